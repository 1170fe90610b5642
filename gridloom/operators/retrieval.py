"""Retrieval over binary descriptors: bands, postings, scores, saliency, matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distances below which a posting counts, floor and square scale of its score, postings kept of an entry (fixed values of the scoring rule).
NEAR, FLOOR, SCALE, POSTINGS = 64, 10, 900.0, 200


def sign_bands(vector: str, bands: int, bits: int) -> list[Column]:
    """Signs of an array column as integers of so many bits each."""
    return [F.expr(f"aggregate(transform(slice({vector}, {b * bits + 1}, {bits}), (v, i) -> if(v > 0, shiftleft(1L, i), 0L)), 0L, (s, x) -> s + x)") for b in range(bands)]


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def by_band(features: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One row for each band: table_id, entry."""
    return features.select("*", F.posexplode(F.array(*bands)).alias("table_id", "entry"))


def probes(features: DataFrame, bits: int, depth: int) -> DataFrame:
    """Entries, and with depth 1 those that differ in one bit as well."""
    if depth == 0:
        return features
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(bits)])
    return features.select("*", F.explode(flips).alias("__flip")).withColumn("entry", F.col("entry").bitwiseXOR(F.col("__flip"))).drop("__flip")


def postings(features: DataFrame, image: str, feature: str, most: int = POSTINGS) -> DataFrame:
    """Index rows: of an image the first feature in an entry; of an entry the first `most` images (a limit of the scoring rule itself)."""
    first = features.groupBy("table_id", "entry", image).agg(F.min(feature).alias(feature))
    rank = Window.partitionBy("table_id", "entry").orderBy(image)
    return first.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= most).drop("__rank")


def band_matches(query: DataFrame, train: DataFrame, bands: Sequence[str], qid: str, tid: str, most: int | None, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Nearest train feature of each query feature among those that share a band; ties to the least id.

    most: the distance that a match stays below. how="left": a query without any comes
    out as match null at the greatest distance. extra: a further join condition over q and t.
    """
    bits = [F.col(f"q.{b}") for b in bands], [F.col(f"t.{b}") for b in bands]
    q, t = by_band(query, bands).alias("q"), by_band(train, bands).alias("t")
    on = (F.col("q.table_id") == F.col("t.table_id")) & (F.col("q.entry") == F.col("t.entry"))
    if extra is not None:
        on = on & extra
    near = q.join(t, on).select(F.col(f"q.{qid}").alias(qid), F.struct(hamming(*bits).alias("h"), F.col(f"t.{tid}").alias("id")).alias("m"))
    best = near.groupBy(qid).agg(F.min("m").alias("m")).select(qid, F.col("m.id").alias("match"), F.col("m.h").cast("long").alias("distance"))
    if most is not None:
        best = best.where(F.col("distance") < most)
    if how == "left":
        return query.select(qid).join(best, qid, "left").withColumn("distance", F.coalesce("distance", F.lit(256).cast("long")))
    return best


def scores(query: DataFrame, index: DataFrame, codes: DataFrame, bands: Sequence[str], image: str, feature: str, images: int) -> DataFrame:
    """tf-idf-like score of every image against the query's features.

    query: (query, feature columns with bands) by band; index: postings; codes: image,
    feature and bands of indexed features. A posting that collides in two tables counts twice.
    """
    hits = query.alias("q").join(index.alias("p"), (F.col("q.table_id") == F.col("p.table_id")) & (F.col("q.entry") == F.col("p.entry")))
    hits = hits.select(F.col("q.query").alias("query"), F.col("q.qfeature").alias("qfeature"), *[F.col(f"q.{b}").alias(f"q_{b}") for b in bands], F.col(f"p.{image}").alias(image), F.col(f"p.{feature}").alias(feature))
    hits = hits.join(codes, [image, feature]).withColumn("h", hamming([F.col(f"q_{b}") for b in bands], [F.col(b) for b in bands])).where(F.col("h") < NEAR)
    near = F.greatest(F.col("h"), F.lit(FLOOR)).cast("double")
    by = hits.groupBy("query", "qfeature", image).agg(F.sum(F.exp(-near * near / SCALE)).alias("s"))
    total = by.groupBy("query", "qfeature").agg(F.sum("s").alias("all"), F.count(F.lit(1)).alias("n"))
    weight = F.log(F.greatest(F.lit(1.0), F.lit(float(images)) / F.col("n").cast("double")))
    part = F.col("s") / (F.col("all") + F.exp(F.lit(-400.0 / SCALE))) * weight
    return by.join(total, ["query", "qfeature"]).groupBy("query", image).agg(F.sum(part).alias("score"))


def saliency(scored: DataFrame, group: str, order: str, score: str) -> DataFrame:
    """Saliency of scores in order, by group: distance from the spread of the prefix before the last one below the mean."""
    everything = Window.partitionBy(group)
    rows = scored.withColumn("__i", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    rows = rows.withColumn("__m", F.avg(score).over(everything))
    rows = rows.withColumn("__k", F.max(F.when(F.col(score) < F.col("__m"), F.col("__i"))).over(everything))
    prefix = F.when(F.col("__i") < F.col("__k"), F.col(score))
    rows = rows.withColumn("__mu", F.avg(prefix).over(everything)).withColumn("__sd", F.stddev_samp(prefix).over(everything))
    value = F.when(F.coalesce("__k", F.lit(0)) <= 0, F.lit(3.0)).when((F.col("__mu") < 1e-8) | (F.col("__k") < 3), F.lit(1.0)).otherwise(F.abs((F.col(score) - F.col("__sd")) / F.col("__mu")))
    return rows.withColumn("saliency", value).drop("__i", "__m", "__k", "__mu", "__sd")


def candidates(salient: DataFrame, group: str, item: str, least: float = 1.0, most: int = 6) -> DataFrame:
    """Items above a saliency, most salient first, at most so many (a top-k); the newest item is not looked at."""
    newest = Window.partitionBy(group)
    rows = salient.withColumn("__last", F.max(item).over(newest)).where((F.col(item) < F.col("__last")) & (F.col("saliency") > least))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("saliency"), item))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("__last")


def main_rotation(matches: DataFrame, group: str, bin_: str, share: float = 0.1, bins: int = 18) -> DataFrame:
    """Matches whose rotation bin is the most frequent or next to it, or second or third with a share of the first's count; ties to the lower bin."""
    counts = matches.groupBy(group, bin_).agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy(group).orderBy(F.desc("n"), bin_)
    ranked = counts.withColumn("r", F.row_number().over(rank)).withColumn("top", F.first("n").over(rank)).withColumn("mode", F.first(bin_).over(rank))
    gap = F.pmod(F.col(bin_) - F.col("mode"), F.lit(bins))
    kept = ranked.where(gap.isin(0, 1, bins - 1) | ((F.col("r") <= 3) & (F.col("n") >= share * F.col("top"))))
    return matches.join(kept.select(group, bin_), [group, bin_], "left_semi")
