"""Carrier queries of descriptor retrieval, correspondences, statistics and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import graph as GR
from gridloom.operators import retrieval as RT
from gridloom.operators import statistics as ST
from gridloom.plans.carriers import BANDS, FEATURES_SQL, POINTS_SQL, Registry, features, points, r6
from gridloom.session import cut, table

R = Registry()
_H = "(bit_count(xor(a.b0, b.b0)) + bit_count(xor(a.b1, b.b1)) + bit_count(xor(a.b2, b.b2)) + bit_count(xor(a.b3, b.b3)))::BIGINT"
_BANDED = "band AS (" + " UNION ALL ".join(f"SELECT *, {i} AS table_id, b{i} AS entry FROM f" for i in range(4)) + ")"
#: Images hold eight features each.
_IMG = "g AS (SELECT *, vec_id // 8 AS image FROM f)"


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([FEATURES_SQL, *more])} {body}"


@R.add("jn1_band_codes", sql("SELECT vec_id, table_id::INTEGER AS table_id, entry FROM band", _BANDED))
def band_codes(spark, sf):
    return RT.by_band(features(spark, sf), BANDS).select("vec_id", "table_id", "entry")


_NEIGHBOUR = """SELECT q AS vec_id, arg_min(t, (h, t)) AS match, min(h) AS distance FROM (SELECT a.vec_id AS q, b.vec_id AS t, {h} AS h FROM {a} a JOIN {b} b ON {on}) GROUP BY q"""
_SHARE = "a.table_id = b.table_id AND a.entry = b.entry AND a.vec_id <> b.vec_id"


def other():
    """A feature is not matched with itself."""
    return F.col("q.vec_id") != F.col("t.vec_id")


@R.add("jn2_band_match", sql(_NEIGHBOUR.format(h=_H, a="band", b="band", on=_SHARE) + " HAVING min(h) < 50", _BANDED))
def band_match(spark, sf):
    f = features(spark, sf)
    return RT.band_matches(f, f, BANDS, "vec_id", "vec_id", 50, extra=other())


@R.add("jn3_band_match_all", sql("SELECT f.vec_id, match, coalesce(distance, 256) AS distance FROM f LEFT JOIN (" + _NEIGHBOUR.format(h=_H, a="band", b="band", on=_SHARE) + ") m USING (vec_id)", _BANDED))
def band_match_all(spark, sf):
    f = features(spark, sf)
    return RT.band_matches(f, f, BANDS, "vec_id", "vec_id", None, how="left", extra=other())


@R.add("jn4_ranged_match", sql(_NEIGHBOUR.format(h=_H, a="band", b="band", on=_SHARE + " AND (a.label - b.label) * (a.label - b.label) < 4") + " HAVING min(h) < 76", _BANDED))
def ranged_match(spark, sf):
    """Only train features near the predicted place count."""
    f = features(spark, sf)
    near = other() & ((F.col("q.label") - F.col("t.label")) * (F.col("q.label") - F.col("t.label")) < 4)
    return RT.band_matches(f, f, BANDS, "vec_id", "vec_id", 76, extra=near)


@R.add("jn5_brute_match", sql(_NEIGHBOUR.format(h=_H, a="f", b="f", on="a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id")))
def brute_match(spark, sf):
    """Exhaustive nearest of the query set, every row whose id is divisible by 100, among all others: the test of the band joins."""
    f = features(spark, sf)
    # The query set is stated and taken in blocks by hash, so that no task holds all of it.
    q = f.where("vec_id % 100 = 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    t = f.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
    pairs = q.alias("q").join(t.alias("t"), (F.col("q.block") == F.col("t.block")) & (F.col("q.vec_id") != F.col("t.vec_id")))
    h = RT.hamming([F.col(f"q.{b}") for b in BANDS], [F.col(f"t.{b}") for b in BANDS]).cast("long")
    best = pairs.groupBy(F.col("q.vec_id").alias("vec_id")).agg(F.min(F.struct(h.alias("h"), F.col("t.vec_id").alias("id"))).alias("m"))
    return best.select("vec_id", F.col("m.id").alias("match"), F.col("m.h").alias("distance"))


@R.add("jn7_multi_probe", sql("SELECT a.vec_id, count(*) AS hits, count(DISTINCT b.vec_id) AS others FROM (SELECT vec_id, table_id, xor(entry, flip) AS entry FROM band, (SELECT unnest([0, " + ", ".join(str(1 << i) for i in range(16)) + "])::BIGINT AS flip)) a JOIN band b ON a.table_id = b.table_id AND a.entry = b.entry AND a.vec_id <> b.vec_id GROUP BY a.vec_id", _BANDED))
def multi_probe(spark, sf):
    """Entries that differ in one bit are looked up as well."""
    banded = RT.by_band(features(spark, sf), BANDS).select("vec_id", "table_id", "entry")
    asked = RT.probes(banded, 16, 1).select(F.col("vec_id").alias("asker"), "table_id", "entry")
    hits = asked.join(banded, ["table_id", "entry"]).where("asker <> vec_id")
    return hits.groupBy(F.col("asker").alias("vec_id")).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("vec_id").alias("others"))


_POST = "post AS (SELECT table_id, entry, image, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY table_id, entry ORDER BY image) AS r FROM (SELECT table_id, entry, image, min(vec_id) AS vec_id FROM (" + " UNION ALL ".join(f"SELECT vec_id, image, {i} AS table_id, b{i} // 256 AS entry FROM g" for i in range(4)) + ") GROUP BY ALL)) WHERE r <= 200)"
_SCORED = """s AS (SELECT q.image AS query, q.vec_id AS qf, p.image AS image, sum(exp(-(greatest(h, 10)::DOUBLE * greatest(h, 10)) / 900.0)) AS s FROM (
    SELECT a.image, a.vec_id, post.image AS pimage, {h} AS h FROM (""".replace("{h}", _H) + " UNION ALL ".join(f"SELECT *, {i} AS table_id, b{i} // 256 AS entry FROM g" for i in range(4)) + """) a JOIN post USING (table_id, entry) JOIN g b ON b.vec_id = post.vec_id) q(image, vec_id, pimage, h), LATERAL (SELECT pimage AS image) p WHERE h < 64 GROUP BY ALL),
  sc AS (SELECT query, image, sum(s / (t + exp(-400 / 900.0)) * ln(greatest(1.0, (SELECT count(DISTINCT image) FROM g)::DOUBLE / n))) AS score FROM s JOIN (SELECT query, qf, sum(s) AS t, count(*) AS n FROM s GROUP BY ALL) USING (query, qf) GROUP BY ALL)"""


def scored(spark, sf):
    coarse = [F.floor(F.col(b) / 256).cast("long").alias(f"e{i}") for i, b in enumerate(BANDS)]
    g = features(spark, sf).withColumn("image", F.floor(F.col("vec_id") / 8).cast("long"))
    banded = RT.by_band(g.select("*", *coarse), [f"e{i}" for i in range(4)])
    index = RT.postings(banded, "image", "vec_id")
    query = banded.withColumnRenamed("image", "query").withColumnRenamed("vec_id", "qfeature")
    images = g.select(F.countDistinct("image")).first()[0]
    return RT.scores(query, index, g.select("image", "vec_id", *BANDS), BANDS, "image", "vec_id", images)


@R.add("agg1_jn6_jn8_scores", sql("SELECT query, image, round(score, 6) AS score FROM sc", _IMG, _POST, _SCORED))
def tfidf_scores(spark, sf):
    return scored(spark, sf).select("query", "image", r6("score", "score"))


_SALIENT = """sal AS (SELECT query, image, score, CASE WHEN coalesce(k, 0) <= 0 THEN 3.0 WHEN mu < 1e-8 OR k < 3 THEN 1.0 ELSE abs((score - sd) / mu) END AS saliency FROM (
  SELECT *, avg(CASE WHEN i < k THEN score END) OVER w AS mu, stddev_samp(CASE WHEN i < k THEN score END) OVER w AS sd FROM (
    SELECT *, max(CASE WHEN score < m THEN i END) OVER w AS k FROM (SELECT *, avg(score) OVER w AS m, row_number() OVER (PARTITION BY query ORDER BY image) - 1 AS i FROM sc WINDOW w AS (PARTITION BY query))
    WINDOW w AS (PARTITION BY query)) WINDOW w AS (PARTITION BY query)))"""


@R.add("agg2_saliency", sql("SELECT query, image, round(saliency, 5) AS saliency FROM sal", _IMG, _POST, _SCORED, _SALIENT))
def saliency(spark, sf):
    return RT.saliency(scored(spark, sf), "query", "image", "score").select("query", "image", F.round("saliency", 5).alias("saliency"))


@R.add("top1_top2_flt2_candidates", sql("SELECT query, image, rank FROM (SELECT query, image, row_number() OVER (PARTITION BY query ORDER BY round(saliency, 8) DESC, image) AS rank FROM sal JOIN (SELECT query, max(image) AS newest FROM sal GROUP BY query) USING (query) WHERE image < newest AND saliency > 1) WHERE rank <= 6", _IMG, _POST, _SCORED, _SALIENT))
def closure_candidates(spark, sf):
    salient = RT.saliency(scored(spark, sf), "query", "image", "score").withColumn("saliency", F.round("saliency", 8))
    return RT.candidates(salient, "query", "image").select("query", "image", F.col("rank").cast("long").alias("rank"))


@R.add("flt9_top5_main_rotation", f"""WITH {POINTS_SQL}, m AS (SELECT id, submap, (floor(((x * 7 - z * 11 + 360) - 360 * floor((x * 7 - z * 11 + 360) / 360)) / 20 + 0.5)::BIGINT % 18) AS bin FROM p),
  k AS (SELECT *, row_number() OVER w AS r, first_value(n) OVER w AS top, first_value(bin) OVER w AS mode FROM (SELECT submap, bin, count(*) AS n FROM m GROUP BY ALL) WINDOW w AS (PARTITION BY submap ORDER BY n DESC, bin))
  SELECT id, submap, bin FROM m JOIN (SELECT submap, bin FROM k WHERE (bin - mode + 18) % 18 IN (0, 1, 17) OR r <= 3 AND n >= 0.1 * top) USING (submap, bin)""")
def main_rotation(spark, sf):
    from gridloom.functions.geometry import angle_bin

    m = points(spark, sf).select("id", "submap", angle_bin(F.col("x") * 7, F.col("z") * 11).alias("bin"))
    return RT.main_rotation(m, "submap", "bin").select("id", "submap", "bin")


@R.add("flt3_pruned_candidates", sql("SELECT a.vec_id AS q, b.vec_id AS c FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id WHERE abs(a.vec_id // 8 - b.vec_id // 8) > 2 AND (abs(a.vec_id // 8 - b.vec_id // 8) <= 12 OR b.vec_id // 8 % 3 <> 0)"))
def pruned_candidates(spark, sf):
    """Candidates of the same agent; far ones go if their submap has a room already."""
    f = features(spark, sf).select("vec_id", "label", F.floor(F.col("vec_id") / 8).cast("long").alias("submap"))
    rooms = f.select(F.col("submap").alias("c_submap")).distinct().where("c_submap % 3 = 0").withColumn("room", F.lit(True))
    pairs = f.alias("a").join(f.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    pairs = pairs.select(F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("c"), F.abs(F.col("a.submap") - F.col("b.submap")).alias("gap"), F.col("b.submap").alias("c_submap"))
    return pairs.join(rooms, "c_submap", "left").where("gap > 2 AND (gap <= 12 OR room IS NULL)").select("q", "c")


_PAIR = f"{POINTS_SQL}, d AS (SELECT submap AS corr, id, x AS px, y AS py, z AS pz, 0.8 * x - 0.6 * y + 1 AS qx, 0.6 * x + 0.8 * y + 2 AS qy, z + nz AS qz, w AS w FROM p)"


def pairs(spark, sf):
    x, y = F.col("x"), F.col("y")
    return points(spark, sf).select(F.col("submap").alias("corr"), "id", "camera", "frame", x.alias("px"), y.alias("py"), F.col("z").alias("pz"), (x * 0.8 - y * 0.6 + 1).alias("qx"), (x * 0.6 + y * 0.8 + 2).alias("qy"), (F.col("z") + F.col("nz")).alias("qz"), "w")


_P, _Q = ["px", "py", "pz"], ["qx", "qy", "qz"]
_SUM_NAMES = {"w": "w", **{f"p{a}": f"w * p{a}" for a in "xyz"}, **{f"q{a}": f"w * q{a}" for a in "xyz"}, **{f"pq{a}{b}": f"w * p{a} * q{b}" for a in "xyz" for b in "xyz"}, **{f"{n * 2}{a}{b}": f"w * {n}{a} * {n}{b}" for n in "pq" for i, a in enumerate("xyz") for b in "xyz"[i:]}}


@R.add("agg8_sufficient_statistics", f"WITH {_PAIR} SELECT corr, " + ", ".join(f"round(sum({e}), 3) AS {n}" for n, e in _SUM_NAMES.items()) + " FROM d GROUP BY corr")
def sufficient_statistics(spark, sf):
    return ST.sums(pairs(spark, sf), ["corr"], _P, _Q, "w").select("corr", *[F.round(n, 3).alias(n) for n in _SUM_NAMES])


_RT = [0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 0.5]


@R.add("agg9_closed_form_error", f"WITH {_PAIR} SELECT corr, round(sqrt(sum(w * ((0.8 * px - 0.6 * py + 1 - qx) ** 2 + (0.6 * px + 0.8 * py + 2 - qy) ** 2 + (pz + 0.5 - qz) ** 2))) / sum(w), 5) AS error FROM d GROUP BY corr")
def closed_form_error(spark, sf):
    return ST.sums(pairs(spark, sf), ["corr"], _P, _Q, "w").select("corr", F.round(ST.error(*_RT), 5).alias("error"))


@R.add("agg10_error_by_frame", f"""WITH {POINTS_SQL}, g AS (SELECT camera AS a, submap AS b, sum(z * w) AS e, sum(w) AS w FROM p GROUP BY ALL)
  SELECT frame, round(CASE WHEN sum(w) < 1 THEN 1e8 ELSE sum(e * w) / sum(w) END, 4) AS error, round(sum(w), 4) AS weight, count(*) AS degree FROM (SELECT a AS frame, e, w FROM g UNION ALL SELECT b, e, w FROM g) GROUP BY frame""")
def error_by_frame(spark, sf):
    edges = points(spark, sf).groupBy(F.col("camera").alias("a"), F.col("submap").alias("b")).agg(F.sum(F.col("z") * F.col("w")).alias("e"), F.sum("w").alias("w"))
    return ST.by_frame(edges, "a", "b", "e", "w").select("frame", F.round("error", 4).alias("error"), F.round("weight", 4).alias("weight"), "degree")


@R.add("agg11_disparity", f"WITH {_PAIR} SELECT corr, round(sum(sqrt((px / (pz + 1) - qx / (qz + 1)) ** 2 + (py / (pz + 1) - qy / (qz + 1)) ** 2)) / (count(*) + 1), 6) AS disparity FROM d GROUP BY corr")
def disparity(spark, sf):
    gap = F.sqrt((F.col("px") / (F.col("pz") + 1) - F.col("qx") / (F.col("qz") + 1)) ** 2 + (F.col("py") / (F.col("pz") + 1) - F.col("qy") / (F.col("qz") + 1)) ** 2)
    return pairs(spark, sf).groupBy("corr").agg(r6(F.sum(gap) / (F.count(F.lit(1)) + 1), "disparity"))


@R.add("agg13_sum_by_place", f"""WITH {POINTS_SQL}, g AS (SELECT camera AS i, submap AS j, sum(w) AS w, sum(z) AS z FROM p GROUP BY ALL)
  SELECT r AS row, c AS col, round(sum(v), 4) AS v FROM (SELECT i AS r, i AS c, w AS v FROM g UNION ALL SELECT i, j, -z FROM g UNION ALL SELECT j, i, -z FROM g UNION ALL SELECT j, j, w FROM g) GROUP BY r, c""")
def sum_by_place(spark, sf):
    g = points(spark, sf).groupBy("camera", "submap").agg(F.sum("w").alias("w"), F.sum("z").alias("z"))
    out = ST.triplets(g, "camera", "submap", [("i", "i", F.col("w")), ("i", "j", -F.col("z")), ("j", "i", -F.col("z")), ("j", "j", F.col("w"))])
    return out.select("row", "col", F.round("v", 4).alias("v"))


@R.add("agg21_covariances", f"WITH {POINTS_SQL} SELECT submap, count(*) AS n, round(avg(x), 5) AS m0, round(covar_pop(x, y), 4) AS c01, round(covar_pop(y, y), 4) AS c11, round(covar_pop(x, z), 4) AS c02 FROM p GROUP BY submap")
def covariances(spark, sf):
    c = ST.covariance(points(spark, sf), ["submap"], ["x", "y", "z"])
    return c.select("submap", "n", F.round("m0", 5).alias("m0"), *[F.round(n, 4).alias(n) for n in ("c01", "c11", "c02")])


@R.add("agg21_fit_planes")
def fit_planes(spark, sf):
    out = ST.planes(points(spark, sf), ["submap"], ["x", "y", "z"])
    return out.select("submap", "n", *[r6(F.col("normal")[i], f"n{i}") for i in range(3)], r6("offset", "offset"), r6("flatness", "flatness"))


@R.add("agg22_kabsch", f"WITH {_PAIR} SELECT DISTINCT corr, 0.8 AS r0, -0.6 AS r1, 0.6 AS r3, 1.0 AS r8, 1.0 AS t0, 2.0 AS t1 FROM d".replace("0.8 AS r0, -0.6 AS r1, 0.6 AS r3, 1.0 AS r8, 1.0 AS t0, 2.0 AS t1", "0.8::DOUBLE AS r0, -0.6::DOUBLE AS r1, 0.6::DOUBLE AS r3, 1::DOUBLE AS r8, 1::DOUBLE AS t0, 2::DOUBLE AS t1"))
def kabsch(spark, sf):
    """The rigid motion between the sides of each correspondence, which the carrier knows."""
    exact = pairs(spark, sf).withColumn("qz", F.col("pz") + 1.0)
    out = ST.fitted(ST.sums(exact, ["corr"], _P, _Q, "w"), ["corr"])
    return out.select("corr", *[F.round(F.col("r")[i], 5).alias(f"r{i}") for i in (0, 1, 3, 8)], *[F.round(F.col("t")[i], 4).alias(f"t{i}") for i in (0, 1)])


#: Agents (customers) and the places that they were seen at: day and price of an order, in hundreds. Every order is an edge.
_EDGES = "SELECT DISTINCT o_custkey AS u, 1000000000 + datediff('day', DATE '1990-01-01', o_orderdate::DATE) * 100000 + floor(o_totalprice / 100)::BIGINT AS v FROM orders"


def sparse_edges(spark, sf):
    place = F.lit(1_000_000_000) + F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long") * 100_000 + F.floor(F.col("o_totalprice") / 100).cast("long")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("u"), place.alias("v")).distinct()


@R.add("jn22_itr18_components", f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  r(node, root) AS (SELECT u, u FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v)
  SELECT node, min(root) AS root FROM r GROUP BY node""")
def agent_components(spark, sf):
    return GR.components(sparse_edges(spark, sf))


@R.add("itr34_set2_merged_agents", f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  r(node, root) AS (SELECT u, u FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v)
  SELECT s.camera, coalesce(root, s.camera) AS root FROM (SELECT c_custkey AS camera FROM customer) s LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = s.camera""")
def merged_agents(spark, sf):
    """Agents with the group that shares their coordinates; those without a match stay alone."""
    agents = table(spark, sf, "customer").select(F.col("c_custkey").alias("camera"))
    return GR.merged_groups(agents, sparse_edges(spark, sf), "camera").select("camera", "root")


@R.add("top6_best_registration", f"WITH {_PAIR} SELECT corr, arg_min(id, (abs(qx - px), id)) AS best FROM d WHERE w > 0.03 GROUP BY corr")
def best_registration(spark, sf):
    return pairs(spark, sf).where("w > 0.03").groupBy("corr").agg(F.min_by("id", F.struct(F.abs(F.col("qx") - F.col("px")), F.col("id"))).alias("best"))


@R.add("jn23_pose_refresh", f"WITH {POINTS_SQL} SELECT p.id, round(p.x + s.mx, 6) AS x, round(p.y + s.my, 6) AS y FROM p JOIN (SELECT submap, avg(x) AS mx, avg(y) AS my FROM p GROUP BY submap) s USING (submap)")
def pose_refresh(spark, sf):
    """Keyframes take the new pose of their submap; the submap table has one row for each."""
    p = points(spark, sf)
    return p.join(p.groupBy("submap").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), "submap").select("id", r6(F.col("x") + F.col("mx"), "x"), r6(F.col("y") + F.col("my"), "y"))


@R.add("itr17_composed_edges", f"""WITH {POINTS_SQL}, g AS (SELECT camera AS a, submap + 100 AS b, avg(x) AS d FROM p GROUP BY ALL) SELECT e.a AS a, f.b AS b, count(*) AS n, round(sum(e.d - f.d), 5) AS d
  FROM (SELECT a, b, d FROM g) e JOIN (SELECT b AS a, a AS b, d FROM g) f ON e.b = f.a WHERE e.a < f.b GROUP BY ALL""")
def composed_edges(spark, sf):
    g = cut(points(spark, sf).groupBy(F.col("camera").alias("a"), (F.col("submap") + 100).alias("b")).agg(F.avg("x").alias("d")))
    back = g.select(F.col("b").alias("b"), F.col("a").alias("c"), F.col("d").alias("d2"))
    both = g.join(back, "b").where("a < c").groupBy("a", F.col("c").alias("b2")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("d") - F.col("d2")), 5).alias("d"))
    return both.select("a", F.col("b2").alias("b"), "n", "d")
