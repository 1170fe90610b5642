"""Carrier queries of sparse convolution, rooms, clustering and estimation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators import estimation as ES
from gridloom.operators import graph as GR
from gridloom.operators import rooms as RM
from gridloom.operators import sparse as SP
from gridloom.operators import statistics as ST
from gridloom.plans.carriers import POINTS_SQL, Registry, points, r6
from gridloom.plans.matching import _EDGES, pairs, sparse_edges
from gridloom.session import ship, table

R = Registry()
K = ["sx", "sy"]
_SITES = "t AS (SELECT floor(x / 2)::BIGINT AS sx, floor(y * 2)::BIGINT AS sy, avg(z) AS a, max(w) AS b FROM p GROUP BY ALL)"


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([POINTS_SQL, _SITES, *more])} {body}"


def sites(spark, sf):
    return points(spark, sf).groupBy(grid.chunk_key("x", 2).alias("sx"), grid.chunk_key(F.col("y") * 2, 1).alias("sy")).agg(F.avg("z").alias("a"), F.max("w").alias("b"))


def weight(tap: int, i: int, o: int) -> float:
    """A fixed rule for weights, so that SQL can follow it."""
    return ((tap * 7 + i * 3 + o * 5) % 11 - 5) / 10.0


def table_of(taps: int, ins: int, outs: int):
    return [[[weight(t, i, o) for o in range(outs)] for i in range(ins)] for t in range(taps)]


_W = "((tap * 7 + {i} * 3 + {o} * 5) % 11 - 5) / 10.0::DOUBLE"


def _y(o: int, bias: float) -> str:
    return f"round(sum(a * {_W.format(i=0, o=o)} + b * {_W.format(i=1, o=o)}) + {bias}, 5) AS y{o}"


@R.add("agg25_input_layer", sql("SELECT floor(x)::BIGINT AS sx, semantic, arg_min(round(z, 6), (id, z)) AS first_z, arg_max(round(z, 6), (id, z)) AS last_z, round(sum(w), 7) AS sum_w, round(avg(nx), 6) AS mean_nx FROM p GROUP BY ALL"))
def input_layer(spark, sf):
    p = points(spark, sf).select("semantic", grid.chunk_key("x", 1).alias("sx"), F.struct("id", "z").alias("ord"), F.round("z", 6).alias("z"), "w", "nx")
    keys, out = ["sx", "semantic"], None
    for mode, column, name in (("first", "z", "first_z"), ("last", "z", "last_z"), ("sum", "w", "sum_w"), ("mean", "nx", "mean_nx")):
        part = SP.input_layer(p, keys, "ord", [column], mode).withColumnRenamed(column, name)
        out = part if out is None else out.join(part, keys)
    return out.select(*keys, "first_z", "last_z", F.round("sum_w", 7).alias("sum_w"), F.round("mean_nx", 6).alias("mean_nx"))


@R.add("scn2_jn21_rule_book", sql("SELECT tap AS \"offset\", count(*) AS n, sum(o.sx * 1000 + o.sy)::BIGINT AS outs FROM t i, (SELECT unnest(range(0, 9)) AS tap) JOIN t o ON o.sx = i.sx - (tap // 3 - 1) AND o.sy = i.sy - (tap % 3 - 1) GROUP BY tap"))
def rule_book(spark, sf):
    return SP.rules(sites(spark, sf), K, [3, 3]).groupBy(F.col("offset").cast("long").alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sx") * 1000 + F.col("sy")).alias("outs"))


@R.add("scn2_scn5_submanifold", sql(f"SELECT o.sx AS sx, o.sy AS sy, {_y(0, 0.5)}, {_y(1, -0.25)}, {_y(2, 0.0)} FROM t i, (SELECT unnest(range(0, 9)) AS tap) JOIN (SELECT sx, sy FROM t) o ON o.sx = i.sx - (tap // 3 - 1) AND o.sy = i.sy - (tap % 3 - 1) GROUP BY o.sx, o.sy"))
def submanifold(spark, sf):
    out = SP.submanifold(sites(spark, sf), K, ["a", "b"], [3, 3], table_of(9, 2, 3), [0.5, -0.25, 0.0])
    return out.select(*K, *[F.round(f"y{o}", 5).alias(f"y{o}") for o in range(3)])


_STRIDED = "(SELECT t.*, ox, oy, (t.sx - 2 * ox) * 3 + (t.sy - 2 * oy) AS tap FROM t, (SELECT unnest(range(0, 31)) AS ox) a, (SELECT unnest(range(0, 31)) AS oy) b WHERE t.sx - 2 * ox BETWEEN 0 AND 2 AND t.sy - 2 * oy BETWEEN 0 AND 2)"


@R.add("scn3_strided", sql(f"SELECT ox AS sx, oy AS sy, {_y(0, 0.1)}, {_y(1, 0.2)} FROM {_STRIDED} GROUP BY ox, oy"))
def strided(spark, sf):
    s = sites(spark, sf)
    out = SP.strided(s, K, ["a", "b"], 3, 2, SP.extent_of(s, K, 3, 2), table_of(9, 2, 2), [0.1, 0.2])
    return out.select(*K, *[F.round(f"y{o}", 5).alias(f"y{o}") for o in range(2)])


@R.add("scn3_transposed", sql(f"SELECT s.sx AS sx, s.sy AS sy, {_y(0, 0.0).replace(", 5)", ", 8)")} FROM (SELECT sx, sy, ox, oy, tap FROM {_STRIDED}) s JOIN (SELECT sx // 2 AS ox, sy // 2 AS oy, avg(a) AS a, avg(b) AS b FROM t GROUP BY ALL) c USING (ox, oy) GROUP BY s.sx, s.sy"))
def transposed(spark, sf):
    s = sites(spark, sf)
    coarse = SP.pool(s, K, ["a", "b"], 2, "active")
    out = SP.transposed(coarse, s, K, ["a", "b"], 3, 2, SP.extent_of(s, K, 3, 2), table_of(9, 2, 1), [0.0])
    return out.select(*K, F.round("y0", 8).alias("y0"))


@R.add("agg26_pooling", sql("SELECT sx // 2 AS sx, sy // 2 AS sy, round(max(a), 6) AS m, round(sum(a) / 4, 6) AS v, round(avg(a), 6) AS t FROM t GROUP BY ALL"))
def pooling(spark, sf):
    s, out = sites(spark, sf), None
    for mode, name in (("max", "m"), ("average", "v"), ("active", "t")):
        part = SP.pool(s, K, ["a"], 2, mode).select(*K, r6("a", name))
        out = part if out is None else out.join(part, K)
    return out


@R.add("agg26_unpooling", sql("SELECT t.sx AS sx, t.sy AS sy, round(m, 6) AS m FROM t JOIN (SELECT sx // 2 AS cx, sy // 2 AS cy, max(a) AS m FROM t GROUP BY ALL) c ON c.cx = t.sx // 2 AND c.cy = t.sy // 2"))
def unpooling(spark, sf):
    s = sites(spark, sf)
    return SP.unpool(SP.pool(s, K, ["a"], 2, "max"), s, K, 2).select(*K, r6("a", "m"))


@R.add("agg27_scn7_batch_norm", sql("SELECT sx, sy, round(CASE WHEN v > 0 THEN v ELSE v * 0.1 END, 5) AS a FROM (SELECT sx, sy, (a - m) / sqrt(s + 1e-4) AS v FROM t, (SELECT avg(a) AS m, var_pop(a) AS s FROM t))"))
def batch_norm(spark, sf):
    return SP.batch_norm(sites(spark, sf), ["a"], leak=0.1).select(*K, F.round("a", 5).alias("a"))


@R.add("scn7_network_in_network", sql("SELECT sx, sy, round(a * 0.5 - b * 2 + 1, 6) AS y0, round(b * 3 - a, 6) AS y1 FROM t"))
def network_in_network(spark, sf):
    out = SP.linear(sites(spark, sf), ["a", "b"], [[0.5, -1.0], [-2.0, 3.0]], [1.0, 0.0])
    return out.select(*K, r6("y0", "y0"), r6("y1", "y1"))


@R.add("scn6_locations", sql("SELECT sx, count(*) AS n, min(sy) AS low, max(sy) AS high FROM t WHERE a > 4.5 GROUP BY sx"))
def locations(spark, sf):
    """Sites whose feature passes a threshold."""
    return sites(spark, sf).where("a > 4.5").groupBy("sx").agg(F.count(F.lit(1)).alias("n"), F.min("sy").alias("low"), F.max("sy").alias("high"))


@R.add("scn8_unet")
def unet(spark, sf):
    """Two levels down and up again; the weights follow a fixed rule."""
    def params(name, ins, outs, taps):
        return [[[weight(t + len(name), i, o) / ins for o in range(outs)] for i in range(ins)] for t in range(taps)], [0.01] * outs

    s = sites(spark, sf)
    out = SP.unet(s, K, ["a", "b"], 2, SP.extent_of(s, K, 2, 2), params)
    return out.select(*K, F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@R.add("agg14_instances", sql("SELECT submap, instance, arg_max(semantic, (k, semantic)) AS semantic, sum(k)::BIGINT AS n, round(sum(sx) / sum(k), 5) AS x FROM (SELECT submap, instance, semantic, count(*) AS k, sum(x) AS sx FROM p WHERE instance IS NOT NULL GROUP BY ALL) GROUP BY ALL HAVING sum(k) >= 5"))
def instance_nodes(spark, sf):
    out = RM.instances(points(spark, sf).where("instance IS NOT NULL"), ["submap", "instance"], "semantic", ["x", "y", "z"], 5)
    return out.select("submap", "instance", "semantic", "n", F.round("x", 5).alias("x"))


_HIST = "h AS (SELECT o_custkey AS room, o_orderpriority AS label, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), nn AS (SELECT room, sum(n * n) AS sq FROM h GROUP BY room)"


def room_hist(spark, sf):
    return RM.histograms(table(spark, sf, "orders").select(F.col("o_custkey").alias("room"), F.col("o_orderpriority").alias("label")), "room", "label")


@R.add("agg14_histogram", f"WITH {_HIST} SELECT room, label, n FROM h")
def histogram(spark, sf):
    return room_hist(spark, sf)


@R.add("top3_nearest_rooms", f"""WITH {_HIST}, dots AS (SELECT x.room AS query, y.room AS room, sum(x.n * y.n) AS dot FROM h x JOIN h y USING (label) WHERE x.room % 100 = 0 GROUP BY ALL),
  d AS (SELECT a.room AS query, b.room AS room, a.sq + b.sq - 2 * coalesce(dot, 0) AS distance FROM nn a JOIN nn b ON a.room <> b.room LEFT JOIN dots ON dots.query = a.room AND dots.room = b.room WHERE a.room % 100 = 0)
  SELECT query, room, distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, room) AS rank FROM d) WHERE rank <= 20""")
def nearest_rooms(spark, sf):
    """The 20 nearest rooms of the query set, every room whose id is divisible by 100, among all rooms."""
    hist = room_hist(spark, sf)
    query = hist.select("room").distinct().where("room % 100 = 0")
    return RM.nearest_rooms(hist, query, "room", "label", 20).select("query", "room", "distance", "rank")


@R.add("agg15_instance_score", sql("""SELECT side, round(sum(CASE WHEN m = 0 THEN 0 WHEN m / n < 0.1 THEN CASE side WHEN 'ref' THEN -0.1 ELSE -0.5 END ELSE least(m / n, 1) END) / count(*), 6) AS score
  FROM (SELECT CASE WHEN frame <= 3 THEN 'ref' ELSE 'new' END AS side, instance, count(*)::DOUBLE AS n, sum((z > 8.5)::INT)::DOUBLE AS m FROM p WHERE instance IS NOT NULL GROUP BY ALL HAVING count(*) > 200) GROUP BY side"""))
def instance_score(spark, sf):
    p = points(spark, sf).where("instance IS NOT NULL").select(F.when(F.col("frame") <= 3, "ref").otherwise("new").alias("side"), "instance", (F.col("z") > 8.5).alias("m"))
    return RM.instance_score(p, "side", "instance", "m", 200, {"ref": -0.1, "new": -0.5}).select("side", r6("score", "score"))


_V = "v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")], "label")


@R.add("jn15_range_join", f"WITH {_V} SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.1")
def range_join(spark, sf):
    return RM.near_pairs(vectors(spark, sf), "vec_id", ["x", "y", "z"], 0.1).select("a", "b", r6("distance", "distance"))


@R.add("jn16_nearest_join", f"WITH {_V} SELECT a.vec_id, arg_min(b.vec_id, (d, b.vec_id)) AS match, round(min(sqrt(d)), 6) AS distance FROM (SELECT a.vec_id, b.vec_id AS bid, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) a, LATERAL (SELECT a.bid AS vec_id) b WHERE d <= 0.15 ** 2 GROUP BY a.vec_id")
def nearest_join(spark, sf):
    v = vectors(spark, sf)
    out = RM.nearest(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "tid"), "vec_id", "tid", ["x", "y", "z"], 0.15)
    return out.select("vec_id", "match", r6("distance", "distance"))


@R.add("jn17_projective_z_buffer", sql("SELECT a.camera, a.u, a.v, a.id FROM (SELECT camera, floor(x)::BIGINT AS u, floor(y)::BIGINT AS v, arg_min(id, (z, id)) AS id, min(z) AS z FROM p GROUP BY ALL) a JOIN (SELECT (camera + 1) % 5 AS camera, floor(x)::BIGINT AS u, floor(y)::BIGINT AS v, min(z) AS z FROM p GROUP BY ALL) b USING (camera, u, v) WHERE abs(a.z - b.z) < 0.05"))
def projective(spark, sf):
    p = points(spark, sf).withColumns({"u": grid.chunk_key("x", 1), "v": grid.chunk_key("y", 1)})
    a = p.groupBy("camera", "u", "v").agg(F.min(F.struct("z", "id")).alias("m"))
    b = p.groupBy(((F.col("camera") + 1) % 5).alias("camera"), "u", "v").agg(F.min("z").alias("z2"))
    return a.join(b, ["camera", "u", "v"]).where(F.abs(F.col("m.z") - F.col("z2")) < 0.05).select("camera", "u", "v", "m.id")


def subdivision():
    s = RM.Subdivision((0.0, 0.0), (60.0, 60.0))
    for i, (n, d) in enumerate([((1.0, 0.0), -20.0), ((0.0, 1.0), -25.0), ((0.6, 0.8), -40.0)]):
        s.insert(n, d, i)
    return s


@R.add("jn18_jn19_point_face", sql("SELECT face, count(*) AS n FROM (SELECT (x < 20)::INT * 4 + (y < 25)::INT * 2 + (0.6 * x + 0.8 * y < 40)::INT AS face FROM p WHERE abs(x - 20) > 1e-6 AND abs(y - 25) > 1e-6 AND abs(0.6 * x + 0.8 * y - 40) > 1e-6) GROUP BY face"))
def point_face(spark, sf):
    """Points to the faces of a subdivision; a face is named by the sides of its lines that it lies on."""
    s = subdivision()
    x, y = F.col("x"), F.col("y")
    place = F.lit(None).cast("int")
    for f in reversed(s.faces):
        inside = F.lit(True)
        for a, b in zip(f, f[1:] + f[:1], strict=True):
            inside = inside & ((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9)
        cx, cy = sum(c[0] for c in f) / len(f), sum(c[1] for c in f) / len(f)
        place = F.when(inside, F.lit((cx < 20) * 4 + (cy < 25) * 2 + (0.6 * cx + 0.8 * cy < 40))).otherwise(place)
    off = (F.abs(x - 20) > 1e-6) & (F.abs(y - 25) > 1e-6) & (F.abs(0.6 * x + 0.8 * y - 40) > 1e-6)
    return points(spark, sf).where(off).select(place.alias("face")).groupBy("face").agg(F.count(F.lit(1)).alias("n"))


@R.add("agg23_edge_weights", sql("SELECT submap, CASE WHEN n < 100 OR e / 50 <= 0.4 THEN 0 ELSE round(e / 50 * n, 4) END AS weight FROM (SELECT submap, count(*) AS n, max(x) - min(x) AS e FROM p WHERE abs(z - 5) < 1.5 GROUP BY submap)"))
def edge_weights(spark, sf):
    g = points(spark, sf).where("abs(z - 5) < 1.5").groupBy("submap").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("e"))
    ratio = F.col("e") / 50
    return g.select("submap", F.when((F.col("n") < 100) | (ratio <= 0.4), F.lit(0.0)).otherwise(F.round(ratio * F.col("n"), 4)).alias("weight"))


@R.add("top7_argmax", sql("SELECT submap, arg_max(semantic, (s, -semantic)) AS best FROM (SELECT submap, semantic, round(sum(w), 6) AS s FROM p GROUP BY ALL) GROUP BY submap"))
def argmax(spark, sf):
    s = points(spark, sf).groupBy("submap", "semantic").agg(F.round(F.sum("w"), 6).alias("s"))
    return s.groupBy("submap").agg(F.max_by("semantic", F.struct("s", -F.col("semantic"))).alias("best"))


@R.add("agg29_gaussian_membership", f"WITH {_V}, c AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v GROUP BY label) SELECT vec_id, round(exp(-((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) / 0.5), 6) AS m FROM v JOIN c USING (label)")
def gaussian_membership(spark, sf):
    v = vectors(spark, sf)
    c = v.groupBy("label").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    gap = sum(((F.col(a) - F.col(f"m{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    return v.join(c, "label").select("vec_id", r6(F.exp(-gap / 0.5), "m"))


@R.add("itr25_k_medoids")
def k_medoids(spark, sf):
    """Classes by the distances of their centroids; as many rows as classes."""
    c = vectors(spark, sf).groupBy("label").agg(*[F.avg(a).alias(a) for a in "xyz"])
    gap = sum(((F.col(f"a.{x}") - F.col(f"b.{x}")) ** 2 for x in "xyz"), F.lit(0.0))
    d = c.alias("a").join(c.alias("b"), F.col("a.label") != F.col("b.label")).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.sqrt(gap).alias("d"))
    own, _ = RM.medoids(d, [0, 1])
    return spark.createDataFrame(sorted(own.items()), "label int, cluster int")


@R.add("itr26_k_means")
def k_means(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, sf).select("vec_id", array_to_vector(F.array("x", "y", "z")).alias("features"))
    return KMeans(k=3, seed=1, maxIter=10).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@R.add("itr27_mean_shift")
def mean_shift(spark, sf):
    """Modes of the points, followed until they stand still, and the cluster of each point."""
    out = RM.mean_shift_clusters(vectors(spark, sf), "vec_id", ["x", "y", "z"], 0.3)
    return out.select("vec_id", *[r6(f"m_{a}", a) for a in "xyz"], "cluster")


@R.add("itr1_itr5_ransac")
def ransac_motion(spark, sf):
    """Rigid motion of each correspondence by samples of four, with a part of the matches wrong, refined with Huber weights."""
    wrong = F.col("id") % 4 == 0
    noisy = pairs(spark, sf).withColumn("qx", F.when(wrong, F.col("qx") + F.col("w") * 300).otherwise(F.col("qx"))).withColumn("qz", F.col("pz") + 1.0)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "px", "py", "pz"])
        p, q = pdf[["px", "py", "pz"]].to_numpy(float), pdf[["qx", "qy", "qz"]].to_numpy(float)
        model, ok = ES.ransac(ES.Rigid(4, None), np.hstack([p, q]), 0.05, 400, int(pdf["corr"].iloc[0]))
        if model is None or ok.sum() < 30:
            return pd.DataFrame({"corr": [], "n_inliers": [], "r0": [], "t0": []}).astype({"corr": "int64", "n_inliers": "int64"})
        r, t, _ = ES.huber_refine(p[ok], q[ok], *ES.rigid_fit(p[ok], q[ok]))
        return pd.DataFrame({"corr": [pdf["corr"].iloc[0]], "n_inliers": [int(ok.sum())], "r0": [round(float(r[0, 0]), 4)], "t0": [round(float(t[0]), 3)]})

    return RM.by_group(noisy, ["corr"], "corr long, n_inliers long, r0 double, t0 double", fit)


@R.add("itr3_plane_ransac")
def ransac_planes(spark, sf):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
        _, ok = ES.ransac(ES.Plane(), xyz, 0.5, 100, 7)
        return pd.DataFrame({"submap": [pdf["submap"].iloc[0]], "n": [len(xyz)], "n_inliers": [int(ok.sum())]})

    return RM.by_group(points(spark, sf).select("submap", "x", "y", "z"), ["submap"], "submap long, n long, n_inliers long", fit)


@R.add("flt10_distance_peers")
def distance_peers(spark, sf):
    """Matches that keep the distance to one of eight random others, five times over."""
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "px", "py", "pz"]).reset_index(drop=True)
        n = len(pdf)
        for turn in range(5):
            p, q = pdf[["px", "py", "pz"]].to_numpy(float), pdf[["qx", "qy", "qz"]].to_numpy(float)
            pdf = pdf[ES.keeps_distance(p, q, 8, 0.015, turn)].reset_index(drop=True)
        return pd.DataFrame({"corr": [int(pdf["corr"].iloc[0])] if len(pdf) else [], "n": [n] if len(pdf) else [], "kept": [len(pdf)] if len(pdf) else []}).astype("int64")

    return RM.by_group(pairs(spark, sf).drop("camera", "frame"), ["corr"], "corr long, n long, kept long", keep)


@R.add("itr19_agg21_plane_growing")
def plane_growing(spark, sf):
    """Planes of each agent's submaps by region growing; a submap's wall points are one task's."""
    scaled = points(spark, sf).select("submap", "camera", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), (F.col("z") / 10).alias("z"), "nx", "ny", "nz")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "z", "nx", "ny", "nz"])
        label = RM.grow_planes(pdf[["x", "y", "z"]].to_numpy(float), pdf[["nx", "ny", "nz"]].to_numpy(float), 0.5, 20)
        found, n = np.unique(label, return_counts=True)
        return pd.DataFrame({"submap": pdf["submap"].iloc[0], "camera": pdf["camera"].iloc[0], "plane": found.astype("int64"), "n": n.astype("int64")})

    return RM.by_group(scaled, ["submap", "camera"], "submap long, camera long, plane long, n long", grow, costly=True)


@R.add("itr21_lines")
def wall_lines(spark, sf):
    """Lines of the submaps' points in the plane, near-duplicates joined to the first."""
    fits = ST.planes(points(spark, sf), ["submap"], ["x", "y"]).orderBy("submap").collect()
    own = RM.merge_lines([(np.array(r.normal), r.offset) for r in fits])
    return spark.createDataFrame([(r.submap, int(k)) for r, k in zip(fits, own, strict=True)], "submap long, line int")


@R.add("itr22_itr24_room_extraction")
def room_extraction(spark, sf):
    """Faces between the wall lines, and which of them are the room.

    Lines are fitted to strips of the points ten wide, each way, and inserted into the box of
    all points; a side's weight is AGG23's, by the points along it; the room is what those
    part from the outside. Lines and sides are few by nature: one floor of a building.
    """
    schema = "face int, area double, n_sides int, in_room boolean"
    p = points(spark, sf).select("x", "y")
    box = p.agg(*[f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("low_", F.min), ("high_", F.max))]).first()
    if box.low_x is None or box.low_x == box.high_x or box.low_y == box.high_y:
        return spark.createDataFrame([], schema)
    fits = [r for a in "xy" for r in ST.planes(p.withColumn("strip", F.floor(F.col(a) / 10)), ["strip"], ["x", "y"]).where("n >= 100").orderBy("strip").collect()]
    lines = [(np.array(r.normal), r.offset) for r in fits]
    s = RM.Subdivision((box.low_x, box.low_y), (box.high_x, box.high_y))
    first = {}
    for line, k in zip(lines, RM.merge_lines(lines), strict=True):
        first.setdefault(k, line)
    for k, (normal, offset) in first.items():
        s.insert(normal, offset, k)
    sides = s.sides()
    told = {r.side: r.weight for r in RM.side_weights(p, list(sides.values()), 0.5).collect()}
    weights = {pair: told.get(i, 0.0) for i, pair in enumerate(sides)}
    room = set(RM.room_faces(weights, len(s.faces)))
    rows = [(i, round(float(a), 4), sum(i in pair for pair in sides), i in room) for i, a in enumerate(s.areas())]
    return spark.createDataFrame(rows, schema)


@R.add("itr29_itr31_scene_match")
def scene_match(spark, sf):
    """Every room matched with itself, moved: graphs of its classes' centres, power iteration, verification."""
    named = points(spark, sf).withColumn("kind", F.col("semantic") % 4)
    nodes = RM.instances(named, ["submap", "semantic"], "kind", ["x", "y", "z"], 1)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("semantic")
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        turned = xyz @ np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1.0]]).T + [1, 2, 3]
        found = ES.match_rooms(xyz, pdf["kind"].tolist(), turned, pdf["kind"].tolist(), rounds=300)
        n = len(found[1]) if found else 0
        right = sum(i == j for i, j in found[1]) if found else 0
        return pd.DataFrame({"submap": [pdf["submap"].iloc[0]], "n_nodes": [len(pdf)], "n_pairs": [n], "n_right": [right]})

    return RM.by_group(nodes, ["submap"], "submap long, n_nodes long, n_pairs long, n_right long", match)


@R.add("itr28_instance_segmentation")
def instance_segmentation(spark, sf):
    v = vectors(spark, sf)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        label = ES.instance_clusters(xyz, xyz, -np.abs(xyz).sum(axis=1), np.full((len(xyz), 2), 0.5), least=5)
        return pd.DataFrame({"vec_id": pdf["vec_id"], "instance": label.astype("int64")})

    return RM.by_group(v.withColumn("scene", F.col("label")), ["scene"], "vec_id long, instance long", cluster)


@R.add("itr11_itr12_pose_graph")
def pose_graph(spark, sf):
    """Poses of the agents from the sums of their correspondences; one row for each agent."""
    p = points(spark, sf)
    moved = [F.col("x") + F.col("camera") * 0.5, F.col("y") - F.col("camera") * 0.25, F.col("z")]
    seen = p.select("camera", F.lit(1.0).alias("w"), *[F.col(a).alias(f"p{a}") for a in "xyz"], *[m.alias(f"q{a}") for m, a in zip(moved, "xyz", strict=True)])
    stats = ST.sums(seen, ["camera"], ["px", "py", "pz"], ["qx", "qy", "qz"], "w").orderBy("camera").collect()
    edges = []
    for r in stats:
        m = lambda n, r=r: np.array([[r[f"{n}{min(a, b)}{max(a, b)}"] for b in "xyz"] for a in "xyz"])
        edges.append({"i": 0, "j": r.camera + 1, "w": r.w, "p": np.array([r[f"p{a}"] for a in "xyz"]), "q": np.array([r[f"q{a}"] for a in "xyz"]), "pq": np.array([[r[f"pq{a}{b}"] for b in "xyz"] for a in "xyz"]), "pp": m("pp"), "qq": m("qq")})
    poses, errors = GR.solve_poses([np.eye(4)] * (len(stats) + 1), edges)
    rows = [(i, *[round(float(x), 4) + 0.0 for x in t[:3, 3]], len(errors) > 0) for i, t in enumerate(poses)]
    return spark.createDataFrame(rows, "pose int, tx double, ty double, tz double, solved boolean")


@R.add("vox10_raycast")
def raycast(spark, sf):
    """Cells that the segment from the origin to each point passes, in order."""
    ship(spark)
    schema = "id long, step int, cx long, cy long, cz long"

    def walk(it):
        from gridloom.operators.meshing import traversed

        for pdf in it:
            rows = [(i, n, *c) for i, x, y, z in pdf.itertuples(index=False) for n, c in enumerate(traversed((0, 0, 0), (x, y, z), 8.0))]
            yield pd.DataFrame(rows, columns=["id", "step", "cx", "cy", "cz"])

    return points(spark, sf).select("id", "x", "y", "z").mapInPandas(walk, schema)


@R.add("set2_agents_by_component", f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  r(node, root) AS (SELECT u, u FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v)
  SELECT root, count(*) AS n FROM (SELECT node, min(root) AS root FROM r GROUP BY node) GROUP BY root""")
def component_sizes(spark, sf):
    return GR.components(sparse_edges(spark, sf)).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@R.add("vox8_marching_cubes")
def marching_cubes(spark, sf):
    """Triangles of the surface where the mean depth of the cells is 4.5, cell by cell."""
    from gridloom.operators import meshing
    from gridloom.plans.voxels import cells

    keys = ["cx", "cy", "cz"]
    means = cells(spark, sf).groupBy(*keys).agg(((F.avg("z") - 4.5) / 10).alias("v"))
    return meshing.surface(means, keys, "v").select(*keys, "triangle", *[r6(f"{a}{i}", f"{a}{i}") for i in range(3) for a in "xyz"])


@R.add("vox12_quadric_simplification")
def quadric(spark, sf):
    """A sampled height field of each agent, simplified to a quarter of its triangles."""
    from gridloom.operators import meshing

    heights = points(spark, sf).groupBy("camera", grid.chunk_key("x", 4).alias("u"), grid.chunk_key("y", 4).alias("v")).agg(F.avg("z").alias("h"))

    def simplify(pdf: pd.DataFrame) -> pd.DataFrame:
        vertices, faces = meshing.height_field(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["h"].to_numpy())
        v, f = meshing.collapse(vertices, faces, max(4, len(faces) // 4))
        return pd.DataFrame({"camera": [pdf["camera"].iloc[0]], "faces": [len(faces)], "left": [len(f)], "vertices": [len(v)]})

    return RM.by_group(heights, ["camera"], "camera long, faces long, left long, vertices long", simplify)


@R.add("win_room_rank", sql("SELECT submap, camera, n, rank() OVER (PARTITION BY submap ORDER BY n DESC)::INTEGER AS rank FROM (SELECT submap, camera, count(*) AS n FROM p GROUP BY ALL)"))
def room_rank(spark, sf):
    n = points(spark, sf).groupBy("submap", "camera").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.rank().over(Window.partitionBy("submap").orderBy(F.desc("n"))))
