"""Carrier queries of depth integration, resampling, point queries, acceptance rules and the remaining estimators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import grid
from gridloom.operators import estimation as ES
from gridloom.operators import images as IM
from gridloom.operators import rooms as RM
from gridloom.operators import sparse as SP
from gridloom.operators import statistics as ST
from gridloom.operators import voxels as V
from gridloom.plans.carriers import POINTS_SQL, Registry, points, r6
from gridloom.plans.matching import _PAIR, pairs
from gridloom.plans.rooms import _SITES, K, sites, table_of, vectors

R = Registry()


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([POINTS_SQL, *more])} {body}"


_COLUMNS = "d AS (SELECT camera, floor(x / 2)::BIGINT AS u, floor(y / 2)::BIGINT AS v, avg(z) / 10 + 0.5 AS depth FROM p GROUP BY ALL)"


def depth_picture(spark, sf):
    return points(spark, sf).groupBy("camera", grid.chunk_key("x", 2).alias("u"), grid.chunk_key("y", 2).alias("v")).agg((F.avg("z") / 10 + 0.5).alias("depth"))


@R.add("vox5_integrate_depth", sql("""SELECT u, v, k, round(sum(s) / (sum(w) + 1e-4), 6) + 0 AS sdf, sum(w)::BIGINT AS weight FROM (
  SELECT u, v, k, depth - (k * 0.05::DOUBLE + 0.025::DOUBLE) AS s, 1 AS w FROM d, (SELECT unnest(range(0, (floor((SELECT max(depth) FROM d) / 0.05) + 2)::BIGINT)) AS k)) WHERE s > -0.03 AND s < 0.15 GROUP BY ALL HAVING sum(w) > 0.5""", _COLUMNS))
def integrate_depth(spark, sf):
    """Signed distances of the voxels along each pixel's ray, within the truncation band, fused over the agents."""
    # The voxels between the ends of the band, whatever the depth.
    low, high = F.greatest(F.floor((F.col("depth") - 0.175) / 0.05), F.lit(0)), F.greatest(F.ceil((F.col("depth") + 0.005) / 0.05), F.lit(0))
    k = F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("k")
    seen = depth_picture(spark, sf).select("u", "v", "depth", k).withColumn("s", F.col("depth") - (F.col("k") * 0.05 + 0.025)).where("s > -0.03 AND s < 0.15").withColumn("w", F.lit(1))
    out = V.fuse(seen, ["u", "v", "k"], "s", "w")
    return out.select("u", "v", F.col("k").cast("long").alias("k"), r6("value", "sdf"), F.col("weight").alias("weight"))


@R.add("vox2_visible_chunks", sql("SELECT DISTINCT camera, u // 4 AS cu, v // 4 AS cv, unnest(range(floor(greatest(depth - 0.15, 0) / 0.4)::BIGINT, floor((depth + 0.03) / 0.4)::BIGINT + 1)) AS ck FROM d", _COLUMNS))
def visible_chunks(spark, sf):
    """Chunks that the truncation band of a pixel passes, coarse cells first."""
    low, high = F.floor(F.greatest(F.col("depth") - 0.15, F.lit(0.0)) / 0.4), F.floor((F.col("depth") + 0.03) / 0.4)
    return depth_picture(spark, sf).select("camera", F.floor(F.col("u") / 4).cast("long").alias("cu"), F.floor(F.col("v") / 4).cast("long").alias("cv"), F.explode(F.sequence(low, high)).alias("ck")).distinct()


@R.add("vox7_fold_all_submaps", sql("SELECT floor(x / 4)::BIGINT AS cx, floor(z / 2)::BIGINT AS cz, round(sum(y * w) / (sum(w) + 1e-4), 6) AS value, count(DISTINCT submap) AS n FROM p GROUP BY ALL HAVING sum(w) > 0.5"))
def fold_all(spark, sf):
    """The global map: all submaps' sums added, with the number of submaps that a cell comes from."""
    part = points(spark, sf).groupBy(grid.chunk_key("x", 4).alias("cx"), grid.chunk_key("z", 2).alias("cz"), "submap").agg(F.sum(F.col("y") * F.col("w")).alias("sum_dw"), F.sum("w").alias("sum_w"))
    whole = part.groupBy("cx", "cz").agg(F.sum("sum_dw").alias("sum_dw"), F.sum("sum_w").alias("sum_w"), F.count(F.lit(1)).alias("n"))
    return V.finish(whole).select("cx", "cz", r6("value", "value"), "n")


@R.add("vox6_splat_neighbours", sql("""SELECT gx, gz, round(sum(y * f) / (sum(f) + 1e-4), 6) AS value FROM (
  SELECT floor(x / 4)::BIGINT + dx AS gx, floor(z / 2)::BIGINT + dz AS gz, y, CASE dx WHEN 0 THEN 1 - (x / 4 - floor(x / 4)) ELSE x / 4 - floor(x / 4) END * CASE dz WHEN 0 THEN 1 - (z / 2 - floor(z / 2)) ELSE z / 2 - floor(z / 2) END AS f
  FROM p, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dz)) GROUP BY ALL HAVING sum(f) > 0.5"""))
def splat(spark, sf):
    """Points spread over the corners of their cell with linear weights."""
    p = points(spark, sf)
    a, b = F.col("x") / 4, F.col("z") / 2
    corners = [F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dz).cast("long").alias("dz")) for dx in (0, 1) for dz in (0, 1)]
    out = p.select("y", a.alias("a"), b.alias("b"), F.explode(F.array(*corners)).alias("c"))
    part = lambda t, d: F.when(d == 0, 1 - (t - F.floor(t))).otherwise(t - F.floor(t))
    out = out.select((F.floor("a") + F.col("c.dx")).alias("gx"), (F.floor("b") + F.col("c.dz")).alias("gz"), "y", (part(F.col("a"), F.col("c.dx")) * part(F.col("b"), F.col("c.dz"))).alias("f"))
    return V.fuse(out, ["gx", "gz"], "y", "f").select("gx", "gz", r6("value", "value"))


_GRID = "m AS (SELECT floor(x / 4)::BIGINT AS gx, floor(y / 2)::BIGINT AS gy, avg(z) AS v FROM p GROUP BY ALL)"


_THIRDS = "m AS (SELECT floor(x / 3)::BIGINT AS gx, floor(y / 1.7)::BIGINT AS gy, avg(z) AS v FROM p GROUP BY ALL)"


@R.add("vox9_interpolated_value", sql("""SELECT id, round((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy, 6) + 0 AS value, round((b.v - a.v) * (1 - fy) + (d.v - c.v) * fy, 6) + 0 AS gx FROM (
  SELECT id, floor(x / 3)::BIGINT AS i, floor(y / 1.7)::BIGINT AS j, x / 3 - floor(x / 3) AS fx, y / 1.7 - floor(y / 1.7) AS fy FROM p) q
  JOIN m a ON a.gx = i AND a.gy = j JOIN m b ON b.gx = i + 1 AND b.gy = j JOIN m c ON c.gx = i AND c.gy = j + 1 JOIN m d ON d.gx = i + 1 AND d.gy = j + 1""", _THIRDS))
def interpolated(spark, sf):
    """True linear interpolation between the cell values around a point, and the gradient along x; points without all neighbours have none."""
    p = points(spark, sf)
    means = p.groupBy(grid.chunk_key("x", 3).alias("gx"), grid.chunk_key("y", 1.7).alias("gy")).agg(F.avg("z").alias("v"))
    corners = V.full_cells(means, ["gx", "gy"], "v")
    q = p.select("id", grid.chunk_key("x", 3).alias("gx"), grid.chunk_key("y", 1.7).alias("gy"), (F.col("x") / 3 - F.floor(F.col("x") / 3)).alias("fx"), (F.col("y") / 1.7 - F.floor(F.col("y") / 1.7)).alias("fy"))
    v = [F.col("values")[i] for i in range(4)]
    both = q.join(corners, ["gx", "gy"])
    slope = G.lerp(v[1] - v[0], v[3] - v[2], F.col("fy"))
    return both.select("id", F.round(G.bilerp(*v, F.col("fx"), F.col("fy")), 6).alias("value"), F.round(slope, 6).alias("gx"))


@R.add("vox15_surface_distance", sql("SELECT id, round(z - v, 6) AS distance, abs(z - v) < 2 AS near FROM p JOIN m ON gx = floor(x / 4)::BIGINT AND gy = floor(y / 2)::BIGINT", _GRID))
def surface_distance(spark, sf):
    p = points(spark, sf).withColumns({"gx": grid.chunk_key("x", 4), "gy": grid.chunk_key("y", 2)})
    means = p.groupBy("gx", "gy").agg(F.avg("z").alias("v"))
    return p.join(means, ["gx", "gy"]).select("id", r6(F.col("z") - F.col("v"), "distance"), (F.abs(F.col("z") - F.col("v")) < 2).alias("near"))


@R.add("flt11_inliers_both_ways", f"WITH {_PAIR} SELECT corr, count(*) AS n FROM d WHERE abs(pz + 0.5 - qz) / (pz + 1) < 0.2 AND sqrt((px / (pz + 1) - (px + 0.1) / (pz + 1.2)) ** 2) * 100 < 60 GROUP BY corr")
def inliers_both_ways(spark, sf):
    """Matches that agree in space, by depth, and in the picture, in pixels."""
    d3 = F.abs(F.col("pz") + 0.5 - F.col("qz")) / (F.col("pz") + 1)
    d2 = F.sqrt((F.col("px") / (F.col("pz") + 1) - (F.col("px") + 0.1) / (F.col("pz") + 1.2)) ** 2) * 100
    return pairs(spark, sf).where((d3 < 0.2) & (d2 < 60)).groupBy("corr").agg(F.count(F.lit(1)).alias("n"))


@R.add("flt17_room_acceptance", sql("SELECT submap, round(avg((z > 4)::INT), 6) AS ratio, round(avg((semantic < 7)::INT), 6) AS score FROM p GROUP BY submap HAVING avg((z > 4)::INT) >= 0.5 AND avg((semantic < 7)::INT) >= 0.5"))
def room_acceptance(spark, sf):
    """Room matches with enough registered points and a good enough score by instances."""
    s = points(spark, sf).groupBy("submap").agg(F.avg((F.col("z") > 4).cast("int")).alias("ratio"), F.avg((F.col("semantic") < 7).cast("int")).alias("score"))
    return s.where("ratio >= 0.5 AND score >= 0.5").select("submap", r6("ratio", "ratio"), r6("score", "score"))


@R.add("flt15_boundary_pixels", sql("SELECT a.camera, a.u, a.v, CASE WHEN bool_or(abs(a.depth - b.depth) > 0.1) THEN 0 ELSE round(any_value(a.depth), 6) END AS depth FROM d a JOIN d b ON a.camera = b.camera AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 GROUP BY a.camera, a.u, a.v", _COLUMNS))
def boundary_pixels(spark, sf):
    """Pixels of which a neighbour is far off lose their depth: an offset join on the pixel."""
    d = depth_picture(spark, sf)
    near = V.shifted(d.select("u", "v", "camera", F.col("depth").alias("other")), ["u", "v"], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]).drop("offset")
    both = d.join(near, ["camera", "u", "v"]).groupBy("camera", "u", "v").agg(F.bool_or(F.abs(F.col("depth") - F.col("other")) > 0.1).alias("edge"), F.first("depth").alias("depth"))
    return both.select("camera", "u", "v", F.when(F.col("edge"), F.lit(0.0)).otherwise(F.round("depth", 6)).alias("depth"))


@R.add("itr16_huber_statistics", f"WITH {_PAIR} SELECT corr, round(sum(h), 4) AS w, round(sum(h * px), 3) AS px FROM (SELECT *, CASE WHEN e < 0.4 THEN 1 ELSE 0.4 / e END AS h FROM (SELECT *, abs(pz + 0.5 - qz) AS e FROM d)) GROUP BY corr")
def huber_statistics(spark, sf):
    """Sums of correspondences weighted anew by their error."""
    e = F.abs(F.col("pz") + 0.5 - F.col("qz"))
    again = pairs(spark, sf).withColumn("w", G.huber(e, 0.4))
    return ST.sums(again, ["corr"], ["px", "py", "pz"], ["qx", "qy", "qz"], "w").select("corr", F.round("w", 4).alias("w"), F.round("px", 3).alias("px"))


@R.add("scn4_full_convolution", sql("SELECT t.sx + tap // 2 AS sx, t.sy + tap % 2 AS sy, round(sum(a * ((tap * 7 % 11 - 5) / 10.0::DOUBLE) + b * (((tap * 7 + 3) % 11 - 5) / 10.0::DOUBLE)), 5) AS y0 FROM t, (SELECT unnest(range(0, 4)) AS tap) GROUP BY t.sx + tap // 2, t.sy + tap % 2", _SITES))
def full_convolution(spark, sf):
    """Every input site feeds all sites of its window: outputs grow beyond the inputs."""
    moved = V.shifted(sites(spark, sf), K, [(0, 0), (0, 1), (1, 0), (1, 1)])
    out = SP._applied(moved, K, ["a", "b"], table_of(4, 2, 1), [0.0])
    return out.select(*K, F.round("y0", 5).alias("y0"))


@R.add("scn4_sparse_to_dense", sql("SELECT sx, count(*) AS n, round(sum(coalesce(a, 0)), 5) AS total FROM (SELECT s.sx, y.sy, t.a FROM (SELECT DISTINCT sx FROM t) s CROSS JOIN (SELECT unnest(range(0, (SELECT max(sy) + 1 FROM t))) AS sy) y LEFT JOIN t ON t.sx = s.sx AND t.sy = y.sy) GROUP BY sx", _SITES))
def sparse_to_dense(spark, sf):
    """Rows of the grid as dense vectors, as long as the last site needs; missing sites are zero."""
    last = sites(spark, sf).agg(F.coalesce(F.max("sy"), F.lit(-1))).first()[0]
    rows = sites(spark, sf).groupBy("sx").agg(F.map_from_entries(F.collect_list(F.struct("sy", "a"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(last, 0)).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return rows.select("sx", F.size(dense).cast("long").alias("n"), F.round(F.aggregate(dense, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@R.add("itr20_line_growing")
def line_growing(spark, sf):
    """Lines among the points of each agent's submaps, by the plane growth with two axes."""
    flat = points(spark, sf).select("submap", "camera", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), "nx", "ny")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "nx", "ny"])
        n = pdf[["nx", "ny"]].to_numpy(float)
        n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
        label = RM.grow_planes(pdf[["x", "y"]].to_numpy(float), n, 0.4, 5, flat=0.9)
        found, k = np.unique(label, return_counts=True)
        return pd.DataFrame({"submap": pdf["submap"].iloc[0], "camera": pdf["camera"].iloc[0], "line": found.astype("int64"), "n": k.astype("int64")})

    return RM.by_group(flat, ["submap", "camera"], "submap long, camera long, line long, n long", grow, costly=True)


@R.add("itr32_registration_ratio")
def registration_ratio(spark, sf):
    """Share of each class's points that a small known motion brings back on to the class."""
    def register(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf.sort_values("vec_id")[["x", "y", "z"]].to_numpy(float)
        normals = np.where(np.arange(len(xyz))[:, None] % 3 == np.arange(3)[None], 1.0, 0.0)
        _, ratio = ES.icp(xyz + [0.01, 0, 0], xyz, normals, 0.06)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "n": [len(xyz)], "ratio": [round(ratio, 4)]})

    return RM.by_group(vectors(spark, sf), ["label"], "label int, n long, ratio double", register)


@R.add("top9_agg20_spread_features")
def spread_features(spark, sf):
    """Points of each submap thinned to about 50, the best of each quarter of a quarter."""
    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "x", "y"]).reset_index(drop=True)
        keep = IM.spread(pdf[["x", "y"]].to_numpy(float), pdf["w"].to_numpy(float), 50, (0.0, 0.0, 64.0, 64.0))
        return pd.DataFrame({"submap": pdf["submap"].iloc[0], "n": [len(pdf)], "kept": [len(keep)]})

    return RM.by_group(points(spark, sf).select("submap", "id", "x", "y", "w"), ["submap"], "submap long, n long, kept long", thin)


@R.add("itr30_triangle_features")
def triangle_features(spark, sf):
    """Sines of the angles of consecutive triples of each class's vectors."""
    def triples(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf.sort_values("vec_id")[["x", "y", "z"]].to_numpy(float)
        t = np.array([(i, i + 1, i + 2) for i in range(len(xyz) - 2)]).reshape(-1, 3)
        f = ES.triangle_features(xyz, t)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "triple": np.arange(len(t)), "s0": f[:, 0].round(6), "s1": f[:, 1].round(6), "s2": f[:, 2].round(6)})

    return RM.by_group(vectors(spark, sf), ["label"], "label int, triple long, s0 double, s1 double, s2 double", triples)
