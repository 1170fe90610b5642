"""Carrier queries of voxel joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators import voxels as V
from gridloom.plans.carriers import POINTS_SQL, Registry, points, r6

R = Registry()
KEYS = ["cx", "cy", "cz"]
FINE_SQL = "g AS (SELECT *, floor(x)::BIGINT AS cx, floor(y * 4)::BIGINT AS cy, floor(z * 2)::BIGINT AS cz FROM p)"
CELLS_SQL = "c AS (SELECT *, floor(x / 8)::BIGINT AS cx, floor(y / 8)::BIGINT AS cy, floor(z / 4)::BIGINT AS cz FROM p)"


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([POINTS_SQL, CELLS_SQL, FINE_SQL, *more])} {body}"


def cells(spark, sf):
    return points(spark, sf).withColumns({"cx": grid.chunk_key("x", 8), "cy": grid.chunk_key("y", 8), "cz": grid.chunk_key("z", 4)})


def fine(spark, sf):
    return points(spark, sf).withColumns({"cx": grid.chunk_key("x", 1), "cy": grid.chunk_key(F.col("y") * 4, 1), "cz": grid.chunk_key(F.col("z") * 2, 1)})


def even(df):
    return df.where("frame % 2 = 0")


def odd(df):
    return df.where("frame % 2 = 1")


@R.add("agg3_weighted_fusion", sql("SELECT cx, cy, cz, round(sum(z * w) / (sum(w) + 1e-4), 6) AS value, round(sum(w), 6) AS weight FROM c GROUP BY ALL HAVING sum(w) > 0.5"))
def weighted_fusion(spark, sf):
    out = V.fuse(cells(spark, sf), KEYS, "z", "w")
    return out.select(*KEYS, r6("value", "value"), r6("weight", "weight"))


@R.add("agg4_weighted_mean", sql("SELECT submap, round(sum(z * w) / sum(w), 6) AS value FROM c GROUP BY submap"))
def weighted_mean(spark, sf):
    return V.fuse(cells(spark, sf), ["submap"], "z", "w", least=0.0, epsilon=0.0).select("submap", r6("value", "value"))


def sums(df):
    return df.groupBy(*KEYS).agg(F.sum(F.col("z") * F.col("w")).alias("sum_dw"), F.sum("w").alias("sum_w"))


@R.add("agg5_jn9_merge_submaps", sql("""SELECT cx, cy, cz, round(coalesce(a.v, 0) + coalesce(b.v, 0), 6) AS sum_dw, round(coalesce(a.w, 0) + coalesce(b.w, 0), 6) AS sum_w
  FROM (SELECT cx, cy, cz, sum(z * w) AS v, sum(w) AS w FROM c WHERE frame % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT cx, cy, cz, sum(z * w) AS v, sum(w) AS w FROM c WHERE frame % 2 = 1 GROUP BY ALL) b USING (cx, cy, cz)"""))
def merge_submaps(spark, sf):
    df = cells(spark, sf)
    return V.merge([sums(even(df)), sums(odd(df))], KEYS).select(*KEYS, r6("sum_dw", "sum_dw"), r6("sum_w", "sum_w"))


@R.add("agg6_transform_regrid", sql("""SELECT floor((x * 0.6 - y * 0.8 + 100) / 4)::BIGINT AS gx, floor((x * 0.8 + y * 0.6) / 4)::BIGINT AS gy, round(sum(z * w) / (sum(w) + 1e-4), 6) AS value, round(sum(w), 6) AS weight FROM c GROUP BY ALL HAVING sum(w) > 0.5"""))
def transform_regrid(spark, sf):
    x, y = F.col("x"), F.col("y")
    moved = points(spark, sf).withColumns({"gx": grid.chunk_key(x * 0.6 - y * 0.8 + 100, 4), "gy": grid.chunk_key(x * 0.8 + y * 0.6, 4)})
    return V.fuse(moved, ["gx", "gy"], "z", "w").select("gx", "gy", r6("value", "value"), r6("weight", "weight"))


@R.add("agg7_cell_means", sql("""SELECT cx, cy, cz, count(*) AS n, round(any_value(mx), 6) AS mean_x, round(any_value(mnx), 6) AS mean_nx, round(avg(sqrt((nx - mnx) * (nx - mnx) + (ny - mny) * (ny - mny) + (nz - mnz) * (nz - mnz))), 6) AS residual
  FROM c JOIN m USING (cx, cy, cz) GROUP BY ALL""", "m AS (SELECT cx, cy, cz, avg(x) AS mx, avg(nx) AS mnx, avg(ny) AS mny, avg(nz) AS mnz FROM c GROUP BY ALL)"))
def cell_means(spark, sf):
    out = V.group_means(cells(spark, sf), KEYS, ["x", "nx", "ny", "nz"], ["nx", "ny", "nz"])
    return out.select(*KEYS, "n", r6("mean_x", "mean_x"), r6("mean_nx", "mean_nx"), r6("residual", "residual"))


@R.add("str8_retraction", sql("""SELECT cx, cy, cz, round(sum(v * w) / (sum(w) + 1e-4), 5) AS value, round(sum(w), 5) AS weight FROM (
  SELECT cx, cy, cz, z AS v, w FROM c UNION ALL SELECT cx, cy, cz, z, -w FROM c WHERE frame = 3 UNION ALL SELECT cx, cy, cz + 1, z, w FROM c WHERE frame = 3) GROUP BY ALL HAVING sum(w) > 0.5"""))
def retraction(spark, sf):
    """Frame 3 is taken out of the map and put in again at a corrected place."""
    df = cells(spark, sf).select(*KEYS, "z", "w", "frame")
    third = df.where("frame = 3")
    out = V.fuse(df.unionByName(V.retracted(third, third.withColumn("cz", F.col("cz") + 1), "w")), KEYS, "z", "w")
    return out.select(*KEYS, F.round("value", 5).alias("value"), F.round("weight", 5).alias("weight"))


@R.add("jn10_vox4_allocate", sql("SELECT DISTINCT submap, cx, cy, cz FROM g EXCEPT SELECT submap + 1, cx, cy, cz FROM g"))
def allocate(spark, sf):
    """Cells that each submap creates: those that the one before has not."""
    df = fine(spark, sf).select("submap", *KEYS).distinct()
    none = df.limit(0)
    return V.allocate(df, none, df.withColumn("submap", F.col("submap") + 1), ["submap", *KEYS])


_UP = " UNION ALL ".join(f"SELECT cx - {n & 1} AS cx, cy - {n >> 1 & 1} AS cy, cz - {n >> 2 & 1} AS cz, {n} AS corner, v FROM m" for n in range(8))


@R.add("jn11_full_neighbourhood", sql(f"SELECT cx, cy, cz, count(*) AS n, round(sum(v), 6) AS total, sum(CASE WHEN v < 4.5 THEN 1 << corner ELSE 0 END)::BIGINT AS code FROM ({_UP}) GROUP BY ALL HAVING count(*) = 8", "m AS (SELECT cx, cy, cz, avg(z) AS v FROM c GROUP BY ALL)"))
def full_neighbourhood(spark, sf):
    """Cells of the marching cubes: all eight corners are there."""
    means = cells(spark, sf).groupBy(*KEYS).agg(F.avg("z").alias("v"))
    out = V.full_cells(means, KEYS, "v")
    code = F.expr("aggregate(transform(values, (v, i) -> if(v < 4.5D, shiftleft(1L, i), 0L)), 0L, (s, x) -> s + x)")
    return out.select(*KEYS, F.size("values").cast("long").alias("n"), r6(F.expr("aggregate(values, 0D, (s, x) -> s + x)"), "total"), code.alias("code"))


@R.add("jn12_sdf_lookup", sql("SELECT id, round(coalesce(v, 999), 6) AS sdf FROM (SELECT id, cx + 1 AS cx, cy, cz FROM c) LEFT JOIN (SELECT cx, cy, cz, avg(z) AS v FROM c GROUP BY ALL) USING (cx, cy, cz)"))
def sdf_lookup(spark, sf):
    df = cells(spark, sf)
    means = df.groupBy(*KEYS).agg(F.avg("z").alias("sdf"))
    ask = df.select("id", (F.col("cx") + 1).alias("cx"), "cy", "cz")
    return V.lookup(ask, means, KEYS, "sdf", 999.0).select("id", r6("sdf", "sdf"))


_NEAR = " UNION ".join(f"SELECT cx + {a}, cy + {b}, cz + {c} FROM g WHERE frame = 7" for a, b, c in V.faces(3))


@R.add("jn13_dirty_set", sql(f"SELECT a.* FROM (SELECT DISTINCT cx, cy, cz FROM g) a JOIN ({_NEAR}) b(cx, cy, cz) USING (cx, cy, cz)"))
def dirty_set(spark, sf):
    """What the newest frame touched, with face neighbours."""
    df = fine(spark, sf)
    return V.dirty(df.where("frame = 7"), KEYS, df)


@R.add("set7_garbage", sql("SELECT DISTINCT cx, cy, cz, submap FROM g a WHERE frame <= 3 AND EXISTS (SELECT 1 FROM g b WHERE b.frame > 3 AND a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz)"))
def garbage(spark, sf):
    """Cells made by the first frames that a later one updated; the others go."""
    df = fine(spark, sf)
    return V.garbage(df.where("frame <= 3").select(*KEYS, "submap").distinct(), df.where("frame > 3"), KEYS)


@R.add("set5_vox11_cluster_vertices", sql("""SELECT rep, count(*) AS n, min(id) AS least FROM (SELECT id, first_value(id) OVER (PARTITION BY floor(x / 5), floor(y / 5), floor(z / 5) ORDER BY frame, id) AS rep FROM c) GROUP BY rep"""))
def cluster_vertices(spark, sf):
    """Each cell keeps its first vertex."""
    reps = V.representatives(points(spark, sf), [grid.chunk_key(a, 5) for a in "xyz"], ["frame", "id"])
    return reps.groupBy(F.col("rep.id").alias("rep")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


@R.add("vox11_solid_triangles", sql("SELECT submap, count(*) AS n FROM (SELECT submap, floor(x / 5) AS a, floor(y / 5) AS b, floor(z / 2) AS c FROM c) WHERE a <> b AND b <> c AND a <> c GROUP BY submap"))
def solid_triangles(spark, sf):
    tri = points(spark, sf).select("submap", *[grid.chunk_key(a, s).alias(n) for a, s, n in (("x", 5, "a"), ("y", 5, "b"), ("z", 2, "c"))])
    return V.solid(tri, ["a", "b", "c"]).groupBy("submap").agg(F.count(F.lit(1)).alias("n"))


@R.add("agg14_majority_label", sql("SELECT cx, cy, cz, arg_max(semantic, (k, semantic)) AS semantic, sum(k)::BIGINT AS n FROM (SELECT cx, cy, cz, semantic, count(*) AS k FROM c GROUP BY ALL) GROUP BY ALL"))
def majority_label(spark, sf):
    return V.majority(cells(spark, sf), KEYS, "semantic").select(*KEYS, "semantic", "n")


@R.add("agg16_floor_normal", sql("SELECT submap, round(a / l, 6) AS nx, round(b / l, 6) AS ny, round(d / l, 6) AS nz FROM (SELECT submap, avg(nx) AS a, avg(ny) AS b, avg(nz) AS d, sqrt(avg(nx) ** 2 + avg(ny) ** 2 + avg(nz) ** 2) AS l FROM c WHERE semantic = 1 GROUP BY submap) WHERE d / l > 0.2"))
def floor_normal(spark, sf):
    m = points(spark, sf).where("semantic = 1").groupBy("submap").agg(*[F.avg(n).alias(n) for n in ("nx", "ny", "nz")])
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return m.where(F.col("nz") / length > 0.2).select("submap", *[r6(F.col(n) / length, n) for n in ("nx", "ny", "nz")])


@R.add("agg17_submap_centre", sql("SELECT submap, camera, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM c GROUP BY submap, camera"))
def submap_centre(spark, sf):
    return points(spark, sf).groupBy("submap", "camera").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.count(F.lit(1)).alias("n"))


@R.add("agg18_statistics", sql("SELECT camera, count(*) FILTER (z < 4) AS inside, count(*) FILTER (z >= 4 AND z < 8) AS outside, count(*) FILTER (z >= 8) AS unknown, round(sum(w), 4) AS weight FROM c GROUP BY camera"))
def statistics(spark, sf):
    z = F.col("z")
    return points(spark, sf).groupBy("camera").agg(F.count_if(z < 4).alias("inside"), F.count_if((z >= 4) & (z < 8)).alias("outside"), F.count_if(z >= 8).alias("unknown"), F.round(F.sum("w"), 4).alias("weight"))


@R.add("agg19_depth_stats", sql("SELECT camera, round(min(z), 6) AS low, round(max(z), 6) AS high, round(avg(z), 6) AS mean FROM c WHERE z > 0 GROUP BY camera"))
def depth_stats(spark, sf):
    return points(spark, sf).where("z > 0").groupBy("camera").agg(r6(F.min("z"), "low"), r6(F.max("z"), "high"), r6(F.avg("z"), "mean"))


@R.add("agg24_room_area", sql("SELECT camera, round(sum(a), 4) AS area FROM (SELECT camera, submap, max(x) * max(z) / 100 AS a FROM c GROUP BY camera, submap) GROUP BY camera HAVING sum(a) <= 200"))
def room_area(spark, sf):
    per = points(spark, sf).groupBy("camera", "submap").agg((F.max("x") * F.max("z") / 100).alias("a"))
    return per.groupBy("camera").agg(F.sum("a").alias("a")).where("a <= 200").select("camera", F.round("a", 4).alias("area"))


@R.add("set3_concatenated_clouds", sql("SELECT submap, count(*) AS n, round(sum(x), 4) AS x FROM (" + " UNION ALL ".join(f"SELECT submap, x + {100 * c} AS x FROM c WHERE camera = {c}" for c in range(5)) + ") GROUP BY submap"))
def concatenated_clouds(spark, sf):
    p = points(spark, sf).select("submap", (F.col("x") + F.col("camera") * 100).alias("x"))
    return p.groupBy("submap").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("x"))


@R.add("set4_unlabelled_submaps", sql("SELECT DISTINCT submap FROM c EXCEPT SELECT submap FROM c WHERE semantic = 1 AND camera = 2 AND z > 9.5 AND x < 8"))
def unlabelled_submaps(spark, sf):
    p = points(spark, sf)
    return p.select("submap").distinct().join(p.where("semantic = 1 AND camera = 2 AND z > 9.5 AND x < 8").select("submap").distinct(), "submap", "left_anti")


@R.add("set6_undirected_edges", sql("SELECT DISTINCT least(camera, submap) AS u, greatest(camera, submap) AS v FROM c WHERE camera <> submap"))
def undirected_edges(spark, sf):
    return points(spark, sf).where("camera <> submap").select(F.least("camera", "submap").alias("u"), F.greatest("camera", "submap").alias("v")).distinct()


@R.add("vox1_cells_in_box", sql("SELECT submap, cx, cy FROM (SELECT submap, unnest(range(a, b + 1)) AS cx, lo, hi FROM (SELECT submap, min(cx) AS a, max(cx) AS b, min(cy) AS lo, max(cy) AS hi FROM c GROUP BY submap)) , LATERAL (SELECT unnest(range(lo, hi + 1)) AS cy)"))
def cells_in_box(spark, sf):
    box = cells(spark, sf).groupBy("submap").agg(F.min("cx").alias("a"), F.max("cx").alias("b"), F.min("cy").alias("lo"), F.max("cy").alias("hi"))
    return box.select("submap", "lo", "hi", F.explode(F.sequence("a", "b")).alias("cx")).select("submap", "cx", F.explode(F.sequence("lo", "hi")).alias("cy"))


@R.add("vox3_bounding_box", sql("SELECT camera, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, min(cz) AS z0, max(cz) AS z1 FROM c GROUP BY camera"))
def bounding_box(spark, sf):
    aggs = [f(f"c{a}").alias(f"{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))]
    return cells(spark, sf).groupBy("camera").agg(*aggs)


@R.add("vox13_vertex_normals", sql("SELECT cx, cy, cz, round(a / l, 6) AS nx, round(b / l, 6) AS ny, round(d / l, 6) AS nz FROM (SELECT cx, cy, cz, sum(nx * w) AS a, sum(ny * w) AS b, sum(nz * w) AS d, sqrt(sum(nx * w) ** 2 + sum(ny * w) ** 2 + sum(nz * w) ** 2) AS l FROM c GROUP BY ALL)"))
def vertex_normals(spark, sf):
    """Normals weighted by area, summed at their vertex."""
    s = cells(spark, sf).groupBy(*KEYS).agg(*[F.sum(F.col(n) * F.col("w")).alias(n) for n in ("nx", "ny", "nz")])
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return s.select(*KEYS, *[r6(F.col(n) / length, n) for n in ("nx", "ny", "nz")])


@R.add("vox14_reference_frame", sql("SELECT cx, cy, cz, arg_max(frame, (nz, frame)) AS frame FROM c GROUP BY ALL"))
def reference_frame(spark, sf):
    return cells(spark, sf).groupBy(*KEYS).agg(F.max_by("frame", F.struct("nz", "frame")).alias("frame"))


@R.add("vox16_mesh_readout", sql("SELECT id, round(x + 10 * (submap % 4), 6) AS x, round(y, 6) AS y, semantic FROM c WHERE submap IN (SELECT DISTINCT submap FROM c WHERE camera = 1 AND semantic = 2)"))
def mesh_readout(spark, sf):
    p = points(spark, sf)
    wanted = p.where("camera = 1 AND semantic = 2").select("submap").distinct()
    return p.join(wanted, "submap", "left_semi").select("id", r6(F.col("x") + 10 * (F.col("submap") % 4), "x"), r6("y", "y"), "semantic")


@R.add("str16_new_cells", sql("SELECT frame, count(*) AS n FROM (SELECT cx, cy, cz, min(frame) AS frame FROM g GROUP BY ALL) GROUP BY frame"))
def new_fine(spark, sf):
    """Cells by the frame that saw them first."""
    first = fine(spark, sf).groupBy(*KEYS).agg(F.min("frame").alias("frame"))
    return first.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
