"""Carrier queries of projections and filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import grid
from gridloom.plans.carriers import POINTS_SQL, Registry, points, r6
from gridloom.session import table

R = Registry()
FX, FY, CX, CY = 525.0, 525.0, 319.5, 239.5
P = ("x", "y", "z")
N = ("nx", "ny", "nz")


def cols(*names):
    return tuple(F.col(n) for n in names)


def sql(body: str) -> str:
    return f"WITH {POINTS_SQL} {body}"


@R.add("prj1_chunk_key", sql("SELECT id, floor(x / 8)::BIGINT AS cx, floor(y / 8)::BIGINT AS cy, floor(z / 8)::BIGINT AS cz FROM p"))
def chunk_key(spark, sf):
    return points(spark, sf).select("id", *[grid.chunk_key(c, 8).alias(f"c{c}") for c in P])


@R.add("prj2_voxel_coords", sql("SELECT id, (floor(x) - 8 * floor(floor(x) / 8))::BIGINT AS vx, (floor(y) - 8 * floor(floor(y) / 8))::BIGINT AS vy, (floor(z) - 8 * floor(floor(z) / 8))::BIGINT AS vz FROM p"))
def voxel_coords(spark, sf):
    return points(spark, sf).select("id", *[grid.voxel_in_chunk(F.col(c), 8).alias(f"v{c}") for c in P])


@R.add("prj3_voxel_id", sql("SELECT id, v, v % 8 AS vx, v // 8 % 8 AS vy, v // 64 AS vz FROM (SELECT id, (floor(x)::BIGINT % 8) + 8 * (floor(y)::BIGINT % 8) + 64 * (floor(z)::BIGINT % 8) AS v FROM p)"))
def voxel_id(spark, sf):
    v = grid.voxel_id(*[grid.voxel_in_chunk(F.col(c), 8) for c in P])
    df = points(spark, sf).select("id", v.alias("v"))
    return df.select("id", "v", *[c.alias(n) for c, n in zip(grid.voxel_coords(F.col("v")), ("vx", "vy", "vz"), strict=True)])


@R.add("prj4_unnest_chunk", sql("""SELECT submap, (i - 1)::INTEGER AS pos, sdf[i] AS sdf FROM (SELECT submap, sdf, unnest(range(1, len(sdf) + 1)) AS i FROM
  (SELECT submap, list(CASE WHEN z > 7 THEN 999 ELSE round(z, 6) END ORDER BY id, z) AS sdf FROM p GROUP BY submap)) WHERE abs(sdf[i]) < 999"""))
def unnest_chunk(spark, sf):
    value = F.when(F.col("z") > 7, F.lit(999.0)).otherwise(F.round("z", 6))
    chunk = points(spark, sf).groupBy("submap").agg(F.sort_array(F.collect_list(F.struct("id", "z", value.alias("v")))).alias("sdf"))
    return chunk.select("submap", F.posexplode("sdf.v").alias("pos", "sdf")).where(F.abs("sdf") < 999)


@R.add("prj5_labels", sql("SELECT id, l AS label, l // 10000 AS semantic, CASE WHEN l % 10000 <> 9999 THEN l % 10000 END AS instance FROM (SELECT id, semantic * 10000 + coalesce(instance, 9999) AS l FROM p)"))
def labels(spark, sf):
    df = points(spark, sf).select("id", grid.pack_label(F.col("semantic"), F.col("instance")).alias("label"))
    semantic, instance = grid.unpack_label(F.col("label"))
    return df.select("id", "label", semantic.alias("semantic"), instance.alias("instance"))


@R.add("prj6_room_border", sql("SELECT id, semantic IN (0, 7, 8) AS border, semantic = 1 AS is_floor FROM p"))
def room_border(spark, sf):
    return points(spark, sf).select("id", grid.is_border(F.col("semantic")).alias("border"), grid.is_floor(F.col("semantic")).alias("is_floor"))


@R.add("prj7_back_projection", sql(f"SELECT id, round((x - {CX}) * z / {FX}, 6) AS px, round((y - {CY}) * z / {FY}, 6) AS py, round(z, 6) AS pz FROM p WHERE z > 0 AND z < 8"))
def back_projection(spark, sf):
    df = points(spark, sf).where("z > 0 AND z < 8")
    return df.select("id", *[r6(c, f"p{n}") for c, n in zip(G.back_project(*cols(*P), FX, FY, CX, CY), P, strict=True)])


_C, _S = math.cos(0.3), math.sin(0.3)


@R.add("prj8_rigid_transform", sql(f"""SELECT id, round({_C!r} * x - {_S!r} * y + 1, 6) AS tx, round({_S!r} * x + {_C!r} * y + 2, 6) AS ty, round(z + 3, 6) AS tz,
  round({_C!r} * nx - {_S!r} * ny, 6) AS tnx, round({_S!r} * nx + {_C!r} * ny, 6) AS tny, round(nz, 6) AS tnz FROM p"""))
def rigid_transform(spark, sf):
    r = G.rotation_about_z(0.3)
    moved, turned = G.rigid(r, [1, 2, 3], cols(*P)), G.rigid(r, None, cols(*N))
    return points(spark, sf).select("id", *[r6(c, f"t{n}") for c, n in zip((*moved, *turned), (*P, *N), strict=True)])


@R.add("prj10_pose_difference", sql("SELECT id, round(9 * (a * a + b * b + c * c) + x * x + y * y + z * z, 6) AS cost FROM (SELECT id, x, y, z, " + ", ".join(f"least(abs({n} * 6), abs({n} * 6 - {math.pi!r}), abs({n} * 6 + {math.pi!r})) AS {a}" for n, a in zip(N, "abc", strict=True)) + " FROM p)"))
def pose_difference(spark, sf):
    return points(spark, sf).select("id", r6(G.pose_difference(tuple(F.col(n) * 6 for n in N), cols(*P)), "cost"))


@R.add("prj11_pinhole", sql(f"SELECT * FROM (SELECT id, floor(x / (z + 1) * {FX} / 100 + {CX} + 0.5)::BIGINT AS u, floor(y / (z + 1) * {FY} / 100 + {CY} + 0.5)::BIGINT AS v FROM p) WHERE u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479"))
def pinhole(spark, sf):
    u, v = G.project((F.col("x"), F.col("y"), F.col("z") + 1), FX / 100, FY / 100, CX, CY)
    return points(spark, sf).select("id", u.alias("u"), v.alias("v")).where("u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479")


@R.add("prj12_colours", sql("SELECT id, c AS rgb, c >> 16 AS r, (c >> 8) & 255 AS g, c & 255 AS b FROM (SELECT id, ((semantic * 19 << 16) + (camera * 50 << 8) + frame * 30)::BIGINT AS c FROM p)"))
def colours(spark, sf):
    df = points(spark, sf).select("id", grid.pack_rgb(F.col("semantic") * 19, F.col("camera") * 50, F.col("frame") * 30).alias("rgb"))
    return df.select("id", "rgb", *[c.alias(n) for c, n in zip(grid.unpack_rgb(F.col("rgb")), "rgb", strict=True)])


@R.add("prj14_truncation_weight", sql("SELECT id, round(z / 100 - 0.05, 6) AS d, z / 100 - 0.05 > -0.03 AND z / 100 - 0.05 < 0.15 AS within, 1 AS weight FROM p"))
def truncation(spark, sf):
    d = F.col("z") / 100 - 0.05
    return points(spark, sf).select("id", r6(d, "d"), ((d > -0.03) & (d < 0.15)).alias("within"), F.lit(1).alias("weight"))


@R.add("prj15_plane_geometry", sql("""SELECT id, round(abs((nx * 9 - x) * (0 - y) - (ny * 9 - y) * (0 - x)) / 2, 6) AS area,
  round(sqrt((x - nx * 9) * (x - nx * 9) + (y - ny * 9) * (y - ny * 9)), 6) AS way,
  ((9 - 0) * (y - 0) - (9 - 0) * (x - 0)) * ((9 - 0) * (ny * 9 - 0) - (9 - 0) * (nx * 9 - 0)) <= 0 AND ((nx * 9 - x) * (0 - y) - (ny * 9 - y) * (0 - x)) * ((nx * 9 - x) * (9 - y) - (ny * 9 - y) * (9 - x)) <= 0 AS crosses FROM p"""))
def plane_geometry(spark, sf):
    a, b, zero, nine = cols("x", "y"), (F.col("nx") * 9, F.col("ny") * 9), (F.lit(0.0), F.lit(0.0)), (F.lit(9.0), F.lit(9.0))
    way = G.norm((a[0] - b[0], a[1] - b[1]))
    return points(spark, sf).select("id", r6(G.triangle_area(a, b, zero), "area"), r6(way, "way"), G.segments_cross(zero, nine, a, b).alias("crosses"))


@R.add("prj15_polygon_area", sql("""SELECT submap, round(abs(list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * ys[i % len(xs) + 1] - xs[i % len(xs) + 1] * ys[i]))) / 2, 4) AS area
  FROM (SELECT submap, list(x ORDER BY id, x, y) AS xs, list(y ORDER BY id, x, y) AS ys FROM p GROUP BY submap)"""))
def polygon_area(spark, sf):
    df = points(spark, sf).groupBy("submap").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("s")).select("submap", F.col("s.x").alias("xs"), F.col("s.y").alias("ys"))
    return df.select("submap", F.round(G.polygon_area("xs", "ys"), 4).alias("area"))


@R.add("prj15_point_to_segment", sql("""SELECT id, round(t * 30, 8) AS qx, round(t * 10, 8) AS qy, round(sqrt((x - t * 30) * (x - t * 30) + (y - t * 10) * (y - t * 10)), 6) AS gap
  FROM (SELECT id, x, y, least(greatest((x * 30 + y * 10) / 1000, 0), 1) AS t FROM p)"""))
def point_to_segment(spark, sf):
    q = G.nearest_on_segment((F.lit(0.0), F.lit(0.0)), (F.lit(30.0), F.lit(10.0)), cols("x", "y"))
    return points(spark, sf).select("id", F.round(q[0], 8).alias("qx"), F.round(q[1], 8).alias("qy"), r6(G.norm((F.col("x") - q[0], F.col("y") - q[1])), "gap"))


@R.add("prj16_interpolation", sql("SELECT id, round(x + (y - x) * nx, 6) AS l, round((x + (y - x) * nx) + ((z + (w - z) * nx) - (x + (y - x) * nx)) * ny, 6) AS b FROM p"))
def interpolation(spark, sf):
    x, y, z, w, nx, ny = cols("x", "y", "z", "w", "nx", "ny")
    return points(spark, sf).select("id", r6(G.lerp(x, y, nx), "l"), r6(G.bilerp(x, y, z, w, nx, ny), "b"))


@R.add("prj17_colour_quality", sql("SELECT id, abs(x * nx + y * ny + z * nz) / (sqrt(x * x + y * y + z * z) * sqrt(nx * nx + ny * ny + nz * nz)) >= 0.4 AS good FROM p"))
def colour_quality(spark, sf):
    return points(spark, sf).select("id", G.good_view(cols(*P), cols(*N)).alias("good"))


@R.add("prj18_edge_vertex", sql("""SELECT id, CASE WHEN (z < 4) <> (y < 12) THEN round(x + 1 * (z - 4) / ((z - 4) - (y - 12)), 6) END AS vertex,
  (CASE WHEN z < 4 THEN 1 ELSE 0 END + CASE WHEN y < 12 THEN 2 ELSE 0 END + CASE WHEN x < 25 THEN 4 ELSE 0 END)::INTEGER AS code FROM p"""))
def edge_vertex(spark, sf):
    a, b, c = F.col("z") - 4, F.col("y") - 12, F.col("x") - 25
    return points(spark, sf).select("id", r6(G.zero_crossing(F.col("x"), F.col("x") + 1, a, b), "vertex"), grid.corner_code([a, b, c]).alias("code"))


@R.add("prj19_nested_messages", "SELECT event_id, user_id AS camera_id, epoch_us(ts) / 1000000 AS stamp, event_type AS kind, round(value * 2, 6) AS doubled FROM events")
def nested_messages(spark, sf):
    ev = table(spark, sf, "events")
    msg = ev.select("event_id", F.struct(F.col("user_id").alias("camera_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("stamp"), F.struct("event_type", "value").alias("body")).alias("frame"))
    return msg.select("event_id", "frame.camera_id", "frame.stamp", F.col("frame.body.event_type").alias("kind"), r6(F.col("frame.body.value") * 2, "doubled"))


@R.add("prj20_rotation_bins", sql("SELECT id, (floor(((x * 7 - y * 11 + 360) - 360 * floor((x * 7 - y * 11 + 360) / 360)) / 20 + 0.5)::BIGINT % 18) AS bin FROM p"))
def rotation_bins(spark, sf):
    return points(spark, sf).select("id", G.angle_bin(F.col("x") * 7, F.col("y") * 11).alias("bin"))


@R.add("flt1_depth_range", sql("SELECT id, round(z, 6) AS z FROM p WHERE z BETWEEN 1 AND 8"))
def depth_range(spark, sf):
    return points(spark, sf).where(F.col("z").between(1, 8)).select("id", r6("z", "z"))


@R.add("flt4_distance_gate", sql("SELECT id, sqrt(nx * nx * 100 + ny * ny * 100) < 9 AND abs(ny * 10) < 3 AS passes FROM p WHERE frame = 1 OR (sqrt(nx * nx * 100 + ny * ny * 100) < 9 AND abs(ny * 10) < 3)"))
def distance_gate(spark, sf):
    near = (F.sqrt(F.col("nx") * F.col("nx") * 100 + F.col("ny") * F.col("ny") * 100) < 9) & (F.abs(F.col("ny") * 10) < 3)
    return points(spark, sf).select("id", "frame", near.alias("passes")).where("frame = 1 OR passes").drop("frame")


@R.add("flt5_walls", sql("SELECT id, semantic FROM p WHERE semantic IN (0, 7, 8) AND abs(nz) < 0.6"))
def walls(spark, sf):
    return points(spark, sf).where(grid.is_border(F.col("semantic")) & (F.abs("nz") < 0.6)).select("id", "semantic")


@R.add("flt6_floor", sql("SELECT id FROM p WHERE semantic = 1 AND nz > 0.5"))
def floor(spark, sf):
    return points(spark, sf).where(grid.is_floor(F.col("semantic")) & (F.col("nz") > 0.5)).select("id")


@R.add("flt7_inlier", sql("SELECT id, abs(x * 0.6 + z * 0.8 - 20) <= 5 / 1.8 AND abs(nx * 0.6 + nz * 0.8) >= 0.7 AS inlier FROM p"))
def inlier(spark, sf):
    plane = (F.lit(0.6), F.lit(0.0), F.lit(0.8))
    return points(spark, sf).select("id", G.is_inlier(cols(*P), cols(*N), plane, -20, 5).alias("inlier"))


@R.add("flt8_label_mask", sql("SELECT id, instance FROM (SELECT id, instance, count(*) OVER (PARTITION BY semantic, instance) AS n FROM p WHERE instance IS NOT NULL) WHERE n >= 5"))
def label_mask(spark, sf):
    """Counted before the join: a window would gather an instance in one task."""
    df = points(spark, sf).where("instance IS NOT NULL").select("id", "semantic", "instance")
    big = df.groupBy("semantic", "instance").count().where("count >= 5").drop("count")
    return df.join(big, ["semantic", "instance"], "left_semi").select("id", "instance")


@R.add("flt12_bounds", sql("""SELECT id, x BETWEEN 5 AND 30 AND y BETWEEN 0 AND 20 AND z BETWEEN 2 AND 9 AS within, x - 1 <= 30 AND 5 <= x + 1 AND y - 1 <= 20 AND 0 <= y + 1 AS meets,
  CASE WHEN nx * x + ny * y + nz * z - 20 > 0.000001 THEN 1 WHEN nx * x + ny * y + nz * z - 20 < -0.000001 THEN -1 ELSE 0 END::INTEGER AS side FROM p"""))
def bounds(spark, sf):
    x, y, z = cols(*P)
    meets = G.boxes_meet((x - 1, y - 1), (x + 1, y + 1), (F.lit(5.0), F.lit(0.0)), (F.lit(30.0), F.lit(20.0)))
    return points(spark, sf).select("id", G.in_box((x, y, z), (5, 0, 2), (30, 20, 9)).alias("within"), meets.alias("meets"), G.plane_side(cols(*N), F.lit(-20.0), (x, y, z)).alias("side"))


@R.add("flt12_ray_box", sql("""SELECT id, greatest(least((10 - x) / nx, (12 - x) / nx), least((5 - y) / dy, (9 - y) / dy)) <= least(greatest((10 - x) / nx, (12 - x) / nx), greatest((5 - y) / dy, (9 - y) / dy))
  AND least(greatest((10 - x) / nx, (12 - x) / nx), greatest((5 - y) / dy, (9 - y) / dy)) >= 0 AS meets FROM (SELECT *, CASE WHEN abs(ny) < 1e-12 THEN 1e-12 ELSE ny END AS dy FROM p)"""))
def ray_box(spark, sf):
    return points(spark, sf).select("id", G.ray_meets_box(cols("x", "y"), cols("nx", "ny"), (10, 5), (12, 9)).alias("meets"))


HULL = [(5.0, 2.0), (30.0, 4.0), (40.0, 20.0), (15.0, 24.0)]
_SIDES = ", ".join(f"({b[0]} - {a[0]}) * (y - {a[1]}) - ({b[1]} - {a[1]}) * (x - {a[0]})" for a, b in zip(HULL, HULL[1:] + HULL[:1], strict=True))


@R.add("flt13_point_in_polygon", sql(f"SELECT id, CASE WHEN m > 1e-9 THEN 1 WHEN m >= -1e-9 THEN 0 ELSE -1 END::INTEGER AS place FROM (SELECT id, least({_SIDES}) AS m FROM p)"))
def point_in_polygon(spark, sf):
    return points(spark, sf).select("id", G.in_convex_polygon(HULL, cols("x", "y")).alias("place"))


@R.add("flt14_depth_consistency", sql("""SELECT a.id, CASE WHEN b.z IS NOT NULL AND abs(a.z - b.z) >= 0.03 * a.z THEN 0 ELSE round(a.z, 6) END AS z
  FROM p a LEFT JOIN (SELECT floor(x)::BIGINT AS u, floor(y)::BIGINT AS v, camera, min(z) AS z FROM p WHERE z > 0 GROUP BY ALL) b ON b.u = floor(a.x)::BIGINT AND b.v = floor(a.y)::BIGINT AND b.camera = (a.camera + 1) % 5 WHERE a.z > 0"""))
def depth_consistency(spark, sf):
    p = points(spark, sf).where("z > 0").select("id", "z", "camera", grid.chunk_key("x", 1).alias("u"), grid.chunk_key("y", 1).alias("v"))
    other = p.groupBy("u", "v", F.pmod(F.col("camera") - 1, F.lit(5)).alias("camera")).agg(F.min("z").alias("z2"))
    odd = F.col("z2").isNotNull() & (F.abs(F.col("z") - F.col("z2")) >= 0.03 * F.col("z"))
    return p.join(other, ["u", "v", "camera"], "left").select("id", F.when(odd, F.lit(0.0)).otherwise(F.round("z", 6)).alias("z"))


@R.add("flt18_near_lines", sql("SELECT id, abs(nx * 0.6 + ny * 0.8) >= 0.75 * sqrt(nx * nx + ny * ny) AND abs(x / 50 - 0.5) <= 0.3 AS same FROM p"))
def near_lines(spark, sf):
    agree = F.abs(F.col("nx") * 0.6 + F.col("ny") * 0.8) >= 0.75 * F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    return points(spark, sf).select("id", (agree & (F.abs(F.col("x") / 50 - 0.5) <= 0.3)).alias("same"))
