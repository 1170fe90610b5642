"""Carrier queries of the streaming operators, run over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import retrieval as RT
from gridloom.operators.sequences import reindex
from gridloom.plans.carriers import BANDS, FRAMES_SQL, POINTS_SQL, Registry, features, frames, points
from gridloom.session import table
from gridloom.sources.formats import half
from gridloom.streaming import agents as A

R = Registry()


def events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@R.add("str1_str2_str4_tracking")
def tracking(spark, sf):
    """State machine of every agent over its frames."""
    return A.track_batch(events(spark, sf))


@R.add("str6_active_submaps")
def active(spark, sf):
    return A.active_submaps(A.track_batch(events(spark, sf)))


@R.add("str3_keyframe_insertion", f"WITH {FRAMES_SQL} SELECT user_id, event_id, first_key, n FROM (SELECT user_id, event_id, seq, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS first_key, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY seq) AS n, event_type FROM e) WHERE event_type = 'purchase'")
def keyframe_insertion(spark, sf):
    """Keyframes with the origin of their map and how many there were by then."""
    w = Window.partitionBy("user_id").orderBy("seq")
    k = frames(spark, sf).where("event_type = 'purchase'")
    first = k.groupBy("user_id").agg(F.min("event_id").alias("first_key"))
    return k.join(first, "user_id").select("user_id", "event_id", "first_key", F.row_number().over(w).cast("long").alias("n"))


@R.add("str5_room_transitions", f"WITH {FRAMES_SQL} SELECT user_id, event_id, inside AND NOT coalesce(was, false) AS enters, NOT inside AND coalesce(was, false) AS leaves FROM (SELECT user_id, event_id, event_type IN ('click', 'purchase') AS inside, lag(event_type IN ('click', 'purchase')) OVER (PARTITION BY user_id ORDER BY seq) AS was FROM e) WHERE inside <> coalesce(was, false)")
def transitions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("seq")
    inside = F.col("event_type").isin("click", "purchase")
    df = frames(spark, sf).select("user_id", "event_id", inside.alias("inside"), F.coalesce(F.lag(inside).over(w), F.lit(False)).alias("was"))
    return df.where("inside <> was").select("user_id", "event_id", (F.col("inside") & ~F.col("was")).alias("enters"), (~F.col("inside") & F.col("was")).alias("leaves"))


@R.add("str7_drains", f"WITH {FRAMES_SQL} SELECT user_id, (seq - 1) // 5 AS drain, count(*) AS n, min(event_id) AS first_event FROM e GROUP BY ALL")
def drains(spark, sf):
    out = A.drained(frames(spark, sf), "user_id", "seq", 5)
    return out.groupBy("user_id", "drain").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@R.add("str9_upsert", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def upsert(spark, sf):
    """Two halves of a stream, the second put over the first."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    last = lambda df: df.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return A.upsert(last(e.where("event_id % 2 = 0")), last(e.where("event_id % 2 = 1")), ["user_id", "event_type"], "event_id")


@R.add("str12_str13_scoped_matches", "SELECT a.vec_id, count(*) AS n, max(b.vec_id) AS newest FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 50 = b.vec_id // 50 AND b.vec_id < a.vec_id GROUP BY a.vec_id")
def scoped(spark, sf):
    """Probe before insert within a scope that is reset: only earlier rows of the same scope are seen."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("scope"))
    b = e.select(F.col("vec_id").alias("seen"), "label", "scope")
    return e.join(b, ["label", "scope"]).where("seen < vec_id").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("newest"))


@R.add("str15_withdraw", "SELECT event_id, user_id, CASE WHEN user_id % 3 <> 0 THEN props END AS props FROM events")
def withdraw(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "props")
    gone = e.where("user_id % 3 = 0").select("user_id").distinct()
    return A.withdrawn(e, gone, "user_id", ["props"]).select("event_id", "user_id", "props")


@R.add("prj13_half_floats")
def half_floats(spark, sf):
    return points(spark, sf).select("id", *[half(F.col(n)).alias(n) for n in ("nx", "ny", "nz")])


@R.add("snk12_split_by_label", f"WITH {POINTS_SQL} SELECT label, count(*) AS n FROM (SELECT DISTINCT id, unnest([semantic, camera, frame]) AS label, x, y, z, w FROM p) GROUP BY label")
def split_labels(spark, sf):
    from gridloom.sources.formats import split_mesh

    t = points(spark, sf).select("id", "x", "y", "z", "w", "semantic", "camera", "frame").distinct()
    return split_mesh(t, ["semantic", "camera", "frame"]).select("id", "label", "x", "y", "z", "w").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@R.add("snk5_src15_spill_round_trip", f"WITH {POINTS_SQL} SELECT camera AS camera_id, submap AS submap_id, count(*) AS n FROM p WHERE submap = 7 AND z / 10 < 1 GROUP BY ALL")
def spill_round_trip(spark, sf):
    """Submaps written as partitions; one is read again."""
    from gridloom.session import checkpoint_root
    from gridloom.sources.formats import write_submaps

    path = f"{checkpoint_root(spark)}/submaps-{spark.sparkContext.applicationId}"
    v = points(spark, sf).select(F.col("camera").cast("long").alias("camera_id"), F.col("submap").alias("submap_id"), (F.col("z") / 10).alias("sdf"), F.lit(0.0).alias("weight"))
    write_submaps(v, path)
    return spark.read.parquet(path).where("submap_id = 7").groupBy(F.col("camera_id").cast("long").alias("camera_id"), F.col("submap_id").cast("long").alias("submap_id")).agg(F.count(F.lit(1)).alias("n"))


@R.add("src1_associations")
def associations(spark, sf):
    """Time pairs of frames as text lines, written and scanned."""
    from gridloom.session import checkpoint_root
    from gridloom.sources.formats import associations as scan

    path = f"{checkpoint_root(spark)}/associate-{spark.sparkContext.applicationId}"
    line = F.when(F.col("event_id") % 10 == 0, F.lit("broken line")).otherwise(F.concat_ws(" ", F.col("event_id"), F.concat(F.lit("rgb/"), F.col("event_id")), F.col("event_id") + 1, F.concat(F.lit("depth/"), F.col("event_id"))))
    table(spark, sf, "events").select(line.alias("value")).write.mode("overwrite").text(path)
    return scan(spark, path).select("t_rgb", "rgb_path", "t_depth", "depth_path", "ts")


R.oracles["src1_associations"] = "SELECT event_id::DOUBLE AS t_rgb, 'rgb/' || event_id AS rgb_path, (event_id + 1)::DOUBLE AS t_depth, 'depth/' || event_id AS depth_path, event_id + 0.5::DOUBLE AS ts FROM events WHERE event_id % 10 <> 0"


@R.add("img2_normal_maps")
def normal_maps(spark, sf):
    """Depth pictures of the agents, as large as their pixels reach, with normals by central differences: mean normal of each."""
    import numpy as np
    import pandas as pd

    from gridloom.functions.grid import chunk_key
    from gridloom.operators import images
    from gridloom.operators.rooms import by_group

    px = points(spark, sf).groupBy("camera", chunk_key(F.col("x") / 4, 1).alias("u"), chunk_key(F.col("y") / 4, 1).alias("v")).agg((F.avg("z") / 10 + 1).alias("d"))

    def normals(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = np.zeros((pdf["v"].max() + 1, pdf["u"].max() + 1))
        depth[pdf["v"], pdf["u"]] = pdf["d"]
        n = images.normal_map(images.clip_range(depth, 8.0), 16.0, 16.0, 7.5, 7.5)
        known = np.abs(n).sum(axis=2) > 0
        mean = n[known].mean(axis=0) if known.any() else np.zeros(3)
        return pd.DataFrame({"camera": [pdf["camera"].iloc[0]], "known": [int(known.sum())], "nz": [round(float(mean[2]), 6)]})

    return by_group(px, ["camera"], "camera long, known long, nz double", normals)


@R.add("itr7_two_view_pipeline")
def two_view(spark, sf):
    """Band match, then matches whose rotation agrees: candidates of the verified pairs."""
    f = features(spark, sf)
    m = RT.band_matches(f, f, BANDS, "vec_id", "vec_id", 50, extra=F.col("q.vec_id") != F.col("t.vec_id"))
    binned = m.withColumn("bin", F.pmod(F.col("match") - F.col("vec_id"), F.lit(18))).withColumn("grp", F.lit(0))
    return RT.main_rotation(binned, "grp", "bin").select("vec_id", "match", "distance")


@R.add("snk6_trajectory")
def trajectory(spark, sf):
    """Poses written as a trajectory and read again: largest change by rounding."""
    from gridloom.session import checkpoint_root
    from gridloom.sources import formats

    path = f"{checkpoint_root(spark)}/trajectory-{spark.sparkContext.applicationId}"
    p = points(spark, sf).select(F.col("id").cast("double").alias("ts"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("nx").alias("qx"), F.col("ny").alias("qy"), F.col("nz").alias("qz"), F.lit(0.5).alias("qw"), "semantic")
    formats.write_trajectory(p, path, F.col("semantic") != 0)
    return formats.trajectory(spark, path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tx"), 3).alias("tx"), F.round(F.sum("tz"), 3).alias("tz"))


R.oracles["snk6_trajectory"] = f"WITH {POINTS_SQL} SELECT count(*) AS n, round(sum(x), 3) AS tx, round(sum(z), 3) AS tz FROM p WHERE semantic <> 0"


@R.add("wide_reindex_by_submap", f"WITH {FRAMES_SQL} SELECT user_id, (seq - 1) // 11 AS submap, event_id, (seq - 1) % 11 AS idx FROM e")
def reindex_by_submap(spark, sf):
    df = frames(spark, sf).withColumn("submap", F.floor((F.col("seq") - 1) / 11).cast("long"))
    return reindex(df, ["user_id", "submap"], ["seq"], "idx").select("user_id", "submap", "event_id", "idx")
