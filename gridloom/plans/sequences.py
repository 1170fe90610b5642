"""Carrier queries of windows, ordered access and sets over frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import sequences as S
from gridloom.plans.carriers import FRAMES_SQL, Registry, frames, r6
from gridloom.session import table

R = Registry()


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([FRAMES_SQL, *more])} {body}"


@R.add("win1_trailing_mean", sql("SELECT user_id, seq, round(avg(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM e"))
def trailing_mean(spark, sf):
    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(-4, 0)
    return frames(spark, sf).select("user_id", "seq", r6(F.avg("value").over(w), "mean"))


_BEST = "SELECT user_id, arg_max(seq, (m, -seq)) AS last_seq, round(max(m), 6) AS mean FROM (SELECT user_id, seq, avg(value) OVER w AS m, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5 GROUP BY user_id HAVING max(m) > 1e-4"


@R.add("win1_best_window", sql(_BEST))
def best_window(spark, sf):
    return S.best_window(frames(spark, sf), "user_id", "seq", "value", 5).select("user_id", "last_seq", r6("mean", "mean"))


@R.add("win2_schedule")
def schedule(spark, sf):
    """Frames chosen for re-integration: windows of 5, 2, 2, then 1, 1, 1 where fewer than 5 were taken."""
    return S.schedule(frames(spark, sf), "user_id", "seq", "value")


@R.add("win3_belief_filter")
def belief_filter(spark, sf):
    return S.belief(frames(spark, sf).select("user_id", "seq", (F.col("value") / (F.col("value") + 50)).alias("likelihood")), "user_id", "seq", "likelihood").select("user_id", "seq", r6("belief", "belief"), "flag")


@R.add("win4_jn24_previous", sql("SELECT user_id, seq, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY seq) AS last_frame, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_keyframe FROM e"))
def previous(spark, sf):
    w = Window.partitionBy("user_id").orderBy("seq")
    key = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return frames(spark, sf).select("user_id", "seq", "event_id", F.lag("event_id").over(w).alias("last_frame"), F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last_keyframe"))


@R.add("win5_jn14_forward_fill", sql("SELECT user_id, seq, last_value(CASE WHEN value > 60 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS label FROM e"))
def forward_fill(spark, sf):
    df = frames(spark, sf).withColumn("label", F.when(F.col("value") > 60, F.col("event_type")))
    return S.forward_fill(df, "user_id", "seq", "label").select("user_id", "seq", "label")


@R.add("win6_snk8_reindex", sql("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq)::BIGINT - 1 AS idx FROM e"))
def reindex(spark, sf):
    return S.reindex(frames(spark, sf), ["user_id", "event_type"], ["seq"], "idx").select("user_id", "event_type", "event_id", "idx")


@R.add("win7_strided_sample", sql("SELECT user_id, seq FROM (SELECT user_id, seq, count(*) OVER (PARTITION BY user_id) AS n FROM e) WHERE (seq - 1) % greatest(n // 20, 1) = 0"))
def strided_sample(spark, sf):
    return S.strided(frames(spark, sf), "user_id", "seq", 20).select("user_id", "seq")


@R.add("win8_evenly_spaced", sql("SELECT user_id, seq FROM (SELECT user_id, seq, count(*) OVER (PARTITION BY user_id) AS n FROM e) WHERE floor((seq - 1) * 6.0 / n) > floor((seq - 2) * 6.0 / n) OR seq = 1"))
def evenly_spaced(spark, sf):
    return S.evenly(frames(spark, sf), "user_id", "seq", 6).select("user_id", "seq")


@R.add("agg28_path_length", sql("SELECT user_id, round(sum(abs(value - p)), 4) AS length FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY seq) AS p FROM e) GROUP BY user_id"))
def path_length(spark, sf):
    w = Window.partitionBy("user_id").orderBy("seq")
    step = frames(spark, sf).withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    return step.groupBy("user_id").agg(F.round(F.sum("step"), 4).alias("length"))


@R.add("str4_count_windows", sql("SELECT user_id, (k - 1) // 11 AS submap, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM e WHERE event_type = 'view') GROUP BY ALL"))
def count_windows(spark, sf):
    """A submap closes after 11 keyframes."""
    keys = S.reindex(frames(spark, sf).where("event_type = 'view'"), ["user_id"], ["seq"], "k")
    return keys.groupBy("user_id", F.floor(F.col("k") / 11).cast("long").alias("submap")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@R.add("str5_islands", sql("SELECT user_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM e WHERE value > 40) GROUP BY user_id, g"))
def islands(spark, sf):
    """Stays in a room: unbroken runs of frames."""
    return S.islands(frames(spark, sf).where("value > 40"), "user_id", "seq").select("user_id", "first_seq", "last_seq", "n")


@R.add("flt19_str14_silence", sql("SELECT user_id, event_id, date_diff('second', p, ts) AS gap FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY seq) AS p FROM e) WHERE date_diff('second', p, ts) > 100"))
def silence(spark, sf):
    """Agents silent for more than 100 s before a frame."""
    w = Window.partitionBy("user_id").orderBy("seq")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    gap = (sec - F.lag(sec).over(w)).cast("long")
    return frames(spark, sf).select("user_id", "event_id", gap.alias("gap")).where("gap > 100")


@R.add("str10_last_pose", sql("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM e GROUP BY ALL"))
def last_pose(spark, sf):
    """Upsert of poses: the last by key."""
    last = frames(spark, sf).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return last.select("user_id", "event_type", "m.event_id", r6("m.value", "value"))


@R.add("str11_registration", sql("SELECT user_id, row_number() OVER (ORDER BY t, user_id) - 1 AS camera_id FROM (SELECT user_id, min(epoch_us(ts)) AS t FROM e GROUP BY user_id)"))
def registration(spark, sf):
    """Agents are numbered in the order in which they came."""
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    return S.numbered(first, ["t", "user_id"], "camera_id").select("user_id", "camera_id")


@R.add("stream_hourly_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_counts(spark, sf):
    hour = F.window(F.col("ts"), "1 hour")["start"]
    return table(spark, sf, "events").groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add("top1_top_per_key", sql("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM e) WHERE rank <= 6"))
def top_per_key(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return frames(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 6").select("user_id", "event_id", "rank")


@R.add("top4_seed", sql("SELECT user_id, arg_min(event_id, (value, event_id)) AS seed FROM e WHERE event_type <> 'view' GROUP BY user_id"))
def seed(spark, sf):
    return frames(spark, sf).where("event_type <> 'view'").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("seed"))


@R.add("top8_feature_cap", sql("SELECT user_id, event_id FROM e WHERE seq <= 100"))
def feature_cap(spark, sf):
    return frames(spark, sf).where("seq <= 100").select("user_id", "event_id")


@R.add("top10_sorted_rank", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events")
def sorted_rank(spark, sf):
    """Global order by ranges: each range is numbered from the count of those before it."""
    return S.numbered(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"], "place").select("event_id", "place")


@R.add("snk7_sorted_members", sql("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM e) GROUP BY user_id"))
def sorted_members(spark, sf):
    return frames(spark, sf).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))
