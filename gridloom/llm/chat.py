"""Chat formatting by multi-party perspective rotation.

For each participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users.  The loss mask covers what
the assistant of that rendering says and its end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import table

#: A turn is HEAD + role + name + BODY + text + END.
HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"
#: Turns numbered block * TURNS to block * TURNS + TURNS - 1 share a row of the result.
TURNS = 64
#: Parts that the turns without a number are spread over, by the first hex digits of a digest.
PARTS = 1024


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = TURNS) -> DataFrame:
    """One row for each conversation, perspective and block of turns.

    Columns: conv_id, perspective, block, part, n_turns, rendered, mask (array of start and
    end, code points within rendered, of what is learnt), n_learnt (code points). part is
    null but for turns without a number, which have no block.
    A conversation's rendering is its blocks in order, joined; blocks bound the size of
    a row, so that a conversation of any length spreads over many tasks.

    Null texts are empty; a null role is the speaker ``unknown``; null turns come last,
    in parts of their own by a hash of role and text; a null conversation is one of its own; equal turn numbers go by role, then
    text; repeated rows are rendered as often as they occur; an empty table gives no rows.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / F.lit(block)).cast("long"))
    rows = rows.withColumn("part", F.when(F.col("turn").isNull(), F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "role", "text")), 1, 4), 16, 10).cast("int"), F.lit(PARTS))).otherwise(F.lit(-1)))
    # Repeated rows are counted before the shuffle.
    rows = rows.groupBy("conv_id", "block", "part", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    blocks = rows.groupBy("conv_id", "block", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n"))).alias("said"), F.collect_set("role").alias("here"))
    # The speakers of a conversation: partial sets by block, then one array by conversation.
    seats = blocks.select("conv_id", F.explode("here").alias("seat")).distinct().groupBy("conv_id").agg(F.sort_array(F.collect_list("seat")).alias("seats"))
    placed = blocks.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).join(
        seats.select(F.col("conv_id").alias("seat_conv"), "seats"), F.col("conv_id").eqNullSafe(F.col("seat_conv"))
    )
    flat = F.expr("flatten(transform(said, x -> array_repeat(struct(x.role AS role, x.text AS text), cast(x.n AS int))))")
    each = placed.select("conv_id", "block", "part", flat.alias("said"), F.explode("seats").alias("perspective"))
    head = f"concat('{HEAD}', if(x.role = perspective, 'assistant', concat('user name=', x.role)), '{BODY}')".replace("\n", "\\n")
    end = END.replace("\n", "\\n")
    each = each.withColumn("heads", F.expr(f"transform(said, x -> {head})")).withColumn("texts", F.expr(f"transform(said, x -> concat(x.text, '{end}'))"))
    # Each turn's end is a running sum; a block has few turns.
    each = each.withColumn("sizes", F.expr("transform(heads, (h, i) -> length(h) + length(texts[i]))"))
    each = each.withColumn("ends", F.expr("transform(sizes, (s, i) -> aggregate(slice(sizes, 1, i + 1), 0, (a, b) -> a + b))"))
    spans = F.expr("filter(transform(said, (x, i) -> if(x.role = perspective, struct(ends[i] - length(texts[i]) AS start, ends[i] AS end), null)), x -> x IS NOT NULL)")
    out = each.withColumn("mask", spans)
    return out.select(
        "conv_id", "perspective", "block", F.when(F.col("part") >= 0, F.col("part")).alias("part"), F.size("said").alias("n_turns"),
        F.expr("array_join(flatten(transform(heads, (h, i) -> array(h, texts[i]))), '')").alias("rendered"), "mask",
        F.expr("aggregate(mask, 0, (a, m) -> a + m.end - m.start)").alias("n_learnt"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's seat; the mask is given as text as well."""
    out = rotate(table(spark, sf_dir, "conversations"))
    mask = F.expr("array_join(transform(mask, m -> concat(m.start, ':', m.end)), ',')")
    return out.select("conv_id", "perspective", "block", "part", "n_turns", "rendered", mask.alias("mask"), "n_learnt")


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, turn // {TURNS} AS block, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
        CASE WHEN turn IS NULL THEN ('0x' || substr(md5(coalesce(role, 'unknown') || '|' || coalesce(text, '')), 1, 4))::INTEGER % {PARTS} END AS part FROM conversations),
seats AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
r AS (SELECT t.*, perspective,
        '{HEAD}' || CASE WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || '{BODY}' AS head,
        text || '{END}' AS body FROM t JOIN seats ON t.conv_id IS NOT DISTINCT FROM seats.conv_id),
s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM r)
SELECT conv_id, perspective, CAST(block AS BIGINT) AS block, part, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg(head || body, '' ORDER BY turn, role, text) AS rendered,
  coalesce(string_agg(CASE WHEN role = perspective THEN (e - length(body))::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR END, ',' ORDER BY turn, role, text), '') AS mask,
  CAST(sum(CASE WHEN role = perspective THEN length(body) ELSE 0 END) AS INTEGER) AS n_learnt
FROM s GROUP BY conv_id, perspective, block, part
"""
