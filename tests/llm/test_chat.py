from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from gridloom.llm import chat as C


def plain(rows):
    """(conv, perspective) -> rendered text and learnt stretches, turn by turn."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "unknown", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        for seat in {r for _, r, _ in turns}:
            text, learnt = "", []
            for _, role, said in turns:
                text += f"<|{'assistant' if role == seat else f'user name={role}'}|>\n"
                if role == seat:
                    learnt.append((len(text), 0))
                text += said + C.END
                if role == seat:
                    learnt[-1] = (learnt[-1][0], len(text))
            out[conv, seat] = text, learnt
    return out


def joined(got):
    """Blocks of a rendering put together again, with the masks moved."""
    out = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.perspective, r.block)):
        text, learnt = out.get((r.conv_id, r.perspective), ("", []))
        spans = [tuple(map(int, m.split(":"))) for m in r.mask.split(",") if m] if isinstance(r.mask, str) else [(m.start, m.end) for m in r.mask]
        assert sum(b - a for a, b in spans) == r.n_learnt
        out[r.conv_id, r.perspective] = text + r.rendered, learnt + [(a + len(text), b + len(text)) for a, b in spans]
    return out


def test_query_against_plain_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op10_chat(spark, sf).collect()
    assert joined(got) == plain(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = con.sql(C.ORACLE)
    names = sorted(rel.columns)
    assert sorted(str([d[n] for n in names]) for d in (dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())) == sorted(str([r[n] for n in names]) for r in got)


def test_nulls_against_sql(spark, tmp_path):
    """Turns and conversations without a number: the same rows as by SQL, and parts tell them apart."""
    rows = [(1, 0, "user", "a"), (1, None, "bot", "z"), (1, None, "bot", "y"), (1, None, "user", None), (None, 0, "user", "x"), (None, None, "cy", "w"), (None, 70, None, "v")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    got = C.op10_chat(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    rel = con.sql(C.ORACLE)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(str(sorted(d.items())) for d in want) == sorted(str(sorted(r.asDict().items())) for r in got)
    keys = [(r.conv_id, r.perspective, r.block, r.part) for r in got]
    assert len(set(keys)) == len(keys) and sum(r.n_turns for r in got if r.conv_id == 1) == 8 and all((r.part is None) == (r.block is not None) for r in got)


def test_long_conversation_in_blocks(spark):
    rows = [(1, t, ("ann", "bob", "cy")[t % 3], f"word {t} 🙂") for t in range(500)]
    got = C.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=16).collect()
    assert len(got) == 3 * 32 and max(r.n_turns for r in got) == 16 and joined(got) == plain(rows)


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "b"), (1, 1, None, "c"), (None, 0, "user", ""), (None, 1, "system", "s"), (3, 5, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seats", F.lit(1)).withColumn("block", F.lit("y"))
    assert joined(C.rotate(df).collect()) == plain(rows)
    late = spark.createDataFrame([(1, 0, "user", "a"), (1, None, "bot", "z")], "conv_id long, turn long, role string, text string")
    got = C.rotate(late).collect()
    assert len(got) == 4 and {r.part for r in got if r.block is None} != {None}
    assert C.rotate(df.limit(0)).count() == 0
