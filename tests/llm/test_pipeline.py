import pytest

import corpus_pipeline as pipeline
from gridloom.llm import decontam, pieces, toxicity
from tests.llm.test_neardup import five_words
from tests.llm.test_secrets import redacted


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def toxic(text):
        hits, n = model.hits(text or "")
        return model.score(model.together([s for *_, s in toxicity.segments(hits, model.cost)], n)) >= 0.5

    left = {i: r for i, r in rows.items() if not toxic(r.text)}
    first = pipeline.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == set(left)
    sets, group = {i: five_words(r.text) for i, r in left.items()}, {i: i for i in left}
    for a in left:
        for b in left:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    left = {i: left[i] for i in set(group.values())}
    index = decontam.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    left = {i: r for i, r in left.items() if not index.search(r.text)}
    got = {r.doc_id: r for r in pipeline.run(spark, sf).collect()}
    assert set(got) == set(left)
    codec = pieces.Codec(pieces.model_bytes())
    for i, r in got.items():
        assert r.text == redacted(left[i].text) and r.as_library and r.n_chars == len(r.text)
        assert list(r.ids) == [*codec.library.encode(r.text), codec.library.eos_id()]
    assert 100 < len(got) < len(rows)


#: Names that the operators use within, and those of their results.
CLASHES = "k y key row fp sim n x u v root node added found base start end kind given ids decoded n_tokens as_library ids_sha256 score best passages item_id distance host slot known group value weight sig tune".split()


@pytest.mark.parametrize("at", range(len(pipeline.STAGES)))
def test_extra_columns_of_any_name(spark, sf, at):
    name, stage = pipeline.STAGES[at]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.selectExpr("*", *[f"doc_id AS `{c}`" for c in CLASHES])
    out = stage(spark, more, sf)
    assert out.columns[: len(more.columns)] == more.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect())
    assert out.where(" OR ".join(f"`{c}` <> doc_id" for c in CLASHES)).isEmpty()


def test_no_stage_drops_clean_rows_or_fails_on_odd_ones(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "just a clean sentence here", "en", "s", 26), (3, "just a clean sentence here", "en", "s", 26), (None, "no id at all on this one", "en", None, 24)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.columns[:5] == odd.columns
        # The empty and the null text are copies, and so are the repeated rows.
        assert out.count() == (3 if "dedup" in name else 5), name
        assert stage(spark, odd.limit(0), sf).count() == 0
