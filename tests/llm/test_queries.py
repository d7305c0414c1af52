"""Registered queries and the pipeline on the smallest tables."""

import pytest

import __spark_entry__ as entry

from test_operators import slow_similar

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages_keep_the_columns_and_act(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == columns
            docs = corpus_pipeline.table(docs)
            counts.append(docs.count())
        if k == 1:
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and docs.count() > 0
    assert docs.select("doc_id", "piece").distinct().count() <= docs.count()


def test_pipeline_decides_row_by_row(spark, sf_dir, monkeypatch):
    body = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest where nobody has been " * 9
    rows = [
        (None, "same text here", "a"), (None, "same text here", "a"), (1, "same text here", "a"), (1, "same text here", "a"),
        (None, "only without ids", "b"), (None, "only without ids", "b"), (2, body, "a"), (None, body + " end", "b"), (3, "bad text", "a"),
        (3, "good text with one shared id", "b"), (None, "bad text", "b"),
    ]
    docs = corpus_pipeline.table(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))

    def after(stage, docs):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, sf_dir).collect()), key=str)

    scores = lambda d, model, id_col: d.select(id_col, corpus_pipeline.F.when(d.text == "bad text", 0.1).otherwise(0.9).alias("score"))
    monkeypatch.setattr(corpus_pipeline.queries, "quality_model", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.quality, "score_quality", lambda d, model, id_col="doc_id": scores(d, model, id_col))
    assert after(corpus_pipeline.quality_stage, docs) == sorted(((i, t) for i, t, _ in rows if t != "bad text"), key=str)
    exact = [(1, "same text here"), (None, "only without ids"), (2, body), (None, body + " end"), (3, "good text with one shared id")]
    got = after(corpus_pipeline.exact_stage, docs.where("text <> 'bad text'"))
    assert got == sorted(exact, key=str)
    near = after(corpus_pipeline.near_stage, docs.where("text <> 'bad text'"))
    assert near == sorted([x for x in exact if x != (None, body + " end")], key=str)
    unequal = [(7, f"word {k} of the first source", "a") for k in range(40)] + [(7, "one", "b"), (None, "two", "b")]
    mixed = corpus_pipeline.table(spark.createDataFrame(unequal, "doc_id long, text string, source string"))
    words = {s: sum(len(t.split()) for _, t, x in unequal if x == s) for s in "ab"}
    plan = {"a": (words["a"] + words["b"] - 3 * words["b"]), "b": 3 * words["b"]}
    out = corpus_pipeline.mix_stage(spark, mixed, sf_dir).collect()
    for s in "ab":
        assert abs(sum(len(r["text"].split()) for r in out if r["source"] == s) - plan[s]) <= (6 if s == "a" else 0)


AWKWARD = [
    (None, None, "en", None, 0), (None, None, "en", None, 0), (1, "", "en", "a", 0), (1, "", None, "b", 0), (2, "   \t\n", "en", "a", 5), (2, "one", "en", "a", 3), (2, "one", "en", "b", 3),
    (None, "one", "fr", "c", None), (3, "word " * 30_000, "en", "a", 1), (4, "x" * 50_000, "en", "b", 1), (5, "é ü 漢字 привет", None, None, None),
]
FIVE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_rows(spark, sf_dir, k):
    """Nulls, repeats, empty and long texts, one identifier in two sources, clashing names, no rows."""
    name, stage = corpus_pipeline.STAGES[k]
    clash = {c: corpus_pipeline.F.lit("clash") for c in ("id", "fp", "copies", "size", "digest", "keep_id", "component_id", "score", "h", "_copies", "_row", "_key", "piece", "row")}
    docs = corpus_pipeline.table(spark.createDataFrame(AWKWARD, FIVE).repartition(3).withColumns(clash))
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns
        given = [tuple(r) for r in docs.collect()]
        assert all(tuple(r) in given for r in rows)
    texts = [r["text"] for r in rows] if k < 4 else []
    if name == "exact dedup":
        kept = sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
        assert kept == sorted([("1", ""), ("2", "   \t\n"), ("2", "one"), ("3", "word " * 30_000), ("4", "x" * 50_000), ("5", "é ü 漢字 привет")])
    if name == "simhash near-dedup":
        # texts without words have one fingerprint, and so have equal ones: one row of each stays, the smallest identifier first
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "5"] and len(texts) == 5
    if name == "mixing sources":
        words = lambda source: sum(len((r["text"] or "").split()) for r in rows if r["source"] == source)
        assert words("c") == 3 and words(None) == 12 and texts.count("") + texts.count(None) + texts.count("   \t\n") <= 4 * 5
    if name == "best-fit packing":
        assert sum(r["piece"] == 0 for r in rows) == len(AWKWARD) and max(r["offset"] + r["length"] for r in rows) <= 4096
    nothing = stage(spark, docs.limit(0), sf_dir)
    assert nothing.count() == 0 and nothing.columns == out.columns


def test_the_whole_run_equals_its_stages(spark, sf_dir):
    """Rows of run() are those of the stages called one after another on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.table(stage(spark, docs, sf_dir))
    placed = ["sequence_id", "offset"]
    key = lambda df: sorted(tuple(r) for r in df.drop(*placed).collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def slow_keep(rows):
    """Rows of (doc_id, text) that exact and near stages keep, by brute force over all pairs."""
    best = {}
    for i, t in rows:
        if (t or "") not in best or best[t or ""] < i:
            best[t or ""] = i
    found = slow_similar(sorted((i, t) for t, i in best.items()))
    return sorted(i for i, least in found.items() if i == least)


def test_deduplicating_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = corpus_pipeline.table(stage(spark, out, sf_dir))
    assert sorted(r["doc_id"] for r in out.collect()) == slow_keep([(r["doc_id"], r["text"]) for r in docs.collect()])
