"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import embeddings, language_model, licenses, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, urls

LONG = "\n".join(f"Line number {k} of a very long text has these words." for k in range(20_000))
ROWS = [
    (1, "A line that two have.\nAnother of its own here.", "en", "a", 5), (2, "a line that two have.  \nSomething else entirely.", "en", None, None),
    (3, None, None, None, None), (4, "", "en", "a", 0), (4, "", "en", "a", 0), (5, LONG, "en", "b", 1), (6, LONG, None, "b", 1),
    (None, "A line that two have.", "en", "a", 1), (None, None, None, None, None), (7, " \t\n\r\x0b ", "en", "c", 1),
]
EXTRA = ["_doc", "_hash", "_keep", "_dropped", "N_lines", "n_dropped", "Kept", "expected_grade", "times", "_id", "_copy", "size", "target", "length", "rank", "component_id"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(EXTRA):
        docs = docs.withColumn(c, F.lit(k))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (5, None, 1), (5, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").withColumn("grade", F.lit("x"))
    return docs, labels


OPERATORS = {
    "licenses": lambda d, lab: licenses.license_scan(d),
    "packing": lambda d, lab: packing.pack(d),
    "quality rules": lambda d, lab: quality_rules.quality_rules(d, lab),
    "line dedup": lambda d, lab: line_dedup.line_dedup(d),
    "mixing": lambda d, lab: mixing.mix(d),
    "language model": lambda d, lab: language_model.lm_score(d),
    "classifier": lambda d, lab: quality_classifier.quality_scores(d, lab),
    "simhash": lambda d, lab: simhash.simhash_components(d),
    "near copies": lambda d, lab: simhash.drop_near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(tables, name):
    docs, labels = tables
    rows = OPERATORS[name](docs, labels).collect()
    if name == "packing":
        assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    elif name == "near copies":
        assert [r["doc_id"] for r in rows if r["doc_id"] in (5, 6)] == [5] and sum(r["doc_id"] is None for r in rows) == 2
    else:
        assert len(rows) == len(ROWS)
    if name == "line dedup":
        text = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] is not None}
        assert text[2] == ("Something else entirely.", 2, 1) and text[3] == ("", 1, 0) and text[6] == ("", 20_000, 20_000)
        assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["", ""]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents_and_no_labels(tables, name):
    docs, labels = tables
    assert OPERATORS[name](docs.where("false"), labels.where("false")).collect() == []


def test_odd_urls(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (4, "http://"), (None, "HTTP://WWW.Example.COM/en/x?y#z"), (6, "http://x.net/es/" + "9" * 50_000)], "page_id long, url string")
    for c in ("host", "rule", "verdict", "suffix1", "f_length", "y"):
        frame = frame.withColumn(c, F.lit(1))
    got = urls.url_filter(frame).collect()
    assert len(got) == 7 and {(r["host"], r["rule"]) for r in got if r["page_id"] is None} == {("www.example.com", "www.example.com/en/")}
    assert all(r["host"] == r["path"] == "" and r["rule"] is None for r in got if r["page_id"] in (1, 2, 3, 4))
    assert urls.url_filter(frame.where("false")).collect() == []


def test_clashing_vector_columns(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    for c in ("h1", "id", "cell", "n", "kept"):
        frame = frame.withColumn(c, F.lit("x"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.embedding_near_dedup(frame).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_stages_take_odd_documents(spark, tables, tmp_path):
    docs, labels = tables
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, docs, str(tmp_path))
        rows.collect()
        assert k + 1 == len(corpus_pipeline.STAGES) or rows.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_columns_with_dots_stay(spark):
    docs = spark.createDataFrame([(1, "a shared line of text\nx", 5, 1), (2, "a shared line of text\ny", 6, 2)], "doc_id long, text string, `a.b` int, `_column2` int")
    kept = line_dedup.line_dedup(docs)
    assert kept.columns == ["doc_id", "text", "a.b", "_column2", "n_lines", "n_dropped"]
    assert {tuple(r) for r in kept.collect()} == {(1, "a shared line of text\nx", 5, 1, 2, 0), (2, "y", 6, 2, 2, 1)}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.quality_scores(docs, labels)
    assert scored.columns[:4] == docs.columns and {r["a.b"] for r in scored.collect()} == {5, 6}
