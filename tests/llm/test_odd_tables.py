"""Each operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import decontamination, embeddings, licenses, mixing, pii, quality, sharding, simhash, substrings, token_counts
from tracewell.llm.queries import tokenizer_path

CLASHING = ("fp", "key", "size", "shard", "slot", "label", "quality", "hit", "bucket", "bits", "n", "score", "lead", "doc", "tokens")


@pytest.fixture(scope="module")
def tables(spark, small):
    long = " ".join(f"word{k % 5000}" for k in range(120_000))
    rows = [(None, "no id at all"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, long), (7, "x" * 400_000), (8, "é　\U0001f600 \x00 end")]
    odd = spark.createDataFrame([(*r, "en" if i % 2 else None, None, None) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id > 20").unionByName(odd)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    labels = spark.read.parquet(f"{small}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (30, None, None), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")).withColumn("text", F.lit("clash"))
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(None, "a null id item of six words"), (900, None), (901, ""), (902, "short")], "item_id long, text string")).withColumn("doc_id", F.lit(1))
    return docs.cache(), labels.cache(), benchmark.cache()


OPERATORS = {
    "shard": lambda d, l, b: sharding.shard_plan(d),
    "simhash": lambda d, l, b: simhash.simhash_components(d),
    "near": lambda d, l, b: simhash.near_duplicates(d),
    "tokens": lambda d, l, b: token_counts.token_counts(d, tokenizer_path()),
    "quality": lambda d, l, b: quality.quality_scores(d, l),
    "pii": lambda d, l, b: pii.personal_data(d, redact=True),
    "mixing": lambda d, l, b: mixing.mixing_rates(d, l, mixing.TARGETS),
}
FINDERS = {
    "licenses": lambda d, l, b: licenses.license_spans(d),
    "benchmark": lambda d, l, b: decontamination.contaminated(d, b),
    "passages": lambda d, l, b: substrings.repeated_passages(d),
}
FILTERS = {
    "good": lambda d, l, b: quality.keep_good(d, l),
    "one": lambda d, l, b: simhash.one_of_each(d),
    "clean": lambda d, l, b: decontamination.drop_contaminated(d, b),
    "mixed": lambda d, l, b: mixing.mixed(d, l, mixing.TARGETS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(tables, name):
    docs = tables[0]
    out = OPERATORS[name](*tables)
    assert sorted((r[0] is None, r[0] or 0) for r in out.select("doc_id").collect()) == sorted((r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", FINDERS)
def test_finders(tables, name):
    assert FINDERS[name](*tables).count() > 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(tables, name):
    out = FILTERS[name](*tables)
    assert out.columns == tables[0].columns and out.count() > 0


@pytest.mark.parametrize("name", {**OPERATORS, **FINDERS, **FILTERS})
def test_empty_tables(tables, name):
    run = {**OPERATORS, **FINDERS, **FILTERS}[name]
    docs, labels, benchmark = tables
    assert run(docs.limit(0), labels, benchmark).count() == 0
    assert run(docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0
    assert run(docs.where("doc_id < 40 or doc_id is null"), labels.limit(0), benchmark.limit(0)).count() >= 0


def test_empty_vectors(spark):
    assert embeddings.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_equal_rows_and_empty_texts(tables):
    rows = {(r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.simhash_components(tables[0]).collect() if r["doc_id"] in (1, 2, 3, 4, 5)}
    assert {(i, c) for i, c, _ in rows} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert {f for i, _, f in rows if i < 4} == {"0" * 16}
    left = [r["doc_id"] for r in simhash.one_of_each(tables[0]).collect()]
    assert left.count(4) == 1 and 5 not in left and left.count(None) == 2


def test_pipeline_on_odd_rows(spark, tables, tmp_path):
    for name, table in zip(("documents", "labels", "benchmark"), tables):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    for name, table in zip(("documents", "labels", "benchmark"), tables):
        table.limit(0).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
