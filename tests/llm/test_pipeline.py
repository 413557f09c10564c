"""The pipeline's stages one by one, on small input."""

import re

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet").cache(), []
    for name, stage in cp.STAGES:
        got = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, got))
        docs = got
    return out


def test_columns_and_names(stages):
    assert [s[0] for s in stages] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_files"]
    for _, before, after in stages[:-1]:
        assert after.columns == cp.COLUMNS and dict(after.dtypes) == dict(before.dtypes)


def test_language_keeps_clean_documents(stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.doc_id for r in before.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_one_of_each_group_stays(stages):
    from tests.llm.test_operators import brute_groups

    _, before, after = stages[1]
    want = {i for i, (_, c) in brute_groups([(r.doc_id, r.text) for r in before.collect()]).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want


def test_benchmark_holders_go(spark, stages):
    _, before, after = stages[2]
    clean = lambda s: " ".join(re.sub(r"[^\w]", "", w).lower() for w in s.split())
    items = [clean(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = {r.doc_id for r in before.collect() if not any(f" {t} " in f" {clean(r.text)} " for t in items)}
    assert {r.doc_id for r in after.collect()} == want


def test_mix_takes_effect(stages):
    from bidframe.llm.mixing import mix_sources

    _, before, after = stages[3]
    want = {r.doc_id: r.copies for r in mix_sources(before).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want


def test_tokens_hold_every_copy(stages):
    from tests.llm.test_operators import plain_ids

    _, before, after = stages[4]
    assert [tuple(r) for r in after.orderBy("start").collect()] == plain_ids([(r.doc_id, r.text) for r in before.collect()])


def test_odd_documents_run_through(spark):
    from tests.llm.test_operators import ODD

    docs, sf_dir = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long"), "/root/testdata/sf0.001"
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() >= 0
    for _, stage in cp.STAGES:
        empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, empty, sf_dir).count() == 0


def test_repeated_rows_stay_or_go_together(spark):
    """Rows are judged by their own text; a doc_id is one document from the second stage on."""
    said = lambda a, b: " ".join(f"word{k % 7} and{k}" for k in range(a, b))
    docs = spark.createDataFrame(
        [(1, said(0, 50), "en", "a", 1), (1, said(0, 50), "en", "a", 1), (2, said(0, 51), "en", "a", 1), (3, "12 34", "en", "a", 1), (3, said(60, 90), "en", "a", 1), (4, said(100, 150), "en", "b", 1), (4, said(0, 50), "en", "b", 1), (None, said(200, 230), None, "b", 1), (5, None, "en", "a", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    first = cp.keep_identified_languages(spark, docs, "")
    assert sorted(r.doc_id or 0 for r in first.collect()) == [0, 1, 1, 2, 3, 4, 4]
    second = cp.keep_one_of_each_group(spark, first, "")
    assert sorted(r.doc_id or 0 for r in second.collect()) == [0, 1, 1, 3]
    taken = cp.mix(spark, second, "")
    assert {r.doc_id for r in taken.collect()} <= {None, 1, 3} and taken.columns == cp.COLUMNS
