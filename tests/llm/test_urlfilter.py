"""Mined URL rules change verdicts on the given urls; odd rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from bidframe.llm import urlfilter


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet")


def test_planted_labels_change_verdicts(pages):
    """Pages of one host and directory are labelled bad (and a few others by chance): they are blocked where no given rule decides."""
    token = F.array_contains(urlfilter.url_tokens(F.col("url")), "p:fr")
    by_chance = F.pmod(F.xxhash64("url"), F.lit(20)) == 0
    labelled = pages.select("url", F.coalesce(token | by_chance, F.lit(False)).alias("bad"))
    before = {r.page_id: r for r in urlfilter.filter_urls(pages, labelled.withColumn("bad", F.lit(False))).collect()}
    after = urlfilter.filter_urls(pages, labelled).join(pages.select("page_id", token.alias("planted")), "page_id").collect()
    planted = [r for r in after if r.planted and r.rule is None]
    assert len(planted) > 50 and all(r.verdict == "block" and r.confidence > 0.5 for r in planted) and all(before[r.page_id].verdict == "allow" for r in planted)
    others = [r for r in after if not r.planted and r.rule is None]
    assert sum(r.verdict == "allow" for r in others) > 0.9 * len(others)
    assert all(r.verdict == before[r.page_id].verdict and r.rule == before[r.page_id].rule for r in after if r.rule)
    assert {r.mined_rules for r in before.values()} == {0} and min(r.mined_rules for r in after) > 0


def test_odd_urls_labels_and_columns(spark):
    columns = "page_id long, url string, rule string, bad string, confidence double, host int, tokens int, token int"
    rows = [(k, f"http://bad.site/{k}", "r", "b", 0.1, 1, 2, 3) for k in range(40)] + [(k, f"http://fine.site/{k}", "r", "b", 0.1, 1, 2, 3) for k in range(100, 160)]
    odd = [(900, None, "r", "b", 0.1, 1, 2, 3), (900, None, "r", "b", 0.1, 1, 2, 3), (901, "", None, None, None, None, None, None), (None, "no scheme", "r", "b", 0.1, 1, 2, 3), (902, "http://", "r", "b", 0.1, 1, 2, 3), (903, "http://bad.site/" + "x/" * 50_000, "r", "b", 0.1, 1, 2, 3), (0, "http://bad.site/0", "r", "b", 0.1, 1, 2, 3)]
    pages = spark.createDataFrame(rows + odd, columns)
    labels = [(r[1], "bad.site" in r[1]) for r in rows] + [(None, True), (rows[0][1], None), (rows[0][1], True), (rows[0][1], True)]
    labelled = spark.createDataFrame([(u, b, 1, "t") for u, b in labels], "url string, bad boolean, confidence int, tokens string")
    got = urlfilter.filter_urls(pages, labelled).collect()
    assert len(got) == len(rows) + len(odd)
    assert {r.page_id for r in got if r.verdict == "block"} == {*range(40), 903}
    assert all(r.host == r.path == "" and r.confidence is None for r in got if r.page_id in (900, 901, None))
    assert urlfilter.filter_urls(pages, labelled.limit(0)).filter("verdict = 'block'").count() == 0 and urlfilter.filter_urls(pages.limit(0), labelled).count() == 0
