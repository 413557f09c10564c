"""Queries on the remaining operators: quotes, first and dominant rows, corrections, considerations, the fresh pool."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bidframe.operators import decisions, ingest, ledger, metrics, pricing, quality, scoring, views
from bidframe.plans import text as texts
from bidframe.plans.quality import _PRED, _predictions
from bidframe.plans.registry import query
from bidframe.plans.standin import table, with_tables
from bidframe.sources import feeds


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CASE WHEN l_discount > 0.04 AND l_tax > 0.02 THEN round((l_discount * 100 + l_tax * 100) / 2, 4) END AS mid FROM lineitem")
def quote_cleaning(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s", "CASE WHEN l_discount > 0.04 THEN l_discount * 100 WHEN l_linenumber % 2 = 0 THEN -1D ELSE CAST('NaN' AS DOUBLE) END AS bid", "CASE WHEN l_tax > 0.02 THEN l_tax * 100 ELSE 0D END AS ask")
    return rows.select("k", "n", "p", "s", F.round(pricing.mid_quote(F.col("bid"), F.col("ask")), 4).alias("mid"))


@query(with_tables("deals") + "SELECT id FROM deals WHERE expected_close_date >= DATE '2000-01-01' OR expected_close_date IS NULL")
def recency_filter(spark, d):
    return feeds.recent(table(spark, d, "deals"), "expected_close_date", date(2000, 1, 1), keep_undated=True).select("id")


@query(with_tables("deals") + "SELECT ticker, id FROM deals QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY announcement_date, id) = 1")
def dedupe_first(spark, d):
    return ingest.keep_first(table(spark, d, "deals"), ["ticker"], ["announcement_date", "id"]).select("ticker", "id")


@query(with_tables("deals") + "SELECT ticker, arg_max(deal_type, (n, -f)) AS deal_type FROM (SELECT ticker, deal_type, count(*) AS n, min(id) AS f FROM deals GROUP BY 1, 2) GROUP BY 1")
def dominant_type(spark, d):
    return ingest.dominant_key(table(spark, d, "deals"), "ticker", "deal_type", "id")


@query(
    with_tables("deals") + "SELECT id, round((id % 90 - CAST(offer_price AS DOUBLE)) / CAST(offer_price AS DOUBLE) * 100, 4) AS delta_pct FROM deals WHERE offer_price > 0 ORDER BY abs(round((id % 90 - CAST(offer_price AS DOUBLE)) / CAST(offer_price AS DOUBLE) * 100, 4)) DESC, id LIMIT 20"
)
def top_corrections(spark, d):
    rows = table(spark, d, "deals").filter("offer_price > 0").select("id", F.col("offer_price").cast("double").alias("old"), (F.col("id") % 90).cast("double").alias("new"))
    return ingest.top_corrections(rows, "old", "new").select("id", "delta_pct")


@query(
    _PRED + ", k AS (SELECT *, rank() OVER (PARTITION BY juridiction ORDER BY round(p, 6)) + (count(*) OVER (PARTITION BY juridiction, round(p, 6)) - 1) / 2.0 AS rk FROM r) SELECT juridiction, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY 1"
)
def auc_rounded(spark, d):
    rows = _predictions(spark, d).withColumn("p", F.bround("p", 6))
    return metrics.auc_parts(rows, "p", "y", ["juridiction"]).select("juridiction", F.round("auc", 6).alias("auc"))


@query("SELECT 10 AS required, CAST(max(event_id) AS INT) AS validated FROM events WHERE user_id = 7 AND ts = (SELECT max(ts) FROM events WHERE user_id = 7)")
def ramp_up_status(spark, d):
    rows = table(spark, d, "events").selectExpr("CASE WHEN user_id = 7 THEN 'rampup_trades_validated' ELSE concat('k', CAST(user_id AS STRING)) END AS key", "CAST(event_id AS STRING) AS value", "ts AS updated_at")
    return ledger.ramp_up_status(ledger.upsert_state(rows.limit(0), rows))


@query(
    with_tables("deals") + f", s AS (SELECT id FROM deals QUALIFY row_number() OVER (PARTITION BY year(announcement_date) ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id) <= 40), f AS (SELECT o_orderkey AS id, o_orderkey % 9 = 0 AS lost, CASE o_orderkey % 6 WHEN 3 THEN CAST({texts._EUROS} AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN 1000 ELSE {texts._PRICE} END AS price FROM orders) "
    "SELECT id, CASE WHEN NOT lost THEN price END AS price, CASE WHEN lost THEN 'missing_pdf' WHEN price IS NULL THEN 'suspect_low_unverified' ELSE 'verified_cash' END AS flag FROM s JOIN f USING (id)"
)
def bound_validation(spark, d):
    """A sample of 40 deals per year, each with what its filing says."""
    deals = table(spark, d, "deals").withColumn("year", F.year("announcement_date"))
    found = texts._orders(spark, d, text=texts._FR_TEXT).withColumn("text", F.when(F.col("id") % 9 != 0, F.col("text")))
    return quality.validate_bounds(quality.stratified_sample(deals, "year", "id", 40), found).withColumn("price", F.col("price").cast("double"))


_REGISTRY = [("mfe media", 0, "MFEB.MI", "NL0015000MZ1")]


@query(f"SELECT o_orderkey AS deal_id, 0.4 AS share_ratio, {texts._PRICE} AS cash_eur, 'MFEB.MI' AS acquirer_ticker FROM orders WHERE o_orderkey % 5 = 2 AND o_orderkey % 2 = 0")
def consideration_upsert(spark, d):
    rows = texts._orders(spark, d, text=texts._DE_TEXT)
    deals = rows.filter("id % 2 = 0").select("id", F.lit("suspect_mixed").alias("offer_price_quality_flag"))
    good, _ = ingest.populate_consideration(deals, rows, spark.createDataFrame(_REGISTRY, "part string, pos int, ticker string, isin string"))
    return good.select("deal_id", F.col("share_ratio").cast("double").alias("share_ratio"), F.col("cash_eur").cast("double").alias("cash_eur"), "acquirer_ticker")


@query("SELECT o_orderkey AS deal_id, CASE WHEN o_orderkey % 4 = 0 THEN 'no_text' ELSE 'no_share_clause' END AS reason FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 5 <> 2)")
def consideration_rejects(spark, d):
    rows = texts._orders(spark, d, text=texts._DE_TEXT)
    deals = rows.filter("id % 2 = 0").select("id", F.lit("suspect_mixed").alias("offer_price_quality_flag"))
    _, bad = ingest.populate_consideration(deals, rows.filter("id % 4 <> 0"), spark.createDataFrame(_REGISTRY, "part string, pos int, ticker string, isin string"))
    return bad


@query(
    with_tables("deals", "scores", "ticks") + ", daily AS (SELECT ticker, CAST(ts AS DATE) + INTERVAL '-8766' DAY AS d, arg_max(close, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2), s AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY id DESC) = 1), "
    "f AS (SELECT d.*, s.p_completion, s.score_stars, CASE dayofweek(announcement_date) WHEN 0 THEN announcement_date - 2 WHEN 1 THEN announcement_date - 3 ELSE announcement_date - 1 END AS day FROM deals d LEFT JOIN s ON s.deal_id = d.id WHERE announcement_date >= DATE '2000-01-01' AND completion_label IS NULL), "
    "c AS (SELECT f.*, CAST(y.close AS DOUBLE) AS close FROM f LEFT JOIN daily y ON y.ticker = f.ticker AND y.d <= f.day AND date_diff('day', CAST(y.d AS DATE), f.day) <= 5 QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY y.d DESC NULLS LAST) = 1), "
    "r AS (SELECT *, CASE WHEN ticker_resolution_flag IS DISTINCT FROM 'home_venue' THEN 'not_home_venue' WHEN offer_price IS NULL THEN 'no_offer' WHEN score_stars IS NULL THEN 'not_scored' WHEN score_stars < 3 THEN 'low_stars' WHEN close IS NULL THEN 'no_close' WHEN NOT ((offer_price - close) / close BETWEEN -0.5 AND 2.0) THEN 'premium_out_of_bounds' ELSE 'decided' END AS reason FROM c) "
    "SELECT id, reason, CASE WHEN reason = 'decided' THEN CASE WHEN p_completion >= 0.7 THEN 'enter' WHEN p_completion >= 0.5 THEN 'wait' ELSE 'skip' END END AS decision FROM r"
)
def fresh_pool_decisions(spark, d):
    """The ticks' days are moved back 24 years, to the deals' last months."""
    closes = table(spark, d, "ticks").withColumn("ts", F.col("ts") - F.expr("INTERVAL '8766' DAY")).withColumn("close", F.col("close").cast("double"))
    deals = table(spark, d, "deals").withColumn("offer_price", F.col("offer_price").cast("double"))
    return decisions.fresh_pool(deals, table(spark, d, "scores"), closes, date(2000, 1, 1)).select("id", "reason", "decision")


@query()
def version_comparison(spark, d):
    from bidframe.plans.models import _features

    rows = _features(spark, d)
    model = scoring.ScoringModel().fit(scoring.flatten(rows), "v2")
    corrected = table(spark, d, "deals").filter("id % 40 = 1").select("target_name")
    return scoring.version_record(model, rows, scoring.cross_validate(rows), corrected)


@query(with_tables("deals", "scores") + ", s AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY id DESC) = 1) SELECT d.juridiction, count(*) AS n_tradable FROM s JOIN deals d ON d.id = s.deal_id WHERE s.score_stars >= 3 AND d.completion_label IS NULL AND d.offer_price_quality_flag NOT IN ('suspect_mixed', 'failed_validation', 'manual_review') GROUP BY 1")
def tradable_count(spark, d):
    got = views.candidates(table(spark, d, "scores"), table(spark, d, "deals"), 3, latest_only=True)
    return got.groupBy("juridiction").agg(F.count("*").alias("n_tradable"))
