"""Queries on merges of filings, signals, labels and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import ingest
from bidframe.plans.registry import query
from bidframe.plans.standin import table, with_tables

#: Stored deals: three of four orders. Landed filings: two of three orders, each one to four times, with other terms every time.
_STORED_MORE = ["CASE WHEN id % 5 = 0 THEN NULL ELSE '/old.pdf' END AS pdf_path", "CAST(1 AS INT) AS parser_version", "CASE WHEN id % 2 = 0 THEN NULL ELSE 'GBP' END AS currency"]
_LANDED = [
    "id * 4 + k AS pos", "juridiction", "regulator_ref", "CASE WHEN id % 8 = 3 THEN NULL ELSE target_name END AS target_name", "CAST(NULL AS VARCHAR(9)) AS acquirer_name", "CASE WHEN id % 8 = 7 THEN NULL ELSE announcement_date END AS announcement_date",
    "CASE WHEN id % 16 = 3 THEN NULL ELSE deal_type END AS deal_type", "expected_close_date", "isin", "CASE (id + k) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'USD' ELSE 'CHF' END AS currency", "CASE WHEN (id + k) % 7 = 0 THEN NULL ELSE CAST(id % 50 + k AS DECIMAL(18,6)) END AS offer_price",
    "CASE (id + k) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'verified_cash' WHEN 2 THEN 'failed_validation' ELSE 'suspect_low_unverified' END AS offer_price_quality_flag", "CASE WHEN (id + k) % 2 = 0 THEN NULL ELSE concat('/new', CAST(k AS VARCHAR(9)), '.pdf') END AS pdf_path",
    "CASE WHEN (id + k) % 4 = 0 THEN NULL ELSE CAST(2 + k AS INT) END AS parser_version",
]


def _stored_and_landed(spark, d):
    deals = table(spark, d, "deals")
    stored = deals.filter("id % 4 < 3").selectExpr("*", *_STORED_MORE)
    return stored, deals.filter("id % 3 < 2").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")))).selectExpr(*_LANDED)


#: The filings one after the other: step n takes each key's n-th filing. Step 0 is the stored deals; a new key's first filing inserts.
_UPSERT = (
    with_tables("deals").replace("WITH ", "WITH RECURSIVE ", 1)
    + f", s AS (SELECT *, {', '.join(_STORED_MORE)} FROM deals WHERE id % 4 < 3), l AS (SELECT {', '.join(_LANDED)} FROM deals, range(0, id % 4 + 1) r(k) WHERE id % 3 < 2), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY juridiction, regulator_ref ORDER BY pos) AS n FROM l), "
    "first_of AS (SELECT n.*, (SELECT max(id) FROM s) + row_number() OVER (ORDER BY concat(juridiction, ' ', regulator_ref)) AS new_id FROM n WHERE n.n = 1 AND (juridiction, regulator_ref) NOT IN (SELECT (juridiction, regulator_ref) FROM s)), "
    "begun AS (SELECT id, juridiction, regulator_ref, target_name, acquirer_name, announcement_date, deal_type, status, offer_price, offer_price_quality_flag, completion_label, premium_pct, min_acceptance_threshold, expected_close_date, isin, ticker, ticker_resolution_flag, pdf_path, parser_version, currency, 0 AS step FROM s "
    "UNION ALL SELECT new_id, juridiction, regulator_ref, coalesce(target_name, '[pending parse]'), coalesce(acquirer_name, '[pending parse]'), coalesce(announcement_date, DATE '2026-01-15'), coalesce(deal_type, 'opa'), 'announced', offer_price, coalesce(offer_price_quality_flag, 'suspect_low_unverified'), "
    "NULL, NULL, NULL, expected_close_date, isin, NULL, NULL, pdf_path, coalesce(parser_version, 1), coalesce(currency, 'EUR'), 1 FROM first_of), "
    "f AS (SELECT * FROM begun UNION ALL SELECT f.id, f.juridiction, f.regulator_ref, f.target_name, f.acquirer_name, f.announcement_date, f.deal_type, f.status, CASE WHEN o THEN n.offer_price ELSE f.offer_price END, CASE WHEN o THEN n.offer_price_quality_flag ELSE f.offer_price_quality_flag END, f.completion_label, f.premium_pct, "
    "f.min_acceptance_threshold, f.expected_close_date, f.isin, f.ticker, f.ticker_resolution_flag, coalesce(f.pdf_path, n.pdf_path), CASE WHEN o THEN coalesce(n.parser_version, f.parser_version) ELSE f.parser_version END, CASE WHEN o THEN coalesce(n.currency, f.currency, 'EUR') ELSE f.currency END, f.step + 1 "
    "FROM (SELECT f.*, f.offer_price_quality_flag = 'suspect_low_unverified' AS is_open FROM f) f JOIN (SELECT *, offer_price_quality_flag IS NOT NULL AS has_terms FROM n) n ON n.juridiction = f.juridiction AND n.regulator_ref = f.regulator_ref AND n.n = f.step + 1, LATERAL (SELECT is_open AND has_terms AS o)) "
)


@query(_UPSERT + "SELECT * EXCLUDE (step) FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1")
def dedupe_upsert(spark, d):
    return ingest.upsert_filings(*_stored_and_landed(spark, d), today="2026-01-15", order="pos")[0]


@query(_UPSERT + "SELECT juridiction, regulator_ref, 'filing' AS event_type, announcement_date AS day FROM begun WHERE step = 1")
def upsert_events(spark, d):
    return ingest.upsert_filings(*_stored_and_landed(spark, d), today="2026-01-15", order="pos")[1]


_SIGNALS = "SELECT o_orderkey AS sid, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'REF-none' ELSE concat('REF-', CAST(o_custkey % 200 AS VARCHAR(20))) END AS regulator_ref, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('https://feed.example/', CAST(o_orderkey % 600 AS VARCHAR(20))) END AS link FROM orders"
#: Every event that is stored or that a signal would make has a place in time, the stored ones first; a signal is a duplicate if one with its deal and link stands before it.
_OUTCOMES = (
    with_tables("deals", "filing_events") + f", s AS ({_SIGNALS}), p AS (SELECT s.sid, s.regulator_ref, s.link, d.id AS deal_id FROM s LEFT JOIN deals d ON d.regulator_ref = s.regulator_ref AND d.juridiction = 'FR'), "
    "e AS (SELECT deal_id, source_url AS link, -1 AS at FROM filing_events WHERE event_type = 'click' UNION ALL SELECT deal_id, link, sid FROM p WHERE deal_id IS NOT NULL), "
    "m AS (SELECT sid, deal_id, CASE WHEN regulator_ref IS NULL THEN 'no_ref' WHEN deal_id IS NULL THEN 'unmatched' WHEN EXISTS (SELECT 1 FROM e WHERE e.deal_id = p.deal_id AND e.link = p.link AND e.at < p.sid) THEN 'duplicate' ELSE 'created' END AS outcome FROM p) "
)


def _matched(spark, d):
    from bidframe.plans.pricing import _split

    signals = table(spark, d, "orders").selectExpr(*[x.strip() for x in _split(_SIGNALS)])
    return ingest.match_signals(signals, table(spark, d, "deals"), table(spark, d, "filing_events"), "click", "sid")


@query(_OUTCOMES + "SELECT sid, deal_id, outcome FROM m")
def event_signal_match(spark, d):
    return _matched(spark, d).select("sid", "deal_id", "outcome")


@query(_OUTCOMES + "SELECT count(*) AS discovered, " + ", ".join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in ("created", "duplicate", "unmatched", "no_ref")) + " FROM m")
def run_counters(spark, d):
    return ingest.run_counters(_matched(spark, d))


@query(
    "WITH f AS (SELECT event_type AS feed, event_id AS key, ts, event_id % 97 = 50 AS known FROM events) SELECT feed, key FROM f QUALIFY coalesce(max(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY ts, key ROWS UNBOUNDED PRECEDING), 0) = 0"
)
def stop_at_known(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("feed"), F.col("event_id").alias("key"), "ts")
    return ingest.before_first_known(rows, rows.filter("key % 97 = 50"), ["feed"], ["ts", "key"], "key").select("feed", "key")


_LABELS = (
    "SELECT o_orderkey AS line, concat(CAST(o_orderkey AS VARCHAR(20)), '_', CAST(o_orderkey + 3 AS VARCHAR(20)), '_x', CASE WHEN o_orderkey % 50 = 0 THEN '_999999999999' ELSE '' END) AS id_cluster, CASE o_orderkey % 5 WHEN 0 THEN ' 1' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE '?' END AS label_y, "
    "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE concat('https://s.example/', CAST(o_orderkey % 9 AS VARCHAR(20))) END AS label_source, CASE WHEN o_orderkey % 3 = 0 THEN ' seen in the press ' WHEN o_orderkey % 3 = 1 THEN '' END AS label_notes FROM orders"
)
_OLD_SOURCE = "CASE WHEN id % 2 = 0 THEN 'earlier' END"


def _labels(spark, d):
    from bidframe.plans.pricing import _split

    rows = table(spark, d, "orders").selectExpr(*[x.strip() for x in _split(_LABELS)])
    return ingest.apply_labels(table(spark, d, "deals").withColumn("label_source", F.expr(_OLD_SOURCE)), rows, "2026-01-31")


_LAST_LABEL = (
    f", l AS ({_LABELS}), x AS (SELECT line, CAST(i AS BIGINT) AS id, CAST(trim(label_y) AS INT) AS y, trim(coalesce(label_source, '')) AS s, trim(coalesce(label_notes, '')) AS n FROM (SELECT *, unnest(string_split(id_cluster, '_')) AS i FROM l) WHERE regexp_full_match(i, '\\d+') AND trim(label_y) IN ('0', '1')), "
    "z AS (SELECT id, y, CASE WHEN s <> '' AND n <> '' THEN s || ' | ' || n WHEN n <> '' THEN n WHEN s <> '' THEN s END AS said FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY line DESC) = 1)"
)


@query(
    with_tables("deals") + _LAST_LABEL + f" SELECT d.id, CASE WHEN z.id IS NOT NULL THEN z.y ELSE d.completion_label END AS completion_label, CASE WHEN z.id IS NOT NULL THEN z.said ELSE {_OLD_SOURCE.replace('id', 'd.id')} END AS label_source, CASE WHEN z.id IS NOT NULL THEN DATE '2026-01-31' END AS label_date FROM deals d LEFT JOIN z ON z.id = d.id"
)
def label_import(spark, d):
    return _labels(spark, d)[0].select("id", "completion_label", "label_source", "label_date")


@query(with_tables("deals") + _LAST_LABEL + " SELECT id FROM z WHERE id NOT IN (SELECT id FROM deals)")
def label_import_unknown(spark, d):
    return _labels(spark, d)[1]


@query(
    with_tables("deals") + ", c AS (SELECT id, CASE WHEN id % 3 = 0 THEN offer_price + 1 ELSE offer_price END AS old_price, CAST(42 AS DECIMAL(18,6)) AS new_price FROM deals WHERE id % 4 = 1) SELECT c.id, CASE WHEN d.offer_price_quality_flag <> 'verified_cash' THEN 'skipped_flag' WHEN d.offer_price IS DISTINCT FROM c.old_price THEN 'skipped_price' ELSE 'applied' END AS status FROM c JOIN deals d USING (id)"
)
def drift_guarded_update(spark, d):
    deals = table(spark, d, "deals")
    changes = deals.filter("id % 4 = 1").selectExpr("id", "CASE WHEN id % 3 = 0 THEN offer_price + 1 ELSE offer_price END AS old_price", "CAST(42 AS DECIMAL(18,6)) AS new_price")
    return ingest.apply_corrections(deals, changes).select("id", "status")


@query(with_tables("deals", "scores") + "SELECT id, deal_id FROM scores WHERE deal_id NOT IN (SELECT id FROM deals WHERE id % 6 = 0)")
def score_invalidation(spark, d):
    changed = table(spark, d, "deals").filter("id % 6 = 0").select(F.col("id").alias("deal_id"))
    return ingest.invalidate_scores(table(spark, d, "scores"), changed)[0].select("id", "deal_id")


@query(
    with_tables("deals", "scores", "filing_events") + ", g AS (SELECT id FROM deals WHERE regulator_ref LIKE 'REF-1%') SELECT 'deals' AS table_name, (SELECT count(*) FROM deals) AS before, (SELECT count(*) FROM g) AS deleted, 0 AS left_over UNION ALL SELECT 'events', (SELECT count(*) FROM filing_events), (SELECT count(*) FROM filing_events WHERE deal_id IN (SELECT id FROM g)), 0 "
    "UNION ALL SELECT 'scores', (SELECT count(*) FROM scores), (SELECT count(*) FROM scores WHERE deal_id IN (SELECT id FROM g)), 0"
)
def cascade_delete(spark, d):
    children = {"events": table(spark, d, "filing_events"), "scores": table(spark, d, "scores")}
    return ingest.cascade_delete(table(spark, d, "deals"), children, "REF-1%")[2].select("table_name", "before", "deleted", "left_over")


@query(with_tables("deals") + "SELECT id FROM deals d WHERE completion_label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM deals e WHERE e.target_name = d.target_name AND e.juridiction = d.juridiction AND e.offer_price_quality_flag = 'manual_review' AND e.completion_label IS NOT NULL)")
def excluded_clusters(spark, d):
    deals = table(spark, d, "deals")
    return deals.filter("completion_label IS NOT NULL").join(ingest.excluded_clusters(deals), ["target_name", "juridiction"], "left_anti").select("id")


@query(
    with_tables("deals") + ", p AS (SELECT id, date_diff('day', announcement_date, DATE '1998-06-01') AS days_open, date_diff('day', announcement_date, DATE '1998-06-01') - CASE juridiction WHEN 'FR' THEN 60 WHEN 'IT' THEN 75 ELSE 90 END AS past_close FROM deals) "
    "SELECT id, CAST(days_open AS INT) AS days_open, CAST(past_close AS INT) AS past_close, CASE WHEN past_close > 90 THEN 'likely 1 if no failure news' WHEN past_close >= 0 THEN 'verify' ELSE 'likely pending NULL' END AS label_guess FROM p"
)
def days_open(spark, d):
    return ingest.days_open(table(spark, d, "deals"), "1998-06-01").select("id", "days_open", "past_close", "label_guess")


@query(with_tables("deals") + "SELECT DISTINCT target_name, juridiction FROM deals WHERE target_name <> '[pending parse]'")
def cluster_keys(spark, d):
    return table(spark, d, "deals").filter("target_name <> '[pending parse]'").select("target_name", "juridiction").distinct()


