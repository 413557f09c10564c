"""Queries on scored clusters and what is shown beside them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bidframe.operators import clusters, views
from bidframe.plans.registry import ORACLE, query
from bidframe.plans.standin import table, with_tables

_LATEST = "latest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY id DESC) = 1)"
_VIEW = (
    with_tables("deals", "scores") + f", {_LATEST}, view AS (SELECT s.deal_id AS cluster_id, s.id AS score_id, s.ts AS scored_at, s.p_completion, s.score_stars, s.model_version, s.features, d.target_name, d.acquirer_name, d.juridiction, "
    "d.deal_type, d.announcement_date, d.status, d.completion_label, (SELECT count(*) FROM deals e WHERE e.target_name = d.target_name AND e.juridiction = d.juridiction) AS events_count FROM latest s JOIN deals d ON d.id = s.deal_id) "
)
_COLUMNS = ["cluster_id", "target_name", "juridiction", "deal_type", "announcement_date", "completion_label", "p_completion", "score_stars", "model_version", "events_count"]


def _view(spark, d):
    return views.cluster_view(table(spark, d, "scores"), table(spark, d, "deals"))


@query(_VIEW + f"SELECT {', '.join(_COLUMNS)} FROM view")
def cluster_view(spark, d):
    return _view(spark, d).select(*_COLUMNS)


@query(
    _VIEW + f"SELECT {', '.join(_COLUMNS)} FROM view WHERE juridiction IN ('FR', 'DE') AND score_stars IN (3, 4, 5) AND completion_label IS NULL AND announcement_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' "
    "AND coalesce(json_extract_string(features, '$.acquirer_type'), 'unknown') IN ('pe', 'soe') AND deal_type IN ('opa', 'ope', 'opas') ORDER BY announcement_date DESC, cluster_id"
)
def cluster_view_filtered(spark, d):
    f = views.DealFilters(("FR", "DE"), (3, 4, 5), "pending", date(1996, 1, 1), date(1999, 12, 31), ("pe", "soe"), ("opa", "ope", "opas"))
    return views.apply_filters(_view(spark, d), f).select(*_COLUMNS).orderBy(F.desc("announcement_date"), "cluster_id")


@query(_VIEW + "SELECT row_number() OVER (ORDER BY announcement_date DESC NULLS LAST, cluster_id) AS pos, cluster_id, announcement_date FROM view")
def cluster_view_order(spark, d):
    """Each cluster's place in the view."""
    return views.placed(_view(spark, d).select("cluster_id", "announcement_date")).select("pos", "cluster_id", "announcement_date")


@query(_VIEW + f"SELECT {', '.join(_COLUMNS)} FROM view WHERE announcement_date >= DATE '2001-08-01' - INTERVAL 730 DAY AND announcement_date <= DATE '2001-08-01' AND score_stars IN (3, 4, 5)")
def cluster_view_defaults(spark, d):
    return views.apply_filters(_view(spark, d), views.DealFilters().with_defaults(date(2001, 8, 1))).select(*_COLUMNS)


@query(with_tables("scores") + "SELECT deal_id, id, p_completion, score_stars FROM scores QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY id DESC) = 1")
def latest_score_by_id(spark, d):
    return views.latest_score(table(spark, d, "scores")).select("deal_id", "id", "p_completion", "score_stars")


@query(with_tables("scores") + "SELECT deal_id, id, p_completion, score_stars FROM scores QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY ts DESC, id DESC) = 1")
def latest_score_by_time(spark, d):
    return views.latest_score(table(spark, d, "scores"), "ts").select("deal_id", "id", "p_completion", "score_stars")


@query(with_tables("deals") + "SELECT target_name, juridiction, count(*) AS events_count FROM deals GROUP BY ALL")
def sibling_count(spark, d):
    return views.sibling_counts(table(spark, d, "deals"))


@query(with_tables("deals") + "SELECT target_name, juridiction, string_agg(CAST(id AS VARCHAR) || ':' || deal_type, '>' ORDER BY announcement_date, id) AS chain, count(*) AS n FROM deals GROUP BY ALL")
def cluster_detail(spark, d):
    chain = F.array_join(F.transform("siblings", lambda s: F.concat_ws(":", s["id"], s["deal_type"])), ">")
    return views.cluster_detail(table(spark, d, "deals")).select("target_name", "juridiction", chain.alias("chain"), F.size("siblings").cast("bigint").alias("n"))


@query(
    with_tables("deals", "filing_events") + "SELECT k.id AS cluster_id, e.id AS event_id, m.id AS deal_id, e.event_type, m.regulator_ref FROM deals k JOIN deals m ON m.target_name = k.target_name AND m.juridiction = k.juridiction JOIN filing_events e ON e.deal_id = m.id "
    "WHERE k.deal_type = 'opr' AND k.target_name <> '[pending parse]'"
)
def cluster_events(spark, d):
    deals = table(spark, d, "deals")
    keys = deals.filter("deal_type = 'opr' AND target_name <> '[pending parse]'").select(F.col("id").alias("cluster_id"))
    return views.cluster_events(deals, table(spark, d, "filing_events"), keys).select("cluster_id", "event_id", "deal_id", "event_type", "regulator_ref")


@query(_VIEW + "SELECT CAST(date_trunc('month', announcement_date) AS DATE) AS month, count(*) AS n FROM view GROUP BY ALL")
def month_timeline(spark, d):
    return views.timeline(_view(spark, d))


@query(
    _VIEW + "SELECT CASE WHEN p_completion < 0.2 THEN 0.1 WHEN p_completion < 0.4 THEN 0.3 WHEN p_completion < 0.6 THEN 0.5 WHEN p_completion < 0.8 THEN 0.7 ELSE 0.9 END AS bin_mid, "
    "round(avg(CAST(completion_label AS DOUBLE)), 8) AS empirical_rate, count(*) AS n FROM view WHERE completion_label IS NOT NULL AND p_completion BETWEEN 0 AND 1 GROUP BY 1"
)
def calibration_bins(spark, d):
    got = views.calibration_bins(_view(spark, d))
    return got.select(F.col("bin_mid").cast("double").alias("bin_mid"), F.round("empirical_rate", 8).alias("empirical_rate"), "n")


@query(
    _VIEW + "SELECT CAST(least(floor(p_completion * 5), 4) AS INT) AS bin, round(avg(CAST(p_completion AS DOUBLE)), 6) AS mean_p, round(avg(CAST(completion_label AS DOUBLE)), 6) AS rate, count(*) AS n FROM view WHERE completion_label IS NOT NULL GROUP BY 1"
)
def calibration_equal_bins(spark, d):
    return views.equal_bins(_view(spark, d), "p_completion", "completion_label").select("bin", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"), "n")


@query(
    _VIEW + "SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT juridiction AS x FROM view)) AS jurisdictions, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT deal_type AS x FROM view)) AS deal_types, "
    "(SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT json_extract_string(features, '$.acquirer_type') AS x FROM view)) AS acquirer_types"
)
def filter_options(spark, d):
    return views.filter_options(_view(spark, d)).select(*[F.array_join(c, ",").alias(c) for c in ("jurisdictions", "deal_types", "acquirer_types")])


@query(with_tables("scores") + "SELECT max(model_version) AS model_version, count(*) AS n_scores, max(ts) AS last_ts FROM scores")
def model_metadata(spark, d):
    return views.model_metadata(table(spark, d, "scores"))


@query(
    with_tables("positions", "trades") + "SELECT (SELECT count(*) FROM positions WHERE status = 'open') AS open_positions, (SELECT count(*) FROM trades WHERE status = 'FILLED') AS filled, "
    "(SELECT count(*) FROM trades WHERE status = 'SUBMITTED') AS submitted, CAST((SELECT coalesce(sum(pnl_realized), 0) FROM trades) AS DOUBLE) AS realized_pnl_eur"
)
def trading_kpis(spark, d):
    return views.trading_kpis(table(spark, d, "positions"), table(spark, d, "trades")).withColumn("realized_pnl_eur", F.col("realized_pnl_eur").cast("double"))


@query(
    with_tables("positions") + "SELECT CAST(close_ts AS DATE) AS day, CAST(sum(pnl_eur) AS DOUBLE) AS realized, CAST(sum(sum(pnl_eur)) OVER (ORDER BY CAST(close_ts AS DATE)) AS DOUBLE) AS cumulative FROM positions WHERE status = 'closed' AND close_ts IS NOT NULL GROUP BY 1"
)
def cum_pnl(spark, d):
    return views.daily_pnl(table(spark, d, "positions")).select("day", F.col("realized").cast("double").alias("realized"), F.col("cumulative").cast("double").alias("cumulative"))


@query(with_tables("vendor_usage") + "SELECT vendor, year_month, CAST(coalesce(sum(credits_cost), 0) AS BIGINT) AS credits FROM vendor_usage GROUP BY ALL")
def credits_used(spark, d):
    return views.credits_used(table(spark, d, "vendor_usage"))


@query(_VIEW + "SELECT juridiction, " + ", ".join(f"count(*) FILTER (score_stars = {k}) AS stars_{k}" for k in range(1, 6)) + " FROM view GROUP BY 1")
def stars_pivot(spark, d):
    return views.stars_pivot(_view(spark, d))


@query(_VIEW + "SELECT CAST(floor(p_completion / 0.05) AS INT) AS bin, juridiction, count(*) AS n FROM view GROUP BY ALL")
def score_histogram(spark, d):
    return views.score_histogram(_view(spark, d))


@query(
    with_tables("deals") + "SELECT count(*) FILTER (completion_label = 1) AS closed, count(*) FILTER (completion_label = 0) AS failed, count(*) FILTER (completion_label IS NULL) AS pending, "
    "round(count(*) FILTER (completion_label = 1) / nullif(count(*) FILTER (completion_label = 0), 0), 6) AS imbalance FROM deals"
)
def class_balance(spark, d):
    return views.class_balance(table(spark, d, "deals"))


@query(_VIEW + "SELECT count(*) AS total, round(CAST(sum(p_completion) AS DOUBLE) / count(*), 6) AS mean_p, (SELECT string_agg(juridiction || '=' || n, ',' ORDER BY juridiction) FROM (SELECT juridiction, count(*) AS n FROM view GROUP BY 1)) AS by_jurisdiction FROM view")
def overview_metrics(spark, d):
    pairs = F.transform(F.array_sort(F.map_entries("by_jurisdiction")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return views.overview(_view(spark, d)).withColumn("by_jurisdiction", F.array_join(pairs, ","))


@query(_VIEW + "SELECT CAST(k AS INT) AS score_stars, (SELECT count(*) FROM view WHERE score_stars = k) AS n FROM range(1, 6) t(k)")
def star_distribution(spark, d):
    return views.star_distribution(_view(spark, d))


@query(_VIEW + "SELECT cluster_id, target_name, p_completion FROM view WHERE completion_label IS NULL AND p_completion >= 0.85 ORDER BY p_completion DESC, cluster_id LIMIT 5")
def top_pending(spark, d):
    where = F.col("completion_label").isNull() & (F.col("p_completion") >= 0.85)
    return views.top_by(_view(spark, d), "p_completion", 5, where=where).select("cluster_id", "target_name", "p_completion")


@query(_VIEW + "SELECT cluster_id, target_name, p_completion FROM view WHERE completion_label IS NULL AND p_completion <= 0.60 ORDER BY p_completion, cluster_id LIMIT 5")
def bottom_watchlist(spark, d):
    where = F.col("completion_label").isNull() & (F.col("p_completion") <= 0.60)
    return views.top_by(_view(spark, d), "p_completion", 5, descending=False, where=where).select("cluster_id", "target_name", "p_completion")


@query(_VIEW + "SELECT cluster_id, announcement_date FROM view WHERE announcement_date >= (SELECT max(announcement_date) FROM view) - 7 ORDER BY announcement_date DESC, cluster_id LIMIT 10")
def last_week(spark, d):
    view = _view(spark, d)
    newest = view.agg(F.date_sub(F.max("announcement_date"), 7).alias("since"))
    got = view.join(newest, F.col("announcement_date") >= F.col("since"))
    return views.top_by(got, "announcement_date", 10).select("cluster_id", "announcement_date")


@query(_VIEW + "SELECT cluster_id, p_completion FROM view WHERE score_stars = 5 ORDER BY p_completion DESC, cluster_id LIMIT 5 OFFSET 3")
def watchlist_slice(spark, d):
    return views.top_by(_view(spark, d), "p_completion", 5, where=F.col("score_stars") == 5, skip=3).select("cluster_id", "p_completion")


@query(_VIEW + "SELECT * FROM (SELECT 'high' AS side, cluster_id, p_completion FROM view ORDER BY p_completion DESC, cluster_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'low' AS side, cluster_id, p_completion FROM view ORDER BY p_completion, cluster_id LIMIT 10)")
def top_and_bottom(spark, d):
    view = _view(spark, d)
    sides = [views.top_by(view, "p_completion", 10, x == "high").select(F.lit(x).alias("side"), "cluster_id", "p_completion") for x in ("high", "low")]
    return sides[0].unionByName(sides[1])


@query(with_tables("positions", "deals") + "SELECT p.id, p.deal_id, CAST(p.size_eur AS DOUBLE) AS size_eur, d.target_name FROM positions p LEFT JOIN deals d ON d.id = p.deal_id WHERE p.status = 'open'")
def open_positions(spark, d):
    return views.open_positions(table(spark, d, "positions"), table(spark, d, "deals")).select("id", "deal_id", F.col("size_eur").cast("double").alias("size_eur"), "target_name")


@query(with_tables("trades", "deals") + "SELECT t.trade_id, t.status, d.target_name FROM (SELECT * FROM trades ORDER BY created_at DESC, trade_id LIMIT 50) t LEFT JOIN deals d ON d.id = t.deal_id")
def recent_trades(spark, d):
    return views.recent_trades(table(spark, d, "trades"), table(spark, d, "deals")).select("trade_id", "status", "target_name")


_TRADABLE = "completion_label IS NULL AND offer_price_quality_flag NOT IN ('suspect_mixed', 'failed_validation', 'manual_review') AND juridiction IN ('DE', 'FR') AND (juridiction <> 'FR' OR ticker_resolution_flag = 'home_venue')"


@query(with_tables("deals", "scores") + f"SELECT s.id AS score_id, s.deal_id, s.score_stars, CAST(d.offer_price AS DOUBLE) AS offer_price FROM scores s JOIN deals d ON d.id = s.deal_id WHERE s.score_stars >= 3 AND {_TRADABLE}")
def candidate_load(spark, d):
    got = views.candidates(table(spark, d, "scores"), table(spark, d, "deals"), 3, ("DE", "FR"), ("FR",))
    return got.select("score_id", "deal_id", "score_stars", F.col("offer_price").cast("double").alias("offer_price"))


@query(with_tables("deals", "scores") + f", {_LATEST} SELECT s.id AS score_id, s.deal_id, s.score_stars FROM latest s JOIN deals d ON d.id = s.deal_id WHERE s.score_stars >= 3 AND {_TRADABLE}")
def candidate_load_latest(spark, d):
    return views.candidates(table(spark, d, "scores"), table(spark, d, "deals"), 3, ("DE", "FR"), ("FR",), latest_only=True).select("score_id", "deal_id", "score_stars")


@query(with_tables("deals", "filing_events") + "SELECT d.id, count(e.id) AS n_events FROM deals d LEFT JOIN filing_events e ON e.deal_id = d.id GROUP BY 1")
def deal_event_counts(spark, d):
    return views.deals_with_event_count(table(spark, d, "deals"), table(spark, d, "filing_events")).select("id", "n_events")


@query(
    _VIEW + ", wanted AS (SELECT * FROM (VALUES ('FR', 'Target 1'), ('IT', 'get 22'), ('DE', 'nobody')) w(juridiction, part)) SELECT w.juridiction, w.part, min(v.cluster_id) AS cluster_id FROM wanted w LEFT JOIN view v ON v.juridiction = w.juridiction AND contains(v.target_name, w.part) GROUP BY 1, 2"
)
def sanity_lookup(spark, d):
    wanted = spark.createDataFrame([("FR", "Target 1"), ("IT", "get 22"), ("DE", "nobody")], "juridiction string, part string")
    return views.first_by_name(_view(spark, d), wanted).select("juridiction", "part", "cluster_id")


_FIRST = "first_value({c}) OVER w"
_CLUSTER_SQL = (
    with_tables("deals") + ", k AS (SELECT *, row_number() OVER (PARTITION BY target_name, juridiction ORDER BY announcement_date, id) AS rn FROM deals WHERE target_name <> '[pending parse]'), "
    "g AS (SELECT target_name, juridiction, count(*) AS n, max(expected_close_date) AS ec, min(announcement_date) AS first_day, arg_min(id, rn) AS rep, arg_min(deal_type, rn) AS deal_type, "
    "coalesce(arg_min(acquirer_name, rn) FILTER (acquirer_name <> '[pending parse]'), arg_min(acquirer_name, rn)) AS acq, arg_min(premium_pct, rn) FILTER (premium_pct IS NOT NULL) AS prem, "
    "arg_min(min_acceptance_threshold, rn) FILTER (min_acceptance_threshold IS NOT NULL) AS mat, arg_min(completion_label, rn) FILTER (completion_label IS NOT NULL) AS label FROM k GROUP BY 1, 2) "
)


@query(
    _CLUSTER_SQL + "SELECT target_name, juridiction, rep AS representative_deal_id, first_day AS earliest_announcement, CASE WHEN prem IS NULL THEN NULL ELSE round(greatest(least(CAST(prem AS DOUBLE) * 100, 500.0), -50.0), 6) END AS bid_premium_pct, "
    "round(CAST(mat AS DOUBLE), 6) AS min_acceptance_threshold, CASE WHEN ec IS NULL THEN NULL ELSE CAST(greatest(least(date_diff('day', first_day, ec), 730), 0) AS DOUBLE) END AS days_to_expected_close, CAST(n AS DOUBLE) AS events_count, deal_type, "
    "CASE WHEN deal_type IN ('ope', 'opas') THEN 'stock' ELSE 'cash' END AS payment_type, CASE WHEN lower(acq) LIKE '%qatar%' THEN 'soe' WHEN lower(acq) LIKE '%holding%' THEN 'pe' WHEN lower(acq) LIKE '% gmbh' OR lower(acq) LIKE '% se%' AND lower(acq) LIKE '% se %' THEN 'corporate' "
    "WHEN lower(acq) LIKE 'maison%' OR acq = '[pending parse]' THEN 'family' ELSE 'unknown' END AS acquirer_type, lower(acq) LIKE '%qatar%' AS cross_border, lower(acq) LIKE '%qatar%' AS fdi_risk_flag, label FROM g"
)
def cluster_features(spark, d):
    got = clusters.cluster_features(table(spark, d, "deals"))
    return got.withColumns({c: F.round(c, 6) for c in ("bid_premium_pct", "min_acceptance_threshold")}).drop("relative_size", "target_sector", "has_irrevocable_undertaking")


@query(
    with_tables("deals") + ", f AS (SELECT *, CASE WHEN date_diff('day', lag(announcement_date) OVER w, announcement_date) >= 730 THEN 1 ELSE 0 END AS opens FROM deals WHERE juridiction = 'FR' AND target_name <> '[pending parse]' WINDOW w AS (PARTITION BY target_name ORDER BY announcement_date, id)), "
    "p AS (SELECT * EXCLUDE (opens), CAST(sum(opens) OVER (PARTITION BY target_name ORDER BY announcement_date, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM f UNION ALL SELECT *, id AS part FROM deals WHERE juridiction <> 'FR' OR target_name = '[pending parse]'), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY juridiction, target_name, part ORDER BY announcement_date, id) AS rn FROM p) "
    "SELECT juridiction, target_name, min(announcement_date) AS first_date, max(announcement_date) AS last_date, count(*) AS n_filings, coalesce(arg_min(acquirer_name, rn) FILTER (acquirer_name <> '[pending parse]'), arg_min(acquirer_name, rn)) AS acquirer_name, "
    "arg_min(deal_type, rn) AS deal_type, max(expected_close_date) AS expected_close_date, CAST(arg_min(offer_price, rn) FILTER (offer_price IS NOT NULL) AS DOUBLE) AS offer_price, string_agg(CAST(id AS VARCHAR), '_' ORDER BY rn) AS id_cluster FROM r GROUP BY juridiction, target_name, part"
)
def fr_chain_collapse(spark, d):
    return clusters.collapse_chains(table(spark, d, "deals")).withColumn("offer_price", F.col("offer_price").cast("double"))


@query(
    with_tables("deals") + "SELECT target_name, juridiction, id FROM deals WHERE target_name <> '[pending parse]' QUALIFY row_number() OVER (PARTITION BY target_name, juridiction ORDER BY coalesce(ticker_resolution_flag = 'home_venue', false) DESC, offer_price IS NOT NULL DESC, announcement_date DESC, id) = 1"
)
def decision_deal(spark, d):
    return clusters.decision_deal(table(spark, d, "deals")).select("target_name", "juridiction", "id")


@query(
    "SELECT juridiction, count(*) AS n_rows, count(*) FILTER (contains(lower(target_name), 'target 12') OR (juridiction = 'IT' AND target_name = 'Target 1')) AS n_flagged, count(*) FILTER (n_filings >= 4) AS n_prelabelled "
    f"FROM ({ORACLE['fr_chain_collapse']}) GROUP BY 1"
)
def collapse_summary(spark, d):
    rows = clusters.collapse_chains(table(spark, d, "deals"))
    pairs = spark.createDataFrame([("IT", "Target 1")], "juridiction string, target_name string")
    return clusters.collapse_summary(clusters.candidate_failures(rows, pairs, ["Target 12"]))
