"""Queries on decisions, order legs and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import decisions, ledger, views
from bidframe.plans.registry import query
from bidframe.plans.standin import table, with_tables

_CAND_COLS = [
    "l.id AS deal_id", "d.juridiction", "CAST(d.offer_price AS DOUBLE) AS offer_price", "CAST(l.p_completion AS DOUBLE) AS p_completion", "l.score_stars",
    "CASE WHEN d.juridiction = 'IT' OR d.id % 13 = 0 THEN NULL ELSE CAST(d.offer_price AS DOUBLE) * 0.95 END AS bid", "CASE WHEN d.juridiction = 'IT' OR d.id % 13 = 0 THEN NULL ELSE CAST(d.offer_price AS DOUBLE) * 0.96 END AS ask",
    "CASE WHEN d.id % 11 = 0 THEN NULL ELSE CAST(d.offer_price AS DOUBLE) * (0.85 + (d.id % 16) / 100.0) END AS last", "CAST(40000 + d.id % 5000 * 100 AS DOUBLE) AS net_liquidation", "CAST(d.id % 7 AS INT) AS open_positions", "CAST(d.id % 15 AS INT) AS rampup_validated",
]
_CAND = with_tables("deals", "scores") + ", l AS (SELECT deal_id AS id, p_completion, score_stars FROM scores QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY id DESC) = 1), c AS (SELECT " + ", ".join(_CAND_COLS) + " FROM l JOIN deals d ON d.id = l.id)"


def _candidates(spark, d):
    last = views.latest_score(table(spark, d, "scores")).select(F.col("deal_id").alias("id"), "p_completion", "score_stars").alias("l")
    return last.join(table(spark, d, "deals").alias("d"), F.col("l.id") == F.col("d.id")).selectExpr(*_CAND_COLS)


_SIZED = (
    _CAND + ", r AS (SELECT *, CASE WHEN juridiction = 'IT' THEN coalesce(nullif(last, 0), (bid + ask) / 2) ELSE coalesce(nullif((bid + ask) / 2, 0), last) END AS ref FROM c), "
    "s AS (SELECT *, (offer_price - ref) / ref AS spread, ref * (1.0 + CASE WHEN juridiction = 'IT' THEN 0.004 ELSE 0.001 END) AS lim FROM r), "
    "k AS (SELECT *, CASE WHEN spread > 0 THEN (p_completion * spread - (1.0 - p_completion) * 0.15) / spread ELSE 0.0 END AS raw, greatest(least(net_liquidation, 2000000.0), 50000.0) AS cap FROM s), "
    "f AS (SELECT *, CASE WHEN spread IS NULL THEN 0.0 ELSE greatest(0.0, least(0.12, raw * 0.15)) END AS pct FROM k), q AS (SELECT *, pct * cap AS eur, floor(pct * cap / lim) AS qty FROM f), "
    "z AS (SELECT *, CASE WHEN open_positions >= 5 THEN 'position_cap' WHEN lim <= 0 THEN 'bad_price' WHEN pct <= 0 THEN 'no_edge' WHEN eur < 1000 OR qty < 1 THEN 'below_min' ELSE 'ok' END AS sizing FROM q), "
    "o AS (SELECT *, CASE WHEN score_stars < 3 THEN 'low_stars' WHEN offer_price IS NULL OR offer_price <= 0 THEN 'no_offer' WHEN ref IS NULL OR ref <= 0 THEN 'no_price' WHEN spread < 0.01 THEN 'thin_spread' ELSE sizing END AS reason FROM z) "
)


@query(_SIZED + "SELECT deal_id, sizing AS reason, CASE WHEN sizing = 'ok' THEN CAST(qty AS BIGINT) ELSE 0 END AS size_qty, round(CASE WHEN sizing IN ('ok', 'below_min') THEN pct ELSE 0 END, 6) AS position_pct FROM o WHERE offer_price > 0 AND ref > 0")
def kelly_sizing(spark, d):
    rows = _candidates(spark, d).withColumn("ref", decisions.reference_price(F.col("bid"), F.col("ask"), F.col("last"), F.col("juridiction"))).filter("offer_price > 0 AND ref > 0")
    spread = (F.col("offer_price") - F.col("ref")) / F.col("ref")
    s = decisions.size_position(F.col("p_completion"), spread, decisions.entry_limit(F.col("ref"), F.col("juridiction")), F.col("net_liquidation"), F.col("open_positions"))
    return rows.withColumn("s", s).select("deal_id", F.col("s.reason").alias("reason"), F.col("s.size_qty").alias("size_qty"), F.round("s.position_pct", 6).alias("position_pct"))


#: Prices have 6 digits; rounded to 4, half to even, in whole millionths.
_FOUR = "(CAST(round({x} * 1000000) AS BIGINT) // 100 + CASE WHEN CAST(round({x} * 1000000) AS BIGINT) % 100 > 50 OR (CAST(round({x} * 1000000) AS BIGINT) % 100 = 50 AND CAST(round({x} * 1000000) AS BIGINT) // 100 % 2 = 1) THEN 1 ELSE 0 END) / 10000.0"


@query(
    _SIZED + "SELECT deal_id, juridiction, score_stars, reason, CASE WHEN reason = 'ok' THEN CAST(qty AS BIGINT) END AS quantity, CASE WHEN reason = 'ok' THEN round_even(lim, 4) END AS limit_price, CASE WHEN reason = 'ok' THEN round_even(lim * 0.9, 4) END AS stop_loss_price, "
    f"CASE WHEN reason = 'ok' THEN {_FOUR.format(x='offer_price')} END AS take_profit_price, round_even(spread, 6) AS expected_return_pct, CASE WHEN reason = 'ok' THEN rampup_validated < 10 END AS requires_approval, "
    "CASE WHEN reason = 'ok' THEN format('p={:.2f}, spread={:.1f}%, {}@{:.2f}', p_completion, spread * 100, CAST(qty AS BIGINT), lim) END AS rationale FROM o"
)
def trade_decisions(spark, d):
    return decisions.decide(_candidates(spark, d)).drop("kelly_fractional_pct", "position_pct")


@query(_SIZED + "SELECT reason, count(*) AS n FROM o GROUP BY 1")
def decision_reasons(spark, d):
    return decisions.decide(_candidates(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


_TICK = "round(round_even({x} / 0.01, 0) * 0.01, 4)"
_BRACKETS = "SELECT l_orderkey * 8 + l_linenumber AS parent_id, CAST(l_quantity AS BIGINT) - 3 AS quantity, l_extendedprice / 1000 AS limit_price, l_extendedprice / 1000 * (0.85 + l_tax * 2) AS stop_loss_price, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_extendedprice / 1000 * (0.98 + l_discount) END AS take_profit_price FROM lineitem"


@query(
    f"WITH b AS ({_BRACKETS}), t AS (SELECT *, {_TICK.format(x='limit_price')} AS e, {_TICK.format(x='stop_loss_price')} AS s, {_TICK.format(x='take_profit_price')} AS p FROM b), g AS (SELECT * FROM t WHERE quantity > 0 AND limit_price > 0 AND s > 0 AND s < e AND (p IS NULL OR p > e)) "
    "SELECT parent_id AS order_id, CAST(0 AS BIGINT) AS parent, 'BUY' AS action, 'LMT' AS order_type, e AS \"limit\", CAST(NULL AS DOUBLE) AS stop, false AS transmit, quantity FROM g "
    "UNION ALL SELECT parent_id + 1, parent_id, 'SELL', 'STP', NULL, s, p IS NULL, quantity FROM g UNION ALL SELECT parent_id + 2, parent_id, 'SELL', 'LMT', p, NULL, true, quantity FROM g WHERE p IS NOT NULL"
)
def order_legs(spark, d):
    from bidframe.plans.pricing import _split

    return decisions.order_legs(table(spark, d, "lineitem").selectExpr(*[x.strip() for x in _split(_BRACKETS)]))


@query(
    with_tables("scores") + "SELECT id, CASE WHEN p_completion < 0.3 THEN 1 WHEN p_completion < 0.5 THEN 2 WHEN p_completion < 0.7 THEN 3 WHEN p_completion < 0.85 THEN 4 ELSE 5 END AS stars, CASE WHEN p_completion >= 0.7 THEN 'enter' WHEN p_completion >= 0.5 THEN 'wait' ELSE 'skip' END AS call, "
    "repeat('★', score_stars) || repeat('☆', 5 - score_stars) AS badge FROM scores"
)
def stars_and_calls(spark, d):
    p = F.col("p_completion")
    return table(spark, d, "scores").select("id", decisions.stars(p).alias("stars"), decisions.call(p).alias("call"), decisions.star_badge(F.col("score_stars")).alias("badge"))


@query(with_tables("deals") + "SELECT id, CASE completion_label WHEN 1 THEN 'closed' WHEN 0 THEN 'failed' ELSE status END AS label FROM deals")
def status_labels(spark, d):
    return table(spark, d, "deals").select("id", decisions.status_label(F.col("completion_label"), F.col("status")).alias("label"))


@query(
    with_tables("fills") + ", e AS (SELECT *, coalesce(sum(CASE WHEN side = 'SELL' THEN 1 ELSE 0 END) OVER (PARTITION BY deal_id ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM fills), "
    "g AS (SELECT deal_id, CAST(epoch AS INT) AS epoch, min(ts) FILTER (side = 'BUY') AS open_ts, max(ts) FILTER (side = 'SELL') AS close_ts, sum(CAST(price AS DOUBLE) * quantity) FILTER (side = 'BUY') AS size, sum(CAST(price AS DOUBLE) * CAST(price AS DOUBLE) * quantity) FILTER (side = 'BUY') AS w, max(CAST(price AS DOUBLE)) FILTER (side = 'SELL') AS x FROM e GROUP BY 1, 2) "
    "SELECT deal_id, epoch, open_ts, close_ts, round(w / size, 6) AS entry_price, round(x, 6) AS exit_price, round(size, 4) AS size_eur, round((x / (w / size) - 1) * size, 4) AS pnl_eur, CASE WHEN close_ts IS NULL THEN 'open' ELSE 'closed' END AS status FROM g WHERE size > 0"
)
def positions_from_fills(spark, d):
    return ledger.positions(table(spark, d, "fills"))


@query(
    with_tables("nlv") + "SELECT account, day, baseline, round(CASE WHEN baseline > 0 THEN (baseline - lowest) / baseline END, 6) AS drawdown, coalesce(baseline > 0 AND (baseline - lowest) / baseline >= 0.02, false) AS breached FROM (SELECT account, CAST(ts AS DATE) AS day, arg_min(net_liquidation, (ts, id)) AS baseline, min(net_liquidation) AS lowest FROM nlv GROUP BY 1, 2)"
)
def daily_loss_guard(spark, d):
    return ledger.daily_loss(table(spark, d, "nlv")).drop("lowest")


@query(
    with_tables("vendor_usage") + ", r AS (SELECT *, sum(credits_cost) OVER (PARTITION BY vendor, year_month ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS after FROM vendor_usage) "
    "SELECT vendor, year_month, id, m AS mark, CAST(after AS BIGINT) AS after FROM r, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) t(m) WHERE after - credits_cost < m * 5000 AND after >= m * 5000"
)
def threshold_crossings(spark, d):
    return ledger.threshold_crossings(table(spark, d, "vendor_usage"), 5000.0).withColumn("mark", F.col("mark").cast("double"))


@query(with_tables("positions") + "SELECT count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'open') >= 5 AS cap_reached FROM positions")
def open_position_count(spark, d):
    return ledger.open_count(table(spark, d, "positions"))


_REQ = "SELECT l_orderkey * 10 + l_linenumber AS trade_id, l_orderkey AS deal_id, l_partkey AS seq, l_returnflag = 'A' AS requires_approval, l_linestatus = 'O' AS resolved FROM lineitem"
_TRADES = "SELECT event_id AS trade_id, user_id AS deal_id, CASE event_id % 5 WHEN 0 THEN 'FILLED' WHEN 1 THEN 'SUBMITTED' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'REJECTED' ELSE 'CANCELLED' END AS status FROM events"


@query(
    f"WITH q AS ({_REQ}), t AS ({_TRADES}) SELECT trade_id, deal_id, CASE WHEN requires_approval THEN 'PENDING' WHEN NOT resolved THEN 'REJECTED' ELSE 'SUBMITTED' END AS status FROM (SELECT * FROM q WHERE trade_id NOT IN (SELECT trade_id FROM t) AND deal_id NOT IN (SELECT deal_id FROM t WHERE status IN ('PENDING', 'SUBMITTED', 'FILLED')) "
    "QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY seq NULLS FIRST, trade_id NULLS FIRST, requires_approval NULLS FIRST, resolved NULLS FIRST) = 1)"
)
def trade_admission(spark, d):
    from bidframe.plans.pricing import _split

    requests = table(spark, d, "lineitem").selectExpr(*[x.strip() for x in _split(_REQ)])
    trades = table(spark, d, "events").selectExpr(*[x.strip() for x in _split(_TRADES)])
    return ledger.admit_trades(requests, trades).select("trade_id", "deal_id", "status")


@query(
    "WITH h AS (SELECT user_id AS trade_id, ts AS created_at, CASE event_id % 5 WHEN 0 THEN 'FILLED' WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'CANCELLED' ELSE 'PENDING' END AS status FROM events) "
    "SELECT trade_id, arg_max(status, (status IN ('FILLED', 'CANCELLED', 'REJECTED'), created_at)) AS status FROM h GROUP BY 1"
)
def trade_final_status(spark, d):
    history = table(spark, d, "events").selectExpr("user_id AS trade_id", "ts AS created_at", "CASE event_id % 5 WHEN 0 THEN 'FILLED' WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'CANCELLED' ELSE 'PENDING' END AS status")
    return ledger.final_status(history)


@query(
    "WITH s AS (SELECT concat('k', CAST(user_id AS VARCHAR)) AS key, CAST(event_id AS VARCHAR) AS value, ts AS updated_at FROM events) SELECT key, arg_max(value, updated_at) AS value, max(updated_at) AS updated_at FROM s GROUP BY 1"
)
def state_upsert(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id % 2 AS half", "concat('k', CAST(user_id AS STRING)) AS key", "CAST(event_id AS STRING) AS value", "ts AS updated_at")
    return ledger.upsert_state(rows.filter("half = 0").drop("half"), rows.filter("half = 1").drop("half"))


@query(
    "WITH s AS (SELECT concat('f', CAST(user_id AS VARCHAR), '.md') AS file, CAST(ts AS DATE) AS day, event_type AS title, ts AS written_at, event_id FROM events) SELECT file, day, title FROM s QUALIFY row_number() OVER (PARTITION BY file ORDER BY written_at DESC) = 1"
)
def decision_index(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id % 2 AS half", "concat('f', CAST(user_id AS STRING), '.md') AS file", "to_date(ts) AS day", "event_type AS title", "ts AS written_at")
    return ledger.decision_index(rows.filter("half = 0").drop("half"), rows.filter("half = 1").drop("half")).select("file", "day", "title")


@query()
def daily_cycle(spark, d):
    """Ordered fold per day; the tests hold it against a loop."""
    rows = table(spark, d, "events").selectExpr(
        "to_date(ts) AS run_day", "event_id AS seq", "user_id AS deal_id", "ts AS at", "event_id % 3 <> 0 AS ok", "CAST(0 AS INT) AS open_positions", "CAST(dayofmonth(ts) AS INT) AS rampup_validated", "dayofmonth(ts) = 13 AS halted"
    )
    return decisions.daily_cycle(rows)


_REPORTED = ["concat('Bid ', CAST(deal_id AS VARCHAR(20))) AS target_name", "CASE WHEN deal_id % 2 = 0 THEN 'A \"B\" Holding' END AS acquirer_name", "CASE deal_id % 3 WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(0 AS DOUBLE) END AS payment_cash_share"]


@query(
    _SIZED + f", b AS (SELECT *, {', '.join(_REPORTED)} FROM o WHERE reason = 'ok') "
    "SELECT concat('2024-01-02_bid-', CAST(deal_id AS VARCHAR), '_', CAST(deal_id AS VARCHAR), '.md') AS file, DATE '2024-01-02' AS day, concat('# ', target_name, chr(10), '- acquirer: ', coalesce(acquirer_name, 'N/A'), chr(10), '- strategy: ', "
    "CASE WHEN coalesce(payment_cash_share, 1) >= 1 THEN 'cash' WHEN payment_cash_share > 0 THEN 'cash and shares' ELSE 'shares' END, chr(10), '- quantity: ', CAST(CAST(qty AS BIGINT) AS VARCHAR), chr(10), '- limit: ', format('{:,.2f} EUR', round_even(lim, 4)), chr(10), "
    f"'- stop: ', format('{{:,.2f}} EUR', round_even(lim * 0.9, 4)), chr(10), '- target: ', format('{{:,.2f}} EUR', {_FOUR.format(x='offer_price')}), chr(10), '- spread: ', format('{{:,.2f}}%', round_even(spread, 6) * 100), chr(10), '- p: 50.00%') AS body FROM b"
)
def decision_reports(spark, d):
    """The whole text of every report."""
    from bidframe.sources.sinks import decision_report

    rows = decisions.decide(_candidates(spark, d)).filter("reason = 'ok'")
    return decision_report(rows.selectExpr("*", *_REPORTED, "DATE '2024-01-02' AS day", "0.5D AS p_completion"))
