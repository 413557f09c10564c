"""Queries on bars, as-of prices, resolution and premiums."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import bars, pricing
from bidframe.plans.registry import query
from bidframe.plans.standin import table, with_tables


def _bars_sql(unit: str) -> str:
    return with_tables("ticks") + (
        f"SELECT ticker, date_trunc('{unit}', ts) AS bucket, CAST(arg_min(close, (ts, event_id)) AS DOUBLE) AS open, CAST(max(close) AS DOUBLE) AS high, CAST(min(close) AS DOUBLE) AS low, CAST(arg_max(close, (ts, event_id)) AS DOUBLE) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_ticks FROM ticks GROUP BY 1, 2"
    )


def _doubles(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query(_bars_sql("hour"))
def price_bars_1h(spark, d):
    return _doubles(bars.price_bars(table(spark, d, "ticks"), "1 hour"), "open", "high", "low", "close")


@query(_bars_sql("day"))
def price_bars_1d(spark, d):
    return _doubles(bars.price_bars(table(spark, d, "ticks"), "1 day"), "open", "high", "low", "close")


_DAILY = "daily AS (SELECT ticker, CAST(ts AS DATE) AS d, arg_max(close, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2)"


def _asof(cond: str, day: str = "r.d") -> str:
    return f"LEFT JOIN daily c ON c.ticker = r.ticker AND {cond} QUALIFY row_number() OVER (PARTITION BY r.deal_id ORDER BY c.d DESC NULLS LAST) = 1"


@query(with_tables("ticks", "price_requests") + f", {_DAILY} SELECT r.deal_id, r.ticker, r.d, CAST(c.close AS DOUBLE) AS close, c.d AS close_date FROM price_requests r " + _asof("c.d <= r.d AND date_diff('day', c.d, r.d) <= 5"))
def asof_close_lookback(spark, d):
    got = pricing.asof_close(table(spark, d, "price_requests"), table(spark, d, "ticks"), 5)
    return _doubles(got.select("deal_id", "ticker", "d", "close", "close_date"), "close")


@query(with_tables("ticks", "price_requests") + f", {_DAILY} SELECT r.deal_id, CAST(c.close AS DOUBLE) AS close, c.d AS close_date FROM price_requests r " + _asof("c.d < r.d"))
def asof_close_strict(spark, d):
    got = pricing.asof_close(table(spark, d, "price_requests"), table(spark, d, "ticks"), None, strict=True)
    return _doubles(got.select("deal_id", "close", "close_date"), "close")


_RATES = "SELECT CASE user_id % 3 WHEN 0 THEN 'EURUSD=X' ELSE 'EURGBP=X' END AS ticker, CAST(ts AS DATE) AS d, CAST(1 + max(value) / 1000 AS DECIMAL(18,6)) AS close FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-10' GROUP BY 1, 2"
_CURRENCY = "CASE deal_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'CHF' END"


@query(
    with_tables("ticks", "price_requests") + f", {_DAILY}, rates AS ({_RATES}), p AS (SELECT r.deal_id, {_CURRENCY} AS currency, c.close, c.d AS close_date FROM price_requests r " + _asof("c.d <= r.d AND date_diff('day', c.d, r.d) <= 5")
    + "), x AS (SELECT p.*, f.close AS rate FROM p LEFT JOIN rates f ON f.ticker = 'EUR' || p.currency || '=X' AND f.d <= p.close_date AND date_diff('day', f.d, p.close_date) <= 5 QUALIFY row_number() OVER (PARTITION BY p.deal_id ORDER BY f.d DESC NULLS LAST) = 1) "
    "SELECT deal_id, currency, round(CASE WHEN currency = 'EUR' THEN CAST(close AS DOUBLE) ELSE CAST(close AS DOUBLE) / CAST(rate AS DOUBLE) END, 6) AS close_eur FROM x"
)
def asof_fx(spark, d):
    requests = table(spark, d, "price_requests").withColumn("currency", F.expr(_CURRENCY))
    rates = table(spark, d, "events").filter("to_date(ts) <> DATE '2024-01-10'").groupBy(F.expr("CASE user_id % 3 WHEN 0 THEN 'EURUSD=X' ELSE 'EURGBP=X' END").alias("ticker"), F.to_date("ts").alias("d")).agg((1 + F.max("value") / 1000).cast("decimal(18,6)").alias("close"))
    got = pricing.to_euro(pricing.asof_close(requests, table(spark, d, "ticks"), 5), rates)
    return got.select("deal_id", "currency", F.round(F.col("close_eur").cast("double"), 6).alias("close_eur"))


_TMINUS = "CASE dayofweek({d}) WHEN 0 THEN {d} - 2 WHEN 1 THEN {d} - 3 ELSE {d} - 1 END"


@query(with_tables("deals") + f"SELECT id, {_TMINUS.format(d='announcement_date')} AS day_before FROM deals")
def business_day_before(spark, d):
    return table(spark, d, "deals").select("id", pricing.prev_business_day(F.col("announcement_date")).alias("day_before"))


@query("SELECT event_id, timezone('UTC', CASE WHEN loc::TIME >= TIME '09:00:00' THEN timezone('Europe/Paris', date_trunc('day', loc) + INTERVAL 33 HOUR) ELSE timezone('Europe/Paris', date_trunc('day', loc) + INTERVAL 9 HOUR) END) AS next_run FROM (SELECT event_id, timezone('Europe/Paris', timezone('UTC', CAST(ts AS TIMESTAMP))) AS loc FROM events)")
def next_morning_run(spark, d):
    return table(spark, d, "events").select("event_id", pricing.next_local_hour(F.col("ts")).alias("next_run"))


_PREM = (
    with_tables("ticks", "price_requests") + f", {_DAILY}, p AS (SELECT r.deal_id, CAST(r.offer_price AS DOUBLE) AS offer, CAST(c.close AS DOUBLE) AS close, c.d AS close_date FROM (SELECT deal_id, ticker, offer_price, {_TMINUS.format(d='d')} AS d FROM price_requests) r "
    + _asof("c.d <= r.d AND date_diff('day', c.d, r.d) <= 5") + ") "
)


#: A quotient of whole numbers, rounded half to even.
def _half_even(n: str, m: str) -> str:
    return f"sign({n}) * (abs({n}) // ({m}) + CASE WHEN 2 * (abs({n}) % ({m})) > ({m}) OR (2 * (abs({n}) % ({m})) = ({m}) AND (abs({n}) // ({m})) % 2 = 1) THEN 1 ELSE 0 END)"


_MICRO = "CAST({} * 1000000 AS HUGEINT)"
_GAP = f"(({_MICRO.format('o')} - {_MICRO.format('c')}) * 10000)"


@query(
    _PREM + f", m AS (SELECT *, CAST(offer AS DECIMAL(18,6)) AS o, CAST(close AS DECIMAL(18,6)) AS c FROM p) SELECT deal_id, CAST(c AS DOUBLE) AS reference_price, close_date AS reference_date, CASE WHEN (o - c) BETWEEN -0.5 * c AND 2 * c THEN CAST({_half_even(_GAP, _MICRO.format('c'))} AS DOUBLE) / 10000 END AS premium_pct, "
    "CASE WHEN c IS NULL THEN 'no_price' WHEN o IS NULL THEN 'no_offer' WHEN NOT ((o - c) BETWEEN -0.5 * c AND 2 * c) THEN 'out_of_bounds' ELSE 'applied' END AS action FROM m"
)
def premium_gate(spark, d):
    requests = table(spark, d, "price_requests").select(F.col("deal_id").alias("id"), "ticker", F.col("d").alias("announcement_date"), "offer_price", F.lit(1).alias("completion_label"))
    return _doubles(pricing.premium_backfill(requests, table(spark, d, "ticks")), "reference_price", "premium_pct").select("deal_id", "reference_price", "reference_date", "premium_pct", "action")


_LEGS = "SELECT o_orderkey AS deal_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS DECIMAL(18,6)) END AS cash_eur, CAST(CAST(o_orderkey % 7 + 1 AS DECIMAL(12,6)) * 0.25 AS DECIMAL(12,6)) AS share_ratio, concat('T', CAST(o_custkey % 150 AS VARCHAR(20))) AS acquirer_ticker, date_add(DATE '2024-01-01', CAST(o_orderkey % 30 AS INT)) AS day FROM orders"
#: Cash and shares times close, in units of 10 ** -12.
_TOTAL = f"({_MICRO.format('coalesce(cash_eur, 0)')} * 1000000 + {_MICRO.format('share_ratio')} * {_MICRO.format('close')})"


@query(
    with_tables("ticks") + f", {_DAILY}, legs AS ({_LEGS}), p AS (SELECT r.*, c.close FROM (SELECT deal_id, cash_eur, share_ratio, acquirer_ticker AS ticker, {_TMINUS.format(d='day')} AS d FROM legs) r " + _asof("c.d <= r.d AND date_diff('day', c.d, r.d) <= 5")
    + f") SELECT deal_id, CAST({_half_even(_TOTAL, '100000000')} AS DOUBLE) / 10000 AS total, CASE WHEN close IS NULL THEN 'miss' ELSE 'updated' END AS action, CASE WHEN close IS NULL THEN 'suspect_mixed' ELSE 'verified_mixed' END AS flag FROM p"
)
def mixed_total(spark, d):
    legs = table(spark, d, "orders").selectExpr(*[x.strip() for x in _split(_LEGS)])
    deals = legs.select(F.col("deal_id").alias("id"), F.col("day").alias("announcement_date"), F.lit("suspect_mixed").alias("offer_price_quality_flag"))
    got = pricing.recalculate_totals(deals, legs.drop("day"), table(spark, d, "ticks"))
    return got.select("deal_id", F.col("offer_price_total_eur").cast("double").alias("total"), "action", F.col("offer_price_quality_flag").alias("flag"))


def _split(sql: str) -> list[str]:
    """The select list of a one-table query, at commas outside of brackets."""
    body, depth, out, start = sql[len("SELECT ") : sql.rindex(" FROM ")], 0, [], 0
    for k, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[start:k])
            start = k + 1
    return [*out, body[start:]]


_LISTINGS = (
    "SELECT p_partkey AS pos, concat(CASE p_partkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'IT' ELSE 'DE' END, lpad(CAST(p_partkey % 97 AS VARCHAR(20)), 10, '0')) AS isin, concat('AB', CAST(p_size AS VARCHAR(20)), CASE WHEN p_partkey % 4 = 0 THEN 'EUR' ELSE '' END) AS ticker, "
    "CASE p_size % 9 WHEN 0 THEN 'FP' WHEN 1 THEN 'XS' WHEN 2 THEN 'GR' WHEN 3 THEN 'IM' WHEN 4 THEN 'LN' WHEN 5 THEN 'GY' WHEN 6 THEN 'US' WHEN 7 THEN 'EO' ELSE 'SM' END AS exch, CASE WHEN p_partkey % 7 = 0 THEN 'Warrant' WHEN p_partkey % 7 = 1 THEN 'REIT' ELSE 'Common Stock' END AS security_type, "
    "CASE WHEN p_partkey % 11 = 0 THEN 'Corp' ELSE 'Equity' END AS market_sector, concat('C', CAST(p_partkey % 5 AS VARCHAR(20))) AS composite FROM part"
)
_ISINS = "SELECT DISTINCT concat(CASE o_custkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'IT' ELSE 'DE' END, lpad(CAST(o_custkey % 120 AS VARCHAR(20)), 10, '0')) AS isin FROM orders"


def _resolved(spark, d):
    listings = table(spark, d, "part").selectExpr(*[x.strip() for x in _split(_LISTINGS)])
    keys = table(spark, d, "orders").selectExpr(_split(_ISINS)[0].strip().removeprefix("DISTINCT ")).distinct()
    return pricing.resolve_venues(keys, listings)


def _venues(keys: str) -> str:
    return (
        f"l AS ({_LISTINGS}), k AS ({keys}), e AS (SELECT *, count(*) OVER (PARTITION BY isin, composite) AS n, min(pos) OVER (PARTITION BY isin, composite) AS seen, "
        "CASE substring(isin, 1, 2) WHEN 'FR' THEN list_position(['FP', 'XS', 'XH', 'EO'], exch) WHEN 'IT' THEN list_position(['IM'], exch) ELSE list_position(['GR', 'GY'], exch) END AS rk FROM l WHERE security_type IN ('Common Stock', 'REIT') AND market_sector = 'Equity'), "
        "b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY isin ORDER BY nullif(rk, 0) ASC NULLS LAST, n DESC, seen, pos) = 1), "
        "t AS (SELECT k.isin, b.exch, b.ticker, nullif(b.rk, 0) AS rk, CASE WHEN b.exch IN ('FP', 'XS', 'XH', 'EO') THEN '.PA' WHEN b.exch = 'IM' THEN '.MI' WHEN b.exch IN ('GR', 'GY') THEN '.DE' WHEN b.exch = 'LN' THEN '.L' WHEN b.exch = 'SM' THEN '.MC' END AS suffix FROM k LEFT JOIN b USING (isin)), "
        "v AS (SELECT isin, CASE WHEN ends_with(ticker, 'EUR') THEN ticker[:-4] ELSE ticker END || suffix AS trading_ticker, CASE WHEN ticker IS NULL THEN 'no_match' WHEN suffix IS NULL THEN 'unknown_exch' WHEN rk IS NULL THEN 'venue_fallback' WHEN exch IN ('XS', 'XH', 'EO') THEN 'growth' ELSE 'home_venue' END AS flag FROM t) "
    )


@query("WITH " + _venues(_ISINS) + "SELECT * FROM v")
def venue_resolution(spark, d):
    return _resolved(spark, d).select("isin", "trading_ticker", "flag")


_OF_DEALS = "SELECT DISTINCT isin FROM deals WHERE isin IS NOT NULL"


def _deals_resolved(spark, d):
    deals = table(spark, d, "deals").withColumn("isin", F.expr("CASE WHEN id % 8 = 0 THEN NULL ELSE isin END"))
    listings = table(spark, d, "part").selectExpr(*[x.strip() for x in _split(_LISTINGS)])
    return deals, pricing.resolve_venues(deals.select("isin").filter("isin IS NOT NULL").distinct(), listings).select("isin", "trading_ticker", "flag")


_SOME_ISINS = "o AS (SELECT id, ticker, ticker_resolution_flag AS old, CASE WHEN id % 8 = 0 THEN NULL ELSE isin END AS isin FROM deals), "
_NEW_FLAG = "CASE WHEN o.isin IS NULL THEN 'not_isin' ELSE coalesce(v.flag, 'no_match') END"


@query(with_tables("deals") + ", " + _SOME_ISINS + _venues(_OF_DEALS.replace("deals", "o")) + f"SELECT id, CASE WHEN old IS NULL THEN coalesce(v.trading_ticker, ticker) ELSE ticker END AS ticker, coalesce(old, {_NEW_FLAG}) AS flag FROM o LEFT JOIN v USING (isin)")
def resolution_write(spark, d):
    return pricing.write_resolution(*_deals_resolved(spark, d)).select("id", "ticker", F.col("ticker_resolution_flag").alias("flag"))


@query(with_tables("deals") + ", " + _SOME_ISINS + _venues(_OF_DEALS.replace("deals", "o")) + f"SELECT id, coalesce(v.trading_ticker, ticker) AS ticker, CASE WHEN old = 'growth' THEN old ELSE {_NEW_FLAG} END AS flag FROM o LEFT JOIN v USING (isin)")
def resolution_backfill(spark, d):
    return pricing.write_resolution(*_deals_resolved(spark, d), only_unset=False, keep=("growth",)).select("id", "ticker", F.col("ticker_resolution_flag").alias("flag"))


@query(
    with_tables("deals") + "SELECT id, CASE WHEN id % 10 = 1 THEN 'cache' WHEN target_name IN ('Target 7', 'Target 1234') THEN 'manual' WHEN id % 4 = 0 THEN NULL ELSE 'isin' END AS source, CASE WHEN id % 10 = 1 THEN concat('S', id) WHEN target_name = 'Target 7' THEN 'SEV' WHEN target_name = 'Target 1234' THEN 'OTT' END AS symbol FROM deals"
)
def broker_contract(spark, d):
    deals = table(spark, d, "deals").withColumn("symbol", F.expr("CASE WHEN id % 10 = 1 THEN concat('S', id) END")).withColumn("exchange", F.lit("SBF")).withColumn("isin", F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE isin END"))
    manual = spark.createDataFrame([("TARGET 7 S.p.A.", "SEV", "BVME"), ("Target 1234 SE", "OTT", "IBIS")], "name string, symbol string, exchange string")
    return pricing.broker_contracts(deals, manual).select("id", F.col("contract.source").alias("source"), F.col("contract.symbol").alias("symbol"))


@query(with_tables("deals") + "SELECT id, CASE WHEN isin = 'FR0000000003' THEN NULL WHEN isin = 'IT0000000004' THEN 'QUAT.MI' ELSE isin END AS resolved_ticker FROM deals")
def curated_ticker(spark, d):
    curated = spark.createDataFrame([("IT0000000004", "QUAT.MI"), ("FR0000000003", "TROIS.PA")], "isin string, ticker string")
    denied = spark.createDataFrame([("FR0000000003",)], "isin string")
    return pricing.curated_tickers(table(spark, d, "deals"), curated, denied, bare=True).select("id", "resolved_ticker")


@query(
    "WITH w AS (SELECT DISTINCT o_custkey AS key FROM orders), c AS (SELECT user_id AS key, ts AS fetched_at FROM events), s AS (SELECT key FROM w WHERE key NOT IN (SELECT key FROM c WHERE fetched_at > TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY)) "
    "SELECT key, CAST(ceil(row_number() OVER (ORDER BY key) / 100.0) AS INT) AS batch FROM s"
)
def stale_worklist(spark, d):
    cache = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"))
    return pricing.stale_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), cache, F.to_timestamp(F.lit("2024-02-20 00:00:00")))


#: Deals with ISINs that listings know, announced in the ticks' days; and ticks at the venues' tickers.
_VENUE_DEALS = (
    "SELECT id, CASE WHEN id % 40 = 0 THEN NULL WHEN id % 41 = 0 THEN 'XX' ELSE concat(juridiction, lpad(CAST(id % 120 AS VARCHAR(20)), 10, '0')) END AS isin, CASE WHEN id % 37 = 0 THEN NULL ELSE date_add(DATE '2024-01-01', CAST(id % 30 AS INT)) END AS announcement_date, "
    "CAST(CASE WHEN offer_price IS NULL THEN NULL ELSE 20 + id % 150 END AS DECIMAL(18,6)) AS offer_price, completion_label, CASE WHEN id % 5 = 0 THEN 'no_match' ELSE NULL END AS ticker_resolution_flag FROM deals"
)
_VENUE_TICKS = "SELECT concat('AB', CAST(user_id % 50 + 1 AS VARCHAR(20)), CASE event_id % 3 WHEN 0 THEN '.PA' WHEN 1 THEN '.DE' ELSE '.MI' END) AS ticker, ts, CAST(value AS DECIMAL(18,6)) AS close, event_id FROM events"
_VENUE_ROWS = (
    with_tables("deals") + f", ticks AS ({_VENUE_TICKS}), {_DAILY}, o AS ({_VENUE_DEALS}), " + _venues("SELECT DISTINCT isin FROM o WHERE isin IS NOT NULL") + ", "
    + f"r AS (SELECT o.id AS deal_id, o.isin, o.announcement_date, o.offer_price AS offer, o.completion_label, o.ticker_resolution_flag AS old, v.trading_ticker, CASE WHEN {{usable}} THEN v.trading_ticker END AS ticker, v.flag AS found, CASE WHEN o.announcement_date IS NOT NULL THEN {_TMINUS.format(d='o.announcement_date')} END AS d FROM o LEFT JOIN v USING (isin)), "
    + "q AS (SELECT r.*, c.close, c.d AS close_date FROM r " + _asof("c.d <= r.d AND date_diff('day', c.d, r.d) <= 5") + "), h AS (SELECT *, CAST(offer AS DECIMAL(18,6)) AS o, CAST(close AS DECIMAL(18,6)) AS c FROM q), g AS (SELECT *, (o - c) BETWEEN -0.5 * c AND 2 * c AS inside, CAST(" + _half_even(_GAP, _MICRO.format("c")) + " AS DOUBLE) / 10000 AS off FROM h) "
)


def _venue_deals(spark, d):
    return table(spark, d, "deals").selectExpr(*[x.strip() for x in _split(_VENUE_DEALS)]), table(spark, d, "part").selectExpr(*[x.strip() for x in _split(_LISTINGS)]), table(spark, d, "events").selectExpr(*[x.strip() for x in _split(_VENUE_TICKS)])


@query(
    _VENUE_ROWS.format(usable="v.flag IN ('home_venue', 'venue_fallback')")
    + "SELECT deal_id, isin, trading_ticker, CASE WHEN len(isin) < 12 THEN 'not_isin' WHEN ticker IS NULL THEN found WHEN close IS NULL THEN 'no_price_data' WHEN NOT inside THEN 'premium_out_of_bounds' ELSE found END AS flag, CAST(close AS DOUBLE) AS reference_price, CASE WHEN close IS NOT NULL THEN d END AS target_date, close_date AS effective_date, "
    "CASE WHEN inside THEN off END AS premium_pct FROM (SELECT * REPLACE (CASE WHEN len(isin) < 12 THEN NULL ELSE trading_ticker END AS trading_ticker) FROM g) WHERE completion_label IS NOT NULL AND isin IS NOT NULL AND old IS NULL"
)
def premium_from_isin(spark, d):
    deals, listings, closes = _venue_deals(spark, d)
    got = pricing.premium_from_isin(deals, listings, closes)
    return got.withColumn("reference_price", F.col("reference_price").cast("double")).withColumn("premium_pct", F.col("premium_pct").cast("double"))


@query(
    with_tables("ticks", "price_requests") + f", {_DAILY}, p AS (SELECT r.deal_id, CAST(r.offer_price AS DECIMAL(18,6)) AS o, CAST(c.close AS DECIMAL(18,6)) AS c FROM (SELECT deal_id, ticker, offer_price, {_TMINUS.format(d='d')} AS d FROM price_requests) r " + _asof("c.d <= r.d AND date_diff('day', c.d, r.d) <= 5")
    + f"), j AS (SELECT deal_id, CASE WHEN c IS NULL THEN 'no_close' WHEN o IS NULL THEN 'no_offer' WHEN abs(o - c) >= 0.3 * c THEN 'deviation' ELSE 'within_bound' END AS reason, CASE WHEN abs(o - c) < 0.3 * c THEN 'verified_cash' ELSE 'manual_review' END AS flag, CAST(c AS DOUBLE) AS close, CAST({_half_even(_GAP, _MICRO.format('c'))} AS DOUBLE) / 10000 AS deviation FROM p) SELECT *, row_number() OVER (ORDER BY flag <> 'verified_cash', abs(deviation) NULLS LAST, deal_id) AS pos FROM j"
)
def small_cap_validation(spark, d):
    return pricing.validate_small_caps(table(spark, d, "price_requests"), table(spark, d, "ticks")).select("pos", "deal_id", "reason", "flag", F.col("close").cast("double").alias("close"), "deviation")


@query(
    with_tables("ticks", "price_requests") + f", {_DAILY}, p AS (SELECT r.deal_id, r.isin, r.ticker, c.close FROM (SELECT deal_id, CASE WHEN deal_id % 60 = 0 THEN NULL ELSE 'X' END AS isin, CASE WHEN deal_id % 80 = 0 THEN NULL ELSE ticker END AS ticker, {_TMINUS.format(d='d')} AS d FROM price_requests) r " + _asof("c.d <= r.d AND date_diff('day', c.d, r.d) <= 5")
    + "), s AS (SELECT *, CASE WHEN isin IS NULL THEN 'no_isin' WHEN ticker IS NULL THEN 'no_ticker' WHEN close IS NULL THEN 'no_price' ELSE 'ok' END AS status FROM p) SELECT round(avg(CASE WHEN isin IS NOT NULL THEN CAST(status <> 'no_ticker' AS INT) END), 6) AS resolution_rate, round(avg(CAST(status = 'ok' AS INT)), 6) AS priced_rate FROM s"
)
def price_probe_rates(spark, d):
    sample = table(spark, d, "price_requests").withColumn("isin", F.expr("CASE WHEN deal_id % 60 = 0 THEN NULL ELSE 'X' END")).withColumn("ticker", F.expr("CASE WHEN deal_id % 80 = 0 THEN NULL ELSE ticker END"))
    return pricing.probe_rates(pricing.price_probe(sample, table(spark, d, "ticks")))


@query(
    _VENUE_ROWS.format(usable="true")
    + "SELECT deal_id, status, CASE WHEN status = 'ok' THEN off END AS premium_preview, coalesce(status = 'ok' AND NOT inside, false) AS outlier FROM (SELECT *, CASE WHEN isin IS NULL THEN 'no_isin' WHEN ticker IS NULL AND found = 'no_match' THEN 'no_match' WHEN ticker IS NULL THEN 'unknown_exch' WHEN d IS NULL THEN 'resolved_no_date' WHEN close IS NULL THEN 'no_price' ELSE 'ok' END AS status FROM g)"
)
def price_probe_statuses(spark, d):
    """Each deal probed from its ISIN on: resolved, priced, and how its offer stands to the price."""
    deals, listings, closes = _venue_deals(spark, d)
    found = pricing.resolve_venues(deals.select("isin").filter("isin IS NOT NULL").distinct(), listings).select("isin", F.col("trading_ticker").alias("ticker"), "flag")
    sample = deals.join(found, "isin", "left").select(F.col("id").alias("deal_id"), "isin", "ticker", "flag", F.col("announcement_date").alias("d"), "offer_price")
    return pricing.price_probe(sample, closes).select("deal_id", "status", F.col("premium_preview").cast("double").alias("premium_preview"), "outlier")


_LISTED = "SELECT id, target_name, CASE WHEN id % 5 = 0 THEN NULL ELSE ticker END AS key, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN concat(target_name, ' Holding SE') WHEN id % 11 = 1 THEN concat('Tragte ', CAST(id % 97 AS VARCHAR(9)), ' AG') WHEN id % 11 = 2 THEN concat('1', target_name) ELSE concat('Other ', acquirer_name) END AS listed_name FROM deals"


def _identity(spark, d):
    from bidframe.functions.names import STOP_WORDS

    return pricing.identity_check(table(spark, d, "deals").selectExpr(*[x.strip() for x in _split(_LISTED)]), STOP_WORDS)


def _identity_sql() -> str:
    """Words, shared words and letters in common by lists. Of the pairs that the bound leaves open, the longest common stretch is found and then those left and right of it, step by step."""
    from bidframe.functions.names import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = "list_sort(list_distinct([w FOR w IN string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ') IF w <> '' AND w NOT IN (" + stop + ")]))"
    return (
        with_tables("deals") + f", p AS ({_LISTED}), w AS (SELECT *, {words.format(c='target_name')} AS t, {words.format(c='listed_name')} AS n FROM p), j AS (SELECT *, array_to_string(t, ' ') AS a, array_to_string(n, ' ') AS b FROM w), "
        "m AS (SELECT *, len(a) + len(b) AS both_, coalesce(list_sum([least(len(a) - len(replace(a, c, '')), len(b) - len(replace(b, c, ''))) FOR c IN list_distinct(string_split(a, '')) IF c <> '']), 0) AS shared FROM j), "
        "x AS (SELECT *, CASE WHEN key IS NULL OR listed_name IS NULL THEN NULL WHEN len(list_filter(list_intersect(t, n), lambda v: len(v) >= 5)) > 0 THEN 'word' WHEN a = b THEN 'equal' WHEN both_ > 0 AND 2 * shared / both_ < 0.6 THEN 'bound' ELSE 'ratio' END AS decided_by FROM m), "
        "q AS (SELECT DISTINCT a, b FROM x WHERE decided_by = 'ratio'), "
        "r AS (SELECT a, b, a AS l, b AS o, 0 AS matched FROM q UNION ALL SELECT a, b, u.l, u.o, u.matched FROM (SELECT a, b, unnest([{'l': l[1:-best.i - 1], 'o': o[1:-best.j - 1], 'matched': best.n}, {'l': l[-best.i + best.n:], 'o': o[-best.j + best.n:], 'matched': 0}]) AS u "
        "FROM (SELECT a, b, l, o, list_max(flatten([flatten([[{'n': n, 'i': -i, 'j': -j} FOR n IN range(1, len(l) + 1) IF i + n <= len(l) + 1 AND j + n <= len(o) + 1 AND l[i:i + n - 1] = o[j:j + n - 1]] FOR j IN range(1, len(o) + 1)]) FOR i IN range(1, len(l) + 1)])) AS best FROM r WHERE l <> '' AND o <> '') WHERE best IS NOT NULL)), "
        "e AS (SELECT a, b, 2 * sum(matched) / (len(a) + len(b)) AS ratio FROM r GROUP BY a, b) "
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    _identity_sql() + "SELECT x.id, CASE WHEN x.key IS NULL THEN 'no_ticker' WHEN x.listed_name IS NULL THEN 'no_data' WHEN decided_by IN ('word', 'equal') OR e.ratio >= 0.6 THEN 'CONFIRM' ELSE 'REJECT' END AS verdict, decided_by, round(e.ratio, 4) AS ratio FROM x LEFT JOIN e ON e.a = x.a AND e.b = x.b AND x.decided_by = 'ratio'"
)
def identity_check(spark, d):
    return _identity(spark, d).select("id", "verdict", "decided_by", "ratio")


@query(_identity_sql() + "SELECT decided_by, count(*) AS n FROM x GROUP BY 1")
def identity_paths(spark, d):
    """How many pairs each way decides; those by ``ratio`` are the ones that reach Python."""
    return _identity(spark, d).groupBy("decided_by").agg(F.count("*").alias("n"))
