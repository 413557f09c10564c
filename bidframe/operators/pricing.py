"""As-of prices, currency conversion, identifier resolution, premiums and totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.functions.names import GROWTH_VENUES, HOME_VENUES, broker_symbol, is_isin, normalise_name, venue_ticker
from bidframe.operators.ordering import carry, number_rows


def prev_business_day(day: Column) -> Column:
    """The day before, or the Friday before on Sundays and Mondays (no holidays)."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def next_local_hour(now: Column, hour: int = 9, zone: str = "Europe/Paris") -> Column:
    """The next ``hour`` o'clock in a zone, as UTC; exactly now counts as past."""
    local = F.from_utc_timestamp(now, zone)
    today = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(hour))
    target = F.when(today <= local, F.date_trunc("day", local) + F.make_dt_interval(F.lit(1), F.lit(hour))).otherwise(today)
    return F.to_utc_timestamp(target, zone)


#: Days in which closes and requests of a ticker are sorted together.
SPAN_DAYS = 30


def asof_close(requests: DataFrame, closes: DataFrame, days: int | None = 5, strict: bool = False, name: str = "close") -> DataFrame:
    """Each request (ticker, d, ...) with the latest close at or before ``d`` (before, if ``strict``), at most ``days`` back.

    A scan in segments instead of a range join: closes become one row per ticker and day, and the days asked for are
    put among them, once each, in spans of a month. Within a span the last close is carried from day to day; each
    span's last close is carried over the spans, of which a ticker has a few hundred, and holds where a span has none
    before. So no window holds more than a ticker's month, however busy the ticker. Adds ``name`` and ``{name}_date``;
    both null without a close, and a request without a ticker or day has none.
    """
    day = F.to_date("ts") if "ts" in closes.columns else F.col("d")
    last = F.max_by("close", F.struct(*[c for c in ("ts", "event_id") if c in closes.columns])) if "ts" in closes.columns else F.max("close")
    daily = closes.filter(F.col("ticker").isNotNull()).groupBy("ticker", day.alias("d")).agg(last.alias("close"))
    asked = requests.filter(F.col("ticker").isNotNull() & F.col("d").isNotNull()).select("ticker", F.col("d").cast("date").alias("d")).distinct()
    none = F.lit(None).cast(daily.schema["close"].dataType)
    both = asked.select("ticker", "d", none.alias("close"), F.lit(0 if strict else 1).alias("k")).unionByName(daily.select("ticker", "d", "close", F.lit(1 if strict else 0).alias("k")))
    priced = F.when(F.col("close").isNotNull(), F.struct("close", "d"))
    rows = both.withColumn("span", F.floor(F.unix_date("d") / SPAN_DAYS).cast("int")).withColumn("seen", priced)
    earlier = carry(rows, ["ticker"], "span", {"kept": F.max_by("seen", F.when(F.col("seen").isNotNull(), F.col("d")))}, lambda c: F.last(c, ignorenulls=True))
    order = W.partitionBy("ticker", "span").orderBy("d", "k").rowsBetween(W.unboundedPreceding, 0)
    here = rows.withColumn("here", F.last("seen", ignorenulls=True).over(order)).filter(F.col("k") == (0 if strict else 1)).filter("close IS NULL")
    got = here.join(earlier, ["ticker", "span"], "left").select("ticker", F.col("d").alias("_day"), F.coalesce("here", "kept").alias("seen"))
    fresh = F.lit(True) if days is None else F.datediff("_day", "seen.d") <= days
    found = got.filter(fresh).select("ticker", "_day", F.col("seen.close").alias("_close"), F.col("seen.d").alias("_close_date"))
    rest = [c for c in requests.columns if c not in ("ticker", "d")]
    asking = requests.withColumn("_day", F.col("d").cast("date"))
    return asking.join(found, ["ticker", "_day"], "left").select("ticker", "d", *rest, F.col("_close").alias(name), F.col("_close_date").alias(f"{name}_date"))


def to_euro(priced: DataFrame, rates: DataFrame, days: int = 5) -> DataFrame:
    """Closes in euro, by the rate ``EUR<currency>=X`` on the close's own date or up to ``days`` before; without a rate there is no price. Six digits, half to even."""
    asked = priced.filter("currency <> 'EUR' AND close IS NOT NULL").select(F.concat(F.lit("EUR"), "currency", F.lit("=X")).alias("ticker"), F.col("close_date").alias("d")).distinct()
    got = asof_close(asked.withColumn("_", F.lit(1)), rates, days, name="rate").select(F.col("ticker").alias("pair"), F.col("d").alias("close_date"), "rate")
    rows = priced.withColumn("pair", F.concat(F.lit("EUR"), "currency", F.lit("=X"))).join(got, ["pair", "close_date"], "left")
    return rows.withColumn("close_eur", F.when(F.col("currency") == "EUR", F.col("close")).otherwise(F.bround(F.try_divide("close", "rate"), 6).cast("decimal(18,6)"))).drop("pair")


def premium(offer: Column, reference: Column, low: float = -0.5, high: float = 2.0) -> Column:
    """(offer - reference) / reference to 4 digits; null outside the gate."""
    p = F.try_divide(offer - reference, reference)
    return F.when(p.between(low, high), F.bround(p, 4))


def mixed_total(cash: Column, ratio: Column, close: Column) -> Column:
    """Cash (none: 0) plus shares, 4 digits, half to even."""
    return F.bround(F.coalesce(cash, F.lit(0).cast("decimal(18,6)")) + ratio * close, 4)


def recalculate_totals(deals: DataFrame, legs: DataFrame, closes: DataFrame) -> DataFrame:
    """Totals of ``suspect_mixed`` deals with their legs (deal_id, cash_eur, share_ratio, acquirer_ticker), from the acquirer's close on the business day before. Without a close a deal stays as it is, marked ``miss``."""
    rows = deals.filter("offer_price_quality_flag = 'suspect_mixed'").join(legs, F.col("id") == F.col("deal_id")).drop("id")
    asked = rows.select(F.col("acquirer_ticker").alias("ticker"), prev_business_day(F.col("announcement_date")).alias("d"), "deal_id", "cash_eur", "share_ratio", "offer_price_quality_flag")
    got = asof_close(asked, closes)
    total = mixed_total(F.col("cash_eur"), F.col("share_ratio"), F.col("close"))
    hit = total.isNotNull()
    return got.select(
        "deal_id", total.alias("offer_price_total_eur"), F.when(hit, "verified_mixed").otherwise(F.col("offer_price_quality_flag")).alias("offer_price_quality_flag"),
        F.when(hit, "yfinance_enriched").otherwise("parser_only").alias("pricing_source"), F.when(hit, "updated").otherwise("miss").alias("action"),
    )


def resolve_venues(keys: DataFrame, listings: DataFrame) -> DataFrame:
    """The venue and ticker of each ISIN, from its equity listings (isin, pos, ticker, exch, security_type, market_sector, composite).

    A country's venues in their order come first; without one, the first listing of the composite with the most
    listings (ties to the one seen first). An unknown venue has no ticker. Flags: home_venue, growth, venue_fallback,
    unknown_exch, no_match.
    """
    equity = listings.filter((F.col("security_type").isin("Common Stock", "REIT")) & (F.col("market_sector") == "Equity") & F.col("ticker").isNotNull() & F.col("exch").isNotNull())
    rank = F.array_position(lookup_list(HOME_VENUES, F.substring("isin", 1, 2)), F.col("exch"))
    per = W.partitionBy("isin", "composite")
    rows = equity.withColumn("rank", F.when(rank > 0, rank)).withColumn("n", F.count("*").over(per)).withColumn("seen", F.min("pos").over(per))
    order = W.partitionBy("isin").orderBy(F.col("rank").asc_nulls_last(), F.desc("n"), "seen", "pos")
    best = rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("isin", "exch", "composite", F.col("ticker").alias("local"), "rank")
    got = keys.join(best, "isin", "left").withColumn("trading_ticker", venue_ticker(F.col("local"), F.col("exch")))
    flag = (
        F.when(F.col("local").isNull(), "no_match").when(F.col("trading_ticker").isNull(), "unknown_exch").when(F.col("rank").isNull(), "venue_fallback")
        .when(F.col("exch").isin(*GROWTH_VENUES), "growth").otherwise("home_venue")
    )
    return got.withColumn("flag", flag).withColumn("symbol", broker_symbol(F.col("trading_ticker"))).drop("local", "rank")


def lookup_list(mapping: dict[str, list[str]], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]), key), F.array().cast("array<string>"))


#: Outcomes of processing that a ticker backfill must not overwrite.
KEPT_FLAGS = ("no_price", "out_of_bounds", "manual_review")


def write_resolution(deals: DataFrame, resolved: DataFrame, only_unset: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals with the flag set (``not_isin`` without an ISIN) and the ticker where resolved. ``only_unset`` leaves deals with a flag alone; a flag in ``keep`` stays even where the ticker is filled."""
    got = deals.join(resolved.select("isin", F.col("trading_ticker").alias("_t"), F.col("flag").alias("_f")), "isin", "left")
    new = F.when(F.col("isin").isNull(), "not_isin").otherwise(F.coalesce("_f", F.lit("no_match")))
    open_ = F.col("ticker_resolution_flag").isNull() if only_unset else ~F.coalesce(F.col("ticker_resolution_flag"), F.lit("")).isin(*keep or ("",)) | F.col("ticker_resolution_flag").isNull()
    ticker = F.when(F.col("ticker_resolution_flag").isNull() | F.lit(not only_unset), F.coalesce("_t", "ticker")).otherwise(F.col("ticker"))
    return got.withColumn("ticker", ticker).withColumn("ticker_resolution_flag", F.when(open_, new).otherwise(F.col("ticker_resolution_flag"))).drop("_t", "_f")


def broker_contracts(deals: DataFrame, manual: DataFrame) -> DataFrame:
    """A deal's contract: its stored symbol, else the hand-made map (name, symbol, exchange) by normalised name, else its ISIN, else none."""
    named = manual.select(normalise_name(F.col("name")).alias("k"), F.col("symbol").alias("m_symbol"), F.col("exchange").alias("m_exchange")).dropDuplicates(["k"])
    got = deals.withColumn("k", normalise_name(F.col("target_name"))).join(named, "k", "left").drop("k")
    none = F.lit(None).cast("string")
    row = lambda s, e, i, w: F.struct(s.alias("symbol"), e.alias("exchange"), i.alias("isin"), F.lit(w).alias("source"))
    pick = F.coalesce(
        F.when(F.col("symbol").isNotNull(), row(F.col("symbol"), F.col("exchange"), none, "cache")), F.when(F.col("m_symbol").isNotNull(), row(F.col("m_symbol"), F.col("m_exchange"), none, "manual")),
        F.when(F.col("isin").isNotNull(), row(none, none, F.col("isin"), "isin")),
    )
    return got.withColumn("contract", pick).drop("m_symbol", "m_exchange")


def curated_tickers(keys: DataFrame, curated: DataFrame, denied: DataFrame, bare: bool = False) -> DataFrame:
    """Tickers of a hand-made map (isin, ticker) but for denied ISINs; with ``bare``, an unmapped ISIN stands for itself."""
    got = keys.join(denied.select("isin", F.lit(True).alias("denied")).distinct(), "isin", "left").join(curated.select("isin", F.col("ticker").alias("curated")), "isin", "left")
    found = F.coalesce("curated", F.col("isin")) if bare else F.col("curated")
    return got.withColumn("resolved_ticker", F.when(F.col("denied").isNull(), found)).drop("denied", "curated")


def premium_backfill(deals: DataFrame, closes: DataFrame) -> DataFrame:
    """Premiums of labelled deals: the close of the business day before, the gated premium, and what became of each deal."""
    asked = deals.filter("completion_label IS NOT NULL").select(F.col("id").alias("deal_id"), "ticker", prev_business_day(F.col("announcement_date")).alias("d"), "offer_price")
    got = asof_close(asked, closes)
    p = premium(F.col("offer_price"), F.col("close"))
    action = F.when(F.col("close").isNull(), "no_price").when(F.col("offer_price").isNull(), "no_offer").when(p.isNull(), "out_of_bounds").otherwise("applied")
    return got.select("deal_id", F.col("close").alias("reference_price"), F.col("close_date").alias("reference_date"), p.alias("premium_pct"), action.alias("action"))


#: Resolutions that are good enough for a price.
PRICED_FLAGS = ("home_venue", "venue_fallback")


def premium_from_isin(deals: DataFrame, listings: DataFrame, closes: DataFrame) -> DataFrame:
    """Labelled deals with an ISIN and no resolution flag yet, from the ISIN to the premium; one row per deal that was due.

    An ISIN of the wrong form ends as ``not_isin``; one that is resolved to a growth venue, an unknown one or none
    keeps that flag and isn't priced; without a close in the five days up to the business day before the announcement
    it is ``no_price_data``; a premium outside the gate is ``premium_out_of_bounds`` and stays null, while the reference
    price is kept. A deal without an offer price has a reference price and no premium. Deals with a flag aren't due, so
    a second run does nothing. Each ISIN is resolved once.
    """
    due = deals.filter("completion_label IS NOT NULL AND isin IS NOT NULL AND ticker_resolution_flag IS NULL").select(F.col("id").alias("deal_id"), "isin", "announcement_date", "offer_price")
    keys = due.filter(is_isin(F.col("isin"))).select("isin").distinct()
    found = resolve_venues(keys, listings).select("isin", "trading_ticker", F.col("flag").alias("_found"))
    rows = due.join(found, "isin", "left").withColumn("ticker", F.when(F.col("_found").isin(*PRICED_FLAGS), F.col("trading_ticker")))
    got = asof_close(rows.withColumn("d", prev_business_day(F.col("announcement_date"))), closes)
    off = F.try_divide(F.col("offer_price") - F.col("close"), "close")
    flag = (
        F.when(~is_isin(F.col("isin")), "not_isin").when(F.col("ticker").isNull(), F.coalesce("_found", F.lit("no_match"))).when(F.col("close").isNull(), "no_price_data")
        .when(~off.between(-0.5, 2.0), "premium_out_of_bounds").otherwise(F.col("_found"))
    )
    priced = F.col("close").isNotNull()
    return got.select(
        "deal_id", "isin", "trading_ticker", flag.alias("flag"), F.col("close").alias("reference_price"), F.when(priced, F.col("d")).alias("target_date"), F.col("close_date").alias("effective_date"),
        premium(F.col("offer_price"), F.col("close")).alias("premium_pct"),
    )


def stale_keys(wanted: DataFrame, cache: DataFrame, now, days: int = 30, batch: int = 100) -> DataFrame:
    """Keys without a cache row of the last ``days``, once each, in batches of ``batch`` for an outside service."""
    fresh = cache.filter(F.col("fetched_at") > F.lit(now) - F.make_dt_interval(F.lit(days))).select("key").distinct()
    rows = wanted.select("key").filter("key IS NOT NULL").distinct().join(fresh, "key", "left_anti")
    return number_rows(rows, "key").select("key", F.ceil(F.col("n") / batch).cast("int").alias("batch"))


def validate_small_caps(chosen: DataFrame, closes: DataFrame) -> DataFrame:
    """Deals (deal_id, ticker, d, offer_price) against the close of the business day before: deviation, flag and reason. ``pos`` is the place in the report: verified ones first, then by the size of the deviation, those without one last."""
    from bidframe.functions.filings import deviation_flag

    got = asof_close(chosen.withColumn("d", prev_business_day(F.col("d"))), closes)
    judged = deviation_flag(F.col("offer_price"), F.col("ticker"), F.col("close"))
    off = F.bround(F.try_divide(F.col("offer_price") - F.col("close"), "close"), 4).cast("double")
    rows = got.select("deal_id", "ticker", "offer_price", "close", off.alias("deviation"), judged["flag"].alias("flag"), judged["reason"].alias("reason"))
    placed = rows.withColumn("_rest", F.coalesce(F.col("flag") != "verified_cash", F.lit(True))).withColumn("_size", F.coalesce(F.abs("deviation"), F.lit(float("inf"))))
    return number_rows(placed, "_rest", name="pos", then=("_size", "deal_id")).drop("_rest", "_size")


def shared_letters(a: Column, b: Column) -> Column:
    """How many letters two texts have in common, each as often as in the one that has it less: no order of matching blocks can have more."""
    letters = F.array_distinct(F.split(a, ""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def identity_check(pairs: DataFrame, stop: list[str], least: float = 0.6) -> DataFrame:
    """``pairs(key, target_name, listed_name)``: CONFIRM if the sorted words are alike by ``least`` or share a word of 5 letters, else REJECT; no_data without a listed name, no_ticker without a key.

    The likeness is the matching-blocks ratio, twice the matched letters by all letters. ``decided_by`` says what a
    verdict rests on: a shared ``word``; ``equal`` texts; a ``bound``, where even all letters in common, in any order,
    are too few; or the ``ratio`` itself, which only the distinct pairs that are left need. ``ratio`` is null for others.
    """
    from bidframe.functions.names import name_tokens

    t, n = name_tokens(F.col("target_name"), stop), name_tokens(F.col("listed_name"), stop)
    joined = lambda x: F.array_join(F.array_sort(x), " ")
    rows = pairs.withColumns({"_a": joined(t), "_b": joined(n), "_word": F.coalesce(F.exists(F.array_intersect(t, n), lambda w: F.length(w) >= 5), F.lit(False))})
    whole = F.length("_a") + F.length("_b")
    most = F.when(whole > 0, 2 * shared_letters(F.col("_a"), F.col("_b")) / whole).otherwise(1.0)
    known = F.col("key").isNotNull() & F.col("listed_name").isNotNull() & F.col("target_name").isNotNull()
    by = F.when(~known, None).when(F.col("_word"), "word").when(F.col("_a") == F.col("_b"), "equal").when(most < least, "bound").otherwise("ratio")
    rows = rows.withColumn("decided_by", by)
    open_ = rows.filter("decided_by = 'ratio'").select("_a", "_b").distinct().withColumn("_ratio", exact_identity_ratio()("_a", "_b"))
    rows = rows.join(open_, ["_a", "_b"], "left")
    hit = F.col("decided_by").isin("word", "equal") | (F.col("_ratio") >= least)
    verdict = F.when(F.col("key").isNull(), "no_ticker").when(F.col("listed_name").isNull(), "no_data").when(hit, "CONFIRM").otherwise("REJECT")
    return rows.select(*pairs.columns, F.when(F.col("decided_by") == "ratio", F.round("_ratio", 4)).alias("ratio"), "decided_by", verdict.alias("verdict"))


def exact_identity_ratio():
    """Pandas UDF: the matching-blocks ratio of two strings, exactly."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    return ratio


def clean_quote(price: Column) -> Column:
    """NaN, zero and negative quotes to null."""
    x = price.cast("double")
    return F.when((x > 0) & ~F.isnan(x), x)


def mid_quote(bid: Column, ask: Column) -> Column:
    return (clean_quote(bid) + clean_quote(ask)) / 2


#: Statuses of a probed row that has an ISIN and no ticker.
UNRESOLVED = ("no_ticker", "no_match", "unknown_exch")


def price_probe(sample: DataFrame, closes: DataFrame) -> DataFrame:
    """Status and premium preview of sampled deals (deal_id, isin, ticker, d, offer_price), with outliers marked.

    With a column ``flag`` (of ``resolve_venues``) a row without a ticker is ``no_match`` or ``unknown_exch``, else
    ``no_ticker``; a resolved row without a day is ``resolved_no_date``. The preview is a fraction; beyond the premium
    gate it is an outlier.
    """
    got = asof_close(sample.withColumn("d", prev_business_day(F.col("d"))), closes)
    missing = F.when(F.coalesce("flag", F.lit("no_match")) == "no_match", "no_match").otherwise("unknown_exch") if "flag" in sample.columns else F.lit("no_ticker")
    status = F.when(F.col("isin").isNull(), "no_isin").when(F.col("ticker").isNull(), missing).when(F.col("d").isNull(), "resolved_no_date").when(F.col("close").isNull(), "no_price").otherwise("ok")
    off = F.try_divide(F.col("offer_price") - F.col("close"), "close")
    ok = status == "ok"
    return got.select("deal_id", "isin", status.alias("status"), F.when(ok, F.bround(off, 4)).alias("premium_preview"), (ok & F.coalesce(~off.between(-0.5, 2.0), F.lit(False))).alias("outlier"))


def probe_rates(probed: DataFrame) -> DataFrame:
    """Resolution rate among rows with an ISIN and priced rate of all, one row."""
    return probed.agg(
        F.round(F.avg(F.when(F.col("isin").isNotNull(), (~F.col("status").isin(*UNRESOLVED)).cast("double"))), 6).alias("resolution_rate"), F.round(F.avg((F.col("status") == "ok").cast("double")), 6).alias("priced_rate"),
    )
