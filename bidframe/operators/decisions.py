"""From priced candidates to sized trades and order legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidframe.operators.ordering import number_rows

#: Fixed values of sizing and admission.
KELLY_SHARE, MOST_OF_CAPITAL, LEAST_EUR, MOST_POSITIONS = 0.15, 0.12, 1000.0, 5
BREAK_LOSS, CAPITAL_FLOOR, CAPITAL_CAP = 0.15, 50_000.0, 2_000_000.0
OFFSET_QUOTED, OFFSET_LAST, LEAST_SPREAD, STOP_LOSS, LEAST_STARS = 0.001, 0.004, 0.01, 0.10, 3


def stars(p: Column) -> Column:
    """1 to 5, by 0.3, 0.5, 0.7 and 0.85."""
    return F.when(p < 0.3, 1).when(p < 0.5, 2).when(p < 0.7, 3).when(p < 0.85, 4).otherwise(5)


def call(p: Column) -> Column:
    return F.when(p >= 0.7, "enter").when(p >= 0.5, "wait").otherwise("skip")


def star_badge(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def status_label(label: Column, status: Column) -> Column:
    """The label's word, else the status."""
    return F.when(label == 1, "closed").when(label == 0, "failed").otherwise(F.coalesce(status, F.lit("unknown")))


def reference_price(bid: Column, ask: Column, last: Column, jurisdiction: Column) -> Column:
    """Mid, or last for IT; the other where it is missing or zero."""
    some = lambda x: F.when(x != 0, x)
    mid = (bid + ask) / 2
    return F.when(jurisdiction == "IT", F.coalesce(some(last), mid)).otherwise(F.coalesce(some(mid), last))


def entry_limit(reference: Column, jurisdiction: Column) -> Column:
    return reference * (1.0 + F.when(jurisdiction == "IT", OFFSET_LAST).otherwise(OFFSET_QUOTED))


def kelly(p: Column, gain: Column) -> Column:
    """(raw, fractional, share of capital); zeros without a gain."""
    raw = F.when(gain > 0, (p * gain - (1.0 - p) * BREAK_LOSS) / gain).otherwise(0.0)
    return F.struct(raw.alias("kelly_raw"), (raw * KELLY_SHARE).alias("kelly_fractional"), F.greatest(F.lit(0.0), F.least(F.lit(MOST_OF_CAPITAL), raw * KELLY_SHARE)).alias("position_pct"))


def size_position(p: Column, gain: Column, price: Column, capital: Column, held: Column) -> Column:
    """(reason, size_qty, size_eur, position_pct, kelly_fractional, capital): the first refusal of position_cap, bad_price, no_edge and below_min, else ok with whole pieces."""
    k = kelly(p, gain)
    cap = F.greatest(F.least(capital, F.lit(CAPITAL_CAP)), F.lit(CAPITAL_FLOOR))
    eur = k["position_pct"] * cap
    pieces = F.when(price > 0, F.floor(eur / price)).otherwise(0)
    reason = (
        F.when(held >= MOST_POSITIONS, "position_cap").when(price <= 0, "bad_price").when(k["position_pct"] <= 0, "no_edge")
        .when((eur < LEAST_EUR) | (pieces < 1), "below_min").otherwise("ok")
    )
    return F.struct(
        reason.alias("reason"), F.when(reason == "ok", pieces).otherwise(0).cast("long").alias("size_qty"), F.when(reason == "ok", pieces * price).when(reason == "below_min", eur).otherwise(0.0).alias("size_eur"),
        F.when(reason.isin("ok", "below_min"), k["position_pct"]).otherwise(0.0).alias("position_pct"), F.when(reason.isin("ok", "below_min", "no_edge"), k["kelly_fractional"]).otherwise(0.0).alias("kelly_fractional"), cap.alias("capital"),
    )


def decide(candidates: DataFrame, ramp_up: int = 10) -> DataFrame:
    """A decision per candidate (deal_id, juridiction, offer_price, p_completion, score_stars, bid, ask, last, net_liquidation, open_positions, rampup_validated), with the reason where there is none."""
    offer, p = F.col("offer_price").cast("double"), F.col("p_completion").cast("double")
    ref = reference_price(F.col("bid"), F.col("ask"), F.col("last"), F.col("juridiction"))
    rows = candidates.withColumn("reference", ref).withColumn("spread", F.try_divide(offer - F.col("reference"), "reference")).withColumn("limit_raw", entry_limit(F.col("reference"), F.col("juridiction")))
    rows = rows.withColumn("s", size_position(p, F.col("spread"), F.col("limit_raw"), F.col("net_liquidation"), F.col("open_positions")))
    reason = (
        F.when(F.col("score_stars") < LEAST_STARS, "low_stars").when(offer.isNull() | (offer <= 0), "no_offer").when(F.col("reference").isNull() | (F.col("reference") <= 0), "no_price")
        .when(F.col("spread") < LEAST_SPREAD, "thin_spread").otherwise(F.col("s.reason"))
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    return rows.select(
        "deal_id", "juridiction", "score_stars", "reason", F.when(ok, F.col("s.size_qty")).alias("quantity"), F.when(ok, F.bround("limit_raw", 4)).alias("limit_price"), F.when(ok, F.bround(F.col("limit_raw") * (1.0 - STOP_LOSS), 4)).alias("stop_loss_price"),
        F.when(ok, F.bround(offer, 4)).alias("take_profit_price"), F.bround("spread", 6).alias("expected_return_pct"), F.bround("s.kelly_fractional", 6).alias("kelly_fractional_pct"), F.bround("s.position_pct", 6).alias("position_pct"),
        F.when(ok, F.col("rampup_validated") < ramp_up).alias("requires_approval"),
        F.when(ok, F.format_string("p=%.2f, spread=%.1f%%, %d@%.2f", p, F.col("spread") * 100, F.col("s.size_qty"), F.col("limit_raw"))).alias("rationale"),
    )


def tick(price: Column, size: float = 0.01) -> Column:
    return F.bround(F.bround(price / size) * size, 4)


def order_legs(trades: DataFrame, size: float = 0.01) -> DataFrame:
    """Legs of (parent_id, quantity, limit_price, stop_loss_price, take_profit_price): buy limit, sell stop, and sell limit if there is a target. Degenerate brackets give no legs; the last leg transmits."""
    rows = trades.withColumn("e", tick(F.col("limit_price"), size)).withColumn("s", tick(F.col("stop_loss_price"), size)).withColumn("t", tick(F.col("take_profit_price"), size))
    rows = rows.filter((F.col("quantity") > 0) & (F.col("limit_price") > 0) & (F.col("s") > 0) & (F.col("s") < F.col("e")) & (F.col("t").isNull() | (F.col("t") > F.col("e"))))
    none, n = F.lit(None).cast("double"), F.col("parent_id")

    def leg(k, action, kind, limit, stop, sends):
        return F.struct((n + k).alias("order_id"), F.when(F.lit(k > 0), n).otherwise(0).alias("parent"), F.lit(action).alias("action"), F.lit(kind).alias("order_type"), limit.alias("limit"), stop.alias("stop"), sends.alias("transmit"))

    target = F.col("t").isNotNull()
    legs = F.array(leg(0, "BUY", "LMT", F.col("e"), none, F.lit(False)), leg(1, "SELL", "STP", none, F.col("s"), ~target), leg(2, "SELL", "LMT", F.col("t"), none, F.lit(True)))
    return rows.select(F.explode(F.slice(legs, F.lit(1), F.when(target, 3).otherwise(2))).alias("leg"), "quantity").select("leg.*", "quantity")


def daily_cycle(decisions: DataFrame, cooldown_min: int = 60, ramp_up: int = 10) -> DataFrame:
    """The day's candidates, in order, as a fold: each decision meets the position cap, the approval gate and the cooldown.

    Rows: run_day, seq, at (timestamp), ok (it is a decision), open_positions and rampup_validated at the day's start,
    halted (kill switch or daily loss). No day is held whole: only a submit changes what later candidates meet, and the
    position cap lets a day have few, so each pass over the rows finds every day's next submit. A missing count of open
    positions, or one below zero, is none. Candidates alike in all columns are told apart by a number.
    """
    told = decisions.select("run_day", "seq", "deal_id", F.unix_timestamp("at").alias("at"), "ok")
    alike = told.groupBy(*told.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = alike.select("run_day", "seq", F.struct("seq", "deal_id", "at", "ok", "copy").alias("row"))
    days = decisions.groupBy("run_day").agg(F.max("open_positions").alias("held"), F.max("rampup_validated").alias("ramp"), F.max("halted").alias("halted"))
    days = days.filter("NOT halted").select(F.col("run_day").alias("day"), F.greatest(F.coalesce(F.col("held").cast("int"), F.lit(0)), F.lit(0)).alias("held"), (F.col("ramp") < ramp_up).alias("gated"))

    def cold(row, last):
        return F.coalesce(row["at"] - last["at"] < cooldown_min * 60, F.lit(False))

    same, last = F.col("run_day").eqNullSafe(F.col("day")), F.try_element_at("sent", F.lit(-1))
    state = days.withColumn("sent", F.array().cast(f"array<{rows.schema['row'].dataType.simpleString()}>"))
    for _ in range(MOST_POSITIONS):
        free = state.filter((F.col("held") + F.size("sent") < MOST_POSITIONS) & ~F.coalesce("gated", F.lit(False)))
        after = (F.size("sent") == 0) | ((F.col("row") > last) & ~cold(F.col("row"), last))
        found = rows.filter(F.coalesce("row.ok", F.lit(True))).join(F.broadcast(free), same & after).groupBy("run_day").agg(F.min("row").alias("next"))
        state = state.join(found, same, "left").select("day", "held", "gated", F.when(F.col("next").isNull(), F.col("sent")).otherwise(F.array_append("sent", F.col("next"))).alias("sent"))

    met = number_rows(rows, "seq", ("run_day",), "n", then=("row",)).join(F.broadcast(state), same).withColumn("sent", F.filter("sent", lambda s: s < F.col("row")))
    outcome = (
        F.when(~F.col("row.ok"), "skipped").when(F.col("held") + F.size("sent") >= MOST_POSITIONS, "skipped").when(cold(F.col("row"), last), "execution_skipped")
        .when(F.col("gated"), "pending_approval").otherwise("submitted")
    )
    return met.select("run_day", (F.col("n") - 1).cast("int").alias("pos"), F.col("row.deal_id").cast("bigint").alias("deal_id"), outcome.alias("outcome"))


def fresh_pool(deals: DataFrame, scores: DataFrame, closes: DataFrame, since, least_stars: int = 3) -> DataFrame:
    """Fresh unlabelled deals with the reason why each is out, or its premium over the close of the business day before and the decision.

    Reasons in order: not_home_venue, no_offer, not_scored, low_stars, no_close, premium_out_of_bounds; else decided.
    """
    from bidframe.operators.pricing import asof_close, premium, prev_business_day
    from bidframe.operators.views import latest_score

    fresh = deals.filter((F.col("announcement_date") >= F.lit(since)) & F.col("completion_label").isNull())
    last = latest_score(scores).select("deal_id", "p_completion", "score_stars")
    rows = fresh.join(last, fresh.id == last.deal_id, "left").drop("deal_id")
    asked = rows.select("ticker", prev_business_day(F.col("announcement_date")).alias("d"), "id", "offer_price", "ticker_resolution_flag", "p_completion", "score_stars")
    got = asof_close(asked, closes).withColumn("premium", premium(F.col("offer_price"), F.col("close")))
    reason = (
        F.when(~F.col("ticker_resolution_flag").eqNullSafe("home_venue"), "not_home_venue").when(F.col("offer_price").isNull(), "no_offer").when(F.col("score_stars").isNull(), "not_scored")
        .when(F.col("score_stars") < least_stars, "low_stars").when(F.col("close").isNull(), "no_close").when(F.col("premium").isNull(), "premium_out_of_bounds").otherwise("decided")
    )
    return got.select("id", reason.alias("reason"), "premium", F.when(reason == "decided", call(F.col("p_completion"))).alias("decision"))
