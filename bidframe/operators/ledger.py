"""Trades admitted, fills folded into positions, guards and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.operators.ordering import carry

OPEN = ("PENDING", "SUBMITTED", "FILLED")


def admit_trades(requests: DataFrame, trades: DataFrame) -> DataFrame:
    """Requests (trade_id, deal_id, seq, requires_approval, resolved) that aren't yet known and whose deal has no open trade, the first per deal by seq, trade_id, requires_approval and resolved, nulls first; PENDING if they need approval, REJECTED if unresolved, else SUBMITTED."""
    new = requests.join(trades.select("trade_id").distinct(), "trade_id", "left_anti")
    free = new.join(trades.filter(F.col("status").isin(*OPEN)).select("deal_id").distinct(), "deal_id", "left_anti")
    first = free.withColumn("_n", F.row_number().over(W.partitionBy("deal_id").orderBy("seq", "trade_id", "requires_approval", "resolved"))).filter("_n = 1").drop("_n")
    return first.withColumn("status", F.when(F.col("requires_approval"), "PENDING").when(~F.col("resolved"), "REJECTED").otherwise("SUBMITTED"))


def final_status(history: DataFrame) -> DataFrame:
    """One row per trade_id: a terminal status wins over others, then the latest."""
    terminal = F.col("status").isin("FILLED", "CANCELLED", "REJECTED")
    return history.groupBy("trade_id").agg(F.max_by("status", F.struct(terminal, F.col("created_at"))).alias("status"))


def positions(fills: DataFrame) -> DataFrame:
    """Fills (deal_id, ts, trade_id, side, price, quantity) folded into positions.

    The number of SELLs before a row is its epoch: an epoch's BUYs make one position, entered at the EUR-weighted
    price, and its SELL closes it all. A SELL without a position gives nothing. SELLs are counted day by day and the
    days' counts added up, so a busy deal is as many tasks as it has days.
    """
    sold = F.when(F.col("side") == "SELL", 1).otherwise(0)
    days = fills.withColumn("_day", F.to_date("ts"))
    before = carry(days, ["deal_id"], "_day", {"_sold": F.sum(sold)}, F.sum)
    order = W.partitionBy("deal_id", "_day").orderBy("ts", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    rows = days.withColumn("_here", F.sum(sold).over(order)).join(before, ["deal_id", "_day"], "left").withColumn("epoch", F.col("_here") + F.coalesce("_sold", F.lit(0)) - sold)
    p, q, buy = F.col("price").cast("double"), F.col("quantity").cast("double"), F.col("side") == "BUY"
    g = rows.groupBy("deal_id", "epoch").agg(
        F.min(F.when(buy, F.col("ts"))).alias("open_ts"), F.max(F.when(~buy, F.col("ts"))).alias("close_ts"), F.sum(F.when(buy, p * q)).alias("size"), F.sum(F.when(buy, p * p * q)).alias("weighted"), F.max(F.when(~buy, p)).alias("exit"),
    )
    entry = F.col("weighted") / F.col("size")
    return g.filter("size > 0").select(
        "deal_id", F.col("epoch").cast("int").alias("epoch"), "open_ts", "close_ts", F.round(entry, 6).alias("entry_price"), F.round("exit", 6).alias("exit_price"), F.round("size", 4).alias("size_eur"),
        F.round((F.col("exit") / entry - 1) * F.col("size"), 4).alias("pnl_eur"), F.when(F.col("close_ts").isNull(), "open").otherwise("closed").alias("status"),
    )


def daily_loss(nlv: DataFrame, limit: float = 0.02, by: tuple[str, ...] = ("account",)) -> DataFrame:
    """Per day: the first value as baseline, and whether a later one was ``limit`` or more below it; a baseline of zero or less never breaches."""
    order = F.struct("ts", "id")
    g = nlv.groupBy(*by, F.to_date("ts").alias("day")).agg(F.min_by("net_liquidation", order).alias("baseline"), F.min("net_liquidation").alias("lowest"))
    drawdown = F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("lowest")) / F.col("baseline"))
    return g.withColumn("drawdown", F.round(drawdown, 6)).withColumn("breached", F.coalesce(drawdown >= limit, F.lit(False)))


def threshold_crossings(usage: DataFrame, budget: float, marks: tuple[float, ...] = (0.5, 0.75, 0.9), spent: DataFrame | None = None) -> DataFrame:
    """Rows at which a vendor's running credits of the month cross a mark of the budget; ``spent`` (vendor, year_month, credits) is what was used before these rows."""
    w = W.partitionBy("vendor", "year_month").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    rows = usage.withColumn("after", F.sum("credits_cost").over(w))
    if spent is not None:
        known = spent.select("vendor", "year_month", F.col("credits").alias("_spent"))
        rows = rows.join(known, ["vendor", "year_month"], "left").withColumn("after", F.col("after") + F.coalesce("_spent", F.lit(0)))
    rows = rows.withColumn("before", F.col("after") - F.col("credits_cost"))
    rows = rows.withColumn("mark", F.explode(F.array(*[F.lit(m) for m in marks])))
    return rows.filter((F.col("before") < F.col("mark") * budget) & (F.col("after") >= F.col("mark") * budget)).select("vendor", "year_month", "id", "mark", "after")


def open_count(positions: DataFrame, most: int = 5) -> DataFrame:
    """Open positions and whether the cap is reached, one row."""
    n = F.count_if(F.col("status") == "open")
    return positions.agg(n.alias("n_open"), (n >= most).alias("cap_reached"))


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Key/value rows with the latest change of each key."""
    return state.unionByName(changes).groupBy("key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))


def ramp_up_status(state: DataFrame, required: int = 10) -> DataFrame:
    value = F.max(F.when(F.col("key") == "rampup_trades_validated", F.col("value").cast("int")))
    return state.agg(F.coalesce(value, F.lit(0)).alias("validated")).withColumn("required", F.lit(required))


def decision_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows (file, day, title, written_at): the latest per file, newest day first."""
    rows = index.unionByName(new).withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy(F.desc("written_at"))))
    return rows.filter("_n = 1").drop("_n").orderBy(F.desc("day"), "file")
