"""Structured Streaming forms of ingestion, bars, dedup, ledger and budget."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from bidframe.operators.bars import price_bars
from bidframe.operators.ledger import threshold_crossings


def read_landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream over landed files, each read once."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def run_available(writer, checkpoint: str):
    """Everything landed so far, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state per key in RocksDB, on disk rather than in memory."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    had = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def ingest(filings: DataFrame, target: str, checkpoint: str, key: list[str], order: list[str], known: DataFrame | None = None):
    """Append filings whose key hasn't come yet, once each, to parquet files in ``target``, a folder per batch.

    The keys are state of the stream, each with its row, so a batch reads its own rows and never the target; a batch
    that runs again after a failure writes the same folder again. Of a key's rows in its first batch the least by
    ``order`` is kept, later rows of it go: a key is new if it first came at this batch's time. ``known`` has keys that
    are there before the stream begins; each batch is held against it.
    """
    rows = filings
    if known is not None:
        had = known.select(*[F.col(k).alias(f"_known_{k}") for k in key]).distinct()
        rows = rows.join(had, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in key]), "left_anti")
    rows = rows.select(*[F.col(k).alias(f"_key_{k}") for k in key], F.struct(*filings.columns).alias("_row"), F.current_timestamp().alias("_at"))
    first = rows.groupBy(*[f"_key_{k}" for k in key]).agg(F.min_by("_row", F.struct("_at", *[f"_row.{c}" for c in order])).alias("_row"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))

    def put(batch: DataFrame, number: int) -> None:
        batch.filter("_first = _last").select("_row.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    with keyed_state(filings.sparkSession):
        return run_available(first.writeStream.outputMode("update").foreachBatch(put), checkpoint)


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Price bars kept current; ticks later than the watermark are dropped. Daily bars look back 7 days."""
    return price_bars(ticks.withWatermark("ts", late), width)


def write_bars(stream: DataFrame, target: str, checkpoint: str):
    """Keep bars in ``target``, a folder per day and version. A batch reads and rewrites the days it has bars of, whole, as a new version; ``_days/batch=n`` says which version of each day holds after batch n. A batch that runs again writes the same folders again, and readers see whole versions only."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date("bucket")).persist()
        days = new.select("day").distinct()
        held = spark.read.parquet(f"{target}/_days/batch={number - 1}") if number else days.limit(0).withColumn("version", F.lit(0))
        old = bars_of(spark, target, held.join(days, "day", "left_semi"), new.schema)
        kept = old.join(new.select("ticker", "bucket"), ["ticker", "bucket"], "left_anti")
        new.unionByName(kept).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{target}/version={number}")
        held.join(days, "day", "left_anti").unionByName(days.withColumn("version", F.lit(number))).coalesce(1).write.mode("overwrite").parquet(f"{target}/_days/batch={number}")
        new.unpersist()

    return run_available(stream.writeStream.outputMode("update").foreachBatch(put), checkpoint)


def bars_of(spark: SparkSession, target: str, held: DataFrame, schema: StructType | None = None) -> DataFrame:
    """The bars of the days and versions in ``held(day, version)``; there are as many as days, whatever the number of bars."""
    paths = [f"{target}/version={r.version}/day={r.day}" for r in held.collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*paths).withColumn("day", F.to_date("bucket"))


def current_bars(spark: SparkSession, target: str, batch: int) -> DataFrame:
    """The bars as they stand after batch number ``batch``."""
    return bars_of(spark, target, spark.read.parquet(f"{target}/_days/batch={batch}")).drop("day")


def dedup_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """One event per deal, type and link within the watermark. Events without a link are never duplicates; they go round the state."""
    rows = events.withWatermark("ts", late).withColumn("source_url", F.nullif("source_url", F.lit("")))
    linked = rows.filter("source_url IS NOT NULL").dropDuplicatesWithinWatermark(["deal_id", "event_type", "source_url"])
    return linked.unionByName(rows.filter("source_url IS NULL"))


#: Groups of deals that share a state, so that a call of Python and its reads and writes serve many deals.
DEAL_GROUPS = 1024


class PositionFold(StatefulProcessor):
    """Open positions of a group of deals: BUYs add to a deal's position, a SELL closes it and gives one row.

    Fills wait until the watermark has passed them, so that no earlier one can come, and are then folded in the order
    of time and trade. A timer at the first waiting fill wakes the group. Fills that came together are one state row,
    as JSON, and so are the group's positions; a state row per fill cost more than the fold.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("positions", "rows string")
        self.waiting = handle.getListState("waiting", "rows string")

    def wake_at(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for part in rows:
            new += zip(*[part[c].astype(kind).tolist() for c, kind in (("at", int), ("trade_id", int), ("side", object), ("price", float), ("quantity", float), ("deal", object))])
        if new:
            self.waiting.appendValue((json.dumps(new),))
            self.wake_at(min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fills = sorted((r for some in self.waiting.get() for r in json.loads(some[0])), key=lambda r: r[:5])
        later = [r for r in fills if r[0] > passed]
        if len(later) < len(fills):
            out = self.fold(fills[: len(fills) - len(later)])
            if later:
                self.waiting.put([(json.dumps(later),)])
                self.wake_at(later[0][0])
            else:
                self.waiting.clear()
            if out:
                yield pd.DataFrame(out, columns=["deal", "epoch", "open_at", "close_at", "entry_price", "exit_price", "size_eur", "pnl_eur"])

    def fold(self, fills: list[list]) -> list[tuple]:
        held = {deal: state for deal, *state in json.loads(self.state.get()[0])} if self.state.exists() else {}
        out = []
        for at, _, side, price, quantity, deal in fills:
            size, weighted, opened, epoch = held.get(deal) or (0.0, 0.0, None, 0)
            if side == "BUY":
                held[deal] = (size + price * quantity, weighted + price * price * quantity, at if opened is None else opened, epoch)
                continue
            if size > 0:
                entry = weighted / size
                out.append((deal, epoch, opened, at, round(entry, 6), round(price, 6), round(size, 4), round((price / entry - 1) * size, 4)))
            held[deal] = (0.0, 0.0, None, epoch + 1)
        self.state.update((json.dumps([(deal, *state) for deal, state in held.items()]),))
        return out

    def close(self) -> None:
        pass


_FOLDED = "deal string, epoch int, open_at bigint, close_at bigint, entry_price double, exit_price double, size_eur double, pnl_eur double"
POSITION_ROW = "deal_id bigint, epoch int, open_ts timestamp, close_ts timestamp, entry_price double, exit_price double, size_eur double, pnl_eur double"


def closed_positions(fills: DataFrame, late: str = "1 hour", groups: int = DEAL_GROUPS) -> DataFrame:
    """Positions as they are closed by a stream of fills that come up to ``late`` after later ones; the batch form is ``ledger.positions``. What happened in the last ``late`` before the newest fill still waits. Deals are kept in ``groups`` by hash; a running stream can't change their number."""
    deal = F.col("deal_id").cast("string").alias("deal")  # a null stays a null in pandas
    rows = fills.withWatermark("ts", late).select(F.pmod(F.xxhash64("deal_id"), F.lit(groups)).alias("group"), deal, "ts", F.unix_micros("ts").alias("at"), "trade_id", "side", F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"))
    closed = rows.groupBy("group").transformWithStateInPandas(PositionFold(), outputStructType=_FOLDED, outputMode="Append", timeMode="EventTime")
    return closed.select(F.col("deal").cast("bigint").alias("deal_id"), "epoch", F.timestamp_micros("open_at").alias("open_ts"), F.timestamp_micros("close_at").alias("close_ts"), "entry_price", "exit_price", "size_eur", "pnl_eur")


def budget_alerts(usage: DataFrame, totals: str, checkpoint: str, budget: float, alert: Callable[[DataFrame, int], None]):
    """Hand each batch's threshold crossings to ``alert``. ``totals`` keeps the credits per vendor and month after each batch, so a batch reads its own usage and the totals before it; one that runs again writes the same."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spent = spark.read.parquet(f"{totals}/batch={number - 1}") if number else None
        alert(threshold_crossings(batch, budget, spent=spent), number)
        used = batch.select("vendor", "year_month", F.col("credits_cost").cast("bigint").alias("credits"))
        every = used if spent is None else used.unionByName(spent)
        every.groupBy("vendor", "year_month").agg(F.sum("credits").alias("credits")).write.mode("overwrite").parquet(f"{totals}/batch={number}")

    return run_available(usage.writeStream.foreachBatch(put), checkpoint)
