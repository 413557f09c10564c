"""Streams over many batches, held against loops and batch twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from bidframe import plans
from bidframe.operators import bars, ledger
from bidframe.plans.standin import table
from bidframe.streaming import streams


def land(spark, folder, batches, schema):
    """One file a batch, read in this order."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/in/part={k}")
        time.sleep(0.01)  # files are read by their time
    return streams.read_landed(spark, f"file://{folder}/in/*", schema, files=1)


def test_ingest_reads_its_own_rows_only(spark, tmp_path):
    draw = random.Random(3)
    batches = [[("FR", f"r{draw.randrange(60)}", draw.randrange(9), k * 100 + n) for n in range(40)] for k in range(8)]
    schema = "juridiction string, regulator_ref string, day int, id int"
    run = streams.ingest(
        land(spark, tmp_path, batches, schema), f"file://{tmp_path}/out", f"file://{tmp_path}/check", ["juridiction", "regulator_ref"], ["day", "id"], spark.createDataFrame([("FR", "r1"), ("FR", "r1"), ("FR", "r2")], "juridiction string, regulator_ref string")
    )
    want, seen = [], {"r1", "r2"}
    for rows in batches:
        for ref in sorted({r[1] for r in rows} - seen):
            want.append(min((r for r in rows if r[1] == ref), key=lambda r: (r[2], r[3])))
        seen |= {r[1] for r in rows}
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("juridiction", "regulator_ref", "day", "id").collect()) == sorted(want)
    read = [p["numInputRows"] for p in run.recentProgress if p["numInputRows"]]
    assert read == [40] * 8 or sum(read) == 320  # a batch's rows, however much is there


def test_dedup_keeps_events_without_link(spark, tmp_path):
    start, draw = datetime.datetime(2024, 1, 1), random.Random(5)
    batches = [[(draw.randrange(4), draw.choice("ab"), draw.choice([None, "", "l1", "l2", "l3"]), start + datetime.timedelta(hours=k, minutes=n), k * 100 + n) for n in range(30)] for k in range(5)]
    schema = "deal_id int, event_type string, source_url string, ts timestamp, id int"
    unique = streams.dedup_events(land(spark, tmp_path, batches, schema), "40 days")
    streams.run_available(unique.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").outputMode("append"), f"file://{tmp_path}/check")
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    rows = [r for b in batches for r in b]
    assert {r.id for r in got if r.source_url is None} == {r[4] for r in rows if not r[2]}
    linked = [(r.deal_id, r.event_type, r.source_url) for r in got if r.source_url is not None]
    assert len(linked) == len(set(linked)) and set(linked) == {r[:3] for r in rows if r[2]}


def test_given_events_without_link_stay(spark, sf_dir):
    events = table(spark, sf_dir, "filing_events")
    once = events.filter("source_url IS NOT NULL").select("deal_id", "event_type", "source_url").distinct().groupBy("event_type").count()
    linked, none = {r.event_type: r["count"] for r in once.collect()}, {r.event_type: r["count"] for r in events.filter("source_url IS NULL").groupBy("event_type").count().collect()}
    got = {r.event_type: (r.n, r.n_without_link) for r in plans.QUERIES["streamed_dedup"](spark, sf_dir).collect()}
    assert got == {k: (linked[k] + none.get(k, 0), none.get(k, 0)) for k in linked}


def test_positions_with_late_fills(spark, tmp_path, sf_dir):
    """Shuffled over three batches, fills give the positions of the batch form, up to the watermark."""
    fills = table(spark, sf_dir, "fills").withColumns({"ts": F.col("ts").cast("timestamp"), "price": F.col("price").cast("double")}).filter("deal_id < 40")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fills.schema)
    rows = [tuple(r) for r in fills.collect()]
    random.Random(1).shuffle(rows)
    newest = max(r[2] for r in rows)
    with streams.keyed_state(spark):
        closed = streams.closed_positions(land(spark, tmp_path, [rows[k::3] for k in range(3)], schema), "400 days")
        streams.run_available(closed.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").outputMode("append"), f"file://{tmp_path}/check")
        # a fill of another deal, long after, lets the watermark pass
        spark.createDataFrame([(10**9, -1, newest + datetime.timedelta(days=500), "BUY", 1.0, 1)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/part=3")
        closed = streams.closed_positions(streams.read_landed(spark, f"file://{tmp_path}/in/*", schema, files=1), "400 days")
        streams.run_available(closed.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").outputMode("append"), f"file://{tmp_path}/check")
    row = lambda r: (r.deal_id, r.epoch, r.open_ts, r.close_ts)
    got = {row(r): r.pnl_eur for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {row(r): r.pnl_eur for r in ledger.positions(fills).filter("status = 'closed'").collect()}
    assert got == pytest.approx(want, abs=1e-3) and len(want) > 20


def test_positions_share_state_by_groups(spark, tmp_path, sf_dir):
    """A few state rows a group hold all deals, fills without a deal among them; positions are those of the batch form."""
    deal = F.when(F.col("deal_id") % 50 > 0, F.col("deal_id"))
    fills = table(spark, sf_dir, "fills").withColumns({"ts": F.col("ts").cast("timestamp"), "price": F.col("price").cast("double"), "deal_id": deal})
    fills.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fills.schema)
    with streams.keyed_state(spark):
        closed = streams.closed_positions(streams.read_landed(spark, f"file://{tmp_path}/in", schema), groups=8)
        run = streams.run_available(closed.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").outputMode("append"), f"file://{tmp_path}/check")
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8 * 6 < fills.select("deal_id").distinct().count()
    end = fills.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    row = lambda r: (r.deal_id, r.epoch, r.close_ts)
    want = {row(r): r.pnl_eur for r in ledger.positions(fills.filter("deal_id IS NOT NULL")).filter("status = 'closed'").filter(F.col("close_ts") < end).collect()}
    got = {row(r): r.pnl_eur for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert {k: v for k, v in got.items() if k[0] is not None} == pytest.approx(want, abs=1e-3) and len(want) > 100 and any(k[0] is None for k in got)


def test_bars_over_many_batches(spark, tmp_path, sf_dir):
    """Days that come back in later batches are rewritten, others aren't read."""
    ticks = table(spark, sf_dir, "ticks").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("close", F.col("close").cast("double"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ticks.schema)
    rows = sorted((tuple(r) for r in ticks.filter("event_id % 5 = 0").collect()), key=lambda r: r[1])
    size = len(rows) // 4 + 1
    batches = [rows[k * size : k * size + size] for k in range(4)]
    stream = streams.bars(land(spark, tmp_path, batches, schema), "1 hour", "2 days")
    run = streams.write_bars(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    key = lambda df: {(r.ticker, r.bucket): (r.open, r.high, r.low, r.close, r.volume, r.n_ticks) for r in df.collect()}
    assert key(streams.current_bars(spark, f"file://{tmp_path}/out", run.lastProgress["batchId"])) == key(bars.price_bars(ticks.filter("event_id % 5 = 0")))
    held = spark.read.parquet(f"file://{tmp_path}/out/_days/batch={run.lastProgress['batchId']}")
    assert held.count() == held.select("day").distinct().count() and held.select("version").distinct().count() > 1
