"""What the third round's review found: days folded without holding one, ties, exact roundings."""

import datetime
import random
import time

import duckdb
from pyspark.sql import functions as F

from bidframe import plans
from bidframe.functions import filings
from bidframe.operators import decisions, ledger
from bidframe.streaming import streams

DAY = datetime.date(2024, 1, 1)


def folded(rows):
    """The daily cycle as a plain loop."""
    want = []
    for day in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == day]
        held, ramp = max((r[5] for r in mine if r[5] is not None), default=0), max((r[6] for r in mine if r[6] is not None), default=None)
        if any(r[7] for r in mine):
            continue
        low = lambda x: (x is not None, x)
        last, free = None, True
        for pos, r in enumerate(sorted(mine, key=lambda r: (low(r[1]), low(r[2]), low(r[3]), low(r[4])))):
            cold = last is not None and r[3] is not None and (r[3] - last).total_seconds() < 3600
            out = "skipped" if r[4] is False or held >= 5 else "execution_skipped" if cold else "pending_approval" if ramp is not None and ramp < 10 else "submitted"
            if out == "submitted":
                held, last = held + 1, r[3]
            want.append((day, pos, r[2], out))
    return want


def test_daily_cycle_holds_no_day(spark):
    draw = random.Random(1)
    rows = []
    for _ in range(400):
        day, at = draw.choice([None, *range(8)]), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=draw.randrange(1440))
        rows.append((None if day is None else DAY + datetime.timedelta(day), draw.choice([None, *range(60)]), draw.randrange(3), draw.choice([at, at, at, None]), draw.choice([True, True, False, None]), 0 if day is None else day % 4, 9 if day == 3 else None if day == 5 else 12, day == 7))
    rows += rows[:60]
    got = decisions.daily_cycle(spark.createDataFrame(rows, "run_day date, seq bigint, deal_id bigint, at timestamp, ok boolean, open_positions int, rampup_validated int, halted boolean"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(folded(rows), key=repr)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row has a whole day


def test_admission_of_equal_requests(spark):
    """Requests alike in seq and trade_id are told apart by what they ask for, whatever order they come in."""
    trades = spark.createDataFrame([], "trade_id bigint, deal_id bigint, status string")
    rows = [(k, k, 1, approval, resolved) for k in range(40) for approval in (True, False) for resolved in (True, False)]
    got = [
        ledger.admit_trades(spark.createDataFrame(some, "trade_id bigint, deal_id bigint, seq bigint, requires_approval boolean, resolved boolean").coalesce(1), trades).select("trade_id", "status").collect()
        for some in (rows, rows[::-1])
    ]
    assert [{tuple(r) for r in g} for g in got] == [{(k, "REJECTED") for k in range(40)}] * 2


def test_admission_sql_of_equal_requests():
    line = "SELECT k AS l_orderkey, 1 AS l_linenumber, 1 AS l_partkey, CASE WHEN k % 2 = {} THEN 'A' ELSE 'N' END AS l_returnflag, 'F' AS l_linestatus FROM range(20) t(k)"
    for first, second in ((0, 1), (1, 0)):
        con = duckdb.connect()
        con.execute(f"CREATE TABLE lineitem AS {line.format(first)} UNION ALL {line.format(second)}")
        con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT)")
        assert {r[2] for r in con.execute(plans.ORACLE["trade_admission"]).fetchall()} == {"REJECTED"}


def test_report_targets_rounded_from_six_digits(spark, sf_dir, tmp_path):
    """16.215050 is half way between two prices of four digits and goes to the even one."""
    con = duckdb.connect()
    for name, change in (("orders", "REPLACE (CAST(16215.05 AS DOUBLE) AS o_totalprice)"), ("lineitem", "REPLACE (CAST(0.1 AS DOUBLE) AS l_discount, 4 AS l_partkey)")):
        con.execute(f"COPY (SELECT * {change} FROM '{sf_dir}/{name}.parquet' WHERE {name[0]}_orderkey < 600) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = plans.QUERIES["decision_reports"](spark, str(tmp_path)).select("file", "day", "body").collect()
    want = con.execute(plans.ORACLE["decision_reports"]).fetchall()
    assert {tuple(r) for r in got} == set(want) and len(got) > 20
    assert all("- target: 16.21 EUR" in r.body for r in got)


def test_texts_of_a_small_table_are_many_tasks(spark, sf_dir):
    """A table of one row group is dealt over all cores before texts are made of its rows and searched."""
    for name in ("de_filing_records", "fr_filing_records", "de_listing_scan", "it_listing_scan"):
        assert plans.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 8


def test_guarded_matches_skip_whole_matches(spark):
    text = "Nennbetrag EUR 5,00. Gegenleistung von EUR 1,00 Grundkapital; Barangebot: EUR 2,50 und Geldbetrag EUR 3,75"
    got = spark.createDataFrame([(text,), ("ohne",), (None,)], "text string").select(filings.guarded_matches(F.col("text"), filings.DE_CASH, filings.DE_PAR, 30, groups=(1, 2)).alias("m")).collect()
    assert [r.m for r in got] == [["Gegenleistung von EUR 1,00", "Geldbetrag EUR 3,75"], None, None]


def test_ingest_starts_no_python_per_key(spark, tmp_path):
    """Keys are grouped by Spark's own aggregate; null keys are one key, and a key's later batches add nothing."""
    batches = [[(None, 3, 1), (None, 2, 2), ("a", 5, 3), ("a", 5, 4), ("k", 1, 5)], [("a", 1, 6), (None, 1, 7), ("b", 9, 8)], [("b", 1, 9)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ref string, day int, id int").coalesce(1).write.parquet(f"file://{tmp_path}/in/part={k}")
        time.sleep(0.01)  # files are read by their time
    stream = streams.read_landed(spark, f"file://{tmp_path}/in/*", "ref string, day int, id int", files=1)
    run = streams.ingest(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check", ["ref"], ["day", "id"], spark.createDataFrame([("k",)], "ref string"))
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [2, 3, 8]
    assert "transformWithState" not in {o["operatorName"] for p in run.recentProgress for o in p["stateOperators"]} and any(p["stateOperators"] for p in run.recentProgress)
