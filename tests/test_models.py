"""Models and streams: invariants, and batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidframe import plans
from bidframe.operators import bars, clusters, fitting, ledger, scoring
from bidframe.plans.standin import table
from bidframe.streaming import streams


@pytest.fixture(scope="module")
def features(spark, sf_dir):
    return clusters.cluster_features(table(spark, sf_dir, "deals")).cache()


@pytest.fixture(scope="module")
def model(features):
    return scoring.ScoringModel().fit(scoring.flatten(features))


def test_scores_are_probabilities(features, model):
    rows = scoring.score_clusters(model, features).collect()
    assert len(rows) == features.count()
    assert all(0 <= r.p_completion <= 1 and 1 <= r.score_stars <= 5 and len(r.positive_factors) <= 3 and len(r.risk_factors) <= 3 for r in rows)
    assert "relative_size" not in model.numeric


def test_signal_is_learnt(spark):
    rows = spark.range(300).select(
        F.concat(F.lit("T"), F.col("id")).alias("target_name"), F.lit("FR").alias("juridiction"), F.col("id").alias("representative_deal_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("earliest_announcement"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 10) * 1.0).alias("bid_premium_pct"), F.lit(None).cast("double").alias("relative_size"), F.lit(0.5).alias("min_acceptance_threshold"), F.lit(90.0).alias("days_to_expected_close"), F.lit(1.0).alias("events_count"),
        F.lit("opa").alias("deal_type"), F.lit("cash").alias("payment_type"), F.lit("unknown").alias("target_sector"), F.when(F.col("id") % 3 == 0, "pe").otherwise("soe").alias("acquirer_type"), F.lit(False).alias("cross_border"), F.lit(False).alias("has_irrevocable_undertaking"),
        F.lit(False).alias("fdi_risk_flag"), (F.col("id") % 3 == 0).cast("int").alias("label"),
    )
    got = scoring.ScoringModel(rounds=1).fit(scoring.flatten(rows)).predict(scoring.flatten(rows)).groupBy("label").agg(F.avg("p").alias("p")).collect()
    mean = {r.label: r.p for r in got}
    assert mean[1] > 0.9 and mean[0] < 0.1


def test_refuses_few_labels(features):
    with pytest.raises(ValueError):
        scoring.ScoringModel().fit(scoring.flatten(features).limit(5))


def test_save_and_load(spark, features, model, tmp_path):
    model.save(f"file://{tmp_path}/m")
    again = scoring.ScoringModel.load(spark, f"file://{tmp_path}/m")
    a = {r.representative_deal_id: r.p for r in model.predict(scoring.flatten(features)).collect()}
    b = {r.representative_deal_id: r.p for r in again.predict(scoring.flatten(features)).collect()}
    assert a == pytest.approx(b)


def test_gaps_are_filled_until_settled(spark):
    """Where two columns fix each other, regressions find a gap's number, and the rounds end by themselves."""
    rows = spark.range(200).select(
        F.when(F.col("id") % 7 > 0, F.col("id") * 2.0 + 1).alias("bid_premium_pct"), F.when(F.col("id") % 5 != 3, F.col("id") * 1.0).alias("events_count"), F.lit(None).cast("double").alias("relative_size"), F.lit(0.5).alias("min_acceptance_threshold"),
        F.lit(None).cast("double").alias("days_to_expected_close"), "id",
    )
    columns = ["bid_premium_pct", "min_acceptance_threshold", "events_count"]
    rows = rows.withColumns({c: F.col(c).cast("double") for c in columns}).withColumn("grp", F.lit(0))
    sums = fitting.gap_sums(rows, "grp", columns)[0]
    maps = fitting.chained_maps(sums, 3, 20, 1e-3)
    moved = fitting.largest_moves(rows, "grp", {0: columns}, {0: maps})[0]
    settled = int(np.flatnonzero(moved < 1e-3 * 400)[0]) + 1
    assert len(maps) == 21 and settled < 20
    model = scoring.ScoringModel()
    model.set_numbers(sums, columns, maps[settled])
    got = {r.id: r.x for r in rows.select("id", model.numbers().alias("x")).collect()}
    assert got[100][0] == 201.0 and got[70][0] == pytest.approx(141, abs=3) and got[93][2] == pytest.approx(93, abs=3)
    filled = np.array(list(got.values()))
    assert model.centres == pytest.approx(filled.mean(axis=0).tolist()) and model.scales[0] == pytest.approx(filled[:, 0].std())


def test_cross_validation_report(features, model):
    report = scoring.cross_validate(features, folds=2)
    got = {r.fold: r for r in report.collect()}
    assert set(got) == {0, 1, 2}
    assert all(r.train_to < r.valid_from and r.n == r.n_pos + r.n_neg for f, r in got.items() if f)
    assert got[0].n == got[1].n + got[2].n and got[0].n_neg == got[1].n_neg + got[2].n_neg
    labelled = scoring.flatten(features).filter("label IS NOT NULL")
    curve, extremes = scoring.calibration_curve(model.predict(labelled)), scoring.extreme_coefficients(model.coefficients(labelled))
    lines = scoring.validation_text(report, curve, extremes).split("\n")
    assert lines[1].startswith("fold | train_n | n") and sum(x.startswith(("top | ", "bottom | ")) for x in lines) == 10
    at = lines.index("Calibration on all rows")
    assert sum(int(x.split(" | ")[2]) for x in lines[at + 2 : lines.index("Coefficients on all rows")]) == labelled.count()


def test_cross_validation_evaluates_its_rows_once(spark, features):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def same(v):
        seen.add(1)
        return v

    rows = features.withColumn("events_count", same.asNondeterministic()("events_count"))
    scoring.cross_validate(rows, folds=2).collect()
    assert seen.value <= features.count()


def test_report_names_folds_that_cannot_be_fitted(spark, features):
    few = features.filter("label IS NOT NULL").orderBy("representative_deal_id").limit(30)
    notes = scoring.cross_validate(few, folds=2)
    assert notes.filter("note IS NOT NULL").count() >= 1 and "too few" in scoring.validation_text(notes)


def test_extremes_curve_and_stability(spark, features):
    c = spark.createDataFrame([(f"f{k}", k - 5.0) for k in range(11)], "feature string, coefficient double")
    got = {(r.side, r.place): r.feature for r in scoring.extreme_coefficients(c).collect()}
    assert len(got) == 10 and got["top", 1] == "f10" and got["bottom", 1] == "f0" and got["bottom", 5] == "f4"
    p = spark.createDataFrame([(0.1, 0), (0.15, 1), (1.0, 1)], "p double, label int")
    assert {tuple(r) for r in scoring.calibration_curve(p).collect()} == {(0.1, 0.5, 2), (0.9, 1.0, 1)}
    rows = scoring.coefficient_stability(features, 2).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + sum(r["rank"] is not None for r in rows)))
    assert all((r.verdict == "absent") == (r.coefficient is None or abs(r.coefficient) < 1e-9) for r in rows)


def test_streamed_bars_equal_batch(spark, sf_dir):
    key = lambda df: {(r.ticker, r.bucket): (r.open, r.high, r.low, r.close, r.volume, r.n_ticks) for r in df.collect()}
    assert key(plans.QUERIES["streamed_bars"](spark, sf_dir)) == key(bars.price_bars(table(spark, sf_dir, "ticks")))


def test_streamed_daily_bars_equal_batch(spark, sf_dir):
    key = lambda df: {(r.ticker, r.bucket): (r.open, r.high, r.low, r.close, r.volume, r.n_ticks) for r in df.collect()}
    assert key(plans.QUERIES["streamed_daily_bars"](spark, sf_dir)) == key(bars.price_bars(table(spark, sf_dir, "ticks"), "1 day"))


def test_alerts_run_on_from_batch_to_batch(spark, tmp_path):
    rows = spark.range(60).selectExpr("id", "concat('v', id % 2) AS vendor", "timestamp_seconds(id * 60) AS ts", "CAST(5 + id % 3 AS INT) AS credits_cost", "'2024-01' AS year_month")
    for k in range(3):
        rows.filter(f"id >= {20 * k} AND id < {20 * k + 20}").coalesce(1).write.parquet(f"file://{tmp_path}/in/part={k}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    alerts = f"file://{tmp_path}/alerts"
    stream = streams.read_landed(spark, f"file://{tmp_path}/in/*", schema, files=1)
    streams.budget_alerts(stream, f"file://{tmp_path}/totals", f"file://{tmp_path}/check", 150.0, lambda rows, number: rows.write.mode("overwrite").parquet(f"{alerts}/batch={number}"))
    got = {tuple(r) for r in spark.read.parquet(f"{alerts}/batch=*").select("vendor", "year_month", "id", "mark", "after").collect()}
    want = ledger.threshold_crossings(rows, 150.0)
    assert got == {tuple(r) for r in want.collect()} and len(got) == 6


def test_streamed_positions_equal_batch(spark, sf_dir):
    fills = table(spark, sf_dir, "fills")
    batch = ledger.positions(fills).filter("status = 'closed'").filter(F.col("close_ts") < fills.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]).collect()
    got = plans.QUERIES["streamed_positions"](spark, sf_dir).collect()
    row = lambda r: (r.deal_id, r.epoch, r.close_ts)
    assert {row(r): r.pnl_eur for r in got} == pytest.approx({row(r): r.pnl_eur for r in batch}, abs=1e-3) and len(batch) > 100


def test_streamed_ingest_keeps_each_key_once(spark, sf_dir):
    assert sum(r.n for r in plans.QUERIES["streamed_ingest"](spark, sf_dir).collect()) == table(spark, sf_dir, "deals").count()


def test_streamed_alerts_equal_batch(spark, sf_dir):
    want = ledger.threshold_crossings(table(spark, sf_dir, "vendor_usage"), 5000.0)
    assert {tuple(r) for r in plans.QUERIES["streamed_budget_alerts"](spark, sf_dir).select("vendor", "year_month", "id", "mark", "after").collect()} == {tuple(r) for r in want.collect()}


def test_daily_cycle_equals_loop(spark, sf_dir):
    rows = [r.asDict() for r in table(spark, sf_dir, "events").selectExpr("to_date(ts) AS day", "event_id AS seq", "user_id AS deal", "unix_timestamp(ts) AS at", "event_id % 3 <> 0 AS ok").collect()]
    want = {}
    for day in {r["day"] for r in rows}:
        if day.day == 13:
            continue
        held, last = 0, None
        for k, r in enumerate(sorted((x for x in rows if x["day"] == day), key=lambda x: x["seq"])):
            out = "skipped" if not r["ok"] or held >= 5 else "execution_skipped" if last is not None and r["at"] - last < 3600 else "pending_approval" if day.day < 10 else "submitted"
            if out == "submitted":
                held, last = held + 1, r["at"]
            want[day, k] = (r["deal"], out)
    assert {(r.run_day, r.pos): (r.deal_id, r.outcome) for r in plans.QUERIES["daily_cycle"](spark, sf_dir).collect()} == want
