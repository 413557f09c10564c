"""Queries that fit models or run streams; no SQL can say them, the tests hold them against invariants or their batch twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from bidframe.operators import clusters, scoring
from bidframe.operators.lineage import stored
from bidframe.plans.registry import query
from bidframe.plans.standin import table
from bidframe.streaming import streams


def _shared(spark, name: str) -> str:
    """A new folder that driver and executors share. A cluster must name the place in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _features(spark, d):
    return clusters.cluster_features(table(spark, d, "deals"))


def _fitted(spark, d):
    rows = stored(scoring.flatten(_features(spark, d)))  # read to fit and to score
    return scoring.ScoringModel().fit(rows), rows


@query()
def scored_clusters(spark, d):
    model, rows = _fitted(spark, d)
    return scoring.score_clusters(model, rows)


@query()
def feature_importance(spark, d):
    model, rows = _fitted(spark, d)
    return model.coefficients(rows).orderBy(F.desc(F.abs("coefficient")), "feature").limit(15)


@query()
def cross_validation(spark, d):
    return scoring.cross_validate(_features(spark, d))


@query()
def validation_report(spark, d):
    """The lines of the report, of which there are a few dozen."""
    features = _features(spark, d)
    model, rows = _fitted(spark, d)
    curve = scoring.calibration_curve(model.predict(rows.filter("label IS NOT NULL")))
    text = scoring.validation_text(scoring.cross_validate(features), curve, scoring.extreme_coefficients(model.coefficients(rows)))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "pos int, line string")


@query()
def coefficient_stability(spark, d):
    return scoring.coefficient_stability(_features(spark, d))


def _landed(spark, d, name: str):
    """A table written as landed files, and its schema."""
    rows = table(spark, d, name)
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})  # event time has a zone
    path = _shared(spark, name)
    rows.write.parquet(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


@query()
def streamed_ingest(spark, d):
    path, schema = _landed(spark, d, "deals")
    target = _shared(spark, "ingested")
    streams.ingest(streams.read_landed(spark, path, schema), target, _shared(spark, "checkpoint"), ["juridiction", "regulator_ref"], ["announcement_date", "id"])
    return spark.read.parquet(target).groupBy("juridiction").agg(F.count("*").alias("n"))


def _bars(spark, d, *how):
    path, schema = _landed(spark, d, "ticks")
    target = _shared(spark, "bars")
    run = streams.write_bars(streams.bars(streams.read_landed(spark, path, schema), *how), target, _shared(spark, "checkpoint"))
    return streams.current_bars(spark, target, run.lastProgress["batchId"])


@query()
def streamed_bars(spark, d):
    return _bars(spark, d)


@query()
def streamed_daily_bars(spark, d):
    return _bars(spark, d, "1 day", "7 days")


@query()
def streamed_dedup(spark, d):
    path, schema = _landed(spark, d, "filing_events")
    target = _shared(spark, "events")
    unique = streams.dedup_events(streams.read_landed(spark, path, schema), "40 days")
    streams.run_available(unique.writeStream.format("parquet").option("path", target).outputMode("append"), _shared(spark, "checkpoint"))
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("source_url").isNull()).alias("n_without_link"))


@query()
def streamed_positions(spark, d):
    """Positions closed up to an hour before the newest fill."""
    path, schema = _landed(spark, d, "fills")
    target = _shared(spark, "positions")
    with streams.keyed_state(spark):
        closed = streams.closed_positions(streams.read_landed(spark, path, schema))
        streams.run_available(closed.writeStream.format("parquet").option("path", target).outputMode("append"), _shared(spark, "checkpoint"))
    return spark.read.schema(streams.POSITION_ROW).parquet(target)


@query()
def streamed_budget_alerts(spark, d):
    path, schema = _landed(spark, d, "vendor_usage")
    alerts = _shared(spark, "alerts")
    streams.budget_alerts(
        streams.read_landed(spark, path, schema), _shared(spark, "usage"), _shared(spark, "checkpoint"), 5000.0, lambda rows, number: rows.write.mode("overwrite").parquet(f"{alerts}/batch={number}")
    )
    return spark.read.parquet(f"{alerts}/batch=*")
