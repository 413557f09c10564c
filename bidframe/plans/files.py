"""Queries on files: tables written by a sink and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import clusters
from bidframe.plans.models import _shared
from bidframe.plans.registry import ORACLE, query
from bidframe.plans.standin import table, with_tables
from bidframe.sources import feeds, sinks

_LABEL_LINES = (
    "SELECT concat(CAST(o_orderkey AS VARCHAR(20)), '_', CAST(o_custkey AS VARCHAR(20))) AS id_cluster, 'FR' AS juridiction, concat('Cible \"', CAST(o_custkey AS VARCHAR(20)), '\", SA') AS target_name, "
    "CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '?' END AS label_y, CASE WHEN o_orderkey % 3 > 0 THEN concat('https://s.example/', CAST(o_orderkey % 9 AS VARCHAR(20))) END AS label_source, CASE WHEN o_orderkey % 5 = 0 THEN 'a, b' END AS label_notes FROM orders"
)


@query(_LABEL_LINES)
def label_file_scan(spark, d):
    path = _shared(spark, "labels")
    lines = spark.sql(_LABEL_LINES.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    sinks.write_audit(lines, path, ["id_cluster", "juridiction", "target_name", "label_y", "label_source", "label_notes"])
    return feeds.label_file(spark, path).drop("line")


_AUDIT = {"pos": "long", "juridiction": "string", "first_date": "date", "target_name": "string", "n_filings": "long", "id_cluster": "string"}


@query(f"SELECT row_number() OVER (ORDER BY juridiction, first_date DESC, id_cluster) AS pos, juridiction, first_date, target_name, n_filings, id_cluster FROM ({ORACLE['fr_chain_collapse']})")
def collapse_audit(spark, d):
    """The audit file of collapsed rows; as a table's files have no order, each row has its place."""
    path = _shared(spark, "audit")
    collapsed = clusters.collapse_chains(table(spark, d, "deals")).select([c for c in _AUDIT if c != "pos"])
    sinks.write_audit(clusters.audit_order(collapsed), path, list(_AUDIT))
    return spark.read.schema(", ".join(f"{k} {v}" for k, v in _AUDIT.items())).csv(path, header=True, quote='"', escape='"')


@query(with_tables("scores") + "SELECT id, deal_id, model_version, score_stars, features FROM scores")
def score_sink(spark, d):
    """Scores of one model version after the other, appended to a table."""
    path = _shared(spark, "scores")
    scores = table(spark, d, "scores").select("id", "deal_id", "model_version", "score_stars", "features")
    for version in ("v1", "v2"):
        sinks.append_scores(scores.filter(F.col("model_version") == version), path)
    return spark.read.schema(scores.schema).parquet(path)


@query(with_tables("deals") + "SELECT juridiction, count(*) AS n_deals, count(completion_label) AS n_labelled, max(announcement_date) AS latest FROM deals GROUP BY 1")
def run_summary(spark, d):
    path = _shared(spark, "summary")
    rows = table(spark, d, "deals").groupBy("juridiction").agg(F.count("*").alias("n_deals"), F.count("completion_label").alias("n_labelled"), F.max("announcement_date").alias("latest"))
    sinks.write_summary(rows, path)
    return spark.read.schema(rows.schema).json(path)
