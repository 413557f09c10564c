"""Deal clusters: features per (target, jurisdiction), multi-stage chains, decision deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.functions.names import acquirer_class, is_cross_border, is_fdi_risk, payment_type
from bidframe.operators.ordering import carry, number_rows

PEND = "[pending parse]"


def first_by_date(col, order=("announcement_date", "id")):
    """The value of the first row, by date and id, that has one; the least such value of rows alike in both."""
    return F.min(F.when(col.isNotNull(), F.struct(*order, col.alias("value"))))["value"]


def cluster_features(deals: DataFrame) -> DataFrame:
    """One row per (target, jurisdiction) with a known target: the features, label, first date and first deal's id."""
    known = F.when(F.col("acquirer_name") != PEND, F.col("acquirer_name"))
    first = F.min(F.struct("announcement_date", "id", "acquirer_name", "deal_type"))
    g = (
        deals.filter(F.col("target_name") != PEND)
        .groupBy("target_name", "juridiction")
        .agg(
            first.alias("first"),
            F.coalesce(first_by_date(known), first["acquirer_name"]).alias("acquirer"),
            first_by_date(F.col("premium_pct")).alias("premium"),
            first_by_date(F.col("min_acceptance_threshold")).alias("min_acceptance_threshold"),
            F.max("expected_close_date").alias("expected_close"),
            F.count("*").cast("double").alias("events_count"),
            first["deal_type"].alias("deal_type"),
            first_by_date(F.col("completion_label")).alias("label"),
        )
    )
    premium = F.col("premium").cast("double") * 100
    days = F.datediff("expected_close", "first.announcement_date").cast("double")
    clip = lambda x, lo, hi: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))
    return g.select(
        "target_name", "juridiction", F.col("first.id").alias("representative_deal_id"), F.col("first.announcement_date").alias("earliest_announcement"),
        clip(premium, -50.0, 500.0).alias("bid_premium_pct"), F.lit(None).cast("double").alias("relative_size"),
        F.col("min_acceptance_threshold").cast("double").alias("min_acceptance_threshold"), clip(days, 0.0, 730.0).alias("days_to_expected_close"), "events_count",
        F.coalesce("deal_type", F.lit("unknown")).alias("deal_type"), payment_type(F.col("deal_type")).alias("payment_type"), F.lit("unknown").alias("target_sector"),
        acquirer_class(F.coalesce("acquirer", F.lit("unknown"))).alias("acquirer_type"), is_cross_border(F.col("target_name"), F.coalesce("acquirer", F.lit(""))).alias("cross_border"),
        F.lit(False).alias("has_irrevocable_undertaking"), is_fdi_risk(F.coalesce("acquirer", F.lit(""))).alias("fdi_risk_flag"), "label",
    )


def collapse_chains(deals: DataFrame, gap_days: int = 730) -> DataFrame:
    """FR filings of one target fall into one cluster while the gap to the filing before is under ``gap_days``; unknown targets and other jurisdictions stay alone."""
    single = (F.col("juridiction") != "FR") | (F.col("target_name") == PEND)
    fr = deals.filter(~single).withColumn("_year", F.coalesce(F.year("announcement_date"), F.lit(0)))
    # gaps and their numbers are found within a target's years; what earlier years leave is carried on
    order = W.partitionBy("target_name", "_year").orderBy("announcement_date", "id")
    newest = carry(fr, ["target_name"], "_year", {"_newest": F.max("announcement_date")}, F.max)
    gap = F.datediff("announcement_date", F.coalesce(F.lag("announcement_date").over(order), "_newest"))
    fr = fr.join(newest, ["target_name", "_year"]).withColumn("_opens", F.when(gap >= gap_days, 1).otherwise(0))
    opened = carry(fr, ["target_name"], "_year", {"_opened": F.sum("_opens")}, F.sum)
    here = F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0))
    fr = fr.withColumn("_here", here).join(opened, ["target_name", "_year"]).withColumn("part", F.col("_here") + F.coalesce("_opened", F.lit(0))).select(*deals.columns, "part")
    rows = fr.unionByName(deals.filter(single).withColumn("part", F.col("id").cast("long")))
    known = F.when(F.col("acquirer_name") != PEND, F.col("acquirer_name"))
    first = F.struct("announcement_date", "id")
    g = rows.groupBy("juridiction", "target_name", "part").agg(
        F.min("announcement_date").alias("first_date"), F.max("announcement_date").alias("last_date"), F.count("*").alias("n_filings"),
        F.coalesce(first_by_date(known), F.min_by("acquirer_name", first)).alias("acquirer_name"), F.min_by("deal_type", first).alias("deal_type"),
        F.max("expected_close_date").alias("expected_close_date"), first_by_date(F.col("offer_price")).alias("offer_price"),
        F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["id"].cast("string")), "_").alias("id_cluster"),
    )
    return g.drop("part")


def audit_order(collapsed: DataFrame) -> DataFrame:
    """Collapsed rows in the order of the audit file, by jurisdiction and from the latest first date (none: last), with their place ``pos``. All columns are written once; a caller selects those it needs before."""
    late = F.coalesce(-F.unix_date("first_date"), F.lit(2**31 - 1))
    return number_rows(collapsed.withColumn("_late", late), "juridiction", name="pos", then=("_late", "id_cluster")).drop("_late").orderBy("pos")


def candidate_failures(collapsed: DataFrame, pairs: DataFrame, parts: list[str], long_chain: int = 4) -> DataFrame:
    """Flag collapsed rows that a hand-made list of (juridiction, target) pairs or name parts marks as likely failures, and label chains of ``long_chain`` filings or more as completed."""
    listed = pairs.select("juridiction", "target_name").distinct().withColumn("listed", F.lit(True))
    named = F.lit(False)
    for part in parts:
        named = named | F.lower("target_name").contains(part.lower())
    return collapsed.join(listed, ["juridiction", "target_name"], "left").withColumn("candidate_failure", F.coalesce("listed", F.lit(False)) | named).drop("listed").withColumn("label_y", F.when(F.col("n_filings") >= long_chain, 1))


def decision_deal(deals: DataFrame) -> DataFrame:
    """The deal a cluster is decided on: home venue before others, then with an offer, then the latest; ties to the smaller id."""
    order = W.partitionBy("target_name", "juridiction").orderBy(
        F.col("ticker_resolution_flag").eqNullSafe("home_venue").desc(), F.col("offer_price").isNotNull().desc(), F.desc("announcement_date"), "id"
    )
    return deals.filter(F.col("target_name") != PEND).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def collapse_summary(collapsed: DataFrame) -> DataFrame:
    return collapsed.groupBy("juridiction").agg(F.count("*").alias("n_rows"), F.count_if("candidate_failure").alias("n_flagged"), F.count("label_y").alias("n_prelabelled"))
