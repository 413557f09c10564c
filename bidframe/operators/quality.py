"""Constraint checks, distributions, parser regressions, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.functions.filings import de_offer_price, fr_offer_price, fr_quality_flag, it_quality_flag, outlier_bucket
from bidframe.operators.ordering import values_at


def violations(df: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """(table_name, rule, key) of rows that break a rule, in one pass over the table; a null outcome doesn't break it."""
    broken = F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()])
    return df.select(F.lit(table).alias("table_name"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return g.select(F.lit(table).alias("table_name"), F.lit("unique").alias("rule"), F.concat_ws("|", *keys).alias("key"))


def orphans(df: DataFrame, table: str, key: str, parents: DataFrame, parent_key: str, own_key: str) -> DataFrame:
    lost = df.join(parents.select(F.col(parent_key).alias(own_key)).distinct(), own_key, "left_anti")
    return lost.select(F.lit(table).alias("table_name"), F.lit("foreign_key").alias("rule"), F.col(key).cast("string").alias("key"))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def counts_with_total(df: DataFrame, col: str, total: str = "TOTAL") -> DataFrame:
    """Counts per value and one row for all; nulls are ``none``."""
    return df.withColumn("k", F.coalesce(F.col(col).cast("string"), F.lit("none"))).rollup("k").agg(F.count("*").alias("n")).select(F.coalesce("k", F.lit(total)).alias(col), "n")


def distribution(df: DataFrame, col: str) -> DataFrame:
    """n, mean, min, p05, median, p95, max and sample deviation of the non-null values, one row. p05 and p95 are the values at places max(1, floor(.05 n)) and max(1, min(n, floor(.95 n))) in ascending order. One pass for sums and brackets, one for counts inside of these."""
    x = F.col("x")
    sums = {"n": F.count("*"), "mean": F.round(F.avg(x), 6), "min": F.min(x), "max": F.max(x), "stdev": F.round(F.stddev_samp(x), 6)}
    places = {"p05": (0.05, lambda n: max(1, n * 5 // 100)), "lower": (0.5, lambda n: (n + 1) // 2), "upper": (0.5, lambda n: n // 2 + 1), "p95": (0.95, lambda n: max(1, n * 95 // 100))}
    at, row = values_at(df.filter(F.col(col).isNotNull()), col, places, sums)
    median = None if at["lower"] is None else (at["lower"] + at["upper"]) / 2
    kinds = "n long, mean double, min double, median double, max double, stdev double, p05 double, p95 double"
    return df.sparkSession.createDataFrame([(row["n"], row["mean"], row["min"], median, row["max"], row["stdev"], at["p05"], at["p95"])], kinds)


def coverage(deals: DataFrame, columns: list[str], target: str = "target_name", jurisdiction: str = "juridiction") -> DataFrame:
    """Clusters that have a value, per jurisdiction and column, with their share."""
    per = deals.groupBy(target, jurisdiction).agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    long = per.unpivot([jurisdiction], columns, "ingredient", "has")
    return long.groupBy(jurisdiction, "ingredient").agg(F.sum("has").cast("bigint").alias("populated"), F.count("*").alias("clusters")).withColumn("share", F.round(F.col("populated") / F.col("clusters"), 6))


def outlier_audit(deals: DataFrame) -> DataFrame:
    n = deals.groupBy(outlier_bucket(F.col("offer_price")).alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def success_rates(probed: DataFrame, go: float = 0.7) -> DataFrame:
    """Share of ``ok`` per jurisdiction and over all, against a threshold."""
    g = probed.rollup("juridiction").agg(F.avg((F.col("status") == "ok").cast("double")).alias("r"), F.count("*").alias("n"))
    return g.select(F.coalesce("juridiction", F.lit("TOTAL")).alias("juridiction"), "n", F.round("r", 6).alias("rate"), F.when(F.col("r") >= go, "GO").otherwise("NO_GO").alias("verdict"))


def stratified_sample(df: DataFrame, stratum: str, key: str, k: int, seed: int = 42, must: Column | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """``k`` rows per stratum, those marked ``must`` first, then in the order of a hash of key and seed; keys of ``exclude`` never."""
    rows = df if exclude is None else df.join(exclude.select(key).distinct(), key, "left_anti")
    first = F.lit(False) if must is None else F.coalesce(must, F.lit(False))
    order = W.partitionBy(stratum).orderBy(first.desc(), F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def backfill_fr(deals: DataFrame, filings: DataFrame, version: int = 2) -> DataFrame:
    """Deals with the default flag and an older parser are read again (filings: id, text, failed). Action: applied, noop, skipped_no_pdf, exception. Run twice, it finds nothing to do."""
    due = deals.filter((F.col("offer_price_quality_flag") == "suspect_low_unverified") & (F.col("parser_version") < version))
    got = due.join(filings, "id", "left").withColumn("x", fr_offer_price(F.col("text")))
    new_flag = fr_quality_flag(F.col("x.amount"))
    action = (
        F.when(F.coalesce("failed", F.lit(False)), "exception").when(F.col("text").isNull(), "skipped_no_pdf")
        .when(F.col("x.amount").eqNullSafe(F.col("offer_price")) & (new_flag == F.col("offer_price_quality_flag")), "noop").otherwise("applied")
    )
    got = got.withColumn("action", action)
    on = F.col("action") == "applied"
    return got.select(
        "id", "action", F.when(on, F.col("x.amount")).otherwise(F.col("offer_price")).alias("offer_price"), F.when(on, new_flag).otherwise(F.col("offer_price_quality_flag")).alias("offer_price_quality_flag"),
        F.when(on, F.lit(version)).otherwise(F.col("parser_version")).alias("parser_version"), F.col("x.source").alias("source"),
    )


def backfill_de(deals: DataFrame, filings: DataFrame, low: float = 5, high: float = 500, version: int = 2) -> DataFrame:
    """German deals from an older parser without a price, or with one below ``low`` or above ``high``, are read again (filings: id, text).

    Action: corrected (another price, or the first), nulled, unchanged, or skipped_no_pdf without a text, which leaves
    the deal as it is. Scores of corrected and nulled deals are no longer valid (``ingest.invalidate_scores``). Run
    twice, it finds only the skipped ones.
    """
    old = F.col("offer_price")
    due = deals.filter((F.col("juridiction") == "DE") & (F.col("parser_version") < version) & (old.isNull() | (old < low) | (old > high)))
    got = due.join(filings, "id", "left").withColumn("x", de_offer_price(F.col("text")))
    new = F.col("x.amount")
    action = (
        F.when(F.col("text").isNull(), "skipped_no_pdf").when(new.isNull() & old.isNotNull(), "nulled").when(new.isNotNull() & (old.isNull() | (new != old)), "corrected").otherwise("unchanged")
    )
    read = F.col("action") != "skipped_no_pdf"
    return got.withColumn("action", action).select(
        "id", old.alias("old_price"), F.when(read, new).otherwise(old).alias("new_price"), F.when(read, F.col("x.flag")).otherwise(F.col("offer_price_quality_flag")).alias("flag"), "action",
        F.when(read, F.lit(version)).otherwise(F.col("parser_version")).alias("parser_version"),
    )


def reparse_action(old_price: Column, new_price: Column, old_flag: Column, new_flag: Column) -> Column:
    """(action, delta): new_suspect_mixed; unchanged without a new price; promoted where there was none; price_changed (over 1 %); promoted by the flag alone; else unchanged. The delta is a share of the old price, where two prices were compared."""
    first = F.coalesce(old_price, F.lit(0)) == 0
    compared = (new_flag != "suspect_mixed") & new_price.isNotNull() & ~first
    delta = F.when(compared, F.abs(F.try_divide(new_price - old_price, old_price)))
    action = (
        F.when(new_flag == "suspect_mixed", "new_suspect_mixed").when(new_price.isNull(), "unchanged").when(first, "promoted").when(delta > 0.01, "price_changed")
        .when(~old_flag.eqNullSafe(new_flag), "promoted").otherwise("unchanged")
    )
    return F.struct(action.alias("action"), F.bround(delta, 6).alias("delta"))


def reparse_de(deals: DataFrame, filings: DataFrame, scores: DataFrame, version: int = 2) -> DataFrame:
    """German deals of an older parser read again (filings: id, text), whatever their price: one audit row each, with prices, flags and versions before and after.

    Without a text a deal stays as it is (``skipped_no_pdf``). Else it takes the new price, also none, the new flag and
    the version. ``scores_deleted`` counts the scores (deal_id) of a deal whose price changed, which are no longer
    valid (``ingest.invalidate_scores``); scores are counted by partial sums.
    """
    due = deals.filter((F.col("juridiction") == "DE") & (F.col("parser_version") < version))
    got = due.join(filings.select("id", "text"), "id", "left").withColumn("x", de_offer_price(F.col("text")))
    read = F.col("text").isNotNull()
    got = got.withColumn("r", reparse_action(F.col("offer_price"), F.col("x.amount"), F.col("offer_price_quality_flag"), F.col("x.flag")))
    n = scores.groupBy(F.col("deal_id").alias("id")).agg(F.count("*").alias("_n"))
    return got.join(n, "id", "left").select(
        "id", F.when(read, F.col("r.action")).otherwise("skipped_no_pdf").alias("action"), F.when(read, F.col("r.delta")).alias("delta"), F.col("offer_price").alias("old_price"),
        F.when(read, F.col("x.amount")).otherwise(F.col("offer_price")).alias("new_price"), F.col("offer_price_quality_flag").alias("old_flag"), F.when(read, F.col("x.flag")).otherwise(F.col("offer_price_quality_flag")).alias("new_flag"),
        F.when(read, F.lit(version)).otherwise(F.col("parser_version")).alias("parser_version"), F.when(read & (F.col("r.action") == "price_changed"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("scores_deleted"),
    )


def validate_bounds(sample: DataFrame, filings: DataFrame) -> DataFrame:
    """Sampled deals (id) with the price their filing's text says and the flag that follows from it; ``missing_pdf`` without a text (filings: id, text)."""
    got = sample.join(filings.select("id", "text"), "id", "left").withColumn("price", fr_offer_price(F.col("text"))["amount"])
    return got.select("id", "price", F.when(F.col("text").isNull(), "missing_pdf").otherwise(fr_quality_flag(F.col("price"))).alias("flag"))


#: Sources of a price that are trusted to correct a stored one.
TRUSTED = ("engagement_clause", "surenchere_raised")


def extraction_diff(old_price: Column, new_price: Column, source: Column) -> Column:
    """(category, delta_eur, delta_pct, review) of a new extraction against the stored price."""
    category = (
        F.when(new_price.isNull(), F.when(old_price.isNull(), "UNCHANGED").otherwise("PARSER_FAIL")).when(old_price.isNull(), "NEW_EXTRACT").when(old_price == new_price, "UNCHANGED")
        .when(source.isin(*TRUSTED), "CORRECTED").otherwise("NEW_DIFFERENT")
    )
    return F.struct(
        category.alias("category"), (new_price - old_price).alias("delta_eur"), F.bround(F.try_divide(new_price - old_price, old_price) * 100, 4).alias("delta_pct"), category.isin("NEW_DIFFERENT", "PARSER_FAIL", "NEW_EXTRACT").alias("review"),
    )


def pattern_impact(text: Column, old: str, new: str, group: int = 1) -> Column:
    """What a change of pattern does to a text."""
    a, b = (F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in (old, new))
    return (
        F.when(a.isNull() & b.isNull(), "unchanged_silent").when(a.isNull(), "recovered").when(b.isNull(), "lost").when(a == b, "unchanged_extracted").otherwise("changed_extracted")
    )


def promote_it_flags(deals: DataFrame, dry_run: bool = False) -> DataFrame:
    """New flag of IT deals by price, type and target: noop, applied, or would_apply in a dry run."""
    x = it_quality_flag(F.col("offer_price"), F.col("deal_type"), F.col("target_name"))
    rows = deals.filter("juridiction = 'IT'").withColumn("x", x)
    action = F.when(F.col("x.flag") == F.col("offer_price_quality_flag"), "noop").otherwise("would_apply" if dry_run else "applied")
    return rows.select("id", F.col("offer_price_quality_flag").alias("old_flag"), F.col("x.flag").alias("new_flag"), F.col("x.outlier").alias("statistical_outlier"), action.alias("action"))


def isin_backfill(deals: DataFrame, texts: DataFrame) -> DataFrame:
    """For deals without a ticker, the first ISIN in their filing (id, text) with the status, per deal."""
    from bidframe.functions.names import first_isin

    got = deals.filter("ticker IS NULL").join(texts, "id", "left").withColumn("found", first_isin(F.col("text")))
    return got.select("id", "juridiction", "found", F.when(F.col("text").isNull(), "no_pdf").when(F.col("found").isNull(), "no_isin").otherwise("ok").alias("status"))
