"""Model metrics, time folds, comparisons of two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.operators.lineage import stored
from bidframe.operators.ordering import number_rows, running_sum


def counted(rows: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Rows, positives (``pos``) and negatives (``neg``) per distinct prediction, written once: what the metrics rest on."""
    label = F.col(y).cast("double")
    return stored(rows.groupBy(*by, p).agg(F.count_if(label == 1).alias("pos"), F.count_if(label != 1).alias("neg"), F.count("*").alias("n")))


def auc_of(values: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Exact AUC by average rank, of ``counted`` predictions."""
    ranked = running_sum(values, p, F.col("n"), tuple(by)).withColumn("rank_sum", F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2))
    g = ranked.groupBy(*by).agg(F.sum("rank_sum").alias("r"), F.sum("pos").alias("n_pos"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("n_pos")
    auc = F.when((F.col("n_pos") > 0) & (neg > 0), (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * neg))
    return g.select(*by, "n", "n_pos", F.round(auc, 8).alias("auc"))


def auc_parts(rows: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Exact AUC. Rows are first counted per distinct prediction, so ties need no ranks of their own; the running sum over distinct values is taken range by range, so a group of many predictions is no one task."""
    return auc_of(counted(rows, p, y, by), p, by)


def losses(rows: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Brier score, log loss, accuracy and F1 (0 without positives) at 0.5."""
    prob, label = F.col(p).cast("double"), F.col(y).cast("double")
    safe = F.greatest(F.least(prob, F.lit(1 - 1e-15)), F.lit(1e-15))
    hit = prob >= 0.5
    tp, fp, fn = F.count_if(hit & (label == 1)), F.count_if(hit & (label == 0)), F.count_if(~hit & (label == 1))
    return rows.groupBy(*by).agg(
        F.round(F.avg((prob - label) * (prob - label)), 8).alias("brier"), F.round(F.avg(-(label * F.log(safe) + (1 - label) * F.log(1 - safe))), 6).alias("log_loss"),
        F.round(F.avg((hit == (label == 1)).cast("double")), 8).alias("accuracy"), F.round(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), 8).alias("f1"),
    )


def losses_of(values: DataFrame, p: str, by: list[str]) -> DataFrame:
    """``losses`` of ``counted`` predictions."""
    prob, pos, neg = F.col(p).cast("double"), F.col("pos"), F.col("neg")
    safe = F.greatest(F.least(prob, F.lit(1 - 1e-15)), F.lit(1e-15))
    hit, known = prob >= 0.5, F.sum(F.when(prob.isNotNull(), pos + neg))
    tp, fp, fn = (F.coalesce(F.sum(F.when(on, c)), F.lit(0)) for on, c in ((hit, pos), (hit, neg), (~hit, pos)))
    mean = lambda x: F.try_divide(F.sum(x), known)
    return values.groupBy(*by).agg(
        F.round(mean(pos * (prob - 1) * (prob - 1) + neg * prob * prob), 8).alias("brier"), F.round(mean(-(pos * F.log(safe) + neg * F.log(1 - safe))), 6).alias("log_loss"),
        F.round(mean(F.when(hit, pos).when(~hit, neg)), 8).alias("accuracy"), F.round(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), 8).alias("f1"),
    )


def metrics(rows: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """AUC and losses; ``rows`` are evaluated once."""
    values = counted(rows, p, y, by)
    return auc_of(values, p, by).join(losses_of(values, p, by), by)


def chronological_folds(rows: DataFrame, k: int = 3, gap_days: int = 90, day: str = "day", key: str = "id") -> DataFrame:
    """Rows by date in k + 1 chunks of n // (k + 1), one row at least (the last takes the rest): fold s validates chunk s + 1 and trains on earlier rows up to ``gap_days`` before its first date. Folds without rows on a side are dropped.

    Adds fold and role, one row per fold a row takes part in. Chunk bounds come from counts per day, so only the
    labelled rows of one day are ever numbered together.
    """
    days = rows.groupBy(day).agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy(day).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy())).drop("n")
    at = rows.join(before, day).withColumn("at", F.col("before") + F.row_number().over(W.partitionBy(day).orderBy(key)) - 1)
    size = F.greatest(F.floor(F.col("total") / (k + 1)), F.lit(1))
    chunk = F.least(F.floor(F.col("at") / size), F.lit(k)).cast("int")
    placed = at.withColumn("chunk", chunk).drop("before", "total", "at")
    starts = placed.filter("chunk >= 1").groupBy(F.col("chunk").alias("fold")).agg(F.min(day).alias("first_valid"))
    parts = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).join(starts, "fold")
    role = F.when(F.col("chunk") == F.col("fold"), "valid").when((F.col("chunk") < F.col("fold")) & (F.col(day) <= F.date_sub("first_valid", gap_days)), "train")
    got = parts.withColumn("role", role).filter("role IS NOT NULL")
    whole = got.groupBy("fold").agg(F.countDistinct("role").alias("sides")).filter("sides = 2").select("fold")
    return got.join(whole, "fold").drop("chunk", "first_valid")


def stratified_folds(rows: DataFrame, label: str, k: int = 3, key: str = "id") -> DataFrame:
    """Fold numbers 1..k, contiguous blocks of each class in the order of the key."""
    held = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_held"))
    rows = number_rows(rows, key, (label,), "_n").join(held, F.col(label).eqNullSafe(F.col("_label")))
    n, at = F.col("_held"), F.col("_n") - 1
    extra = n % k
    base = F.floor(n / k)
    cut = extra * (base + 1)
    fold = F.when(at < cut, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - cut) / F.greatest(base, F.lit(1))))
    return rows.withColumn("fold", (fold + 1).cast("int")).drop("_label", "_held", "_n")


def compare_models(a: DataFrame, b: DataFrame, keys: list[str], p: str = "p") -> tuple[DataFrame, DataFrame]:
    """(summary: mean, max, number over 1e-6; the ten that moved most)."""
    both = a.select(*keys, F.col(p).cast("double").alias("p_a")).join(b.select(*keys, F.col(p).cast("double").alias("p_b")), keys).withColumn("diff", F.abs(F.col("p_a") - F.col("p_b")))
    summary = both.agg(F.round(F.avg("diff"), 12).alias("mean_diff"), F.max("diff").alias("max_diff"), F.count_if(F.col("diff") > 1e-6).alias("n_moved"))
    return summary, both.orderBy(F.desc("diff"), *keys).limit(10)


def no_regression(max_diff: Column, brier_a: Column, brier_b: Column, auc_a: Column, auc_b: Column) -> Column:
    """identical (to 1e-10), acceptable (Brier within 0.005, AUC within 0.01), else regression."""
    near = (F.abs(brier_a - brier_b) <= 0.005) & (F.abs(auc_a - auc_b) <= 0.01)
    return F.when(max_diff <= 1e-10, "identical").when(near, "acceptable").otherwise("regression")


def refit_variance(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of runs (run, keys, p): mean and largest difference, the latter as it is, however small. Runs are few; rows meet on their key."""
    a, b = runs.select(F.col("run").alias("run_a"), *keys, F.col("p").alias("p_a")), runs.select(F.col("run").alias("run_b"), *keys, F.col("p").alias("p_b"))
    both = a.join(b, keys).filter("run_a < run_b").withColumn("diff", F.abs(F.col("p_a") - F.col("p_b")))
    return both.groupBy("run_a", "run_b").agg(F.round(F.avg("diff"), 12).alias("mean_diff"), F.max("diff").alias("max_diff"), F.count("*").alias("n"))


def split_audit(deals: DataFrame) -> DataFrame:
    role = F.when(F.col("offer_price_quality_flag") == "manual_review", "train_only").otherwise("train_and_test")
    return deals.filter("completion_label IS NOT NULL").select("id", "juridiction", role.alias("use"))


def extraction_outcome(expected: Column, got: Column) -> Column:
    return (
        F.when(expected.isNull() & got.isNull(), "match_none").when(expected.isNull(), "false_positive").when(got.isNull(), "miss").when(expected == got, "match").otherwise("mismatch")
    )
