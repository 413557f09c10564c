"""The completion model: imputation, elastic-net logistic regression, isotonic calibration, inference."""

from __future__ import annotations

import json
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.operators.decisions import call, stars
from bidframe.operators.fitting import chained_maps, fit_isotonic, fit_logistic, gap_mask, gap_sums, interpolate, largest_moves
from bidframe.operators.lineage import stored
from bidframe.operators.metrics import chronological_folds, metrics, stratified_folds

NUMERIC = ["bid_premium_pct", "relative_size", "min_acceptance_threshold", "days_to_expected_close", "events_count"]
CATEGORICAL = ["deal_type", "payment_type", "juridiction", "target_sector", "acquirer_type"]
BOOLEAN = ["cross_border", "has_irrevocable_undertaking", "fdi_risk_flag"]
LEAST_LABELS = 20
#: Labelled rows a task of a solver, about.
TASK_ROWS = 50_000
#: Smaller coefficients count as zero.
ZERO = 1e-9


def flatten(features: DataFrame) -> DataFrame:
    """Null categories to ``unknown``, booleans to 0 and 1; numbers stay null where missing."""
    return features.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in CATEGORICAL} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in BOOLEAN} | {c: F.col(c).cast("double") for c in NUMERIC})


class ScoringModel:
    """Fitted on a flattened frame with ``label``; everything that is fitted is small, whatever the number of rows.

    ``numeric`` are the columns that have numbers; ``maps`` fill their gaps (``fitting.chained_maps``); ``centres``
    and ``scales`` bring them to one size. ``names`` are the features of ``base``, coefficients and shift of the full
    model; ``calibrated`` has for each fold a model without it and the points that calibrate it.
    """

    def __init__(self, rounds: int = 20, folds: int = 3, tolerance: float = 1e-3):
        self.rounds, self.folds, self.tolerance = rounds, folds, tolerance

    def fit(self, rows: DataFrame, version: str = "v1", calibrate: bool = True) -> ScoringModel:
        """Refuses to fit on fewer than 20 labelled rows or one class. A model that isn't calibrated has coefficients but can't predict."""
        found = fit_models(rows.withColumn("grp", F.lit(0)), [0], version, calibrate, self)[0]
        if isinstance(found, str):
            raise ValueError(found)
        self.__dict__.update(found.__dict__)
        return self

    def set_numbers(self, sums: dict, numeric: list[str], maps: np.ndarray) -> None:
        """Keep the maps, and centre and scale of the filled numbers, which the same sums give."""
        self.numeric, self.maps = numeric, maps.tolist()
        k = len(numeric)
        moments = np.zeros((k + 1, k + 1))
        for m, (s, _) in sums.items():
            whole = np.vstack((maps[m], np.eye(k + 1)[-1]))
            moments += whole @ s @ whole.T
        mean = moments[:k, k] / moments[k, k]
        scale = np.sqrt(np.maximum(np.diag(moments)[:k] / moments[k, k] - mean**2, 0))
        self.centres = mean.tolist()
        self.scales = [float(v) if v > 1e-9 * (1 + abs(m)) else 1.0 for v, m in zip(scale, mean)]

    def numbers(self) -> Column:
        """The numeric columns as an array, their gaps filled by the map of the row's nulls."""
        if not self.numeric:
            return F.array().cast("array<double>")
        maps = F.from_json(F.lit(json.dumps(self.maps)), "array<array<array<double>>>")
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.numeric], F.lit(1.0))
        own = F.get(maps, gap_mask(self.numeric))
        return F.transform(own, lambda line: F.aggregate(F.zip_with(line, x, lambda w, v: w * v), F.lit(0.0), lambda a, b: a + b))

    def features(self) -> Column:
        numbers = F.transform(self.numbers(), lambda v, k: (v - F.get(F.array(*[F.lit(c) for c in self.centres]), k)) / F.get(F.array(*[F.lit(c) for c in self.scales]), k)) if self.numeric else self.numbers()
        flags = [(F.col(c) == v).cast("double") for c, values in self.categories.items() for v in values]
        return F.concat(numbers, F.array(*flags, *[F.col(c).cast("double") for c in BOOLEAN]))

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}_{v}" for c, values in self.categories.items() for v in values], *BOOLEAN]

    @staticmethod
    def margin(features: Column, weights: list[float]) -> Column:
        return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights[:-1]]), lambda x, w: x * w), F.lit(float(weights[-1])), lambda a, b: a + b)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p, the mean of the calibrated models, and contributions (coefficient times value) of the full model."""
        df = rows.withColumn("_features", self.features())
        df = df.withColumns({f"_margin{k}": self.margin(F.col("_features"), w) for k, (w, _, _) in enumerate(self.calibrated)})
        p = sum((interpolate(F.col(f"_margin{k}"), x, y) for k, (_, x, y) in enumerate(self.calibrated)), F.lit(0.0)) / len(self.calibrated)
        weights, names = F.array(*[F.lit(float(w)) for w in self.base[:-1]]), F.array(*[F.lit(n) for n in self.names])
        parts = F.zip_with(names, F.zip_with("_features", weights, lambda x, w: x * w), lambda n, v: F.struct(v.alias("value"), n.alias("name")))
        return df.select(*rows.columns, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), parts.alias("contributions"))

    def coefficients(self, rows: DataFrame) -> DataFrame:
        return rows.sparkSession.createDataFrame(list(zip(self.names, map(float, self.base[:-1]))), "feature string, coefficient double")

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        SparkSession.active().createDataFrame([(json.dumps(self.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> ScoringModel:
        model = cls()
        model.__dict__.update(json.loads(spark.read.text(path).first()[0]))
        return model


def fit_models(rows: DataFrame, groups: list[int], version: str = "v1", calibrate: bool = True, like: ScoringModel | None = None) -> dict[int, ScoringModel | str]:
    """A model for the rows of each group ``grp``, or why there is none; all of them are fitted in the same passes.

    1. Rows and positives per group, and the values of the categories.
    2. Sums of products per group and set of missing numbers, from which all chained regressions are solved; one more
       pass says after which round the filled numbers have settled.
    3. Steps of the logistic fits: the full model and one without each calibration fold, for every group at once.
    4. The calibration of each fold.
    """
    like = like or ScoringModel()
    folds = like.folds if calibrate else 0
    rows = rows.filter("label IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in NUMERIC}).cache()  # labelled clusters, read by every pass
    held = {r.grp: r for r in rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), *[F.count(c).alias(c) for c in NUMERIC]).collect()}
    out: dict[int, ScoringModel | str] = {}
    for g in groups:
        n, pos = (held[g]["n"], int(held[g]["pos"])) if g in held else (0, 0)
        if n < LEAST_LABELS or pos in (0, n):
            out[g] = f"{n} labelled rows, {pos} of them positive: too few to fit on"
    live = [g for g in groups if g not in out]
    if live:
        kinds = rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in CATEGORICAL]).first().asDict()
        models = {g: ScoringModel(like.rounds, like.folds, like.tolerance) for g in live}
        numeric = {g: [c for c in NUMERIC if held[g][c]] for g in live}
        sums, maps = {}, {}
        for columns in {tuple(c) for c in numeric.values() if c}:  # groups of like columns
            some = [g for g in live if tuple(numeric[g]) == columns]
            sums |= gap_sums(rows.filter(F.col("grp").isin(some)), "grp", list(columns))
        for g in live:
            maps[g] = chained_maps(sums[g], len(numeric[g]), like.rounds, 1e-3) if numeric[g] else [np.zeros((1, 0, 1))]
        moved = largest_moves(rows, "grp", numeric, maps)
        for g, model in models.items():
            largest = max((v for _, v in sums[g].values()), default=0.0) if numeric[g] else 0.0
            settled = np.flatnonzero(moved[g] < like.tolerance * largest)
            model.rounds_run = int(settled[0]) + 1 if len(settled) else len(moved[g])
            model.categories = {c: list(v) for c, v in kinds.items()}
            model.set_numbers(sums.get(g, {0: (np.array([[float(held[g]["n"])]]), 0.0)}), numeric[g], maps[g][model.rounds_run])
            model.info = {"version": version, "n": held[g]["n"], "positive": int(held[g]["pos"])}
        ready = None
        for g, model in models.items():
            part = rows.filter(F.col("grp") == g).select("grp", "label", "representative_deal_id", model.features().alias("features"))
            # groups may have other columns, so features are brought to one width
            width = max(len(m.names) for m in models.values())
            part = part.withColumn("features", F.concat("features", F.array_repeat(F.lit(0.0), width - len(model.names))))
            ready = part if ready is None else ready.unionByName(part)
        ready = ready.withColumn("_class", F.concat_ws(":", "grp", F.col("label").cast("int")))
        ready = (stratified_folds(ready, "_class", folds, "representative_deal_id") if folds else ready.withColumn("fold", F.lit(-1))).withColumnRenamed("fold", "part")
        ready = ready.coalesce(max(1, ceil(sum(held[g]["n"] for g in live) / TASK_ROWS))).cache()  # few rows, few tasks
        per = ready.groupBy("grp", "part").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()
        counts = {(g, k): tuple(int(sum(r[c] for r in per if r.grp == g and r.part != k)) for c in ("n", "pos")) for g in live for k in range(folds + 1)}
        for g in live:
            bad = [k for k in range(folds + 1) if counts[g, k][1] in (0, counts[g, k][0])]
            if bad:
                out[g] = f"{counts[g, 0][0]} labelled rows, {counts[g, 0][1]} of them positive: too few to fit on"
        live = [g for g in live if g not in out]
        fits = fit_logistic(ready, {m: c for m, c in counts.items() if m[0] in live}, width) if live else {}
        cut = lambda g, w: [*w[: len(models[g].names)].tolist(), float(w[-1])]
        if folds and live:
            margin = None
            for (g, k), w in fits.items():
                if k:
                    margin = F.when((F.col("grp") == g) & (F.col("part") == k), ScoringModel.margin(F.col("features"), w.tolist())) if margin is None else margin.when((F.col("grp") == g) & (F.col("part") == k), ScoringModel.margin(F.col("features"), w.tolist()))
            points = fit_isotonic(ready.filter(F.col("grp").isin(live)).select("grp", "part", margin.alias("margin"), "label"))
        for g in live:
            models[g].base = cut(g, fits[g, 0])
            models[g].calibrated = [(cut(g, fits[g, k]), *points[g, k]) for k in range(1, folds + 1)]
            out[g] = models[g]
        ready.unpersist()
    rows.unpersist()
    return out


def top_factors(contributions, n: int = 3):
    """(positive, negative): names of the n largest contributions of each sign."""
    up = F.filter(contributions, lambda c: c["value"] > 0)
    down = F.filter(contributions, lambda c: c["value"] < 0)
    name = lambda arr: F.transform(F.slice(arr, 1, n), lambda c: c["name"])
    return F.struct(name(F.sort_array(up, asc=False)).alias("positive"), name(F.sort_array(down)).alias("negative"))


def score_clusters(model: ScoringModel, features: DataFrame) -> DataFrame:
    """p to 4 digits, stars, call and top factors of every cluster, in one pass."""
    got = model.predict(flatten(features)).withColumn("f", top_factors(F.col("contributions")))
    p = F.bround("p", 4)
    return got.select("target_name", "juridiction", F.col("representative_deal_id").alias("deal_id"), p.alias("p_completion"), stars(p).alias("score_stars"), call(p).alias("decision"), F.col("f.positive").alias("positive_factors"), F.col("f.negative").alias("risk_factors"))


def cross_validate(rows: DataFrame, folds: int = 3, gap_days: int = 90) -> DataFrame:
    """Per time fold the rows it trains on and validates, their first and last day, positives, negatives and metrics; fold 0 has the metrics over all validated rows. A fold that can't be fitted has a note and no metrics."""
    spark = rows.sparkSession
    labelled = stored(flatten(rows).filter("label IS NOT NULL").withColumn("day", F.col("earliest_announcement")))  # read for days, places and starts
    placed = stored(chronological_folds(labelled, folds, gap_days, "day", "representative_deal_id"))
    valid = F.col("role") == "valid"
    sides = {"train": ~valid, "valid": valid}
    ranges = [f(F.when(on, F.col("day"))).alias(f"{side}_{name}") for side, on in sides.items() for f, name in ((F.min, "from"), (F.max, "to"))]
    held = placed.groupBy("fold").agg(F.count_if(~valid).alias("train_n"), *ranges, F.count_if(valid & (F.col("label") == 0)).alias("n_neg"))
    held = spark.createDataFrame(held.collect(), held.schema)  # a row per fold
    scored, notes = None, []
    fitted = fit_models(placed.filter(~valid).withColumn("grp", F.col("fold")), list(range(1, folds + 1)))
    for fold, model in fitted.items():
        if isinstance(model, str):
            notes.append((fold, model))
            continue
        got = model.predict(placed.filter(valid & (F.col("fold") == fold))).select("fold", "label", "p")
        scored = got if scored is None else scored.unionByName(got)
    failed = spark.createDataFrame(notes, "fold int, note string")
    if scored is None:
        return failed.join(held, "fold", "left").withColumn("n", F.lit(None).cast("bigint"))
    scored = stored(scored)  # validated rows, read for several metrics
    per = metrics(scored.unionByName(scored.withColumn("fold", F.lit(0))), "p", "label", ["fold"]).withColumn("note", F.lit(None).cast("string"))
    report = per.unionByName(failed, allowMissingColumns=True).join(held, "fold", "left")
    report = report.withColumn("n_neg", F.when(F.col("note").isNull(), F.coalesce("n_neg", F.col("n") - F.col("n_pos"))))
    report = spark.createDataFrame(report.collect(), report.schema)  # a row per fold
    return report


def calibration_curve(predicted: DataFrame, bins: int = 5) -> DataFrame:
    """(mid, rate, n): the share of positives among rows (label, p) per bin of p."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return predicted.groupBy(F.round((at + 0.5) / bins, 6).alias("mid")).agg(F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


def extreme_coefficients(coefficients: DataFrame, n: int = 5) -> DataFrame:
    """(side, place, feature, coefficient): the n largest and the n smallest coefficients of a model, of which there are few."""
    sides = []
    for side, order in (("top", F.desc("coefficient")), ("bottom", F.asc("coefficient"))):
        place = F.row_number().over(W.orderBy(order, "feature"))
        sides.append(coefficients.select(F.lit(side).alias("side"), place.alias("place"), "feature", "coefficient").filter(F.col("place") <= n))
    return sides[0].unionByName(sides[1])


def validation_text(report: DataFrame, curve: DataFrame | None = None, extremes: DataFrame | None = None) -> str:
    """The report of ``cross_validate`` as lines of text, with the calibration and the extreme coefficients of the model on all rows; these tables have a row per fold, bin and coefficient."""

    def line(*values) -> str:
        return " | ".join("n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in values)

    names = ["fold", "train_n", "n", "n_pos", "n_neg", "auc", "brier", "train_from", "train_to", "valid_from", "valid_to", "note"]
    lines = ["Folds by date; fold 0 is all of them", line(*names)]
    lines += [line(*[r.asDict().get(k) for k in names]) for r in report.orderBy("fold").collect()]
    if curve is not None:
        lines += ["Calibration on all rows", line("mid", "rate", "n")] + [line(*r) for r in curve.orderBy("mid").collect()]
    if extremes is not None:
        lines += ["Coefficients on all rows", line("side", "place", "feature", "coefficient")] + [line(*r) for r in extremes.orderBy(F.desc("side"), "place").collect()]
    return "\n".join(lines)


def coefficient_stability(rows: DataFrame, steps: int = 3) -> DataFrame:
    """Per feature its coefficient on all labelled rows and the rank of its size, and what models fitted on ever longer pasts say: spread, times zeroed and a verdict.

    ``absent``: zero on all rows. ``present``: in two pasts or more and of one sign in all. Else ``indeterminate``.
    """
    days = flatten(rows).filter("label IS NOT NULL").cache()
    day = F.unix_date("earliest_announcement")
    cuts = days.agg(*[F.percentile(day, k / (steps + 1)) for k in range(1, steps + 1)]).first()
    pasts = F.filter(F.array(*[F.when(day <= cut, k) for k, cut in enumerate(cuts, 1)], F.lit(steps + 1)), lambda k: k.isNotNull())
    fitted = fit_models(days.withColumn("grp", F.explode(pasts)), list(range(1, steps + 2)), calibrate=False)
    refused = [m for m in fitted.values() if isinstance(m, str)]
    if refused:
        raise ValueError(refused[0])
    found = None
    for k, model in fitted.items():
        got = model.coefficients(days).withColumn("step", F.lit(k))
        found = got if found is None else found.unionByName(got)
    days.unpersist()
    last, c = F.col("step") == steps + 1, F.col("coefficient")
    g = found.groupBy("feature").agg(
        F.max(F.when(last, c)).alias("coefficient"), F.min(F.when(~last, c)).alias("low"), F.max(F.when(~last, c)).alias("high"), F.count_if(~last & (F.abs(c) < ZERO)).alias("zeroed"), F.count_if(~last).alias("steps"),
        F.count_if(~last & (c > 0)).alias("_up"),
    )
    absent = F.coalesce(F.abs("coefficient") < ZERO, F.lit(True))
    same = (F.col("steps") >= 2) & F.col("_up").isin(0, F.col("steps"))
    verdict = F.when(absent, "absent").when(same, "present").otherwise("indeterminate")
    rank = F.when(F.col("coefficient").isNotNull(), F.row_number().over(W.orderBy(F.abs("coefficient").desc_nulls_last(), "feature")))  # a row per feature
    return g.withColumn("rank", rank).withColumn("verdict", verdict).drop("_up")


def version_record(model: ScoringModel, rows: DataFrame, report: DataFrame, corrected: DataFrame) -> DataFrame:
    """One row on a model: in-sample metrics on all labelled clusters, pooled cross-validation metrics, and how many labelled clusters the corrected targets (target_name) touch."""
    labelled = flatten(rows).filter("label IS NOT NULL")
    scored = stored(model.predict(labelled).select("label", "p", F.lit(1).alias("k")))
    own = metrics(scored, "p", "label", ["k"]).select("k", F.col("n").alias("n_labelled"), F.col("auc").alias("auc_in_sample"), F.col("brier").alias("brier_in_sample"))
    held = report.filter("fold = 0").select(F.lit(1).alias("k"), *[F.col(c).alias(f"{c}_cv") for c in ("auc", "brier") if c in report.columns])
    touched = labelled.join(corrected.select("target_name").distinct(), "target_name", "left_semi").agg(F.count("*").alias("n_touched")).withColumn("k", F.lit(1))
    return own.join(held, "k", "left").join(touched, "k").drop("k").withColumn("version", F.lit(model.info["version"]))
