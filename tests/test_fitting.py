"""Fits by sums against the library's own estimators and plain loops."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import functions as F

from bidframe.operators import fitting


def test_ridge_is_the_library_s(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1.0, 20.0, 0.1] + [0, 5, -2]
    y = x @ [2.0, -0.3, 7.0] + rng.normal(size=400) * 3
    fit = LinearRegression(featuresCol="f", labelCol="y", regParam=1e-3).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")))
    z = np.concatenate((x, y[:, None], np.ones((400, 1))), axis=1)
    w, shift = fitting.ridge(z.T @ z, 3, [0, 1, 2], 1e-3)
    assert w == pytest.approx(list(fit.coefficients), rel=1e-5) and shift == pytest.approx(fit.intercept, rel=1e-5)


def test_chained_fills_equal_a_loop(spark):
    """Maps from sums fill as regressions over all rows do, round by round."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 3
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), 1.0, x[:, 3])
    rows = spark.createDataFrame([(k % 2, *[None if np.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)], "g int, a double, b double, c double, d double")
    sums = fitting.gap_sums(rows, "g", list("abcd"))
    for g in (0, 1):
        own = x[g::2]
        gap, filled = np.isnan(own), np.where(np.isnan(own), np.nanmean(own, axis=0), own)
        maps = fitting.chained_maps(sums[g], 4, 3, 1e-3)
        moves = []
        for r in range(4):
            mask = (gap << np.arange(4)).sum(axis=1)
            got = np.stack([maps[r][m] @ np.append(np.nan_to_num(v), 1.0) for m, v in zip(mask, own)])
            assert got == pytest.approx(filled, rel=1e-7)
            before = filled.copy()
            for c in (0, 1, 2):
                others = [o for o in range(4) if o != c]
                z = np.concatenate((filled[~gap[:, c]], np.ones(((~gap[:, c]).sum(), 1))), axis=1)
                w, shift = fitting.ridge(z.T @ z, c, others, 1e-3)
                filled[gap[:, c], c] = filled[gap[:, c]][:, others] @ w + shift
            moves.append(np.abs(filled - before).max())
        assert fitting.largest_moves(rows.filter(f"g = {g}"), "g", {g: list("abcd")}, {g: maps})[g] == pytest.approx(moves[:3], rel=1e-7)


def test_logistic_models_in_shared_passes(spark):
    """Each of several models, over its own rows, is the library's with the same penalty."""
    rng = np.random.default_rng(3)
    n = 600
    x = np.concatenate((rng.normal(size=(n, 3)), (rng.random((n, 2)) < 0.3).astype(float)), axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.5, 0, -1, 2, 0] - 0.5)))).astype(float)
    rows = spark.createDataFrame([(int(k % 2), int(k % 3 + 1), r.tolist(), float(v)) for k, (r, v) in enumerate(zip(x, y))], "grp int, part int, features array<double>, label double").repartition(4)
    k = np.arange(n)
    on = {(g, p): (k % 2 == g) & (k % 3 + 1 != p) for g in (0, 1) for p in range(4)}
    fits = fitting.fit_logistic(rows, {m: (int(v.sum()), int(y[v].sum())) for m, v in on.items()}, 5)
    assert set(fits) == set(on)
    for m in ((0, 0), (1, 2)):
        some, pos = int(on[m].sum()), int(y[on[m]].sum())
        own = rows.filter((F.col("grp") == m[0]) & (F.col("part") != m[1])).withColumn("f", array_to_vector("features")).withColumn("w", F.when(F.col("label") == 1, some / 2 / pos).otherwise(some / 2 / (some - pos)))
        fit = LogisticRegression(featuresCol="f", labelCol="label", weightCol="w", elasticNetParam=0.5, regParam=1.0 / some, standardization=False, maxIter=500, tol=1e-10).fit(own)
        assert fits[m][:-1].tolist() == pytest.approx(list(fit.coefficients), abs=2e-4) and fits[m][-1] == pytest.approx(fit.intercept, abs=2e-4)


def test_steps_do_not_grow_with_rows(monkeypatch):
    """Flags of all kinds add up to the shift, so only penalties tell solutions apart, and these fall with the rows: neither passes nor what is left to gain may grow for it."""
    rng = np.random.default_rng(4)
    n = 3000
    flags = np.concatenate([np.eye(k)[rng.integers(0, k, n)] for k in (5, 3)], axis=1)
    x = np.concatenate((rng.normal(size=(n, 2)), flags, flags[:, :1] + flags[:, 1:2], np.ones((n, 2))), axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 0.3 + x[:, 3] * 0.1 - 0.1)))).astype(float)
    passes = []

    def sums(rows, models):  # of ``rows`` copies of each row
        passes.append(len(models))
        out = {}
        for m, (beta, up, down) in models.items():
            z, w = x @ beta, np.where(y == 1, up, down)
            p = 1 / (1 + np.exp(-z))
            out[m] = tuple(rows * v for v in ((w * (np.logaddexp(0, z) - y * z)).sum(), x.T @ (w * (p - y)), x.T @ (x * (w * p * (1 - p))[:, None])))
        return out

    monkeypatch.setattr(fitting, "logistic_sums", sums)
    for copies in (1, 300, 30_000):
        passes.clear()
        beta = fitting.fit_logistic(copies, {(0, 0): (n * copies, int(y.sum()) * copies)}, x.shape[1] - 1)[0, 0]
        assert len(passes) <= 8
        up, down = n / 2 / y.sum(), n / 2 / (n - y.sum())
        _, slope, _ = sums(1, {(0, 0): (beta, up, down)})[0, 0]
        penalty = np.append(np.full(len(beta) - 1, 0.5 / n / copies), 0.0)
        slope = slope / n + penalty * beta
        left = np.where((beta != 0) | (penalty == 0), np.abs(slope + penalty * np.sign(beta)), np.maximum(np.abs(slope) - penalty, 0))
        assert left.max() < 1e-10


def test_isotonic_points(spark):
    rng = np.random.default_rng(5)
    rows = [(g, p, float(np.round(v, 1)), float(rng.random() < 1 / (1 + np.exp(-v)))) for g in (0, 1) for p in (1, 2) for v in rng.normal(size=150) * 2]
    df = spark.createDataFrame(rows, "grp int, part int, margin double, label double").repartition(3)
    points = fitting.fit_isotonic(df)
    asked = spark.createDataFrame([(float(v),) for v in np.arange(-8, 8, 0.17)], "margin double")
    for key, (x, y) in points.items():
        assert x == sorted(x) and y == sorted(y)
        model = IsotonicRegression(featuresCol="margin", labelCol="label").fit(df.filter((F.col("grp") == key[0]) & (F.col("part") == key[1])))
        got = {r.margin: r.p for r in asked.select("margin", fitting.interpolate(F.col("margin"), x, y).alias("p")).collect()}
        assert got == pytest.approx({r.margin: r.prediction for r in model.transform(asked).collect()}, abs=1e-9)
    assert set(points) == {(0, 1), (0, 2), (1, 1), (1, 2)}
