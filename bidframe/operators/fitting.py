"""Fits of many small models by sums over the rows: imputation, elastic-net logistic regression, isotonic calibration.

What a fit needs of the rows are sums of fixed size, so models of all folds and groups share each pass over them, and
the driver solves systems of some dozens of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a logistic fit, at most, and the change of a coefficient at which it has settled.
MOST_STEPS, SETTLED = 40, 1e-8


# --------------------------------------------------------------------- gaps


def gap_mask(columns: list[str]) -> Column:
    """A number whose bits say which columns are null."""
    return sum((F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(columns)), F.lit(0))


def gap_sums(rows: DataFrame, group: str, columns: list[str]) -> dict[int, dict[int, tuple[np.ndarray, float]]]:
    """For each group and set of null columns: the sums of products of (numbers, 1), nulls taken as 0, and the largest number. One pass, and at most 2**columns rows a group."""
    x = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns] + [F.lit(1.0)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    largest = F.greatest(*[F.max(F.abs(v)) for v in x[:-1]]) if len(columns) > 1 else F.max(F.abs(x[0]))
    got = rows.groupBy(group, gap_mask(columns).alias("_mask")).agg(*[F.sum(x[i] * x[j]).alias(f"_s{i}_{j}") for i, j in pairs], largest.alias("_largest")).collect()
    out: dict[int, dict[int, tuple[np.ndarray, float]]] = {}
    for r in got:
        s = np.zeros((len(x), len(x)))
        for i, j in pairs:
            s[i, j] = s[j, i] = r[f"_s{i}_{j}"]
        out.setdefault(r[group], {})[r["_mask"]] = (s, r["_largest"])
    return out


def ridge(moments: np.ndarray, y: int, others: list[int], penalty: float) -> tuple[np.ndarray, float]:
    """Weights and shift of a linear regression of y on others, from sums of products with 1 as the last. The penalty is on weights of scaled columns, by the scale of y."""
    n = moments[-1, -1]
    mean = moments[:-1, -1] / n
    cov = moments[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    w = np.zeros(len(others))
    live = [k for k, o in enumerate(others) if scale[o] > 1e-12 * (1 + abs(mean[o]))]
    if live and scale[y] > 1e-12 * (1 + abs(mean[y])):
        at = [others[k] for k in live]
        a = cov[np.ix_(at, at)] / np.outer(scale[at], scale[at]) + np.eye(len(at)) * penalty / scale[y]
        w[live] = np.linalg.solve(a, cov[at, y] / scale[at] / scale[y]) * scale[y] / scale[at]
    return w, float(mean[y] - w @ mean[others])


def chained_maps(sums: dict[int, tuple[np.ndarray, float]], k: int, rounds: int, penalty: float) -> list[np.ndarray]:
    """For 0, 1, 2 ... rounds of chained regressions the filled numbers of a row: as gaps are filled by linear functions, one linear map for each set of null columns. Item r has shape (2**k, k, k + 1)."""
    total = sum(s for s, _ in sums.values())
    seen = np.array([sum(s[-1, -1] for m, (s, _) in sums.items() if not m >> c & 1) for c in range(k)])
    means = total[:k, -1] / np.maximum(seen, 1)
    maps = np.zeros((1 << k, k, k + 1))
    for m in range(1 << k):
        for c in range(k):
            maps[m, c, k if m >> c & 1 else c] = means[c] if m >> c & 1 else 1.0
    out = [maps.copy()]
    gaps = [c for c in range(k) if 0 < seen[c] < total[-1, -1]]
    for _ in range(rounds if gaps and k > 1 else 0):
        for c in gaps:
            moments = np.zeros((k + 1, k + 1))
            for m, (s, _) in sums.items():
                if not m >> c & 1:
                    whole = np.vstack((maps[m], np.eye(k + 1)[-1]))
                    moments += whole @ s @ whole.T
            others = [o for o in range(k) if o != c]
            w, shift = ridge(moments, c, others, penalty)
            for m in range(1 << k):
                if m >> c & 1:
                    maps[m, c] = w @ maps[m, others]
                    maps[m, c, k] += shift
        out.append(maps.copy())
    return out


def largest_moves(rows: DataFrame, group: str, columns: dict[int, list[str]], maps: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """Per group, for each round, the most that a filled number moved in it; one pass for all rounds and groups."""
    every = sorted({c for cols in columns.values() for c in cols})
    steps = {g: np.stack([b - a for a, b in zip(m, m[1:])]) for g, m in maps.items() if len(m) > 1}
    if not steps:
        return {g: np.zeros(0) for g in maps}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column(0).to_numpy()
            x = {c: batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k, c in enumerate(every)}
            for g in np.unique(groups).tolist():
                if g in steps:
                    own = np.stack([x[c][groups == g] for c in columns[g]], axis=1)
                    mask = (np.isnan(own) << np.arange(own.shape[1])).sum(axis=1)
                    full = np.concatenate((np.nan_to_num(own), np.ones((len(own), 1))), axis=1)
                    moved = np.zeros(len(steps[g]))
                    for m in np.unique(mask):
                        moved = np.maximum(moved, np.abs(np.einsum("rkj,nj->rnk", steps[g][:, m], full[mask == m])).max(axis=(1, 2)))
                    most[g] = np.maximum(most.get(g, 0.0), moved)
        flat = [(g, r, float(v)) for g, moved in most.items() for r, v in enumerate(moved)]
        yield pa.RecordBatch.from_pydict({"g": pa.array([f[0] for f in flat], pa.int32()), "r": pa.array([f[1] for f in flat], pa.int32()), "v": pa.array([f[2] for f in flat], pa.float64())})

    got = rows.select(F.col(group).cast("int"), *[F.col(c).cast("double") for c in every]).mapInArrow(run, "g int, r int, v double").groupBy("g", "r").agg(F.max("v").alias("v")).collect()
    out = {g: np.zeros(max(0, len(m) - 1)) for g, m in maps.items()}
    for row in got:
        out[row.g][row.r] = row.v
    return out


# --------------------------------------------------------------------- logistic regression


def newton_step(beta: np.ndarray, slope: np.ndarray, curve: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The least of the loss's quadratic at ``beta`` plus penalties, exactly, however small these are. Coefficients that are not zero are solved for as one; the first that would change its sign becomes zero; then the one with the steepest way out of zero joins. The sum falls with each solution, so no choice of signs comes twice."""
    u = beta.copy()
    whole, linear = curve + np.diag(l2), slope - curve @ beta
    live = np.diag(whole) > 1e-15
    sign = np.sign(u)
    on = live & ((u != 0) | (l1 == 0))
    for _ in range(100 * len(u)):
        at = np.flatnonzero(on)
        guess = np.zeros(len(u))
        guess[at] = np.linalg.solve(whole[np.ix_(at, at)], -linear[at] - whole[np.ix_(at, ~live)] @ u[~live] - l1[at] * sign[at])
        turned = at[(l1[at] > 0) & (guess[at] * sign[at] <= 0)]
        if len(turned):
            way = np.abs(u[turned]) / np.maximum(np.abs(u[turned] - guess[turned]), 1e-300)
            u[at] += way.min() * (guess[at] - u[at])
            u[turned[way.argmin()]] = 0.0
            on[turned[way.argmin()]] = False
            continue
        u[at] = guess[at]
        down = linear + whole @ u
        steep = np.where(live & ~on, np.abs(down) - l1, -np.inf)
        j = int(steep.argmax())
        if steep[j] <= 1e-12:
            break
        on[j], sign[j] = True, -np.sign(down[j])
    return u


def logistic_sums(rows: DataFrame, models: dict[tuple[int, int], tuple[np.ndarray, float, float]]) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """Loss, slope and curvature of weighted logistic models at their coefficients, in one pass over ``rows(grp, part, features, label)``.

    Model (g, k) is over the rows of group g, without those of part k, and has (coefficients with the shift last,
    weight of a positive row, weight of a negative one). Tasks hand on sums; they are added by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            groups, parts, y = (batch.column(k).to_numpy() for k in (0, 1, 3))
            lists = batch.column(2)
            x = np.concatenate((lists.flatten().to_numpy().reshape(len(groups), -1), np.ones((len(groups), 1))), axis=1)
            for (g, k), (beta, up, down) in models.items():
                on = (groups == g) & (parts != k)
                if on.any():
                    xs, ys = x[on], y[on]
                    w = np.where(ys == 1, up, down)
                    z = xs @ beta
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    loss = (w * (np.logaddexp(0, z) - ys * z)).sum()
                    sums = np.concatenate(([loss], xs.T @ (w * (p - ys)), (xs.T @ (xs * (w * p * (1 - p))[:, None])).ravel()))
                    total[g, k] = total.get((g, k), 0.0) + sums
        keys = [(g, k, n) for (g, k), v in total.items() for n in range(len(v))]
        values = np.concatenate(list(total.values())) if total else np.zeros(0)
        yield pa.RecordBatch.from_pydict({c: pa.array([x[n] for x in keys], pa.int32()) for n, c in enumerate("gkn")} | {"v": values})

    got = rows.select(F.col("grp").cast("int"), F.col("part").cast("int"), "features", F.col("label").cast("double")).mapInArrow(run, "g int, k int, n int, v double").groupBy("g", "k", "n").agg(F.sum("v").alias("v")).collect()
    out = {}
    for key, (beta, *_) in models.items():
        d = len(beta)
        flat = np.zeros(1 + d + d * d)
        for r in got:
            if (r.g, r.k) == key:
                flat[r.n] = r.v
        out[key] = (flat[0], flat[1 : 1 + d], flat[1 + d :].reshape(d, d))
    return out


def fit_logistic(rows: DataFrame, counts: dict[tuple[int, int], tuple[int, int]], width: int, mixing: float = 0.5) -> dict[tuple[int, int], np.ndarray]:
    """Coefficients, the shift last, of balanced elastic-net logistic models (g, k), all fitted in the same passes. ``counts`` has rows and positives of each; the penalty is 1 / rows, ``mixing`` of it on sizes and the rest on squares, none on the shift."""
    state = {m: {"at": np.zeros(width + 1), "best": None, "value": np.inf, "up": n / (2.0 * pos), "down": n / (2.0 * (n - pos)), "n": n} for m, (n, pos) in counts.items()}
    live = dict(state)
    for _ in range(MOST_STEPS):
        sums = logistic_sums(rows, {m: (s["at"], s["up"], s["down"]) for m, s in live.items()})
        for m, s in list(live.items()):
            loss, slope, curve = (v / s["n"] for v in sums[m])  # the weights sum to the number of rows
            l1, l2 = np.full(width + 1, mixing / s["n"]), np.full(width + 1, (1 - mixing) / s["n"])
            l1[-1] = l2[-1] = 0.0
            value = loss + (l1 * np.abs(s["at"])).sum() + (l2 * s["at"] ** 2).sum() / 2
            if value > s["value"] + 1e-12:
                s["at"] = (s["at"] + s["best"]) / 2
                continue
            s["best"], s["value"] = s["at"], value
            s["at"] = newton_step(s["best"], slope, curve, l1, l2)
            if np.abs(s["at"] - s["best"]).max() < SETTLED:
                s["best"] = s["at"]
                del live[m]
        if not live:
            break
    return {m: s["best"] for m, s in state.items()}


# --------------------------------------------------------------------- isotonic regression


def pool(blocks: Iterator[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Neighbouring blocks (low, high, sum, n), in ascending order, pooled until their means rise."""
    out: list[tuple[float, float, float, float]] = []
    for low, high, s, n in blocks:
        while out and out[-1][2] * n >= s * out[-1][3]:
            a, _, t, m = out.pop()
            low, s, n = a, s + t, n + m
        out.append((low, high, s, n))
    return out


def fit_isotonic(rows: DataFrame) -> dict[tuple[int, int], tuple[list[float], list[float]]]:
    """Points (x, y) of the isotonic regression of label on margin for each model of ``rows(grp, part, margin, label)``. Ranges of margins are pooled in tasks, and the few blocks that are left on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key, blocks):
            return pa.RecordBatch.from_pydict({"g": pa.array([key[0]] * len(blocks), pa.int32()), "k": pa.array([key[1]] * len(blocks), pa.int32())} | {c: pa.array([b[n] for b in blocks], pa.float64()) for n, c in enumerate(("low", "high", "s", "n"))})

        key, held = None, []
        for batch in batches:
            for g, k, margin, s, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (g, k) != key:
                    if held:
                        yield told(key, held)
                    key, held = (g, k), []
                held = held[:-1] + pool(iter([*held[-1:], (margin, margin, s, n)])) if held and held[-1][2] * n < s * held[-1][3] else pool(iter([*held, (margin, margin, s, n)]))
        if held:
            yield told(key, held)

    each = rows.groupBy(F.col("grp").cast("int").alias("g"), F.col("part").cast("int").alias("k"), "margin").agg(F.sum(F.col("label").cast("double")).alias("s"), F.count("*").cast("double").alias("n"))
    got = each.repartitionByRange("g", "k", "margin").sortWithinPartitions("g", "k", "margin").mapInArrow(run, "g int, k int, low double, high double, s double, n double").collect()
    out = {}
    for key in sorted({(r.g, r.k) for r in got}):
        x, y = [], []
        for low, high, s, n in pool(sorted((r.low, r.high, r.s, r.n) for r in got if (r.g, r.k) == key)):
            for at in [low] if low == high else [low, high]:
                x.append(float(at))
                y.append(float(s / n))
        out[key] = (x, y)
    return out


def interpolate(value: Column, x: list[float], y: list[float]) -> Column:
    """The points' line at ``value``; their ends beyond them."""
    xs, ys = F.array(*[F.lit(v) for v in x]), F.array(*[F.lit(v) for v in y])
    at = F.size(F.filter(xs, lambda b: b <= value))
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    return F.when(at == 0, F.lit(y[0])).when(at == len(x), F.lit(y[-1])).otherwise(y0 + (y1 - y0) * (value - x0) / (x1 - x0))
