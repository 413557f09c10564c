"""Row numbers and running sums in the order of a key, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.operators.lineage import stored

#: Ranges of the key that are numbered on their own; one bound each is known to the driver.
RANGES = 256


def key_range(df: DataFrame, key: str, ranges: int = RANGES) -> Column:
    """The number of the key's range. The bounds are the keys of the ``ranges`` rows whose keys have the smallest hashes: a sample that is the same in every run and of bounded size. A key is compared with each 16th bound and then with the 16 from there."""
    sample = df.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(ranges)
    bounds = sorted({r[0] for r in sample.collect()})
    if not bounds:
        return F.lit(0)

    def upto(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: b <= F.col(key)))

    blocks = [bounds[k : k + 16] for k in range(0, len(bounds), 16)]
    block = upto(F.array(*[F.lit(b[0]) for b in blocks]))
    inside = upto(F.get(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), block - 1))
    return F.when(block > 0, (block - 1) * 16 + inside).otherwise(0)


def carry(df: DataFrame, by: list[str], span: str, parts: dict[str, Column], fold: Callable[[str], Column]) -> DataFrame:
    """For each ``by`` and ``span`` the aggregates ``parts`` of earlier spans, put together by ``fold``. There is a row per span, not per row, so a window over a group's spans is small."""
    per = df.groupBy(*by, span).agg(*[v.alias(k) for k, v in parts.items()])
    earlier = W.partitionBy(*by).orderBy(span).rowsBetween(W.unboundedPreceding, -1)
    return per.select(*by, span, *[fold(k).over(earlier).alias(k) for k in parts])


#: Rows that an exact selection hands to the driver, about, and the accuracy of the brackets it begins with.
SELECTED = 100_000
ACCURACY = 10_000


def values_at(df: DataFrame, key: str, places: dict[str, tuple[float, Callable[[int], int]]], more: dict[str, Column]) -> tuple[dict, dict]:
    """The values of a numeric ``key`` at places in ascending order, and the aggregates ``more``, exactly.

    ``places`` has by name the share of rows up to the place, near enough, and the place from 1 for n rows. One pass
    brackets each place by a quantile sketch, whose error is bounded; a second counts what is before, between and in
    the brackets, value by value inside. Where brackets would hold more than ``SELECTED`` rows, as in billions, they
    are narrowed by a pass each first. ``more`` comes from the first pass. No place has a value if there are no rows.
    """
    x = df.select(F.col(key).cast("double").alias("x")).filter("x IS NOT NULL")
    wide = 3 / ACCURACY
    edges = [min(1.0, max(0.0, share + side * wide)) for share, _ in places.values() for side in (-1, 1)]
    first = x.agg(F.count("*").alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max"), F.percentile_approx("x", edges, ACCURACY).alias("_edges"), *[v.alias(k) for k, v in more.items()]).first().asDict()
    n = first.pop("_n")
    low, high, sketch = first.pop("_min"), first.pop("_max"), first.pop("_edges")
    if not n:
        return {k: None for k in places}, first
    wanted = {k: place(n) for k, (_, place) in places.items()}
    few = n <= SELECTED
    brackets = {k: (low, high) if few else (sketch[2 * m], sketch[2 * m + 1]) for m, k in enumerate(places)}
    share = 3 * wide * len(places)
    while not few and n * share > SELECTED:
        row = x.agg(*[f(F.when(c, 1)).alias(f"{k}_{w}") for k, (a, b) in brackets.items() for w, f, c in (("before", F.count, F.col("x") < a), ("inside", F.count, F.col("x").between(a, b)))]).first()
        aim = {k: (wanted[k] - row[f"{k}_before"]) / max(row[f"{k}_inside"], 1) for k in places}
        cut = [F.percentile_approx(F.when(F.col("x").between(*brackets[k]), F.col("x")), [min(1.0, max(0.0, aim[k] + side * wide)) for side in (-1, 1)], ACCURACY).alias(k) for k in places]
        found = x.agg(*cut).first()
        brackets, share = {k: tuple(found[k]) for k in places}, share * 3 * wide
    spans = sorted(set(brackets.values()))
    merged: list[list[float]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    region, value = F.lit(2 * len(merged)), F.lit(None).cast("double")
    for m in range(len(merged) - 1, -1, -1):
        a, b = merged[m]
        region = F.when(F.col("x") < a, 2 * m).when(F.col("x") <= b, 2 * m + 1).otherwise(region)
        value = F.when(F.col("x").between(a, b), F.col("x")).otherwise(value)
    counts = sorted(x.groupBy(region.alias("region"), value.alias("value")).agg(F.count("*").alias("n")).collect(), key=lambda r: (r.region, r.value if r.value is not None else 0.0))
    out, upto = {}, 0
    for r in counts:
        upto += r.n
        for k, place in wanted.items():
            if k not in out and place <= upto:
                if r.value is None:
                    raise ValueError(f"{k} isn't in its bracket")
                out[k] = r.value
    return out, first


def running_sum(df: DataFrame, key: str, weight: Column, by: tuple[str, ...] = (), name: str = "upto", ranges: int = RANGES, then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``weight`` up to and with each row, in the order of ``key`` and ``then`` (nulls first) within ``by``.

    Each range is summed on its own; the sums of the ranges before, of which there are few, are added. Rows that share
    a key are in one range, ordered by ``then`` and else in no particular order. Columns ``by`` compare null-safely.
    """
    rows = df.withColumn("_weight", weight).withColumn("_range", key_range(df, key, ranges))
    whole = rows.groupBy(*by, "_range").agg(F.sum("_weight").alias("_sum"))
    before = whole.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = F.col("_range").eqNullSafe(F.col("_r"))  # as ``==`` it would carry the range's expression over to the other side
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    here = F.sum("_weight").over(W.partitionBy(*by, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in (key, *then)]).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_here", here).join(before, same).withColumn(name, F.col("_before") + F.col("_here")).select(*df.columns, name)


def number_rows(df: DataFrame, key: str, by: tuple[str, ...] = (), name: str = "n", ranges: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the number of each row from 1, in the order of ``key`` and ``then`` (nulls first) within ``by``.

    Rows are dealt into ranges of that order, sorted there and written once with their places in the range; where a
    range begins follows from the counts of the ranges before, of which there are few. So ``df`` is not evaluated again
    for the counts, and no window holds a range. Without ``ranges`` there are as many as the shuffle has partitions.
    """
    order = [F.col(c).asc_nulls_first() for c in (*by, key, *then)]
    placed = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    rows = stored(placed.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    held = rows.groupBy(*by, "_range").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"), (F.coalesce(F.sum("_held").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    return rows.join(starts if by else F.broadcast(starts), same).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)  # a row per range
