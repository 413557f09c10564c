"""Row numbers over ranges equal those of one sorted list."""

import pytest

from bidframe.operators import ordering, quality


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_numbers_in_order(spark, ranges):
    rows = [(f"k{(k * 7919) % 501:04d}", None if k % 3 == 0 else k % 3) for k in range(501)]
    df = spark.createDataFrame(rows, "key string, part int").repartition(5)
    got = ordering.number_rows(df, "key", ranges=ranges).collect()
    assert [(r.key, r.n) for r in sorted(got, key=lambda r: r.n)] == [(k, n) for n, k in enumerate(sorted(k for k, _ in rows), 1)]
    got = ordering.number_rows(df, "key", ("part",), ranges=ranges).collect()
    for part in (None, 1, 2):
        want = sorted(k for k, p in rows if p == part)
        assert [r.key for r in sorted((r for r in got if r.part == part), key=lambda r: r.n)] == want and {r.n for r in got if r.part == part} == set(range(1, len(want) + 1))


def test_distribution_of_few_values(spark):
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 40 + [7.0, 9.0]):
        got = quality.distribution(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x").collect()
        n = len(values)
        row = got[0]
        assert row.n == n
        if n:
            s = sorted(values)
            assert (row.p05, row.median, row.p95) == (s[max(0, int(0.05 * n) - 1)], (s[(n - 1) // 2] + s[n // 2]) / 2, s[min(n, max(1, int(0.95 * n))) - 1])


@pytest.mark.parametrize("selected,accuracy", [(100_000, 10_000), (50, 100), (10, 20)])
def test_exact_places_by_narrowing(spark, monkeypatch, selected, accuracy):
    """Brackets narrowed pass by pass give the values of a sorted list, with ties and heavy values."""
    import random

    monkeypatch.setattr(ordering, "SELECTED", selected)
    monkeypatch.setattr(ordering, "ACCURACY", accuracy)
    draw = random.Random(selected)
    for values in ([draw.gauss(0, 1) for _ in range(3001)], [float(draw.randrange(4)) for _ in range(2000)] + [draw.random() for _ in range(500)], [7.0] * 300):
        row = quality.distribution(spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(7), "x").first()
        s, n = sorted(values), len(values)
        assert (row.n, row.p05, row.median, row.p95) == (n, s[max(1, n * 5 // 100) - 1], (s[(n - 1) // 2] + s[n // 2]) / 2, s[max(1, n * 95 // 100) - 1])


@pytest.mark.parametrize("by", [(), ("part",)])
def test_numbering_evaluates_its_rows_for_bounds_and_once(spark, by):
    """The bounds take a pass over the rows and the numbering one; counts and places come from what that wrote."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def key(v):
        seen.add(1)
        return (v * 7919) % 1009

    rows = spark.range(1009).repartition(4).withColumn("key", key.asNondeterministic()("id")).withColumn("part", F.col("id") % 3)
    got = ordering.number_rows(rows, "key", by).collect()
    assert seen.value <= 2 * 1009
    for part in {0, 1, 2} if by else {None}:
        some = sorted((r for r in got if part in (None, r.part)), key=lambda r: r.n)
        assert [r.key for r in some] == sorted((v * 7919) % 1009 for v in range(1009) if part in (None, v % 3)) and [r.n for r in some] == list(range(1, len(some) + 1))


def test_small_caps_in_the_order_of_numbers(spark):
    """Rows alike in flag and deviation go by the number of their deal, below zero too."""
    from bidframe.operators import pricing

    asked = spark.createDataFrame([(k, "T1", "2024-01-10", 11.0) for k in (5, -3, 12, -5)], "deal_id long, ticker string, d string, offer_price double").selectExpr("deal_id", "ticker", "CAST(d AS DATE) AS d", "CAST(offer_price AS DECIMAL(18,6)) AS offer_price")
    closes = spark.createDataFrame([("T1", "2024-01-09", 10.0)], "ticker string, d string, close double").selectExpr("ticker", "CAST(d AS DATE) AS d", "CAST(close AS DECIMAL(18,6)) AS close")
    assert [r.deal_id for r in sorted(pricing.validate_small_caps(asked, closes).collect(), key=lambda r: r.pos)] == [-5, -3, 5, 12]


def test_metrics_evaluate_their_rows_once(spark):
    """AUC and losses come from the counts per distinct prediction."""
    from pyspark.sql import functions as F

    from bidframe.operators import metrics

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def guess(v):
        seen.add(1)
        return (v * 37 % 11) / 10

    rows = spark.range(400).repartition(4).select((F.col("id") % 2).alias("g"), guess.asNondeterministic()("id").alias("p"), F.when(F.col("id") % 9 > 0, (F.col("id") % 3 == 0).cast("int")).alias("y"))
    got = {r.g: r for r in metrics.metrics(rows, "p", "y", ["g"]).collect()}
    assert seen.value == 400
    want = {r.g: r for r in metrics.losses(rows, "p", "y", ["g"]).collect()}
    for g in (0, 1):
        assert all(got[g][c] == pytest.approx(want[g][c], abs=1e-8) for c in ("brier", "log_loss", "accuracy", "f1"))
