"""Pareto order sampling: how often documents are taken, and how near sources come to their targets."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidframe.llm import mixing


def plain_class(size):
    return 4 * size.bit_length() + size * 4 // (1 << (size.bit_length() - 1)) - 4 if size else 0


def test_size_classes(spark):
    sizes = [*range(0, 70), 255, 256, 1000, 65_535, 65_536, 10**9]
    got = spark.createDataFrame([(s,) for s in sizes], "size long").select("size", mixing.size_class(F.col("size")).alias("c")).collect()
    assert {r["size"]: r.c for r in got} == {s: plain_class(s) for s in sizes}
    per = defaultdict(list)
    for s in sizes[1:]:
        per[plain_class(s)].append(s)
    assert all(max(x) <= 1.25 * min(x) for x in per.values())


def test_documents_are_taken_as_often_as_their_inclusion_says(spark):
    """Two sources; in each, one stratum of sizes from 64 to 79: the share taken of every size is its inclusion probability, and their number is fixed."""
    rows = [(k, "w " * (64 + k % 16), "a" if k < 20_000 else "b") for k in range(36_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mixing.mix_sources(docs).toPandas()
    assert set(got["size"].map(plain_class)) == {plain_class(64)}
    for source, part in got.groupby("source"):
        whole = int(part.target.iloc[0] / part.source_size.iloc[0])
        extra = part.copies - whole
        assert set(extra) == {0, 1} and extra.sum() == pytest.approx(part.inclusion.sum(), abs=1e-6)
        by_size = part.assign(extra=extra).groupby("size").agg(share=("extra", "mean"), p=("inclusion", "first"), n=("extra", "size"))
        assert by_size.p.is_monotonic_increasing and by_size.p.max() > 1.05 * by_size.p.min()
        sigma = np.sqrt(by_size.p * (1 - by_size.p) / by_size.n)
        assert (abs(by_size.share - by_size.p) < 4 * sigma).all()
        assert part.taken.sum() == pytest.approx(part.target.iloc[0], rel=0.002)


def test_sources_come_near_their_targets(spark):
    got = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    for _, part in got.groupby("source", dropna=False):
        assert part.taken.sum() == pytest.approx(part.target.iloc[0], rel=0.01)
    assert (got.taken <= 3 * got["size"]).all() and got.inclusion.between(0, 1).all()


def test_repeated_ids_and_clashing_columns(spark):
    columns = "doc_id long, text string, source string, class int, n int, p double, f double, s string, c int, held int, cut int"
    rows = [(k // 3, "w " * (10 + k % 5), None if k % 2 else "a", 1, 2, 0.5, 0.5, "x", 1, 2, 3) for k in range(600)]
    docs = spark.createDataFrame(rows, columns)
    one, two = ([(r.doc_id, r["size"], r.taken) for r in mixing.mix_sources(d).collect()] for d in (docs, docs.repartition(5)))
    assert len(one) == 600 and Counter(one) == Counter(two)
