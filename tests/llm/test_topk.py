"""Exact top-k: large components, repeated ids, empty vectors, and how many blocks meet."""

import math

import numpy as np
from pyspark.sql import functions as F

from bidframe.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank int, bin int, score string, x double"
LEAST, MOST = -(2**63), 2**63 - 1


def brute(rows, k=10):
    """(query_id, rank, vec_id, score) of all rows, each that asks with every other; products kept within 64 bits."""
    rows = [(i, tuple(math.floor(1024 * x) if abs(1024 * x) < 2**53 else int(1024 * x) for x in v)) for i, v in rows]
    out = []
    for n, (q, x) in enumerate(rows):
        if q % 100 == 0:
            found = sorted((-min(max(sum(a * b for a, b in zip(x, y)), LEAST), MOST), i) for m, (i, y) in enumerate(rows) if m != n and len(y) == len(x))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, 2, "s", 0.5) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k).select("query_id", "rank", "vec_id", "score").collect())


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    for k, big in enumerate((1e13, -1e13, 3e15, 1e30, -1e30, 2.0**52)):
        for i in (400 + k, 500 + 100 * k):
            rows.append((i, [big, *rng.normal(size=7).tolist()]))
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_and_empty_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 130, np.round(rng.normal(size=4), 1).tolist()) for k in range(400)]
    rows += rows[:50] + [(700, []), (701, []), (800, [0.0] * 4), (801, [0.0] * 4), (100, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)


def test_blocks_of_mixed_lengths_meet_only_where_they_can_enter(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=6) * 2.0 ** rng.integers(-6, 5)).tolist()) for k in range(4000)]
    assert run(spark, rows) == brute(rows)
    # with thresholds as a first block gives them, most pairs of blocks don't meet
    df = spark.createDataFrame([(k, v, float(np.linalg.norm(v))) for k, v in rows], "vec_id long, x array<double>, length double").withColumn("dim", F.lit(6)).withColumn("bin", topk._length_bin(F.col("length")))
    blocks = topk.length_blocks(df)
    assert blocks.filter("held > 64 * blocks OR held <= 64 * (blocks - 1)").count() == 0
    longest = sorted((np.linalg.norm(v) for _, v in rows), reverse=True)[100]
    asked = df.filter("vec_id % 100 = 0").withColumn("need", F.lit(float(longest) / 4)).withColumn("group", topk._length_bin(F.col("need")))
    met = topk.reached(asked, blocks).agg(F.sum(F.col("query_blocks") * F.col("blocks"))).first()[0]
    every = 10 * blocks.agg(F.sum("blocks")).first()[0]
    assert 0 < met < every / 2


def test_floors_keep_what_ties():
    vectors = np.array([[1.0], [2.0], [2.0], [3.0]])
    q, v, s = topk.search_block(np.array([9]), np.array([[1.0]]), np.arange(4), vectors, 2, np.array([2]))
    assert v.tolist() == [3, 1] and s.tolist() == [3, 2]


def test_repeated_rows_are_candidates(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0]), (0, [3.0]), (0, [1.0])]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])], 3) == [(0, 1, 1, 2048 * 1024), (0, 2, 1, 2048 * 1024), (0, 3, 2, 1024 * 1024)]
