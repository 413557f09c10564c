"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from bidframe.llm import prefixtrie


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def plain(rows):
    members = defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c, n in members[p] if n == len(p))))
        out.append((min(members[p])[0], len(p), min(members[p[:-1]])[0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got_rows(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def made(seed, n=60):
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(400), n):
        for turn in range(draw.choice([1, 2, 3, 8, 12, 20])):
            rows.append((c, draw.choice([turn, turn, turn, None]), draw.choice(["user", "assistant", None]), draw.choice(["", None, "a", "b", "é", "x" * 50])))
    return rows + rows[:7] + [(None, 0, "user", "no conversation")]


@pytest.mark.parametrize("piece,block", [(64, 1 << 15), (2, 5), (3, 1 << 15), (1, 3)])
def test_against_plain(spark, monkeypatch, piece, block):
    """Short pieces and small blocks give the same nodes: prefixes go on over layers, blocks and ranges."""
    rows = made(piece)
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(40) for t in range(6)]
    docs = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 int, part string, n int").repartition(6)
    turns, convs = prefixtrie.graft_heads(docs, *heads())
    real = prefixtrie._blocks

    def small(batches):
        for table in real(batches):
            for low in range(0, len(table), block):
                yield table.slice(low, block).combine_chunks()

    monkeypatch.setattr(prefixtrie, "_blocks", small)
    assert got_rows(prefixtrie.prefix_trie(turns, convs, piece)) == plain(rows)


def heads():
    from pyspark.sql import functions as F

    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, F.col("conv_id") - F.col("conv_id") % 5


def test_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert got_rows(prefixtrie.conversation_trie(rows)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_turnless_and_empty(spark):
    none = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(none, 0, "user", "one turn")]
    docs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = got_rows(prefixtrie.conversation_trie(docs))
    assert got == plain(rows) == [(none, 0, None, 1, 0, 1, 0, hashlib.sha256(str(none).encode()).hexdigest())]
    assert prefixtrie.conversation_trie(docs.limit(0)).count() == 0
    assert prefixtrie.conversation_trie(docs.selectExpr("cast(null AS long) AS conv_id", "turn", "role", "text")).count() == 0


def test_long_conversation(spark):
    """One conversation with most of all rows is many tasks and pieces."""
    rows = [(5, t, "user", f"t{t}") for t in range(3000)] + [(7, t, "user", f"t{t}" if t < 2500 else "other") for t in range(2600)] + [(11, t, "a", "b") for t in range(4)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got_rows(prefixtrie.conversation_trie(docs)) == plain(rows)


def test_intervals_by_sparse_table():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 200):
        values = rng.integers(-1, 6, n)
        values[0] = -1
        table = prefixtrie.SparseTable(values)
        first = rng.integers(0, n, 50)
        last = np.minimum(first + rng.integers(0, n, 50), n - 1)
        assert table.least(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]
        row, depth = rng.integers(0, n, 50), rng.integers(0, 6, 50)
        left, right = prefixtrie.member_intervals(table, row, depth)
        for k, d, a, b in zip(row, depth, left, right):
            assert (values[a + 1 : k + 1] >= d).all() and (values[k + 1 : b + 1] >= d).all()
            assert (a == 0 or values[a] < d) and (b == n - 1 or values[b + 1] < d)
