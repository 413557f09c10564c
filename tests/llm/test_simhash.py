"""Fingerprint groups against all pairs, and crowds of like fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from bidframe.llm import simhash


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode("utf-8"), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=2):
    """{row number: component} of (doc_id, fingerprint), all pairs compared."""
    of = {d: d for d in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
                x, y = of[a], of[b]
                if x != y:
                    of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
    least = {}
    for k, v in of.items():
        if rows[k][0] is not None:
            least[v] = min(least.get(v, rows[k][0]), rows[k][0])
    return [None if rows[k][0] is None else least[v] for k, v in of.items()]


def test_odd_texts(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "One"), (6, "one"), (7, "ONE two"), (7, "one  TWO"), (8, "É a b c"), (10, "é a b c"), (None, "one"), (11, "a b c a b c a b c"), (2, "x\x0by\x0cz"), (1, "nb sp and sep here"), (12, "a b c " * 70_000), (7, "another text here")]
    docs = spark.createDataFrame([(a, b, 1, "f", 2, 3) for a, b in rows], "doc_id long, text string, fp int, fingerprint string, component int, copies int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_duplicates(docs).collect()), key=str)
    prints = [plain_print(t) for _, t in rows]
    want = plain_groups([(d, p) for (d, _), p in zip(rows, prints)])
    assert got == sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want)), key=str)
    assert simhash.simhash_duplicates(docs.limit(0)).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_duplicates(docs.repartition(7)).collect()}
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(rows, plain_groups(rows))}
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 4])
def test_links_of_a_crowd(spark, monkeypatch, crowd):
    """Chains, balls and loners: every pair within two bits is found once buckets are too large, and no other."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(1)
    centre = draw.getrandbits(64)
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a, 64, 5)} | {draw.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 1, 3, 7}
    prints |= {p ^ (1 << draw.randrange(64)) for p in list(prints)[:200]}
    listed = sorted(prints)
    signed = np.array(listed, dtype=np.uint64).view(np.int64).tolist()
    got = [tuple(sorted((r.a, r.b))) for r in simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    want = {tuple(sorted((signed[a], signed[b]))) for a in range(len(listed)) for b in range(a) if (listed[a] ^ listed[b]).bit_count() <= 2}
    assert set(got) == want and len(want) > 1000
    if crowd > 100:
        assert len(got) < 2 * len(want)


def test_coordinates():
    """Within r bits, no distance to a reference differs by more than r, and at most r block coordinates do."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    assert np.abs(simhash.distances(a, simhash.SPREAD) - simhash.distances(b, simhash.SPREAD)).max() <= 2
    assert ((simhash.block_coordinates(a, 2) != simhash.block_coordinates(b, 2)).sum(axis=1) <= 2).all()
    for width, groups in ((2, 4), (2, 6), (2, 16), (1, 64)):
        one, other = (simhash.bucket_keys(x, width, groups, 2)[0] for x in (a, b))
        assert (one == other).any(axis=1).all()
