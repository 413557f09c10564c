"""Near-duplicate groups by SimHash fingerprints and a table of their distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidframe.llm.common import materialise
from bidframe.llm.neardup import COMMON, connected_components
from bidframe.llm.words import mix

BITS = 64
#: Shingles whose bits are counted at once.
CHUNK_SHINGLES = 100_000
#: Fingerprints in a bucket up to which they are compared pair by pair; larger buckets are cut finer.
CROWD = 128
#: Rows of buckets that a task holds at once.
CHUNK_ROWS = 1 << 16
#: References without a structure, whose distances only discard pairs.
SPREAD = mix(np.arange(16, dtype=np.uint64), 23)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included: bit k is 1 if it is set in over half of their XXH64."""
    words = text.encode().lower().split()  # of bytes: only A-Z are lowered, and only space and \t \n \v \f \r part words
    if not words:
        return 0
    digest = partial(xxhash.xxh64_digest, seed=seed)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) >= width else iter([b" ".join(words)])
    total, n = np.zeros(BITS, dtype=np.int64), 0
    while part := b"".join(map(digest, islice(shingles, CHUNK_SHINGLES))):
        bits = np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def references(width: int) -> np.ndarray:
    """Zero, and for each block of ``width`` bits the fingerprint with ones there only."""
    return np.array([0] + [((1 << width) - 1) << k for k in range(0, BITS, width)], dtype=np.uint64)


def distances(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot table: row i has the Hamming distances of fingerprint i to all references."""
    return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)


def block_coordinates(prints: np.ndarray, width: int) -> np.ndarray:
    """Distances to the references of the blocks, less that to zero. One differing bit changes one of these only, so fingerprints within r bits agree in all but r of them."""
    table = distances(prints, references(width))
    return table[:, 1:] - table[:, :1]


def bucket_keys(prints: np.ndarray, width: int, groups: int, radius: int) -> tuple[np.ndarray, list[tuple[int, ...]], np.ndarray]:
    """For each fingerprint a key for each choice of all but ``radius`` groups of block coordinates; the choices; and a hash of each group. Fingerprints within ``radius`` bits share a key."""
    coordinates = block_coordinates(prints, width)
    parts = np.empty((len(prints), groups), dtype=np.uint64)
    for g, columns in enumerate(np.array_split(np.arange(coordinates.shape[1]), groups)):
        part = np.full(len(prints), g, dtype=np.uint64)
        for c in columns:
            part = mix(part * np.uint64(131) + coordinates[:, c].astype(np.int64).view(np.uint64), 9)
        parts[:, g] = part
    choices = list(combinations(range(groups), groups - radius))
    keys = np.stack([mix(parts[:, list(c)].sum(axis=1, dtype=np.uint64), 41 + k) for k, c in enumerate(choices)], axis=1)
    return keys, choices, parts


def _keyed(width: int, groups: int, radius: int):
    """Rows (key, choice, fp) of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(prints), 512):
                part = prints[low : low + 512]
                keys, choices, _ = bucket_keys(part, width, groups, radius)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "choice": np.tile(np.arange(len(choices), dtype=np.int32), len(part)), "fp": np.repeat(part, len(choices)).view(np.int64)})

    return run


def close_pairs(keys: np.ndarray, choice: np.ndarray, prints: np.ndarray, width: int, groups: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within ``radius`` bits of rows sorted by key. Rows of a key are taken 1, 2, 3 ... apart; what a coordinate of the pivot table tells apart goes, and the rest is verified. A pair is given in the first choice it shares only."""
    table = distances(prints, SPREAD)
    out_a, out_b = [], []
    at, apart = np.arange(len(keys)), 0
    while len(at):
        apart += 1
        at = at[at + apart < len(keys)]
        at = at[keys[at] == keys[at + apart]]
        # no coordinate of fingerprints within r bits differs by more than r
        kept = at[np.abs(table[at] - table[at + apart]).max(axis=1, initial=0) <= radius]
        gap = np.bitwise_count(prints[kept] ^ prints[kept + apart])
        kept = kept[(gap <= radius) & (gap > 0)]
        out_a.append(kept)
        out_b.append(kept + apart)
    a, b = np.concatenate([*out_a, at]), np.concatenate([*out_b, at])
    if len(a):
        _, choices, one = bucket_keys(prints[a], width, groups, radius)
        other = bucket_keys(prints[b], width, groups, radius)[2]
        same = np.stack([(one[:, list(c)] == other[:, list(c)]).all(axis=1) for c in choices], axis=1)
        first = same.argmax(axis=1) == choice[a]
        a, b = a[first], b[first]
    return prints[a], prints[b]


def _paired(width: int, groups: int, radius: int):
    """Links (a, b) of rows (key, choice, fp) that come sorted by key; buckets are small, and none is cut between two portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(upto: int | None = None) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
            rows = tuple(np.concatenate(c) for c in zip(*held))
            end = len(rows[0]) if upto is None else upto
            a, b = close_pairs(rows[0][:end], rows[1][:end], rows[2][:end].view(np.uint64), width, groups, radius)
            return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)}), tuple(c[end:] for c in rows)

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            if sum(len(h[0]) for h in held) >= CHUNK_ROWS:
                keys = np.concatenate([h[0] for h in held])
                last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if last:
                    found, rest = links(last)
                    held[:] = [rest]
                    yield found
        if held:
            yield links()[0]

    return run


def first_groups(n: int, radius: int) -> int:
    """Groups of two-bit blocks, the fewest for which n fingerprints fill about n buckets: a block of two random bits has 1.5 bits of information."""
    return next((g for g in range(radius + 2, 13) if 48 * (g - radius) / g >= np.log2(max(n, 2))), 12)


def link_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints ``prints(fp)`` that differ in at most ``radius`` bits.

    Every fingerprint has a table of distances to references: zero, the blocks of two bits, and 16 spread ones.
    Fingerprints within ``radius`` bits agree in all but ``radius`` of the block coordinates, so with these in g
    groups they agree in g - radius groups, and are met in the bucket of one such choice. Pairs of a bucket go if any
    coordinate differs by more than ``radius``; the bits of the rest are compared.

    A bucket of over CROWD fingerprints, as near copies make, isn't compared: its fingerprints go on to finer buckets,
    16 groups of two-bit blocks and then single bits, where a bucket has all bits but ``radius`` in common and so at
    most 2**radius fingerprints. So no bucket is quadratic and none is cut off.
    """
    left = prints
    found = None
    for width, groups in ((2, first_groups(prints.count(), radius)), (2, 16), (1, BITS)):
        keyed = left.mapInArrow(_keyed(width, groups, radius), "key long, choice int, fp long")
        held = keyed.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
        members = materialise(keyed.join(held, "key"), "buckets")
        small = members if width == 1 else members.filter(F.col("held") <= CROWD)
        pairs = small.select("key", "choice", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_paired(width, groups, radius), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        left = members.filter(F.col("held") > CROWD).select("fp").distinct()
        if width == 1 or left.isEmpty():
            return found
        left = materialise(left, "crowded")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_duplicates(docs: DataFrame, radius: int = 2, text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Fingerprint and group of every document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Rows with equal fingerprints are one class, named by its smallest doc_id; classes whose fingerprints differ in at
    most ``radius`` bits are linked (``link_fingerprints``), and component_id is the smallest doc_id that links lead to.

    A null text, an empty one or one without words has fingerprint zero and is linked like any other. Rows that repeat
    a doc_id are judged by their own text each; sharing an id links nothing. A row without doc_id has a fingerprint and
    no component, and links nothing. An empty table gives no rows. Columns other than doc_id and text aren't looked at.
    """
    prints = materialise(fingerprints(docs, text, width, seed), "fingerprints")
    named = prints.filter("doc_id IS NOT NULL")
    classes = materialise(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    groups = connected_components(materialise(link_fingerprints(classes.select("fp"), radius), "links"))
    placed = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = materialise(placed.join(names, "component").select("fp", "copies", "component_id"), "named-classes")
    # fewer than COMMON classes hold more than one row in COMMON each, so these are broadcast; their rows aren't shuffled
    common = F.col("copies") * COMMON > named.count()
    top = prints.join(F.broadcast(by_class.filter(common).drop("copies")), "fp", "left")
    rest = top.filter("component_id IS NULL").drop("component_id").join(by_class.filter(~common).drop("copies"), "fp", "left")
    both = top.filter("component_id IS NOT NULL").unionByName(rest)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return both.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
