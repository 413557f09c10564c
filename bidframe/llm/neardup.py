"""Near-duplicate groups by min-max hashing of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.llm.common import materialise, trimmed
from bidframe.llm.words import mix, shingle_sets, split_words, text_blocks

#: Each permutation gives two signature values, its minimum and its maximum.
PERMUTATIONS = 64
#: Signature values that must all agree in a band.
BAND_ROWS = 4
#: Classes outside a bucket's largest component from which they are compared in blocks instead of pair by pair.
MOST_OUTSIDE = 4
#: Classes that hold more than one row in so many are joined by broadcast; there are fewer of them than this.
COMMON = 1000
#: Classes, and shingles of these, in a block, about.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 400_000


def min_max_signatures(values: np.ndarray, starts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Row i: the minima, then the maxima, of set i under each permutation. Sets must not be empty."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    out = np.empty((len(starts) - 1, 2 * permutations), dtype=np.uint64)
    for k in range(permutations):
        moved = values * factors[k] + shifts[k]
        out[:, k] = np.minimum.reduceat(moved, starts[:-1])
        out[:, permutations + k] = np.maximum.reduceat(moved, starts[:-1])
    return out


def band_hashes(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash per band of ``rows`` neighbouring signature values; the band's number is part of it."""
    n, width = signatures.shape
    parts = mix(signatures).reshape(n, width // rows, rows)
    total = np.arange(width // rows, dtype=np.uint64)[None, :] + np.zeros((n, 1), dtype=np.uint64)
    for k in range(rows):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k], 5)
    return total


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(_signed(values)))


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column(1)):
            values, starts = shingle_sets(split_words(data, offsets))
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            width = 2 * PERMUTATIONS // BAND_ROWS
            prints = np.zeros((2, len(sizes)), dtype=np.uint64)
            bands, band_starts = np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
            if len(full):
                edges = np.concatenate((starts[full], starts[-1:]))
                bands = band_hashes(min_max_signatures(values, edges)).ravel()
                band_starts[1:] = np.cumsum((sizes > 0) * width)
                prints[:, full] = _prints(values, edges)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(sizes.astype(np.int64)), pa.array(_signed(prints[0])), pa.array(_signed(prints[1])), _lists(bands, band_starts)],
                names=["doc_id", "n_shingles", "print1", "print2", "bands"],
            )


def _prints(values: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The two fingerprints of non-empty sets, which don't depend on an order."""
    return [np.add.reduceat(mix(values, 11 + k), edges[:-1]) for k in (0, 1)]


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, shingles) of the rows (doc_id, text, print1, print2) whose text has these fingerprints."""
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column(1)):
            values, starts = shingle_sets(split_words(data, offsets))
            full = np.flatnonzero(np.diff(starts))
            want = [batch.column(2 + k).slice(first, last - first).to_numpy().view(np.uint64) for k in (0, 1)]
            got = _prints(values, np.concatenate((starts[full], starts[-1:]))) if len(full) else want
            same = full[(got[0] == want[0][full]) & (got[1] == want[1][full])] if len(full) else full
            lists = _lists(values, starts).take(pa.array(same))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(same)), lists], names=["doc", "shingles"])


def common_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of ``one`` with each of ``other``: a product of 0/1 matrices over the values that occur on both sides, some thousand values at a time."""
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, other))
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, other))
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    total = np.zeros((len(one), len(other)), dtype=np.float32)
    if not len(shared):
        return total
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    hit_a, hit_b = (shared[np.minimum(at, len(shared) - 1)] == x for at, x in ((at_a, a), (at_b, b)))
    at_a, row_a, at_b, row_b = at_a[hit_a], row_a[hit_a], at_b[hit_b], row_b[hit_b]
    for low in range(0, len(shared), 4096):
        left, right = (np.zeros((n, 4096), dtype=np.float32) for n in (len(one), len(other)))
        for grid, at, row in ((left, at_a, row_a), (right, at_b, row_b)):
            part = (at >= low) & (at < low + 4096)
            grid[row[part], at[part] - low] = 1
        total += left @ right.T
    return total


def _compare_blocks(least: int, of: int):
    """Links (a, b) between two blocks of (rep, component, shingles) whose components differ."""

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(one) and len(other):
            sets = [[np.array(x, dtype=np.int64) for x in t.column("shingles").to_pylist()] for t in (one, other)]
            sizes = [np.array([len(x) for x in s], dtype=np.int64) for s in sets]
            both = common_counts(*sets).astype(np.int64)
            (rep_a, part_a), (rep_b, part_b) = ([t.column(c).to_numpy() for c in ("rep", "component")] for t in (one, other))
            union = sizes[0][:, None] + sizes[1][None, :] - both
            k, m = np.nonzero((both * of >= union * least) & (part_a[:, None] != part_b[None, :]))
            out_a, out_b = [np.minimum(rep_a[k], rep_b[m])], [np.maximum(rep_a[k], rep_b[m])]
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; a component is named by its smallest node.

    Every node points to the smallest of itself and its neighbours; pointers are followed to their ends by doubling,
    and edges between different ends are contracted and taken again. A round at least halves the ends that still have
    edges. Each round is a written table; the driver sees only whether rows are left.
    """
    edges = materialise(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
    found = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "pointers")
        while True:
            ends = point.select(F.col("node").alias("to"), F.col("to").alias("end"))
            moved = materialise(point.join(ends, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "pointers")
            point = moved.select("node", "to")
            if moved.filter("moved").isEmpty():
                break
        if found is None:
            found = point.withColumnRenamed("to", "component")
        else:
            step = point.select(F.col("node").alias("component"), "to")
            found = materialise(found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        at_a, at_b = (point.select(F.col("node").alias(x), F.col("to").alias("end_" + x)) for x in "ab")
        edges = materialise(
            edges.join(at_a, "a").join(at_b, "b").filter("end_a <> end_b").select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).distinct(), "edges"
        )
        if edges.isEmpty():
            return found


def merge_links(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after ``links(a, b)`` were added; only the ends' components are joined again."""
    if parts is None:
        return connected_components(links)
    end_a, end_b = (parts.select(F.col("node").alias(x), F.col("component").alias("part_" + x)) for x in "ab")
    new = materialise(links.join(end_a, "a", "left").join(end_b, "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")), "new-links")
    final = connected_components(new).select(F.col("node").alias("component"), F.col("component").alias("final"))
    # a component without an entry of its own is a node that had no link so far
    alone = new.select(F.col("a").alias("node")).union(new.select("b")).distinct().select("node", F.col("node").alias("component"))
    known = parts.unionByName(alone.join(parts.select("node"), "node", "left_anti"))
    return materialise(known.join(final, "component", "left").select("node", F.coalesce("final", "component").alias("component")), "groups")


def _open_buckets(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with their component, the bucket's largest one, and how many rows are outside of that."""
    placed = members.drop("component", "main", "outside").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    per = placed.groupBy("bucket", "component").agg(F.count("*").alias("held"))
    size = F.struct("held", "component")
    main = per.groupBy("bucket").agg(F.max(size).alias("top"), F.sum("held").alias("all")).filter("all > top.held").select("bucket", F.col("top.component").alias("main"), (F.col("all") - F.col("top.held")).alias("outside"))
    return placed.join(main, "bucket")


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (75, 100), text: str = "text") -> DataFrame:
    """Groups of documents whose sets of 5-word shingles have a Jaccard similarity of 75/100 or more.

    1. One pass gives each document the size and a fingerprint of its set, and the bands of its min-max signature: 64
       permutations give 128 values in 32 bands of 4. A pair at similarity 0.75 misses every band about once in
       200,000 times, and one link more in its group makes up for it.
    2. Documents with equal sets become one class, named by the smallest doc_id; only classes go on.
    3. In each band bucket the class that shares most buckets with others is compared with all, on full sets, and
       links make components. Then the one of these among the classes outside of a bucket's largest component is
       compared with the others outside. So a group of m near copies costs about m comparisons, not m * m.
    4. What is still outside is compared with all classes of other components in its bucket: pair by pair where that
       is a few classes; else, as in a crowd of texts that are alike but not alike enough, in blocks of bounded size,
       each pair of blocks in a task that counts common shingles as a matrix product and returns only links. So every
       pair that shares a bucket is either compared or already connected.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows that repeat a
    doc_id with another text are judged by their own text each; as links name documents, what one of these texts is
    linked with in its own name is linked with the other. A null doc_id gets a null component. An empty table gives an empty result. Other
    columns aren't looked at. Returns doc_id, n_shingles, component_id, kept.
    """
    least, of = similarity
    texts = docs.select("doc_id", F.col(text).alias("text"))
    signs = materialise(texts.mapInArrow(trimmed(_signature_batches), "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>"), "signatures")
    keys = ["n_shingles", "print1", "print2"]
    full = signs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = materialise(full.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("copies")), "classes")
    classes = heads.drop("bands")
    bands = materialise(heads.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "bands")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1")
    members = materialise(bands.join(shared, "bucket"), "members")
    weights = members.groupBy("rep").agg(F.sum("held").alias("weight"))
    members = materialise(members.join(weights, "rep").select("bucket", "rep", "n", "weight"), "weighted-members")
    sets = materialise(
        texts.join(classes.join(weights.select("rep"), "rep").select(F.col("rep").alias("doc_id"), "print1", "print2"), "doc_id").select("doc_id", "text", "print1", "print2").mapInArrow(trimmed(_set_batches), "doc long, shingles array<long>").distinct(), "sets"
    )

    def close(n, m):
        return F.least(n, m) * of >= F.greatest(n, m) * least

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the full sets confirm."""
        one = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("of_b"))
        other = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("of_a"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        union = F.size("of_a") + F.size("of_b") - both
        return pairs.join(one, "b").join(other, "a").filter(both * of >= union * least).select("a", "b")

    def stars(rows: DataFrame, hub, outer) -> DataFrame:
        """Pairs of each bucket's hub, an aggregate (rep, n), and the rows for which ``outer`` holds."""
        hubs = rows.groupBy("bucket").agg(hub.alias("hub"))
        return rows.filter(outer).join(hubs, "bucket").filter((F.col("rep") != F.col("hub.rep")) & close(F.col("n"), F.col("hub.n"))).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()

    node = F.struct("rep", "n")
    heaviest = F.struct("weight", "rep")
    parts = merge_links(None, materialise(linked(stars(members, F.max_by(node, heaviest), F.lit(True))), "links"))
    members = materialise(_open_buckets(members, parts), "open-members")
    apart = F.col("component") != F.col("main")
    again = materialise(linked(stars(members, F.max_by(node, F.when(apart, heaviest)), apart)), "links")
    if not again.isEmpty():
        parts = merge_links(parts, again)
        members = materialise(_open_buckets(members, parts), "open-members")

    few = members.filter(F.col("outside") <= MOST_OUTSIDE)
    outside = few.filter(apart).select("bucket", F.col("rep").alias("x"), F.col("n").alias("x_n"), F.col("component").alias("x_part"))
    inside = few.select("bucket", F.col("rep").alias("y"), F.col("n").alias("y_n"), F.col("component").alias("y_part"), (~apart).alias("y_main"))
    pair = (F.col("x_part") != F.col("y_part")) & (F.col("y_main") | (F.col("x") < F.col("y"))) & close(F.col("x_n"), F.col("y_n"))
    crossing = outside.join(inside, "bucket").filter(pair).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # buckets with many classes outside, taken together if they have the same largest component
    many = materialise(members.filter(F.col("outside") > MOST_OUTSIDE).select("main", "rep", "n", "component").distinct(), "crowds")
    blocks = lambda rows, volume: F.greatest(F.ceil(rows / BLOCK_CLASSES), F.ceil(volume / BLOCK_SHINGLES)).cast("int")
    sizes = many.groupBy("main").agg(
        blocks(F.count("*"), F.sum("n")).alias("n_all"), blocks(F.count_if(apart), F.sum(F.when(apart, F.col("n")).otherwise(0))).alias("n_out")
    )
    rows = many.join(sizes, "main").join(sets.withColumnRenamed("doc", "rep"), "rep")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    grid = ["main", "out_block", "all_block"]
    left = rows.filter(apart).select("main", place(F.col("n_out")).alias("out_block"), every(F.col("n_all")).alias("all_block"), "rep", "component", "shingles")
    right = rows.select("main", every(F.col("n_out")).alias("out_block"), place(F.col("n_all")).alias("all_block"), "rep", "component", "shingles")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, for the cogroup
    crowded = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(_compare_blocks(least, of), "a long, b long")
    more = materialise(linked(crossing).unionByName(crowded).distinct(), "links")
    groups = parts if more.isEmpty() else merge_links(parts, more)

    by_class = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, "copies", F.coalesce("component", "rep").alias("component_id"))
    rows = signs.select("doc_id", *keys)
    # fewer than COMMON classes hold more than one row in COMMON each, so these are broadcast; their rows aren't shuffled
    common = F.col("copies") * COMMON > full.count()
    top = rows.join(F.broadcast(by_class.filter(common).drop("copies")), keys, "left")
    rest = top.filter("component_id IS NULL").drop("component_id").join(by_class.filter(~common).drop("copies"), keys, "left")
    component = F.coalesce("component_id", "doc_id")
    return top.filter("component_id IS NOT NULL").unionByName(rest).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
