"""The trie of conversations that share their first turns, from sorted turn sequences and their common prefixes.

A conversation is a sequence of turns, each written as 16 bytes of its SHA-256, cut into pieces of ``PIECE`` turns. A
piece is filed under its layer and a hash of all turns before it, so pieces of one layer and hash go on from the same
node, and a conversation of any length is rows of bounded size. Sorted, equal prefixes stand together: the members of
a prefix are an interval, found by binary search over range minima of the lengths of neighbours' common prefixes.
Tasks sort and search blocks of their own; what blocks found of one node is added by the node's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.llm.common import materialise
from bidframe.llm.words import mix

#: Turns in a piece of a conversation.
PIECE = 64
TURN_BYTES = 16
#: Pieces, and turns of these, that are searched together.
BLOCK_PIECES = 1 << 15
BLOCK_TURNS = 1 << 18
NODE = ["depth", "k1", "k2"]


def number_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, seq, turn_hash, bytes) and (conv_id, part, first, before, n) of all rows with a conv_id.

    Rows are sorted by conv_id, turn (null first), role and text in ranges, so a long conversation is many tasks;
    a range counts its rows in ``seq``, and a turn's place in its conversation is before + seq - first. ``n`` is the
    number of turns of the conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    body = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    turn = F.col("turn").asc_nulls_first()
    # ranges are told apart by the first letters, so bounds are short; within a range, the whole texts are sorted
    dealt = body.repartitionByRange("conv_id", turn, F.substring("role", 1, 8), F.substring("text", 1, 16)).sortWithinPartitions("conv_id", turn, "role", "text")
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = materialise(
        dealt.select("conv_id", F.monotonically_increasing_id().alias("seq"), F.substring(content, 1, 2 * TURN_BYTES).alias("turn_hash"), F.octet_length("text").cast("long").alias("bytes"))
        .withColumn("part", F.shiftright("seq", 33)), "turns",
    )
    runs = turns.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("held"))
    whole = W.partitionBy("conv_id")
    upto = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return turns, runs.select("conv_id", "part", "first", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"), F.sum("held").over(whole).alias("n"))


def graft_heads(rows: DataFrame, head: Column, donor: Column) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, turn_hash, bytes), depth from 1, and conversations (conv_id, length), of conversations whose first turns are another's.

    ``head`` and ``donor`` are columns of conv_id: how many of the donor's first turns (all if it has fewer, none if
    there is no such conversation) replace as many of the conversation's own.
    """
    turns, runs = number_turns(rows)
    runs = materialise(runs, "runs")
    convs = runs.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", "n", head.alias("head"), donor.alias("donor"))
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    convs = materialise(convs.join(donors, "donor", "left").select("conv_id", "n", "head", "donor", F.least("head", F.coalesce("donor_n", F.lit(0))).alias("given")), "conversations")
    placed = turns.join(runs.select("conv_id", "part", "first", "before"), ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("seq") - F.col("first")).alias("place"), "turn_hash", "bytes")
    own = placed.join(convs.select("conv_id", "head", "given"), "conv_id").filter("place >= head").select("conv_id", (F.col("given") + F.col("place") - F.col("head") + 1).alias("depth"), "turn_hash", "bytes")
    most = convs.groupBy("donor").agg(F.max("given").alias("lent"))
    lent = placed.withColumnRenamed("conv_id", "donor").join(most, "donor").filter("place < lent")
    heads = convs.select("conv_id", "donor", "given").join(lent, "donor").filter("place < given").select("conv_id", (F.col("place") + 1).alias("depth"), "turn_hash", "bytes")
    length = F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0))
    return own.unionByName(heads), convs.select("conv_id", length.alias("length"))


def cut_pieces(turns: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The conversations in pieces: conv_id, layer, c1 and c2 (hash of all turns before), o1 and o2 (with the piece), turns, sizes, before (bytes of earlier turns), total (of all), last."""
    layer = F.floor((F.col("depth") - 1) / piece).cast("int").alias("layer")
    listed = F.sort_array(F.collect_list(F.struct("depth", "turn_hash", "bytes")))
    cut = turns.withColumn("layer", layer).groupBy("conv_id", "layer").agg(
        listed.alias("listed"), F.bit_xor(F.xxhash64("turn_hash", "depth")).alias("x1"), F.bit_xor(F.xxhash64("depth", "turn_hash")).alias("x2"), F.sum("bytes").alias("held")
    )
    cut = cut.select("conv_id", "layer", "x1", "x2", "held", F.unhex(F.array_join("listed.turn_hash", "")).alias("turns"), F.col("listed.bytes").alias("sizes"))
    none = convs.filter("length = 0").select("conv_id", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), F.lit(0).cast("long").alias("held"), F.unhex(F.lit("")).alias("turns"), F.array().cast("array<long>").alias("sizes"))
    cut = materialise(cut.unionByName(none), "pieces")
    whole = W.partitionBy("conv_id")
    upto = whole.orderBy("layer").rowsBetween(W.unboundedPreceding, W.currentRow)
    # a long conversation's pieces meet here as rows of numbers, not with their turns
    chained = cut.select("conv_id", "layer", "x1", "x2", "held").select(
        "conv_id", "layer", F.bit_xor("x1").over(upto).alias("o1"), F.bit_xor("x2").over(upto).alias("o2"), (F.sum("held").over(upto) - F.col("held")).alias("before"),
        F.sum("held").over(whole).alias("total"), (F.max("layer").over(whole) == F.col("layer")).alias("last"),
    )
    joined = cut.join(chained, ["conv_id", "layer"])
    return joined.select("conv_id", "layer", F.col("o1").bitwiseXOR(F.col("x1")).alias("c1"), F.col("o2").bitwiseXOR(F.col("x2")).alias("c2"), "o1", "o2", "turns", "sizes", "before", "total", "last")


class SparseTable:
    """Range minima in constant time: row k has the minimum of each 2**k neighbouring values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (1 << len(self.rows) - 1) <= len(values):
            half, last = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], both ends included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << k) + 1])
        return out


def member_intervals(shared: SparseTable, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the sorted rows that begin with the first ``depth`` turns of ``row``. ``shared`` is over the lengths that each row has in common with the one before. Each candidate searches to the left and to the right on its own, in steps that halve."""
    n = len(shared.rows[0])
    left, right = row.copy(), row.copy()
    for k in range(len(shared.rows) - 1, -1, -1):
        step, least = 1 << k, shared.rows[k]
        at = np.flatnonzero(right + step < n)
        right[at] += step * (least[right[at] + 1] >= depth[at])
        at = np.flatnonzero(left >= step)
        left[at] -= step * (least[left[at] - step + 1] >= depth[at])
    return left, right


def common_lengths(same: np.ndarray, turns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many first turns each sorted row has in common with the one before; -1 where ``same`` says they don't go on from one node. ``turns`` has a row for each turn, two numbers wide."""
    lengths = np.diff(starts)
    out = np.full(len(lengths), -1, dtype=np.int64)
    rows = np.flatnonzero(same)
    both = np.minimum(lengths[rows], lengths[rows - 1])
    out[rows] = both
    total = np.cumsum(both)
    at = np.arange(total[-1] if len(total) else 0) - np.repeat(total - both, both)
    differ = (turns[np.repeat(starts[rows], both) + at] != turns[np.repeat(starts[rows - 1], both) + at]).any(axis=1)
    np.minimum.at(out, np.repeat(rows, both)[differ], at[differ])
    return out


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, ``counts`` times: its number, and 0, 1, 2 ..."""
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - (ends - counts)[row]


def search_block(block: pa.Table, piece: int, weighted: bool) -> pa.RecordBatch:
    """What a block of sorted pieces knows of every node that any of them goes through.

    Per node: depth, k1 and k2 (its hash), and, over its members here, n and rep (the smallest conv_id). Not
    ``weighted``: also its parent's hash and the bytes of the turns before its last. ``weighted``: the sums of
    the members' ``value`` and ``leaf``, rep's value, and the conv_ids that end here, as text, with the first of them.
    """
    conv, layer = block["conv_id"].to_numpy(), block["layer"].to_numpy().astype(np.int64)
    c1, c2, o1, o2 = (block[c].to_numpy().view(np.uint64) for c in ("c1", "c2", "o1", "o2"))
    starts = np.concatenate(([0], np.cumsum([len(t) for t in block["turns"].to_pylist()]) // TURN_BYTES)).astype(np.int64)
    flat = np.frombuffer(b"".join(block["turns"].to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    lengths = np.diff(starts)
    n = len(conv)
    same = np.concatenate(([False], (layer[1:] == layer[:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])))
    shared = common_lengths(same, flat, starts)

    # candidates: the prefixes that a row doesn't share with the one before; the node a later layer goes on from is the earlier layer's
    least = np.where((shared < 0) & (layer > 0), 1, shared + 1)
    row, more = _ranges(np.maximum(lengths - least + 1, 0))
    depth = least[row] + more
    left, right = member_intervals(SparseTable(shared), row, depth)
    rep = SparseTable(conv).least(left, right)

    _, place = _ranges(lengths)
    sums = []
    for salt, (one, other) in enumerate(((0, 1), (1, 0))):
        term = mix(mix(flat[:, one], 61 + salt) + flat[:, other] * np.uint64(0x9E3779B97F4A7C15) + mix(place.astype(np.uint64), 63 + salt), 65 + salt)
        sums.append(np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(term))))

    def keys(at: np.ndarray, upto: np.ndarray) -> list[np.ndarray]:
        """The hashes of the nodes ``upto`` turns into the pieces of rows ``at``."""
        out = []
        for inside, before, after in ((sums[0], c1, o1), (sums[1], c2, o2)):
            own = mix(before[at] + np.uint64(1) ^ inside[starts[at] + upto] ^ inside[starts[at]], 67)
            out.append(np.where(upto == 0, before[at], np.where(upto == piece, after[at], own)).view(np.int64))
        return out

    k1, k2 = keys(row, depth)
    out = {"depth": layer[row] * piece + depth, "k1": k1, "k2": k2, "n": right - left + 1, "rep": rep}
    if not weighted:
        root = depth == 0
        p1, p2 = keys(row, np.maximum(depth - 1, 0))
        sizes = np.concatenate(([0], np.cumsum(block["sizes"].combine_chunks().flatten().to_numpy())))
        before = block["before"].to_numpy()[row] + sizes[starts[row] + np.maximum(depth - 1, 0)] - sizes[starts[row]]
        out |= {"p1": pa.array(p1, mask=root), "p2": pa.array(p2, mask=root), "before": before}
    else:
        order = np.argsort(conv, kind="stable")
        value, leaf = block["value"].to_numpy(), block["leaf"].to_numpy()
        for name, v in (("value", value), ("leaves", leaf)):
            upto = np.concatenate(([0], np.cumsum(v)))
            out[name] = upto[right + 1] - upto[left]
        out["rep_value"] = value[order][np.searchsorted(conv[order], rep)]
        ids: list[str | None] = [None] * len(row)
        first: list[int | None] = [None] * len(row)
        last = block["last"].to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(depth == lengths[row])  # one for each run of equal rows, at the run's first
        for k, a, b in zip(whole.tolist(), row[whole].tolist(), [*row[whole][1:].tolist(), n]):
            ended = conv[a:b][last[a:b] & (lengths[a:b] == lengths[a])]
            if len(ended):
                ids[k], first[k] = ",".join(map(str, ended.tolist())), int(ended[0])
        out |= {"ended": pa.array(ids, pa.string()), "first_ended": pa.array(first, pa.int64())}
    return pa.RecordBatch.from_pydict(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = turns = 0
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            held.append(part)
            rows, turns = rows + part.num_rows, turns + sum(len(t) for t in part.column("turns").to_pylist()) // TURN_BYTES
            if rows >= BLOCK_PIECES or turns >= BLOCK_TURNS:
                yield pa.Table.from_batches(held)
                held, rows, turns = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def found_nodes(pieces: DataFrame, piece: int, weighted: bool) -> DataFrame:
    """What the blocks of the sorted pieces found, a row for each block and node."""
    # ranges are told apart by a few turns and then the conversation, so copies of one sequence are many tasks
    dealt = pieces.repartitionByRange("layer", "c1", "c2", F.substring("turns", 1, 4 * TURN_BYTES), "conv_id").sortWithinPartitions("layer", "c1", "c2", "turns", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield search_block(block, piece, weighted)

    rest = "value long, leaves long, rep_value long, ended string, first_ended long" if weighted else "p1 long, p2 long, before long"
    return dealt.mapInArrow(run, f"depth long, k1 long, k2 long, n long, rep long, {rest}")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's ids, joined by commas, from rows (depth, k1, k2, ended) in order; no more than a row is held."""
    key, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        for *node, ended in zip(*[c.to_pylist() for c in batch.columns]):
            if node != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(ended.encode())
            else:
                digest.update(b"," + ended.encode())
        yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), map(list, zip(*out)))) if out else {c: [] for c in (*NODE, "ends_sha256")}, schema=_ENDS)
    if key is not None:
        yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip((*NODE, "ends_sha256"), (*key, digest.hexdigest()))}, schema=_ENDS)


_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(turns: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, turn_hash, bytes) and ``convs`` (conv_id, length).

    A node is a distinct sequence of first turns, from the empty one on; its members are the conversations that begin
    with it. Returns per node conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves
    (childless nodes in its subtree), saved_tokens (over its subtree, each node's members but one times the bytes
    of its last turn) and ends_sha256 (of the members that end there). No conversation gives no node.

    Members' intervals are searched twice. The first search gives members, representatives and parents. From these,
    every conversation gets two numbers: the bytes before it first represents a node, or all its bytes if it never
    does, and whether a childless node is its own. A subtree's sums are sums of these over the members' intervals:
    the nodes that a member repeats are those down to where it begins to represent.
    """
    pieces = materialise(cut_pieces(turns, convs, piece), "chained-pieces")
    nodes = materialise(found_nodes(pieces, piece, False).groupBy(*NODE).agg(F.sum("n").alias("n_convs"), F.min("rep").alias("rep"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("before").alias("before")), "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_conv_id"))
    nodes = nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(parents, ["depth", "p1", "p2"], "left")
    nodes = materialise(nodes.drop("p1", "p2"), "linked-nodes")
    own = nodes.groupBy(F.col("rep").alias("conv_id")).agg(F.min_by("before", "depth").alias("value"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    valued = pieces.join(own, "conv_id", "left").withColumns({"value": F.coalesce("value", "total"), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    found = materialise(found_nodes(valued, piece, True), "weighted-nodes")
    sums = found.groupBy(*NODE).agg(F.sum("value").alias("value"), F.sum("leaves").alias("n_leaves"), F.min_by("rep_value", "rep").alias("rep_value"))
    ended = found.filter("ended IS NOT NULL").select(*NODE, "ended", "first_ended").repartition(*NODE).sortWithinPartitions(*NODE, "first_ended")
    ends = ended.drop("first_ended").mapInArrow(_hash_ends, "depth long, k1 long, k2 long, ends_sha256 string")
    saved = F.col("value") - F.col("rep_value") - (F.col("n_convs") - 1) * F.col("before")
    return nodes.join(sums, NODE).join(ends, NODE, "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, every: int = 5, heads: int = 9, piece: int = PIECE) -> DataFrame:
    """The trie of rebuilt conversations ``rows(conv_id, turn, role, text)``.

    Conversation c takes the first h = crc32(c) % ``heads`` turns of conversation c - c % ``every`` and goes on with
    its own after its first h. Turns are ordered by turn, null first; equal turns by role and text. A null role or
    text is empty; rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their
    own. An empty table gives no rows. Other columns aren't looked at.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    turns, convs = graft_heads(rows, head, F.col("conv_id") - F.col("conv_id") % every)
    return prefix_trie(turns, convs, piece)
