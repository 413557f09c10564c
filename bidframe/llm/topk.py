"""Exact top-k search by norm-bucketed retrieval."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.llm.common import materialise

#: Vectors and queries that meet in one task, about. Vectors are dealt by length first, then by a hash.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 512
#: A bucket holds vectors whose lengths are within this ratio, and at most so many of them.
BUCKET_RATIO = 0.9
BUCKET_SIZE = 1024
#: From this local cosine threshold on, a bucket is searched by coordinates, below it by length.
COORDINATE_FROM = 0.6
#: Coordinates of a query whose ranges are intersected.
FOCUS = 4
#: Below this bound on a product, sums of doubles are exact integers; below the next, sums of 64-bit integers are.
EXACT, LONG = 2.0**53, 2.0**63
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Lengths are compared with this relative slack, for what rounding may add.
SLACK = 1e-9


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows; those beyond a 64-bit integer become its greatest or least value."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if bound < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    if bound < LONG:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in rows.tolist()] for rows in (queries, vectors)]
    return np.array([[min(max(sum(x * y for x, y in zip(q, v)), LEAST), MOST) for v in whole[1]] for q in whole[0]], dtype=np.int64).reshape(len(queries), len(vectors))


def _buckets(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of lengths in descending order."""
    out, a = [], 0
    while a < len(lengths):
        b = int(np.searchsorted(-lengths, -lengths[a] * BUCKET_RATIO, side="right"))
        b = max(a + 1, min(b, a + BUCKET_SIZE))
        out.append((a, b))
        a = b
    return out


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of ``vectors`` by inner product, ties to the smaller id, as (query number, id, product). A vector isn't found by the query of its id; where ids repeat, ``own`` numbers the vectors, and queries are named by such numbers.

    Vectors are grouped by length in descending order. Per bucket and query the k-th best product so far, or the
    query's floor (k products at least as high are known) if that is higher, divided by both lengths, is the local
    cosine threshold. Above 1 nothing in the bucket can enter. A high threshold confines the vectors that can enter to
    narrow ranges of the query's largest coordinates; a low one only to those long enough. Products of what is left
    are computed exactly. Rows so large that doubles can't hold their products are compared with all.
    """
    own = ids if own is None else own
    best, best_ids = np.full((len(queries), k), LEAST), np.full((len(queries), k), MOST)
    floors = np.full(len(queries), LEAST) if floors is None else floors

    def enter(q: int, scores: np.ndarray, names: np.ndarray) -> None:
        scores, names = np.concatenate((best[q], scores)), np.concatenate((best_ids[q], names))
        keep = np.lexsort((names, ~scores))[:k]
        best[q], best_ids[q] = scores[keep], names[keep]

    def compare(some_queries: np.ndarray, some: np.ndarray, may: np.ndarray | None) -> None:
        got, names = _products(queries[some_queries], vectors[some]), ids[some]
        allowed = (own[some][None, :] != query_ids[some_queries, None]) & (got >= np.maximum(best[:, -1], floors)[some_queries, None])
        allowed = allowed if may is None else allowed & may
        for r in np.flatnonzero(allowed.any(axis=1)):
            take = np.flatnonzero(allowed[r])
            enter(some_queries[r], got[r, take], names[take])

    large = 2.0**24
    big_query, big = (np.abs(x).max(axis=1, initial=0) >= large for x in (queries, vectors))
    for some_queries, some in ((big_query, ~big), (np.ones(len(queries), dtype=bool), big)):
        if some_queries.any() and some.any():
            compare(np.flatnonzero(some_queries), np.flatnonzero(some), None)
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    order = np.flatnonzero(~big)
    order = order[np.lexsort((ids[order], -lengths[order]))]
    lengths = lengths[order]
    q_lengths = np.sqrt((queries * queries).sum(axis=1))
    for a, b in _buckets(lengths):
        bar = np.maximum(best[:, -1], floors)
        full, kth = bar != LEAST, bar.astype(float)
        reach = q_lengths * lengths[a]
        live = np.flatnonzero(~big_query & (~full | (reach * (1 + SLACK) >= kth)))
        if not len(live):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(full[live] & (reach[live] > 0), kth[live] / reach[live], -1.0)
        may = np.ones((len(live), b - a), dtype=bool)
        low, high = cosine < COORDINATE_FROM, cosine >= COORDINATE_FROM
        if low.any():
            need = np.where(cosine[low] > 0, kth[live[low]] / np.maximum(q_lengths[live[low]], 1e-300) * (1 - SLACK), 0)
            may[low] = lengths[None, a:b] >= need[:, None]
        if high.any():
            part = queries[live[high]] / q_lengths[live[high], None]
            unit = vectors[order[a:b]] / np.maximum(lengths[a:b, None], 1e-300)
            t = np.minimum(cosine[high], 1.0)
            rest = np.sqrt(np.maximum(0, 1 - t * t))
            focus = np.argsort(-np.abs(part), axis=1)[:, :FOCUS]
            ok = np.ones((len(part), b - a), dtype=bool)
            for j in range(focus.shape[1]):
                x = np.take_along_axis(part, focus[:, j : j + 1], axis=1)[:, 0]
                # of all unit vectors at cosine t or more, the least and greatest coordinate
                spread = np.sqrt(np.maximum(0, 1 - x * x)) * rest
                least = np.where(x <= -t, -1.0, x * t - spread) - SLACK
                most = np.where(x >= t, 1.0, x * t + spread) + SLACK
                values = unit[:, focus[:, j]].T
                ok &= (values >= least[:, None]) & (values <= most[:, None])
            may[high] = ok
        columns = np.flatnonzero(may.any(axis=0))
        if len(columns):
            compare(live, order[a + columns], may[:, columns])
    q, j = np.nonzero(best_ids != MOST)
    return q, best_ids[q, j], best[q, j]


def _length_bin(length: Column) -> Column:
    """The bucket of a length: lengths of one bucket differ by BUCKET_RATIO at most; -1 for 0, and one bucket for all that is beyond doubles."""
    return F.when(length > 0, F.least(F.log(length) / F.lit(-math.log(BUCKET_RATIO)), F.lit(1e6)) + 10_000).otherwise(-1).cast("int")


def _meet(k: int):
    """Search of one block of vectors for one block of queries, as Arrow tables."""

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("x").combine_chunks().flatten().to_numpy()
        return flat.reshape(len(t), len(flat) // len(t))

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        q, v, s = np.zeros((3, 0), np.int64)
        if len(queries) and len(block):
            query_rows = queries.column("query_row").to_numpy()
            q, v, s = search_block(query_rows, matrix(queries), block.column("vec_id").to_numpy(), matrix(block), k, queries.column("bar").to_numpy(), block.column("row").to_numpy())
            q = query_rows[q]
        return pa.table({"query_row": q.astype(np.int64), "vec_id": v.astype(np.int64), "score": s.astype(np.int64)})

    return run


_FOUND = "query_row long, vec_id long, score long"


def length_blocks(rows: DataFrame) -> DataFrame:
    """dim, bin, top (its greatest length), held and blocks of every bucket of ``rows(dim, bin, length)``; the first block of the seed, the longest bucket with enough vectors, gives queries their thresholds."""
    return rows.groupBy("dim", "bin").agg(F.max("length").alias("top"), F.count("*").alias("held"), F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))


def reached(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """The buckets that some query of each group of ``asked(dim, group, need)`` reaches: dim, group, query_blocks, bin, blocks. ``need`` is the length that a vector must have to enter; queries of like need are a group."""
    groups = asked.groupBy("dim", "group").agg(F.min("need").alias("need"), F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    return groups.join(blocks.select("dim", "bin", "top", "blocks"), "dim").filter(F.col("top") * (1 + SLACK) >= F.col("need")).select("dim", "group", "query_blocks", "bin", "blocks")


def _cogroup(queries: DataFrame, block: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Query blocks and vector blocks of equal keys, searched. Both sides may come from one table, so the vectors get columns of their own."""
    block = block.select(*[F.col(c).alias(c) for c in block.columns])
    return queries.groupBy(*keys).cogroup(block.groupBy(*keys)).applyInArrow(_meet(k), _FOUND)


def _block(n, key: str) -> Column:
    """Which of n blocks a row belongs to."""
    return F.pmod(F.pmod(F.xxhash64(key), F.lit(1 << 40)), n).cast("int")


def _each(n) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products with all other rows; ties to the smaller vec_id.

    Components become floor(scale * x). Vectors are bucketed by length, and buckets are cut into blocks of bounded
    size by a hash of the row's number.

    1. Every query meets one block of long vectors. The k-th best product is its threshold.
    2. The threshold over the query's length is the length that other vectors must have; queries of like need are
       grouped, and a group's blocks go on only to blocks of the buckets that reach it. Inside a task the buckets are
       searched by coordinates or by length, by the local cosine threshold.
    3. The blocks' best are ranked once more.

    Vectors that are null or hold null or non-finite components take no part; nor do rows without a vec_id. Vectors
    of different dimension never meet. Products beyond a 64-bit integer count as its greatest or least value, and tie.
    Every row is a candidate of all others, and every row that asks is a query, also where rows repeat a vec_id or all
    of a row; only the row itself is left out. Components beyond doubles when scaled count as non-finite. An empty table gives an empty result; other columns aren't looked at. Returns query_id, rank, vec_id, score.
    """
    held = F.col(vector)
    scaled = lambda v: v.cast("double") * scale
    whole = F.transform(held, lambda v: F.when(F.abs(scaled(v)) < EXACT, F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    fit = F.forall(held, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(scaled(v)) < F.lit(float("inf"))))
    rows = vectors.filter(held.isNotNull() & F.col("vec_id").isNotNull()).filter(F.coalesce(fit, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"), F.size(held).alias("dim"), is_query.alias("asks"), F.monotonically_increasing_id().alias("row"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v))
    rows = materialise(rows.withColumn("length", length).withColumn("bin", _length_bin(F.col("length"))), "vectors")
    blocks = materialise(length_blocks(rows), "length-blocks")
    asked = rows.filter("asks").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "dim", "x", "length")

    # 1. a block of the longest bucket that has more than k vectors
    seed = blocks.filter(F.col("held") > k).groupBy("dim").agg(F.max(F.struct("top", "bin", "blocks")).alias("seed")).select("dim", F.col("seed.bin").alias("bin"), F.col("seed.blocks").alias("blocks"))
    many = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    first = rows.join(seed, ["dim", "bin"]).filter(_block(F.col("blocks"), "row") == 0).join(many, "dim").select("dim", _each(F.col("query_blocks")).alias("query_block"), "row", "vec_id", "x")
    ask = asked.join(many, "dim").select("dim", _block(F.col("query_blocks"), "query_row").alias("query_block"), "query_row", "x", F.lit(int(LEAST)).alias("bar"))
    keys = ["dim", "query_block"]
    nearest = materialise(_cogroup(ask, first, keys, k), "first-block")

    # 2. what else can reach the threshold
    bars = nearest.groupBy("query_row").agg(F.min("score").alias("bar"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")
    need = F.when((F.col("bar") > 0) & (F.col("length") > 0), F.col("bar") / F.col("length") * (1 - SLACK)).otherwise(0.0)
    asked = asked.join(bars, "query_row", "left").withColumn("need", F.coalesce(need, F.lit(0.0))).withColumn("group", _length_bin(F.col("need")))
    asked = materialise(asked.withColumn("bar", F.coalesce("bar", F.lit(int(LEAST)))), "thresholds")
    plan = materialise(reached(asked, blocks).join(seed.select("dim", F.col("bin").alias("seed")), "dim", "left"), "reached-buckets")
    keys = ["dim", "group", "query_block", "bin", "block"]
    unseen = ~((F.col("bin") == F.coalesce("seed", F.lit(-2))) & (F.col("block") == 0))
    ask = asked.join(plan, ["dim", "group"]).select("dim", "group", _block(F.col("query_blocks"), "query_row").alias("query_block"), "bin", "seed", _each(F.col("blocks")).alias("block"), "query_row", "x", "bar").filter(unseen).drop("seed")
    other = rows.join(plan, ["dim", "bin"]).select("dim", "group", _each(F.col("query_blocks")).alias("query_block"), "bin", "seed", _block(F.col("blocks"), "row").alias("block"), "row", "vec_id", "x").filter(unseen).drop("seed")
    found = _cogroup(ask, other, keys, k)

    # 3. the best of all blocks
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = nearest.unionByName(found).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(asked.select("query_row", "query_id"), "query_row").select("query_id", "rank", "vec_id", "score")
