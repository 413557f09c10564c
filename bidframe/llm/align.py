"""Alignment of two tokenizers' ids over the same bytes.

A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model with byte fallback. A text is read as
a space and then the text, which is what B makes of it. Byte offsets where a token of A and one of B both end cut the
ids into groups; tokens whose byte ranges overlap are linked.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.llm.common import materialise
from bidframe.llm.tokens import LAST_LATIN, PieceEncoder
from bidframe.llm.words import portions

#: Pieces of text whose alignment a Python worker remembers, about 400 bytes each.
STORED_PIECES = 700_000
#: Characters of neighbouring texts that are handled together.
CHUNK_CHARS = 2_000_000
#: Distinct id pairs that a task counts before it hands the counts on.
COUNTED_PAIRS = 2_000_000
#: Id pairs that are sent to every worker, 24 bytes each; where there are more, links are joined with them instead.
BROADCAST_PAIRS = 4_000_000


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, those from U+0100 on for the other bytes in turn."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """For each offset where a token of A and one of B both end, ascending: the numbers of these tokens. The ends are keys of two dictionaries, whose key sets are intersected."""
    at_a, at_b = dict(zip(a_ends, range(len(a_ends)))), dict(zip(b_ends, range(len(b_ends))))
    shared = sorted(at_a.keys() & at_b.keys())
    return [at_a[e] for e in shared], [at_b[e] for e in shared]


def group_links(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The overlapping pairs, a * 2**32 + b, of ids whose last ends are equal: every byte range between neighbouring ends of either side is in one token of each. Slices that end at common ends may be given together, as no range crosses these."""
    ends = np.union1d(a_ends, b_ends)
    return (a_ids[np.searchsorted(a_ends, ends)].astype(np.int64) << 32) | b_ids[np.searchsorted(b_ends, ends)]


class Aligner:
    """Aligns texts piece by piece, once for each distinct piece.

    A text that is words parted by single spaces or line feeds is cut in front of these. Neither vocabulary joins a
    space or line feed to what is before it, so both sides' ids of the text are those of its pieces, one after the
    other, and every piece ends at a common end. Any other text is one piece. ``codes`` are id pairs, a * 2**32 + b.
    """

    def __init__(self, path_a: str, path_b: str, texts: bool = True, stored: int = STORED_PIECES):
        import sentencepiece

        self.a = PieceEncoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_level_bytes()
        self.a_bytes = {k: bytes([of[c] for c in token]) if all(c in of for c in token) else token.encode() for token, k in self.a.tokenizer.get_vocab().items()}
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        # B's ids of a piece don't depend on its neighbours if no entry goes on over a word's start or holds a line feed
        self.by_piece = self.a.by_piece and not any("▁" in p.lstrip("▁") or "\n" in p for p in names) and self.b.encode("\nx", out_type=str)[:1] == ["▁"]
        self.lengths = [np.array([len(names[k]) if k in names else 1 for k in range(max(names) + 1)]) for names in (self.a_bytes, dict(enumerate(self.b_bytes)))]
        self.names = [str(k) for k in range(max(len(x) for x in self.lengths))]
        self.texts, self.stored = texts, stored
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 3), dtype=np.int32)  # of A, of B, groups; -1 where the bytes differ
        self.codes = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)  # of each piece's codes
        self.scores: tuple = ("", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        self.kept = 0  # pieces that stood in the store before the last call

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of " " + text, each without its space; None for a text that can't be cut."""
        flat = text.replace("\n", " ") if "\n" in text else text
        words = flat.split()
        if not self.by_piece or not words or " ".join(words) != flat:
            return None
        return words if flat is text else text.replace("\n", " \n").split(" ")

    def encode_pieces(self, new: list[str]) -> tuple[list[bytes], list[list[int]]]:
        """Ids of A as little-endian 32-bit integers, and of B."""
        stems = [p.rstrip(".,;:!?") for p in new]
        ends = [bool(s) and s != p and s.isalpha() and max(s) <= LAST_LATIN for s, p in zip(stems, new)]
        learnt = self.a.learn(list({s if e else p for s, e, p in zip(stems, ends, new)}))
        ids_a = [learnt[s] + self.a.mark(p[len(s) :]) if e else learnt[p] for s, e, p in zip(stems, ends, new)]
        ids_b = [ids[1:] if p[0] == "\n" else ids for p, ids in zip(new, self.b.encode(new, num_threads=1))]
        return ids_a, ids_b

    def add(self, texts: list[str], all_a: list[bytes], all_b: list[list[int]]) -> None:
        """Align texts, given with their space, and add them to the store. Texts whose bytes both sides have end at common ends, so all of them are aligned as one."""
        whole = [t.encode() for t in texts]
        counts = np.array([[len(a) >> 2 for a in all_a], [len(b) for b in all_b]], dtype=np.int64).reshape(2, -1)
        ids = [np.frombuffer(b"".join(all_a), "<u4"), np.fromiter(chain.from_iterable(all_b), np.uint32, int(counts[1].sum()))]
        sizes = np.array([len(w) for w in whole], dtype=np.int64)
        good = np.ones(len(texts), dtype=bool)
        for k, names in ((0, self.a_bytes), (1, self.b_bytes)):
            parts = [names[x] for x in ids[k].tolist()]
            if b"".join(parts) != b"".join(whole) or not (np.diff(np.concatenate(([0], np.cumsum([len(p) for p in parts])))[np.concatenate(([0], np.cumsum(counts[k])))]) == sizes).all():
                at = np.concatenate(([0], np.cumsum(counts[k]))).tolist()
                good &= np.array([b"".join(parts[m:n]) == w for m, n, w in zip(at, at[1:], whole)], dtype=bool)
        ids = [x[np.repeat(good, counts[k])] for k, x in enumerate(ids)]
        counts = counts * good
        ends = [np.cumsum(lengths[x]) for lengths, x in zip(self.lengths, ids)]
        at_a, at_b = common_ends(ends[0].tolist(), ends[1].tolist())
        bounds = np.concatenate(([0], np.cumsum(counts[0])))
        group_of = np.searchsorted(bounds, np.array(at_a, dtype=np.int64), side="right") - 1  # the text of each group
        n_groups = np.bincount(group_of, minlength=len(texts))
        codes = group_links(ids[0], ids[1], *ends)
        n_links = np.where(good, counts[0] + counts[1] - n_groups, 0)  # each end of either side closes one link
        if self.texts:
            names_a, names_b = [self.names[x] for x in ids[0].tolist()], [self.names[x] for x in ids[1].tolist()]
            said, k0, m0 = [], 0, 0
            for k, m in zip(at_a, at_b):
                one = names_a[k] if k == k0 else ",".join(names_a[k0 : k + 1])
                other = names_b[m] if m == m0 else ",".join(names_b[m0 : m + 1])
                said.append(f"{one}|{other}")
                k0, m0 = k + 1, m + 1
            cut = np.concatenate(([0], np.cumsum(n_groups))).tolist()
            self.groups.extend([said[x] if y - x == 1 else ";".join(said[x:y]) for x, y in zip(cut, cut[1:])])
        else:
            self.groups.extend([""] * len(texts))
        self.first = np.concatenate((self.first, len(self.codes) + np.cumsum(n_links)))
        self.codes = np.concatenate((self.codes, codes))
        self.sizes = np.concatenate((self.sizes, np.where(good[:, None], np.stack((counts[0], counts[1], n_groups), axis=1), -1).astype(np.int32)))

    def read(self, texts: list[str]) -> list[list[int]]:
        """The numbers, in the store, of each text's pieces in order; they hold until the next call. An empty text has none. The pieces met first, which are the common ones, stay in the store; once it is full, others leave with the next call."""
        self.drop_from(len(self.index))
        self.kept = len(self.groups)
        cut = [self.pieces(t) for t in texts]
        new = list(set().union(*[p for p in cut if p]).difference(self.index))
        whole = [t for t, p in zip(texts, cut) if p is None and t]
        base = len(self.groups)
        if new:
            self.add([p if p[0] == "\n" else " " + p for p in new], *self.encode_pieces(new))
        if whole:
            self.add([" " + t for t in whole], [self.a.whole(" " + t) for t in whole], self.b.encode(whole, num_threads=1))
        more = dict(zip(new, range(base, base + len(new))))
        find = self.index.__getitem__
        if base + len(new) <= self.stored:
            self.index.update(more)
        else:
            find = lambda p, old=self.index.get: more[p] if (k := old(p)) is None else k
        at, out = iter(range(base + len(new), len(self.groups))), []
        for text, pieces in zip(texts, cut):
            out.append(list(map(find, pieces)) if pieces else [next(at)] if text else [])
        return out

    def drop_from(self, n: int) -> None:
        del self.groups[n:]
        self.first, self.sizes = self.first[: n + 1], self.sizes[:n]
        self.codes = self.codes[: self.first[-1]]

    def score(self, key: str, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece in the store, over its links: how many are best, and the sum of their counts. ``table`` has codes in order, counts and whether they are best; ``key`` names it. Only pieces that are new since the last call are looked up."""
        old, best, counted = self.scores
        kept = min(self.kept, len(best)) if old == key else 0
        codes, first = self.codes[self.first[kept] :], self.first[kept:] - self.first[kept]
        at = np.minimum(np.searchsorted(table[0], codes), max(len(table[0]) - 1, 0))
        known = table[0][at] == codes if len(table[0]) else np.zeros(0, dtype=bool)
        out = []
        for had, values in ((best, table[2]), (counted, table[1])):
            sums = np.concatenate(([0], np.cumsum(np.where(known, values[at], 0) if len(known) else np.zeros(len(codes), dtype=np.int64))))
            out.append(np.concatenate((had[:kept], sums[first[1:]] - sums[first[:-1]])))
        self.scores = (key, *out)
        return out[0], out[1]

    def links(self, pieces: np.ndarray) -> np.ndarray:
        """The codes of these pieces, one piece after the other."""
        counts = self.first[pieces + 1] - self.first[pieces]
        ends = np.cumsum(counts)
        return self.codes[np.repeat(self.first[pieces] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


_aligners: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str, texts: bool) -> Aligner:
    """One per Python worker, which keeps what it has learnt from task to task."""
    key = (path_a, path_b, texts)
    if key not in _aligners:
        _aligners.clear()  # what an earlier pass has learnt goes
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _read(batches: Iterator[pa.RecordBatch], column: int, known: Aligner) -> Iterator[tuple[pa.RecordBatch, int, int, list[list[int]]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        for first, last in portions(texts, CHUNK_CHARS):
            yield batch, first, last, known.read(texts[first:last])


def linked_pairs(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(a, b, n): in how many documents tokens with these ids are linked. Tasks hand on one count per pair, not one row per document and pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = aligner(path_a, path_b, False), {}

        def handed() -> pa.RecordBatch:
            codes = np.fromiter(total.keys(), np.int64, len(total))
            return pa.RecordBatch.from_pydict({"a": (codes >> 32).astype(np.int32), "b": (codes & 0xFFFFFFFF).astype(np.int32), "n": np.fromiter(total.values(), np.int64, len(total))})

        for _, _, _, rows in _read(batches, 0, known):
            held = []
            for row in rows:
                pieces = np.array(list(set(row)), dtype=np.int64)
                if len(pieces) and known.sizes[pieces, 0].min() >= 0:
                    held.append(np.unique(known.links(pieces)))
            codes, counts = np.unique(np.concatenate(held), return_counts=True) if held else ([], [])
            for code, n in zip(np.asarray(codes).tolist(), np.asarray(counts).tolist()):
                total[code] = total.get(code, 0) + n
            if len(total) > COUNTED_PAIRS:
                yield handed()
                total.clear()
        yield handed()

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _aligned(path_a: str, path_b: str, pairs):
    """What ``mapInArrow`` runs over (doc_id, text): the digest columns, and n_best and count_sum by a broadcast of (codes, n, best), or else the distinct links and how often each occurs."""

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b, True)
        table = pairs.value if pairs else None
        for batch, first, last, rows in _read(batches, 1, known):
            names = ["n_a", "n_b", "n_groups", "n_links"]
            out: dict[str, list] = {k: [] for k in (*names, "n_best", "count_sum", "groups_sha256")}
            links: list[np.ndarray] = []
            if table:
                best, counted = known.score(key, table)
            n_links = np.diff(known.first)
            for row in rows:
                pieces = np.array(row, dtype=np.int64)
                if len(pieces) and known.sizes[pieces, 0].min() >= 0:
                    values = [*known.sizes[pieces].sum(axis=0).tolist(), int(n_links[pieces].sum())]
                    said = hashlib.sha256(";".join(map(known.groups.__getitem__, row)).encode()).hexdigest()
                else:
                    values, said, pieces = [0] * 4, "", pieces[:0]
                for k, v in zip(names, values):
                    out[k].append(v)
                out["n_best"].append(int(best[pieces].sum()) if table else 0)
                out["count_sum"].append(int(counted[pieces].sum()) if table else 0)
                out["groups_sha256"].append(said)
                links.append(known.links(pieces) if not table else pieces[:0])
            columns = {"doc_id": batch.column(0).slice(first, last - first)} | {k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in out.items()}
            found = [np.unique(x, return_counts=True) for x in links]
            edges = pa.array(np.concatenate(([0], np.cumsum([len(x) for x, _ in found]))).astype(np.int32))
            for k, part in (("codes", 0), ("times", 1)):
                columns[k] = pa.ListArray.from_arrays(edges, pa.array(np.concatenate([x[part] for x in found]).astype(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Align every whole text's ids of A and of B.

    Returns per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is in as many
    documents as any pair of its A id), count_sum (documents of each link's pair, summed over links) and
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``). One pass counts the pairs in tasks and sums them; a second aligns again,
    as texts are cheaper to align than links are to shuffle, and looks the counts up: in a broadcast table if there
    are at most ``broadcast_pairs`` of them, else by a join on (row, pair), one row for each distinct link of a document.

    A text that is null, empty, or whose ids of either side don't have the bytes of a space and the text has no
    tokens: zeros and an empty ``groups_sha256``. Rows that repeat a doc_id or a text are rows of their own, each
    counted; a null doc_id stays null. An empty table gives no rows. Columns other than doc_id and text aren't looked at.
    """
    spark = docs.sparkSession
    counts = linked_pairs(docs, path_a, path_b, text)
    most = W.partitionBy("a")
    pairs = materialise(counts.select("a", "b", "n", (F.col("n") == F.max("n").over(most)).cast("long").alias("best")), "pairs")
    rows = docs.select("doc_id", F.col(text).alias("text"))
    digest = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {digest}, codes array<long>, times array<long>"
    code = F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")
    if pairs.count() <= broadcast_pairs:
        held = pairs.select(code.alias("code"), "n", "best").toArrow()
        order = np.argsort(held["code"].to_numpy())
        sent = spark.sparkContext.broadcast(tuple(held[c].to_numpy()[order] for c in ("code", "n", "best")))
        return rows.mapInArrow(_aligned(path_a, path_b, sent), schema).drop("codes", "times")
    found = materialise(rows.mapInArrow(_aligned(path_a, path_b, None), schema).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = found.select("row", F.explode(F.arrays_zip("codes", "times")).alias("link")).select("row", F.col("link.codes").alias("code"), F.col("link.times").alias("times"))
    sums = links.join(pairs.select(code.alias("code"), "n", "best"), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    plain = found.drop("codes", "times", "n_best", "count_sum").join(sums, "row", "left")
    return plain.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
