"""Benchmark decontamination by template windows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidframe.llm.common import materialise, trimmed
from bidframe.llm.words import BASE, BASE_INVERSE, mix, powers, text_blocks

#: Words of a window; a shorter item is one window.
WIDTH = 8
#: Share of an item's windows that one document must hold.
COVERAGE = 0.5
#: Words of a window that must not be placeholders.
LITERALS = 4
#: Bits of the filter that lets a document's window through to the join; its size bounds what is broadcast.
FILTER_BITS = 1 << 22

#: Words that count as units of measure after a number.
UNITS = "mm cm m km mi ft in yd g kg mg lb oz t s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years km/h mph l ml gal c f k w kw mw v a hz khz mhz ghz b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents percent pound pounds metre metres meter meters mile miles gram grams kilogram kilograms litre litres".split()

NUMBER, NAME, UNIT = 1, 2, 3


def _raw_hash(word: str) -> int:
    """The hash that ``templates`` gives a word, before placeholders."""
    h = 0
    for k, letter in enumerate(word):
        h = (h + (ord(letter) + 1) * pow(BASE, k, 1 << 64)) % (1 << 64)
    return int(mix(np.array([h], dtype=np.uint64), 1)[0])


_UNIT_HASHES = np.sort(np.array([_raw_hash(u.replace("/", "")) for u in UNITS], dtype=np.uint64))
_tables: list[np.ndarray] = []


def character_tables() -> list[np.ndarray]:
    """For every code point whether it is a letter or digit, whether it is white space, and its lower case (itself, if that has several characters)."""
    if not _tables:
        every = [chr(k) for k in range(0x110000)]
        _tables.extend(np.fromiter(map(test, every), bool, len(every)) for test in (str.isalnum, str.isspace))
        _tables.append(np.fromiter((ord(low) if len(low := c.lower()) == 1 else ord(c) for c in every), np.uint32, len(every)))
    return _tables


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a block of texts in UTF-8, and where each text's start (and the last ends)."""
    body = data.tobytes()
    points = np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    edges = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    if edges[-1] != len(points):  # bytes that aren't UTF-8: text by text
        texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return points, edges


def templates(data: np.ndarray, offsets: np.ndarray):
    """The words of a block of texts, as (hash, kind, first, opener): letters and digits only, lower-cased, with kind 0
    for a literal word, or a placeholder's kind. A number holds a digit. A name is a capitalised word, not all
    capitals, that doesn't begin a sentence; one that does is an opener. A unit is a word of the list that follows a
    number."""
    is_letter, is_white, lower_of = character_tables()
    points, offsets = code_points(data, offsets)
    kept = is_letter[points] | is_white[points]
    end = (points == 46) | (points == 33) | (points == 63) | (points == 10) | (points == 58) | (points == 124)
    ends = np.concatenate(([0], np.cumsum(end)))
    where = np.flatnonzero(kept)
    small = points[where]
    small_offsets = np.searchsorted(where, offsets)
    inside = ~is_white[small]
    edge = np.zeros(len(small) + 1, dtype=bool)
    edge[small_offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(small) else inside
    after = np.concatenate((inside[1:], [False])) if len(small) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, small_offsets)
    lower = lower_of[small]
    sums = np.zeros(len(small) + 1, dtype=np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(small)), out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * powers(BASE_INVERSE, len(small) + 1)[start], 1)
    kind, opener = np.zeros(len(start), dtype=np.int8), np.zeros(len(start), dtype=bool)
    if len(start):
        capital = lower != small
        count = lambda flags: np.concatenate(([0], np.cumsum(flags)))
        capitals, digits = count(capital), count((small >= 48) & (small <= 57))
        opens = np.zeros(len(start), dtype=bool)
        opens[first[:-1][first[:-1] < len(start)]] = True
        opens[1:] |= ends[where[start[1:]]] > ends[where[stop[:-1] - 1]]
        name = capital[start] & (capitals[stop] - capitals[start] == 1) & (stop - start > 1)
        kind[name & ~opens] = NAME
        number = digits[stop] > digits[start]
        kind[number] = NUMBER
        opener = name & opens & ~number
        at = np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)
        unit = (_UNIT_HASHES[at] == hashes) & (kind == 0)
        unit[1:] &= kind[:-1] == NUMBER
        unit[0] = False
        unit[first[:-1][first[:-1] < len(start)]] = False
        kind[unit] = UNIT
    return hashes, kind, first, opener


def merge_runs(hashes: np.ndarray, kind: np.ndarray, first: np.ndarray, opener: np.ndarray):
    """The words of ``templates`` with each run of numbers and their units, or of names and openers, as one word whose hash is that of the whole run."""
    if not len(hashes):
        return hashes, kind, first
    kind = np.where(opener, NAME, np.where(kind == UNIT, NUMBER, kind)).astype(np.int8)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = np.concatenate(([False], (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME)) & ~opener[1:] & (row[1:] == row[:-1])))
    start = np.flatnonzero(~same)
    place = (np.arange(len(hashes)) - start[np.cumsum(~same) - 1]).astype(np.uint64)
    whole = np.add.reduceat(mix(hashes + place * np.uint64(BASE), 4), start)
    single = np.diff(np.concatenate((start, [len(hashes)]))) == 1
    return np.where(single, hashes[start], whole), kind[start], np.concatenate(([0], np.cumsum(~same)))[first]


def _windows(hashes: np.ndarray, kind: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The template windows of ``width`` words of a block: the positions of their first words and their hashes. Windows that reach into the next text or have too few literal words are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.where(kind == 0, hashes, kind.astype(np.uint64))
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(BASE) + mix(word[k : k + n], k)
    literal = np.concatenate(([0], np.cumsum(kind == 0)))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    good = (row[: n] == row[width - 1 :]) & (literal[width:] - literal[:-width] >= min(LITERALS, width))
    at = np.flatnonzero(good)
    return at, mix(total[at], 3)


def _window_batches(widths: list[int], passes: np.ndarray | None):
    """Rows (id, at, window, slots, n_words, form) of each text's windows, read word by word (form 0) and with runs of
    numbers and units, or of names (capitalised words that begin a sentence among them), as one word (form 1).

    With a filter these are the windows of all ``widths`` that pass it, for documents. Without one each text is a
    benchmark item, whose windows have WIDTH words, or as many as it has itself if those are fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, last_row, data, offsets in text_blocks(batch.column(1)):
                plain = templates(data, offsets)
                for form, (hashes, kind, first) in enumerate((plain[:3], merge_runs(*plain))):
                    sizes = np.diff(first)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    tried = widths if passes is not None else sorted({WIDTH, *sizes[(sizes > 0) & (sizes < WIDTH)].tolist()})
                    for width in tried:
                        at, windows = _windows(hashes, kind, first, width)
                        if passes is not None:
                            bit = windows % np.uint64(FILTER_BITS)
                            keep = (passes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        else:
                            keep = np.minimum(sizes[row[at]], WIDTH) == width
                        at, windows = at[keep], windows[keep]
                        slots = [hashes[k : k + width][kind[k : k + width] > 0].view(np.int64) for k in at.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[batch.column(k).take(pa.array(first_row + row[at])) for k in (0, 2)], pa.array((at - first[row[at]]).astype(np.int32)), pa.array(windows.view(np.int64)), pa.array(slots, pa.list_(pa.int64())),
                                pa.array(sizes[row[at]].astype(np.int32)), pa.array(np.full(len(at), form, np.int32)),
                            ],
                            names=["id", "text_key", "at", "window", "slots", "n_words", "form"],
                        )

    return run


def joined_cover(shift: list[int], item_at: list[int], said: list, says: list, reach: int) -> int:
    """The most windows of an item that one place of a document holds, of the windows met there.

    Within one shift, windows whose slots are not replaced one by one, in both directions, don't count. From each
    shift on, the other shifts less than ``reach`` away join it, the best filled first, with those of their windows
    that aren't there yet and whose slots agree with all that are.
    """
    hits = defaultdict(dict)
    for s, at, a, b in zip(shift, item_at, said, says):
        hits[int(s)][int(at)] = list(zip(a, b))
    whole = {}
    for s, windows in hits.items():
        there, back = defaultdict(set), defaultdict(set)
        for slots in windows.values():
            for a, b in slots:
                there[a].add(b)
                back[b].add(a)
        whole[s] = {at: slots for at, slots in windows.items() if all(len(there[a]) == 1 == len(back[b]) for a, b in slots)}
    most, order = 0, sorted(whole)
    for s in order:
        found, there, back = set(), {}, {}
        near = order[bisect_right(order, s - reach) : bisect_left(order, s + reach)]
        for other in sorted(near, key=lambda x: (x != s, -len(whole[x]), abs(x - s), x)):
            for at, slots in sorted(whole[other].items()):
                if at not in found and all(there.get(a, b) == b and back.get(b, a) == a for a, b in slots):
                    found.add(at)
                    there.update(slots)
                    back.update((b, a) for a, b in slots)
        most = max(most, len(found))
    return most


_ROW = "id long, text_key long, at int, window long, slots array<long>, n_words int, form int"


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(0))


def _text_key(doc_id: Column, text: Column) -> Column:
    """0 for a document that has a doc_id; one without is told apart by its text."""
    return F.when(doc_id.isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text).bitwiseOR(F.lit(1).cast("long")))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold a benchmark item, re-parameterised or not: doc (doc_id, 0 without one), text_key, item_id, coverage.

    Words are reduced to letters and digits in lower case, of any script; numbers, names and units become typed
    placeholders, which may span words: "1 200 euros" or "Mary Ann Smith" is also read as one. Every
    window of 8 such words is hashed, and documents' windows meet items' windows in a join on the hash. A fixed-size
    bit filter of the items' windows (512 KB) is broadcast first, so that other windows never leave their task; it
    only saves work, and the join decides. Slots are then checked: what an item has in its slots must be replaced
    consistently, one value by one value in both directions, within one alignment of document and item (equal
    distance between their positions) and over those that join it. Inserted or removed words only move the
    alignment, so alignments less than the item's length apart count together. A document holds an item if they
    cover ``coverage`` of the item's windows, be runs of numbers or names read word by word or as one slot each.

    Items with fewer than 8 words are one window of their own width; items without 4 literal words in any window (or
    all words literal, if fewer) can't be recognised and match nothing. Null and empty texts hold nothing. Repeated
    rows of a doc_id give its item once; empty tables give an empty result. Other columns aren't looked at.
    """
    own = ["doc", "text_key", "item_id", "form"]
    items = materialise(benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text", F.lit(0).cast("long")).mapInArrow(trimmed(_window_batches([WIDTH], None)), _ROW), "items")
    bits = items.select(F.expr(f"CAST(window & {FILTER_BITS - 1} AS INT)").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    passes = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    np.bitwise_or.at(passes, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    short = [r[0] for r in items.filter(F.col("n_words") < WIDTH).select("n_words").distinct().collect()]
    found = docs.select(_doc(F.col("doc_id")).alias("id"), "text", _text_key(F.col("doc_id"), F.col("text")).alias("text_key")).mapInArrow(trimmed(_window_batches([WIDTH, *short], passes)), _ROW)
    of_item = items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "window", F.col("slots").alias("item_slots"), "form")
    sizes = items.groupBy(F.col("id").alias("item_id"), "form").agg(F.countDistinct("at").alias("windows"), F.max("n_words").alias("n_words"))
    met = found.select(F.col("id").alias("doc"), "text_key", "at", "window", "slots", "form").join(of_item, ["window", "form"])
    met = materialise(met.withColumn("shift", F.col("at") - F.col("item_at")).select(*own, "shift", "item_at", "item_slots", "slots").distinct(), "met-windows")
    enough = met.groupBy(*own).agg(F.countDistinct("item_at").alias("n")).join(sizes, ["item_id", "form"]).filter(F.col("n") >= coverage * F.col("windows")).drop("n")

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        n = joined_cover(group["shift"], group["item_at"], group["item_slots"], group["slots"], int(group["n_words"].iloc[0]))
        return pd.DataFrame({c: group[c].iloc[:1] for c in own[:3]} | {"coverage": [n / group["windows"].iloc[0]]})

    share = met.join(enough, own).groupBy(*own).applyInPandas(cover, "doc long, text_key long, item_id long, coverage double")
    return share.filter(F.col("coverage") >= coverage).groupBy(*own[:3]).agg(F.max("coverage").alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage of the documents that hold a benchmark item, as ``leaks`` finds them. Texts without a doc_id that hold one have a row each, with a null doc_id."""
    doc_id = F.when(F.col("text_key") == 0, F.col("doc")).cast("long")
    return leaks(docs, benchmark, coverage).select(doc_id.alias("doc_id"), "item_id", "coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Rows that share a doc_id go together; rows without one go by their own text."""
    found = leaks(docs, benchmark, coverage).select("doc", "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    same = (_doc(F.col("row.doc_id")) == F.col("doc")) & (_text_key(F.col("row.doc_id"), F.col("row.text")) == F.col("text_key"))
    return rows.join(found, same, "left_anti").select("row.*")
