"""Language identification by word-first backoff.

Words and n-grams are handled as 64-bit hashes of their code points, a block of texts at a time, so that a model keeps
everything it was fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.llm.common import give_back, trimmed
from bidframe.llm.words import BASE, BASE_INVERSE, mix, portions, powers

#: Labelled documents of each language that the model is fitted on, about; the sample is drawn by a hash of doc_id.
#: This alone bounds the model: every word and n-gram of the sample is kept.
FIT_DOCS = 1000
LONGEST_GRAM = 5
#: Added to every count.
SMOOTH = 0.5
#: Characters of neighbouring texts that are handled at once.
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"

_alphabetic: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    """``str.isalpha`` of code points."""
    if not _alphabetic:
        _alphabetic.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _alphabetic[0][points]


def segments(texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """The texts, long ones in pieces of about BLOCK_CHARS that end with a word, and the number of the text of each piece."""
    number, out = [], []
    for k, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = at + BLOCK_CHARS
            while end < len(text) and text[end].isalpha():
                end += 1
            number.append(k)
            out.append(text[at:end] if at or end < len(text) else text)
            at = end
    return np.array(number, dtype=np.int64), out


class Runs:
    """The words of a block of texts: maximal runs of letters of the lower-cased texts.

    points: code points of all texts; start, end, text: of each word, the text by number; hash: of its code points.
    """

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        flags = np.zeros(len(self.points) + 2, dtype=np.int8)
        flags[1:-1] = is_letter(self.points)
        turns = np.diff(flags)
        self.start, self.end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        edges = np.cumsum([0] + [len(t) + 1 for t in low])
        self.text = np.searchsorted(edges, self.start, side="right") - 1
        n = len(self.points)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(BASE_INVERSE, n + 1)[self.start], 1)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, a word that has it, and for every word the number of its hash)."""
        return np.unique(self.hash, return_index=True, return_inverse=True)

    def padded(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of words, each between ``<`` and ``>``, and where each begins (and the last ends)."""
        sizes = self.end[words] - self.start[words] + 2
        begin = np.concatenate(([0], np.cumsum(sizes)))
        out = self.points[np.clip(np.repeat(self.start[words] - 1 - begin[:-1], sizes) + np.arange(begin[-1]), 0, max(len(self.points) - 1, 0))]
        out[begin[:-1]], out[begin[1:] - 1] = ord("<"), ord(">")
        return out, begin


def gram_hashes(points: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of padded words: their hashes and the number of the word of each. Single characters are the word's own, without the padding."""
    sizes = np.diff(begin)
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(points)) - np.repeat(begin[:-1], sizes)
    good = (place > 0) & (place < sizes[word] - 1) if n == 1 else place <= sizes[word] - n
    at = np.flatnonzero(good)
    total = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(BASE) + points[at + k] + np.uint64(1)
    return mix(total, 20 + n), word[at]


class HashIndex:
    """Finds the places of 64-bit hashes in an array of distinct ones: their leading bits say where to look in its sorted copy."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)))).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't there."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        prefix = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[prefix], self.starts[prefix + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[at[live]] == hashes[live]
            out[live[hit]] = self.order[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class BackoffModel:
    """Per-language log frequencies of words and of character n-grams.

    A known word adds its log frequency in each language. A word that isn't known is scored by its longest n-grams
    that are: all of length 5 if any is known, else of length 4, and so on down to 1, by the mean of their log
    frequencies. N-grams of two and more characters are cut from the word between ``<`` and ``>``. A word without any
    known character adds nothing.
    """

    def __init__(self, lang: list[str], kind: np.ndarray, key: np.ndarray, n: np.ndarray):
        """One entry per language, kind (0 for a word, or n for an n-gram) and hash: how often it occurs."""
        self.langs = sorted(set(lang))
        number = {name: k for k, name in enumerate(self.langs)}
        of = np.fromiter((number[x] for x in lang), np.int64, len(lang))
        self.index: dict[int, HashIndex] = {}
        self.logs: dict[int, np.ndarray] = {}
        for k in np.unique(kind).tolist():
            part = kind == k
            keys, row = np.unique(key[part], return_inverse=True)
            table = np.zeros((len(keys), len(number)))
            np.add.at(table, (row, of[part]), n[part])
            self.index[k] = HashIndex(keys)
            self.logs[k] = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * (len(keys) + 1))).astype(np.float32)

    def back_off(self, runs: Runs, words: np.ndarray) -> np.ndarray:
        """Scores of unseen words, one row each."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.arange(len(words))
        for n in range(LONGEST_GRAM, 0, -1):
            if n not in self.index or not len(left):
                continue
            hashes, word = gram_hashes(*runs.padded(words[left]), n)
            rows = self.index[n].find(hashes)
            known = rows >= 0
            rows, word = rows[known], word[known]
            held = np.bincount(word, minlength=len(left))
            some = held > 0
            for j in range(len(self.langs)):
                out[left[some], j] = (np.bincount(word, weights=self.logs[n][rows, j], minlength=len(left))[some]) / held[some]
            left = left[~some]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the likelihood; ties go to the first by code point."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool)
        number, bodies = segments(texts)
        for first, last in portions(bodies, BLOCK_CHARS) if self.langs else ():
            runs = Runs(bodies[first:last])
            if not len(runs.start):
                continue
            hashes, example, inverse = runs.distinct()
            rows = self.index[0].find(hashes)
            of_word = np.zeros((len(hashes), len(self.langs)))
            seen = rows >= 0
            of_word[seen] = self.logs[0][rows[seen]]
            of_word[~seen] = self.back_off(runs, example[~seen])
            cut = np.flatnonzero(np.diff(runs.text, prepend=-1))
            texts_here = number[first + runs.text[cut]]
            np.add.at(total, texts_here, np.add.reduceat(of_word[inverse], cut, axis=0))
            letters[texts_here] = True
        for k in np.flatnonzero(letters).tolist():
            best = int(total[k].argmax())
            langs[k], scores[k] = self.langs[best], 1.0 / float(np.exp(np.clip(total[k] - total[k, best], -700, 0)).sum())
        return langs, scores


def count_block(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, hashes, counts) of the words and n-grams of texts."""
    runs = Runs(texts)
    hashes, example, inverse = runs.distinct()
    times = np.bincount(inverse, minlength=len(hashes))
    yield 0, hashes, times
    padded = runs.padded(example)
    for n in range(1, LONGEST_GRAM + 1):
        grams, word = gram_hashes(*padded, n)
        keys, row = np.unique(grams, return_inverse=True)
        yield n, keys, np.bincount(row, weights=times[word], minlength=len(keys)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).extend(segments([text])[1])
        for lang, rows in texts.items():
            for first, last in portions(rows, BLOCK_CHARS):
                for kind, keys, n in count_block(rows[first:last]):
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> BackoffModel:
    """Fit on ``docs(doc_id, text, lang)``, on about ``fit_docs`` of each language's labelled documents: those with the smallest hashes of doc_id, by a bound on the hash that the languages' counts give."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    per = docs.groupBy("lang").count().collect()
    if not per:
        return BackoffModel([], *np.zeros((3, 0), np.int64))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keep = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(math.ceil(min(1.0, fit_docs / r["count"]) * (1 << 30)))) for r in per])
    counts = docs.filter(place < keep).select("text", "lang").mapInArrow(trimmed(_count_batches), "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow()
    # languages as in the sample; one whose documents have no letters has no entry
    return BackoffModel(counts["lang"].to_pylist(), counts["kind"].to_numpy(), counts["key"].to_numpy().view(np.uint64), counts["n"].to_numpy())


def identify(docs: DataFrame, model: BackoffModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone; columns of these names are replaced, all others stay.

    A text that is null or has no letter is ``und`` with score 0; so is every text if the model has no language. A
    text none of whose characters the model knows goes to the first language with an equal share for each. Repeated
    rows are judged one by one, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame(dict(zip(("lang_pred", "score"), shared.value.predict(texts.tolist()))))
        give_back()
        return found

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(F.struct(*others).alias("row"), predict(F.col(text)).alias("found"))
    return found.select("row.*", "found.lang_pred", "found.score")


def held_out():
    """True for the fifth of documents that no fit may see."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify_documents(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; the model is fitted on labelled documents that aren't held out. Repeated rows are judged one by one, and an empty table gives an empty result."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")), fit_docs)
    return identify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is identified with ``least_score`` of the likelihood or more; the model is fitted as for ``identify_documents``."""
    model = fit(docs.filter(~held_out()), fit_docs)
    found = identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
