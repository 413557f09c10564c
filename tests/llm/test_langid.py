"""Language ID against a plain fit and score, on letters, long texts and clashing columns."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bidframe.llm import langid


def words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def grams(word, n):
    if n == 1:
        return list(word)
    padded = f"<{word}>"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Plain:
    """The model as its definition says it, with strings and dictionaries."""

    def __init__(self, rows):
        self.langs = sorted({lang for lang, text in rows if words(text)})
        self.counts = defaultdict(Counter)
        for lang, text in rows:
            for w in words(text):
                self.counts[0, lang][w] += 1
                for n in range(1, 6):
                    self.counts[n, lang].update(grams(w, n))
        self.totals = {k: c.total() for k, c in self.counts.items()}
        self.known = {n: set().union(*[self.counts[n, x] for x in self.langs]) for n in range(6)}

    def log(self, n, lang, string):
        return math.log((self.counts[n, lang][string] + 0.5) / (self.totals[n, lang] + 0.5 * (len(self.known[n]) + 1)))

    def score(self, word, lang):
        if word in self.known[0]:
            return self.log(0, lang, word)
        for n in range(5, 0, -1):
            got = [self.log(n, lang, g) for g in grams(word, n) if g in self.known[n]]
            if got:
                return sum(got) / len(got)
        return 0.0

    def predict(self, text):
        found = Counter(words(text))
        if not found or not self.langs:
            return "und", 0.0
        total = [sum(k * self.score(w, lang) for w, k in found.items()) for lang in self.langs]
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        return self.langs[best], 1 / sum(math.exp(max(x - total[best], -700)) for x in total)


def model_of(rows):
    lang, kind, key, n = [], [], [], []
    for name, text in rows:
        for k, keys, times in langid.count_block([text]):
            lang += [name] * len(keys)
            kind.append(np.full(len(keys), k))
            key.append(keys)
            n.append(times)
    return langid.BackoffModel(lang, *(np.concatenate(x) for x in (kind, key, n)))


def test_all_documents_as_the_plain_model(spark, sf_dir):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    plain = Plain([(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5])
    got = {r.doc_id: r for r in langid.identify_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fit_docs=10**6).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = plain.predict(r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-3)


ROWS = [("aa", "the thing sings"), ("bb", "der schuh ist schön"), ("aa", "zzz quick"), ("bb", "yy ärger")]


@pytest.mark.parametrize("text", ["the", "der", "xxing", "schxx", "yyy", "12 + 3", None, "", "日本", "m²", "x½ y¹", "²³", "the² thing", "İstanbul the", "a_b c3d", "\ud800 the", "ſchuh ß ÄRGER"])
def test_words_are_maximal_runs_of_letters(text):
    model, plain = model_of(ROWS), Plain(ROWS)
    (lang,), (score,) = model.predict([text])
    assert lang == plain.predict(text)[0] and score == pytest.approx(plain.predict(text)[1], abs=1e-5)
    assert (lang == "und") == (not any(c.isalpha() for c in text or ""))


def test_long_texts_are_cut_between_words(monkeypatch):
    model = model_of(ROWS)
    text = "the schuh " * 50 + "q" * 300 + " der yy" * 40
    whole = model.predict([text, "der"])
    monkeypatch.setattr(langid, "BLOCK_CHARS", 64)
    number, pieces = langid.segments([text, None, "der"])
    assert "".join(pieces[:-1]) == text and number[-1] == 2 and len(pieces) > 10
    got = model.predict([text, "der"])
    assert got[0] == whole[0] and got[1] == pytest.approx(whole[1])


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "the thing", "x", 7, 0.5), (2, None, "y", 8, 0.1), (None, "der schuh", "z", 9, 0.2)], "doc_id long, text string, row string, found int, score double")
    got = langid.identify(docs, model_of(ROWS))
    assert sorted(got.columns) == ["doc_id", "found", "lang_pred", "row", "score", "text"]
    assert {(r.row, r.found, r.lang_pred) for r in got.collect()} == {("x", 7, "aa"), ("y", 8, "und"), ("z", 9, "bb")}


def test_rows_are_kept_with_their_columns(spark):
    docs = spark.createDataFrame([(k, t, lang, k) for k, (lang, t) in enumerate(ROWS * 20)] + [(500, "12", "aa", 1), (None, "the thing", None, 2), (1, None, None, 3)], "doc_id long, text string, lang string, row long")
    got = langid.keep_identified(docs, 0.5)
    assert got.columns == docs.columns and got.filter("doc_id = 500 OR text IS NULL").count() == 0 and got.filter("doc_id IS NULL").count() == 1
    assert got.count() == len(ROWS) * 20 + 1
