"""Disclosure of entities by terms: planted names, rare words, letters that change length, and a plain version of the statistic."""

import math
import random
import re
from collections import Counter

import pytest

from bidframe.llm import pii


def plain_base(text):
    """(start, end, kind, text) by the contract's patterns; cards and phones don't occur in these tests."""
    out = [(*m.span(), "email", m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    return sorted(out + [(*m.span(), "ip", m[0]) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))])


def plain_disclosing(texts, window=8, z=1.96, candidates=4, least=2, disclosure=0.5):
    """{(entity, term): share} by loops over whole texts."""
    together, entities, holds = {}, Counter(), Counter()
    for text in texts:
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{2,}", text)]
        holds.update({w for w, _, _ in words})
        spans = plain_base(text)
        entities.update({f"{k}:{x.lower()}" for _, _, k, x in spans})
        free = [w for w in words if not any(w[1] < e and s < w[2] for s, e, _, _ in spans)]
        for s, e, k, x in spans:
            for w in [f for f in free if f[2] <= s][-window:] + [f for f in free if f[1] >= e][:window]:
                together.setdefault((f"{k}:{x.lower()}", w[0]), set()).add(text)
    out, total = {}, max(2, len(texts))
    for (e, t), where in together.items():
        k, n = len(where), holds[t]
        p = k / n
        sure = (p + z**2 / (2 * n) - z * math.sqrt(p * (1 - p) / n + z**2 / (4 * n**2))) / (1 + z**2 / n)
        own = math.log2(total / entities[e])
        share = math.log2(sure * total / entities[e]) / own if own > 0 else 0.0
        if k >= least and sure * candidates > 1 and share >= disclosure:
            out[e, t] = share
    return out


def corpus(seed=2, n=900):
    """Texts of common and rare words; 30 people whose name stands near their address in 3 to 6 texts, and addresses without a name."""
    draw = random.Random(seed)
    word = lambda k: "".join(draw.choices("abcdefghijklmnoprstuvw", k=k))
    common, names = [word(5) for _ in range(300)], {f"Nom{word(6)}": f"{word(7)}@mail.example.org" for _ in range(30)}

    def filler(n):
        return " ".join(word(9) if draw.random() < 0.1 else draw.choice(common) for _ in range(n))

    texts = [f"{filler(draw.randrange(20, 90))}." for _ in range(n)]
    for name, mail in names.items():
        texts += [f"{filler(30)} {name} {filler(draw.randrange(4))} {mail} {filler(30)}" for _ in range(draw.randrange(3, 7))]
    texts += [f"{filler(40)} {word(8)}@other.example.org and 10.0.{k}.7 {filler(40)}" for k in range(120)]
    texts += [f"{filler(40)} info@shop.example.org {filler(40)}" for k in range(400)]  # an address of a third of all texts
    return texts, names


def found(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return {(r.entity, r.term): r.share for r in pii.disclosing_terms(docs, pii.base_findings(docs), **more).collect()}


@pytest.mark.parametrize("named", [pii.NAMED_TERMS, 0])
def test_statistic_as_shipped(spark, named):
    texts, names = corpus()
    got = found(spark, texts, named=named)
    assert got == pytest.approx(plain_disclosing(texts))
    # recall and precision over the planted names, against plain rare words around them
    want = {(f"email:{mail}", name.lower()) for name, mail in names.items()}
    assert len(want & set(got)) == 30 and len(want & set(got)) / len(got) > 0.9


def test_given_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text LIKE '%@%' OR doc_id % 2 = 0").collect()]
    texts += [f"{t[:200]} Zebulonia zeb@home.example.org {t[200:400]}" for t in texts[:6]]
    got = found(spark, texts)
    assert got == pytest.approx(plain_disclosing(texts)) and ("email:zeb@home.example.org", "zebulonia") in got


def test_copies_of_one_text_are_no_evidence(spark):
    text = "one long word heliotropium beside anna@home.example.org here"
    others = [f"plain text number {k} of many" for k in range(300)]
    assert found(spark, [text] * 40 + others) == {}
    assert ("email:anna@home.example.org", "heliotropium") in found(spark, [f"{text} {k}" for k in range(5)] + others)


def test_letters_that_change_length(spark):
    """A capital whose lower case is two characters long is counted as the term it becomes, and its place is kept."""
    texts = [f"we met İstanbullu at the door ist@home.example.org today {k}" for k in range(5)] + [f"we met at the door today {k}" for k in range(300)]
    assert ("email:ist@home.example.org", "İstanbullu".lower()) in found(spark, texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [(s.start, s.end) for s in pii.find_personal_data(docs).filter("doc_id = 0").first().spans if s.kind == "term"]
    assert [texts[0][a:b] for a, b in spans] == ["İstanbullu"]


def test_every_place_of_a_term_goes(spark):
    texts = [f"Zebulon said so. {'a and the ' * 40} Zebulon for zeb@home.example.org {k}" for k in range(4)] + [f"and the a said so for {k}" for k in range(300)] + ["Zebulon again, without an address"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, near string, together int")
    found_ = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(docs).collect()}
    assert all(found_[k].count("term") == 2 and found_[k].count("email") == 1 for k in range(4)) and found_[len(texts) - 1] == []
    assert "Zebulon" not in pii.sanitise(docs, pii.find_personal_data(docs)).filter("doc_id = 0").first().text
