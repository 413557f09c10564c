"""Decontamination: placeholders against a plain reading, scripts other than Latin, and re-parameterised items among fillers."""

import random
import re

import numpy as np
import pytest

from bidframe.llm import decontam
from bidframe.llm.words import text_blocks

SCHEMA = "doc_id long, text string, window int, id int, at int, slots string, form int"


def plain_kinds(text):
    """(lower-cased word, kind, whether it is a name that opens a sentence) as ``templates`` defines them, word by word."""
    found = []
    opens = True
    for m in re.finditer(r"(\s*)(\S+)", text):
        if "\n" in m[1]:
            opens = True
        raw = m[2]
        lead = re.match(r"[^\w]*|_*", raw)[0]
        if any(c in ".!?:|" for c in lead):
            opens = True
        word = "".join(c for c in raw if c.isalnum())
        if word:
            capitals = sum(c.lower() != c and len(c.lower()) == 1 for c in word)
            name = len(word) > 1 and word[0].lower() != word[0] and capitals == 1
            number = any(c in "0123456789" for c in word)
            low = word.lower()
            kind = decontam.NUMBER if number else decontam.NAME if name and not opens else 0
            if not kind and found and found[-1][1] == decontam.NUMBER and low in {u.replace("/", "") for u in decontam.UNITS}:
                kind = decontam.UNIT
            found.append((low, kind, name and opens and not number))
            tail = raw[max(k for k, c in enumerate(raw) if c.isalnum()) + 1 :]
            opens = any(c in ".!?:|" for c in tail)
    return found


def block(texts):
    import pyarrow as pa

    for _, _, data, offsets in text_blocks(pa.array(texts)):
        yield data, offsets


@pytest.mark.parametrize("text", [
    "A train leaves Paris at 9. Maria pays 35 euros, and Tom 1 200 km! The END", "Η Μαρία πήγε στην Αθήνα με 12 km", "Мария заплатила 35 рублей. Иван Петров ждёт Анну", "“Hello” said Ann: Bob ran 5 km", "", " \n ", "x1 2y Zz ZZ Zürich ÉCOLE École été",
])
def test_words_and_kinds(text):
    (data, offsets), = block([text]) if text else [(np.zeros(0, np.uint8), np.zeros(2, np.int64))]
    hashes, kind, first, opener = decontam.templates(data, offsets)
    want = plain_kinds(text)
    assert kind.tolist() == [k for _, k, _ in want] and opener.tolist() == [o for *_, o in want] and first.tolist() == [0, len(want)]
    assert hashes.tolist() == [decontam._raw_hash(w) for w, _, _ in want]


FILL = "alpha beta gamma delta omega sigma kappa lambda theta iota zeta eta rho tau phi chi psi".split()
NAMES = ["Tom", "Mary Ann", "Otto", "Peter Jones", "Zoë", "Ivan Petrov Junior", "Анна", "Ελένη Παππά"]
AMOUNTS = ["7", "1 200", "35", "12 000", "9 euros", "4 km", "88 hours", "3,500 kg"]


def write(template, draw):
    names, amounts = draw.sample(NAMES, 3), draw.sample(AMOUNTS, 3)
    return template.format(a=names[0], b=names[1], c=names[2], x=amounts[0], y=amounts[1], z=amounts[2])


def test_reparameterised_items_among_fillers(spark):
    """Every document that holds an item with other names, numbers and units, at any place, and no other."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("bcdfgklmnprst", k=3)) + draw.choice("aeiou") + draw.choice("xyz")
    templates = []
    for _ in range(12):
        lit = [word() for _ in range(26)]
        templates.append(" ".join([*lit[:6], "{a}", *lit[6:11], "{x}", *lit[11:16], "{b}", *lit[16:21], "{y}", *lit[21:], "and", "{a}"]))
    items = [(k, write(t, draw)) for k, t in enumerate(templates)]
    filler = lambda n: " ".join(draw.choices(FILL, k=n))
    docs, want = [], set()
    for k in range(120):
        if k % 3 == 0:
            docs.append((k, filler(80)))
        else:
            t = draw.randrange(len(templates))
            docs.append((k, f"{filler(draw.randrange(40))} {write(templates[t], draw)} {filler(draw.randrange(40))}"))
            want.add((k, t))
    docs += [(500, f"{filler(9)} {templates[0].split('{b}')[0].format(a='Tom', x='7')} {filler(30)}")]  # less than half of an item
    rows = [(i, t, 1, 2, 3, "s", 4) for i, t in docs] + [(None, items[0][1], 1, 2, 3, "s", 4), (1, items[5][1], 1, 2, 3, "s", 4), (3, "x " * 200_000, 1, 2, 3, "s", 4)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, window string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert got == want | {(1, 5), (None, 0)}


def test_slots_must_agree(spark):
    """One value for one value: a name that stands twice in an item must be replaced by one name."""
    lit = [f"w{chr(97 + k)}" for k in range(24)]
    item = " ".join(["go", *lit[:4], "Maria", *lit[4:7], "Maria", *lit[7:10]])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("Maria", "Klaus")), (2, item.replace("Maria", "Klaus", 1).replace("Maria", "Petra"))], "doc_id long, text string")
    got = {r.doc_id: r.coverage for r in decontam.contaminated(docs, bench, 0.01).collect()}
    assert got[1] == 1.0 and got.get(2, 0.0) < 0.5


def test_documents_without_an_id(spark):
    """A text without a doc_id that holds an item goes, whatever else has none; document 0 isn't mistaken for it."""
    item = "what is the sum of the first seven odd numbers that the teacher wrote on the board"
    rows = [(None, f"before {item} after", "a"), (None, "nothing of the kind is said in this text at all", "b"), (None, None, "c"), (0, "also a plain text", "d"), (3, f"so {item}", "e"), (3, "its other row", "f"), (None, f"before {item} after", "g")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row string, doc int, text_key int")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).fillna(-1, ["doc_id"]).collect()) == [(-1, 9), (3, 9)]
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.row for r in kept.collect()} == {"b", "c", "d"}
