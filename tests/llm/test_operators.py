"""The corpus operators against brute force, and on odd input."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bidframe.llm import decontam, langid, licences, mixing, neardup, pii, queries, sharding, tokens, topk, urlfilter
from bidframe.llm.words import shingle_sets, split_words, text_blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, rank int, bands int, bucket int, size int, spans int, base int, print int, score double"
#: Nulls in any column, empty and long texts, ties, repeated rows; columns whose names the operators use themselves.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, "one two", "en", "a", 7), (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7),
    (6, "x" * 300_000, "fr", "b", 300_000), (7, "word " * 40_000, None, "b", 200_000), (None, "no id here at all, none", "en", "a", 5), (None, None, None, None, None), (9, "a@b.co 1.2.3.4 +1 (123) 456-7890", "en", "z", 1), (10, "日本語 テキスト", "en", "z", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8, 0.5) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_brute_force(documents):
    want = brute_groups([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents).collect()}
    assert got == want


def test_near_duplicates_chains_and_crowds(spark):
    """A chain of texts of which only neighbours are alike, a crowd of variants of one text, and a passage shared by unlike texts."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(200)]
    rows = []
    chain = list(base)
    for k in range(12):
        rows.append((1000 - k, " ".join(chain)))
        chain = chain[12:] + [word() for _ in range(12)]
    crowd = [word() for _ in range(150)]
    for k in range(120):
        text = list(crowd)
        for at in rng.choice(150, 4, replace=False):
            text[at] = word()
        rows.append((2000 + k, " ".join(text)))
    passage = [word() for _ in range(60)]
    for k in range(120):
        rows.append((3000 + k, " ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(40))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_near_duplicates_odd(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] * 2
    assert all(c is None and k for _, c, k in by[None])
    assert neardup.near_duplicates(none).count() == 0


def test_shingles_equal_plain_sets():
    import pyarrow as pa

    texts = ["A b  C\nd e f", "a B c d E F", "", None, "é É x", "one", "one two one two one two one two"]
    for first, last, data, offsets in text_blocks(pa.array(texts)):
        values, starts = shingle_sets(split_words(data, offsets))
        got = [set(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:])]
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert got[0] == got[1]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r.node: r.component for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_language_held_out(documents):
    got = langid.identify_documents(documents).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_uses_only_text(spark, documents):
    """Predictions don't change when held-out labels, sources and ids do."""
    base = {r.doc_id: r.lang_pred for r in langid.identify_documents(documents).collect()}
    moved = documents.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {r.doc_id: r.lang_pred for r in langid.identify_documents(moved).collect()} == base


def test_language_odd(odd, none):
    got = {r.doc_id: r for r in langid.identify_documents(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[10].lang_pred in ("en", "fr")
    assert langid.identify_documents(none).count() == 0
    assert {r.lang_pred for r in langid.identify_documents(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_top(vectors, k=10):
    rows = {i: [math.floor(1024 * float(x)) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in rows.items():
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows.items() if i != q and len(y) == len(x)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.normal(size=16) * rng.choice([0.01, 0.5, 1, 1, 3])).astype(np.float32).tolist() for i in range(900)}
    vectors |= {i: vectors[50] for i in range(901, 930)}
    vectors |= {1000: None, 1001: [float("nan")] * 16, 1002: [None] * 16, 1100: [float("inf")] * 16, 1200: [0.0] * 16, 1300: [1.0, 2.0], 1301: [0.5, 0.5]}
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(vectors)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_prunes_and_stays_exact():
    """Many buckets with high local thresholds, in one block."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=24)
    vectors = np.floor(1024 * (centre + 0.2 * rng.normal(size=(5000, 24))) * rng.choice([0.2, 0.6, 1.0, 1.4], 5000)[:, None])
    vectors[2500:] = np.floor(300 * rng.normal(size=(2500, 24)))
    ids = rng.permutation(5000)
    got = list(zip(*(x.tolist() for x in topk.search_block(ids[:40], vectors[:40], ids, vectors, 10))))
    products = (vectors[:40] @ vectors.T).astype(np.int64)
    for q in range(40):
        want = sorted((-int(products[q, j]), int(ids[j])) for j in range(5000) if ids[j] != ids[q])[:10]
        assert [(-s, i) for _, i, s in got[10 * q : 10 * q + 10]] == want


def test_decontamination_planted(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    clean = lambda s: [re.sub(r"[^\w]", "", w).lower() for w in s.split()]
    items = {r.item_id: " ".join(clean(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in documents.select("doc_id", "text").collect() for i, t in items.items() if f" {t} " in f" {' '.join(clean(r.text))} "}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(documents, bench).collect()}
    assert want and got == want


def test_decontamination_templates(spark):
    bench = spark.createDataFrame([
        (1, "A train leaves the station with 120 passengers at 9 and Maria pays 35 euros for the ticket while Maria waits near the old bridge"), (2, "What is the capital"), (3, "12 34 56"), (4, None), (None, "some text that has no item id at all here"),
    ], "item_id long, text string")
    said = "we read: a train leaves the station with 77 passengers at 8 and Petra pays 12 dollars for the ticket while {} waits near the old bridge. The end"
    docs = spark.createDataFrame([
        (1, said.format("Petra"), 0), (2, said.format("Klaus"), 0), (3, "tell me, what is the capital of it", 0), (4, "a train leaves the town", 0), (5, None, 0), (6, "", 0), (7, "1 2 3", 0), (1, said.format("Petra"), 0), (None, said, 0),
    ], "doc_id long, text string, window int")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 2)}
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(docs, bench, 0.9).collect()) == [0, 2, 4, 5, 6, 7]


def test_decontamination_shifted(spark):
    """Words put in or left out, and slots whose number of words changes, split the match over shifts; it is still one."""
    literal = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    plain, slots = literal[:38], "the {} that {} saw at the {} had {} red and blue stones for him while {} sang"
    bench = spark.createDataFrame([(1, " ".join(plain)), (2, "so " + slots.format("12", "Tom", "bridge", "7", "Tom"))], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, " ".join(literal[50:] + plain[:19] + ["new"] + plain[19:])), (2, " ".join(plain[:18] + plain[19:])), (3, "so " + slots.format("1 200", "Mary Ann", "bridge", "30 000", "Mary Ann")),
        (4, "so " + slots.format("1 200", "Mary Ann", "bridge", "30 000", "Otto Karl")), (5, " ".join(plain[:19] + literal[38:] * 3 + plain[19:])), (6, " ".join(plain[:20])),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.contaminated(docs, bench).collect()}
    assert got[1, 1] == pytest.approx(24 / 31) and (2, 1) in got and got[3, 2] == 1.0
    assert set(got) == {(1, 1), (2, 1), (3, 2)}


def brute_mix(rows, weights=(1, 2, 3), most=3, seed=17):
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(total.values()))
    while free:
        share = left / sum(w[s] for s in free)
        stop = {s for s in free if share * w[s] > most * total[s]}
        for s in stop or free:
            target[s] = most * total[s] if stop else share * w[s]
        left -= sum(target[s] for s in stop)
        free -= stop or free
    return sizes, total, target


def test_mixing(documents, spark):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()] + [(-1, "lone words here", None), (-2, None, "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, total, target = brute_mix(rows)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == total[r.source] and math.isclose(r.target, target[r.source]) and r.taken == r.copies * r["size"] and r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= max(largest[s] / 2 + 1, 0.02 * target[s]) for s in target)
    again = mixing.mix_sources(df.orderBy(F.desc("doc_id"))).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_targets_stop(spark):
    rows = [(k, "w " * 5, "a") for k in range(4)] + [(10 + k, "w " * 500, "b") for k in range(40)] + [(100, "w " * 3, "c")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.target for r in got if r.source == "a"} == {60.0} and {r.copies for r in got if r.source == "c"} == {3}
    assert sum(r.target for r in {r.source: r for r in got}.values()) == pytest.approx(20 + 20000 + 3)


def test_mixing_odd(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(none).count() == 0


def plain_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(documents):
    rows = [(r.doc_id, r.text) for r in documents.filter("doc_id % 3 = 0").collect()]
    path = public_tokenizers.path("byte_bpe_50k.json")
    for planes in ("byte", "bit"):
        got = tokens.tokenise_documents(documents.filter("doc_id % 3 = 0"), path, planes=planes).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == plain_ids(rows)


def test_token_files_odd(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = plain_ids([(r[0], r[1]) for r in ODD])
    got = [tuple(r) for r in tokens.tokenise_documents(odd, path).orderBy("start").collect()]
    assert got == want
    assert tokens.tokenise_documents(none, path).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n\nb c", "a\nb c d", "x\t y", "a\u00a0b c", "it's <|endoftext|> 12 3", "\x1c a", "é à\n ü", "a\r\nb", "…  ", "w " * 50 + "end"])
def test_pieces_encode_as_whole(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = np.frombuffer(tokens.PieceEncoder(path).encode(text), dtype="<u4")
    assert got.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 2**32, 1001, dtype=np.uint32)
    for planes, n in (("byte", 4), ("bit", 32)):
        parts = tokens.to_planes(ids, planes)
        assert len(parts) == n and (tokens.from_planes(parts, len(ids), planes) == ids).all()


def test_url_parts_and_given_rules(spark):
    rows = [
        (1, "https://Sub.Example.COM/en/7x?q=1#f", "sub.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"), (3, "x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"),
        (4, "x://q.example.net/de/81", "q.example.net", "/de/81", "example.net/de/8", "block"), (5, "ftp://c.org/es/?a", "c.org", "/es/", "org/es/", "block"), (6, "no scheme", "", "", None, "allow"), (7, None, "", "", None, "allow"),
        (8, "http://com/en/x", "com", "/en/x", "com/en/", "block"), (9, "http://xcom/en/x", "xcom", "/en/x", None, "allow"), (10, "http://a.com?x=/en/", "a.com", "", None, "allow"), (11, "http://É.org#a://b", "É.org", "", None, "allow"), (7, None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "t") for r in rows], "page_id long, url string, tokens string")
    got = urlfilter.filter_urls(pages, pages.selectExpr("url", "true AS bad").limit(0)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.rule) == sorted((r[0], *r[2:]) for r in rows if r[4])
    assert sorted((r.page_id, r.host, r.path, r.verdict) for r in got) == sorted((r[0], r[2], r[3], r[5]) for r in rows)
    assert urlfilter.filter_urls(pages.limit(0), pages.selectExpr("url", "true AS bad").limit(0)).count() == 0


def test_url_rules_brute_force(spark):
    rng = np.random.default_rng(4)
    urls = [f"http://{h}.example.org/{p}/{n}.html?utm={n}" for n, (h, p) in enumerate(zip(rng.choice(["spam", "good", "news"], 600), rng.choice(["win", "read"], 600)))]
    rows = [(u, bool(("spam" in u and "win" in u) or rng.random() < 0.1)) for u in urls]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    lift = 0.6 / (sum(b for _, b in rows) / len(rows))
    found = {tuple(r.tokens): (r.confidence, r.support) for r in urlfilter.mine_rules(df, 0.05, lift).collect()}
    token = {r.url: set(r.t) for r in df.select("url", urlfilter.url_tokens(F.col("url")).alias("t")).collect()}
    import itertools

    want = {}
    every = sorted(set().union(*token.values()))
    for n in (1, 2, 3):
        for combo in itertools.combinations(every, n):
            hit = [b for u, b in rows if token[u].issuperset(combo)]
            if sum(hit) >= 0.05 * len(rows) and sum(hit) / len(hit) >= 0.6 and not any(set(c) < set(combo) and want[c][0] >= sum(hit) / len(hit) for c in want):
                want[combo] = (sum(hit) / len(hit), sum(hit) / len(rows))
    short = {k: v for k, v in found.items() if len(k) <= 3}
    assert want and short.keys() == want.keys() and all(short[k] == pytest.approx(want[k]) for k in want)
    blocked = {r.url for r in urlfilter.match_rules(df, urlfilter.mine_rules(df, 0.05, lift)).collect()}
    assert blocked == {u for u in urls if any(token[u].issuperset(c) for c in found)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), 0) for m in EMAIL.finditer(text)]
    out += [(*m.span(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return [(s, e, pii.KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def test_personal_data_base(documents):
    texts = [r.text for r in documents.select("text").collect()]
    texts += ["a@b.c@d.ef", "@x.y", "a@b", "..@a.b-", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.004", "4111 1111 1111 1111-", "+1 (234) 567-8901x", "+1+2 345 678 901 2", "12" * 5000, "a" * 5000 + "@b.c", "x@y..z @", "1.1.1.1@a.b", "é@a.fr ü1.2.3.4"]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(list("ab1.@-+ ()"), 60)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data_terms(spark):
    """A word that always stands beside one address gives it away; common words don't."""
    rows = [(k, f"the note of Zebulon for zeb@home.org and the rest {k}") for k in range(5)] + [(10 + k, f"the note of others and the rest {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(df).orderBy("doc_id").collect()
    at = rows[0][1].index("Zebulon")
    for r in found[:5]:
        kinds = [(s.start, s.end, s.kind) for s in r.spans]
        assert (at, at + 7, "term") in kinds and any(k == "email" for *_, k in kinds)
        assert not any(rows[0][1][s:e] in ("the", "note", "of", "and") for s, e, k in kinds if k == "term")
    assert not any(r.spans for r in found[5:])
    out = pii.sanitise(df, pii.find_personal_data(df)).filter("doc_id = 0").first()
    assert "[EMAIL]" in out.text and "[TERM]" in out.text and "Zebulon" not in out.text


def test_personal_data_odd(odd, none):
    got = {r.doc_id: r for r in pii.find_personal_data(odd).collect()}
    assert [s.kind for s in got[9].base] == ["email", "ip", "phone"] and got[1].base == [] and pii.find_personal_data(none).count() == 0
    assert pii.find_personal_data(odd).count() == len(ODD)


def test_licences_odd(odd, none):
    got = licences.licence_scan(odd).collect()
    assert len(got) == len(ODD) and all(r.n_known == 0 and r.sequence == "" and r.licence is None for r in got)
    assert licences.licence_scan(none).count() == 0


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 100):
        assert sharding.jump_hash(keys.copy(), n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards(documents, odd, none):
    got = sharding.assign_shards(documents).collect()
    slots = defaultdict(list)
    text = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.shard == plain_jump(r.doc_id, 16) and r.grown_shard in (r.shard, 16) and r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == len(ODD) and sharding.assign_shards(none).count() == 0
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 1} == {(1, 0)}


def test_query_digests(spark, sf_dir):
    got = queries.op8_personal_data(spark, sf_dir).first()
    assert len(got.base_sha256) == 64 and got.base_sha256 == got.base_sha256.lower()
    empty = [r for r in queries.op8_personal_data(spark, sf_dir).collect() if r.n_email + r.n_ip + r.n_card + r.n_phone == 0]
    assert empty[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert json.dumps(sorted(queries.queries())) and len(queries.queries()) == 13
