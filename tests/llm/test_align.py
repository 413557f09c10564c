"""Token alignment against a plain version of whole texts, and the aligner on odd texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from bidframe.llm import align

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(tools, text):
    """(ids of A, ids of B, groups, links) of a whole text, every pair of tokens compared; None without tokens."""
    if not text:
        return None
    a, b = tools
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    back = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    back |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(back.values()))}
    of_a = [bytes(back[c] for c in a.id_to_token(k)) for k in ids_a]
    of_b = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return None
    sa, sb = spans(of_a), spans(of_b)
    groups, ends = [], sorted({e for _, e in sa} & {e for _, e in sb})
    for low, high in zip([0, *ends], ends):
        groups.append(",".join(str(k) for k, (x, y) in zip(ids_a, sa) if low <= x and y <= high) + "|" + ",".join(str(k) for k, (x, y) in zip(ids_b, sb) if low <= x and y <= high))
    links = [(k, m) for k, (x, y) in zip(ids_a, sa) for m, (u, v) in zip(ids_b, sb) if x < v and u < y]
    return ids_a, ids_b, groups, links


def brute(tools, rows):
    found = [(doc, plain(tools, text)) for doc, text in rows]
    counts = Counter(p for _, got in found if got for p in set(got[3]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for doc, got in found:
        if got is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            ids_a, ids_b, groups, links = got
            out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "two  spaces"), (6, "tab\there"), (7, " leads"), (8, "trails "), (9, "line\nfeed\n"), (9, "line\nfeed\n"), (10, "▁ mark"), (11, "x▁y z"), (12, "日本語 テキスト。"), (13, "<|endoftext|> <s> <0x0A> </s>"), (None, "null id"),
    (14, "é́ combining̈ ́x"), (15, "🙂🙃 emoji👩‍👩‍👧 ok"), (16, "a\r\nb"), (17, "\n"), (18, "don't can't, I'll! (word) 12,345.67 a_b"), (19, "wörter. naïve, Straße; ΑΒΓ: АБВ!"), (20, "nul\x00byte"), (21, "nb sp"), (22, "  sep"), (9, "other text of nine"),
]


def rows_of(got):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()), key=str)


@pytest.mark.parametrize("most", [align.BROADCAST_PAIRS, 0])
def test_against_brute_force(spark, tools, most):
    """Odd texts and whole given documents; both ways to look counts up."""
    given = [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").collect()]
    rows = ODD + given
    docs = spark.createDataFrame([(a, b, 1, 2, "r") for a, b in rows], "doc_id long, text string, n long, a int, row string").repartition(5)
    got = rows_of(align.align_tokenizers(docs, *PATHS, broadcast_pairs=most))
    assert got == brute(tools, rows)
    assert align.align_tokenizers(docs.limit(0), *PATHS, broadcast_pairs=most).count() == 0


def test_pieces_are_whole_texts(tools):
    """Piece by piece equals whole texts, also where the store is too small."""
    draw = random.Random(3)
    parts = ["Wort", "don't", "it's.", "x1.", "é!", "naïve,", "$$$", "a%%%", "word...", "(word)", "12,50", "日本。", "ΑΒΓ.", ".", "<s>", "_x_", "'s", "a'", "𝒳!", "ﬁ", "ß?"]
    texts = [draw.choice([" ", "\n"]).join(draw.choices(parts, k=30)) + draw.choice(["", "\n" + draw.choice(parts)]) for _ in range(150)]
    for stored in (10**6, 40, 0):
        known = align.Aligner(*PATHS, stored=stored)
        assert known.by_piece
        for k in range(0, len(texts), 50):
            for text, row in zip(texts[k : k + 50], known.read(texts[k : k + 50])):
                want = plain(tools, text)
                assert len(row) > 1 and known.sizes[row].sum(axis=0).tolist() == [len(want[0]), len(want[1]), len(want[2])]
                assert ";".join(known.groups[p] for p in row) == ";".join(want[2])
                codes = [(a << 32) + b for a, b in want[3]]
                assert sorted(known.links(np.array(row)).tolist()) == sorted(codes)


def test_groups():
    assert align.common_ends([1, 3, 6], [2, 3, 4, 6]) == ([1, 2], [1, 3])
    got = align.group_links(*map(np.array, ([1, 2], [7, 8], [1, 4], [3, 4])))
    assert [(c >> 32, c & 0xFFFFFFFF) for c in got.tolist()] == [(1, 7), (2, 7), (2, 8)]
