"""Information-theoretic sanitisation of personal data."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidframe.llm.common import materialise

#: Normal quantile of the confidence bound on how often a term's documents hold an entity; it stands for 95 %.
CONFIDENCE = 1.96
#: Share of an entity's information that a term may give away; beyond it, the term is generalised or removed.
DISCLOSURE = 0.5
#: A term protects an entity if its reader is left with this many candidates or more.
CANDIDATES = 4
#: Terms on each side of an entity that co-occur with it.
WINDOW = 8
#: Different texts in which a term must co-occur with an entity; what one text says may be chance.
LEAST_TEXTS = 2
#: Terms whose documents are counted by name, as a set in every task; where there are more, all words are counted and joined.
NAMED_TERMS = 1_000_000
KINDS = ("email", "ip", "card", "phone")

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_local = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_term = re.compile(r"[^\W\d_]{2,}")


def emails(text: str) -> list[tuple[int, int]]:
    """The email pattern's leftmost matches, found from each ``@`` outward, so that long runs of name characters are read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _local.match(text, start - 1):
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of emails, ips, cards and phones, by start and then in that order of kinds."""
    out = [(s, e, 0) for s, e in emails(text)]
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    for m in _phone.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def entity_of(text: str, span: tuple[int, int, str]) -> str:
    return f"{span[2]}:{text[span[0] : span[1]].lower()}"


def terms_outside(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the text's terms that touch no span."""
    out, covered, k = [], [], 0
    for s, e, _ in sorted(spans):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    for m in _term.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or m.end() <= covered[k][0]:
            out.append((m[0].lower(), *m.span()))
    return out


def pairs_near(text: str, spans: list[tuple[int, int, str]], terms: list[tuple[str, int, int]], window: int) -> set[tuple[str, str]]:
    """(entity, term) of every span with the ``window`` terms before and after it."""
    starts, out = [t[1] for t in terms], set()
    for span in spans:
        at, entity = bisect_left(starts, span[0]), entity_of(text, span)
        after = bisect_left(starts, span[1])
        out.update((entity, t[0]) for t in terms[max(0, at - window) : at] + terms[after : after + window])
    return out


_FOUND = "doc_id long, print long, base array<struct<start:int,end:int,kind:string>>, entities array<string>, terms array<struct<term:string,start:int,end:int>>, near array<struct<entity:string,term:string>>"


def base_findings(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, print (a hash of the text), base spans, the distinct entities in them and, of texts that have any, the terms outside of them and the pairs of entity and term that stand near, of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, entities, all_terms, near = [], [], [], []
            for body in batch.column(2).to_pylist():
                spans = base_spans(body)
                terms = terms_outside(body, spans) if spans else []
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                entities.append(sorted({entity_of(body, x) for x in spans}))
                all_terms.append([dict(zip(("term", "start", "end"), x)) for x in terms])
                near.append([{"entity": e, "term": t} for e, t in sorted(pairs_near(body, spans, terms, window))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, _SPANS), pa.array(entities, pa.list_(pa.string())), pa.array(all_terms, _TERMS), pa.array(near, _NEAR)], names=["doc_id", "print", "base", "entities", "terms", "near"]
            )

    return rows.mapInArrow(find, _FOUND)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_TERMS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))


def term_counts(docs: DataFrame, wanted: DataFrame, text: str = "text", named: int = NAMED_TERMS) -> DataFrame:
    """(term, term_docs): in how many of all documents each term of ``wanted(term)`` stands. Tasks hand on one count per term; up to ``named`` wanted terms are known to every task, beyond that all words are counted and joined with them."""
    known = None
    if wanted.count() <= named:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in wanted.toLocalIterator()))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = known.value if known else None
        for batch in batches:
            found: Counter = Counter()
            for body in batch["text"]:
                if body:
                    words = set(map(str.lower, set(_term.findall(body))))
                    found.update(words if some is None else words & some)
            yield pd.DataFrame(found.items(), columns=["term", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInPandas(spread, "term string, n long").groupBy("term").agg(F.sum("n").alias("term_docs"))
    return counts if known else counts.join(wanted, "term", "left_semi")


def disclosing_terms(
    docs: DataFrame, findings: DataFrame, disclosure: float = DISCLOSURE, text: str = "text", z: float = CONFIDENCE, candidates: float = CANDIDATES, least: int = LEAST_TEXTS, named: int = NAMED_TERMS
) -> DataFrame:
    """(entity, term, together, share): terms that reveal a protected entity beyond the thresholds.

    A term co-occurs with an entity where it is one of the ``WINDOW`` terms next to it, on either side. ``together``
    is the number of different texts in which it does, so copies of one text are no evidence, and must be ``least``
    or more. p(entity | term) is held to be the lower end of Wilson's interval, at the quantile ``z``, of together in
    all documents that hold the term anywhere. Two things are asked of it, whatever the size of the corpus:

    - a reader of the term is left with fewer than ``candidates`` candidates, 1 / p(entity | term). With 4 candidates
      and 95 % these are 2 of 2 documents, 3 of 4, 5 of 9: one document is never enough;
    - it is more than chance: the mutual information of the two, log2(p(entity | term) / p(entity)), is the share
      ``disclosure`` or more of the entity's own, -log2 p(entity). An entity in half of all documents has no such term.

    Pairs near each other are counted by partial sums; the documents' words are counted for terms of these alone.
    """
    pairs = findings.select("print", F.explode("near").alias("pair")).select("print", "pair.*").distinct().groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= least)
    pairs = materialise(pairs, "pairs-near")
    counts = term_counts(docs, pairs.select("term").distinct(), text, named)
    own = findings.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("entity_docs"))
    rows = pairs.join(counts, "term").join(own, "entity")
    total = F.lit(float(max(2, findings.count())))
    n, seen = F.col("term_docs"), F.col("together") / F.col("term_docs")
    sure = (seen + z * z / (2 * n) - z * F.sqrt(seen * (1 - seen) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    own = F.log2(total / F.col("entity_docs"))
    share = F.when(own > 0, F.log2(sure * total / F.col("entity_docs")) / own).otherwise(0.0)
    return rows.withColumn("share", share).filter((sure * candidates > 1) & (F.col("share") >= disclosure)).select("entity", "term", "together", "share")


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, text: str = "text", z: float = CONFIDENCE) -> DataFrame:
    """doc_id, print, base and spans of every document; spans are base spans and, as kind ``term``, the added ones.

    In a document with an entity, every place of a term that ``disclosing_terms`` found to reveal this entity is added.
    A null or empty text has no spans. Repeated rows are handled one by one, though each counts in the statistics; an
    empty table gives an empty result; other columns aren't looked at.
    """
    findings = materialise(base_findings(docs, text), "personal-data")
    risky = materialise(disclosing_terms(docs, findings, disclosure, text, z).select("entity", "term"), "disclosing-terms")
    held = findings.filter("size(entities) > 0").select("doc_id", "print", F.explode("entities").alias("entity")).distinct()
    added = held.join(risky, "entity").groupBy("doc_id", "print").agg(F.collect_set("term").alias("risky"))
    rows = findings.join(added.withColumnRenamed("doc_id", "d").withColumnRenamed("print", "p"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    more = F.transform(F.filter("terms", lambda t: F.array_contains("risky", t["term"])), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("term").alias("kind")))
    more = F.when(F.col("risky").isNotNull(), more).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    order = F.create_map(*[x for k, name in enumerate((*KINDS, "term")) for x in (F.lit(name), F.lit(k))])
    keyed = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return rows.select("doc_id", "print", "base", F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def span_text(spans) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, found: DataFrame, action: str = "generalise", text: str = "text") -> DataFrame:
    """``docs`` with their texts sanitised: spans of ``found`` become ``[KIND]`` (``generalise``) or vanish (``remove``).

    Overlapping spans are replaced as one, named after the first. ``found`` is matched by doc_id, null or not, and the
    text's hash, so rows that repeat a doc_id with another text each get their own spans; a row without any, and a null
    or empty text, stay as they are. All columns of ``docs`` are returned, whatever their names; an empty table gives
    an empty result.
    """
    spans = found.filter("size(spans) > 0").select(F.struct("doc_id", "print").alias("key"), "spans").dropDuplicates(["key"])

    @F.pandas_udf("string")
    def replace(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for body, marks in zip(texts, all_spans):
            if body is not None and marks is not None:
                parts, done = [], 0
                for m in marks:
                    if m["start"] >= done:
                        parts += [body[done : m["start"]], f"[{m['kind'].upper()}]" if action == "generalise" else ""]
                    done = max(done, m["end"])
                body = "".join([*parts, body[done:]])
            out.append(body)
        return pd.Series(out, dtype=object)

    key = F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row")[text]).alias("print"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("own", key).join(spans, F.col("own").eqNullSafe(F.col("key")), "left")
    clean = replace(F.col("row")[text], F.col("spans"))
    return rows.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
