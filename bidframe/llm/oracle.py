"""DuckDB SQL for the corpus queries that SQL can say.

Not here: language ID, token files and alignment (model and tokenizers), fingerprints (XXH64), URL rules (mined), personal data (possessive patterns and corpus statistics), decontamination (hashes of placeholders); the tests hold these against brute force.
"""

from __future__ import annotations

import re

from bidframe.llm.licences import ABBREVIATION, COMMENT, CUT, FORMS, LAST_RULES, LINE, PARAGRAPH, STEMS, TAG, TWO_TAGS, known_sentences, ordered_rules, rule_pattern

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: All pairs that share a shingle are counted, so this is for small tables.
OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sh AS (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_distinct([array_to_string(words[k:k + 4], ' ') FOR k IN range(1, len(words) - 3)]) WHEN len(words) > 0 THEN ['#' || array_to_string(words, ' ')] ELSE [] END) AS s
    FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT a, a FROM edge UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.doc_id AND reach.r < e.b),
part AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(part.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(part.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN part USING (doc_id)
"""

OP3 = """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INT) AS rank, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.n <> q.n
WINDOW w AS (PARTITION BY q.n ORDER BY CAST(list_dot_product(q.x, c.x) AS BIGINT) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 10
"""

OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s),
o AS (
    SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS total, sum(w) OVER () AS w_total,
        sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS w_upto
    FROM r
),
f AS (SELECT *, CAST(total - 3 * (upto - source_size) AS DOUBLE) / CAST(w_total - w_upto + w AS DOUBLE) AS share FROM o),
l AS (SELECT arg_min(share, k) AS level FROM f WHERE share * w <= 3 * source_size),
t AS (SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), level * w), CAST(3 * source_size AS DOUBLE)) AS target FROM f LEFT JOIN l ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
q AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS p FROM p),
e AS (
    SELECT *, CASE WHEN size > 0 THEN 4 * length(bin(size)) + (size * 4) // (CAST(1 AS BIGINT) << (length(bin(size)) - 1)) - 4 ELSE 0 END AS class,
        CAST(CAST('0x' || md5(concat(coalesce(CAST(doc_id AS VARCHAR), '~'), ':17'))[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
    FROM d
),
h AS (SELECT source, class, CAST(count(*) AS DOUBLE) AS held, CAST(sum(size) AS DOUBLE) AS words, CAST(sum(size * size) AS DOUBLE) AS squares, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS k FROM e WHERE class > 0 GROUP BY source, class),
g(source, class, k, n, mean, f, carry) AS (
    SELECT source, 0, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM q
    UNION ALL
    SELECT source, class, k, n, mean, f, wanted - (f * words + f * (1 - f) * (squares / mean - words)) FROM (
        SELECT *, n / held AS f FROM (
            SELECT *, greatest(0.0, least(held, floor(wanted / mean + 0.5))) AS n FROM (
                SELECT h.*, q.p * h.words + g.carry AS wanted, h.words / h.held AS mean
                FROM g JOIN h ON h.source IS NOT DISTINCT FROM g.source AND h.k = g.k + 1 JOIN q ON q.source IS NOT DISTINCT FROM g.source
            )
        )
    )
),
i AS (
    SELECT e.doc_id, e.size, e.source, e.class, e.u, q.source_size, q.target, q.whole, coalesce(g.n, 0) AS n, CASE WHEN g.f > 0 AND g.f < 1 THEN g.f + g.f * (1 - g.f) * (e.size / g.mean - 1) END AS p
    FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source LEFT JOIN g ON e.source IS NOT DISTINCT FROM g.source AND e.class = g.class AND g.class > 0
),
r2 AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY CASE WHEN p IS NULL THEN u ELSE u * (1 - p) / (u * (1 - p) + (1 - u) * p) END, doc_id, size) AS place FROM i)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN place <= n THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r2
"""


def _op9() -> str:
    """Paragraphs, their lines and their joined text are rows here, and each rule is a step of a recursion."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    form = "trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))"
    for pattern, to in FORMS:
        form = f"regexp_replace({form}, {q(_re2(pattern))}, {q(to if '(?=' not in pattern else to + chr(92) + '1')}, 'g')"
    table = ", ".join(f"({q(k)}, {q(v)})" for k, v in known_sentences().items())
    patterns = [(licence, *rule_pattern(names)) for licence, names in ordered_rules()] + [(licence, p, "+") for licence, p in LAST_RULES]
    rules = ", ".join(f"({k}, {q(licence)}, {q(p)}, {q(left.replace('$', chr(92)))})" for k, (licence, p, left) in enumerate(patterns, 1))
    stems = q("|".join(STEMS))
    tags = q("spdx-license-identifier: " + chr(92) + "1") + " || chr(10) || chr(10) || " + q("spdx-license-identifier: " + chr(92) + "2")
    return f"""
WITH RECURSIVE known(s, id) AS (VALUES {table}),
rules(k, licence, pattern, kept) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\r\n?', chr(10), 'g'), {q(TWO_TAGS)}, {tags}, 'g'), {q(COMMENT)}, '', 'g') AS low FROM documents),
c AS (SELECT rid, regexp_replace(regexp_replace(low, {q(TAG)}, 'spdx id ', 'g'), {q(_re2(ABBREVIATION))}, 'v \1', 'g') AS low FROM d WHERE regexp_matches(low, {stems})),
p AS (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT rid, regexp_split_to_array(low, {q(PARAGRAPH)}) AS parts FROM c)),
u AS (
    SELECT rid, pos, 0 AS line, regexp_replace(part, {q(LINE)}, ' ', 'g') AS u FROM p WHERE regexp_matches(part, {stems})
    UNION ALL SELECT rid, pos, generate_subscripts(lines, 1) AS line, unnest(lines) AS u FROM (SELECT rid, pos, regexp_split_to_array(part, {q(LINE)}) AS lines FROM p WHERE regexp_matches(part, {stems}))
),
t AS (SELECT rid, pos, line, generate_subscripts(ss, 1) AS k, unnest(ss) AS s FROM (SELECT rid, pos, line, regexp_split_to_array(u, {q(CUT)}) AS ss FROM u)),
n AS (SELECT rid, pos, line, k, {form} AS s FROM t WHERE regexp_matches(s, {stems})),
i AS (SELECT rid, pos, line, k, id FROM n JOIN known USING (s)),
j AS (
    SELECT * FROM i WHERE line = 0
    UNION ALL
    SELECT rid, pos, min(line), min_by(k, (line, k)), id FROM i WHERE line > 0 AND NOT EXISTS (SELECT 1 FROM i AS w WHERE w.rid = i.rid AND w.pos = i.pos AND w.line = 0 AND w.id = i.id) GROUP BY rid, pos, id
),
g AS (SELECT rid, count(*) AS n_known, string_agg(id, ', ' ORDER BY pos, line, k) AS sequence, '<' || string_agg(id, '><' ORDER BY pos, line, k) || '>' AS line FROM j GROUP BY rid),
m(rid, k, line, licences, hits) AS (
    SELECT rid, 0, line, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM g
    UNION ALL
    SELECT rid, rules.k, regexp_replace(line, pattern, kept, 'g'), CASE WHEN regexp_matches(line, pattern) AND NOT list_contains(licences, licence) THEN list_append(licences, licence) ELSE licences END,
        CASE WHEN regexp_matches(line, pattern) THEN list_append(hits, CAST(rules.k AS VARCHAR)) ELSE hits END
    FROM m JOIN rules ON rules.k = m.k + 1
),
r AS (SELECT rid, array_to_string(licences, ' AND ') AS licence, array_to_string(hits, ',') AS rule FROM m WHERE k = (SELECT max(k) FROM rules))
SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(sequence, '') AS sequence, nullif(licence, '') AS licence, nullif(rule, '') AS rule FROM d LEFT JOIN g USING (rid) LEFT JOIN r USING (rid)
"""


def _re2(pattern: str) -> str:
    """A pattern's lookahead at its end as a group, which the replacement then writes back."""
    return re.sub(r"\(\?=(.*)\)$", r"(\1)", pattern)


#: The CRC's table follows from its polynomial; bytes are read from the text's hexadecimal form.
OP10 = """
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
    SELECT doc_id, CAST(bytes + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h[2 * k - 1:2 * k] AS BIGINT) FOR k IN range(1, bytes + 1)]), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32,
        CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '~'))[1:4] AS INT) AS part
    FROM d, crc
),
j(id, n, key, b, j) AS (
    SELECT DISTINCT doc_id, n, CAST(doc_id AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents, (VALUES (16), (17)) t(n)
    UNION ALL
    SELECT id, n, (key * 2862933555777941757 + 1) % 18446744073709551616, j, CAST(floor((j + 1) * (2147483648.0 / (CAST(((key * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 AS DOUBLE) + 1.0))) AS BIGINT) FROM j WHERE j < n
),
e AS (SELECT id, n, CAST(b AS INT) AS shard FROM j WHERE j >= n)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY part, s.doc_id, s.size, s.text_crc32) - 1 AS slot, g.shard AS grown_shard
FROM s JOIN e a ON a.id = s.doc_id AND a.n = 16 JOIN e g ON g.id = s.doc_id AND g.n = 17
"""

#: Every prefix is a list of all its turns, and every subtree a join of lists, so this is for small tables.
OP13 = """
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (
    SELECT conv_id, turns, conv_id - conv_id % 5 AS donor,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1])), CAST(4294967295 AS BIGINT)) % 9 AS h
    FROM own, crc
),
c AS (SELECT h.conv_id, list_concat(coalesce(d.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own d ON d.conv_id = h.donor),
p AS (SELECT conv_id, len(turns) AS n, CAST(d AS BIGINT) AS depth, turns[1:d] AS prefix FROM c, range(0, len(turns) + 1) t(d)),
node AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
        (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(coalesce(prefix[depth].text, ''))) END AS own_saved
    FROM p GROUP BY prefix, depth
),
kid AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid USING (prefix)),
sub AS (SELECT u.prefix[1:d] AS prefix, sum(u.own_saved) AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves FROM full_node u, range(0, u.depth + 1) t(d) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sub s USING (prefix) LEFT JOIN full_node q ON f.depth > 0 AND q.prefix = f.prefix[1:f.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2, "op3_top_k": OP3, "op5_mix_sources": OP5, "op9_licence_scan": _op9(), "op10_shards": OP10, "op13_conversation_trie": OP13}
