"""Queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from . import chat, chunk_dedup, collocations, decontamination, html_text, jaccard_join, language, quality, segmentation, spelling, suffix_dedup, topk_search, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1,
        "op2_chat_formatting": chat.op2,
        "op3_ngram_jaccard_join": jaccard_join.op3,
        "op4_warc": warc.op4,
        "op5_decontamination": decontamination.op5,
        "op6_html_extraction": html_text.op6,
        "op7_language_id": language.op7,
        "op8_sentencepiece": segmentation.op8,
        "op9_quality_rules": quality.op9,
        "op10_chunk_dedup": chunk_dedup.op10,
        "op11_topk_search": topk_search.op11,
        "op12_spelling_variants": spelling.op12,
        "op13_collocations": collocations.op13,
    }


_OP1 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS k FROM d, unnest(generate_series(0, length(h) // 2 - 100)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
p AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM s GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
_OP2 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c(control) AS (VALUES ('<<SYS>>'), ('<</SYS>>'), ('<s>'), ('</s>'), ('[INST]'), ('[/INST]'), ('[ANSWER]'), ('[ROLE]'), ('[/ROLE]'), ('[/TURN]')),
m(role, around) AS (VALUES ('system', length('<<SYS>> ' || ' <</SYS>>')), ('user', length('<s>[INST] ' || ' [/INST]')), ('assistant', length('[ANSWER] ' || ' </s>'))),
x AS (SELECT t.*, m.role IS NOT NULL AS known, length(text) + length(text) - length(replace(text, chr(9243), ''))
             + 2 * (SELECT sum((length(t.text) - length(replace(t.text, control, ''))) // length(control)) FROM c)
             + coalesce(around, length('[ROLE] ' || ' [/ROLE] ' || ' [/TURN]') + length(t.role) + length(t.role) - length(replace(t.role, chr(9243), ''))
                                + 2 * (SELECT sum((length(t.role) - length(replace(t.role, control, ''))) // length(control)) FROM c)) AS size FROM t LEFT JOIN m USING (role))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       bool_and(known) AND regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system )?user assistant( user assistant)*') AS valid
FROM x GROUP BY conv_id
"""
_OP4 = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.digest = m.digest AND n >= 1000
"""
_OP3 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
    FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT node, min(other) AS low FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""
_OP5 = r"""
WITH lowered AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
    SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM b, unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) AS u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS u(i)),
hits AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

_OP11 = r"""
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
#: The CRC goes bit by bit over the UTF-8 bytes; all code points are below 256.
_OP12 = r"""
WITH RECURSIVE d AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM d GROUP BY id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h FROM c),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(generate_series(1, length(word))) AS u(i)),
near AS (
    SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION SELECT less.word, v.word FROM less JOIN v ON v.word = rest
    UNION SELECT v.word, less.word FROM less JOIN v ON v.word = rest),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-m.n, b)) AS b, max(m.n) AS m FROM near JOIN v m ON m.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f g ON g.word = walk.root WHERE g.form IS NULL
"""
_OP13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + k.k - 1] AS p, k.k AS k FROM w, unnest(generate_series(1, len(w))) AS u(i), range(1, 6) k(k) WHERE i + k.k - 1 <= len(w)),
f AS (SELECT lang, array_to_string(p, ' ') AS phrase, any_value(p) AS p, k, count(*) AS f FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
held AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k AND 100 * y.f >= 100 * x.f AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, i, l.f AS l, r.f AS r, n, 1000::HUGEINT * c.f * n // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT * FROM c ANTI JOIN held USING (lang, phrase)) c, unnest(generate_series(1, k - 1)) AS u(i) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.p[1:i], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.p[i + 1:], ' ') JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def _op9() -> str:
    """The counts by lists of words and lines, and expectation-maximisation as a recursion over
    rows of shares: (round, share of good, shares of the votes of each rule)."""
    rules = list(quality.RULES.values())
    number = lambda characters: f"length(t) - length(translate(t, '{characters}', ''))"
    cast = ", ".join(f"CASE WHEN {reject} THEN 1 WHEN {keep or 'false'} THEN 3 ELSE 2 END" for reject, keep in rules)
    start = {c: "[" + ", ".join(f"[{', '.join(f'{x}::DOUBLE' for x in quality.START[c])}]" for _ in rules) + "]" for c in quality.START}
    odds = f"ln(good / (1 - good)) + list_sum(list_transform(range(1, {len(rules) + 1}), lambda r: ln(gs[r][v[r]] / bs[r][v[r]])))"
    weight = quality.PRIOR_WEIGHT

    def shares(c: str, w: str) -> str:
        rows = []
        for r in range(1, len(rules) + 1):
            mass = [f"({weight * quality.START[c][j]}::DOUBLE + coalesce(sum({w}) FILTER (v[{r}] = {j + 1}), 0))" for j in range(3)]
            rows.append(f"[{', '.join(f'{m} / ({weight} + sum({w}))' for m in mass)}]")
        return f"[{', '.join(rows)}]"

    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(generate_series(1, len(w) - 4)) AS u(i)),
p AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g), range(5) k(k) WHERE times > 1 GROUP BY 1),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, {number('#*$%&|<>')} AS n_symbols, {number('0123456789')} AS n_digits, {number('.!?')} AS n_stops,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
votes AS (SELECT *, [{cast}] AS v FROM c),
patterns AS (SELECT v, count(*) AS n FROM votes GROUP BY v),
em AS (
    SELECT 0 AS round, {quality.START_GOOD}::DOUBLE AS good, {start['bad']} AS bs, {start['good']} AS gs
    UNION ALL
    SELECT round + 1, least(0.99, greatest(0.01, (sum(n * p) + {weight * quality.START_GOOD}) / (sum(n) + {weight}))), {shares('bad', 'n * (1 - p)')}, {shares('good', 'n * p')}
    FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM em, patterns WHERE round < {quality.ROUNDS}) GROUP BY round)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND p >= 0.5 AS kept, round(p, 4) AS p_good
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed, 1 / (1 + exp(-({odds}))) AS p FROM votes, (SELECT good, bs, gs FROM em WHERE round = {quality.ROUNDS}))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": _OP1,
        "op2_chat_formatting": _OP2,
        "op3_ngram_jaccard_join": _OP3,
        "op4_warc": _OP4,
        "op5_decontamination": _OP5,
        "op9_quality_rules": _op9(),
        "op11_topk_search": _OP11,
        "op12_spelling_variants": _OP12,
        "op13_collocations": _OP13,
    }
