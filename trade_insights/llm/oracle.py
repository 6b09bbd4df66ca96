"""DuckDB twins of the registered queries of this subpackage that SQL can
express, over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

TOPK = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20"""

def _rest_equal(t: str, p: str) -> str:
    """Number of tokens after the third that are the pattern's."""
    return f"len(list_filter(list_zip({t}[4:], {p}[4:]), lambda z: z[1] = z[2] AND z[1] <> '<*>'))"


def _equal(t: str, p: str) -> str:
    return f"len(list_filter(list_zip({t}, {p}), lambda z: z[1] = z[2] AND z[1] <> '<*>'))"


def _alike(t: str, p: str) -> str:
    """Whether a line belongs to a further template of its leaf."""
    rest = _rest_equal(t, p)
    return f"({rest} >= 0.6 * (len({t}) - 3) OR ({t} = {p} AND {rest} > 0)) AND {_equal(t, p)} >= 0.6 * len({t})"


LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
raw AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
lines AS (SELECT doc_id, pos, line, list_transform({WORDS.format("line")}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM raw),
leaves AS (SELECT *, row(len(t), t[1], coalesce(t[2], ''), coalesce(t[3], '')) AS leaf FROM lines WHERE len(t) > 3 OR len(list_filter(t, lambda x: x <> '<*>')) > 0),
common AS (SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT l.* FROM leaves l SEMI JOIN common USING (leaf)),
tok AS (SELECT leaf, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM c),
n AS (SELECT leaf, i, x, count(*) AS n FROM tok GROUP BY ALL),
top AS (SELECT *, sum(n) OVER (PARTITION BY leaf, i) AS total, row_number() OVER (PARTITION BY leaf, i ORDER BY n DESC, x DESC) AS r FROM n),
template AS (SELECT leaf, list(CASE WHEN n >= 0.8 * total THEN x ELSE '<*>' END ORDER BY i) AS template FROM top WHERE r = 1 GROUP BY leaf),
main AS (SELECT doc_id, pos, leaf FROM c JOIN template USING (leaf)
    WHERE len(t) <= 3 OR ({_equal("t", "template")} >= 0.6 * len(t) AND {_rest_equal("t", "template")} > 0)),
often AS (SELECT leaf FROM main GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
kind AS (SELECT leaf, t, count(*) AS n FROM c WHERE len(t) > 3 GROUP BY ALL),
spot AS (SELECT leaf, t, n, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM kind),
pattern AS (SELECT leaf, t, any_value(a.n) AS n, list(CASE WHEN i <= 3 OR coalesce(o.n, 0) >= 10 THEN x ELSE '<*>' END ORDER BY i) AS p, sum((i > 3 AND x <> '<*>' AND coalesce(o.n, 0) >= 10)::INTEGER) AS k
    FROM spot a LEFT JOIN n o USING (leaf, i, x) GROUP BY leaf, t),
own AS (SELECT leaf, t, n, p FROM pattern WHERE k > 0 AND {_alike("t", "p")}),
wanted AS (SELECT leaf, p FROM own GROUP BY leaf, p HAVING sum(n) >= 10),
further AS (SELECT leaf, p FROM wanted JOIN own USING (leaf, p) JOIN c USING (leaf, t) GROUP BY leaf, p HAVING count(DISTINCT doc_id) >= 10),
near AS (SELECT DISTINCT leaf, t FROM kind JOIN further USING (leaf) WHERE {_alike("t", "p")}),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM main SEMI JOIN often USING (leaf) UNION ALL SELECT doc_id, pos FROM c SEMI JOIN near USING (leaf, t))),
share AS (SELECT doc_id, sum(len(t)) AS n FROM gone JOIN lines USING (doc_id, pos) GROUP BY doc_id),
whole AS (SELECT doc_id, coalesce(n, 0) > 0.5 * len({WORDS.format("text")}) AS left_whole FROM d LEFT JOIN share USING (doc_id)),
cut AS (SELECT g.doc_id, g.pos FROM gone g JOIN whole w USING (doc_id) WHERE NOT left_whole),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n_kept FROM lines ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CASE WHEN o.text IS NULL THEN 0 ELSE len(l) END::BIGINT AS n_lines, (len(l) - coalesce(n_kept, 0))::BIGINT AS n_dropped, left_whole, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN whole USING (doc_id) LEFT JOIN kept USING (doc_id) JOIN documents o USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
sets AS (SELECT min(doc_id) AS sid, s, len(s) AS n, count(*) AS copies FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT sid, unnest(s) AS g FROM sets),
inter AS (SELECT a.sid AS a, b.sid AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.sid < b.sid GROUP BY 1, 2),
pairs AS (SELECT a, b FROM inter JOIN sets x ON x.sid = a JOIN sets y ON y.sid = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT sid, sid FROM sets UNION SELECT r.a, p.b FROM reach r JOIN both_ways p ON r.b = p.a),
class AS (SELECT a AS sid, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS sid, count(*) AS classes, sum(copies) AS docs FROM both_ways JOIN sets ON sid = b GROUP BY a)
SELECT s.doc_id, coalesce(class_id, s.doc_id) AS class_id, coalesce(copies - 1 + coalesce(docs, 0), 0)::BIGINT AS n_links, coalesce(classes, 0)::BIGINT AS n_linked_classes
FROM s LEFT JOIN sets USING (s) LEFT JOIN class USING (sid) LEFT JOIN links USING (sid)"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to FROM m"""


def _level(name: str, above: str, path: list[str], weight: str) -> str:
    """Budgets of one level of the tree from those of the level above: by
    weight, none above its cap, shortages to the others by weight."""
    keys, parent = ", ".join(path), ", ".join(path[:-1]) or "1"
    join = f"JOIN {above} a USING ({', '.join(path[:-1])})" if len(path) > 1 else f"CROSS JOIN {above} a"
    by = f"PARTITION BY {parent} ORDER BY cap / weight, {path[-1]}"
    return f"""
{name}_n AS (SELECT {keys}, sum(cap) AS cap, {weight} AS weight, any_value(a.budget) AS up FROM leaf {join} GROUP BY {keys}),
{name}_o AS (SELECT *, row_number() OVER ({by}) AS place,
    (up - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_n),
{name}_f AS (SELECT *, min(CASE WHEN cap > level * weight THEN place END) OVER (PARTITION BY {parent}) AS open FROM {name}_o),
{name} AS (SELECT {keys}, CASE WHEN open IS NULL OR place < open THEN cap
    ELSE greatest(0.0, max(CASE WHEN place = open THEN level END) OVER (PARTITION BY {parent}) * weight) END AS budget FROM {name}_f)"""


def mix(share: float, epochs: int, seed: int) -> str:
    domain = "CASE WHEN domain = 'shelf0' THEN 4.0::DOUBLE WHEN domain = 'shelf1' THEN 3.0 WHEN domain = 'shelf2' THEN 2.0 ELSE 1.0 END"
    lang = "CASE WHEN lang = 'en' THEN 5.0::DOUBLE WHEN lang = 'de' THEN 2.0 WHEN lang = 'fr' THEN 2.0 ELSE 1.0 END"
    return rf"""
WITH u AS (SELECT doc_id, 'shelf' || (regexp_extract(source, '(\d+)', 1)::INTEGER % 4) AS domain, lang, source, len({WORDS.format("text")})::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * {epochs} AS cap FROM u GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * {share}::DOUBLE) AS budget FROM leaf),{_level("one", "root", ["domain"], domain)},{_level("two", "one", ["domain", "lang"], lang)},{_level("three", "two", ["domain", "lang", "source"], "1.0::DOUBLE")},
b AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN floor(budget / tokens)::INTEGER ELSE 0 END AS epochs, tokens FROM three JOIN leaf USING (domain, lang, source)),
r AS (SELECT u.*, budget, epochs, floor(budget - epochs * tokens)::BIGINT AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}/' || epochs || '/' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS run
    FROM u JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget, CASE WHEN n_tokens = 0 THEN 0 ELSE epochs + (run <= rest)::INTEGER END AS copies FROM r"""


ORACLE = {"op1_substrings": SUBSTRINGS, "op2_topk": TOPK, "op4_lines": LINES, "op5_near": NEAR, "op6_warc": WARC, "op8_mix": mix(0.6, 4, 7)}
