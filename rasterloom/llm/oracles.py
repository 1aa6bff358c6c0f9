"""SQL for DuckDB of the operators that SQL can express, by plain means of its own."""

from __future__ import annotations

import string

from .quality_rules import FENCE, GROWTH, LEAN, MIN_WORDS, REPEAT_PERCENT
from .sharding import TABLE_SIZE, fill_table

WORD = r"[^\x20\x09-\x0D]"
LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def ngram_join() -> str:
    """All pairs of documents that share a shingle, their exact similarity, and everything reachable by links."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '{WORD}+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w[i:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w) UNION ALL SELECT doc_id, w FROM w WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""


def exact_dedup() -> str:
    return f"""WITH t AS (SELECT doc_id, {LOW} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g::BIGINT AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM t WINDOW g AS (PARTITION BY t)"""


def sharding(shards: list[str]) -> str:
    """The filled table is given as a list; placement is SQL."""
    slots = ", ".join(map(str, fill_table(shards).tolist()))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS n_bytes, (('0x' || substr(md5('k' || doc_id), 1, 15))::BIGINT % {TABLE_SIZE})::INT AS slot FROM documents)
SELECT doc_id, n_bytes, slot, [{names}][[{slots}][slot + 1] + 1] AS shard FROM d"""


def quality_rules() -> str:
    values = {"symbol_rate": "n_symbols / greatest(n_words, 1)", "punctuation_rate": "n_punctuation / greatest(n_words, 1)", "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)", "repeat_rate": "n_repeat_words / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)"}
    bucket = lambda v: f"round(ln(1 + 1000 * ({v})) / ln({GROWTH}::DOUBLE))::INT"
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {bucket(v)} AS b FROM c WHERE NOT failed" for k, v in values.items())

    def quartiles(name: str, keys: str) -> str:
        by = f"PARTITION BY {keys}, rate"
        return f"""{name}_run AS (SELECT {keys}, rate, b, sum(count(*)) OVER ({by} ORDER BY b) AS upto, sum(count(*)) OVER ({by}) AS total FROM m WHERE b > 0 GROUP BY {keys}, rate, b),
{name} AS (SELECT {keys}, rate, max(total)::BIGINT AS total, min(b) FILTER (4 * upto >= 3 * total) AS q75, min(b) FILTER (4 * upto >= 3 * total) - min(b) FILTER (4 * upto >= total) AS spread FROM {name}_run GROUP BY {keys}, rate)"""

    beyond = " OR ".join(f"coalesce({bucket(v)} > (SELECT f.fence FROM f WHERE f.rate = '{k}' AND f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source), FALSE)" for k, v in values.items())
    signs = string.punctuation.replace("'", "''")
    return f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w FROM documents),
g AS (SELECT rid, i, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS j FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
b AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, length(text) - length(translate(text, '{signs}', '')) AS n_punctuation, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
c AS (SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_punctuation, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS failed FROM b),
m AS ({rows}), {quartiles("own", "lang, source")}, {quartiles("wide", "lang")},
s AS (SELECT DISTINCT lang, source FROM m WHERE b > 0),
f AS (SELECT s.lang, s.source, wide.rate, CASE WHEN own.rate IS NULL THEN wide.q75 + {FENCE} * wide.spread ELSE (own.total * (own.q75 + {FENCE} * greatest(own.spread, wide.spread)) + {LEAN} * (wide.q75 + {FENCE} * wide.spread)) / (own.total + {LEAN}) END AS fence FROM s JOIN wide ON s.lang IS NOT DISTINCT FROM wide.lang LEFT JOIN own ON own.rate = wide.rate AND own.lang IS NOT DISTINCT FROM s.lang AND own.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT ({beyond}) AS kept FROM c"""


def fill_in_middle() -> str:
    """Units as a list; texts are joined from slices of it."""
    number = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT doc_id, text, u, len(u) AS n, least({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS a, greatest({number(0)} % (len(u) + 1), {number(1)} % (len(u) + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(2)} % 100 >= 50 THEN 'plain' WHEN {number(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def top_products() -> str:
    """Every query against every other row."""
    return """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, v.rid AS other, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.rid <> q.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
