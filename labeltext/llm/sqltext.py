"""DuckDB SQL of the queries that SQL can state."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def component_sql(table: str, width: int, percent: int) -> str:
    """CTEs ending in ``labelled`` (doc_id, n_shingles, component_id): links by
    the size of the intersection over the union of the word shingle sets of
    ``table`` (doc_id, text), then the smallest reachable doc_id."""
    return f"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width} - 1], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM hits JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
sides AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT u, v FROM sides UNION SELECT r.u, s.v FROM reach r JOIN sides s ON r.v = s.u),
least_of AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
labelled AS (SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(l.v, n.doc_id)) AS component_id FROM n LEFT JOIN least_of l ON l.u = n.doc_id)"""


def search_sql(k: int) -> str:
    """Ranked lexical search of ``benchmark`` items over ``documents``."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS (SELECT doc_id, {terms} AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
m AS (SELECT doc_id, ((50 * n * docs) // total)::BIGINT + 50 AS m FROM d, s),
c AS (SELECT q.item_id, p.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= {k}"""


ORACLE = {
    "op4_superminhash_dedup": f"WITH RECURSIVE {component_sql('documents', 4, 80)} SELECT doc_id, n_shingles::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM labelled",
    "op11_mask_search": search_sql(50),
    "op13_warc_salvage": """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)""",
}
