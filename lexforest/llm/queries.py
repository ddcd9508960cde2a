"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .exact_dedup import op13_exact_dedup
from .exact_topk import op6_exact_topk
from .hard_negatives import op12_hard_negatives
from .line_dedup import op4_line_dedup
from .mixing import op5_mixing
from .near_dup import op7_near_dup
from .packing import op3_packing
from .permutation import op9_permutation
from .quality import op1_quality
from .ranked_search import op11_ranked_search
from .repeats import op8_repeats
from .sharding import op2_sharding
from .token_counts import op10_token_counts


def queries() -> dict:
    found = (
        op1_quality, op2_sharding, op3_packing, op4_line_dedup, op5_mixing, op6_exact_topk, op7_near_dup, op8_repeats, op9_permutation, op10_token_counts,
        op11_ranked_search, op12_hard_negatives, op13_exact_dedup,
    )
    return {f.__name__: f for f in found}


TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5"""

NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [array_to_string(ws, ' ')] END) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
digest AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS d FROM sh GROUP BY doc_id),
class AS (SELECT d, min(doc_id) AS class_id FROM digest GROUP BY d)
SELECT n.doc_id, n AS n_shingles, component_id, n.doc_id = component_id AS kept, coalesce(class_id, n.doc_id) AS class_id
FROM n JOIN comp ON comp.doc_id = n.doc_id LEFT JOIN digest g ON g.doc_id = n.doc_id LEFT JOIN class ON class.d = g.d"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
i AS (SELECT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
w AS (SELECT item_id, term, times * floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df USING (term), s),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ts) * n) // l AS m FROM d, s WHERE len(ts) > 0),
sc AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM w JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 20"""

NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label, a.e, b.r AS b, b.vec_id AS positive_id, list_dot_product(a.e, b.e)::BIGINT AS positive_score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY positive_score DESC, positive_id, b) AS place FROM s QUALIFY place <= 5),
n AS (SELECT p.*, c.vec_id AS negative_id, list_dot_product(p.e, c.e)::BIGINT AS negative_score FROM p JOIN v c ON c.label <> p.label)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY r, place ORDER BY negative_score DESC, negative_id)::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE 80 * positive_score <= 100 * negative_score AND 100 * negative_score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY r, place ORDER BY negative_score DESC, negative_id) <= 5"""

EXACT = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)"""


def oracle_sql() -> dict[str, str]:
    """The others hold hashes, checksums or models that SQL lacks; tests compare them with brute force."""
    return {"op6_exact_topk": TOP_K, "op7_near_dup": NEAR, "op11_ranked_search": RANKED, "op12_hard_negatives": NEGATIVES, "op13_exact_dedup": EXACT}
