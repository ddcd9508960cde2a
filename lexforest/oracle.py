"""DuckDB SQL for the registered queries: the same results, written as plain relational definitions."""

from __future__ import annotations

from .operators import axes
from .operators.heads import HEAD_RULES, PUNCTUATION
from .operators.patterns import CLAUSE, FINITE, NOMINAL, PRIMITIVES, SENTENCE, WORD
from .operators.surrogate import SENTENCE as SENTENCE_FORM, chunked_sql
from .operators.tokens import penn_tag_sql, universal_tag_sql

TOKEN = r"[\p{L}\p{N}]+"


def names(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


TOKENS = f"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS ws FROM documents),
plain AS (SELECT doc_id, unnest(ws) AS lemma, generate_subscripts(ws, 1) - 1 AS pos FROM words),
tok AS (SELECT *, {penn_tag_sql('lemma')} AS ptb FROM plain),
tagged AS (SELECT *, {universal_tag_sql('ptb')} AS tag FROM tok)"""

CLASSED = f"""{TOKENS},
easy AS (SELECT lemma FROM tagged GROUP BY lemma ORDER BY count(*) DESC, lemma LIMIT 2000),
adj AS (SELECT DISTINCT lemma FROM tagged WHERE tag = 'ADJ'),
adverbs AS (SELECT lemma FROM adj UNION SELECT lemma || 'ly' FROM adj),
flags AS (SELECT t.*, t.lemma NOT IN (SELECT lemma FROM easy) AND tag <> 'NUM' AS soph, t.lemma IN (SELECT lemma FROM adverbs) AS advlemma FROM tagged t),
classed AS (SELECT *, CASE WHEN tag = 'NOUN' THEN 'noun' WHEN tag = 'ADJ' THEN 'adj' WHEN tag = 'ADV' AND advlemma THEN 'adv' WHEN tag = 'VERB' THEN 'verb' END AS class FROM flags)"""

MEMBER = {
    "word": "TRUE", "sword": "soph", "lex": "class IS NOT NULL", "slex": "class IS NOT NULL AND soph", "noun": "class = 'noun'",
    "verb": "class = 'verb'", "sverb": "class = 'verb' AND soph", "adj": "class = 'adj'", "adv": "class = 'adv'",
}


def counts(key: str = "doc_id", source: str = "classed") -> str:
    cols = ", ".join(f"count(DISTINCT lemma) FILTER ({m}) AS {c}_t, count(*) FILTER ({m}) AS {c}_n" for c, m in MEMBER.items())
    return f"counted AS (SELECT {key}, {cols} FROM {source} GROUP BY {key})"


LOG = lambda f, x: f"CASE WHEN ({x}) > 0 THEN {f}(({x})::DOUBLE) ELSE 0.0 END"
INDEX = {
    "LD": ratio("lex_n", "word_n"), "LS1": ratio("slex_n", "lex_n"), "LS2": ratio("sword_t", "word_t"), "VS1": ratio("sverb_t", "verb_n"), "VS2": ratio("sverb_t * sverb_t", "verb_n"),
    "CVS1": ratio("sverb_t", "sqrt(verb_n * 2)"), "NDW": "word_t::DOUBLE", "TTR": ratio("word_t", "word_n"), "CTTR": ratio("word_t", "sqrt(word_n * 2)"), "RTTR": ratio("word_t", "sqrt(word_n)"),
    "LogTTR": ratio(LOG("ln", "word_t"), LOG("ln", "word_n")), "Uber": ratio(f"pow({LOG('log10', 'word_n')}, 2)", LOG("log10", ratio("word_n", "word_t"))),
    "VV1": ratio("verb_t", "verb_n"), "SVV1": ratio("verb_t * verb_t", "verb_n"), "CVV1": ratio("verb_t", "sqrt(verb_n * 2)"), "LV": ratio("lex_t", "lex_n"), "VV2": ratio("verb_t", "lex_n"),
    "NV": ratio("noun_t", "noun_n"), "AdjV": ratio("adj_t", "lex_n"), "AdvV": ratio("adv_t", "lex_n"), "ModV": ratio("adv_t + adj_t", "lex_n"),
}


def index_query(wanted, digits: int | None = None) -> str:
    shown = [f'round({INDEX[n]}, {digits}) AS "{n}"' if digits else f'{INDEX[n]} AS "{n}"' for n in wanted]
    return f"WITH {CLASSED}, {counts()} SELECT doc_id, {', '.join(shown)} FROM counted"


# ---- trees: forests, then nodes by nearest opener


def surrogate() -> str:
    tagged = f"array_to_string(list_transform(ws, lambda w: '(' || {penn_tag_sql('w')} || ' ' || w || ')'), ' ')"
    one = chunked_sql("tagged", "\\", ", 'g'")
    return rf"""sentences AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.!?\n]+')) AS s, generate_subscripts(string_split_regex(lower(text), '[.!?\n]+'), 1) AS ord FROM documents),
sent AS (SELECT doc_id, ord, regexp_extract_all(s, '{TOKEN}') AS ws FROM sentences),
tags AS (SELECT doc_id, ord, {tagged} AS tagged FROM sent WHERE len(ws) > 0),
chunks AS (SELECT doc_id, ord, {one} AS t FROM tags),
forests AS MATERIALIZED (SELECT d.doc_id, coalesce(string_agg({SENTENCE_FORM}, chr(10) ORDER BY ord), '') AS forest FROM documents d LEFT JOIN chunks USING (doc_id) GROUP BY d.doc_id)"""


NODES = r"""
toks AS MATERIALIZED (SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(forest, '[()]|[^\s()]+') AS ts FROM forests)),
around AS MATERIALIZED (SELECT *, lag(tok) OVER w AS prev, lead(tok) OVER w AS nxt, sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS dep FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
closed AS MATERIALIZED (SELECT doc_id, pos AS st, tok, nxt, dep AS lvl, lead(pos) OVER (PARTITION BY doc_id, CASE tok WHEN '(' THEN dep ELSE dep + 1 END ORDER BY pos) AS en FROM around WHERE tok IN ('(', ')')),
opened AS MATERIALIZED (SELECT doc_id, st, en, CASE WHEN nxt NOT IN ('(', ')') THEN nxt END AS label, lvl FROM closed WHERE tok = '('),
raw AS MATERIALIZED (SELECT *, FALSE AS word FROM opened UNION ALL SELECT doc_id, pos, pos, tok, dep + 1, TRUE FROM around WHERE tok NOT IN ('(', ')') AND prev <> '(' AND dep > 0),
marked AS (SELECT doc_id, st, en, label, lvl, word, lvl AS lv, NULL::INTEGER AS over_st, NULL::VARCHAR AS over_label FROM raw UNION ALL SELECT doc_id, st, NULL::INTEGER, label, NULL::INTEGER, FALSE, lvl + 1, st, label FROM opened),
up AS MATERIALIZED (SELECT * EXCLUDE (o), o.st AS parent, o.label AS parent_label FROM (SELECT doc_id, st, en, label, lvl, word, last_value(CASE WHEN over_st IS NOT NULL THEN struct_pack(st := over_st, label := over_label) END IGNORE NULLS) OVER (PARTITION BY doc_id, lv ORDER BY st) AS o FROM marked) WHERE lvl IS NOT NULL),
rooted AS MATERIALIZED (SELECT *, last_value(CASE WHEN lvl = 1 THEN st END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY st) AS tree_id FROM up),
kidcount AS MATERIALIZED (SELECT doc_id, parent AS st, count(*) AS n_kids FROM rooted WHERE parent IS NOT NULL GROUP BY ALL),
nodes AS MATERIALIZED (SELECT r.doc_id, tree_id, r.st, en, label, lvl, parent, parent_label, coalesce(n_kids, 0) AS n_kids, coalesce(n_kids, 0) = 0 AS is_leaf,
  CASE WHEN parent IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY r.doc_id, parent ORDER BY r.st) - 1 END AS ci,
  CASE WHEN parent IS NOT NULL THEN lead(label) OVER (PARTITION BY r.doc_id, parent ORDER BY r.st) END AS next_label
  FROM rooted r LEFT JOIN kidcount k ON r.doc_id = k.doc_id AND r.st = k.st)"""

EDGES = """
leaves AS MATERIALIZED (SELECT doc_id, tree_id, st FROM nodes WHERE is_leaf),
edged AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM leaves l WHERE l.doc_id = n.doc_id AND l.tree_id = n.tree_id AND l.st < n.st) AS left_edge,
  (SELECT count(*) FROM leaves l WHERE l.doc_id = n.doc_id AND l.tree_id = n.tree_id AND l.st <= n.en) AS right_edge FROM nodes n)"""


def heads(source: str = "nodes") -> str:
    rows = ", ".join(f"('{m}', {k}, '{d}', [{', '.join(repr(c) for c in cats)}]::VARCHAR[])" for m, rules in HEAD_RULES.items() for k, (d, cats) in enumerate(rules))
    return f"""
rules(mother, ord, dir, cats) AS (VALUES {rows}),
hits AS MATERIALIZED (SELECT p.doc_id, p.st, c.ci, r.ord * 1000000 + CASE WHEN r.dir IN ('left', 'right') THEN list_position(r.cats, c.label) ELSE 0 END * 1000 + CASE WHEN r.dir LIKE 'left%' THEN c.ci ELSE 900 - c.ci END AS k
  FROM {source} p JOIN rules r ON regexp_replace(p.label, '^@', '') = r.mother JOIN {source} c ON c.doc_id = p.doc_id AND c.parent = p.st AND list_contains(r.cats, c.label) WHERE p.n_kids > 1),
best AS MATERIALIZED (SELECT doc_id, st, arg_min(ci, k) AS ci FROM hits GROUP BY ALL),
lastrule AS MATERIALIZED (SELECT mother, arg_max(dir, ord) AS dir FROM rules GROUP BY mother),
pres AS MATERIALIZED (SELECT n.doc_id, n.st FROM {source} n JOIN {source} c ON c.doc_id = n.doc_id AND c.parent = n.st AND c.is_leaf WHERE n.n_kids = 1),
shifted AS MATERIALIZED (SELECT b.doc_id, b.st, CASE WHEN b.ci >= 2 AND q.label IN ('CC', 'CONJP') AND NOT (x.label IN {names(p.replace("'", "''") for p in PUNCTUATION)} AND EXISTS (SELECT 1 FROM pres WHERE pres.doc_id = x.doc_id AND pres.st = x.st)) THEN b.ci - 2 ELSE b.ci END AS ci
  FROM best b LEFT JOIN {source} q ON q.doc_id = b.doc_id AND q.parent = b.st AND q.ci = b.ci - 1 LEFT JOIN {source} x ON x.doc_id = b.doc_id AND x.parent = b.st AND x.ci = b.ci - 2),
headci AS MATERIALIZED (SELECT n.doc_id, n.st, CASE WHEN n.n_kids = 1 THEN 0 WHEN n.n_kids > 1 AND s.ci IS NOT NULL THEN s.ci WHEN n.n_kids > 1 AND l.dir LIKE 'left%' THEN 0 WHEN n.n_kids > 1 AND l.dir IS NOT NULL THEN n.n_kids - 1 END AS ci
  FROM {source} n LEFT JOIN shifted s ON s.doc_id = n.doc_id AND s.st = n.st LEFT JOIN lastrule l ON l.mother = regexp_replace(n.label, '^@', '')),
headed AS MATERIALIZED (SELECT n.*, c.st AS head_st, c.label AS head_label FROM {source} n LEFT JOIN headci h ON h.doc_id = n.doc_id AND h.st = n.st LEFT JOIN {source} c ON c.doc_id = n.doc_id AND c.parent = n.st AND c.ci = h.ci)"""


def exists(alias: str, condition: str, source: str = "headed") -> str:
    return f"EXISTS (SELECT 1 FROM {source} {alias} WHERE {alias}.doc_id = n.doc_id AND {alias}.tree_id = n.tree_id AND {condition})"


KID = lambda c: exists("k", f"k.parent = n.st AND {c}")
FIN, S3, S4 = names(FINITE), names(CLAUSE), names(SENTENCE)
#: Steps: each adds flags that later ones use.
PATTERNS = f"""
f1 AS MATERIALIZED (SELECT n.*, n.label = 'VP' AND coalesce(n.head_label IN {FIN}, FALSE) AS fin, {KID("k.label = 'CC'")} AS cc,
  {KID(f"k.label = 'VP' AND k.head_label IN {FIN}")} AS finkid, {exists('k', "k.parent = n.st AND k.ci = 0 AND k.label = 'VP' AND k.head_label = 'VB'")} AS vbfirst FROM headed n),
f2 AS MATERIALIZED (SELECT n.*, coalesce(n.label IN {S3}, FALSE) AND (coalesce(n.parent_label = 'ROOT', FALSE) AND vbfirst OR coalesce(n.head_label IN {FIN}, FALSE)
  OR {exists('k', "k.parent = n.st AND (k.fin OR k.label = 'VP' AND k.cc AND k.finkid)", 'f1')}) AS core FROM f1 n),
f3 AS MATERIALIZED (SELECT n.*, coalesce(n.label = 'SBAR', FALSE) AND {exists('k', 'k.parent = n.st AND k.core', 'f2')} AS dc,
  coalesce(n.label IN {S4}, FALSE) AND (coalesce(n.parent_label = 'ROOT', FALSE) OR {exists('k', f"k.parent = n.parent AND k.ci < n.ci AND k.label IN {S4}", 'f2')}
    AND NOT {exists('k', "k.st < n.st AND k.en > n.en AND k.label IN ('SBAR', 'VP')", 'f2')}) AS t1,
  coalesce(n.label IN {names(NOMINAL)}, FALSE) OR n.label = 'NP' AND {exists('k', "k.parent = n.parent AND k.ci > n.ci AND k.label = 'NP'", 'f2')} AND coalesce(n.next_label <> 'CC', TRUE) AS nominal FROM f2 n),
found AS MATERIALIZED (SELECT n.doc_id, n.tree_id, n.st, n.en,
  n.label = 'ROOT' AND n.parent IS NULL AS is_S, n.label = 'VP' AND n.parent_label IN {S3} AS is_VP1,
  n.label IN {FIN} AND n.parent_label = 'SQ' AND NOT {exists('k', "k.parent = n.parent AND k.label = 'VP'", 'f3')} AS is_VP2, n.core AS is_C1,
  n.label = 'FRAG' AND n.parent_label = 'ROOT' AND NOT {exists('k', 'k.st > n.st AND k.en < n.en AND k.core', 'f3')} AS is_C2, n.t1 AS is_T1,
  n.label = 'FRAG' AND n.parent_label = 'ROOT' AND NOT {exists('k', 'k.st > n.st AND k.en < n.en AND k.t1', 'f3')} AS is_T2,
  n.label = 'NP' AND coalesce(n.parent_label <> 'NP', TRUE) AND {exists('k', 'k.st > n.st AND k.en < n.en AND k.nominal', 'f3')} AS is_CN1,
  n.label = 'SBAR' AND (n.head_label = 'WHNP' OR n.head_label = 'IN' AND {exists('k', "k.parent = n.head_st AND k.label IN ('That', 'that', 'For', 'for')", 'f3')} OR {exists('k', "k.parent = n.st AND k.ci = 0 AND k.label = 'S'", 'f3')})
    AND (coalesce(n.next_label = 'VP', FALSE) OR coalesce(n.parent_label = 'VP', FALSE)) AS is_CN2,
  n.label = 'S' AND n.next_label = 'VP' AND {exists('k', "k.parent = n.st AND k.label = 'VP' AND k.head_label IN ('VBG', 'TO')", 'f3')} AS is_CN3, n.dc AS is_DC,
  n.t1 AND {exists('k', 'k.st > n.st AND k.en < n.en AND k.dc', 'f3')} AS is_CT, n.label IN ('ADJP', 'ADVP', 'NP', 'VP') AND n.cc AS is_CP FROM f3 n)"""


def structure_counts(forests: str) -> str:
    """counted13: doc_id, W and the structures of every document."""
    cols = ", ".join(f"count(*) FILTER (is_{p}) AS {p}" for p in PRIMITIVES)
    zero = ", ".join(f"coalesce({p}, 0)::BIGINT AS {p}" for p in PRIMITIVES)
    return f"""WITH {forests}, {NODES}, {heads()}, {PATTERNS},
per AS (SELECT doc_id, {cols} FROM found GROUP BY doc_id),
prim AS (SELECT f.doc_id, len(regexp_extract_all(f.forest, '{WORD}'))::BIGINT AS W, {zero} FROM forests f LEFT JOIN per USING (doc_id)),
sums AS (SELECT *, VP1 + VP2 AS VP, C1 + C2 AS C, T1 + T2 AS T, CN1 + CN2 + CN3 AS CN FROM prim)"""


RATIOS = {"MLS": ("W", "S"), "MLT": ("W", "T"), "MLC": ("W", "C"), **{f"{a}/{b}": (a, b) for a, b in (("C", "S"), ("VP", "T"), ("C", "T"), ("DC", "C"), ("DC", "T"), ("T", "S"), ("CT", "T"), ("CP", "T"), ("CP", "C"), ("CN", "T"), ("CN", "C"))}}
ALL = ", ".join(["W", "S", "VP", "C", "T", "DC", "CT", "CP", "CN", *(f'{ratio(a, b)} AS "{n}"' for n, (a, b) in RATIOS.items())])


#: By plain joins: a node's forked nodes above it, the most of them above a leaf below it, and the sum of the weights below it.
NUM_EDGES = """
fork AS MATERIALIZED (SELECT n.*, NOT n.is_leaf AND n.parent IS NOT NULL AND p.n_kids > 1 AS forked FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.st = n.parent),
above AS MATERIALIZED (SELECT d.doc_id, d.tree_id, d.st, count(a.st) AS forks FROM fork d LEFT JOIN fork a ON a.doc_id = d.doc_id AND a.tree_id = d.tree_id AND a.st < d.st AND a.en > d.en AND a.forked GROUP BY ALL),
full_fork AS MATERIALIZED (SELECT * FROM fork JOIN above USING (doc_id, tree_id, st)),
heavy AS MATERIALIZED (SELECT n.doc_id, n.tree_id, n.st, n.en, n.forked, 1 + max(l.forks) - max(n.forks) AS weight FROM full_fork n JOIN full_fork l ON l.doc_id = n.doc_id AND l.tree_id = n.tree_id AND l.st >= n.st AND l.en <= n.en AND l.is_leaf GROUP BY ALL),
own AS MATERIALIZED (SELECT h.*, CASE WHEN f.is_leaf THEN 1 WHEN h.forked THEN h.weight ELSE 0 END AS e FROM heavy h JOIN fork f USING (doc_id, tree_id, st)),
counted_edges AS MATERIALIZED (SELECT n.doc_id, n.tree_id, n.st, sum(d.e)::BIGINT AS edges, max(n.weight)::BIGINT AS weight FROM own n JOIN own d ON d.doc_id = n.doc_id AND d.tree_id = n.tree_id AND d.st >= n.st AND d.en <= n.en GROUP BY n.doc_id, n.tree_id, n.st)"""


def axis_nodes(forests: str) -> str:
    return f"""{forests}, {NODES}, {EDGES}, {heads('edged')},
ax AS MATERIALIZED (SELECT n.*, n.parent IS NULL OR h.st IS NOT NULL AS is_head FROM headed n LEFT JOIN (SELECT DISTINCT doc_id, head_st AS st FROM headed WHERE head_st IS NOT NULL) h ON h.doc_id = n.doc_id AND h.st = n.st)"""


def axis_query(forests: str, condition: str) -> str:
    return f"WITH {axis_nodes(forests)} SELECT a.doc_id, a.tree_id, a.st AS a, b.st AS b FROM ax a JOIN ax b ON a.doc_id = b.doc_id AND a.tree_id = b.tree_id WHERE {condition}"


def way_query(forests: str, upwards: bool, leave: str = "TRUE", enter: str = "TRUE", through: str = "TRUE") -> str:
    """Step by step from every node to its ancestors: leave and through are conditions on the node left (x), enter on the one reached (p)."""
    a, b = ("low", "high") if upwards else ("high", "low")
    up = "JOIN ax p ON p.doc_id = x.doc_id AND p.st = x.parent"
    return f"""WITH RECURSIVE {axis_nodes(forests)},
way(doc_id, tree_id, low, high) AS (SELECT x.doc_id, x.tree_id, x.st, p.st FROM ax x {up} WHERE {leave} AND {enter}
  UNION ALL SELECT w.doc_id, w.tree_id, w.low, p.st FROM way w JOIN ax x ON x.doc_id = w.doc_id AND x.st = w.high {up} WHERE {leave} AND {enter} AND {through})
SELECT doc_id, tree_id, {a} AS a, {b} AS b FROM way"""


def chain_query(forests: str, category: str, backwards: bool) -> str:
    a, b = ("y", "x") if backwards else ("x", "y")
    return f"""WITH RECURSIVE {forests}, {NODES}, {EDGES}, ends AS MATERIALIZED (SELECT * FROM edged),
arcs AS MATERIALIZED (SELECT DISTINCT doc_id, tree_id, left_edge, right_edge FROM ends x WHERE {category}),
reach(doc_id, tree_id, p, q) AS (SELECT DISTINCT doc_id, tree_id, right_edge, right_edge FROM ends UNION SELECT r.doc_id, r.tree_id, r.p, x.right_edge FROM reach r JOIN arcs x ON x.doc_id = r.doc_id AND x.tree_id = r.tree_id AND x.left_edge = r.q)
SELECT x.doc_id, x.tree_id, {a}.st AS a, {b}.st AS b FROM ends x JOIN reach r ON r.doc_id = x.doc_id AND r.tree_id = x.tree_id AND r.p = x.right_edge JOIN ends y ON y.doc_id = x.doc_id AND y.tree_id = x.tree_id AND y.left_edge = r.q"""


def axis_sql(forests: str) -> dict[str, str]:
    category = "x.label IN ('NP', 'VP', 'S')"
    out = {f"axis_{n}": axis_query(forests, c) for n, (_, c) in axes.SIMPLE.items()}
    ways = {"unary_path_ancestor_of": {"enter": "p.n_kids = 1"}, "headed_by": {"leave": "x.is_head"}, "unbroken_dominates": {"through": f"coalesce({category}, FALSE)"}}
    for down, up in (("unary_path_ancestor_of", "unary_path_descendant_of"), ("headed_by", "heads"), ("unbroken_dominates", "unbroken_dominated_by")):
        out |= {f"axis_{down}": way_query(forests, False, **ways[down]), f"axis_{up}": way_query(forests, True, **ways[down])}
    out |= {f"axis_{n}_{'last' if k < 0 else k}": axis_query(forests, axes.numbered(n, k)) for n in ("ith_child_of", "has_ith_child", "ancestor_of_ith_leaf") for k in (2, -1)}
    return out | {f"axis_unbroken_{w}": chain_query(forests, category, w == "follows") for w in ("precedes", "follows")}
