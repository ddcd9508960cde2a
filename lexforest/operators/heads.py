"""Head children by Collins' rules (Collins 1999), as column expressions over a node's children."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import Nodes, child, from_children, places

# The published head rules. Mother, then (direction, categories) in order of trial.
HEAD_RULES = {
    "ADJP": [("left", ["NNS", "QP", "NN", "$", "ADVP", "JJ", "VBN", "VBG", "ADJP", "JJR", "NP", "JJS", "DT", "FW", "RBR", "RBS", "SBAR", "RB"])],
    "ADVP": [("right", ["RB", "RBR", "RBS", "FW", "ADVP", "TO", "CD", "JJR", "JJ", "IN", "NP", "JJS", "NN"])],
    "CONJP": [("right", ["CC", "RB", "IN"])],
    "FRAG": [("right", [])],
    "INTJ": [("left", [])],
    "LST": [("right", ["LS", ":"])],
    "NAC": [("left", ["NN", "NNS", "NNP", "NNPS", "NP", "NAC", "EX", "$", "CD", "QP", "PRP", "VBG", "JJ", "JJS", "JJR", "ADJP", "FW"])],
    "NX": [("left", [])],
    "PP": [("right", ["IN", "TO", "VBG", "VBN", "RP", "FW"])],
    "PRN": [("left", [])],
    "PRT": [("right", ["RP"])],
    "QP": [("left", ["$", "IN", "NNS", "NN", "JJ", "RB", "DT", "CD", "NCD", "QP", "JJR", "JJS"])],
    "RRC": [("right", ["VP", "NP", "ADVP", "ADJP", "PP"])],
    "S": [("left", ["TO", "IN", "VP", "S", "SBAR", "ADJP", "UCP", "NP"])],
    "SBAR": [("left", ["WHNP", "WHPP", "WHADVP", "WHADJP", "IN", "DT", "S", "SQ", "SINV", "SBAR", "FRAG"])],
    "SBARQ": [("left", ["SQ", "S", "SINV", "SBARQ", "FRAG"])],
    "SINV": [("left", ["VBZ", "VBD", "VBP", "VB", "MD", "VP", "S", "SINV", "ADJP", "NP"])],
    "SQ": [("left", ["VBZ", "VBD", "VBP", "VB", "MD", "VP", "SQ"])],
    "UCP": [("right", [])],
    "VP": [("left", ["TO", "VBD", "VBN", "MD", "VBZ", "VB", "VBG", "VBP", "AUX", "AUXG", "VP", "ADJP", "NN", "NNS", "NP"])],
    "WHADJP": [("left", ["CC", "WRB", "JJ", "ADJP"])],
    "WHADVP": [("right", ["CC", "WRB"])],
    "WHNP": [("left", ["WDT", "WP", "WP$", "WHADJP", "WHPP", "WHNP"])],
    "WHPP": [("right", ["IN", "TO", "FW"])],
    "X": [("right", [])],
    "NP": [("rightdis", ["NN", "NNP", "NNPS", "NNS", "NX", "POS", "JJR"]), ("left", ["NP"]), ("rightdis", ["$", "ADJP", "PRN"]), ("right", ["CD"]), ("rightdis", ["JJ", "JJS", "RB", "QP"])],
    "TYPO": [("left", [])],
    "EDITED": [("left", [])],
    "XS": [("right", ["IN"])],
}
# Marks that keep the head where it is in a coordination.
PUNCTUATION = ("''``", ".", ":", ",")


def rules_table(spark) -> DataFrame:
    """mother, rules: array of (dir, cats); one row a mother."""
    rows = list(HEAD_RULES.items())
    return spark.createDataFrame(rows, "mother string, rules array<struct<dir:string,cats:array<string>>>")


def rule_index(kids: Column, rule: Column) -> Column:
    """Index from 0 of the child that a rule finds, null if none.

    left and right look for the first category that occurs and then for its outermost child;
    leftdis and rightdis for the outermost child of any category; the except forms for the
    outermost child of none.
    """
    direction, cats = rule["dir"], rule["cats"]

    def key(kid: Column, i: Column) -> Column:
        rank = F.coalesce(F.array_position(cats, kid["label"]), F.lit(0)).cast("int")
        place = F.when(direction.startswith("left"), i).otherwise(-i)
        plain = direction.isin("left", "right")
        hit = F.when(direction.endswith("except"), rank == 0).otherwise(rank > 0)
        return F.when(hit, F.struct(F.when(plain, rank).otherwise(0).alias("rank"), place.alias("place"), i.alias("i")))

    return F.array_min(F.filter(F.transform(kids, key), lambda x: x.isNotNull()))["i"]


def coordinated(kids: Column, i: Column) -> Column:
    """Two to the left of a child that follows a conjunction, unless a mark stands there."""
    at = lambda k: F.try_element_at(kids, k + 1)
    joined = (i >= 2) & at(F.greatest(i - 1, F.lit(0)))["label"].isin("CC", "CONJP")
    two = at(F.greatest(i - 2, F.lit(0)))
    mark = two["pre"] & two["label"].isin(*PUNCTUATION)
    return F.when(F.coalesce(joined & ~F.coalesce(mark, F.lit(False)), F.lit(False)), i - 2).otherwise(i)


def head_index(kids: Column, rules: Column) -> Column:
    """Index from 0 of the head among the children; null for a leaf or an unknown mother of several."""
    hits = F.filter(F.transform(rules, lambda r: rule_index(kids, r)), lambda x: x.isNotNull())
    found = F.try_element_at(hits, F.lit(1))
    last = F.element_at(rules, -1)["dir"]
    fallback = F.when(last.startswith("left"), 0).otherwise(F.size(kids) - 1)
    some = F.when(found.isNotNull(), coordinated(kids, found)).otherwise(fallback)
    return F.when(F.size(kids) == 1, 0).when((F.size(kids) > 1) & rules.isNotNull(), some)


def with_heads(nodes: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds kids (array of st, label, pre), n_kids, head_st and head_label (only where wanted); the rule table has a fixed size."""
    # nodes shredded in place may know their children
    out = nodes if "kids" in nodes.columns else from_children(nodes, kids=F.collect_list(child(F.struct("st", "label", "pre")))).withColumn("kids", F.array_sort("kids"))
    rules = F.broadcast(rules_table(nodes.sparkSession))
    out = out.join(rules, F.regexp_replace("label", "^@", "") == F.col("mother"), "left")
    index = head_index(F.col("kids"), F.col("rules"))
    out = out.withColumn("head", F.try_element_at("kids", (index if wanted is None else F.when(wanted, index)) + 1))
    return out.withColumns({"n_kids": F.size("kids"), "head_st": F.col("head")["st"], "head_label": F.col("head")["label"]}).drop("mother", "rules", "head")


#: Labels that rules and coordinations name, and the rules as arrays: by mother and rule, and by label the rank from 1 (0: not named).
KNOWN = tuple(sorted({c for rules in HEAD_RULES.values() for _, cats in rules for c in cats} | {"CC", "CONJP", *PUNCTUATION}))
MOTHERS = tuple(HEAD_RULES)
_SHAPE = (len(MOTHERS), max(len(rules) for rules in HEAD_RULES.values()))
_DIRECTIONS = np.array([[rules[k][0] if k < len(rules) else "" for k in range(_SHAPE[1])] for rules in HEAD_RULES.values()])
_LEFT, _EXCEPT, _PLAIN = np.char.startswith(_DIRECTIONS, "left"), np.char.endswith(_DIRECTIONS, "except"), np.isin(_DIRECTIONS, ("left", "right"))
_LAST_LEFT = np.array([rules[-1][0].startswith("left") for rules in HEAD_RULES.values()])
_RANK = np.zeros((*_SHAPE, len(KNOWN) + 1), int)
for _m, _rules in enumerate(HEAD_RULES.values()):
    for _k, (_, _cats) in enumerate(_rules):
        for _rank, _cat in reversed(list(enumerate(_cats, 1))):
            _RANK[_m, _k, KNOWN.index(_cat)] = _rank
_JOINS, _MARKS = np.isin((*KNOWN, ""), ("CC", "CONJP")), np.isin((*KNOWN, ""), PUNCTUATION)


def head_children(nodes: Nodes) -> np.ndarray:
    """Index of each node's head child, -1 without one: ``head_index`` for all nodes at once."""
    children, n_kids = nodes.children, nodes.n_kids
    out = np.full(len(n_kids), -1)
    out[n_kids == 1] = children[nodes.first[n_kids == 1]]
    mother = np.full(len(n_kids), -1)
    many = np.flatnonzero(n_kids > 1)
    mother[many] = nodes.codes(MOTHERS, pc.replace_substring_regex(nodes.label.take(pa.array(many)), "^@", "", max_replacements=1))
    kids = children[mother[nodes.parent[children]] >= 0]
    if not len(kids):
        return out
    code, of, kid = nodes.codes(KNOWN), mother[nodes.parent[kids]], nodes.kid[kids]
    starts = np.flatnonzero(np.diff(nodes.parent[kids], prepend=-1))
    up = nodes.parent[kids[starts]]
    width = int(n_kids.max()) + 1
    none = (_RANK.max() + 1) * width
    found = np.full(len(starts), -1)
    for k in range(_SHAPE[1]):
        rank = _RANK[of, k, code[kids]]
        hit = np.where(_EXCEPT[of, k], rank == 0, rank > 0) & (_DIRECTIONS[of, k] != "")
        place = np.where(_LEFT[of, k], kid, width - 1 - kid)
        best = np.minimum.reduceat(np.where(hit, np.where(_PLAIN[of, k], rank, 0) * width + place, none), starts)
        here = (found < 0) & (best < none)
        found[here] = np.where(_LEFT[of[starts], k], best % width, width - 1 - best % width)[here]
    at = lambda i: children[nodes.first[up] + np.maximum(i, 0)]
    two = at(found - 2)
    joined = (found >= 2) & _JOINS[code[at(found - 1)]] & ~(nodes.pre[two] & _MARKS[code[two]])
    found = np.where(joined, found - 2, found)
    out[up] = at(np.where(found >= 0, found, np.where(_LAST_LEFT[mother[up]], 0, n_kids[up] - 1)))
    return out


#: Columns for ``trees.shred_in_place``.
HEAD_ST = ("int", lambda nodes, rows: places(nodes, nodes.once(head_children), rows))


def head_labels(nodes: Nodes, rows: np.ndarray) -> pa.Array:
    head = nodes.once(head_children)[rows]
    return nodes.label.take(pa.array(head, mask=head < 0))
