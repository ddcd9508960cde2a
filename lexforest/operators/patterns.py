"""The thirteen syntactic structures as flags on the node table.

Definitions follow Lu (2010). A structure's matches are distinct nodes, so every
condition on other nodes is a yes or no: conditions on children come up by windows
over families, conditions on ancestors and descendants are running extremes.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees
from .heads import head_children, with_heads
from .trees import TREE, child, enclosed, from_children

# Label sets of the definitions.
FINITE = ("MD", "VBZ", "VBP", "VBD")
CLAUSE, SENTENCE = ("S", "SINV", "SQ"), ("S", "SBARQ", "SINV", "SQ")
NOMINAL = ("JJ", "POS", "PP", "S", "VBG")
THAT = ("That", "that", "For", "for")
#: Labels of nodes that matter beside their parents or children; IN, words and finite tags matter only in their places.
LASTING = tuple(sorted({*SENTENCE, *NOMINAL, "ROOT", "FRAG", "SBAR", "NP", "VP", "ADJP", "ADVP"}))
#: Every label that a definition names.
NAMED = tuple(sorted({*FINITE, *CLAUSE, *SENTENCE, *NOMINAL, *THAT, "ROOT", "FRAG", "SBAR", "NP", "VP", "ADJP", "ADVP", "CC", "IN", "VB", "TO", "WHNP"}))
PRIMITIVES = ("S", "VP1", "VP2", "C1", "C2", "T1", "T2", "CN1", "CN2", "CN3", "DC", "CT", "CP")
# Fixed value: a counted word in bracket text, a tag of capitals and a token without brackets and dashes.
WORD = "\\([A-Z]+\\$? [^()—–-]+\\)"
#: WORD for the JVM: it matches the same, but most characters by a table of plain letters, and nothing is tried twice.
WORD_IN_PLACE = "\\([A-Z]++\\$? (?!\\))[a-z0-9]*+[^()—–-]*+\\)"


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def has_kid(*labels: str) -> Column:
    return F.exists("kids", lambda k: sure(k["label"].isin(*labels)))


def any_kid(flag: Column) -> Column:
    return F.bool_or(child(sure(flag)))


def flagged(nodes: DataFrame) -> DataFrame:
    """Shredded nodes with a column is_<structure> for each of PRIMITIVES; nodes that are and decide no structure are left out.

    Windows by family and by sentence only, within the one partitioning of the node table.
    """
    label, parent, head, after = F.col("label"), F.col("parent_label"), F.col("head_label"), F.col("next_label")
    # a word below its tag plays no part, unless it looks like a label; that leaves half of the rows
    only = (F.col("ci") == 0) & F.col("youngest") & F.col("parent").isNotNull()
    word = F.col("is_leaf") & only & ~sure(label.isin(*NAMED))
    headed = label.isin(*CLAUSE, "VP", "SBAR")
    n = with_heads(mothers(nodes.where(~word), ~F.col("is_leaf") & (headed | label.isin("NP", "ADJP", "ADVP"))), headed)
    n = n.withColumns({"vp": sure(label == "VP"), "finite": sure(head.isin(*FINITE)), "cc": has_kid("CC"), "first_label": F.try_element_at("kids", F.lit(1))["label"]})
    # the rest sorts narrow rows, and few
    placed = ((label == "IN") & (parent == "SBAR")) | (label.isin(*THAT) & (parent == "IN")) | (label.isin(*FINITE) & (parent == "SQ"))
    n = n.where(sure(label.isin(*LASTING)) | sure(placed)).drop("kids", "word", "pre", "prev_label", "sisters")
    n = from_children(
        mothers(n, label.isin(*CLAUSE, "VP", "IN")),
        finite_vp_kid=any_kid(F.col("vp") & F.col("finite")),
        vb_vp_first=any_kid(F.col("vp") & (head == "VB") & (F.col("ci") == 0)),
        loose_vp_kid=any_kid(F.col("vp") & head.isin("VBG", "TO")),
        that_kid=any_kid(label.isin(*THAT)),
    )
    n = from_children(
        mothers(n, label.isin(*CLAUSE, "SBAR")),
        clause_vp_kid=any_kid(F.col("vp") & (F.col("finite") | (F.col("cc") & sure(F.col("finite_vp_kid"))))),
        that_sts=F.collect_set(child(F.when((label == "IN") & sure(F.col("that_kid")), F.col("st")))),
    )
    under_root = sure(parent == "ROOT")
    core = label.isin(*CLAUSE) & ((under_root & sure(F.col("vb_vp_first"))) | F.col("finite") | sure(F.col("clause_vp_kid")))
    n = from_children(mothers(n.withColumns({"is_C1": sure(core), "under_root": under_root}), label == "SBAR"), core_kid=any_kid(F.col("is_C1")))
    sisters = Window.partitionBy(*TREE, "parent")
    n = n.drop("__childless").withColumns({
        "is_DC": sure((label == "SBAR") & F.col("core_kid")),
        "first_s": F.min(F.when(label.isin(*SENTENCE), F.col("ci"))).over(sisters),
        "last_np": F.max(F.when(label == "NP", F.col("ci"))).over(sisters),
        "sq_vp": F.bool_or(sure(label == "VP")).over(sisters),
    })
    joined_np = (label == "NP") & F.col("parent").isNotNull() & (F.col("ci") < F.col("last_np")) & ~sure(after == "CC")
    n = n.withColumns({"frag": sure((label == "FRAG") & F.col("under_root")), "nominal": sure(label.isin(*NOMINAL) | joined_np), "blocks": sure(label.isin("SBAR", "VP"))})
    s4 = sure(label.isin(*SENTENCE))
    later = s4 & F.col("parent").isNotNull() & sure(F.col("ci") > F.col("first_s"))
    n = enclosed(n, above=("blocks",)).withColumn("is_T1", s4 & (F.col("under_root") | (later & ~F.col("under_blocks"))))
    n = enclosed(n, below=("is_C1", "is_T1", "nominal", "is_DC"))
    intro = (head == "WHNP") | ((head == "IN") & F.array_contains("that_sts", F.col("head_st"))) | (F.col("first_label") == "S")
    return n.withColumns({
        "is_S": sure((label == "ROOT") & F.col("parent").isNull()),
        "is_VP1": sure(F.col("vp") & parent.isin(*CLAUSE)),
        "is_VP2": sure(label.isin(*FINITE) & (parent == "SQ") & ~F.col("sq_vp")),
        "is_C2": F.col("frag") & ~F.col("over_is_C1"),
        "is_T2": F.col("frag") & ~F.col("over_is_T1"),
        "is_CN1": sure((label == "NP") & ~sure(parent == "NP")) & F.col("over_nominal"),
        "is_CN2": sure((label == "SBAR") & sure(intro) & (sure(after == "VP") | sure(parent == "VP"))),
        "is_CN3": sure((label == "S") & (after == "VP") & F.col("loose_vp_kid")),
        "is_CT": F.col("is_T1") & F.col("over_is_DC"),
        "is_CP": sure(label.isin("ADJP", "ADVP", "NP", "VP") & F.col("cc")),
    })


def mothers(nodes: DataFrame, which: Column) -> DataFrame:
    """nodes of which only these ask their children for values."""
    return nodes.withColumn("__childless", ~sure(which))


def matches(nodes: DataFrame, names=PRIMITIVES) -> DataFrame:
    """doc_id, tree_id, st, en and measure of every match; nodes are flagged."""
    found = F.filter(F.array(*(F.when(F.col(f"is_{n}"), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return nodes.select(*TREE, "st", "en", "left_edge", "right_edge", F.explode(found).alias("measure"))


def counts(nodes: DataFrame, names=PRIMITIVES) -> DataFrame:
    """doc_id and the number of matches of each structure."""
    return nodes.groupBy("doc_id").agg(*(F.count_if(f"is_{n}").alias(n) for n in names))


def word_counts(forests: DataFrame) -> DataFrame:
    """doc_id and W, counted in the bracket text itself."""
    return forests.select("doc_id", F.coalesce(F.regexp_count("forest", F.lit(WORD_IN_PLACE)), F.lit(0)).cast("long").alias("W"))


class Structures:
    """The structures as flags of some documents' nodes, each worked out when it is asked for; they are those of ``flagged``."""

    def __init__(self, nodes: trees.Nodes):
        self.n, self._code = nodes, np.append(nodes.codes(NAMED), -1)

    def label(self, *labels: str, of: np.ndarray | None = None) -> np.ndarray:
        """Nodes (or those that of leads to) that have one of the labels."""
        code = self._code[:-1] if of is None else self._code[of]
        named = np.zeros(len(NAMED) + 1, bool)
        named[[NAMED.index(x) for x in labels]] = True
        return named[code]

    def parent(self, *labels: str) -> np.ndarray:
        return self.label(*labels, of=self.n.parent)

    def after(self, *labels: str) -> np.ndarray:
        return self.label(*labels, of=self.n.after)

    def head(self, *labels: str) -> np.ndarray:
        """Clauses, verb phrases and subordinate clauses whose head has one of the labels."""
        return self.label(*CLAUSE, "VP", "SBAR") & self.label(*labels, of=self.n.once(head_children))

    def family(self, pick, values: np.ndarray, flag: np.ndarray, none: int) -> np.ndarray:
        """The least or largest value of those of a node's sisters that have the flag; the node is one of them."""
        best, up = np.full(len(flag) + 1, none), self.n.parent
        chosen = flag & (up >= 0)
        pick.at(best, up[chosen], values[chosen])
        return np.where(up >= 0, best[up], none)

    @cached_property
    def cc(self):
        return self.n.some_kid(self.label("CC"))

    @cached_property
    def C1(self):
        vp, finite = self.label("VP"), self.head(*FINITE)
        first = self.n.some_kid(vp & self.head("VB") & (self.n.kid == 0))
        kid = self.n.some_kid(vp & (finite | (self.cc & self.n.some_kid(vp & finite))))
        return self.label(*CLAUSE) & ((self.parent("ROOT") & first) | finite | kid)

    @cached_property
    def DC(self):
        return self.label("SBAR") & self.n.some_kid(self.C1)

    @cached_property
    def T1(self):
        clause = self.label(*SENTENCE)
        later = clause & (self.n.parent >= 0) & (self.n.kid > self.family(np.minimum, self.n.kid, clause, len(clause)))
        return clause & (self.parent("ROOT") | (later & ~self.n.under(self.label("SBAR", "VP"))))

    @property
    def S(self):
        return self.label("ROOT") & (self.n.parent < 0)

    @property
    def VP1(self):
        return self.label("VP") & self.parent(*CLAUSE)

    @property
    def VP2(self):
        vp = self.label("VP")
        return self.label(*FINITE) & self.parent("SQ") & (self.family(np.maximum, vp.astype(int), vp, 0) == 0)

    @property
    def C2(self):
        return self.label("FRAG") & self.parent("ROOT") & ~self.n.over(self.C1)

    @property
    def T2(self):
        return self.label("FRAG") & self.parent("ROOT") & ~self.n.over(self.T1)

    @property
    def CN1(self):
        np_ = self.label("NP")
        joined = np_ & (self.n.parent >= 0) & (self.n.kid < self.family(np.maximum, self.n.kid, np_, -1)) & ~self.after("CC")
        return np_ & ~self.parent("NP") & self.n.over(self.label(*NOMINAL) | joined)

    @property
    def CN2(self):
        that = self.n.some_kid(self.label(*THAT))
        first = self.n.some_kid(self.label("S") & (self.n.kid == 0))
        intro = self.head("WHNP") | (self.head("IN") & np.append(that, False)[self.n.once(head_children)]) | first
        return self.label("SBAR") & intro & (self.after("VP") | self.parent("VP"))

    @property
    def CN3(self):
        return self.label("S") & self.after("VP") & self.n.some_kid(self.label("VP") & self.head("VBG", "TO"))

    @property
    def CT(self):
        return self.T1 & self.n.over(self.DC)

    @property
    def CP(self):
        return self.label("ADJP", "ADVP", "NP", "VP") & self.cc


def found_in_place(forests: DataFrame, name: str, partitioned: bool = False) -> DataFrame:
    """doc_id, tree_id and st of a structure's matches, found where the forests lie."""
    return trees.shred_in_place(forests, "tree_id", "st", chosen=lambda nodes: getattr(Structures(nodes), name), partitioned=partitioned)


def counts_in_place(forests: DataFrame, names=("W", *PRIMITIVES), partitioned: bool = False) -> DataFrame:
    """doc_id and the named counts of every document, a row each, counted where the forests lie; a document without doc_id counts no structures."""
    structures = [n for n in names if n != "W"]
    words = F.coalesce(F.regexp_count("forest", F.lit(WORD_IN_PLACE)), F.lit(0)).cast("long").alias("W")
    if not structures:
        return forests.select("doc_id", *(words for _ in names))

    def run(batches):
        for batch in batches:
            tokens, out = batch.column("tokens"), np.zeros((len(structures), len(batch)), np.int64)
            for x, y in trees.whole_parts(tokens, trees.TOKENS):
                flags = {n: ("boolean", lambda nodes, rows, n=n: pa.array(getattr(nodes.once(Structures), n)[rows])) for n in structures}
                for doc, columns in trees.nodes_of(tokens.slice(x, y - x), (), flags):
                    for i, flag in enumerate(columns):
                        out[i, x:y] += np.bincount(doc[flag.to_numpy(zero_copy_only=False)], minlength=y - x)
            out[:, batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)] = 0
            found = dict(zip(structures, map(pa.array, out), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column("W") if n == "W" else found[n] for n in names)], names=["doc_id", *names])

    kind = forests.schema["doc_id"].dataType.simpleString()
    return trees.tokens_of(forests, partitioned, words).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}")
