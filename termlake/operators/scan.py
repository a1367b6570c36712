"""Evaluate a condition on a documents DataFrame directly, without any prepared
table: a narrow pass over the text, for one-off filters. Independent of the
postings form, which the tests compare it with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import TEXT_FIELDS
from .conditions import Condition, Leaf, groups_of
from .match import pattern_test, shift
from .near import near_starts
from .rank import group_flag

def _positions(toks: Column, word: str) -> Column:
    """Positions of a word in the token array."""
    return F.filter(F.transform(toks, lambda t, i: F.when(t == word, i)), lambda i: i.isNotNull())


def _words_flag(leaf: Leaf, toks: Column) -> Column:
    words = leaf.words
    if not words:
        return F.lit(False)
    if leaf.is_term:
        return F.array_contains(toks, words[0][1])
    if leaf.bound == 0:
        starts = [shift(_positions(toks, w), o) for o, w in words]
        out = starts[0]
        for s in starts[1:]:
            out = F.array_intersect(out, s)
        return F.size(out) > 0
    return F.size(near_starts({w: _positions(toks, w) for _, w in words}, words, leaf.bound)) > 0


def _repeats(leaf: Leaf) -> bool:
    return leaf.is_near and len({w for _, w in leaf.words}) < len(leaf.words)


def leaf_flag(leaf: Leaf, toks: dict[str, Column]) -> Column:
    """The condition as a boolean over a document and its token arrays."""
    if leaf.kind == "all":
        return F.lit(True)
    if leaf.kind == "equal":
        return F.col(leaf.fields[0]) == leaf.text
    if leaf.kind == "words":
        flag = F.lit(False)
        for f in leaf.fields:
            flag = flag | F.coalesce(_words_flag(leaf, toks[f]), F.lit(False))
        return flag
    return F.exists(toks["content"], lambda t: pattern_test(leaf, t))


def scan(docs: DataFrame, condition: Condition) -> DataFrame:
    """The documents that match, unranked. A condition on ext or path only is a
    plain predicate, which the scan of the documents can push down."""
    groups = groups_of(condition)

    # Proximity of a word with itself is settled ahead, outside of any lambda.
    ahead = {l: f"__near{i}" for i, l in enumerate(dict.fromkeys(l for g in groups for l, _ in g)) if _repeats(l)}

    def flag(toks: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a | b, (group_flag(g, {
            l: F.col(ahead[l]) if l in ahead else leaf_flag(l, toks) for l, _ in g}) for g in groups))

    if not {l.kind for g in groups for l, _ in g} - {"all", "equal"}:
        return docs.filter(flag({}))
    columns = docs.columns
    for leaf, name in ahead.items():
        docs = docs.withColumn(name, leaf_flag(leaf, {f: tokens(F.col(f)) for f in TEXT_FIELDS}))
    # The token arrays are bound as a lambda's variable: as a plain column the
    # optimizer would copy the tokenizer into every place that reads them.
    both = F.struct(*[tokens(F.col(f)).alias(f) for f in TEXT_FIELDS])
    return docs.filter(F.exists(F.array(both), lambda d: flag({f: d[f] for f in TEXT_FIELDS}))).select(*[F.col(f"`{c}`") for c in columns])
