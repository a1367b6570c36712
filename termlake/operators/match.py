"""Evaluate a condition over postings: one filtered scan, one aggregation by
document, then plain columns. On postings bucketed by path nothing is shuffled
before the top-k."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import rests, within_distance
from ..functions.text import glob_to_regex, literal_runs, required_gram, whole_token
from ..schema import KEY, TEXT_FIELDS
from .conditions import Condition, Leaf, groups_of, leaves_of
from .near import all_present, near_starts
from .rank import FieldStats, bm25, combine, idf

# A pattern that expands to at most this many terms is searched by those terms,
# which the parquet scan can use; a wider one is tested on the postings rows.
MAX_EXPANSION = 5000

ANY = lambda cols: reduce(lambda a, b: a | b, cols)


@dataclass
class SearchTables:
    """What a search reads. ``index`` are index rows, ``vocab`` (term, field, df)
    where several rows of a term add up, ``stats`` the per-field statistics,
    ``grams`` (gram, term) the content terms that hold a run of three characters,
    ``rests`` (rest, term) those of which a rest is left without up to two letters."""
    index: DataFrame
    vocab: DataFrame
    stats: dict[str, FieldStats]
    grams: DataFrame | None = None
    rests: DataFrame | None = None


@dataclass
class Resolved:
    """Vocabulary look-ups of a condition: a bounded number of literals."""
    df: dict[tuple[str, str], int] = field(default_factory=dict)
    expansion: dict[Leaf, list[str] | None] = field(default_factory=dict)


def pattern_test(leaf: Leaf, term: Column) -> Column:
    """Does a token match a wildcard, regular expression or fuzzy word?"""
    if leaf.kind == "fuzzy":
        return within_distance(term, leaf.text, leaf.bound)
    if leaf.kind == "glob":
        body = leaf.text.rstrip("*")
        if body != leaf.text and not set(body) & set("*?"):
            return term.startswith(body)
        pattern = glob_to_regex(leaf.text)
    else:
        pattern = leaf.text
    return term.rlike(whole_token(pattern))


def _is_prefix(leaf: Leaf) -> bool:
    body = leaf.text.rstrip("*")
    return leaf.kind == "glob" and bool(body) and body != leaf.text and not set(body) & set("*?")


def _is_any(leaf: Leaf) -> bool:
    return leaf.kind == "glob" and not leaf.text.strip("*")


def candidates(leaf: Leaf, vocab: DataFrame, grams: DataFrame | None, by_rest: DataFrame | None = None) -> DataFrame:
    """The content terms a pattern is tested on: those with three characters that it
    demands, or all if it demands none; for a fuzzy word those that share a rest with
    it. Grams and rests are sorted, so few are read."""
    if leaf.kind == "fuzzy" and by_rest is not None:
        keys = rests(leaf.text, leaf.bound)
        tens = [keys[i:i + 10] for i in range(0, len(keys), 10)]  # longer lists reach the scan as one range only
        return by_rest.filter(ANY([F.col("rest").isin(ten) for ten in tens])).select("term")
    runs = re.split(r"[*?]", leaf.text) if leaf.kind == "glob" else literal_runs(leaf.text) if leaf.kind == "regex" else []
    gram = required_gram(runs)
    if grams is None or gram is None:
        return vocab.filter(F.col("field") == "content").select("term")
    return grams.filter(F.col("gram") == gram).select("term")


def resolve(vocab: DataFrame, leaves: list[Leaf], max_expansion: int = MAX_EXPANSION, grams: DataFrame | None = None,
            by_rest: DataFrame | None = None) -> Resolved:
    out = Resolved()
    words = sorted({w for l in leaves if l.kind == "words" for _, w in l.words})
    if words:
        rows = vocab.filter(F.col("term").isin(words)).groupBy("term", "field").agg(F.sum("df").alias("df"))
        out.df = {(r.term, r.field): r.df for r in rows.collect()}  # at most words x fields rows
    for leaf in leaves:
        if leaf.kind not in ("glob", "regex", "fuzzy") or _is_any(leaf) or _is_prefix(leaf):
            continue
        if leaf.kind == "regex":
            check_pattern(vocab, leaf)
        hits = (candidates(leaf, vocab, grams, by_rest).filter(pattern_test(leaf, F.col("term")))
                .distinct().limit(max_expansion + 1).collect())
        out.expansion[leaf] = sorted(r.term for r in hits) if len(hits) <= max_expansion else None
    return out


def check_pattern(vocab: DataFrame, leaf: Leaf) -> None:
    """Compile a pattern ahead, so that a bad one is told whatever the tables hold."""
    try:
        vocab.sparkSession._jvm.java.util.regex.Pattern.compile(whole_token(leaf.text))
    except IllegalArgumentException as e:
        raise ValueError(f"invalid pattern {leaf.text!r}") from e


def row_test(leaf: Leaf, res: Resolved) -> Column:
    """Does an index row bear on the condition?"""
    term, fld = F.col("term"), F.col("field")
    if leaf.kind == "all":
        return (term == "") & (fld == "content")
    if leaf.kind == "equal":
        if leaf.fields == ("path",):
            return (term == "") & (fld == "content") & (F.col("path") == leaf.text)
        return (term == leaf.text) & (fld == leaf.fields[0])
    if leaf.kind == "words":
        words = sorted({w for _, w in leaf.words})
        return (term.isin(words) if words else F.lit(False)) & fld.isin(*leaf.fields)
    if _is_any(leaf):
        return (term == "") & (fld == "content") & (F.col("dl") > 0)
    terms = res.expansion.get(leaf)
    if terms is not None:
        return (term.isin(terms) if terms else F.lit(False)) & (fld == "content")
    return (term != "") & (fld == "content") & pattern_test(leaf, term)


def _weight(leaf: Leaf, fld: str, res: Resolved, stats: dict[str, FieldStats]) -> float:
    return sum(idf(stats[fld].n_docs, res.df.get((w, fld), 0)) for _, w in leaf.words)


def _term_score(leaf: Leaf, res: Resolved, stats: dict[str, FieldStats], tf: Column, dl: Column,
                fld: Column) -> Column:
    """BM25 of one row of a word's or phrase's field."""
    score = F.lit(0.0)
    for f in leaf.fields:
        if stats[f].avgdl > 0:
            score = F.when(fld == f, bm25(tf, dl, _weight(leaf, f, res, stats), stats[f].avgdl)).otherwise(score)
    return score


def shift(positions: Column, off: int) -> Column:
    return F.transform(positions, lambda p: p - off)


def near_counts(rows: DataFrame, leaf: Leaf) -> DataFrame:
    """(key, field, tf, dl): starts from which the words are within the slop.

    Positions go into blocks at least as wide as the reach of a match, each with
    its neighbours, so one group never holds more than three blocks' positions
    however long the document. Groups keep the document's key, so bucketed
    postings are not shuffled."""
    offs = [o for o, _ in leaf.words]
    distinct = sorted({w for _, w in leaf.words})
    width = max(64, leaf.bound + max(offs) - min(offs))
    pos = rows.filter(row_test(leaf, Resolved())).select(
        *KEY, "field", "term", "dl", F.explode("positions").alias("p"))
    home = F.floor(F.col("p") / width)
    near = pos.select("*", F.explode(F.array(home - 1, home, home + 1)).alias("block"))
    # Documents without every word have groups that lack one; they drop out here.
    grouped = near.groupBy(*KEY, "field", "block").agg(
        F.first("dl").alias("dl"),
        *[F.collect_list(F.when(F.col("term") == w, F.col("p"))).alias(f"p{i}")
          for i, w in enumerate(distinct)])
    place = {w: F.col(f"p{i}") for i, w in enumerate(distinct)}
    grouped = grouped.filter(all_present(place))
    mine = F.filter(near_starts(place, leaf.words, leaf.bound), lambda p: F.floor(p / width) == F.col("block"))
    starts = F.size(mine)
    return (grouped.select(*KEY, "field", "dl", starts.alias("n"))
            .groupBy(*KEY, "field").agg(F.first("dl").alias("dl"), F.sum("n").alias("tf"))
            .filter("tf > 0"))


def matches(tables: SearchTables, condition: Condition, res: Resolved | None = None) -> DataFrame:
    """(path, copy, gen, score) of every matching document."""
    groups = groups_of(condition)
    leaves = leaves_of(groups)
    res = res or resolve(tables.vocab, leaves, grams=tables.grams, by_rest=tables.rests)
    stats = tables.stats
    rows = tables.index
    plain = [l for l in leaves if not l.is_near]
    nears = [l for l in leaves if l.is_near]
    name = {l: f"l{i}" for i, l in enumerate(leaves)}

    aggs: dict[str, Column] = {}
    score: dict[Leaf, Column] = {}
    for l in plain:
        if l.kind == "words" and not l.is_term:
            score[l] = _phrase(l, name[l], res, stats, aggs)
        elif l.kind == "words":
            s = _term_score(l, res, stats, F.col("tf"), F.col("dl"), F.col("field"))
            aggs[name[l]] = F.sum(F.when(row_test(l, res), s))
            score[l] = F.col(name[l])
        else:
            aggs[name[l]] = F.max(F.when(row_test(l, res), F.lit(1.0)))
            score[l] = F.col(name[l])
    for l in nears:
        aggs[name[l]] = F.sum(F.when(F.col("near") == leaves.index(l), F.col("near_score")))
        score[l] = F.col(name[l])

    parts = []
    if plain:
        scan = rows.filter(ANY([row_test(l, res) for l in plain]))
        parts.append(scan.select(*KEY, "term", "field", "tf", "dl", "positions")
                     if not nears else scan.select(*KEY, "term", "field", "tf", "dl", "positions",
                                                   F.lit(None).cast("int").alias("near"),
                                                   F.lit(None).cast("double").alias("near_score")))
    for l in nears:
        s = _term_score(l, res, stats, F.col("tf"), F.col("dl"), F.col("field"))
        parts.append(near_counts(rows, l).select(
            *KEY, F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("field"),
            F.lit(None).cast("int").alias("tf"), F.lit(None).cast("int").alias("dl"),
            F.lit(None).cast("array<int>").alias("positions"),
            F.lit(leaves.index(l)).alias("near"), s.alias("near_score")))
    by_doc = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(
        *[c.alias(n) for n, c in aggs.items()])

    # Name each condition's score once, so the boolean part below stays small.
    scored = by_doc.select(*KEY, *[score[l].alias(f"s_{name[l]}") for l in leaves])
    hit = {l: F.col(f"s_{name[l]}").isNotNull() for l in leaves}
    value = {l: F.coalesce(F.col(f"s_{name[l]}"), F.lit(0.0)) for l in leaves}
    matched, total = combine(groups, hit, value)
    return scored.filter(matched).select(*KEY, total.alias("score"))


def _phrase(leaf: Leaf, name: str, res: Resolved, stats: dict[str, FieldStats],
            aggs: dict[str, Column]) -> Column:
    """Exact phrase: positions of each word, shifted to the phrase's start and
    intersected. Registers the position columns, returns the score (null = no)."""
    if not leaf.words:
        aggs[name] = F.max(F.lit(None).cast("double"))
        return F.col(name)
    total, any_hit = F.lit(0.0), F.lit(False)
    for f in leaf.fields:
        starts = None
        for off, w in leaf.words:
            col = f"{name}_{f}_{[x for _, x in leaf.words].index(w)}"
            aggs[col] = F.first(F.when((F.col("term") == w) & (F.col("field") == f), F.col("positions")),
                                ignorenulls=True)
            shifted = shift(F.col(col), off)
            starts = shifted if starts is None else F.array_intersect(starts, shifted)
        dl = f"{name}_{f}_dl"
        aggs[dl] = F.max(F.when((F.col("term") == leaf.words[0][1]) & (F.col("field") == f), F.col("dl")))
        tf = F.coalesce(F.size(starts), F.lit(0))
        found = tf > 0
        any_hit = any_hit | found
        if stats[f].avgdl > 0:
            total = total + F.when(found, bm25(tf, F.col(dl), _weight(leaf, f, res, stats), stats[f].avgdl)
                                   ).otherwise(0.0)
    return F.when(any_hit, total)


def highlight_weights(condition: Condition, res: Resolved) -> dict[str, float]:
    """Content words of the required conditions, rarer ones weighing more."""
    words = {w for g in groups_of(condition) for l, req in g
             if req and l.kind == "words" and "content" in l.fields for _, w in l.words}
    return {w: 1.0 / (1 + res.df.get((w, "content"), 0)) for w in words}
