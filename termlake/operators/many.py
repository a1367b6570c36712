"""Many searches in one job: a DataFrame of queries against one collection.

Conditions are rows. Each different one is a leaf, whatever number of queries have
it: its words, or the terms that its pattern has in the vocabulary, are joined with
the postings once, and it gets a score for each document. Queries then only add up
the scores of their leaves."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.fuzzy import rests_of, within_distance_of
from ..functions.text import glob_pattern, tokens
from ..schema import KEY, TEXT_FIELDS, VERBATIM_FIELDS
from .conditions import BARE_ANCHORS, BRACKETS, UNSUPPORTED, Condition, groups_of
from .match import SearchTables
from .near import starts
from .rank import SCORE_DIGITS, bm25

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Rows of leaves, of their terms, or of queries that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_LEAVES = 200_000
KINDS = ("word", "phrase", "near", "wildcard", "regex", "fuzzy", "field", "all")
COLUMNS = {"kind": "string", "text": "string", "bound": "int", "field": "string"}
ROWS = "query_id string, grp int, kind string, text string, bound int, field string, negate boolean"


def query_rows(spark: SparkSession, queries: Iterable[tuple[str, Condition | None]]) -> DataFrame:
    """Conditions built in Python, by query id, as rows for ``search_many``. A blank
    query, None, has a row that no document meets."""
    rows = []
    for query_id, condition in queries:
        if condition is None:
            rows.append((query_id, 0, "word", "", 0, None, False))
            continue
        for grp, group in enumerate(groups_of(condition)):
            for leaf, required in group:
                kind, field = {"glob": "wildcard", "equal": "field"}.get(leaf.kind, leaf.kind), None
                if leaf.kind == "words":
                    kind = "near" if leaf.is_near else "phrase"
                    field = None if leaf.fields == TEXT_FIELDS else leaf.fields[0]
                elif leaf.kind == "equal":
                    field = leaf.fields[0]
                rows.append((query_id, grp, kind, leaf.text, leaf.bound, field, not required))
    return spark.createDataFrame(rows, ROWS)


def _checked(queries: DataFrame) -> DataFrame:
    """(query_id, grp, negate, kind, text, bound, field), every kind known and every
    pattern and field fit to be searched. A row without kind is a ``word``, which is
    in the column ``word`` or ``text``."""
    have = queries.columns
    column = lambda name: F.col(name).cast(COLUMNS[name]) if name in have else F.lit(None).cast(COLUMNS[name])
    text = F.coalesce(column("text"), F.col("word") if "word" in have else F.lit(None).cast("string"), F.lit(""))
    rows = queries.select("query_id", "grp", F.coalesce(F.col("negate"), F.lit(False)).alias("negate"),
                          F.coalesce(column("kind"), F.lit("word")).alias("kind"), text.alias("text"),
                          F.coalesce(column("bound"), F.lit(0)).alias("bound"), column("field").alias("field"))
    pattern = F.col("kind").isin("wildcard", "regex", "fuzzy")
    rows = rows.withColumn("text", F.when(pattern, F.lower("text")).otherwise(F.col("text")))
    rows = rows.withColumn("bound", F.when(F.col("kind") == "fuzzy", F.least(F.greatest("bound", F.lit(1)), F.lit(2))).otherwise(F.col("bound")))
    bare = F.regexp_replace("text", r"\\\\", "")
    bad = F.when(~F.col("kind").isin(*KINDS), F.concat(F.lit("no such kind of condition: "), "kind"))
    bad = bad.when((F.col("kind") == "regex") & (bare.rlike(UNSUPPORTED) | F.regexp_replace(bare, BRACKETS, "").rlike(BARE_ANCHORS)),
                   F.concat(F.lit("unsupported construct in pattern "), "text"))
    bad = bad.when(pattern & (F.col("text") == ""), F.lit("empty pattern"))
    bad = bad.when((F.col("kind") == "field") & ~F.coalesce(F.col("field").isin(*TEXT_FIELDS, *VERBATIM_FIELDS), F.lit(False)),
                   F.concat(F.lit("no searchable field named "), F.coalesce("field", F.lit("null"))))
    return rows.withColumn("kind", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("kind")))


def _words(leaves: DataFrame) -> DataFrame:
    """(leaf, off, term, field, n_words, bound) of leaves that look for words."""
    texts = leaves.filter(F.col("kind").isin("word", "phrase", "near") | ((F.col("kind") == "field") & F.col("field").isin(*TEXT_FIELDS)))
    toks = texts.withColumn("toks", tokens("text")).withColumn("bound", F.when(F.col("kind") == "near", F.col("bound")).otherwise(0))
    fields = F.when(F.col("field").isNull(), F.array(*map(F.lit, TEXT_FIELDS))).otherwise(F.array("field"))
    return toks.select("leaf", F.explode(fields).alias("field"), F.size("toks").alias("n_words"), "bound", "toks").select(
        "leaf", "field", "n_words", "bound", F.posexplode("toks").alias("off", "term"))


def _fits(term: Column) -> Column:
    """Does a term of the vocabulary match the leaf of the row?"""
    whole = F.concat(F.lit(r"\A(?:"), F.when(F.col("kind") == "wildcard", glob_pattern("text")).otherwise(F.col("text")), F.lit(r")\z"))
    return F.when(F.col("kind") == "fuzzy", within_distance_of(term, F.col("text"), F.col("bound"))).otherwise(F.rlike(term, whole))


def _exact(leaves: DataFrame) -> DataFrame:
    """(leaf, term, field) of the leaves that are single rows of the index: a verbatim
    field, every document, and ``*``, which any document with a token meets."""
    one = leaves.filter(((F.col("kind") == "field") & F.col("field").isin(*VERBATIM_FIELDS)) | (F.col("kind") == "all")
                        | ((F.col("kind") == "wildcard") & F.col("text").rlike(r"\A\*+\z")))
    ext = (F.col("kind") == "field") & (F.col("field") == "ext")
    return one.select("leaf", F.when(ext, F.col("text")).otherwise("").alias("term"), F.when(ext, "ext").otherwise("content").alias("field"),
                      F.when((F.col("kind") == "field") & (F.col("field") == "path"), F.col("text")).alias("only_path"),
                      (F.col("kind") == "wildcard").alias("has_tokens"))


@F.pandas_udf(IntegerType())
def _near_count(positions: pd.Series, terms: pd.Series, bound: pd.Series) -> pd.Series:
    """Starts of affordable placements: a row's words in order, each with positions."""
    out = []
    for places, words, slop in zip(positions, terms, bound, strict=True):
        names = list(dict.fromkeys(words))
        slots = [names.index(w) for w in words]
        out.append(len(starts([places[slots.index(s)] for s in range(len(names))], list(range(len(words))), slots, int(slop))))
    return pd.Series(out, dtype="int32")


def _phrase_count(found: Column) -> Column:
    """Starts at which all words follow each other, from (off, positions) in order."""
    shifted = lambda x: F.transform(x["positions"], lambda p: p - x["off"])
    rest = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.size(F.aggregate(rest, shifted(found[0]), lambda acc, x: F.array_intersect(acc, shifted(x))))


def _word_scores(tables: SearchTables, words: DataFrame, hint) -> DataFrame:
    """(leaf, key, score) of the documents in which words, phrases and near words are."""
    df = (tables.vocab.join(hint(words.select("term").distinct()), "term", "left_semi")
          .groupBy("term", "field").agg(F.sum("df").alias("df")))
    n, avgdl = F.lit(0), F.lit(1.0)
    for f, s in tables.stats.items():
        n = F.when(F.col("field") == f, s.n_docs).otherwise(n)
        avgdl = F.when(F.col("field") == f, s.avgdl or 1.0).otherwise(avgdl)
    known = F.coalesce(F.col("df"), F.lit(0))
    weight = words.join(df, ["term", "field"], "left").groupBy("leaf", "field").agg(
        F.sum(F.log(1 + (n - known + 0.5) / (known + 0.5))).alias("idf"))
    asked = words.join(weight, ["leaf", "field"])
    score = bm25(F.col("tf"), F.col("dl"), F.col("idf"), avgdl)
    add = lambda rows: rows.select("leaf", *KEY, score.alias("score")).groupBy("leaf", *KEY).agg(F.sum("score").alias("score"))

    single = tables.index.join(hint(asked.filter("n_words = 1")), ["term", "field"])
    several = tables.index.join(hint(asked.filter("n_words > 1")), ["term", "field"]).groupBy("leaf", "field", *KEY).agg(
        F.array_sort(F.collect_list(F.struct("off", "positions", "term"))).alias("found"), F.first("dl").alias("dl"),
        F.first("idf").alias("idf"), F.first("n_words").alias("n_words"), F.first("bound").alias("bound"))
    several = several.filter(F.size("found") == F.col("n_words"))
    next_to = several.filter("bound = 0").withColumn("tf", _phrase_count(F.col("found")))
    near = several.filter("bound > 0").withColumn("tf", _near_count(
        F.transform("found", lambda x: x["positions"]), F.transform("found", lambda x: x["term"]), F.col("bound")))
    columns = ["leaf", "field", *KEY, "tf", "dl", "idf"]
    return add(single.select(*columns).unionByName(next_to.filter("tf > 0").select(*columns)).unionByName(near.filter("tf > 0").select(*columns)))


def search_many(tables: SearchTables, queries: DataFrame, limit: int,
                live: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, rank, path, score): the best ``limit`` documents of each query, as
    ``search`` would find them one query after the other.

    ``queries`` has a row per condition: (query_id, grp, kind, text, bound, field,
    negate). ``kind`` is one of ``KINDS``; ``bound`` is the slop of ``near`` and the
    distance of ``fuzzy``; ``field`` is for ``field``. Conditions of a group are all
    required or excluded, groups of a query are alternatives, and a group of
    exclusions takes them from every document. A condition without words, as from
    a blank query, is met by nothing.

    While leaves and their terms fit a broadcast, postings keep their bucketing
    through the joins, and everything up to the per-query cut runs without an
    exchange. More of them are joined by a shuffle, in which adaptive execution
    splits frequent terms. The window keeps ``limit`` rows per query and task
    before it shuffles."""
    rows = _checked(queries)
    bare = rows.groupBy("query_id", "grp").agg(F.bool_and("negate").alias("bare")).filter("bare")
    every = bare.select("query_id", "grp", F.lit(False).alias("negate"), F.lit("all").alias("kind"), F.lit("").alias("text"),
                        F.lit(0).alias("bound"), F.lit(None).cast("string").alias("field"))
    rows = rows.unionByName(every)
    leaf = F.sha2(F.concat_ws("\u0001", "kind", F.coalesce("field", F.lit("\u0002")), F.col("bound").cast("string"), "text"), 256)
    rows = rows.withColumn("leaf", leaf).distinct()
    leaves = rows.select("leaf", "kind", "text", "bound", "field").distinct()
    small = lambda df: df.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES
    hint = F.broadcast if small(rows) else (lambda df: df)

    words, exact = _words(leaves), _exact(leaves)
    patterns = leaves.filter(F.col("kind").isin("wildcard", "regex", "fuzzy")).join(exact.select("leaf"), "leaf", "left_anti")
    vocab = tables.vocab.filter("field = 'content'").select("term").distinct()
    if tables.rests is None:
        fitting = vocab.join(hint(patterns), _fits(F.col("term"))).select("leaf", "term")
    else:  # fuzzy words meet terms by an equality, on what is left without some letters
        fuzzy = patterns.filter("kind = 'fuzzy'").withColumn("rest", F.explode(rests_of(F.col("text"))))
        near_terms = tables.rests.join(hint(fuzzy), "rest").filter(_fits(F.col("term"))).select("leaf", "term").distinct()
        fitting = vocab.join(hint(patterns.filter("kind <> 'fuzzy'")), _fits(F.col("term"))).select("leaf", "term").unionByName(near_terms)
    expanded = fitting.select(
        "leaf", "term", F.lit("content").alias("field"), F.lit(None).cast("string").alias("only_path"), F.lit(False).alias("has_tokens"))
    named = exact.unionByName(expanded)
    named = F.broadcast(named) if small(named) else named
    index = tables.index
    plain = index.join(named, ["term", "field"]).filter(
        F.coalesce(F.col("path") == F.col("only_path"), F.lit(True)) & (~F.col("has_tokens") | (F.col("dl") > 0)))
    hits = _word_scores(tables, words, hint).unionByName(plain.select("leaf", *KEY).distinct().withColumn("score", F.lit(1.0)))

    groups = rows.groupBy("query_id", "grp").agg(F.count_if(~F.col("negate")).alias("required"))
    asked = rows.select("query_id", "grp", "negate", "leaf")
    by_group = hits.join(hint(asked), "leaf").groupBy("query_id", "grp", *KEY).agg(
        F.sum(F.when(~F.col("negate"), F.col("score"))).alias("score"), F.count_if(~F.col("negate")).alias("found"),
        F.max("negate").alias("excluded"))
    matched = (by_group.filter(~F.col("excluded")).join(hint(groups), ["query_id", "grp"])
               .filter(F.col("found") == F.col("required")))
    by_doc = live(matched.groupBy("query_id", *KEY).agg(F.round(F.sum("score"), SCORE_DIGITS).alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    return (by_doc.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select("query_id", "rank", "path", "score"))
