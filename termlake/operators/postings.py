"""Token, postings, vocabulary and field-length tables of a set of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import KEY, TEXT_FIELDS
from .rank import FieldStats


def with_key(docs: DataFrame) -> DataFrame:
    """Give plain documents, one row per path, the full row key."""
    for name in KEY[1:]:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(0).cast("int" if name == "copy" else "bigint"))
    return docs


def _short(term, max_token_bytes: int | None):
    """Whether a token is searchable: every one, unless the caller sets a limit."""
    return F.lit(True) if max_token_bytes is None else F.octet_length(term) < max_token_bytes


def tokenize(docs: DataFrame, field: str = "content", max_token_bytes: int | None = None) -> DataFrame:
    """One row per token: (path, pos, term). Tokens of ``max_token_bytes`` UTF-8
    bytes or more, if a limit is set, leave a gap."""
    return (docs.select("path", F.posexplode(tokens(F.col(field))).alias("pos", "term"))
            .filter(_short("term", max_token_bytes)))


def index_rows(docs: DataFrame, max_token_bytes: int | None = None) -> DataFrame:
    """(path, copy, gen, term, field, tf, positions, dl), one row per term, field
    and document, plus one row per text field with an empty term that carries the
    field's length. Those length rows stand for "every document" in a search and
    feed the ranking statistics without another look at the text.

    A document is indexed where it is: its tokens are sorted and cut into terms inside
    its own row, so a task sorts one text at a time and never the tokens of all its
    texts. Texts of the same key count as one document, each with positions from 0.
    On documents that are bucketed or partitioned by path this plans no exchange."""
    texts = with_key(docs).groupBy(*KEY).agg(F.collect_list(F.struct("ext", *TEXT_FIELDS)).alias("texts"))
    short = lambda toks: toks if max_token_bytes is None else F.filter(toks, lambda t: _short(t, max_token_bytes))
    toks_of = lambda f, cut: F.struct(F.lit(f).alias("field"), F.transform("texts", lambda t: cut(t[f])).alias("toks"))
    per_field = texts.select(*KEY, F.inline(F.array(*[toks_of(f, tokens) for f in TEXT_FIELDS], toks_of("ext", F.array))))
    verbatim = F.col("field") == "ext"
    placed = lambda toks: F.transform(toks, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    in_order = per_field.select(
        *KEY, "field", F.when(verbatim, 1).otherwise(F.size(short(F.get("toks", F.lit(0))))).alias("dl"),
        F.sort_array(F.flatten(F.transform("toks", placed))).alias("toks"))
    # Where a term begins among the sorted tokens; it ends where the next one begins.
    begins = lambda t, i: (i == 0) | ~t["term"].eqNullSafe(F.get("toks", i - 1)["term"])
    cut = in_order.select("*", F.array_compact(F.transform("toks", lambda t, i: F.when(begins(t, i), i))).alias("first"))
    n_of = lambda at, k: F.coalesce(F.get("first", k + 1), F.size("toks")) - at
    entry = lambda term, tf, positions: F.struct(term.alias("term"), tf.alias("tf"), positions.alias("positions"))
    terms = F.transform("first", lambda at, k: entry(
        F.get("toks", at)["term"], n_of(at, k), F.transform(F.slice("toks", at + 1, n_of(at, k)), lambda t: t["pos"])))
    length = F.array(entry(F.lit(""), F.lit(0), F.array().cast("array<int>")))
    rows = cut.select(*KEY, "field", "dl", F.inline(F.when(verbatim, terms).otherwise(F.concat(terms, length))))
    searchable = rows.filter(verbatim | _short("term", max_token_bytes))
    return searchable.select(*KEY, "term", "field", "tf", "positions", "dl")


def postings(docs: DataFrame, max_token_bytes: int | None = None) -> DataFrame:
    """(term, field, path, tf, positions, dl) of the tokenized fields."""
    return text_rows(index_rows(docs, max_token_bytes)).select(
        "term", "field", "path", "tf", "positions", "dl")


def text_rows(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("term") != "") & F.col("field").isin(*TEXT_FIELDS))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(term, field, df) from postings or index rows. Each document adds one row
    per term, so partial counts leave at most one row per term and task."""
    return text_rows(rows).groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))


def field_lengths(rows: DataFrame) -> DataFrame:
    """(field, n_docs, total_dl) from the length rows."""
    return (rows.filter((F.col("term") == "") & F.col("field").isin(*TEXT_FIELDS))
            .groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_dl")))


def field_stats(rows: DataFrame) -> DataFrame:
    """(field, n_docs, avgdl); an empty field counts with length 0."""
    return field_lengths(rows).select("field", "n_docs", (F.col("total_dl") / F.col("n_docs")).alias("avgdl"))


def stats_map(lengths: DataFrame) -> dict[str, FieldStats]:
    """The per-field statistics as literals: one row per text field."""
    found = {r.field: FieldStats(r.n_docs, r.total_dl / r.n_docs if r.n_docs else 0.0)
             for r in lengths.collect()}
    return {f: found.get(f, FieldStats(0, 0.0)) for f in TEXT_FIELDS}
