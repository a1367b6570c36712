"""Excerpts. Applied to the hits of a search only, after the top-k cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PIECES, _col

SNIPPET_CHARS = 220  # fixed value

BLANK, NOT_BLANK = r"[\t-\r\x{85}\p{Z}]", r"[^\t-\r\x{85}\p{Z}]"


def _escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _escape_quotes(c: Column) -> Column:
    return F.replace(F.replace(_escape(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def pieces(text) -> Column:
    """The text cut into alternating token and gap pieces; joins back to it."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(PIECES), F.lit(0))


def snippet_highlight(text, terms: list[str]) -> Column:
    """Escape the text and wrap every token that is one of ``terms`` in <b>."""
    if not terms:
        return _escape_quotes(F.coalesce(_col(text), F.lit("")))
    return F.array_join(F.transform(
        pieces(text),
        lambda x: F.when(F.lower(x).isin(terms),
                         F.concat(F.lit("<b>"), _escape_quotes(x), F.lit("</b>")))
                   .otherwise(_escape_quotes(x))), "")


def best_window(text, weights: dict[str, float], max_chars: int = SNIPPET_CHARS) -> Column:
    """struct(start, end, weight) of the best window, in characters.

    Tokens fill a window until the next one would end past ``max_chars``; a
    window weighs the sum of its tokens' weights; the earliest of the best wins.
    One fold over the pieces that carries the open window and the best so far,
    so a long text costs linear time and constant state."""
    table = F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv]) if weights else None

    def token_weight(x: Column) -> Column:
        if table is None:
            return F.lit(0.0)
        return F.coalesce(F.try_element_at(table, F.lower(x)), F.lit(0.0))

    zero = F.struct(
        F.lit(0).alias("pos"), F.lit(-1).alias("s"), F.lit(0).alias("e"), F.lit(0.0).alias("w"),
        F.lit(0).alias("bs"), F.lit(0).alias("be"), F.lit(0.0).alias("bw"))

    def step(a: Column, x: Column) -> Column:
        end = a["pos"] + F.char_length(x)
        is_tok = x.rlike(r"\A[\p{L}\p{N}]")
        opens = (a["s"] < 0) | (end - a["s"] > max_chars)
        s = F.when(opens, a["pos"]).otherwise(a["s"])
        w = F.when(opens, F.lit(0.0)).otherwise(a["w"]) + token_weight(x)
        better = w > a["bw"] + 1e-12
        grown = F.struct(
            end.alias("pos"), s.alias("s"), end.alias("e"), w.alias("w"),
            F.when(better, s).otherwise(a["bs"]).alias("bs"),
            # the window that is best so far keeps growing while it is open
            F.when(better | ((s == a["bs"]) & (a["bw"] > 0)), end).otherwise(a["be"]).alias("be"),
            F.when(better, w).otherwise(a["bw"]).alias("bw"))
        kept = F.struct(end.alias("pos"), a["s"].alias("s"), a["e"].alias("e"), a["w"].alias("w"),
                        a["bs"].alias("bs"), a["be"].alias("be"), a["bw"].alias("bw"))
        return F.when(is_tok, grown).otherwise(kept)

    return F.aggregate(pieces(text), zero, step, lambda a: F.struct(
        a["bs"].alias("start"), a["be"].alias("end"), a["bw"].alias("weight")))


def snippet_fallback(text, max_chars: int = SNIPPET_CHARS) -> Column:
    """Start of the trimmed text, escaped: shown when no content word matched."""
    trimmed = F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"\A{BLANK}+", "")
    head = F.substring(trimmed, 1, max_chars)
    # Only a text that ends inside the head can have trailing blanks there.
    tail = F.regexp_replace(head, rf"{BLANK}+\z", "")
    rest_blank = ~F.substring(trimmed, max_chars + 1, 2147483647).rlike(NOT_BLANK)
    return _escape(F.when(rest_blank, tail).otherwise(head))


def with_snippet(hits, weights: dict[str, float], max_chars: int = SNIPPET_CHARS):
    """Add ``snippet`` to rows that carry ``content``."""
    if not weights:
        return hits.withColumn("snippet", snippet_fallback("content", max_chars))
    win = hits.withColumn("_w", best_window("content", weights, max_chars))
    part = F.substring(F.col("content"), F.col("_w.start") + 1, F.col("_w.end") - F.col("_w.start"))
    return win.withColumn("snippet", F.when(
        F.col("_w.weight") > 0, snippet_highlight(part, sorted(weights))
    ).otherwise(snippet_fallback("content", max_chars))).drop("_w")


def snippet_text(snippet) -> Column:
    """Markup back to plain text on one line."""
    c = _col(snippet)
    for mark, plain in (("<b>", ""), ("</b>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                        ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return F.translate(c, "\n\r", "  ")
