"""Quality rules: a table of thresholds compiled into projections.

Each rule names a ratio and the range it may lie in. ``measured`` gives the counts
of the texts, ``RATIOS`` what is derived from them, and ``verdict`` the conjunction
of all rules, all of it built-in functions over the row itself: the operator neither
shuffles nor starts Python.

A null text has no words. The base rule fails below 50 words, so null, empty and
very short texts fail it. Repeated rows and documents with the same id are judged
one by one; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Lower bits of a sorted window hash that hold its place in the text.
PLACE_BITS = 20
MAX_REPEATED_PERCENT = 50

#: Frequent function words of the languages that are judged.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "with", "on", "be", "are", "this", "by"),
    "de": ("der", "die", "und", "das", "von", "zu", "mit", "den", "des", "ist", "nicht", "ein", "auf", "auch", "im"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "qui", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una"),
}


@dataclass(frozen=True)
class Rule:
    """``ratio`` must lie in [low, high]; None leaves a side open."""
    ratio: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.20),
    Rule("stop_word_ratio", 0.06, None),
    Rule("dup_line_ratio", None, 0.40),
    Rule("repeat_word_ratio", None, 0.50),
    Rule("upper_ratio", None, 0.50),
)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), use)[0]


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of every three consecutive words."""
    return let(words, lambda w: F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))


def placed(hashes: Column) -> Column:
    """The places of ``hashes`` in the order of their upper bits: each a number with
    the upper bits of the hash and, in the lower ones, the place."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(_upper(h), PLACE_BITS).bitwiseOR(i)))


def _upper(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _words_at(places: Column) -> Column:
    """How many words the windows at ``places`` have."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))


def _by_whole_hashes(hashes: Column) -> Column:
    """``repeated_words`` by an order of whole hashes with their places."""
    def places(ordered):
        after = F.slice(ordered, 2, F.size(ordered))
        pairs = F.filter(F.arrays_zip(ordered.alias("x"), after.alias("y")), lambda p: p["x"]["h"] == p["y"]["h"])
        return _words_at(F.flatten(F.transform(pairs, lambda p: F.array(p["x"]["i"], p["y"]["i"]))))

    return let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)


def repeated_words(hashes: Column, different: Column, ordered: Column) -> Column:
    """Words that lie in a window of three found twice or more, from the hashes of the
    windows, the number of different ones and ``placed`` of them. Hashes that agree in
    their upper bits are neighbours there; if two of them are not equal, or the places do
    not fit into the lower bits, whole hashes are sorted. What is looked up for each
    window is bound by ``let``: a filter on the result that moves below the projections
    would have a column computed anew for each window."""
    def near(x, i, array):
        return (_upper(x) == _upper(F.get(array, i - 1))) | (_upper(x) == _upper(F.get(array, i + 1)))

    def differs(x, i, array, own):
        before = F.get(array, i - 1)
        return (_upper(x) == _upper(before)) & (F.get(own, _place(x)) != F.get(own, _place(before)))

    def count(found, own):
        clash = F.size(F.filter(found, lambda x, i: differs(x, i, found, own))) > 0
        return F.when(clash, _by_whole_hashes(own)).otherwise(_words_at(F.transform(found, _place)))

    def by_upper_bits(own):
        return let(ordered, lambda o: let(F.filter(o, lambda x, i: near(x, i, o)), lambda found: count(found, own)))

    return let(hashes, lambda own: F.when(different == F.size(own), F.lit(0))
               .when(F.size(own) <= F.lit(1 << PLACE_BITS), by_upper_bits(own))
               .otherwise(_by_whole_hashes(own))).cast("long")


def measured(texts: DataFrame, stop_words: tuple = ()) -> DataFrame:
    """``doc_id`` and the counts of each ``text``, which is not null. What several
    counts need is a column of a projection of its own, so it is computed once."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    parts = texts.select("doc_id", "text", F.array_remove(F.split("text", SPACE + "+"), "").alias("words"), lines.alias("lines"),
                         F.regexp_replace("text", r"\P{L}+", "").alias("letters"))
    hashed = parts.withColumn("hashes", window_hashes(F.col("words")))
    ready = hashed.withColumns({"different": F.size(F.array_distinct("hashes")), "ordered": placed(F.col("hashes"))})
    stop, longest = [F.lit(w) for w in stop_words], max(map(len, stop_words), default=0)
    return ready.select("doc_id", *[c.cast("long").alias(name) for name, c in {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("hashes"), F.col("different"), F.col("ordered")),
        "n_upper": F.char_length(F.regexp_replace("letters", r"\P{Lu}+", "")),
        "n_letters": F.char_length("letters"),
        "n_stop_words": F.size(F.filter("words", lambda x: (F.char_length(x) <= longest) & F.lower(x).isin(*stop))) if stop else F.lit(0),
    }.items()])


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


RATIOS = {
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_word_ratio": lambda: _ratio("n_repeat_words", "n_words"),
    "upper_ratio": lambda: _ratio("n_upper", "n_letters"),
}


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of rules as one condition over the counts."""
    ok = F.lit(True)
    for rule in rules:
        value = RATIOS[rule.ratio]()
        if rule.low is not None:
            ok = ok & (value >= rule.low)
        if rule.high is not None:
            ok = ok & (value <= rule.high)
    return ok


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
            languages: tuple = tuple(STOP_WORDS)) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed and kept."""
    stop = tuple(dict.fromkeys(w for x in languages for w in STOP_WORDS[x]))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    counts = measured(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")), stop)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
