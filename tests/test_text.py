"""Column functions, with the odd cases they have to get right."""

import re

from pyspark.sql import functions as F

from termlake.functions import text as txt
from termlake.functions.snippet import (best_window, snippet_fallback, snippet_highlight, snippet_text, with_snippet)


def one(spark, value, fn, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(fn(F.col("x"))).first()[0]


def test_tokens(spark):
    t = lambda s: one(spark, s, txt.tokens)
    assert t("The Quick-brown, FOX!") == ["the", "quick", "brown", "fox"]
    assert t("  ") == [] and t("") == [] and t(None) == []
    assert t("Élan über x2_y") == ["élan", "über", "x2", "y"]


def test_names(spark):
    ext = lambda s: one(spark, s, txt.ext_of)
    assert [ext(p) for p in ("a/b.TXT", "a/.env", "x.tar.GZ", "a.d/b", "a/b.", "a/.x.md")] == ["txt", "", "gz", "", "", "md"]
    assert one(spark, "a/b/c.txt", txt.filename_of) == "c.txt"
    slug = lambda s: one(spark, s, txt.slugify)
    assert [slug(s) for s in ("My Notes!", "  C:/Work/2025  ", "***", "É é", "A--b")] == [
        "my-notes", "c-work-2025", "index", "index", "a-b"]


def test_decoding(spark):
    d = lambda b: one(spark, b, txt.decode_text, "binary")
    assert d("naïve 語 😀".encode()) == "naïve 語 😀"
    assert d(b"\xef\xbb\xbf" + "é".encode()) == "é"
    for codec in ("utf-16-le", "utf-16-be"):
        mark = b"\xff\xfe" if codec.endswith("le") else b"\xfe\xff"
        assert d(mark + "語 😀x".encode(codec)) == "語 😀x"
    assert d("café".encode("latin-1")) == "café"
    # malformed input never fails
    assert d(b"\xff\xfe\x00\xd8") and d(b"\xff\xfea") and d(b"\xc3(") and d(b"\xef\xbb\xbf\xc3(")
    binary = lambda b: one(spark, b, txt.looks_binary, "binary")
    assert binary(b"a\0b") and not binary(b"ab") and not binary(b"a" * 8192 + b"\0") and binary(b"a" * 8191 + b"\0")
    assert not binary(b"")


def test_highlight_and_fallback(spark):
    h = lambda s, *w: one(spark, s, lambda c: snippet_highlight(c, list(w)))
    assert h("The fox & 'dog' <i>", "fox", "dog") == "The <b>fox</b> &amp; &#x27;<b>dog</b>&#x27; &lt;i&gt;"
    assert h("Foxes FOX", "fox") == "Foxes <b>FOX</b>"
    f = lambda s: one(spark, s, snippet_fallback)
    assert f("  a<b & c  ") == "a&lt;b &amp; c"
    assert f("\n" + "x" * 219 + " y  ") == "x" * 219 + " "
    assert f("x" * 219 + "   \n") == "x" * 219
    assert one(spark, 'a <b>b</b>\r\n&lt;c&gt; &quot;d&quot; &#x27;&#39; &amp;lt;', snippet_text) == "a b  <c> \"d\" '' &lt;"


def reference_window(text, weights, limit=220):
    best, cur = (0.0, 0, 0), None
    for m in re.finditer(r"[^\W_]+", text):
        if cur is None or m.end() - cur[1] > limit:
            cur = [0.0, m.start(), m.end()]
        cur[0], cur[2] = cur[0] + weights.get(m.group().lower(), 0.0), m.end()
        if cur[0] > best[0] + 1e-12 or (best[1] == cur[1] and best[0] > 0):
            best = tuple(cur)
    return best


def test_best_window(spark, sf_dir):
    weights = {"the": 0.1, "und": 0.3, "de": 0.2}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "text", best_window("text", weights).alias("w")).collect()
    assert len(rows) > 100
    for r in rows:
        w, s, e = reference_window(r.text, weights)
        assert (r.w["start"], r.w["end"]) == (s, e) and abs(r.w["weight"] - w) < 1e-9


def test_snippet_choice(spark):
    df = spark.createDataFrame([("a", "the fox"), ("b", "a cat & mouse"), ("c", "word " * 100 + "the fox ran")],
                               "path string, content string")
    got = {r.path: r.snippet for r in with_snippet(df, {"fox": 0.5}).collect()}
    assert got["a"] == "the <b>fox</b>" and got["b"] == "a cat &amp; mouse"
    assert got["c"].endswith("the <b>fox</b> ran") and len(got["c"]) <= 220 + 7
    assert {r.path: r.snippet for r in with_snippet(df, {}).collect()}["a"] == "the fox"


def test_literal_runs_are_in_every_match():
    import re

    from termlake.functions.text import literal_runs
    cases = {"abc": ["abc"], "abc?d": ["ab", "d"], "ab+c": ["ab", "c"], "a|bcd": [], "x(a|b)yz": ["x", "yz"], r"\dabc": ["abc"],
             "[abc]def": ["def"], "[]x]ab": ["ab"], "[^]x]ab": ["ab"], "[a[bc]de]fgh": [], "(?x)ab#cde": [], r"\x41bc": [],
             "ab{0,1}cd": ["a", "cd"], "ab{2}cd": ["a", "cd"], "a.c*de": ["a", "de"], "": []}
    for pattern, runs in cases.items():
        assert literal_runs(pattern) == runs, pattern
        for text in ("abc", "abd", "abcd", "xayz", "1abc", "adef", "acd", "abbcd", "axde", "xab", "]ab"):
            if re.fullmatch(pattern, text):
                assert all(r in text for r in runs)


def test_words_within_two_edits_share_a_rest(spark):
    """Every word that one or two edits, swaps included, make of a word, at any place."""
    import random

    from termlake.functions.fuzzy import rests, rests_of
    rng = random.Random(3)

    def edits(w):
        yield from (w[:i] + w[i + 1:] for i in range(len(w)))
        yield from (w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "ax")
        yield from (w[:i] + "x" + w[i + 1:] for i in range(len(w)))
        yield from (w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1))

    for word in ["", "a", "ab", "élan", "abcdefg", "abcdefgh", "aabbaabbaabb", "".join(rng.choices("abcd", k=12))]:
        for one in edits(word):
            assert set(rests(word, 1)) & set(rests(one, 1))
            for two in edits(one):
                assert set(rests(word)) & set(rests(two)), (word, two)
        assert sorted(spark.createDataFrame([(word,)], "w string").select(rests_of(F.col("w"))).first()[0]) == rests(word)


def test_rests_are_compiled(spark):
    """No expression over array elements, which Spark would interpret for each rest."""
    from termlake.functions.fuzzy import rests_of
    rests = spark.range(1).select(rests_of(F.col("id").cast("string")).alias("r"))
    assert "lambda" not in rests._jdf.queryExecution().executedPlan().toString()
    null = spark.createDataFrame([(None,)], "w string").select(rests_of(F.col("w"))).first()[0]
    assert null == [None]
