"""Conditions on a small corpus, in both forms, and against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import termlake as tl
from termlake.functions.text import fuzzy_distance, glob_to_regex, query_tokens
from termlake.operators.conditions import groups_of
from termlake.operators.match import SearchTables, matches
from termlake.operators.postings import field_lengths, index_rows, stats_map, tokenize, vocabulary
from termlake.operators.rank import FieldStats, idf
from termlake.operators.scan import scan

DOCS = [("file1.txt", "the quick brown fox jumps"), ("file2.txt", "a lazy dog sleeps"),
        ("file3.txt", "quick dog runs fast")]
T, W = tl.term, tl.wildcard


def frame(spark, docs):
    return spark.createDataFrame(
        [(f"d/{n}", n, n.rsplit(".", 1)[-1] if "." in n else "", c) for n, c in docs],
        "path string, filename string, ext string, content string")


def tables(docs_df):
    rows = index_rows(docs_df).cache()
    return SearchTables(rows, vocabulary(rows), stats_map(field_lengths(rows)))


@pytest.fixture(scope="module")
def small(spark):
    df = frame(spark, DOCS).cache()
    return df, tables(df)


CASES = [
    (T("fox"), "1"), (tl.all_of(T("quick"), T("dog")), "3"), (tl.any_of(T("quick"), T("lazy")), "123"),
    (tl.all_of(T("quick"), tl.exclude(T("dog"))), "1"), (tl.phrase("quick brown"), "1"),
    (tl.phrase("brown quick"), ""), (tl.near("quick fox", 2), "1"), (tl.near("quick fox", 0), ""),
    (W("qui*"), "13"), (W("?og"), "23"), (tl.regex("jump.*"), "1"), (tl.fuzzy("quik"), "13"),
    (tl.all_of(W("qui*"), T("dog")), "3"), (tl.exclude(T("fox")), "23"),
    # one gap costs 1, a swapped pair 2
    (tl.near("quick fox", 1), "1"), (tl.near("brown quick", 1), ""), (tl.near("brown quick", 2), "1"),
    # words that hold several tokens, or none
    (T("file1.txt"), "1"), (T("quick-brown"), "1"), (T("!!"), ""), (tl.exclude(T("!!")), "123"),
    # the filename is tokenized too, but patterns look at the content only
    (T("TXT"), "123"), (W("tx*"), ""), (tl.regex("file.*"), ""), (tl.fuzzy("txt"), ""),
    (W("*"), "123"), (W("foo-b*"), ""), (tl.regex("QUICK"), "13"),
    (tl.match_field("ext", "txt"), "123"), (tl.match_field("ext", "TXT"), ""),
    (tl.match_field("filename", "file2"), "2"), (tl.match_field("content", "txt"), ""),
    (tl.match_path("d/file2.txt"), "2"), (tl.match_all(), "123"),
    (tl.any_of(tl.all_of(), T("fox")), "1"), (tl.any_of(tl.all_of(T("a"), T("b")), tl.exclude(T("quick"))), "2"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_condition(small, i):
    df, t = small
    condition, expected = CASES[i]
    found = lambda rows: "".join(sorted(r.path[6] for r in rows.collect()))
    assert found(matches(t, condition)) == expected
    assert found(scan(df, condition)) == expected


def test_scores(small):
    df, t = small
    score = lambda c: {r.path[6]: r.score for r in matches(t, c).collect()}
    n, avg = 3, (5 + 4 + 4) / 3
    one = idf(n, 2) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avg))
    assert score(T("quick"))["1"] == pytest.approx(one)
    assert score(W("qu*")) == {"1": 1.0, "3": 1.0}
    assert score(tl.exclude(T("fox"))) == {"2": 1.0, "3": 1.0}
    assert score(tl.all_of(T("quick"), W("q*"), tl.exclude(T("dog"))))["1"] == pytest.approx(one + 1)
    pair = (idf(n, 2) + idf(n, 1)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avg))
    assert score(tl.phrase("quick brown"))["1"] == pytest.approx(pair)
    # a group that does not match adds nothing, even where some of its words do
    assert score(tl.any_of(T("fox"), tl.all_of(T("quick"), T("dog"))))["1"] == pytest.approx(score(T("fox"))["1"])


def test_invalid_conditions(small):
    for bad in (r"a(?=b)", r"(a)\1", "^a", "a$", r"\bx"):
        with pytest.raises(ValueError):
            tl.regex(bad)
    tl.regex(r"[^a]\$")
    with pytest.raises(ValueError):
        groups_of(tl.all_of())
    with pytest.raises(ValueError):
        tl.match_field("size", "1")
    with pytest.raises(ValueError):
        matches(small[1], tl.regex("(a")).collect()


def test_small_parsers():
    assert glob_to_regex("a*b?c.d") == r"a.*b.c\.d"
    assert [fuzzy_distance(d) for d in ("", "0", "1", "2", "9", "300")] == [1, 1, 1, 2, 2, 1]
    assert query_tokens("Foo-bar " + "x" * 40 + " é1") == [(0, "foo"), (1, "bar"), (2, "x" * 40), (3, "é1")]


def test_long_tokens_are_searchable(spark):
    long = "y" * 4000
    t = tables(frame(spark, [("a.txt", f"one {long} two"), ("b.txt", "one two"), ("c.txt", "y" * 39)]))
    found = lambda c: sorted(r.path for r in matches(t, c).collect())
    assert found(tl.phrase("one two")) == ["d/b.txt"]
    assert found(tl.phrase(f"one {long} two")) == ["d/a.txt"]
    assert found(T(long)) == ["d/a.txt"] and found(T("y" * 39)) == ["d/c.txt"]
    assert found(W("y*")) == ["d/a.txt", "d/c.txt"]
    assert t.stats["content"] == FieldStats(3, 2)


def test_a_token_limit_keeps_positions(spark):
    docs = frame(spark, [("a.txt", f"one {'y' * 40} two")])
    rows = tokenize(docs, max_token_bytes=40).select("pos", "term").collect()
    assert sorted(map(tuple, rows)) == [(0, "one"), (2, "two")]


def brute_starts(words, wanted, slop):
    places = [[i for i, w in enumerate(words) if w == x] for x in wanted]
    starts = set()
    for combo in itertools.product(*places):
        q = [p - i for i, p in enumerate(combo)]
        if len(set(combo)) == len(combo) and sum(abs(a - b) for a, b in zip(q, q[1:])) <= slop:
            starts.add(combo[0])
    return len(starts)


def test_near_against_brute_force(spark):
    rnd = random.Random(7)
    docs = [(f"n{i}.txt", " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14)))) for i in range(40)]
    # far apart, so that matches lie across several blocks of positions
    docs += [(f"m{i}.txt", " ".join(["z"] * (60 + i) + ["a", "z", "b", "a", "c"] + ["z"] * 70 + ["b", "a"]))
             for i in range(12)]
    df = frame(spark, docs).cache()
    t = tables(df)
    for wanted, slop in ((["a", "b"], 1), (["a", "b"], 3), (["a", "a"], 2), (["a", "b", "c"], 4),
                         (["a", "b", "a"], 3), (["b", "a"], 75)):
        from termlake.operators.match import near_counts
        leaf = tl.near(" ".join(wanted), slop)
        got = {r.path: r.tf for r in near_counts(t.index, leaf).filter("field = 'content'").collect()}
        want = {f"d/{n}": brute_starts(c.split(), wanted, slop) for n, c in docs}
        assert got == {p: k for p, k in want.items() if k}
        assert {r.path for r in scan(df, leaf).collect()} == set(got)


def damerau(a, b):
    """Optimal distance with swaps of neighbours, by dynamic programming."""
    last, inf = {}, len(a) + len(b)
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            if a[i - 1] == b[j - 1]:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (a[i - 1] != b[j - 1]), d[i + 1][j] + 1, d[i][j + 1] + 1,
                                  d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[-1][-1]


def test_fuzzy_distance_against_brute_force(spark):
    from termlake.functions.fuzzy import edit_distance, within_distance
    assert damerau("ca", "abc") == 2 and damerau("paymnet", "payment") == 1
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abé", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for stem in ("a", "ab", "abé", "abba", "éaab"):
        rows = df.select("t", edit_distance(F.col("t"), stem).alias("d"),
                         *[within_distance(F.col("t"), stem, k).alias(f"w{k}") for k in (1, 2)]).collect()
        for r in rows:
            true = damerau(r.t, stem)
            assert (r.d, r.w1, r.w2) == (min(true, 3), true <= 1, true <= 2), (stem, r)


def test_scan_and_postings_agree(spark):
    rnd = random.Random(3)
    vocab = ["ab", "abc", "bca", "cab", "x1", "über", "the"]
    docs = [(f"r{i}.{rnd.choice(['txt', 'md'])}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12))))
            for i in range(60)]
    df = frame(spark, docs).cache()
    t = tables(df)
    leaf = lambda: rnd.choice([
        lambda: T(rnd.choice(vocab)), lambda: tl.phrase(" ".join(rnd.choices(vocab, k=2))),
        lambda: tl.near(" ".join(rnd.choices(vocab, k=3)), rnd.randint(0, 4)), lambda: W(rnd.choice(["a*", "?a*", "*b"])),
        lambda: tl.fuzzy(rnd.choice(vocab), rnd.randint(1, 2)), lambda: tl.match_field("ext", "md"),
        lambda: tl.regex("[ab]+c?")])()
    for _ in range(8):
        parts = lambda: [tl.exclude(leaf()) if rnd.random() < .3 else leaf() for _ in range(rnd.randint(1, 2))]
        c = tl.any_of(*[tl.all_of(*parts()) for _ in range(rnd.randint(1, 2))])
        assert ({r.path for r in matches(t, c).collect()} == {r.path for r in scan(df, c).collect()}), c


def test_wide_pattern_equals_expanded(small):
    from termlake.operators import match
    c = tl.regex(".*o.*")
    res = match.resolve(small[1].vocab, [c], max_expansion=1)
    assert res.expansion[c] is None
    assert {r.path for r in matches(small[1], c, res).collect()} == {r.path for r in matches(small[1], c).collect()}
