"""What the physical plans must look like to hold at scale."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
import termlake as tl
from termlake.operators.match import resolve
from termlake.operators.conditions import groups_of, leaves_of
from termlake.operators.postings import index_rows
from termlake.operators.rank import top_k


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_does_not_shuffle_before_the_cut(spark, sf_dir):
    coll = entry.collection(spark, sf_dir)
    for c in (entry.SLICE, tl.phrase("of the"), tl.wildcard("th?n"), tl.near("the of", 3), tl.exclude(tl.term("the"))):
        p = plan(coll.matches(c))
        assert "Exchange" not in p and "Join" not in p, p
        assert p.count("FileScan") == 1 and ("In(term" in p or "EqualTo(term" in p)
    p = plan(top_k(coll.matches(tl.term("the")), 50))
    assert "TakeOrderedAndProject" in p


def test_columns_are_pruned(spark, sf_dir):
    coll = entry.collection(spark, sf_dir)
    assert "positions:array" not in plan(coll.matches(tl.term("the"))).split("ReadSchema")[1]
    assert "content" not in plan(coll.documents().select("path", "modified")).split("ReadSchema")[1]
    assert "StartsWith(term,tion)" in plan(coll.matches(tl.wildcard("tion*")))


def test_postings_need_no_shuffle_on_bucketed_documents(spark, sf_dir):
    assert "Exchange" not in plan(index_rows(entry.collection(spark, sf_dir).keyed_documents()))


def test_hits_open_their_own_buckets(spark, sf_dir, monkeypatch, tmp_path):
    from termlake.plans import collection as col
    monkeypatch.setattr(col, "SMALL_BUCKET_BYTES", 1024)
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("c", [])
    store.build_from("c", entry.docs(spark, sf_dir))
    assert store.open("c").version.buckets == 8
    coll = store.open("c")
    files = lambda df: {f.toPath().getName() for p in df._jdf.queryExecution().toRdd().partitions() for f in p.files()}
    texts = coll._rows("documents")
    assert len(files(texts)) == 8 and len(files(texts.filter(F.col("path").isin(["src1/1.txt"])))) == 1
    p = plan(coll.search(tl.match_path("src1/1.txt")))
    assert "EqualTo(path,src1/1.txt)" in p and p.count("FileScan") == 1, p


def test_patterns_with_three_letters_read_their_grams_only(spark, sf_dir):
    from termlake.operators.match import candidates, resolve
    coll = entry.collection(spark, sf_dir)
    leaves = [tl.wildcard("*tion*"), tl.wildcard("?hou?*"), tl.regex("th(e|at|is)[a-e]?"), tl.regex("[a-z]+tion(s|en)?"), tl.regex("whi.h|when"),
              tl.wildcard("th?n"), tl.regex("abc?def"), tl.regex("x{0,2}the")]
    with_grams, without = resolve(coll.vocab(), leaves, grams=coll.grams()), resolve(coll.vocab(), leaves)
    assert with_grams.expansion == without.expansion and any(with_grams.expansion.values())
    p = plan(candidates(leaves[0], coll.vocab(), coll.grams()))
    assert "EqualTo(gram,tio)" in p and "/vocab" not in p
    assert "/grams" not in plan(candidates(leaves[5], coll.vocab(), coll.grams()))


def test_fuzzy_words_read_their_rests_only(spark, sf_dir):
    from termlake.operators.match import candidates, resolve
    coll = entry.collection(spark, sf_dir)
    leaves = [tl.fuzzy(w, d) for w in ("a", "teh", "wihch", "becuase", "governmnt", "xx") for d in (1, 2)]
    with_rests, without = resolve(coll.vocab(), leaves, by_rest=coll.rests()), resolve(coll.vocab(), leaves)
    assert with_rests.expansion == without.expansion and any(with_rests.expansion.values())
    p = plan(candidates(leaves[-2], coll.vocab(), coll.rests(), coll.rests()))
    assert "/rests" in p and "/vocab" not in p and ("EqualTo(rest,x)" in p or "In(rest, [" in p), p
    n, everything = (df.distinct().count() for df in (candidates(leaves[5], coll.vocab(), None, coll.rests()), coll.rests().select("term")))
    assert 0 < n < everything / 4


def test_joins_of_a_sync_stay_in_their_buckets(spark, sf_dir, monkeypatch, tmp_path):
    from termlake.plans import collection as col, store as st
    monkeypatch.setattr(st, "REWRITE_SHARE", 100.0)
    monkeypatch.setattr(col, "MAX_BROADCAST_PATHS", 0)
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("c", [])
    store.build_from("c", entry.stored_docs(spark, sf_dir))
    store.build_from("c", entry.listed_docs(spark, sf_dir), extensions=entry.fs.DEFAULT_EXTENSIONS)
    coll = store.open("c")
    assert coll.version.n_tombstones > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = plan(coll.matches(tl.term("the")))
        big = plan(coll.search(tl.term("the"), 5000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "Exchange" not in p, p
    # the texts of many hits are joined in their buckets too: only the keys move
    texts = next(l for l in big.splitlines() if "content" in l and "FileScan" in l)
    above = big.splitlines()[:big.splitlines().index(texts)]
    depth = lambda l: len(l) - len(l.lstrip(" :+-*()0123456789"))
    path_up, level = [], depth(texts)
    for l in reversed(above):
        if depth(l) < level:
            path_up.append(l)
            level = depth(l)
    below_join = path_up[:next(i for i, l in enumerate(path_up) if "Join" in l)]
    assert not any("Exchange" in l for l in below_join), big


def test_tokens_of_a_task_are_not_sorted_together(spark, sf_dir):
    """Terms are cut out of each document's own row, so nothing above them is grouped or sorted."""
    p = plan(index_rows(entry.collection(spark, sf_dir).keyed_documents()))
    above = p[:p.index("Generate")]
    assert "Aggregate" not in above and "Sort" not in above, p


def test_a_bucket_is_small_enough_for_a_task(spark):
    """Its postings, some 18 bytes a byte of text while they are sorted, fit a task's share of 700 MB."""
    from termlake.plans.collection import bucket_count
    for n_bytes in (100_000_000, 1_000_000_000, 6_000_000_000):
        assert n_bytes / bucket_count(n_bytes) * 18 < 700_000_000


def test_texts_of_one_key_are_one_document(spark):
    rows = [("p", "f.md", "md", "b a b"), ("p", "f.md", "md", "a c"), ("q", None, None, None), ("r", "", "", "A a")]
    got = index_rows(spark.createDataFrame(rows, "path string, filename string, ext string, content string")).collect()
    found = {(r.path, r.field, r.term): (r.tf, r.positions) for r in got}
    assert len(found) == len(got)
    assert {k[2]: v for k, v in found.items() if k[:2] == ("p", "content")} == {
        "a": (2, [0, 1]), "b": (2, [0, 2]), "c": (1, [1]), "": (0, [])}
    assert found["p", "ext", "md"] == (2, [0, 0]) and found["p", "filename", "f"] == (2, [0, 0])
    assert {k[1:]: v for k, v in found.items() if k[0] == "q"} == {
        ("content", ""): (0, []), ("filename", ""): (0, []), ("ext", None): (1, [0])}
    assert found["r", "content", "a"] == (2, [0, 1])
    assert {r.dl for r in got if r.path == "r" and r.field == "content"} == {2}
