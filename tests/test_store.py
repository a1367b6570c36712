"""Collections: creation, full and incremental builds, and their statistics."""

import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import termlake as tl
from termlake.functions.fuzzy import MAX_RESTS, within_distance, within_distance_of
from termlake.functions.text import glob_pattern, glob_to_regex
from termlake.operators import many, sync
from termlake.plans import collection as col
from termlake.plans import store as st

COUNTS = ("indexed", "unchanged", "removed")


def put(folder, name, text, mtime=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    if mtime:
        os.utime(path, (mtime, mtime))


def found(coll, condition):
    return sorted(r.filename for r in coll.search(condition).collect())


def test_incremental_sequence(spark, tmp_path):
    src, store = str(tmp_path / "src"), tl.CollectionStore(spark, str(tmp_path / "store"))
    info = store.create(" My Notes ", [src])
    assert (info.name, info.dir, info.doc_count, info.last_built) == ("My Notes", "my-notes", 0, None)
    with pytest.raises(LookupError):
        store.open("My Notes")
    put(src, "a.txt", "alpha content")
    put(src, "b.txt", "beta content")
    put(src, ".c.md", "hidden content")
    pick = lambda s: tuple(s[c] for c in COUNTS)
    assert pick(store.build("My Notes")) == (3, 0, 0)
    assert pick(store.build("My Notes")) == (0, 3, 0)
    put(src, "a.txt", "alpha updated content", 2000000000)
    assert pick(store.build("My Notes")) == (1, 2, 0)
    put(src, "c.txt", "gamma content")
    put(src, "d.png", "no")
    os.remove(os.path.join(src, "b.txt"))
    stats = store.build("My Notes")
    assert stats == dict(indexed=1, skipped=1, files_seen=4, unchanged=2, removed=1)
    coll = store.open("My Notes")
    assert found(coll, tl.term("content")) == [".c.md", "a.txt", "c.txt"] and coll.count_docs() == 3
    assert found(coll, tl.term("beta")) == [] and found(coll, tl.term("updated")) == ["a.txt"]
    # a file that turns binary is deleted, and counts as skipped
    put(src, "a.txt", b"now \0 binary", 2000000001)
    stats = store.build("My Notes")
    assert stats == dict(indexed=0, skipped=2, files_seen=4, unchanged=2, removed=0)
    assert found(store.open("My Notes"), tl.term("content")) == [".c.md", "c.txt"]
    row = store.get("My Notes")
    assert row.doc_count == 2 and row.last_built is not None
    store.drop("My Notes")
    assert store.list().count() == 0 and not os.path.exists(tmp_path / "store" / "my-notes")
    assert os.path.exists(os.path.join(src, "c.txt"))
    with pytest.raises(KeyError):
        store.drop("My Notes")


def test_full_build_and_names(spark, tmp_path):
    src, store = str(tmp_path / "src"), tl.CollectionStore(spark, str(tmp_path / "store"))
    put(src, "x/one.txt", "one fox") if os.makedirs(os.path.join(src, "x")) is None else None
    put(src, "two.txt", "two fox")
    put(src, "_skip.bin", "fox")
    store.create("A b", [src, os.path.join(src, "x")])
    for _ in range(2):
        stats = store.build_full("A b")
        assert stats == dict(indexed=3, skipped=1, files_seen=4, unchanged=0, removed=0)
    # overlapping folders: a full build keeps both copies, a sync of changes one
    assert found(store.open("A b"), tl.term("fox")) == ["one.txt", "one.txt", "two.txt"]
    put(src, "x/one.txt", "one changed fox", 2000000000)
    stats = store.build("A b")
    assert (stats["files_seen"], stats["indexed"], stats["unchanged"]) == (4, 2, 1)
    assert found(store.open("A b"), tl.term("fox")) == ["one.txt", "two.txt"]
    with pytest.raises(ValueError):
        store.create("A b", [])
    with pytest.raises(ValueError):
        store.create("  ", [])
    assert [store.create(n, []).dir for n in ("a B!", "A-b", "***")] == ["a-b-2", "a-b-3", "index"]


@pytest.mark.parametrize("share", [0.0, 100.0])
def test_sync_equals_rebuild(spark, sf_dir, tmp_path, monkeypatch, share):
    """Appending to a collection and writing it anew give the same searches as
    building the final state at once."""
    store = tl.CollectionStore(spark, str(tmp_path))
    monkeypatch.setattr(st, "REWRITE_SHARE", share)
    ext = entry.fs.DEFAULT_EXTENSIONS
    store.create("steps", [])
    store.build_from("steps", entry.stored_docs(spark, sf_dir))
    second = store.build_from("steps", entry.listed_docs(spark, sf_dir), extensions=ext)
    seen = entry.classified(spark, sf_dir)
    expected = entry.build_stats(spark, sf_dir).first().asDict()
    assert second == expected
    assert expected["files_seen"] == expected["indexed"] + expected["skipped"] + expected["unchanged"]
    store.create("once", [])
    store.build_from("once", entry.listed_docs(spark, sf_dir), extensions=ext)
    a, b = store.open("steps"), store.open("once")
    assert (a.version.n_tombstones > 0) == (share > 1)
    assert a.stats() == b.stats() and a.count_docs() == b.count_docs() == seen.filter("status <> 'ineligible'").count()
    assert sorted(map(tuple, a.vocabulary().collect())) == sorted(map(tuple, b.vocabulary().collect()))
    for c in (tl.term("the"), tl.exclude(tl.term("the")), tl.phrase("of the"), tl.near("the of", 3), tl.wildcard("th*"),
              tl.all_of(tl.near("the of", 3), tl.term("and"), tl.exclude(tl.fuzzy("thta")))):
        assert a.search(c, 2000).collect() == b.search(c, 2000).collect()
    # nothing changed: nothing is written
    again = store.build_from("steps", entry.listed_docs(spark, sf_dir), extensions=ext)
    assert again["indexed"] == 0 and store.open("steps").version == a.version


def test_many_changed_files_are_read_by_range(spark, tmp_path, monkeypatch):
    src, store = str(tmp_path / "src"), tl.CollectionStore(spark, str(tmp_path / "store"))
    for i in range(6):
        put(src, f"f{i}.txt", f"word{i} old", 1700000000 + i * 7200)
    store.create("c", [src])
    store.build("c", hidden=False, ignore_files=False)
    for i in range(4):
        put(src, f"f{i}.txt", f"word{i} new", 1600000000 + i * 7200)
    monkeypatch.setattr(st, "MAX_TIME_RANGES", 1)
    assert store.build("c", hidden=False, ignore_files=False)["indexed"] == 4
    coll = store.open("c")
    assert found(coll, tl.term("new")) == [f"f{i}.txt" for i in range(4)]
    assert found(coll, tl.term("old")) == ["f4.txt", "f5.txt"]


def test_ignored_files_stay_out(spark, tmp_path):
    src, store = str(tmp_path / "src"), tl.CollectionStore(spark, str(tmp_path / "store"))
    put(src, "a.txt", "fox")
    put(src, "b.log", "fox")
    put(src, ".gitignore", "*.log")
    store.create("c", [src])
    assert store.build("c")["indexed"] == 1 and found(store.open("c"), tl.term("fox")) == ["a.txt"]
    assert store.build("c", ignore_files=False)["indexed"] == 1
    assert found(store.open("c"), tl.term("fox")) == ["a.txt", "b.log"]


def test_missing_root(spark, tmp_path):
    src, store = str(tmp_path / "src"), tl.CollectionStore(spark, str(tmp_path / "store"))
    put(src, "a.txt", "fox")
    store.create("c", [src])
    store.build("c")
    os.rename(src, src + "2")
    with pytest.raises(Exception):
        store.build("c")
    assert found(store.open("c"), tl.term("fox")) == ["a.txt"]  # the failed build changed nothing
    assert store.build("c", missing_roots="empty")["removed"] == 1
    assert found(store.open("c"), tl.term("fox")) == []


def test_search_many_equals_single_searches(spark, sf_dir):
    coll = entry.collection(spark, sf_dir)
    asked = {"q1": ([["the", "of"]], tl.all_of(tl.term("the"), tl.term("of"))),
             "q2": ([["und"], ["the", "-and"]], tl.any_of(tl.term("und"), tl.all_of(tl.term("the"), tl.exclude(tl.term("and"))))),
             "q3": ([["txt", "the"]], tl.all_of(tl.term("txt"), tl.term("the")))}
    rows = [(q, g, w.lstrip("-"), w.startswith("-")) for q, (gs, _) in asked.items() for g, ws in enumerate(gs) for w in ws]
    queries = spark.createDataFrame(rows, "query_id string, grp int, word string, negate boolean")
    got = coll.search_many(queries, 25).orderBy("query_id", "rank").collect()
    for q, (_, condition) in asked.items():
        want = [(r.path, r.score) for r in coll.search(condition, 25).collect()]
        assert [(r.path, r.score) for r in got if r.query_id == q] == want
    with pytest.raises(Exception, match="no such kind"):
        query = spark.createDataFrame([("q", 1, "sound", "x", False)], "query_id string, grp int, kind string, text string, negate boolean")
        coll.search_many(query, 5).collect()


MANY = {
    "term": tl.term("the"), "two": tl.term("of-the"), "phrase": tl.phrase("that is the"), "near": tl.near("and of the", 4),
    "self": tl.near("the the", 3), "glob": tl.wildcard("th?n"), "any": tl.wildcard("*"), "wide": tl.all_of(tl.wildcard("*t*"), tl.term("und")),
    "regex": tl.regex("th(e|at|is)[a-e]?"), "fuzzy": tl.fuzzy("teh", 1), "fuzzy2": tl.fuzzy("wihch", 2), "all": tl.match_all(),
    "ext": tl.match_field("ext", "md"), "name": tl.match_field("filename", "txt"), "path": tl.match_path("src1/1.txt"),
    "not": tl.exclude(tl.term("the")), "nots": tl.all_of(tl.exclude(tl.term("the")), tl.exclude(tl.wildcard("u*"))),
    "mixed": tl.any_of(tl.all_of(tl.term("the"), tl.phrase("of the")), tl.all_of(tl.wildcard("und*"), tl.exclude(tl.term("der"))),
                       tl.exclude(tl.wildcard("e*"))),
    "twice": tl.any_of(tl.term("und"), tl.all_of(tl.term("und"), tl.term("die"))), "none": tl.term("!!!"), "blank": None,
}


@pytest.mark.parametrize("limit", [1, 200_000])  # leaves broadcast, and joined
def test_search_many_takes_every_condition(spark, sf_dir, limit, monkeypatch):
    monkeypatch.setattr(many, "MAX_BROADCAST_LEAVES", limit)
    coll = entry.collection(spark, sf_dir)
    got = coll.search_many(many.query_rows(spark, MANY.items()), 15).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.path, r.score))
    for name, condition in MANY.items():
        alone = [] if condition is None else [(r.path, r.score) for r in coll.search(condition, 15).collect()]
        assert found[name] == alone, name


def test_patterns_of_columns_are_those_of_literals(spark):
    stems, terms = ["teh", "a", "ca", "which", "thier", ""], ["the", "abc", "ac", "ca", "wihch", "their", "b", "", "ab", "hte", "whcih"]
    rows = spark.createDataFrame([(s, t, d) for s in stems for t in terms for d in (1, 2)], "s string, t string, d int")
    got = {(r.s, r.t, r.d): r.ok for r in rows.withColumn("ok", within_distance_of(F.col("t"), F.col("s"), F.col("d"))).collect()}
    for s in stems:
        for d in (1, 2):
            alone = rows.filter((F.col("s") == s) & (F.col("d") == d)).withColumn("ok", within_distance(F.col("t"), s, d)).collect()
            assert all(got[r.s, r.t, r.d] == r.ok for r in alone)
    globs = ["a*", "?b", "a.b*", "(x)", "ä?", "*"]
    pattern = spark.createDataFrame([(g,) for g in globs], "g string").withColumn("p", glob_pattern("g")).collect()
    for r in pattern:
        for text in ("ab", "a.bc", "(x)", "äb", "x", "axb"):
            assert bool(re.fullmatch(r.p, text)) == bool(re.fullmatch(glob_to_regex(r.g), text))



def test_limits(spark, sf_dir):
    coll = entry.collection(spark, sf_dir)
    assert coll.search(tl.term("the"), 3).count() == 3
    assert coll.search_text(None).count() == 0
    with pytest.raises(ValueError):
        coll.search(tl.term("the"), 0)
    small = [r.path for r in coll.search(tl.term("the"), 40).collect()]
    large = [r.path for r in coll.search(tl.term("the"), 5000).collect()]
    assert small == large[:40]


def test_directories_are_unique(spark, tmp_path):
    names = ["a", "A", "a-2", "a 2", "b-7", "a", "***", "***", "b-7", "a-2-2"]
    rows = spark.createDataFrame(list(enumerate(names)), "ord int, name string").repartition(3)
    got = [r.dir for r in st.unique_dirs(rows, str(tmp_path / "w")).orderBy("ord").collect()]
    assert got == ["a", "a-2", "a-2-2", "a-2-3", "b-7", "a-3", "index", "index-2", "b-7-2", "a-2-2-2"]


def test_unique_dirs_equal_one_after_the_other(spark, tmp_path, monkeypatch):
    """Also with blocks of three names, and slugs that are numbered forms of others."""
    from termlake.operators import naming
    monkeypatch.setattr(naming, "BLOCK", 3)
    rng = random.Random(5)
    for n_names in (40, 120):
        ends = ["", "", "", "-2", "-3", "-4", "-5", " 2 2", "-2-3", "-02", "-1", "-7", "-2-2-2", "-99999999999999999999"]
        names = [rng.choice(["a", "A!", "b", "c-9"]) + rng.choice(ends) for _ in range(n_names)] + ["", "--"]
        rows = [(n, i if i % 9 else None) for i, n in enumerate(names)] + [("b", 3), ("b", 3)]
        got = st.unique_dirs(spark.createDataFrame(rows, "name string, ord int").repartition(5), str(tmp_path / f"w{n_names}")).collect()
        slug = lambda n: re.sub("[^a-z0-9]+", "-", n.lower()).strip("-") or "index"
        taken, counter, want = set(), {}, []
        for n, o in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
            want.append((n, o, st.first_free(slug(n), taken, counter)))
            taken.add(want[-1][2])
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    empty = st.unique_dirs(spark.createDataFrame([], "name string, ord int"), str(tmp_path / "none"))
    assert empty.collect() == [] and empty.columns == ["name", "ord", "dir"]
    nulls = st.unique_dirs(spark.createDataFrame([(None, 1), ("index", 2)], "name string, ord int"), str(tmp_path / "nulls")).collect()
    assert sorted(r.dir for r in nulls) == ["index", "index-2"]


def test_names_of_one_slug_are_many_tasks(spark):
    from termlake.operators import naming
    rows = spark.range(4000).select(F.lit("same").alias("name"), F.col("id").alias("ord"))
    share = rows.groupBy(naming._slices(rows).alias("slice")).count().collect()
    assert len(share) == 4 and max(r["count"] for r in share) < 1600


def _docs(spark, ids, text="some words here"):
    return spark.createDataFrame([(f"p{i}.txt", f"p{i}.txt", "txt", f"{text} n{i}", 1, 10) for i in ids],
                                 "path string, filename string, ext string, content string, modified bigint, size bigint")


def test_growing_collections_are_written_anew(spark, tmp_path, monkeypatch):
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("c", ["x"])
    for n in (40, 50, 60, 70, 80, 90):
        store.build_from("c", _docs(spark, range(n)))
        assert len(store.open("c").version.gens) <= 3
    assert store.open("c").count_docs() == 90 and found(store.open("c"), tl.term("n85")) == ["p85.txt"]
    # text for many more buckets brings the buckets
    big = _docs(spark, range(90)).withColumn("size", F.lit(2 * 1024 * 1024).cast("bigint"))
    buckets = store.open("c").version.buckets
    store.build_from("c", big.unionByName(_docs(spark, [100])))
    assert store.open("c").version.buckets > buckets


def test_many_small_syncs_leave_the_base_alone(spark, tmp_path):
    """Changes of one document each: the gens stay few, the base is written once, and
    everything equals a build of the last state."""
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("c", ["x"])
    state = {i: (f"n{i}", 1) for i in range(40)}

    def docs():
        return spark.createDataFrame([(f"p{i}.txt", f"p{i}.txt", "txt", f"some words here {w}", m, 10) for i, (w, m) in sorted(state.items())],
                                     "path string, filename string, ext string, content string, modified bigint, size bigint")

    store.build_from("c", docs())
    base, copied = store.open("c").version, 0
    for k in range(14):
        if k % 4 == 3:
            del state[k]
        state[k % 5 if k % 3 else 100 + k] = (f"again{k}", k + 2)
        counts = store.build_from("c", docs())
        v = store.open("c").version
        assert v.base == base.base and v.gens[0] == base.gens[0] and len(v.gens) <= 5
        assert counts["indexed"] == 1 and counts["removed"] == (k % 4 == 3)
        copied += v.rows[-1]
    assert copied < 14 * 5  # not 1 + 2 + … + 14
    store.create("once", ["x"])
    store.build_from("once", docs())
    a, b = store.open("c"), store.open("once")
    assert a.version.n_docs == b.version.n_docs == len(state) and a.version.lengths == b.version.lengths
    assert sorted(map(tuple, a.vocabulary().collect())) == sorted(map(tuple, b.vocabulary().collect()))
    for df in ("postings", "documents"):
        one, other = (sorted(map(repr, getattr(x, df)().collect())) for x in (a, b))
        assert one == other
    kinds = {d for d in os.listdir(f"{tmp_path}/c/{base.base}/vocab") if d.startswith("gen=")}
    assert len(kinds) <= len(a.version.gens) + 3  # what was merged before is deleted
    for condition in (tl.term("again9"), tl.term("some"), tl.exclude(tl.term("some"))):
        assert a.matches(condition).count() == b.matches(condition).count()


def test_a_small_sync_reads_no_text_of_the_dead(spark, tmp_path, monkeypatch):
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("c", ["x"])
    store.build_from("c", _docs(spark, range(60)))
    coll = store.open("c")
    for literal in (1000, 0):
        monkeypatch.setattr(col, "MAX_LITERAL_PATHS", literal)
        gone = coll._postings_of(spark.createDataFrame([("p3.txt",)], "path string"), 1)
        plan = gone._jdf.queryExecution().executedPlan().toString()
        assert "content#" not in plan and "positions" not in plan
        assert [r.dl for r in gone.collect() if (r.term, r.field) == ("", "content")] == [4]
    store.build_from("c", _docs(spark, range(1, 60)).unionByName(_docs(spark, [0], "other text").withColumn("modified", F.lit(2).cast("bigint"))))
    v = {(r.term, r.field): r.df for r in store.open("c").vocabulary().collect()}
    assert v[("some", "content")] == 59 and v[("other", "content")] == 1
    assert dict(store.open("c").version.lengths)["content"] == 59 * 4 + 3


def test_a_change_of_the_manifest_reads_it_once(spark, tmp_path, monkeypatch):
    store, looks = tl.CollectionStore(spark, str(tmp_path)), []
    log = st.CollectionStore._log
    monkeypatch.setattr(st.CollectionStore, "_log", lambda self: (looks.append(1), log(self))[1])
    made = [store.create(n, [f"/x/{n}"]) for n in ("One", "one!", "Two")]
    assert [tuple(r) for r in made] == [("One", "one", ["/x/One"], 0, None), ("one!", "one-2", ["/x/one!"], 0, None), ("Two", "two", ["/x/Two"], 0, None)]
    store.drop("One")
    assert len(looks) == 4
    assert [store.get(r.name) for r in made[1:]] == made[1:]
    with pytest.raises(KeyError):
        store.drop("One")
    assert store.create(" One ", []).dir == "one"
    assert log(store).agg(F.count_distinct("seq"), F.max("seq")).first() == (5, 5)
    assert sorted(r.name for r in store.list().collect()) == ["One", "Two", "one!"]


def test_look_up_tables_are_sorted_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """However many terms there are, no task sorts more rows than its bytes allow."""
    monkeypatch.setattr(col, "LOOKUP_BYTES", 40_000)
    rows = [(f"{i}.txt", f"{i}.txt", "txt", " ".join(f"w{i}x{k}ending" for k in range(50)), i, 10) for i in range(30)]
    docs = spark.createDataFrame(rows, "path string, filename string, ext string, content string, modified bigint, size bigint")
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("c", [])
    store.build_from("c", docs)
    coll = store.open("c")
    for table, key in ((coll.grams(), "gram"), (coll.rests(), "rest")):
        per_file = table.groupBy(F.input_file_name().alias("file")).agg(
            F.sum(F.octet_length("term") + col.LOOKUP_ROW_BYTES).alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"),
            F.countDistinct(key).alias("keys")).orderBy("low").collect()
        assert len(per_file) > 12
        assert all(a.high < b.low for a, b in zip(per_file, per_file[1:]))  # one file for each look-up
        assert max(r.bytes for r in per_file if r.keys > 1) < 6 * col.LOOKUP_BYTES  # a gram may be in every term
    assert coll.rests().count() == coll.rests().distinct().count() <= 1500 * MAX_RESTS
    assert coll.matches(tl.fuzzy("w7x1endnig", 2)).filter("path = '7.txt'").count() == 1
    assert coll.matches(tl.wildcard("w7x49*")).count() == 1


def test_sizes_of_tasks():
    mb = 1024 * 1024
    assert all(n * mb / col.bucket_count(n * mb) <= 16 * mb for n in (100, 168, 841, 10_000, 100_000))
    assert col.lookup_parts(0, 8) == 1 and col.lookup_parts(30 * mb, 8) == 2 and col.lookup_parts(500 * mb, 8) == 8
    assert all(n * mb / col.lookup_parts(n * mb, 12) <= 128 * mb for n in (1, 2_000, 50_000, 1_000_000))
    assert col.lookup_parts(10 ** 15, 12) == col.MAX_LOOKUP_PARTS


def test_tables_are_stored_as_zstd(spark, tmp_path):
    import pyarrow.parquet as pq
    rows = [("a.txt", "a.txt", "txt", "some words here", 1, 15)]
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("c", [])
    store.build_from("c", spark.createDataFrame(rows, "path string, filename string, ext string, content string, modified bigint, size bigint"))
    coll = store.open("c")
    for kind in ("documents", "postings", "vocab", "grams", "rests"):
        files = [f for f in (tmp_path / "c" / str(coll.version.base) / kind).rglob("*.parquet")]
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def _contents(store, name):
    return sorted((r.filename, r.content, r["size"]) for r in store.open(name).documents().collect())


def test_a_build_reads_files_in_tasks_and_only_those_it_needs(spark, tmp_path, monkeypatch):
    """No listing by Spark, which the driver would hold; a sync opens the changed files alone."""
    src = tmp_path / "a b/50%"  # as a URI these names need escapes
    for n in ("x.txt", "y.md", ".h.txt", "p.png"):
        put(src, n, "fox " + n)
    put(src / "sub", "z.txt", "fox z")
    given, real, real_read = [], st.read_documents, st.read_listed
    monkeypatch.setattr(st, "read_documents", lambda df: (given.append(df), real(df))[1])
    store = tl.CollectionStore(spark, str(tmp_path / "store"))
    store.create("full", [f"file://{src}"])
    assert store.build_full("full")["indexed"] == 4 and len(given) == 1
    store.create("c", [str(src)])
    assert store.build("c")["indexed"] == 4
    assert _contents(store, "c") == _contents(store, "full") and len({r.path for r in store.open("full").documents().collect()}) == 4
    put(src, "y.md", "fox again", 2_000_000_000)
    put(src, ".h.txt", "fox hidden again", 2_000_000_000)
    os.utime(src / "p.png", (0, 0))
    read = []
    monkeypatch.setattr(st, "read_listed", lambda df, n=0: (read.append(sorted(r.path.rsplit("/", 1)[1] for r in df.collect())), real_read(df, n))[1])
    assert store.build("c") == dict(indexed=2, skipped=1, files_seen=5, unchanged=2, removed=0)
    assert read == [[".h.txt", "y.md"]] and ("y.md", "fox again", 9) in _contents(store, "c")
    assert len(given) == 3 and not any("binaryFile" in df._jdf.queryExecution().optimizedPlan().toString() for df in given)


def test_folders_that_only_spark_reads_are_scanned_by_it(spark, tmp_path, monkeypatch):
    from termlake.sources import files as fs
    monkeypatch.setattr(fs, "reachable", lambda uri: False)
    src = tmp_path / "src"
    for n in ("x.txt", "y.md", ".h.txt", "n.log"):
        put(src, n, "fox " + n, 1_000_000_000)
    put(src, ".ignore", "*.log\n")
    store = tl.CollectionStore(spark, str(tmp_path / "store"))
    for name, run in (("full", store.build_full), ("c", store.build)):
        store.create(name, [str(src)])
        assert run(name)["indexed"] == 3
    put(src, "y.md", "fox again", 2_000_000_000)
    assert store.build("c")["indexed"] == 1
    assert [c for _, c, _ in _contents(store, "c")] == ["fox .h.txt", "fox x.txt", "fox again"]
