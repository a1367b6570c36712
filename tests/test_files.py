"""Folders to documents: eligibility, decoding, hidden files and ignore rules."""

import os

import pytest

from termlake.functions.text import decode_text
from termlake.sources.files import DEFAULT_EXTENSIONS, documents, filter_ext, is_eligible, scan_files
from termlake.sources.hidden import hidden_files, ignore_lines, read_hidden
from termlake.sources.ignore import apply_ignore, compile_rules


def write(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def names(df, root):
    return sorted(r.path.removeprefix("file:").removeprefix(str(root)).lstrip("/") for r in df.collect())


def test_pipeline(spark, tmp_path):
    write(tmp_path, "a.txt", "the quick brown fox")
    write(tmp_path, "sub/b.md", "lazy dog jumps over")
    write(tmp_path, "c.txt", b"binary\0\0\0data fox")
    write(tmp_path, "d.png", "not indexed ext fox")
    write(tmp_path, "big.txt", "a" * 2048)
    write(tmp_path, "full.txt", "a" * 100)
    write(tmp_path, "u16.txt", "text".encode("utf-16"))
    write(tmp_path, "latin.txt", "café".encode("latin-1"))
    write(tmp_path, "noext", "x")
    files = scan_files(spark, [str(tmp_path)])
    docs = documents(files, max_file_bytes=100)
    assert names(docs, tmp_path) == ["a.txt", "full.txt", "latin.txt", "sub/b.md"]
    row = docs.filter("filename = 'latin.txt'").first()
    assert (row.ext, row.content, row["size"]) == ("txt", "café", 4)
    assert row.modified == int(os.stat(tmp_path / "latin.txt").st_mtime * 1000)
    assert names(documents(files, extensions=["png"]), tmp_path) == ["d.png"]
    assert len(DEFAULT_EXTENSIONS) == 57


def test_roots(spark, tmp_path):
    write(tmp_path, "a/x.txt", "1")
    write(tmp_path, "a/b/y.txt", "2")
    a, b = str(tmp_path / "a"), str(tmp_path / "a" / "b")
    twice = scan_files(spark, [a, b])
    assert names(twice, tmp_path) == ["a/b/y.txt", "a/b/y.txt", "a/x.txt"]
    assert twice.select("path", "copy").distinct().count() == 3
    assert scan_files(spark, [a, str(tmp_path / "none")], "empty").count() == 2
    assert scan_files(spark, [str(tmp_path / "none")], "empty").count() == 0
    with pytest.raises(Exception):
        scan_files(spark, [str(tmp_path / "none")]).count()


def test_size_filter_reaches_the_scan(spark, tmp_path):
    write(tmp_path, "a.txt", "x")
    plan = documents(scan_files(spark, [str(tmp_path)]))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length" in plan


def test_hidden_and_ignored(spark, tmp_path):
    for n in ("a.txt", ".h.txt", "_u.py", "sub/b.txt", "sub/.x/y/z.md", "only/.q.txt", "deep/er/_p/r.txt",
              "sub/__init__.py", "build/x.txt", "build/keep.txt", "sub/n.log", "sub/keep.log", "e.md"):
        write(tmp_path, n, "text " + n)
    write(tmp_path, ".gitignore", "# comment\n\nbuild/\n*.log\n!build/keep.txt\n/e.md  \n")
    write(tmp_path, "sub/.gitignore", "!keep.log\n")
    seen = scan_files(spark, [str(tmp_path)]).select("path", "modificationTime", "length", "copy")
    hidden = hidden_files(spark, [str(tmp_path)], seen)
    assert names(hidden, tmp_path) == [".gitignore", ".h.txt", "_u.py", "deep/er/_p/r.txt", "only/.q.txt",
                                       "sub/.gitignore", "sub/.x/y/z.md", "sub/__init__.py"]
    read = {r.path.rsplit("/", 1)[-1]: r.content for r in read_hidden(hidden.filter("path like '%.txt'")).collect()}
    assert bytes(read["r.txt"]) == b"text deep/er/_p/r.txt" and len(read) == 3
    every = seen.unionByName(hidden)
    rules = compile_rules(ignore_lines(spark, every))
    assert names(apply_ignore(every, rules), tmp_path) == [
        ".gitignore", ".h.txt", "_u.py", "a.txt", "deep/er/_p/r.txt", "only/.q.txt", "sub/.gitignore",
        "sub/.x/y/z.md", "sub/__init__.py", "sub/b.txt", "sub/keep.log"]


def test_ignore_globs(spark):
    paths = ["a/b.txt", "a/x/b.txt", "a/x/y/b.txt", "q1.md", "q12.md", "qa.md", "v/w/f", "k+.c", "k1c"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    left = lambda *lines: names(apply_ignore(files, compile_rules(spark.createDataFrame(
        [("", i, l) for i, l in enumerate(lines)], "dir string, ord int, line string"))), "")
    gone = lambda *lines: sorted(set(paths) - set(left(*lines)))
    assert gone("a/**/b.txt") == ["a/b.txt", "a/x/b.txt", "a/x/y/b.txt"]
    assert gone("a/*/b.txt") == ["a/x/b.txt"]
    assert gone("q?.md") == ["q1.md", "qa.md"] and gone("q[0-9].md") == ["q1.md"] and gone("q[!0-9].md") == ["qa.md"]
    assert gone("k+.c") == ["k+.c"] and gone("v/**") == ["v/w/f"] and gone("w") == ["v/w/f"] and gone("/w") == []
    assert gone("*.md", "!q1.md") == ["q12.md", "qa.md"] and gone("!q1.md", "*.md") == ["q1.md", "q12.md", "qa.md"]


def test_escaped_ignore_patterns(spark):
    lines = [("", 0, r"foo\*bar"), ("", 1, r"what\?"), ("", 2, r"\[x]"), ("", 3, r"back\\*"), ("", 4, r"\a*")]
    rules = compile_rules(spark.createDataFrame(lines, "dir string, ord int, line string"))
    paths = ["foo*bar", "fooxbar", "what?", "whats", "[x]", "x", "back\\slash", "backs", "abc", "\\abc", "d/foo*bar"]
    kept = apply_ignore(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    assert sorted(r.path for r in kept.collect()) == sorted(["fooxbar", "whats", "x", "backs", "\\abc"])


def test_extension_lists_are_taken_as_they_are(spark):
    files = spark.createDataFrame([("a.txt", 1), ("b.png", 1), ("c", 1)], "path string, length bigint")
    for extensions, want in ((None, ["a.txt"]), ([], []), (["*"], ["a.txt", "b.png", "c"]), (["png"], ["b.png"])):
        assert sorted(r.path for r in filter_ext(files, extensions).collect()) == want
        assert sorted(r.path for r in files.filter(is_eligible(extensions)).collect()) == want


def test_legacy_text_is_windows_1252(spark):
    raw = bytes([0x93, 0x41, 0x94, 0x80, 0x81, 0xE9])
    frame = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert frame.select(decode_text("b")).first()[0] == "\u201cA\u201d\u20ac\x81\xe9"


def test_ignore_files_and_their_precedence(spark, tmp_path):
    """The exclude file loses to .gitignore, which loses to .ignore; deeper ones win."""
    import os

    import termlake as tl
    src = tmp_path / "src"
    for name, text in {"a.txt": "x", "b.txt": "x", "c.txt": "x", "d.txt": "x", "sub/a.txt": "x", "sub/e.txt": "x",
                       ".git/info/exclude": "a.txt\nd.txt\n", ".gitignore": "!a.txt\nb.txt\nc.txt\n", ".ignore": "!c.txt\n",
                       "sub/.gitignore": "a.txt\n", "sub/.ignore": "!a.txt\ne.txt\n"}.items():
        os.makedirs((src / name).parent, exist_ok=True)
        (src / name).write_text(text)
    store = tl.CollectionStore(spark, str(tmp_path / "store"))
    store.create("c", [str(src)])
    store.build("c")
    found = {r.path.split("/src/")[1] for r in store.open("c").documents().collect()}
    assert found == {"a.txt", "c.txt", "sub/a.txt"}


def test_small_files_and_hidden_ones_are_shared_out(spark, tmp_path):
    """Not a task for every 32 files, and hidden files are not read in one task."""
    from termlake.sources.files import few_tasks
    for i in range(150):
        write(tmp_path, f"{i}.txt", f"text {i}")
        write(tmp_path, f".{i}.txt", f"text {i}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = scan_files(spark, [str(tmp_path)])
    assert listed.rdd.getNumPartitions() > n >= few_tasks(listed).rdd.getNumPartitions()
    assert few_tasks(listed).count() == 150
    read = read_hidden(hidden_files(spark, [str(tmp_path)], listed))
    assert read.rdd.getNumPartitions() == n
    assert sorted(bytes(r.content).decode() for r in read.collect()) == sorted(f"text {i}" for i in range(150))


def test_a_build_scans_its_folder_once_for_the_listing(spark, tmp_path, monkeypatch):
    """All steps but the one that reads texts are on the listing that the first wrote."""
    import termlake as tl
    from termlake.plans import store as st
    write(tmp_path, "src/a.txt", "fox")
    write(tmp_path, "src/b.log", "fox")
    write(tmp_path, "src/.c.log", "fox")
    write(tmp_path, "src/.gitignore", "*.log\n")
    given = []
    seen = lambda f: lambda *a: (given.append(a), f(*a))[1]
    for name in ("hidden_files", "ignore_lines", "apply_ignore"):
        monkeypatch.setattr(st, name, seen(getattr(st, name)))
    store = tl.CollectionStore(spark, str(tmp_path / "store"))
    store.create("c", [str(tmp_path / "src")])
    assert store.build_full("c")["indexed"] == 1 and store.build("c")["unchanged"] == 1
    frames = [x for a in given for x in a if hasattr(x, "_jdf")]
    assert len(given) == 8 and not any("binaryFile" in x._jdf.queryExecution().optimizedPlan().toString() for x in frames)


@pytest.fixture
def odd_tree(tmp_path):
    for n in ("a.txt", "b c.md", "50%.txt", "100%25.txt", "x#y?.txt", "ü.txt", ".h.txt", "_u.txt", "_k=v.txt", "t._COPYING_",
              "_metadata", "_metadata_x/m.txt", "_k=v/w.txt", "_hid/x.txt", ".hid/x.txt", "d/e/f/g.txt", "d/h i/j.txt", "z/k.gz"):
        write(tmp_path, n, "text " + n)
    write(tmp_path, "empty.txt", "")
    write(tmp_path, "d/none.md", "")
    os.makedirs(tmp_path / "bare/er")
    os.symlink(tmp_path / "a.txt", tmp_path / "d/link.txt")
    os.symlink(tmp_path / "d/e", tmp_path / "z/linked")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.txt")
    os.utime(tmp_path / "a.txt", ns=(0, 1_234_567_891_234_567_890))
    return tmp_path


@pytest.mark.parametrize("entries", [1, 20_000])
def test_tasks_list_what_spark_lists(spark, odd_tree, monkeypatch, entries):
    """The driver holds no list of files, and the rows are those of Spark's own listing."""
    from termlake.sources import walk
    from termlake.sources.files import spark_scan
    monkeypatch.setattr(walk, "WALKED_ENTRIES", entries)  # with 1, a round for each level
    roots = [str(odd_tree), f"{odd_tree}/d", f"{odd_tree}/d/e/"]
    found = scan_files(spark, roots)
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    rows = lambda df: sorted((r.path, r.modificationTime, r.length, bytes(r.content), r.copy) for r in df.collect())
    assert rows(found) == rows(spark_scan(spark, roots)) and found.count() == 18
    assert rows(scan_files(spark, [f"{odd_tree}/[dz]"])) == rows(spark_scan(spark, [f"{odd_tree}/[dz]"]))
    assert rows(scan_files(spark, [f"{odd_tree}/a.txt"])) == rows(spark_scan(spark, [f"{odd_tree}/a.txt"]))
    assert rows(scan_files(spark, [f"file://{odd_tree}", f"file:{odd_tree}/d/"])) == rows(spark_scan(spark, roots[:2]))
    assert scan_files(spark, []).count() == 0


def test_a_listing_is_kept_where_it_is_told(spark, tmp_path):
    write(tmp_path, "src/a.txt", "x")
    found = scan_files(spark, [str(tmp_path / "src")], work=str(tmp_path / "work"))
    write(tmp_path, "src/b.txt", "x")
    os.remove(tmp_path / "src/a.txt")
    assert (tmp_path / "work").is_dir() and names(found, tmp_path) == ["src/a.txt"] and found.first().content is None
    assert documents(found).count() == 0


def test_files_are_read_once_and_only_if_asked_for(spark, tmp_path):
    write(tmp_path, "a.txt", "x")
    found = scan_files(spark, [str(tmp_path)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(documents(found)).split("== Initial Plan")[0].count("ArrowEvalPython") == 1
    assert "ArrowEvalPython" not in plan(found.select("path", "length"))


def test_large_directories_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    from termlake.sources import walk
    import pandas as pd
    monkeypatch.setattr(walk, "HELD_ENTRIES", 4)
    monkeypatch.setattr(walk, "HELD_BYTES", 10)
    for i in range(10):
        write(tmp_path, f"{i}.txt", "12345")
    top = pd.DataFrame({"path": [f"file:{tmp_path}"], "copy": [0]})
    parts = list(walk._walk(iter([top])))
    assert [len(p) for p in parts] == [4, 4, 2]
    assert [len(p) for p in walk._read(iter([pd.concat(parts, ignore_index=True)]))] == [2] * 5
