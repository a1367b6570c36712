"""
tables, and the SQL that states the same results (``oracle.py``).

Searches run on a collection that Spark builds from ``documents`` once per
session and table version, in the shared folder ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle
import termlake as tl
from termlake.functions import text as txt
from termlake.functions.fuzzy import edit_distance
from termlake.functions.snippet import (best_window, snippet_fallback, snippet_highlight, snippet_text)
from termlake.operators import postings as post
from termlake.operators import sync
from termlake.operators.many import query_rows
from termlake.operators.rank import top_k
from termlake.operators.scan import scan
from termlake.plans import store as st
from termlake.plans.collection import Collection
from termlake.schema import DOCUMENT_COLS
from termlake.sources import files as fs
from termlake.sources.hidden import _open_dir
from termlake.sources.ignore import apply_ignore, compile_rules

if find_spec("corpus_pipeline") and find_spec("termlake.llm"):  # a part that can be left out
    import corpus_pipeline
    from termlake.llm import queries as llm
else:
    llm = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


# --- inputs -----------------------------------------------------------------

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: path, filename, ext, content, modified, size."""
    ext = (F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "de", "md")
           .when(F.col("lang") == "fr", "log").otherwise("bin"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)
    return _table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", name).alias("path"), name.alias("filename"), ext.alias("ext"),
        F.col("text").alias("content"),
        (F.lit(1700000000000) + F.col("doc_id") * 1000).alias("modified"),
        F.octet_length("text").cast("bigint").alias("size"), "doc_id", "lang")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(*DOCUMENT_COLS)


def stored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the corpus: some documents missing, some older."""
    older = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return (corpus(spark, sf_dir)
            .filter((F.col("doc_id") % 10 != 0) & ((F.col("lang") != "es") | (F.col("doc_id") % 3 == 0)))
            .withColumn("modified", F.col("modified") - older).select(*DOCUMENT_COLS))


def listed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state a sync finds."""
    return corpus(spark, sf_dir).filter(F.col("doc_id") % 13 != 0).select(*DOCUMENT_COLS)


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as undecoded files: a third UTF-16, a third windows-1252 where
    Latin-1 can say the text, with quotes and a euro sign at its end, and a NUL byte after every fifth text."""
    c, utf8 = F.col("content"), F.encode("content", "UTF-8")
    latin = c.rlike(r"\A[\x00-\xff]*\z")
    body = (F.when(F.col("doc_id") % 3 == 1, F.encode("content", "UTF-16"))
            .when((F.col("doc_id") % 3 == 2) & latin, F.concat(F.encode(F.when(latin, c).otherwise(""), "ISO-8859-1"), F.lit(b" \x93\x80\x94")))
            .otherwise(utf8))
    return corpus(spark, sf_dir).select(
        "path", F.timestamp_millis("modified").alias("modificationTime"),
        F.octet_length("content").cast("bigint").alias("length"), body.alias("body"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(utf8, F.lit(b"\x00"))).otherwise(utf8).alias("content"))


# --- a built collection per session -----------------------------------------

_built: dict[tuple, object] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares. Only a local session without one, as in
    tests, gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        key = ("own", spark.sparkContext.applicationId)
        if key not in _built:
            _built[key] = tempfile.mkdtemp(prefix="termlake-")
        base = _built[key]
    return f"{base}/termlake-{spark.sparkContext.applicationId}"


def _version_of(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    """Changes whenever the table is written again."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{table}.parquet")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first())


def _once(spark: SparkSession, sf_dir: str, kind: str, make: Callable, table: str = "documents"):
    key = (spark.sparkContext.applicationId, sf_dir, kind, _version_of(spark, sf_dir, table))
    if key not in _built:
        _built[key] = make(f"{shared_root(spark)}/store-{len(_built)}")
    return _built[key]


def collection(spark: SparkSession, sf_dir: str) -> Collection:
    def make(root):
        store = tl.CollectionStore(spark, root)
        store.create("Corpus", ["documents"])
        store.build_from("Corpus", docs(spark, sf_dir))
        return store.open("Corpus")
    return _once(spark, sf_dir, "corpus", make)


def synced(spark: SparkSession, sf_dir: str) -> tuple[tl.CollectionStore, list[dict]]:
    """A store whose collection was built from the earlier state, then synced."""
    def make(root):
        store = tl.CollectionStore(spark, root)
        store.create("Synced", ["documents"])
        first = store.build_from("Synced", stored_docs(spark, sf_dir))
        second = store.build_from("Synced", listed_docs(spark, sf_dir), extensions=fs.DEFAULT_EXTENSIONS)
        return store, [first, second]
    return _once(spark, sf_dir, "synced", make)


def _matching(condition, rename: str = "score"):
    def run(spark, sf_dir):
        return collection(spark, sf_dir).matches(condition).select("path", F.round("score", 6).alias(rename))
    return run


def _scanning(condition):
    return lambda spark, sf_dir: scan(docs(spark, sf_dir), condition).select("path")


def _top(condition, limit):
    def run(spark, sf_dir):
        m = collection(spark, sf_dir).matches(condition)
        return top_k(m, limit).select("path", "score")
    return run


def _hits(condition, limit, *drop):
    return lambda spark, sf_dir: collection(spark, sf_dir).search(condition, limit).drop(*drop)


# --- manifest rows that grow with the tables --------------------------------

def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest log with one collection per source and language: a row when it
    was created, one when it was built, and one when it was dropped."""
    per = corpus(spark, sf_dir).withColumn("source", F.substring_index("path", "/", 1)).groupBy(
        "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("modified").alias("at"))
    base = per.select(
        F.concat_ws(" ", F.initcap("source"), F.upper("lang")).alias("name"),
        F.concat_ws("-", "source", "lang").alias("dir"), F.array("source").alias("folders"), "n", "at", "lang")
    created = base.select("name", "dir", "folders", F.lit(0).cast("bigint").alias("doc_count"),
                          F.lit(None).cast("bigint").alias("last_built"), F.lit(1).alias("seq"),
                          F.lit(False).alias("dropped"), "lang")
    later = lambda seq, gone: base.select("name", "dir", "folders", F.col("n").alias("doc_count"),
                                          F.col("at").alias("last_built"), F.lit(seq).alias("seq"),
                                          F.lit(gone).alias("dropped"), "lang")
    return (created.unionByName(later(2, False).filter("lang <> 'fr'"))
            .unionByName(later(3, True).filter("lang = 'es'")).drop("lang"))


def _manifest(spark, sf_dir) -> DataFrame:
    return st.current_manifest(manifest_log(spark, sf_dir)).select(
        "name", "dir", F.array_join("folders", ",").alias("folders"), "doc_count", "last_built")


# --- queries that need more than a line --------------------------------------

IGNORE_RULES = [("", "src1/"), ("", "*.log"), ("", "!src2/*.log"), ("src3", "/1*.txt"), ("src3", "!*3.txt"),
                ("", "src4/**/*2.md"), ("src5", "[0-4]*.txt"), ("src6", r"1\*.txt"), ("src7", r"\2*.txt")]


def ignore_rules(spark, sf_dir):
    lines = spark.createDataFrame([(d, i, l) for i, (d, l) in enumerate(IGNORE_RULES)],
                                  "dir string, ord int, line string")
    return apply_ignore(docs(spark, sf_dir).select("path", "size"), compile_rules(lines))


def mtime_millis(spark, sf_dir):
    utc = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))
    return _table(spark, sf_dir, "events").select("event_id", txt.mtime_millis(utc).alias("modified"))


def classified(spark, sf_dir):
    listing = listed_docs(spark, sf_dir).select("path", "modified", "size")
    return sync.classify_changes(listing, sync.read_snapshot(stored_docs(spark, sf_dir)))


def upsert_documents(spark, sf_dir):
    changed = classified(spark, sf_dir).filter(F.col("status") == sync.CHANGED).select("path")
    fresh = listed_docs(spark, sf_dir).join(changed, "path", "left_semi")
    return (sync.upsert_documents(stored_docs(spark, sf_dir), changed, fresh)
            .select("path", "modified", "size"))


def build_stats(spark, sf_dir):
    seen = classified(spark, sf_dir)
    changed = seen.filter(F.col("status") == sync.CHANGED).select("path")
    removed = sync.removed_documents(sync.read_snapshot(stored_docs(spark, sf_dir)), seen)
    return sync.build_stats(seen, changed, removed)


def update_in_memory(spark, sf_dir):
    listing = listed_docs(spark, sf_dir).select("path", "modified", "size")
    return sync.update_incremental(stored_docs(spark, sf_dir), listing, listed_docs(spark, sf_dir)).select(
        "path", "modified", "size")


def build_collection(spark, sf_dir):
    store, _ = synced(spark, sf_dir)
    return store.list().select("name", "dir", "doc_count")


# --- the corpus as real files --------------------------------------------------

def put_files(rows: DataFrame, root: str) -> None:
    """Write each (path, content) as a file under ``root``, in tasks."""
    def put(frames):
        made = set()
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                filesystem, inner, _ = _open_dir(f"{root}/{path}")
                if (folder := inner.rsplit("/", 1)[0]) not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                with filesystem.open_output_stream(inner) as out:
                    out.write((content or "").encode())
            yield frame[["path"]]
    rows.select("path", "content").mapInPandas(put, "path string").count()


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each of ``documents``, every eleventh with a hidden name."""
    dot = F.when(F.col("doc_id") % 11 == 0, ".").otherwise("")
    return corpus(spark, sf_dir).withColumn("filename", F.concat(dot, "filename")).withColumn(
        "path", F.concat_ws("/", F.substring_index("path", "/", 1), "filename"))


def files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with these files, and ignore files in some of its folders."""
    def make(root):
        put_files(file_rows(spark, sf_dir), f"{root}/files")
        lines = [("src1/.gitignore", "*.log\n"), ("src2/.gitignore", "# texts\n/1*.txt\n!*3.txt\n"), ("src3/.ignore", "*.md\n")]
        put_files(spark.createDataFrame(lines, "path string, content string"), f"{root}/files")
        return f"{root}/files"
    return _once(spark, sf_dir, "files", make)


def _inside(path="path"):
    return F.regexp_extract(path, r"/files/(.*)\z", 1)


def scan_files(spark, sf_dir):
    found = fs.scan_files(spark, [files(spark, sf_dir)])
    return found.select(_inside().alias("path"), txt.ext_of("path").alias("ext"), "length")


def build_full(spark, sf_dir):
    """Everything in the folder anew: hidden files too, less what ignore files exclude."""
    folder = files(spark, sf_dir)

    def make(root):
        store = tl.CollectionStore(spark, root)
        store.create("Files", [folder])
        store.build_full("Files")
        return store
    rows = _once(spark, sf_dir, "full", make).open("Files").documents()
    return rows.select(_inside().alias("path"), "filename", "ext", "size", F.char_length("content").cast("bigint").alias("chars"))


def changed_files(spark: SparkSession, sf_dir: str) -> tuple[tl.CollectionStore, list[dict]]:
    """A folder that is built, changed and synced: some files are written anew, and
    some come to it."""
    def make(root):
        rows = file_rows(spark, sf_dir)
        put_files(rows, f"{root}/files")
        store = tl.CollectionStore(spark, f"{root}/store")
        store.create("Files", [f"{root}/files"])
        first = store.build("Files")
        again = rows.filter("doc_id % 7 = 0").withColumn("content", F.concat("content", F.lit(" again")))
        more = rows.filter("doc_id % 10 = 0").withColumn("path", F.concat(F.lit("more/"), "path"))
        put_files(again.unionByName(more), f"{root}/files")
        return store, [first, store.build("Files")]
    return _once(spark, sf_dir, "changed-files", make)


def read_changed_only(spark, sf_dir):
    """The files that the second sync read: those of its own gen."""
    coll = changed_files(spark, sf_dir)[0].open("Files")
    rows = coll._rows("documents", coll.version.gens[-1:])
    return rows.select(_inside().alias("path"), "size", F.char_length("content").cast("bigint").alias("chars"))


def build_files(spark, sf_dir):
    """What is in the collection after both syncs, with what a search finds."""
    coll = changed_files(spark, sf_dir)[0].open("Files")
    hits = coll.matches(tl.term("again")).select("path", F.lit(True).alias("hit"))
    return coll.documents().join(hits, "path", "left").select(
        _inside().alias("path"), "filename", "ext", "size", F.coalesce("hit", F.lit(False)).alias("hit"))


def field_stats(spark, sf_dir):
    rows = post.field_stats(post.index_rows(docs(spark, sf_dir)))
    return rows.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def vocab_distance(spark, sf_dir):
    """Terms within the distance that a query's digits stand for."""
    v = collection(spark, sf_dir).vocabulary().filter("field = 'content'")
    distance = edit_distance(F.col("term"), "thier")
    return v.select("term", distance.alias("distance"), *[
        (distance <= txt.fuzzy_distance(d)).alias(f"within_{d or 'none'}") for d in ("", "0", "2", "9", "300")])


def fuzzy_expansion(spark, sf_dir):
    v = collection(spark, sf_dir).vocabulary().filter("field = 'content'")
    return v.filter(F.col("term").rlike(txt.whole_token(txt.glob_to_regex("t?e*n")))).select("term", "df")


def snippet_best(spark, sf_dir):
    w = best_window("content", oracle.SNIPPET_WEIGHTS)
    return docs(spark, sf_dir).select("path", w.alias("w")).select(
        "path", F.col("w.start").cast("bigint").alias("from_char"),
        F.col("w.end").cast("bigint").alias("to_char"), F.round("w.weight", 6).alias("weight"))


def by_language(spark: SparkSession, sf_dir: str) -> tl.CollectionStore:
    """A store of three collections, of which one is built and one dropped."""
    def make(root):
        store = tl.CollectionStore(spark, root)
        for lang in ("en", "de", "fr"):
            store.create(f"Docs {lang}", [lang])
        store.build_from("Docs en", corpus(spark, sf_dir).filter("lang = 'en'").select(*DOCUMENT_COLS))
        store.drop("Docs fr")
        return store
    return _once(spark, sf_dir, "by-language", make)


def by_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tl.CollectionStore]:
    """A store with a collection for each source of ``documents``, as it was created, and
    the store after every other one was dropped."""
    def make(root):
        store = tl.CollectionStore(spark, root)
        names = [r.source for r in _table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").collect()]
        for name in names:
            store.create(f"Docs: {name}", [name, f"more/{name}"])
        store.list().write.parquet(f"{root}-created")
        for name in names[::2]:
            store.drop(f"Docs: {name}")
        return spark.read.parquet(f"{root}-created"), store
    return _once(spark, sf_dir, "by-source", make)


def create_collection(spark, sf_dir):
    return by_source(spark, sf_dir)[0].select("name", "dir", F.array_join("folders", ",").alias("folders"), "doc_count", "last_built")


def get_collection(spark, sf_dir):
    row = by_language(spark, sf_dir).get("Docs en")
    return spark.createDataFrame([(row.name, row.dir, ",".join(row.folders), row.doc_count)],
                                 "name string, dir string, folders string, doc_count bigint")


def unique_dir(spark, sf_dir):
    """Names of which many have the same slug, and some one with a number."""
    number = F.when(F.col("p_partkey") % 7 == 0, " 2").when(F.col("p_partkey") % 11 == 0, "-3").otherwise("")
    return st.unique_dirs(_table(spark, sf_dir, "part").select(
        F.concat(F.substring_index("p_name", " ", 1), number).alias("name"), F.col("p_partkey").alias("ord")),
        f"{shared_root(spark)}/names-{uuid.uuid4().hex}")


def search_many(spark, sf_dir):
    """One query per source of ``documents``: its most frequent content word of
    at least six letters with "the", or without "der" any document on "und"."""
    def make(root):
        src = docs(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("query_id"),
                                         F.explode(txt.tokens("content")).alias("word"))
        counted = (src.filter(F.char_length("word") >= 6)
                   .groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n")))
        best = counted.groupBy("query_id").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
        word = lambda g, w, neg: F.struct(F.lit(g).alias("grp"), w.alias("word"), F.lit(neg).alias("negate"))
        (best.select("query_id", F.inline(F.array(
            word(1, F.col("word"), False), word(1, F.lit("the"), False),
            word(2, F.lit("und"), False), word(2, F.lit("der"), True)))).write.parquet(root))
        return root

    queries = spark.read.parquet(_once(spark, sf_dir, "asked", make))
    return collection(spark, sf_dir).search_many(queries, 20)


MANY = {"near": tl.near("and of the", 4), "self": tl.near("the the", 3), "regex": tl.regex("th(e|at|is)[a-e]?"),
        "phrase": tl.all_of(tl.phrase("of the"), tl.exclude(tl.term("der"))), "field": tl.match_field("ext", "md"),
        "mixed": tl.any_of(tl.all_of(tl.term("the"), tl.phrase("of the")), tl.all_of(tl.wildcard("und*"), tl.exclude(tl.term("der"))),
                           tl.exclude(tl.wildcard("e*"))),
        "const": tl.any_of(tl.wildcard("und*"), tl.fuzzy("thet", 1)), "not": tl.all_of(tl.exclude(tl.term("the")), tl.exclude(tl.term("und"))),
        "blank": None}


def search_many_conditions(spark, sf_dir):
    """Conditions of all kinds, and a blank one, in one result."""
    return collection(spark, sf_dir).search_many(query_rows(spark, MANY.items()), 30)


def empty_query(spark, sf_dir):
    """Blank queries beside real ones: each source asks for its most frequent word of
    at least six letters, and every other source, by number, for nothing."""
    def make(root):
        src = docs(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("query_id"), F.explode(txt.tokens("content")).alias("word"))
        counted = src.filter(F.char_length("word") >= 6).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("query_id").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
        blank = F.regexp_extract("query_id", r"(\d+)", 1).cast("int") % 2 == 1
        (best.select("query_id", F.lit(0).alias("grp"), F.when(blank, " ").otherwise(F.col("word")).alias("word"), F.lit(False).alias("negate"))
         .write.parquet(root))
        return root
    return collection(spark, sf_dir).search_many(spark.read.parquet(_once(spark, sf_dir, "blank", make)), 20)


def conversation_search(spark, sf_dir):
    """A search over another table: the turns of all conversations."""
    turns = _table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"),
        F.col("role").alias("filename"), F.lit("").alias("ext"), F.col("text").alias("content"),
        F.lit(0).cast("bigint").alias("modified"), F.octet_length("text").cast("bigint").alias("size"))

    def make(root):
        store = tl.CollectionStore(spark, root)
        store.create("Talk", ["conversations"])
        store.build_from("Talk", turns)
        return store.open("Talk")
    talk = _once(spark, sf_dir, "talk", make, "conversations")
    found = talk.matches(tl.any_of(tl.all_of(tl.term("the"), tl.exclude(tl.term("user"))), tl.phrase("de la")))
    return found.select("path", F.round("score", 6).alias("score"))


def page_scan(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"), txt.filename_of("url").alias("filename"), txt.ext_of("url").alias("ext"),
        F.col("html").alias("content"))
    return scan(p, tl.all_of(tl.term("nav"), tl.phrase("of the"))).select("path", "filename", "ext")


T, W = tl.term, tl.wildcard
SLICE = tl.all_of(T("the"), tl.exclude(T("der")))
COMBINED = tl.any_of(tl.all_of(T("the"), tl.phrase("of the")), tl.all_of(W("und*"), tl.exclude(T("der"))),
                     tl.exclude(W("e*")))
CONDITIONS = {
    "match_term": T("the"),
    "match_term_split": T("of-the"),
    "match_phrase": tl.phrase("of the"),
    "match_phrase_three": tl.phrase("that is the"),
    "match_near": tl.near("the of", 3),
    "match_near_three": tl.near("and of the", 4),
    "match_near_repeated": tl.near("the the", 3),
    "match_wildcard": W("th?n"),
    "match_wildcard_prefix": W("tion*"),
    "match_wildcard_any": W("*"),
    "match_wildcard_wide": W("*t*"),
    "match_regex": tl.regex("th(e|at|is)[a-e]?"),
    "match_fuzzy": tl.fuzzy("teh", 1),
    "match_fuzzy_two": tl.fuzzy("wihch", 2),
    "match_all": tl.match_all(),
    "match_field": tl.match_field("ext", "md"),
    "match_field_filename": tl.match_field("filename", "txt"),
    "match_path": tl.match_path("src1/1.txt"),
    "all_of": tl.all_of(T("the"), T("of"), T("this")),
    "any_of": tl.any_of(T("worthless"), tl.all_of(T("the"), T("und"))),
    "exclude": tl.all_of(T("the"), tl.exclude(tl.phrase("of the"))),
    "exclude_only": tl.all_of(tl.exclude(T("the")), tl.exclude(T("und"))),
    "score_combined": COMBINED,
}
SCANS = ["match_term", "match_phrase", "match_near", "match_near_three", "match_near_repeated",
         "match_wildcard", "match_regex", "match_fuzzy", "match_field", "any_of", "exclude", "exclude_only",
         "score_combined"]


def entry(spark: SparkSession) -> DataFrame:
    """Ranked top 50 for "the" without "der", with excerpts."""
    return collection(spark, SMOKE_DIR).search(SLICE)


HIT_SLICE = tl.any_of(T("worthless"), tl.all_of(T("und"), tl.phrase("of the")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    # sources
    q["scan_files"] = scan_files
    q["ignore_rules"] = ignore_rules
    q["ext_of"] = lambda s, d: _table(s, d, "pages").select("url", txt.ext_of("url").alias("ext"))
    q["filename_of"] = lambda s, d: _table(s, d, "pages").select("url", txt.filename_of("url").alias("filename"))
    q["filter_ext"] = lambda s, d: fs.filter_ext(docs(s, d)).select("path", "ext")
    q["filter_size"] = lambda s, d: fs.filter_size(
        docs(s, d).withColumnRenamed("size", "length"), 2000).select("path", "length")
    q["filter_binary"] = lambda s, d: fs.filter_binary(raw_files(s, d)).select("path")
    q["decode_text"] = lambda s, d: raw_files(s, d).select("path", txt.decode_text("body").alias("content"))
    q["documents"] = lambda s, d: fs.documents(raw_files(s, d), max_file_bytes=50_000).select(*DOCUMENT_COLS)
    q["mtime_millis"] = mtime_millis
    q["build_full"] = build_full
    q["open_or_create"] = lambda s, d: collection(s, d).documents().select("path", "modified", "size")
    q["read_snapshot"] = lambda s, d: sync.read_snapshot(collection(s, d).documents())
    q["count_docs"] = lambda s, d: collection(s, d).documents().agg(F.count(F.lit(1)).alias("n_docs"))
    # sync
    q["classify_changes"] = lambda s, d: classified(s, d).select("path", "status")
    q["read_changed_only"] = read_changed_only
    q["upsert_documents"] = upsert_documents
    q["removed_documents"] = lambda s, d: sync.removed_documents(
        sync.read_snapshot(stored_docs(s, d)), classified(s, d))
    q["update_incremental"] = lambda s, d: synced(s, d)[0].open("Synced").documents().select("path", "modified", "size")
    q["update_in_memory"] = update_in_memory
    q["update_vocabulary"] = lambda s, d: synced(s, d)[0].open("Synced").vocabulary()
    q["build_stats"] = build_stats
    # text tables
    q["tokenize"] = lambda s, d: post.tokenize(docs(s, d))
    q["postings"] = lambda s, d: post.postings(docs(s, d)).select(
        "term", "field", "path", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), "dl")
    q["vocabulary"] = lambda s, d: post.vocabulary(post.index_rows(docs(s, d)))
    q["field_stats"] = field_stats
    # conditions, combinators and scores
    for name, condition in CONDITIONS.items():
        q[name] = _matching(condition)
    for name in SCANS:
        q[f"scan_{name}"] = _scanning(CONDITIONS[name])
    q["score_bm25"] = _matching(T("und"))
    q["score_phrase"] = _matching(tl.phrase("in the"))
    q["score_const"] = _matching(tl.any_of(W("und*"), tl.fuzzy("thet", 1)))
    q["top_k"] = _top(T("the"), 50)
    q["search"] = _hits(SLICE, 50, "snippet")
    q["search_hits"] = _hits(HIT_SLICE, 50)
    q["hit_projection"] = _hits(tl.match_field("filename", "txt"), 100)
    q["search_beyond_key_limit"] = _hits(T("the"), 100_000, "snippet")
    q["match_no_token"] = _matching(tl.all_of(T("und"), tl.exclude(T("!!!"))))
    q["empty_query"] = empty_query
    q["search_many_conditions"] = search_many_conditions
    q["search_many"] = search_many
    q["conversation_search"] = conversation_search
    q["page_scan"] = page_scan
    # scalar functions
    q["snippet_best"] = snippet_best
    q["snippet_highlight"] = lambda s, d: docs(s, d).select(
        "path", snippet_highlight("content", ["the", "of"]).alias("snippet"))
    q["snippet_fallback"] = lambda s, d: docs(s, d).select("path", snippet_fallback("content").alias("snippet"))
    q["snippet_text"] = lambda s, d: docs(s, d).select(
        "path", snippet_text(snippet_highlight("content", ["the"])).alias("line"))
    q["slugify"] = lambda s, d: docs(s, d).select("path", txt.slugify("content").alias("slug"))
    q["glob_to_regex"] = fuzzy_expansion
    q["fuzzy_distance"] = vocab_distance
    # manifest
    q["list_collections"] = _manifest
    q["get_collection"] = get_collection
    q["drop_collection"] = lambda s, d: by_source(s, d)[1].list().select("name", "dir")
    q["unique_dir"] = unique_dir
    q["build_collection"] = build_collection
    q["build_files"] = build_files
    q["create_collection"] = create_collection
    q["load_collection"] = lambda s, d: collection(s, d).postings().select("term", "field", "path", "tf", "dl")
    if llm:
        q |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return q


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | (llm.oracle_sql() if llm else {})
