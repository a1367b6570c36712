"""A built collection: bucketed tables on shared storage, and searches on them.

``documents`` and ``postings`` are parquet tables bucketed by path. A document's
rows of every table are in the same bucket, so grouping a search's postings by
document, and joining them with documents or tombstones, needs no exchange, and
a word that is in every document is spread over all buckets. Inside a bucket
postings are sorted by term, so a search reads the row groups of its own terms.

Each build adds a ``gen`` partition. A replaced or removed path is listed in
``tombstones``: its rows of older gens are dead. A small sync therefore writes
as much as it changed. It takes along the latest gens that are not much larger
than itself: their live rows, tombstones and counts go into the new gen, bucket by
bucket, as they are. So gens grow geometrically and stay few, each row is copied a
number of times that grows with the logarithm of the changes, and the first gen,
which has most rows, is left alone until too many of its rows are dead."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fuzzy import MAX_RESTS, rests_of
from ..functions.snippet import with_snippet
from ..functions.text import grams_of
from ..operators.conditions import Condition, groups_of, leaves_of
from ..operators.many import search_many
from ..operators.match import SearchTables, highlight_weights, matches, resolve
from ..operators.postings import index_rows, text_rows
from ..operators.rank import FieldStats, top_k
from ..schema import DOCUMENT_COLS, HIT_COLS, KEY, TEXT_FIELDS
from ..sources.files import path_exists

DEFAULT_LIMIT = 50
BUCKET_BYTES = 16 * 1024 * 1024  # text per bucket, while the bucket count allows: its postings are sorted in a task's memory
SMALL_BUCKET_BYTES = 512 * 1024   # below MIN_BUCKETS, so that a small collection is still cut up
MIN_BUCKETS, MAX_BUCKETS = 8, 65536
LOOKUP_BYTES = 128 * 1024 * 1024  # of a look-up table's rows in one task, which sorts them in memory
SMALL_LOOKUP_BYTES = 16 * 1024 * 1024  # the same, while there are fewer tasks than cores
LOOKUP_ROW_BYTES = 64  # of a row without its term
MAX_LOOKUP_PARTS = 8192
COMPRESSION = "zstd"
# Largest number of rows that is ever sent to the driver or broadcast.
MAX_HITS_BY_KEY = 1000
MAX_BROADCAST_PATHS = 200_000
MAX_LITERAL_PATHS = 1000  # of replaced documents whose buckets alone are opened
MERGE_FACTOR = 2  # a gen of up to this many times the rows goes into the new one

TABLES = {
    "documents": ("path string, copy int, filename string, ext string, content string, "
                  "modified bigint, size bigint, gen bigint", "path"),
    "postings": ("path string, copy int, term string, field string, tf int, positions array<int>, "
                 "dl int, gen bigint", "term, field, path"),
    "tombstones": ("path string, gen bigint", "path"),
}


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least ``n``."""
    return 1 << (ceil(n) - 1).bit_length() if n > 1 else 1


def bucket_count(text_bytes: int) -> int:
    small = min(MIN_BUCKETS, power_of_two(text_bytes / SMALL_BUCKET_BYTES))
    return min(MAX_BUCKETS, max(small, power_of_two(text_bytes / BUCKET_BYTES)))


def lookup_parts(row_bytes: int, cores: int) -> int:
    """Tasks that sort so many bytes of a look-up table's rows."""
    large, small = ceil(row_bytes / LOOKUP_BYTES), ceil(row_bytes / SMALL_LOOKUP_BYTES)
    return max(1, min(MAX_LOOKUP_PARTS, large), min(cores, small))


@dataclass(frozen=True)
class Version:
    """What the manifest records of a built collection."""
    base: int                # names the directory and the first gen in it
    buckets: int
    gens: tuple[int, ...]
    n_docs: int
    rows: tuple[int, ...]    # of each gen: documents
    dead: tuple[int, ...]    # and tombstones
    lengths: tuple[tuple[str, int], ...]  # (field, total tokens)

    @property
    def n_tombstones(self) -> int:
        return sum(self.dead)

    def to_merge(self, size: int) -> tuple[int, ...]:
        """The latest gens, but never the first, that a gen of ``size`` rows takes along."""
        taken = []
        for gen, own in list(zip(self.gens, map(sum, zip(self.rows, self.dead)), strict=True))[:0:-1]:
            if own > MERGE_FACTOR * size:
                break
            taken.append(gen)
            size += own
        return tuple(taken)


class Collection:
    def __init__(self, spark: SparkSession, location: str, version: Version):
        self.spark, self.location, self.version = spark, location.rstrip("/"), version
        self.base_dir = f"{self.location}/{version.base}"
        self._register()

    # --- tables -------------------------------------------------------------

    def _table(self, kind: str) -> str:
        tag = hashlib.sha256(self.base_dir.encode()).hexdigest()[:16]
        return f"termlake_{tag}_{kind}"

    def _register(self) -> None:
        """Declare the external tables in this session's catalog. The files are
        self-describing, so any session can open them."""
        for kind, (columns, order) in TABLES.items():
            if not self.spark.catalog.tableExists(self._table(kind)):
                self.spark.sql(
                    f"CREATE TABLE {self._table(kind)} ({columns}) USING parquet OPTIONS (compression '{COMPRESSION}') "
                    f"PARTITIONED BY (gen) CLUSTERED BY (path) SORTED BY ({order}) "
                    f"INTO {self.version.buckets} BUCKETS LOCATION '{self.base_dir}/{kind}'")
        known = {r.partition for r in self.spark.sql(f"SHOW PARTITIONS {self._table('documents')}").collect()}
        if any(f"gen={g}" not in known for g in self.version.gens):
            for kind in TABLES:  # an empty build leaves no files behind
                if path_exists(self.spark, f"{self.base_dir}/{kind}"):
                    self.spark.sql(f"ALTER TABLE {self._table(kind)} RECOVER PARTITIONS")

    def unregister(self) -> None:
        for kind in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(kind)}")

    def _rows(self, kind: str, gens=None) -> DataFrame:
        """Rows of committed builds; an interrupted build's gen is not listed."""
        return self.spark.table(self._table(kind)).filter(F.col("gen").isin(list(gens or self.version.gens)))

    def _live(self, rows: DataFrame, also: int | None = None, n_also: int = 0) -> DataFrame:
        """Drop rows that a later build replaced or removed; ``also`` is a gen in the
        making with ``n_also`` tombstones."""
        n = self.version.n_tombstones + n_also
        if not n:
            return rows
        dead = self._rows("tombstones", [*self.version.gens, *([also] if also else [])])
        dead = dead.groupBy("path").agg(F.max("gen").alias("_dead"))
        if n <= MAX_BROADCAST_PATHS:
            dead = F.broadcast(dead)
        dead = dead.withColumnRenamed("path", "_path")
        return rows.join(dead, (rows["path"] == dead["_path"]) & (rows["gen"] < dead["_dead"]), "left_anti")

    def keyed_documents(self) -> DataFrame:
        return self._live(self._rows("documents"))

    def documents(self) -> DataFrame:
        return self.keyed_documents().select(*DOCUMENT_COLS)

    def postings(self) -> DataFrame:
        return self._live(text_rows(self._rows("postings"))).select(
            "term", "field", "path", "tf", "positions", "dl")

    def vocab(self) -> DataFrame:
        """(term, field, df); a term's rows add up over builds."""
        return (self.spark.read.option("basePath", f"{self.base_dir}/vocab")
                .schema("term string, field string, df bigint, gen bigint")
                .parquet(f"{self.base_dir}/vocab").filter(F.col("gen").isin(list(self.version.gens)) & (F.col("term") != "")))

    def _lookup(self, kind: str, key: str) -> DataFrame:
        path = f"{self.base_dir}/{kind}"
        return (self.spark.read.option("basePath", path).schema(f"{key} string, term string, gen bigint")
                .parquet(path).filter(F.col("gen").isin(list(self.version.gens))))

    def grams(self) -> DataFrame:
        """(gram, term) of the content terms that some build added."""
        return self._lookup("grams", "gram")

    def rests(self) -> DataFrame:
        """(rest, term) of the content terms that some build added."""
        return self._lookup("rests", "rest")

    def vocabulary(self) -> DataFrame:
        return self.vocab().groupBy("term", "field").agg(F.sum("df").alias("df")).filter("df > 0")

    def stats(self) -> dict[str, FieldStats]:
        n = self.version.n_docs
        return {f: FieldStats(n, total / n if n else 0.0) for f, total in self.version.lengths}

    def count_docs(self) -> int:
        return self.version.n_docs

    # --- writing ------------------------------------------------------------

    def write_gen(self, gen: int, docs: DataFrame, dead: DataFrame | None, n_bytes: int,
                  merge: tuple[int, ...] = ()) -> Version:
        """Add one build: fresh documents, the paths whose older rows die, and the gens
        that it takes along. The only exchange of text is the one that puts fresh
        documents into buckets; what is taken along is in its buckets already."""
        v = self.version
        parts = min(v.buckets, max(MIN_BUCKETS, power_of_two(n_bytes / BUCKET_BYTES)))
        number = F.lit(gen).cast("bigint").alias("gen")
        (docs.select("path", "copy", *DOCUMENT_COLS[1:], number).repartition(parts, "path")
         .write.insertInto(self._table("documents")))
        fresh = self._rows("documents", [gen])
        index_rows(fresh).select("path", "copy", "term", "field", "tf", "positions", "dl", "gen").write.insertInto(
            self._table("postings"))
        n_dead = 0
        if dead is not None:
            dead.select("path", number).repartition(parts, "path").write.insertInto(self._table("tombstones"))
            n_dead = self._rows("tombstones", [gen]).count()

        # One table of what the build adds to the counts; rows with an empty term have the lengths.
        counts = lambda rows, sign: rows.filter(F.col("field").isin(*TEXT_FIELDS)).select(
            "term", "field", F.lit(sign).cast("bigint").alias("df"), (sign * F.col("dl")).cast("bigint").alias("total_dl"))
        change = counts(self._rows("postings", [gen]), 1)
        if n_dead:
            change = change.unionByName(counts(self._postings_of(self._rows("tombstones", [gen]).select("path"), n_dead), -1))
        length = F.col("term") == ""
        sums = [F.sum("df").alias("df"), F.sum(F.when(length, F.col("total_dl"))).alias("total_dl"),
                F.sum(F.when(length & (F.col("df") > 0), F.col("df"))).alias("fresh")]
        change = change.groupBy("term", "field").agg(*sums)
        vocab = f"{self.base_dir}/vocab"
        table = lambda *gens: self.spark.read.option("basePath", vocab).schema(
            "term string, field string, df bigint, total_dl bigint, fresh bigint").parquet(*[f"{vocab}/gen={g}" for g in gens])
        if merge:
            change = (change.unionByName(table(*merge).filter("term <> ''").drop("gen")).groupBy("term", "field")
                      .agg(F.sum("df").alias("df"), F.sum("total_dl").alias("total_dl"), F.sum("fresh").alias("fresh")))
        (change.filter((F.col("df") != 0) | length).repartitionByRange("term").sortWithinPartitions("term", "field")
         .write.mode("append").parquet(f"{vocab}/gen={gen}", compression=COMPRESSION))
        terms = table(gen).filter((F.col("field") == "content") & (F.col("df") > 0) & (F.col("term") != ""))
        # Each row holds its term, so tasks are as many as the terms' bytes, once for each of their rows, need.
        row = F.octet_length("term") + LOOKUP_ROW_BYTES
        sizes = terms.agg(F.sum(F.char_length("term").cast("bigint") * row), F.sum(row.cast("bigint") * MAX_RESTS)).first()
        cores = self.spark.sparkContext.defaultParallelism
        for (kind, key, keys), size in zip((("grams", "gram", grams_of("term")), ("rests", "rest", rests_of(F.col("term")))), sizes, strict=True):
            (terms.select(F.explode(keys).alias(key), "term").repartitionByRange(lookup_parts(size or 0, cores), key)
             .sortWithinPartitions(key, "term").write.mode("append")
             .parquet(f"{self.base_dir}/{kind}/gen={gen}", compression=COMPRESSION))
        own = {r.field: r for r in table(gen).filter(length).collect()}
        value = lambda f, name: (own[f][name] or 0) if f in own else 0
        n_docs = value("content", "fresh")
        if merge:
            self._take_along(gen, merge, n_dead)
            n_docs, n_dead = (self._rows(kind, [gen]).count() for kind in ("documents", "tombstones"))
        left = [i for i, g in enumerate(v.gens) if g not in merge]
        total = dict(v.lengths)
        return Version(v.base, v.buckets, (*(v.gens[i] for i in left), gen), v.n_docs + value("content", "df"),
                       (*(v.rows[i] for i in left), n_docs), (*(v.dead[i] for i in left), n_dead),
                       tuple((f, total.get(f, 0) + value(f, "total_dl")) for f in TEXT_FIELDS))

    def _take_along(self, gen: int, merge: tuple[int, ...], n_dead: int) -> None:
        """Append the live rows and the tombstones of the gens ``merge`` to ``gen``. They
        are read from their buckets and written to the same ones, without an exchange."""
        number = F.lit(gen).cast("bigint").alias("gen")
        for kind in ("documents", "postings"):
            rows = self._live(self._rows(kind, merge), gen, n_dead)
            rows.select(*[c for c in rows.columns if c != "gen"], number).write.insertInto(self._table(kind))
        new = self._rows("tombstones", [gen]).select("path")
        old = self._rows("tombstones", merge).select("path").distinct().join(new, "path", "left_anti")
        old.select("path", number).write.insertInto(self._table("tombstones"))

    def _postings_of(self, paths: DataFrame, n: int) -> DataFrame:
        """(term, field, dl) rows of documents that die. No text is read, and for few
        paths only their buckets."""
        rows = self._live(self._rows("postings").select("path", "gen", "term", "field", "dl"))
        if n <= MAX_LITERAL_PATHS:
            return rows.filter(F.col("path").isin([r.path for r in paths.collect()]))
        return rows.join(F.broadcast(paths) if n <= MAX_BROADCAST_PATHS else paths, "path", "left_semi")

    # --- searching ----------------------------------------------------------

    def search_tables(self) -> SearchTables:
        return SearchTables(self._rows("postings"), self.vocab(), self.stats(), self.grams(), self.rests())

    def matches(self, condition: Condition, res=None) -> DataFrame:
        """(path, copy, gen, score) of every live matching document, lazily."""
        return self._live(matches(self.search_tables(), condition, res))

    def search(self, condition: Condition, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """The best ``limit`` hits with their metadata and an excerpt.

        Top-k runs on keys and scores only. Its keys are few, so they go back as
        literals, with which the scan of the texts opens their buckets alone. For
        a larger ``limit`` they are broadcast, or joined bucket by bucket."""
        if limit < 1:
            raise ValueError("limit must be at least 1")
        res = resolve(self.vocab(), leaves_of(groups_of(condition)), grams=self.grams(), by_rest=self.rests())
        top = top_k(self.matches(condition, res), limit, KEY)
        docs = self._rows("documents")
        if limit <= MAX_HITS_BY_KEY:
            rows = top.collect()
            top = self.spark.createDataFrame(rows, top.schema)
            docs = docs.filter(F.col("path").isin([r.path for r in rows]) if rows else F.lit(False))
        if limit <= MAX_BROADCAST_PATHS:
            top = F.broadcast(top)
        hits = with_snippet(join_by_path(docs, top), highlight_weights(condition, res))
        return hit_projection(hits).orderBy(F.desc("score"), "path").limit(limit)

    def search_many(self, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Best hits of each query of a DataFrame; see ``operators.many``."""
        return search_many(self.search_tables(), queries, limit, self._live)

    def search_text(self, condition: Condition | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Like ``search``; no condition, as from a blank input, gives no hits."""
        if condition is None:
            return self.spark.createDataFrame([], hit_schema())
        return self.search(condition, limit)


def join_by_path(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Join on the full key. Only the path is an equality, so that the bucketed
    side stays where it is; the rest of the key is compared as a range."""
    keys = keys.select(*[F.col(k).alias(f"_{k}") for k in KEY], *[c for c in keys.columns if c not in KEY])
    same = docs["path"] == keys["_path"]
    for k in KEY[1:]:
        same = same & (docs[k] >= keys[f"_{k}"]) & (docs[k] <= keys[f"_{k}"])
    return docs.join(keys, same).drop(*[f"_{k}" for k in KEY])


def hit_schema() -> str:
    return ("path string, filename string, ext string, size bigint, modified bigint, "
            "score double, snippet string")


def hit_projection(hits: DataFrame) -> DataFrame:
    """The columns of a hit, with empty text and 0 for what is missing."""
    zero = {"size": F.lit(0).cast("bigint"), "modified": F.lit(0).cast("bigint"), "score": F.lit(0.0)}
    return hits.select(*[F.coalesce(F.col(c), zero.get(c, F.lit(""))).alias(c) for c in HIT_COLS])


def empty_version(base: int, text_bytes: int) -> Version:
    return Version(base, bucket_count(text_bytes), (), 0, (), (), tuple((f, 0) for f in TEXT_FIELDS))
