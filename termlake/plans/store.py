"""Named collections under one root on shared storage.

The manifest is an append-only parquet log, one row per change; the current
state is the newest row of each name. Appending that row is the last step of a
build, so a build that fails before leaves the former state readable. One writer
at a time is assumed; readers are free."""

from __future__ import annotations

import sys
import time

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mtime_millis, slugify
from ..operators import sync
from ..operators.naming import unique_dirs  # noqa: F401
from ..operators.postings import with_key
from ..schema import DOCUMENT_COLS
from ..sources.files import (MAX_FILE_BYTES, disjoint_layers, documents as read_all, few_tasks, is_eligible, listed_files,
                             path_exists, read_documents)
from ..sources.hidden import hidden_files, ignore_lines
from ..sources.ignore import _small, apply_ignore, compile_rules
from ..sources.walk import read_listed, uri_of
from .collection import MAX_BROADCAST_PATHS, Collection, Version, bucket_count, empty_version

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

MANIFEST = ("name string, dir string, folders array<string>, doc_count bigint, last_built bigint, "
            "base bigint, previous_base bigint, buckets int, gens array<bigint>, gen_rows array<bigint>, gen_dead array<bigint>, "
            "retired array<bigint>, lengths map<string,bigint>, seq bigint, dropped boolean")
INFO_COLS = ["name", "dir", "folders", "doc_count", "last_built"]

# Above this share of dead or fresh documents a sync writes a new base, so a base is
# written anew only after half as many documents changed as it holds.
REWRITE_SHARE = 0.5
# With text for this many times its buckets a sync writes a new base too, with as
# many buckets as the text then needs.
MAX_BUCKET_GROWTH = 2
MAX_TIME_RANGES = 500


def current_manifest(log: DataFrame) -> DataFrame:
    """Newest row of each name, without dropped collections."""
    newest = log.groupBy("name").agg(F.max_by(F.struct(*log.columns), "seq").alias("r"))
    return newest.select("r.*").filter(~F.col("dropped"))


def first_free(slug: str, taken, counter: dict[str, int]) -> str:
    """``slug``, or the first of slug-2, slug-3, … that is not taken. ``counter``
    remembers how far each slug has come, as nothing is ever given back."""
    free, n = slug, counter.get(slug, 1)
    while free in taken:
        n += 1
        free = f"{slug}-{n}"
    counter[slug] = n if n > 1 else 1
    return free


class CollectionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- manifest -----------------------------------------------------------

    def _log(self) -> DataFrame:
        path = f"{self.root}/manifest"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def _current(self) -> DataFrame:
        return current_manifest(self._log())

    def _save(self, row: dict, last: int | None = None) -> None:
        """Append a row. ``last`` is the largest seq, if the caller has just read it."""
        last = last if last is not None else self._log().agg(F.max("seq")).first()[0] or 0
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        values = {**dict.fromkeys(names), **row, "seq": last + 1}
        (self.spark.createDataFrame([tuple(values[n] for n in names)], MANIFEST).coalesce(1)
         .write.mode("append").parquet(f"{self.root}/manifest"))

    def list(self) -> DataFrame:
        return self._current().select(*INFO_COLS)

    def _row(self, name: str) -> Row:
        row = self._current().filter(F.col("name") == name).first()
        if row is None:
            raise KeyError(f"{name!r} is not a collection of this store")
        return row

    def get(self, name: str) -> Row:
        row = self._row(name)
        return Row(**{c: row[c] for c in INFO_COLS})

    def location(self, info: Row) -> str:
        return f"{self.root}/{info.dir}"

    def create(self, name: str, folders: list[str]) -> Row:
        name = name.strip()
        if not name:
            raise ValueError("a collection needs a name")
        # One look at the log: a row per collection, the largest seq and the slug.
        newest = self._log().groupBy("name").agg(F.max_by(F.struct("dir", "dropped"), "seq").alias("r"), F.max("seq").alias("seq"))
        now = newest.agg(F.collect_list(F.when(~F.col("r.dropped"), F.struct("name", "r.dir"))).alias("current"),
                         F.max("seq").alias("last")).select("current", "last", slugify(F.lit(name)).alias("slug")).first()
        if any(r.name == name for r in now.current):
            raise ValueError(f"{name!r} is already in this store")
        taken, counter = {r.dir for r in now.current}, {}
        while path_exists(self.spark, f"{self.root}/{(free := first_free(now.slug, taken, counter))}"):
            taken.add(free)
        made = dict(name=name, dir=free, folders=list(folders), doc_count=0, last_built=None)
        self._save(dict(**made, gens=[], gen_rows=[], gen_dead=[], retired=[], lengths={}, dropped=False), now.last or 0)
        return Row(**made)

    def drop(self, name: str) -> None:
        """Forget a collection and delete its data; its sources stay."""
        is_it = (F.col("name") == name) & ~F.col("dropped")
        newest = self._log().groupBy("name").agg(F.max_by(F.struct(*[c.split()[0] for c in MANIFEST.split(", ")]), "seq").alias("r"))
        row, last = newest.select("r.*", "r").agg(F.first(F.when(is_it, F.col("r")), ignorenulls=True), F.max("seq")).first()
        if row is None:
            raise KeyError(f"{name!r} is not a collection of this store")
        self._save({**row.asDict(), "dropped": True}, last)
        if row.base is not None:
            self._collection(row).unregister()
        self._delete(f"{self.root}/{row.dir}")

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    # --- opening ------------------------------------------------------------

    def _collection(self, row: Row) -> Collection:
        version = Version(row.base, row.buckets, tuple(row.gens), row.doc_count, tuple(row.gen_rows), tuple(row.gen_dead),
                          tuple(sorted(row.lengths.items())))
        return Collection(self.spark, f"{self.root}/{row.dir}", version)

    def open(self, name: str) -> Collection:
        row = self._row(name)
        if row.base is None:
            raise LookupError(f"collection {name!r} is not built yet")
        return self._collection(row)

    # --- building -----------------------------------------------------------

    def _now(self, row: Row) -> int:
        return max([int(time.time() * 1000), *((g + 1) for g in row.gens or [])])

    def _commit(self, row: Row, version: Version) -> None:
        """Switch to the new version. The base before last is deleted, and so are gens
        that went into another one before last, so searches that still run on the
        former version can finish."""
        rebased = version.base != row.base
        merged = [] if rebased else [g for g in row.gens if g not in version.gens]
        self._save({**row.asDict(), "doc_count": version.n_docs, "last_built": int(time.time() * 1000),
                    "base": version.base, "previous_base": row.base if rebased else row.previous_base,
                    "buckets": version.buckets, "gens": list(version.gens),
                    "gen_rows": list(version.rows), "gen_dead": list(version.dead), "retired": merged,
                    "lengths": dict(version.lengths)})
        for gen in row.retired if row.base is not None and version.gens != tuple(row.gens) else ():
            for kind in ("documents", "postings", "tombstones", "vocab", "grams", "rests"):
                self._delete(f"{self.root}/{row.dir}/{row.base}/{kind}/gen={gen}")
        if rebased and row.previous_base is not None:
            self._delete(f"{self.root}/{row.dir}/{row.previous_base}")

    def _rebase(self, row: Row, gen: int, docs: DataFrame, n_bytes: int) -> Version:
        fresh = Collection(self.spark, f"{self.root}/{row.dir}", empty_version(gen, n_bytes))
        return fresh.write_gen(gen, docs, None, n_bytes)

    def build_full(self, name: str, extensions=None, max_file_bytes: int = MAX_FILE_BYTES,
                   missing_roots: str = "error", hidden: bool = True, ignore_files: bool = True) -> dict:
        """Index every eligible file anew. A file under two overlapping folders
        becomes two documents. Options as for ``build``."""
        row = self._row(name)
        gen = self._now(row)
        work = f"{self.root}/{row.dir}/sync-{gen}"
        listed, visible, unseen = self._files(row, work, missing_roots, hidden, ignore_files)
        listing = listed if unseen is None else listed.unionByName(unseen)
        able = is_eligible(extensions, max_file_bytes)
        seen = listing.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(able, F.col("length"))).alias("bytes")).first()
        read = lambda files: read_documents(read_listed(files.filter(able), seen["bytes"] or 0))
        if visible is None:
            docs = read(listing)
        else:
            docs = read_all(visible, extensions, max_file_bytes)
            docs = docs if unseen is None else docs.unionByName(read(unseen))
        version = self._rebase(row, gen, docs, seen["bytes"] or 0)
        self._commit(row, version)
        self._delete(work)
        return dict(indexed=version.n_docs, skipped=seen["n"] - version.n_docs, files_seen=seen["n"],
                    unchanged=0, removed=0)

    def build(self, name: str, extensions=None, max_file_bytes: int = MAX_FILE_BYTES,
              missing_roots: str = "error", hidden: bool = True, ignore_files: bool = True) -> dict:
        """Bring a collection up to date with its folders; returns the counts.

        ``hidden`` includes files whose names start with ``.`` or ``_``, which
        Spark does not list itself; ``ignore_files`` obeys ignore files."""
        row = self._row(name)
        gen = self._now(row)
        work = f"{self.root}/{row.dir}/sync-{gen}"
        listed, visible, unseen = self._files(row, work, missing_roots, hidden, ignore_files)
        meta = lambda files, is_hidden: files.select(
            "path", "copy", mtime_millis("modificationTime").alias("modified"), F.col("length").alias("size"),
            "modificationTime", F.lit(is_hidden).alias("hidden"))
        listing = meta(listed, False)
        if unseen is not None:
            listing = listing.unionByName(meta(unseen, True))

        def fetch(changed, everything, n_bytes):
            read = lambda files: read_documents(read_listed(files.withColumnRenamed("size", "length"), n_bytes))
            if visible is None:
                return read(changed)
            mine = changed.filter(~F.col("hidden"))
            docs = (read_all(visible, extensions, max_file_bytes) if everything
                    else self._read_changed(visible, mine, extensions, max_file_bytes))
            return docs if unseen is None else docs.unionByName(read(changed.filter("hidden")))

        return self._sync(row, gen, work, listing, fetch, extensions, max_file_bytes)

    def _files(self, row: Row, work: str, missing_roots: str, hidden: bool, ignore_files: bool):
        """(listing of the files Spark would list, Spark's scan of them or None, hidden files
        or None), without what ignore files exclude. Without a scan, tasks list the files and
        read those that are named to them. A listing looks at each file of a folder, so there
        is one; every step reads what that one wrote."""
        def written(df, step):
            df.write.parquet(f"{work}/{step}")
            return self.spark.read.schema(df.schema).parquet(f"{work}/{step}")

        roots = list(row.folders)
        listed, visible = listed_files(self.spark, roots, f"{work}/visible", missing_roots)
        unseen = None
        if visible is not None:
            listed = written(few_tasks(listed), "visible")
            visible = few_tasks(visible, listed.agg(F.sum("length")).first()[0] or 0)
        if hidden:
            for i, layer in enumerate(disjoint_layers([uri_of(r) for r in roots if path_exists(self.spark, r)])):
                own = hidden_files(self.spark, layer, listed.filter(F.col("copy") == i)).withColumn("copy", F.lit(i))
                unseen = own if unseen is None else unseen.unionByName(own)
        if unseen is not None:
            unseen = written(unseen, "hidden")  # directories are listed once per build
            unseen = None if unseen.isEmpty() else unseen
        if not ignore_files:
            return listed, visible, unseen
        paths = listed.select("path")
        if unseen is not None:
            paths = paths.unionByName(unseen.select("path"))
        rules = written(compile_rules(ignore_lines(self.spark, paths)), "rules")
        if rules.isEmpty():
            return listed, visible, unseen
        kept = written(apply_ignore(listed, rules), "kept")
        if visible is not None:
            gone = written(listed.select("path").distinct().join(kept, "path", "left_anti"), "gone")
            visible = visible.join(_small(gone), "path", "left_anti")
        return kept, visible, unseen if unseen is None else apply_ignore(unseen, rules)

    def build_from(self, name: str, docs: DataFrame, extensions=("*",),
                   max_file_bytes: int = MAX_FILE_BYTES) -> dict:
        """Like ``build``, from a documents DataFrame with one row per path."""
        row = self._row(name)
        docs = with_key(docs).select("path", "copy", *DOCUMENT_COLS[1:])
        able = docs.filter(is_eligible(extensions, max_file_bytes, "path", "size"))
        fetch = lambda changed, everything, n_bytes: able if everything else able.join(changed, "path", "left_semi")
        gen = self._now(row)
        return self._sync(row, gen, f"{self.root}/{row.dir}/sync-{gen}", docs.select("path", "copy", "modified", "size"),
                          fetch, extensions, max_file_bytes)

    def _read_changed(self, files, changed, extensions, max_file_bytes) -> DataFrame:
        """Document rows of the changed files: the file scan, narrowed to the hours
        in which changed files were modified, joined with them. Only files of those
        hours are opened, and one that is gone by then is left out."""
        hour = 3_600_000
        slots = changed.select(F.floor(F.col("modified") / hour).alias("h")).distinct()
        hours = sorted(r.h for r in slots.limit(MAX_TIME_RANGES + 1).collect())
        if len(hours) > MAX_TIME_RANGES:
            lo, hi = changed.agg(F.min("modified"), F.max("modified")).first()
            ranges = [(lo, hi)]
        else:
            ranges = [(h * hour, (h + 1) * hour) for h in hours]
        when = F.lit(False)
        for lo, hi in ranges:
            when = when | ((F.col("modificationTime") >= F.timestamp_millis(F.lit(lo)))
                           & (F.col("modificationTime") <= F.timestamp_millis(F.lit(hi + 1))))
        picked = files.filter(is_eligible(extensions, max_file_bytes) & when)
        mine = changed.select("path", F.col("copy").alias("_copy"))
        # Comparing with <= keeps the join on the path alone, as the buckets are.
        return read_documents(picked.join(mine, "path").filter(F.col("copy") <= F.col("_copy")).drop("_copy"))

    def _sync(self, row: Row, gen: int, work: str, listing: DataFrame, fetch, extensions, max_file_bytes) -> dict:
        old = self._collection(row) if row.base is not None else None
        snapshot = (sync.read_snapshot(old.documents()) if old
                    else self.spark.createDataFrame([], "path string, modified bigint"))
        # Written once, so that every later step decides on the same listing.
        sync.classify_changes(listing, snapshot, extensions, max_file_bytes).write.parquet(f"{work}/listing")
        seen = self.spark.read.parquet(f"{work}/listing")
        changed_rows = seen.filter(F.col("status") == sync.CHANGED)
        n = seen.agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if(F.col("status") == sync.UNCHANGED).alias("unchanged"),
            F.count_if(F.col("status") == sync.CHANGED).alias("changed"),
            F.count_if((F.col("status") == sync.CHANGED) & F.col("stored")).alias("replaced"),
            F.sum(F.when(F.col("status") == sync.CHANGED, F.col("size"))).alias("changed_bytes"),
            F.sum(F.when(F.col("status") != sync.INELIGIBLE, F.col("size"))).alias("bytes"),
            F.max("copy").alias("copies")).first()
        # One row per path; overlapping folders list a path once per folder.
        changed = changed_rows.groupBy("path").agg(F.min_by(
            F.struct(*[c for c in changed_rows.columns if c != "path"]), "copy").alias("r")).select("path", "r.*")
        if n.changed <= MAX_BROADCAST_PATHS:
            changed = F.broadcast(changed)  # the texts are then picked without being shuffled
        removed = sync.removed_documents(snapshot, seen)
        n_removed = removed.count() if old else 0
        everything = n.unchanged == 0 and not n.copies
        docs = fetch(changed, everything, n.changed_bytes or 0).withColumn("copy", F.lit(0))

        if old is None:
            version = self._rebase(row, gen, docs, n.bytes or 0)
        else:
            dead = changed_rows.filter("stored").select("path").unionByName(removed).distinct()
            live = max(old.version.n_docs, 1)
            changes = n.changed or n_removed
            outgrown = changes and bucket_count(n.bytes or 0) >= MAX_BUCKET_GROWTH * old.version.buckets
            if outgrown or (n.changed + n_removed + old.version.n_tombstones) / live > REWRITE_SHARE:
                kept = old.keyed_documents().join(dead, "path", "left_anti").select("path", "copy", *DOCUMENT_COLS[1:])
                version = self._rebase(row, gen, kept.unionByName(docs.select(*kept.columns)), n.bytes or 0)
            elif changes:
                size = n.changed + n.replaced + n_removed
                version = old.write_gen(gen, docs, dead, n.changed_bytes or 0, old.version.to_merge(size))
            else:
                version = old.version
        indexed = 0
        if n.changed:  # paths only, in the buckets that both are in
            built = Collection(self.spark, f"{self.root}/{row.dir}", version)
            fresh = built._rows("documents", version.gens[-1:]).select("path").distinct()
            indexed = changed_rows.select("path").join(fresh, "path", "left_semi").count()
        self._commit(row, version)
        self._delete(work)
        return dict(indexed=indexed, skipped=n.files - n.unchanged - indexed, files_seen=n.files,
                    unchanged=n.unchanged, removed=n_removed)
