"""Incremental sync as joins on ``path`` between a listing (path, modified, size)
and the stored snapshot (path, modified). Texts are not needed to decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import MAX_FILE_BYTES, is_eligible

INELIGIBLE, UNCHANGED, CHANGED = "ineligible", "unchanged", "changed"


def read_snapshot(docs: DataFrame) -> DataFrame:
    """(path, modified) of the stored documents; a blank path is no key."""
    return docs.select("path", "modified").filter(F.col("path") != "")


def classify_changes(listing: DataFrame, snapshot: DataFrame, extensions=None,
                     max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Add ``status`` and ``stored`` (is there an older version) to the listing.
    A file is unchanged only if its stored time is equal; older also differs."""
    old = (snapshot.groupBy("path").agg(F.max("modified").alias("_old"))
           .withColumn("_stored", F.lit(True)))
    ok = is_eligible(extensions, max_file_bytes, "path", "size")
    return (listing.join(old, "path", "left")
            .withColumn("status", F.when(~ok, INELIGIBLE)
                        .when(F.col("_old") == F.col("modified"), UNCHANGED).otherwise(CHANGED))
            .withColumn("stored", F.coalesce("_stored", F.lit(False)))
            .drop("_old", "_stored"))


def removed_documents(snapshot: DataFrame, classified: DataFrame) -> DataFrame:
    """Stored paths that the listing no longer has as eligible files."""
    present = classified.filter(F.col("status") != INELIGIBLE).select("path")
    return snapshot.select("path").distinct().join(present, "path", "left_anti")


def upsert_documents(docs: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace every changed path by its fresh row. A changed file that gave no
    fresh row, because it turned binary, is deleted."""
    kept = docs.join(changed.select("path"), "path", "left_anti")
    return kept.unionByName(fresh.dropDuplicates(["path"]))


def build_stats(classified: DataFrame, fresh: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: indexed, skipped, files_seen, unchanged, removed, where
    files_seen = indexed + skipped + unchanged. Counts are made per side before
    they meet, so only single rows are joined."""
    got = fresh.select("path").distinct().withColumn("_got", F.lit(True))
    seen = (classified.select("path", "status").join(got, "path", "left")
            .agg(F.count_if((F.col("status") == CHANGED) & F.col("_got").isNotNull()).alias("indexed"),
                 F.count_if((F.col("status") == INELIGIBLE) |
                            ((F.col("status") == CHANGED) & F.col("_got").isNull())).alias("skipped"),
                 F.count(F.lit(1)).alias("files_seen"),
                 F.count_if(F.col("status") == UNCHANGED).alias("unchanged")))
    gone = removed.agg(F.count(F.lit(1)).alias("removed"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(seen).join(one(gone), "_one").drop("_one")


def update_incremental(docs: DataFrame, listing: DataFrame, contents: DataFrame, extensions=None,
                       max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The documents after one sync, without storing anything: kept rows plus the
    fresh rows of changed paths. ``contents`` gives document rows for paths."""
    classified = classify_changes(listing, read_snapshot(docs), extensions, max_file_bytes)
    changed = classified.filter(F.col("status") == CHANGED).select("path").distinct()
    removed = removed_documents(read_snapshot(docs), classified)
    fresh = contents.join(changed, "path", "left_semi")
    return upsert_documents(docs.join(removed, "path", "left_anti"), changed, fresh)
