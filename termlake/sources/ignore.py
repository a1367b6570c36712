"""Ignore rules: the lines of ignore files, applied to paths by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def _bounded_count(df: DataFrame) -> int:
    return df.limit(MAX_BROADCAST_ROWS + 1).count()


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if few rows; otherwise the join shuffles, and adaptive execution
    splits a directory that holds very many files."""
    return F.broadcast(df) if _bounded_count(df) <= MAX_BROADCAST_ROWS else df


#: Characters that mean something in a pattern, the backslash first, and what
#: stands for them while the rest is translated.
ESCAPED = (("\\", "\u0011"), ("*", "\u0012"), ("?", "\u0013"), ("[", "\u0014"), ("]", "\u0015"))


def _glob(c: Column) -> Column:
    """An ignore pattern as a regular expression. ``*`` and ``?`` stay inside a
    path segment, ``**`` between slashes spans any number of them. A backslash
    makes the next character literal: such pairs are taken out first, from left to
    right, and put back last."""
    for escaped, mark in ESCAPED:
        c = F.replace(c, F.lit("\\" + escaped), F.lit(mark))
    c = F.regexp_replace(c, r"\\(.)", "$1")
    c = F.regexp_replace(c, r"([.+()|{}^$])", r"\\$1")
    for glob, mark in ((r"\[!", "\u0001"), (r"^\*\*/", "\u0002"), (r"/\*\*/", "\u0003"), (r"/\*\*$", "\u0004"),
                       (r"\*+", "\u0005"), (r"\?", "\u0006")):
        c = F.regexp_replace(c, glob, mark)
    for mark, pattern in (("\u0001", "[^"), ("\u0002", "(?:.*/)?"), ("\u0003", "/(?:.*/)?"), ("\u0004", "/.*"),
                          ("\u0005", "[^/]*"), ("\u0006", "[^/]")):
        c = F.replace(c, F.lit(mark), F.lit(pattern))
    for escaped, mark in ESCAPED:
        c = F.replace(c, F.lit(mark), F.lit("\\" + escaped))
    return c


def compile_rules(lines: DataFrame) -> DataFrame:
    """(dir, ord, line) of ignore files to rules (dir, ord, regex, negate,
    dirs_only). Blank lines and comments drop out; a pattern with a slash before
    its end is bound to the file's own directory, any other fits at any depth."""
    line = F.regexp_replace("line", r"(?<!\\)[ \t\r]+$", "")
    lines = lines.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    lines = lines.withColumn("negate", F.col("line").startswith("!"))
    body = F.regexp_replace(F.regexp_replace("line", "^!", ""), r"^\\(?=[#!])", "")
    lines = lines.withColumn("body", body).withColumn("dirs_only", F.col("body").endswith("/"))
    bare = F.regexp_replace("body", "/$", "")
    bound = F.contains(bare, F.lit("/"))
    pattern = _glob(F.regexp_replace(bare, "^/", ""))
    return lines.select("dir", "ord", "negate", "dirs_only", F.concat(
        F.lit(r"\A"), F.when(bound, "").otherwise("(?:.*/)?"), pattern, F.lit(r"\z")).alias("regex"))


def parent_of(path) -> Column:
    """The directory a path is in."""
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def parents_of(path: Column) -> Column:
    """Every directory above a path, from the top ('') down."""
    segments = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(segments) - 1),
                       lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))


def directories(paths: DataFrame) -> DataFrame:
    """(home, dir): each directory that holds a file, with itself and all above
    it. Files are reduced to their directories before anything is multiplied."""
    homes = paths.select(parent_of("path").alias("home")).distinct()
    return homes.select("home", F.explode(F.array_append(parents_of(F.col("home")), F.col("home"))).alias("dir"))


def _decide(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries (entry, is_dir) that the last rule bearing on them excludes. Rules
    of a deeper directory come later than those above it."""
    dirs = entries.select("entry", "is_dir", F.explode(parents_of(F.col("entry"))).alias("dir"))
    within = F.when(F.col("dir") == "", F.col("entry")).otherwise(
        F.substring(F.col("entry"), F.char_length("dir") + 2, F.char_length("entry")))
    bears = (F.col("is_dir") | ~F.col("dirs_only")) & F.rlike(within, F.col("regex"))
    hit = dirs.join(rules, "dir").filter(bears)
    last = hit.groupBy("entry").agg(
        F.max_by("negate", F.struct(F.char_length("dir").alias("depth"), "ord")).alias("negate"))
    return last.filter(~F.col("negate")).select("entry")


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files that no rule excludes. A directory that is excluded takes all
    below it along: re-including a file inside has no effect. Directories are
    decided once each, not once per file."""
    n = _bounded_count(rules)
    if n == 0:
        return files
    if n <= MAX_BROADCAST_ROWS:
        rules = F.broadcast(rules)
    paths = files.select("path").distinct()
    above = directories(paths).filter("dir <> ''")
    dirs = above.select(F.col("dir").alias("entry"), F.lit(True).alias("is_dir")).distinct()
    gone_dirs = _decide(dirs, rules).withColumnRenamed("entry", "dir")
    gone_homes = above.join(gone_dirs, "dir", "left_semi").select("home").distinct()
    gone_files = (_decide(paths.select(F.col("path").alias("entry"), F.lit(False).alias("is_dir")), rules)
                  .withColumnRenamed("entry", "path"))
    return (files.withColumn("home", parent_of("path")).join(_small(gone_homes), "home", "left_anti").drop("home")
            .join(_small(gone_files), "path", "left_anti"))
