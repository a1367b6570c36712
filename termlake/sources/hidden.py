"""Files that Spark's own listing leaves out: names starting with ``.`` or ``_``,
and everything in directories so named. Directories are listed in tasks, by
Arrow's file systems, and no list passes through the driver."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ignore import directories
from .walk import HELD_ENTRIES, _entries, _open_dir, read_listed, uri_of

# The task functions below travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = "path string, modificationTime timestamp, length bigint, kind string"


def _is_hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def _list(frames: Iterator[pd.DataFrame], below_all: bool) -> Iterator[pd.DataFrame]:
    """Entries Spark's listing lacks, of each directory given. A visible
    sub-directory is reported as such; a hidden one is walked to its end."""
    frame_of = lambda rows: pd.DataFrame(rows, columns=["path", "modificationTime", "length", "kind"]).astype(
        {"modificationTime": "datetime64[us, UTC]", "length": "int64"})
    out = []
    for frame in frames:
        for top in frame["path"]:
            todo = [(top, below_all)]
            while todo:
                where, everything = todo.pop()
                for uri, name, is_dir, at, size in _entries(where):
                    wanted = everything or _is_hidden(name)
                    if is_dir and wanted:
                        todo.append((uri, True))
                    elif is_dir:
                        out.append((uri, at, 0, "dir"))
                    elif wanted:
                        out.append((uri, at, size, "file"))
                    if len(out) >= HELD_ENTRIES:
                        yield frame_of(out)
                        out = []
    if out:
        yield frame_of(out)


def hidden_files(spark: SparkSession, roots: list[str], listed: DataFrame) -> DataFrame:
    """(path, modificationTime, length, copy) of the hidden files under the roots.

    Every directory that holds a visible file is looked into once. Directories
    that hold none are found through their parents, and then walked whole."""
    tops = spark.createDataFrame([(uri_of(r),) for r in roots], "path string")
    above = directories(listed).select(F.col("dir").alias("path"))
    inside = reduce(lambda a, b: a | b, (
        (F.col("path") == uri_of(r)) | F.col("path").startswith(uri_of(r) + "/") for r in roots), F.lit(False))
    known = above.filter(inside).unionByName(tops).distinct()
    first = known.repartition("path").mapInPandas(lambda it: _list(it, False), LISTED)
    unseen = (first.filter("kind = 'dir'").select("path").join(known, "path", "left_anti"))
    rest = unseen.repartition("path").mapInPandas(lambda it: _list(it, True), LISTED)
    return (first.unionByName(rest).filter("kind = 'file'")
            .select("path", "modificationTime", "length", F.lit(0).alias("copy")))


def read_hidden(files: DataFrame) -> DataFrame:
    """Add the content of files that only this listing knows."""
    return read_listed(files)


#: Ignore files, the one that wins last: a rule of the second kind overrides those of
#: the first in the same directory. The exclude file belongs to the directory that
#: its repository is in, and loses to both.
IGNORE_FILES = (".git/info/exclude", ".gitignore", ".ignore")


def ignore_lines(spark: SparkSession, listed: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(dir, ord, line) of every ignore file beside or above a listed file, in the order
    in which they count. A file that is not there has no lines; one that cannot be
    read is an error, as leaving it out would change what is indexed."""
    def read(frames):
        for frame in frames:
            for uri in frame["dir"]:
                lines = []
                for name in names:
                    try:
                        filesystem, inner, _ = _open_dir(f"{uri}/{name}")
                        with filesystem.open_input_stream(inner) as f:
                            lines += f.read().decode("utf-8", "replace").splitlines()
                    except (FileNotFoundError, NotADirectoryError):
                        continue
                if lines:
                    yield pd.DataFrame({"dir": uri, "ord": range(len(lines)), "line": lines})

    dirs = directories(listed).select("dir").distinct().filter(F.contains("dir", F.lit("/")))
    return dirs.repartition("dir").mapInPandas(read, "dir string, ord int, line string")
