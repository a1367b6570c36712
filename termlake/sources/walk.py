"""Folders listed, and their files read, in tasks by Arrow's file systems. Neither a
list of files nor their contents pass through the driver, however many there are."""

from __future__ import annotations

import errno
import os
import sys
from collections.abc import Iterator
from math import ceil
from urllib.parse import quote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_FILE

# The task functions below travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Content that a task holds before it hands files on.
HELD_BYTES = 8 * 1024 * 1024
#: Listed entries that a task hands on at once.
HELD_ENTRIES = 10_000
#: After so many entries a task leaves the directories that it finds to the next round.
WALKED_ENTRIES = 20_000
#: Directories of a round in one task, if there are that many.
TASK_DIRS = 100
TASK_BYTES = 32 * 1024 * 1024  # of files that are read in one task, if there are that many bytes
ENTRY = "path string, modified bigint, length bigint, copy int, dir boolean"


def _open_dir(uri: str):
    """(file system, path in it, prefix that turns such a path into a URI)."""
    from pyarrow import fs
    scheme, _, rest = uri.partition(":")
    if "/" in scheme or not rest:
        return fs.LocalFileSystem(), uri, "file:"
    if scheme == "file":  # as it is: a name may hold what a URI has to escape
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    filesystem, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest, safe='/:@')}")
    return filesystem, inner, uri[: len(uri) - len(inner)] if uri.endswith(inner) else f"{scheme}:"


def uri_of(root: str) -> str:
    """A folder as listed paths name it: without a slash at its end, local ones as file:/…"""
    root = root.rstrip("/") or "/"
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return f"file:{root}" if root.startswith("/") else root


def reachable(uri: str) -> bool:
    """Whether Arrow has a file system for this URI, and finds something there."""
    from pyarrow import fs
    try:
        filesystem, inner, _ = _open_dir(uri)
        return filesystem.get_file_info(inner).type != fs.FileType.NotFound
    except Exception:  # no such scheme, no driver for it, no access: Spark may have one
        return False


def _entries(uri: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """(URI, name, is it a directory, microseconds of its time, bytes) of all that is in a
    directory. A local one is read as a stream; one that is gone has no entries."""
    from pyarrow import fs
    filesystem, inner, prefix = _open_dir(uri)
    try:
        if not isinstance(filesystem, fs.LocalFileSystem):
            for e in filesystem.get_file_info(fs.FileSelector(inner)):
                if e.type in (fs.FileType.Directory, fs.FileType.File):
                    yield prefix + e.path, e.base_name, e.type == fs.FileType.Directory, (e.mtime_ns or 0) // 1000, e.size or 0
            return
        with os.scandir(inner) as entries:
            for e in entries:
                try:
                    e.name.encode()
                    s, is_dir = e.stat(), e.is_dir()
                except UnicodeEncodeError:  # no string can name it
                    continue
                except OSError as x:  # gone, or a link to nothing
                    if x.errno not in (errno.ENOENT, errno.ENOTDIR, errno.ELOOP):
                        raise
                    continue
                if is_dir or e.is_file():
                    yield prefix + e.path, e.name, is_dir, s.st_mtime_ns // 1000, 0 if is_dir else s.st_size
    except (FileNotFoundError, NotADirectoryError):
        return


def _left_out(name: str, is_dir: bool) -> bool:
    """Whether Spark's own listing leaves a name out. Metadata folders are looked into."""
    if is_dir and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The files that Spark would list of each directory given, and of those below it
    while they are few. The other directories are reported as such."""
    n, held = 0, []
    frame_of = lambda rows: pd.DataFrame(rows, columns=["path", "modified", "length", "copy", "dir"])
    for frame in frames:
        for top, copy in zip(frame["path"], frame["copy"]):
            todo = [top]
            while todo:
                for uri, name, is_dir, at, size in _entries(todo.pop()):
                    n += 1
                    if _left_out(name, is_dir) or not (is_dir or size):
                        continue
                    if is_dir and n < WALKED_ENTRIES:
                        todo.append(uri)
                        continue
                    held.append((uri, at // 1000, size, copy, is_dir))
                    if len(held) >= HELD_ENTRIES:
                        yield frame_of(held)
                        held = []
    if held:
        yield frame_of(held)


def list_files(spark: SparkSession, layers: list[list[str]], folder: str) -> DataFrame:
    """(path, modificationTime, length, copy) of every file that Spark would list under
    the URIs, ``copy`` being the number of the list that names the URI. Directories are
    shared out in rounds, and what each round finds is kept in ``folder``."""
    todo = spark.createDataFrame([(uri, i) for i, layer in enumerate(layers) for uri in layer], "path string, copy int")
    shuffled, n_dirs, rounds = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(map(len, layers)), 0
    while n_dirs:
        at = f"{folder}/round={rounds}"
        found = todo.repartition(max(min(shuffled, n_dirs), ceil(n_dirs / TASK_DIRS))).mapInPandas(_walk, ENTRY)
        found.hint("rebalance").write.parquet(at)  # a directory may hold most files
        todo = spark.read.schema(ENTRY).parquet(at).filter("dir").select("path", "copy")
        n_dirs, rounds = todo.count(), rounds + 1
    if not rounds:
        return spark.createDataFrame([], RAW_FILE).drop("content").withColumn("copy", F.lit(0))
    found = spark.read.schema(ENTRY).parquet(*[f"{folder}/round={i}" for i in range(rounds)]).filter("not dir")
    return found.select("path", F.timestamp_millis("modified").alias("modificationTime"), "length", "copy")


# --- contents -----------------------------------------------------------------

def _content(uri: str) -> bytes | None:
    """None for a file that is gone or that cannot be read."""
    try:
        filesystem, inner, _ = _open_dir(uri)
        with filesystem.open_input_stream(inner, compression=None) as f:
            return f.read()
    except OSError:
        return None


def content_of(path: str = "path") -> Column:
    """The bytes of the file of each path. Files are opened only if the column is used."""
    def read(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in paths:
            contents, held = [], 0
            for uri in some:
                contents.append(_content(uri))
                held += len(contents[-1] or b"")
                if held >= HELD_BYTES:
                    yield pd.Series(contents, dtype=object)
                    contents, held = [], 0
            if contents:
                yield pd.Series(contents, dtype=object)
    return F.pandas_udf(read, "binary")(path)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows, contents, held = [], [], 0
        for i, uri in enumerate(frame["path"]):
            if (content := _content(uri)) is None:
                continue
            contents.append(content)
            rows.append(i)
            held += len(content)
            if held >= HELD_BYTES:
                yield frame.iloc[rows].assign(content=contents)
                rows, contents, held = [], [], 0
        if rows:
            yield frame.iloc[rows].assign(content=contents)


def read_listed(files: DataFrame, n_bytes: int = 0) -> DataFrame:
    """Add the content of listed files; one that is gone is left out. The caller filters
    by name and size first, so nothing else is opened. The listing is small whatever
    the files hold, so it is dealt out by rows, not by its own bytes. ``n_bytes`` is
    what will be read."""
    raw = files.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), "copy")
    shuffled = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = raw.repartition(max(shuffled, ceil(n_bytes / TASK_BYTES)))
    return raw.mapInPandas(_read, raw.schema).select(*RAW_FILE.fieldNames(), "copy")
