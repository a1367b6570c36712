"""Folders of text files as DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_text, ext_of, filename_of, looks_binary, mtime_millis
from ..schema import RAW_FILE
from .walk import TASK_BYTES, content_of, list_files, reachable, uri_of

# The extensions taken as plain text, and the largest file indexed.
DEFAULT_EXTENSIONS = (
    "txt", "md", "markdown", "rst", "csv", "tsv", "log", "json", "jsonl", "ndjson", "xml", "yaml", "yml", "toml", "ini",
    "cfg", "conf", "env", "properties", "rs", "py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "java", "kt", "c", "h", "cpp",
    "cc", "hpp", "cs", "go", "rb", "php", "swift", "scala", "sql", "sh", "bash", "zsh", "ps1", "bat", "html", "htm",
    "css", "scss", "less", "vue", "svelte", "tex", "org", "asciidoc", "adoc",
)
MAX_FILE_BYTES = 20 * 1024 * 1024
GLOB = frozenset("{}[]*?\\")  # characters of a path that Spark takes as a pattern


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that Spark itself would use for this path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def disjoint_layers(roots: list[str]) -> list[list[str]]:
    """Split roots into lists whose members do not contain each other. One list,
    and so one scan, unless folders overlap."""
    layers: list[list[str]] = []
    for root in (r.rstrip("/") or "/" for r in roots):
        inside = lambda a, b: a == b or b.startswith(a.rstrip("/") + "/")
        for layer in layers:
            if not any(inside(root, o) or inside(o, root) for o in layer):
                layer.append(root)
                break
        else:
            layers.append([root])
    return layers


def scratch_folder(spark: SparkSession) -> str | None:
    """A new folder that all nodes see, in ``spark.checkpoint.dir``. Without one, a local
    session has a temporary folder, which goes with it, and a cluster has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="termlake-"))
        base = _own[0].name
    return base and f"{base}/termlake-{spark.sparkContext.applicationId}/listing-{uuid.uuid4().hex}"


_own: list[tempfile.TemporaryDirectory] = []


def folders_of(spark: SparkSession, roots: list[str]) -> list[str] | None:
    """The folders as listed paths name them, patterns written out, if tasks can list
    them. None if Arrow has no file system for one, or if one is a single file."""
    out = []
    for root in roots:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        filesystem = p.getFileSystem(spark._jsc.hadoopConfiguration())
        found = (filesystem.globStatus(p) or ()) if GLOB & set(root) else [filesystem.getFileStatus(p)] if filesystem.exists(p) else ()
        if not found:
            raise FileNotFoundError(f"{root!r} is not there")
        for status in found:
            uri = uri_of(status.getPath().toString())
            if not status.isDirectory() or not reachable(uri):
                return None
            out.append(uri)
    return out


def spark_scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The files as Spark lists them, which takes driver memory for each of them."""
    out = None
    for i, layer in enumerate(disjoint_layers(roots)):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
                 .load(layer).select(*RAW_FILE.fieldNames(), F.lit(i).alias("copy")))
        out = files if out is None else out.unionByName(files)
    return out if out is not None else spark.createDataFrame([], RAW_FILE).withColumn("copy", F.lit(0))


def listed_files(spark: SparkSession, roots: list[str], work: str | None,
                 missing_roots: str = "error") -> tuple[DataFrame, DataFrame | None]:
    """(path, modificationTime, length, copy) of the files, listed in tasks and kept in
    the folder ``work``, and None. Where tasks cannot list them, or without ``work``, the
    second is Spark's own scan, which has the contents too, and the first is taken from it."""
    if missing_roots == "empty":
        roots = [r for r in roots if path_exists(spark, r)]
    folders = folders_of(spark, roots) if work else None
    if folders is not None:
        return list_files(spark, disjoint_layers(folders), work), None
    scan = spark_scan(spark, roots)
    return scan.drop("content"), scan


def scan_files(spark: SparkSession, roots: list[str], missing_roots: str = "error", work: str | None = None) -> DataFrame:
    """Every regular file under the folders: path, modificationTime, length,
    content, copy. Select without ``content`` and no file is opened; it is null for a
    file that is gone by then or cannot be read.

    Tasks list the folders, now, and keep the list in the folder ``work``, which all
    nodes share; without it in a new one of ``scratch_folder``, which is left to whoever
    clears that.

    A file under two overlapping folders is listed twice, told apart by ``copy``.
    Names that start with ``.`` or ``_`` are left out, as in Spark's own listing; add them
    with ``hidden.hidden_files``. A missing folder is an error unless
    ``missing_roots="empty"``, which lists nothing for it: a sync then removes
    every document it had."""
    listed, scan = listed_files(spark, roots, work or scratch_folder(spark), missing_roots)
    if scan is not None:
        return scan
    n_bytes = listed.agg(F.sum("length")).first()[0] or 0
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.repartition(max(2 * shuffled, ceil(n_bytes / TASK_BYTES)))
    return dealt.select("path", "modificationTime", "length", content_of("path").alias("content"), "copy")


def few_tasks(files: DataFrame, n_bytes: int = 0) -> DataFrame:
    """The same files in fewer tasks. Spark counts 4 MB for each file it opens, so a scan
    of small files is a task for every 32 of them. ``n_bytes`` is what will be read."""
    shuffled = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.coalesce(max(shuffled, ceil(n_bytes / TASK_BYTES)))


def is_eligible(extensions=None, max_file_bytes: int = MAX_FILE_BYTES, path="path", size="length") -> Column:
    """Allowed extension and not over the size cap. The cap on ``length`` is pushed
    into the file scan, so larger files are not read."""
    return has_ext(extensions, path) & (F.col(size) <= max_file_bytes)


def has_ext(extensions=None, path="path") -> Column:
    """An extension of the caller's list, as it is: ``"*"`` allows all and an empty
    list none. Without a list, the default ones."""
    allowed = list(DEFAULT_EXTENSIONS if extensions is None else extensions)
    return F.lit(True) if "*" in allowed else ext_of(path).isin(allowed) if allowed else F.lit(False)


def filter_ext(files: DataFrame, extensions=None) -> DataFrame:
    return files.filter(has_ext(extensions))


def filter_size(files: DataFrame, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    return files.filter(F.col("length") <= max_file_bytes)


def filter_binary(files: DataFrame) -> DataFrame:
    return files.filter(~looks_binary("content"))


def read_documents(files: DataFrame) -> DataFrame:
    """Decode files that are eligible: drop binaries, then the document columns."""
    carried = [c for c in ("copy",) if c in files.columns]
    # Exploded, so that the test for binaries stays above what reads the files: a filter
    # that is pushed below it would read each of them twice.
    files = files.withColumn("content", F.explode(F.array("content")))
    return filter_binary(files).select(
        "path", *carried, filename_of("path").alias("filename"), ext_of("path").alias("ext"),
        decode_text("content").alias("content"),
        mtime_millis("modificationTime").alias("modified"), F.col("length").alias("size"))


def documents(files: DataFrame, extensions=None, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The whole pipeline: extension, size, binary test, decode, document row."""
    return read_documents(files.filter(is_eligible(extensions, max_file_bytes)))
