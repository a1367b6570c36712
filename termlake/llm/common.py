"""What the operators share: words, the shared folder, written tables, joins on
keys that may be very frequent, and dense numbering of a sorted table."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a character class, and what lies between.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE keys are.
HOT_SHARE = 1000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.
    Only a local session without that setting, as in tests, gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="llm-")
    return _own[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from
    lost executors, and with row numbers that later readers agree on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame):
    """A hash of a whole row. Rows that agree in it are interchangeable. Maps, which
    have no hash, are taken as text: equal maps with entries in another order differ."""
    value = {name: F.to_json(F.struct(F.col(f"`{name}`"))) if "map<" in kind else F.col(f"`{name}`") for name, kind in df.dtypes}
    columns = [c for name in df.columns for c in (value[name], F.col(f"`{name}`").isNull())]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("long")


def in_file_order(df: DataFrame) -> DataFrame:
    """``df`` in range partitions that hold its rows as its part files do, if it is
    a table in files: readers deal files out by size, so their order has to be
    restored. Anything else stays as it is."""
    try:
        placed = df.withColumns({"__llm_file": F.col("_metadata.file_name"), "__llm_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return df
    number = lambda pattern: F.regexp_extract("__llm_file", pattern, 1).try_cast("long")
    order = [number(r"part-(\d+)"), number(r"-c(\d+)"), F.col("__llm_file"), F.col("__llm_at")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in df.columns])


def join_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per ``key`` and in
    ``weight`` its number of ``left`` rows, ``total`` in all. Keys with more than
    1/1000 of the rows are at most 1000 and are broadcast; no other key is large."""
    hot = right.filter(F.col(weight) * HOT_SHARE > F.lit(total))
    rest = right.filter(F.col(weight) * HOT_SHARE <= F.lit(total))
    few = F.broadcast(hot.select(key))
    return (left.join(F.broadcast(hot), key)
            .unionByName(left.join(few, key, "left_anti").join(rest, key)))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its dense rank from 0 in ``name`` under ``order``, by range
    partitions, of which only the sizes reach the driver."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("__llm_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__llm_at", 33)
    sizes = sorted(tuple(r) for r in ranged.groupBy(part).agg(F.count(F.lit(1))).collect())
    start = list(accumulate((n for _, n in sizes), initial=0))
    before = [(k, at) for (k, _), at in zip(sizes, start, strict=False)] or [(0, 0)]
    offsets = df.sparkSession.createDataFrame(before, "__llm_part long, __llm_before long")
    row = F.col("__llm_at").bitwiseAND((1 << 33) - 1)
    return (ranged.withColumn("__llm_part", part).join(F.broadcast(offsets), "__llm_part")
            .withColumn(name, F.col("__llm_before") + row).drop("__llm_part", "__llm_before", "__llm_at"))
