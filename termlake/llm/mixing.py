"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight, and from the weights and its size a target: the words
that the mix takes from it. A target never exceeds ``limit`` times the source; the
excess is shared again by weight. Documents stand in a hashed order within their
source, and the cumulative words in that order decide which of them are taken once
more than the others.

When a source is used follows its schedule: a multiplier of its weight that
changes over training time from 0 to 1. The integral of the schedule says how much
of the source's demand is met by then; inverted, it turns the cumulative words at
a copy of a document into that copy's position in training. ``curriculum`` sorts
the copies by position in range partitions and numbers them, ``taken_words`` sums
what the numbered copies take of each document, and ``training_order`` gives the
documents themselves in that order. Rows are known by a number of their own, so
repeated rows and rows with the same id are never grouped.

A running sum over a source that holds a third of all rows is cut into slices of
the hashed order, so no task gets more than a slice.

A null text has size 0, and a null source is a source of its own, the last. Rows
that agree in everything are single documents that get their copies as any other.
A source without words has the target 0 and takes nothing. An empty table gives
an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, numbered, row_key, written

WEIGHTS = (5, 2, 1)
#: For each weight the points (time, multiplier) of its schedule, linear between:
#: heavy sources early, light ones late.
SCHEDULES = (((0.0, 1.25), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Documents of a slice of the hashed order, on average over all sources.
SLICE_ROWS = 50_000
_SEED = "mix"


def words(text):
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, total: int, budget: float = 1.5, limit: float = 2.0,
                   weights: tuple = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size) with weight class and ``target``. Sources in
    code-point order, null last, take the weights in turn. Each round shares out
    what the full sources leave; only one row of sums a round reaches the driver."""
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "rank")
    kind = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (kind + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(limit))
    ranked = ranked.select("source", "source_size", kind.cast("int").alias("kind"), weight.alias("weight"), cap.alias("cap"))
    level, full_before = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        got = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
                         F.count(F.when(full, 1)).alias("n")).first()
        if got["n"] == full_before or not got["open"]:
            break
        full_before, level = got["n"], (total * budget - got["used"]) / got["open"]
    return ranked.select("source", "source_size", "kind",
                         F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def position_at(share, points):
    """The time by which ``share`` of a schedule's integral has passed: the
    integral inverted piece by piece, each piece being a quadratic."""
    areas = [(t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(points, points[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, None
    for ((t0, m0), (t1, m1)), area in zip(zip(points, points[1:], strict=False), areas, strict=True):
        left, slope = share * F.lit(whole) - F.lit(before), (m1 - m0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(m0 * m0) + left * F.lit(2 * slope)))
        at = F.lit(t0) + F.when(left <= 0, 0.0).otherwise(left * 2 / (F.lit(m0) + root))
        before += area
        out = (F if out is None else out).when(share * F.lit(whole) <= F.lit(before), at)
    return F.least(F.lit(1.0), out.otherwise(F.lit(1.0)))


def mix(docs: DataFrame, budget: float = 1.5, limit: float = 2.0, weights: tuple = WEIGHTS,
        schedules: tuple = SCHEDULES, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, copies,
    the positions of the copies, ``row_key``, and ``row``, the number of the row in
    ``docs``, which later readers of ``docs`` agree on if it is a table."""
    rows = written(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        words(F.col(f"`{text_col}`")).alias("size"), row_key(docs).alias("row_key"),
        F.monotonically_increasing_id().alias("row")), "mix-sizes")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    total, slices = whole["words"] or 0, max(1, -(-whole["n"] // SLICE_ROWS))
    hashed = F.xxhash64(F.lit(_SEED), "doc_id", "row_key")
    share_of = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
    rows = rows.withColumns({"order": hashed, "slice": F.least(F.lit(slices - 1), F.floor(share_of * slices)).cast("int")})
    # the unsigned order of the hash, in which the slices follow each other
    rows = rows.withColumn("order", F.shiftrightunsigned("order", 1))

    part = written(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    sizes = part.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, total, budget, limit, weights)
    along = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    t = targets.withColumnRenamed("source", "t_source")
    part = part.join(t, part["source"].eqNullSafe(t["t_source"])).select(
        F.col("source").alias("p_source"), F.col("slice").alias("p_slice"), "before", "source_size", "kind", "target")
    placed = rows.join(part, rows["source"].eqNullSafe(part["p_source"]) & (rows["slice"] == part["p_slice"]))

    inside = W.partitionBy("source", "slice").orderBy("order", "doc_id", "row_key", "row").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumns({"middle": middle, "passes": passes.cast("int")})
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    once_more = (F.col("size") > 0) & (F.col("middle") <= rest)
    copies = F.when(F.col("size") > 0, F.col("passes") + once_more.cast("int")).otherwise(0)
    placed = placed.withColumn("copies", copies)
    at = lambda k: F.least(F.lit(1.0), (k * F.col("source_size") + F.col("middle")) / F.col("target"))

    def positions(points):
        return F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1),
                                                       lambda k: position_at(at(k), points)))
    chosen = F.lit(None).cast("array<double>")
    for i, points in enumerate(schedules):
        chosen = F.when(F.col("kind") == i, positions(points)).otherwise(chosen)
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("copies") * F.col("size")).alias("taken"), "copies",
                         F.coalesce(chosen, F.array().cast("array<double>")).alias("positions"), "row_key", "row")


def curriculum(mixed: DataFrame) -> DataFrame:
    """A row per copy of ``mixed``: row, size, position, and its place in training,
    ``at``, from 0: the copies sorted by position in range partitions."""
    copies = mixed.select("row", "row_key", "size", F.explode("positions").alias("position"))
    return numbered(copies, [F.col("position"), F.col("row_key"), F.col("row")], "at").drop("row_key")


def taken_words(docs: DataFrame, **parameters) -> DataFrame:
    """A row per document as ``mix`` has it, with ``taken`` and ``first_at``, the place
    of its first copy in training, from the copies in the curriculum."""
    mixed = written(mix(docs, **parameters), "mixed")
    copies = curriculum(mixed).groupBy("row").agg(F.sum("size").alias("words"), F.min("at").alias("first_at"))
    return mixed.drop("taken").join(copies, "row", "left").withColumn("taken", F.coalesce("words", F.lit(0))).drop("words", "row")


def training_order(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as the mix takes them: as many copies of each row as the mix has, in
    range partitions by position, sorted within each. Columns as in ``docs``, which
    must be a table in files, so that its rows have the same numbers again."""
    plan = mix(docs, **parameters).filter("copies > 0").select(F.col("row").alias("__llm_row"), F.col("row_key").alias("__llm_key"),
                                                               F.explode("positions").alias("__llm_position"))
    own = docs.withColumn("__llm_own", F.monotonically_increasing_id())
    copies = own.join(plan, F.col("__llm_own") == F.col("__llm_row"))
    order = ["__llm_position", "__llm_key", "__llm_row"]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])
