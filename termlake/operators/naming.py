"""Directories for collection names, many at a time.

A slug that is taken gets the first free number from 2. Only two things can take
the directory ``s-m``: the numbers of the slug ``s``, and a name whose own slug is
``s-m``. So the k-th name of a slug gets number k, but for the numbers that such
names were given first. Counting is done per slug and slice of the order, so a slug
that most names share is many tasks; only slugs that are numbered forms of another
slug are gone through one after the other, a row each, in constant memory."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

NUMBERED = r"\A(.+)-([2-9]|[1-9][0-9]{1,17})\z"  # larger numbers are out of reach
BLOCK = 100_000  # names of one slug that are renumbered in one task


def _slices(names: DataFrame) -> Column:
    """The number of a row's slice in the order of (ord, name). Bounds are Spark's own
    range partitions of these columns, at most one for each shuffle partition."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = names.select("ord", "name").repartitionByRange(n, "ord", "name")
    lows = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("ord", "name")).alias("low")).orderBy("part").collect()
    kind = {f.name: f.dataType for f in names.schema}
    bounds = [F.struct(*[F.lit(r.low[c]).cast(kind[c]).alias(c) for c in ("ord", "name")]) for r in lows[1:]]
    at = F.struct("ord", "name")
    return F.size(F.filter(F.array(*bounds), lambda b: b <= at)) if bounds else F.lit(0)


def _running(rows: DataFrame, part: str, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``total``, the sum of ``amount`` over the rows of the slug up to this
    one: what earlier parts of the slug add up to, and a running sum in its own part."""
    inside = Window.partitionBy("slug", part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("slug").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("slug", part).agg(F.sum("amount").alias("n"))
    before = parts.select("slug", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (rows.withColumn("inside", F.sum("amount").over(inside)).join(before, ["slug", part])
            .withColumn("total", F.col("inside") + F.col("before")).drop("inside", "before"))


def _walk(frames):
    """Numbered forms of slugs, those of one slug together and by number, after the rows of
    the slug it is a form of itself. Gives (slug, at): from its at-th name on, a slug's
    numbers are one higher, as its own directory is given away, or one in its way is."""
    import pandas as pd

    given, stem, parent, passed = set(), None, None, 0
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.stem != stem:
                given, stem, parent = set(), r.stem, None
            if r.parent != parent:
                parent, passed = r.parent, 0
            k = r.m - passed - (parent in given)  # the name that would get the number m
            if k > r.n:
                continue
            if r.earlier < k:
                passed += 1
                out.append((parent, k))
            else:
                if r.is_parent:
                    given.add(r.slug)
                out.append((r.slug, 1))
        yield pd.DataFrame(out, columns=["slug", "k"])


def unique_dirs(names: DataFrame, work: str) -> DataFrame:
    """(name, ord, dir) of each (name, ord), as if they were created in order of ord and
    then name: the slug, or with the first number from 2 that makes it free. Equal
    rows are as many names. A null name counts as a blank one, null ords come first.

    ``work`` is a new folder on shared storage. What is read more than once is written
    there, so a lost executor costs no more than its own part of a step."""
    def written(df, step):
        df.write.parquet(f"{work}/{step}")
        return names.sparkSession.read.schema(df.schema).parquet(f"{work}/{step}")

    rows = written(names.select("name", "ord", slugify("name").alias("slug"), _slices(names).alias("slice")), "rows")

    slugs = written(rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "name", "slice")).alias("first")), "slugs")
    part = lambda i: F.regexp_extract("slug", NUMBERED, i)
    forms = slugs.filter(part(1) != "").select("slug", "first", part(1).alias("parent"), part(2).cast("bigint").alias("m"))
    forms = forms.join(slugs.select(F.col("slug").alias("parent"), "n"), "parent")
    most = forms.groupBy("parent").agg(F.count(F.lit(1)).alias("forms"))
    forms = written(forms.join(most, "parent").filter(F.col("m") <= F.col("n") + F.col("forms") + 1), "forms")

    # Names are counted, and between them stand the first names of numbered forms.
    none = F.lit(None).cast("string")
    counted = written(_running(
        rows.select("slug", "slice", "ord", "name", none.alias("form"), F.lit(1).alias("amount")).unionByName(
            forms.select(F.col("parent").alias("slug"), "first.slice", "first.ord", "first.name", F.col("slug").alias("form"),
                         F.lit(0).alias("amount"))), "slice", ["ord", "name"]), "counted")
    earlier = counted.filter("form IS NOT NULL").select(F.col("form").alias("slug"), F.col("total").alias("earlier"))
    parents = forms.select(F.col("parent").alias("slug"), F.lit(True).alias("is_parent")).distinct()
    walked = written(forms.join(earlier, "slug").join(parents, "slug", "left").select(
        F.regexp_replace("slug", r"(?:-\d+)+$", "").alias("stem"), "slug", "parent", "m", "n", "earlier",
        F.coalesce("is_parent", F.lit(False)).alias("is_parent"))
        .repartition("stem").sortWithinPartitions("stem", F.char_length("parent"), "parent", "m")
        .mapInPandas(_walk, "slug string, k bigint"), "walked")

    kind = dict(names.dtypes)
    block = F.floor((F.col("k") - 1) / BLOCK).alias("block")
    names_at = counted.filter("form IS NULL").select("slug", F.col("total").alias("k"), "name", "ord", F.lit(0).alias("amount"))
    steps = walked.select("slug", "k", F.lit(None).cast(kind["name"]).alias("name"), F.lit(None).cast(kind["ord"]).alias("ord"),
                          F.lit(1).alias("amount"))
    placed = _running(names_at.unionByName(steps).select("*", block), "block", ["k", F.desc("amount")]).filter("amount = 0")
    number = F.col("k") + F.col("total")
    return placed.select("name", "ord", F.when(number == 1, F.col("slug")).otherwise(
        F.concat_ws("-", "slug", number.cast("string"))).alias("dir"))
