"""Filter interaction audit by decision diagrams.

A document's failures are a mask with a bit for each filter. The documents of a
part become a diagram of their masks: a level for each filter, a low edge for
"passes" and a high edge for "fails", equal sub-diagrams shared, and every node
weighted by the documents, good documents and toxic documents below it. Under the
order of its levels the path of low edges is what passes: at each step the node
on the low edge has what is kept, the one on the high edge what is removed. Another
order needs no other pass over anything: two neighbouring levels are swapped in
place, and a sequence of such swaps goes through all orders.

Masks are counted by Spark. Failing by text alone is a projection of built-in
functions; being a repeat of an earlier text is settled on counts of equal texts,
combined before each shuffle, so a text that a third of all rows share is a few
rows. What reaches a diagram is a part's distinct masks, at most two to the number
of filters.

A null text is empty, and a null part is the part ''. Labels are joined by id; an id
with several labels is good or toxic if one of them says so, and null labels say
nothing. Null ids have no labels and come after all others: they repeat a text if any
other id has it, and never each other. Rows that agree in id and text are counted
one by one and do not repeat each other, as neither id is smaller. An empty table
gives an empty result."""

from __future__ import annotations

import sys
from collections.abc import Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: The name of the filter that fails what repeats the text of a smaller id.
REPEATED = "E"

Weight = tuple[int, int, int]  # documents, good ones, toxic ones
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


# --- diagrams -----------------------------------------------------------------

def _plus(a: Weight, b: Weight) -> Weight:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Diagram:
    """A diagram over the filters ``order``, from the weight of each mask. Every
    path has all levels, so a node's sub-diagrams lie on the next level."""

    def __init__(self, order: str, masks: Mapping[int, Weight]):
        self.order = list(order)
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[Weight] = []
        self.levels: list[dict] = [{} for _ in range(len(order) + 1)]  # the last one holds weights
        row = [self._end(masks.get(m, (0, 0, 0))) for m in range(1 << len(order))]
        for level in reversed(range(len(order))):  # filter ``level`` is bit ``level`` of a mask
            half = 1 << level
            row = [self._node(self.levels[level], row[m], row[m + half]) for m in range(half)]
        self.root = row[0]

    def _add(self, low: int, high: int, weight: Weight) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _end(self, weight: Weight) -> int:
        ends = self.levels[-1]
        if weight not in ends:
            ends[weight] = self._add(-1, -1, weight)
        return ends[weight]

    def _node(self, level: dict, low: int, high: int) -> int:
        if (low, high) not in level:
            level[low, high] = self._add(low, high, _plus(self.weight[low], self.weight[high]))
        return level[low, high]

    def swap(self, level: int) -> None:
        """Exchange ``level`` and the next. Nodes of ``level`` keep their identity and
        what they stand for, so nothing above them changes."""
        upper, below = {}, {}
        for node in self.levels[level].values():
            a, b = self.low[node], self.high[node]
            self.low[node], self.high[node] = (self._node(below, self.low[a], self.low[b]),
                                               self._node(below, self.high[a], self.high[b]))
            upper[self.low[node], self.high[node]] = node
        self.levels[level], self.levels[level + 1] = upper, below
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, Weight, Weight]]:
        """(filter, kept, removed) along the path on which everything passes."""
        out, node = [], self.root
        for name in self.order:
            out.append((name, self.weight[self.low[node]], self.weight[self.high[node]]))
            node = self.low[node]
        return out


def adjacent_swaps(n: int) -> list[int]:
    """Levels to swap with their next, one after the other, so that every order of
    ``n`` comes up once: the last sweeps through each order of the others."""
    if n < 2:
        return []
    out, leftward = [], True
    for inner in [*adjacent_swaps(n - 1), None]:
        out += range(n - 2, -1, -1) if leftward else range(n - 1)
        if inner is not None:
            out.append(inner + leftward)
        leftward = not leftward
    return out


def every_order(names: str, masks: Mapping[int, Weight]) -> dict[str, list[tuple[str, Weight, Weight]]]:
    """The steps under each order of the filters, from one diagram."""
    diagram = Diagram(names, masks)
    out = {names: diagram.steps()}
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        out["".join(diagram.order)] = diagram.steps()
    return out


def audit_part(part: str, names: str, masks: Mapping[int, Weight]) -> list[tuple]:
    """The rows of a part. A filter's failures are what it removes as the first, and
    what only it fails is what it removes as the last."""
    orders = every_order(names, masks)
    fails, alone, sums = {}, {}, dict.fromkeys(names, 0)
    for steps in orders.values():
        fails[steps[0][0]], alone[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]
        for name, _, removed in steps:
            sums[name] += removed[0]
    return [(part, order, k, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], sums[name])
            for order, steps in orders.items() for k, (name, kept, removed) in enumerate(steps, 1)]


# --- masks -----------------------------------------------------------------------

def failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that a text fails by itself, by name, in the order of their bits."""
    n = F.size(words)
    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < MIN_WORDS, "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
            "C": 100 * upper > MAX_UPPER_PERCENT * F.char_length(text), "D": text.rlike(SYMBOLS)}


def count_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> tuple[str, DataFrame]:
    """The filters' names and (part, mask, n, good, toxic) over all documents."""
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    own = failures(F.col("text"), F.col("words"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(own.values())), F.lit(0))
    rows = texts.select("id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))

    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key"))
             .agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("named", F.lit(True)))
    # null ids, which no label has, are dealt out by their texts
    rows = rows.withColumns({"named": F.col("id").isNotNull(), "key": F.coalesce("id", F.xxhash64("digest"))})
    labelled = rows.join(known, ["named", "key"], "left").fillna(False, ["good", "toxic"])
    cells = written(labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least")), "text-cells")
    first = cells.groupBy("digest").agg(F.min("least").alias("first"))
    cells = cells.join(first, "digest")
    ahead = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.inline(F.array(F.struct(F.col("mask"), ahead.alias("n")),
                             F.struct((F.col("mask") + (1 << len(own))).alias("mask"), (F.col("n") - ahead).alias("n"))))
    counted = cells.select("part", "good", "toxic", split).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    return "".join(own) + REPEATED, counted


def audit(names: str, masks: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from (part, mask, n, good,
    toxic). ``names`` has a letter for each bit of a mask, the lowest first."""
    def run(key, frame):
        own = {int(m): (int(n), int(g), int(t)) for m, n, g, t in frame[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        return pd.DataFrame(audit_part(key[0], names, own), columns=[c.split()[0] for c in STEPS.split(", ")])
    return masks.groupBy("part").applyInPandas(run, STEPS)


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    return audit(*count_masks(docs, labels, **columns))
