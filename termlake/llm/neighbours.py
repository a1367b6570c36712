"""Approximate nearest neighbours by collision counting.

Nearness is the inner product. Vectors get one more component that brings all of a
block to the norm of its longest, and a query gets a zero there; then the largest
inner product is the smallest distance. The index keeps, block by block, a sorted
array of the projections on each of a set of orthonormal directions, one direction
to an array. A query opens a window around its own projection in every array, and
a vector collides with it wherever it lies in the window. The windows belong to a
search radius. If the radius holds too few neighbours it grows by ``GROWTH``, and
the windows grow with it around the query, so that only what they gain is counted
(virtual rehashing). A vector with enough collisions is verified: its inner product
is computed. A block is done when the radius holds as many verified vectors as are
wanted. How many collisions are enough follows from how a difference of exactly the
radius spreads over random directions: all but a share ``MISSED`` of such vectors
have more.

Every row is indexed. Equal vectors are indexed once, with the least of their ids,
as many as any answer can need, so a vector that a third of all rows share is one
entry; equal queries are searched once. Blocks hold ``BLOCK_VECTORS`` vectors of
similar norm. Queries stream past each block, and what a block finds for a query is
cut before anything is merged, so no task holds more than a block and a batch. The
work is queries times blocks, as the query set is stated and grows with the table.

A null id, a null vector, and one that is zero, holds a null or is not finite takes
no part; neither do vectors of another length than the most frequent (of equally
frequent lengths, the largest). Of rows with the same id the one with the least
vector counts. Ties go to the smaller id. An empty table gives an empty result."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_lookup, numbered, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_VECTORS = 16_384
#: At least this many directions; whole sets of orthonormal ones.
DIRECTIONS = 64
#: Half a window over the search radius, growth of the radius, and the share of
#: vectors at the very radius that may collide too seldom.
WIDTH, GROWTH, MISSED = 1.6, 1.08, 0.2
#: Vectors of a block that are looked at for the first radius of a query.
SEEDS = 256
BATCH_QUERIES = 256


def directions(size: int, least: int = DIRECTIONS, seed: int = 11) -> np.ndarray:
    """Rows of random rotations of a space of ``size``, scaled so that a difference
    of length 1 has components of variance 1. Of a large space, ``2 * least`` rows."""
    rng, out = np.random.default_rng(seed), []
    while sum(map(len, out)) < least:
        rows = np.linalg.qr(rng.normal(size=(size, size)))[0].T
        out.append(rows[:2 * least] * np.sqrt(size))
    return np.concatenate(out)


def enough_collisions(rows: np.ndarray, width: float = WIDTH, missed: float = MISSED, trials: int = 4000) -> int:
    """Collisions that all but ``missed`` of the vectors at the radius have."""
    rng = np.random.default_rng(5)
    apart = rng.normal(size=(trials, rows.shape[1]))
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    counts = np.sort((np.abs(apart @ rows.T) <= width).sum(axis=1))
    return max(1, int(counts[int(missed * trials)]))


class Block:
    """The sorted arrays of some vectors, and the ids that each of them has."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], rows: np.ndarray, enough: int):
        self.vectors, self.ids, self.enough = vectors, ids, enough
        n = len(vectors)
        self.scale = max(float(np.abs(vectors).max()), np.finfo(float).tiny)
        scaled = vectors / self.scale
        squares = (scaled * scaled).sum(axis=1)
        self.norm = float(np.sqrt(squares.max()))
        lifted = np.concatenate([scaled, np.sqrt(np.maximum(self.norm ** 2 - squares, 0))[:, None]], axis=1)
        projected = lifted @ rows.T
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        # one ascending array of all, a span apart, so that one search finds all windows
        self.low = float(self.sorted.min())
        self.span = 4 * (float(self.sorted.max()) - self.low) + 4 * self.norm
        self.shift = np.arange(len(rows)) * self.span
        self.flat = (self.sorted - self.low + self.shift[:, None]).ravel()
        self.first = np.arange(len(rows)) * n
        self.rows = rows
        self.seeds = np.linspace(0, n - 1, min(SEEDS, n)).astype(np.int64)

    def _bounds(self, values: np.ndarray, side: str) -> np.ndarray:
        """Where each value would stand in its array: queries x directions."""
        inside = np.clip(values - self.low, -self.norm, self.span - 2 * self.norm)
        return np.searchsorted(self.flat, inside + self.shift, side) - self.first

    def search(self, queries: np.ndarray, wanted: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, inner products) of at least the best ``wanted`` found, for each query."""
        n = len(self.vectors)
        if n <= wanted:
            return [(np.arange(n), (self.vectors * q).sum(axis=1)) for q in queries]
        size = np.abs(queries).max(axis=1, keepdims=True)
        unit = queries / size
        stretch = self.norm / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        unit *= stretch
        centre = unit @ self.rows[:, :-1].T
        near = np.maximum(2 * self.norm ** 2 - 2 * (unit @ (self.vectors[self.seeds] / self.scale).T), 0)
        near[near < 1e-9 * self.norm ** 2] = 4 * self.norm ** 2  # the query itself is no guide
        start = np.sqrt(near.min(axis=1))
        start = np.maximum(start, 1e-6 * self.norm)
        lows = self._bounds(centre - WIDTH * start[:, None], "left")
        highs = self._bounds(centre + WIDTH * start[:, None], "right")
        return [self._expand(*x, wanted) for x in zip(queries, (stretch / size).ravel() / self.scale, centre, start, lows, highs, strict=True)]

    def _expand(self, query, stretch, centre, radius, low, high, wanted) -> tuple[np.ndarray, np.ndarray]:
        n, order = len(self.vectors), self.order
        outside = [part for o, a, b in zip(order, low, high, strict=True) for part in (o[:a], o[b:])]
        counts = len(order) - np.bincount(np.concatenate(outside), minlength=n)
        done = np.zeros(n, bool)
        places, products, apart = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        while True:
            fresh = np.flatnonzero((counts >= self.enough) & ~done)
            if len(fresh):
                done[fresh] = True
                own = (self.vectors[fresh] * query).sum(axis=1)
                places, products = np.concatenate([places, fresh]), np.concatenate([products, own])
                apart = np.concatenate([apart, 2 * self.norm ** 2 - 2 * stretch * own])
            if len(places) >= wanted and (len(places) == n or (apart <= radius * radius).sum() >= wanted):
                return places, products
            radius *= GROWTH
            wider_low = self._bounds(centre - WIDTH * radius, "left")
            wider_high = self._bounds(centre + WIDTH * radius, "right")
            gained = [o[a:b] for o, x, y, w, z in zip(order, low, high, wider_low, wider_high, strict=True)
                      for a, b in ((w, x), (y, z))]
            counts += np.bincount(np.concatenate(gained), minlength=n)
            low, high = wider_low, wider_high


def best_of(places: np.ndarray, products: np.ndarray, ids: list[np.ndarray], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``wanted`` ids by product and id. Of equal products the vectors with
    the smallest ids are enough, as each vector's ids come smallest first."""
    if len(products) > 4 * wanted:
        near = products >= np.partition(products, len(products) - wanted)[len(products) - wanted]
        places, products = places[near], products[near]
    own = [ids[p] for p in places]
    all_ids, all_products = np.concatenate(own), np.repeat(products, [len(x) for x in own])
    order = np.lexsort((all_ids, -all_products))[:wanted]
    return all_ids[order], all_products[order]


# --- the operator ------------------------------------------------------------------

FOUND = "query long, vec_id long, score double"


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(wanted: int):
    """Rows come block by block, the block's vectors before the queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vectors, ids, block, rows, enough = None, [], [], None, None, 0
        for batch in batches:
            of, is_query = batch.column("block").to_numpy(), batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(of):
                change = np.flatnonzero((of[at:] != of[at]) | (is_query[at:] != is_query[at]))
                end = at + (int(change[0]) if len(change) else len(of) - at)
                if of[at] != current:
                    current, vectors, ids, block = of[at], [], [], None
                if not is_query[at]:
                    part = batch.slice(at, end - at)
                    vectors.append(_floats(part.column("vec")))
                    ids += [x.values.to_numpy() for x in part.column("ids")]
                else:
                    if rows is None:
                        rows = directions(vectors[0].shape[1] + 1)
                        enough = enough_collisions(rows)
                    block = block or Block(np.concatenate(vectors), ids, rows, enough)
                    vectors = []
                    for a in range(at, end, BATCH_QUERIES):
                        part = batch.slice(a, min(BATCH_QUERIES, end - a))
                        found = block.search(_floats(part.column("vec")), wanted)
                        best = [best_of(*x, ids, wanted) for x in found]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(part.column("query").to_numpy(), [len(i) for i, _ in best])),
                             pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))],
                            names=["query", "vec_id", "score"])
                at = end
    return run


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part, one for each id."""
    vec = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = out.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    lengths = out.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    length = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    out = out.filter(F.size("vec") == (length["n"] if length else 0))
    again = out.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out if again.isEmpty() else out.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner
    product for each row that ``is_query``, a condition on ``vec_id``."""
    spark, wanted = rows.sparkSession, k + 1  # the query's own row is among them
    own = written(usable(rows, id_col, vector_col).withColumn("key", F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(7), "vec"))), "vectors")
    least = Window.partitionBy("key").orderBy("vec_id")
    few = own.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= wanted)
    entries = few.groupBy("key").agg(F.min_by("vec", "place").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    index = numbered(entries.withColumn("norm", F.round(norm, 6)), [F.desc("norm"), F.col("key")], "number")
    index = index.select((F.col("number") / block_vectors).cast("long").alias("block"), "vec", "ids")

    asked = own.filter(is_query)
    each = written(asked.groupBy("key").agg(F.min("vec_id").alias("query"), F.count(F.lit(1)).alias("rows"),
                                            F.first("vec").alias("vec")), "asked")
    n_blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    streams = each.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "query", "vec")
    both = (index.select("block", F.lit(None).cast("long").alias("query"), "vec", "ids")
            .unionByName(streams.withColumn("ids", F.lit(None).cast("array<long>"))))
    found = (both.repartition(n_blocks, "block").sortWithinPartitions("block", F.col("query").isNotNull())
             .select("block", "query", "vec", "ids").mapInArrow(_search(wanted), FOUND))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= wanted)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    lists = written(lists.join(each.select("query", "key", "rows"), "query").select("key", "found", "rows"), "nearest")
    total = lists.agg(F.sum("rows")).first()[0] or 0
    answers = join_lookup(asked.select(F.col("vec_id").alias("query_id"), "key"), lists, "key", "rows", total)
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = answers.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
