"""Proximity against all placements, and on many repeated words."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

import termlake as tl
from termlake.operators import near
from termlake.operators.scan import scan


def starts_of(places, offsets, slots, slop):
    """First words of all affordable placements, by trying every one."""
    out = set()
    for picked in itertools.product(*[range(len(places[s])) for s in slots]):
        if len({(s, i) for s, i in zip(slots, picked)}) == len(slots):
            q = [places[s][i] - o for s, i, o in zip(slots, picked, offsets)]
            if sum(abs(b - a) for a, b in zip(q, q[1:])) <= slop:
                out.add(picked[0])
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_starts_against_every_placement(seed):
    rng = random.Random(seed)
    for _ in range(120):
        kinds = rng.randint(1, 3)
        slots = [rng.randrange(kinds) for _ in range(rng.randint(2, 5))]
        places = [sorted(rng.sample(range(18), rng.randint(0, 6))) for _ in range(kinds)]
        offsets = list(range(len(slots)))
        slop = rng.randint(1, 12)
        assert near.starts(places, offsets, slots, slop) == starts_of(places, offsets, slots, slop)


def test_columns_against_every_placement(spark):
    rng = random.Random(9)
    rows = [tuple(sorted(rng.sample(range(25), rng.randint(1, 7))) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, c array<int>")
    for slop in (1, 4, 9):
        words = ((0, "a"), (1, "c"), (2, "b"))
        got = df.select("*", near.cheapest_starts({w: F.col(w) for w in "abc"}, words, slop).alias("s")).collect()
        assert all(sorted(r.s) == [r.a[i] for i in starts_of([r.a, r.c, r.b], [0, 1, 2], [0, 1, 2], slop)] for r in got)


def test_many_repeated_words_end_soon(spark, tmp_path):
    """A document of 20,000 equal words, and one where they hardly fit."""
    sparse = " ".join("the" if i % 11 == 0 else f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame(
        [("a", "a.txt", "txt", "the " * 20_000, 1, 1), ("b", "b.txt", "txt", "the " * 5, 1, 1), ("c", "c.txt", "txt", sparse, 1, 1)],
        "path string, filename string, ext string, content string, modified long, size long")
    store = tl.CollectionStore(spark, str(tmp_path))
    store.create("N", [])
    store.build_from("N", docs)
    condition = tl.near("the the the the the the", 50)
    began = time.time()
    assert sorted(r.path for r in store.open("N").matches(condition).collect()) == ["a", "c"]
    assert sorted(r.path for r in scan(docs, condition).collect()) == ["a", "c"]
    assert sorted(r.path for r in scan(docs, tl.near("the the the the the the", 40)).collect()) == ["a"]
    assert time.time() - began < 60
