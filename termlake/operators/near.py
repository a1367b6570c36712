"""Proximity: words that can be brought next to each other by few moves.

A placement gives every word of a condition a position of its own. Its cost is the
sum of the differences between the shifts of neighbouring words. Which positions of
the first word start an affordable placement follows from the least cost from each
position to the last word, found from the last word back to the first: what a start
may cost does not depend on the start, so no list of placements is kept, only one
cost for each position.

Where a word comes more than once its positions must differ. The least costs without
that demand are then a bound, and a start within it is searched for by depth: of the
free positions on each side of where the word should be, only as many nearest ones
can matter as the word still has to be placed, since a nearer free position that no
later place of the word takes would be as good or better."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def cheapest_starts(places: dict[str, Column], words: tuple[tuple[int, str], ...], slop: int) -> Column:
    """Positions of the first word from which words that all differ can be placed,
    from the position arrays of each word."""
    off, word = words[-1]
    costs = F.transform(places[word], lambda p: F.struct((p - off).alias("q"), F.lit(0).alias("cost")))

    def before(off: int, word: str):
        def step(after: Column) -> Column:
            least = lambda q: F.array_min(F.transform(after, lambda s: s["cost"] + F.abs(s["q"] - q)))
            here = F.transform(places[word], lambda p: F.struct((p - off).alias("q"), least(p - off).alias("cost")))
            return F.filter(here, lambda s: s["cost"] <= slop)
        return step

    for off, word in reversed(words[:-1]):
        costs = F.transform(F.array(costs), before(off, word))[0]
    first = words[0][0]
    return F.transform(costs, lambda s: s["q"] + first)


# --- words that come more than once ---------------------------------------------

def least_costs(shifts: list[np.ndarray]) -> list[np.ndarray]:
    """For each shift of each word the least cost from there to the last word, with
    positions that may coincide. Shifts ascend."""
    out = [np.zeros(len(shifts[-1]))]
    for here, after in zip(shifts[-2::-1], shifts[:0:-1], strict=True):
        cost = out[0]
        at = np.searchsorted(after, here, "right")
        left = np.concatenate([[np.inf], np.minimum.accumulate(cost - after)])[at] + here
        right = np.concatenate([np.minimum.accumulate((cost + after)[::-1])[::-1], [np.inf]])[at] - here
        out.insert(0, np.minimum(left, right))
    return out


def starts(places: list, offsets: list[int], slots: list[int], slop: int) -> list[int]:
    """Places in the first word's positions that start an affordable placement.
    ``slots`` says for each word which of ``places`` has its positions, ascending."""
    if any(len(places[s]) == 0 for s in slots):
        return []
    own = [np.asarray(places[s], np.int64) for s in slots]
    shifts = [p - o for p, o in zip(own, offsets, strict=True)]
    bound = least_costs(shifts)
    later = [slots[k + 1:].count(slots[k]) + 1 for k in range(len(slots))]  # how often the word is still to be placed
    plain = [(x.tolist(), b.tolist()) for x, b in zip(shifts, bound, strict=True)]
    hopeful = np.flatnonzero(bound[0] <= slop).tolist()
    if len(set(slots)) == len(slots):
        return hopeful

    def found(k: int, q: int, cost: float, used: frozenset, dead: dict) -> bool:
        if k == len(slots):
            return True
        key = k, q, used
        if dead.get(key, np.inf) <= cost:
            return False
        shift, least = plain[k]
        slot, at = slots[k], int(np.searchsorted(shifts[k], q))
        options = []
        for step, i in ((1, at), (-1, at - 1)):
            free = 0
            while 0 <= i < len(shift) and free < later[k] and cost + abs(shift[i] - q) <= slop:
                if (slot, i) not in used:
                    free += 1
                    total = cost + abs(shift[i] - q)
                    if total + least[i] <= slop:
                        options.append((total + least[i], total, i))
                i += step
        for _, total, i in sorted(options):
            if found(k + 1, shift[i], total, used | {(slot, i)}, dead):
                return True
        dead[key] = cost
        return False

    return [i for i in hopeful if found(1, plain[0][0][i], 0, frozenset([(slots[0], i)]), {})]


def starting_positions(places: list[Column], offsets: list[int], slots: list[int], slop: int) -> Column:
    """As ``cheapest_starts``, for any words: Arrow hands the positions over."""
    @F.pandas_udf("array<int>")
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([[int(row[slots[0]][i]) for i in starts(row, offsets, slots, slop)] for row in rows])
    return run(*places)


def near_starts(places: dict[str, Column], words: tuple[tuple[int, str], ...], slop: int) -> Column:
    """Positions of the first word that start an affordable placement of ``words``
    (offset, word). ``places`` are columns, not values inside a lambda, if a word
    comes twice."""
    if len({w for _, w in words}) == len(words):
        return cheapest_starts(places, words, slop)
    names = list(places)
    return starting_positions([F.sort_array(places[w]) for w in names], [o for o, _ in words], [names.index(w) for _, w in words], slop)


def all_present(places: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (F.size(p) > 0 for p in places.values()))
