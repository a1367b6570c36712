"""Edit distance with transpositions, capped at 3, as one built-in expression.

``levenshtein`` counts a swap of neighbours as two edits. A swap that is part of
a shortest edit script of length at most 2 is either made first on the typed
word, or last on the stored term, or the whole script is two swaps. The typed
word's variants are literals, so their number depends on its length only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swaps(word: str) -> set[str]:
    return {word[:i] + word[i + 1] + word[i] + word[i + 2:]
            for i in range(len(word) - 1) if word[i] != word[i + 1]}


def edit_distance(term: Column, stem: str, cap: int = 2) -> Column:
    """Distance between ``term`` and the literal ``stem``; ``cap + 1`` if more."""
    far = F.lit(cap + 1)
    lev = lambda a, b: F.coalesce(F.nullif(F.levenshtein(a, b, cap), F.lit(-1)), far)
    steps = [lev(term, F.lit(stem))]
    one = sorted(_swaps(stem))
    if one:
        steps.append(F.when(term.isin(one), 1).otherwise(far))
    if cap >= 2:
        steps += [lev(term, F.lit(v)) + 1 for v in one]
        two = sorted({w for v in one for w in _swaps(v)})
        if two:
            steps.append(F.when(term.isin(two), 2).otherwise(far))
        swapped = F.transform(
            F.sequence(F.lit(1), F.char_length(term) - 1),
            lambda i: lev(F.lit(stem), F.concat(
                F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.lit(1)),
                F.substring(term, i, F.lit(1)), F.substring(term, i + 2, F.char_length(term)))),
        )
        steps.append(F.when(F.char_length(term) > 1, F.array_min(swapped) + 1).otherwise(far))
    steps.append(far)
    return F.least(*steps)


def within_distance(term: Column, stem: str, distance: int) -> Column:
    """``term`` is at most ``distance`` edits from ``stem``; a cheap length test
    comes first so most terms never reach the edit distance."""
    near_len = F.abs(F.char_length(term) - F.lit(len(stem))) <= distance
    return F.when(near_len, edit_distance(term, stem, distance) <= distance).otherwise(False)


def _swapped(word: Column) -> Column:
    """All strings that one swap of neighbours makes of ``word``."""
    swap = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)),
                              F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.char_length(word)))
    n = F.char_length(word)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), swap)).otherwise(F.array().cast("array<string>"))


def within_distance_of(term: Column, stem: Column, distance: Column) -> Column:
    """``within_distance`` for stems and distances, at most 2, of a column."""
    far = F.lit(9)
    lev = lambda a, b: F.coalesce(F.nullif(F.levenshtein(a, b, 2), F.lit(-1)), far)
    least = lambda values: F.coalesce(F.array_min(values), far)
    of_stem = least(F.transform(_swapped(stem), lambda v: F.when(v == term, 1).otherwise(
        F.least(lev(term, v) + 1, F.when(F.array_contains(_swapped(v), term), 2).otherwise(far)))))
    of_term = least(F.transform(_swapped(term), lambda u: lev(stem, u) + 1))
    near_len = F.abs(F.char_length(term) - F.char_length(stem)) <= distance
    return F.when(near_len, F.least(lev(term, stem), of_stem, of_term) <= distance).otherwise(False)


# --- look-up by what is left -------------------------------------------------

#: Letters are taken out of a word's beginning only, so a long word has as few rests
#: as a word of this length, 29. Two words within ``d`` edits still share one: edits up
#: to there take no more than ``d`` of these letters from either word.
REST_OF = 7
MAX_RESTS = 1 + REST_OF + REST_OF * (REST_OF - 1) // 2  # of a word, without up to two letters


def rests(word: str, bound: int = 2) -> list[str]:
    """What is left of a word's beginning when up to ``bound`` letters are taken out."""
    start = word[:REST_OF]
    return sorted({"".join(c for i, c in enumerate(start) if i not in out)
                   for n in range(bound + 1) for out in combinations(range(len(start)), n)})


def rests_of(word: Column) -> Column:
    """``rests`` of a column, for up to two letters. The places are literals, so this is
    compiled code; a place behind a word's end takes nothing out."""
    part = lambda a, b: F.substring(word, a + 1, b - a)  # from letter a up to before b, counted from 0
    out = [places for n in range(3) for places in combinations(range(REST_OF), n)]
    left = lambda places: F.concat(*[part(a, b) for a, b in zip((0, *(i + 1 for i in places)), (*places, REST_OF), strict=True) if a < b])
    return F.array_distinct(F.array(*[left(places) for places in out]))
