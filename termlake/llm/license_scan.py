"""Licence scans: templates found by winnowed fingerprints, then aligned.

Texts are runs of letters and digits, lower-cased. Of every ``WINNOW`` neighbouring
three-word sequences the one with the least hash is a fingerprint, so an unchanged
run of five words shares one with its template. The templates' fingerprints are
an inverted index that goes with the job, as large as the templates are. Where a
document's fingerprints meet a template's on nearby diagonals there is a candidate.
Around each of its fingerprints in turn the text is aligned word by word with the
template, in a band around the diagonals: equal words score, unequal and missing
ones cost. What the best alignment matches of the template is its coverage. If that
is enough it is a finding, and the words before and after it are aligned by
themselves, so a notice that comes again and again is found each time. Of findings
that overlap the one stays whose matched words exceed its missing ones most.

Spans count the words and characters of the text as it stands. A null or empty text
has no findings. Rows are scanned one by one, so repeated rows give repeated
findings. An empty table gives an empty result."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM_WORDS, WINNOW = 3, 3
BAND = 12
MATCH, MISS, GAP = 1.0, -0.6, -0.6
LEAST_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")

FOUND = ("doc_id long, template string, coverage double, matched_words long, template_words long, start_word long, "
         "end_word long, start_char long, end_char long")


def _hashes(ids: np.ndarray) -> np.ndarray:
    """Of every three words; the largest number where a word is in no template (0)."""
    n = len(ids) - GRAM_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM_WORDS):
        part = ids[k:k + n]
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        known &= part > 0
    return np.where(known, out, np.uint64(0xFFFFFFFFFFFFFFFF))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: wherever a hash is the least of a window."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = min(WINNOW, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    places = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
    return places[hashes[places] != np.uint64(0xFFFFFFFFFFFFFFFF)]


class Index:
    """The templates' words and fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        words = [WORD.findall(t.lower()) for t in templates.values()]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in words for w in t), 1)}
        self.texts = [np.array([self.number[w] for w in t], np.int64) for t in words]
        hashes = [_hashes(ids) for ids in self.texts]
        rows = sorted((h[at], t, at) for t, h in enumerate(hashes) for at in winnow(h))
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template, self.at = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(template, diagonals, places) of the fingerprints that meet on diagonals of
        which neighbours are near, in the order of their places."""
        hashes = _hashes(ids)
        places = winnow(hashes)
        lo, hi = (np.searchsorted(self.keys, hashes[places], side) for side in ("left", "right"))
        count = hi - lo
        if not count.any():
            return []
        row = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(places, count)
        template, diagonal = self.template[row], place - self.at[row]
        order = np.lexsort((place, diagonal, template))
        template, diagonal, place = template[order], diagonal[order], place[order]
        new = np.r_[True, (np.diff(template) != 0) | (np.diff(diagonal) > BAND)]
        start = np.flatnonzero(new)
        out = []
        for a, b in zip(start, np.r_[start[1:], len(order)], strict=True):
            by_place = a + np.argsort(place[a:b], kind="stable")
            out.append((int(template[a]), diagonal[by_place], place[by_place]))
        return out


def align(text: list[int], template: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment on the diagonals ``low`` to ``high`` (text less template):
    matched words, first word and end of it in the text."""
    width, n = high - low + 1, len(text)
    none = (0.0, 0, 0, 0)  # score, matched, first, end
    above, best = [none] * (width + 1), none
    for i, word in enumerate(template):
        row, left = [none] * (width + 1), none
        for d in range(width):
            j = i + low + d
            if not 0 <= j < n:
                left = none
                continue
            s, m, first, _ = above[d]  # the same diagonal, one word back in both
            if text[j] == word:
                cell = (s + MATCH, m + 1, first if s > 0 else j, j + 1)
            else:
                cell = (s + MISS, m, first, j + 1)
            for other in (left, above[d + 1]):
                if other[0] + GAP > cell[0]:
                    cell = (other[0] + GAP, *other[1:3], j + 1)
            if cell[0] <= 0:
                cell = none
            elif cell[0] > best[0]:
                best = cell
            row[d] = left = cell
        above = row
    return best[1], best[2], best[3]


def aligned(ids: np.ndarray, own: np.ndarray, diagonal: np.ndarray, place: np.ndarray,
            least: float) -> list[tuple[int, int, int]]:
    """(matched words, first word, end) of all alignments of a candidate that match
    ``least`` words and do not overlap."""
    found, parts = [], [(0, len(ids), 0, len(place))]  # words, and the fingerprints in them
    reach, template = len(own) + BAND, own.tolist()
    while parts:
        a, b, i, j = parts.pop()
        while i < j:
            near = diagonal[i:i + int(np.searchsorted(place[i:j], place[i] + reach, "right"))]
            start, stop = max(a, int(place[i]) - reach), min(b, int(place[i]) + reach + GRAM_WORDS)
            matched, first, end = align(ids[start:stop].tolist(), template, int(near.min()) - start - BAND, int(near.max()) - start + BAND)
            if matched >= least:
                first, end = start + first, start + end
                found.append((matched, first, end))
                before, after = (i + int(np.searchsorted(place[i:j], *at)) for at in ((first - GRAM_WORDS, "right"), (end, "left")))
                parts += [(a, first, i, before), (end, b, after, j)]
                break
            i += 1
    return found


def scan_text(text: str, index: Index, least_coverage: float = LEAST_COVERAGE) -> list[tuple]:
    """(template, coverage, matched, words of the template, first word, end, first
    character, end) of each finding, in text order."""
    number, words = index.number, list(WORD.finditer(text))
    ids = np.array([number.get(w[0].lower(), 0) for w in words], np.int64)
    found = []
    for t, diagonal, place in index.candidates(ids):
        own = index.texts[t]
        found += [(matched, 2 * matched - len(own), t, a, b)
                  for matched, a, b in aligned(ids, own, diagonal, place, least_coverage * len(own))]
    chosen: list[tuple] = []
    taken = np.zeros(len(ids), bool)
    for f in sorted(found, key=lambda f: (-f[1], f[4] - f[3], f[2], f[3])):
        if not taken[f[3]:f[4]].any():
            taken[f[3]:f[4]] = True
            chosen.append(f)
    if not chosen:
        return []
    spans = [m.span() for m in words]
    return [(index.names[t], matched / len(index.texts[t]), matched, len(index.texts[t]), a, b, spans[a][0], spans[b - 1][1])
            for matched, _, t, a, b in sorted(chosen, key=lambda c: c[3])]


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least_coverage: float = LEAST_COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per finding: doc_id, template, coverage, matched words and the template's,
    and the span in words and characters."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for found in scan_text(text.as_py() or "", index, least_coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=names)
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, FOUND)
