"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a partition are one stream of tokens, in the order in which they
stand there. Windows are cut from it one after the other, so nothing is reordered.
A cut may lie at the end of a document for nothing, at the end of a sentence for a
small penalty, and in a run without sentence ends for a larger one. The cuts
minimise the padding and the penalties: the best way to a cut is the least of
"best way to an earlier cut, plus its window's padding" over all cuts at most a
window back, which a monotone queue gives in constant time; windows with a power
of two of tokens are not padded and are tried by themselves. The stream is solved
``GATHER_TOKENS`` at a time, the unfinished end going on to the next part.

A null text is empty and has only the closing token. Repeated rows and documents
with the same id are packed like any other. An empty table gives an empty result."""

from __future__ import annotations

import sys
import types
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ByteLevel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 2048
CLOSING_ID = 1
#: In tokens: what a cut inside a document costs at a sentence end and elsewhere,
#: and what any further sequence costs, so that short ones are not made for nothing.
SENTENCE_CUT, HARD_CUT, SEQUENCE = 8.0, 64.0, 16.0
#: A longer run without a possible cut gets hard cuts this far apart.
HARD_STEP = 256
SHORT_WINDOWS = (32, 64, 128, 256, 512, 1024)
GATHER_TOKENS = 400_000
#: Parts of text whose ids a worker remembers, in each of two generations.
REMEMBERED = 250_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")


# --- token ids -----------------------------------------------------------------

class Encoder:
    """Ids of whole texts, as the tokenizer gives them, and where sentences end."""

    def __init__(self, path: str):
        self.tokens = ByteLevel(path, specials=True, remembered=REMEMBERED)
        vocabulary = self.tokens.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 2
        self.ends, self.opens = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():  # Ġ and Ċ stand for a space and a line break
            self.ends[i], self.opens[i] = token[-1:] in (".", "!", "?", "Ċ"), token[:1] in ("Ġ", "Ċ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.tokens.encode(texts)]


def encoder(path: str) -> Encoder:
    """One for each file and worker process, kept while Spark reuses the process."""
    kept = sys.modules.setdefault("_packing_state", types.ModuleType("_packing_state"))
    made = vars(kept).setdefault("encoders", {})
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


# --- cuts ------------------------------------------------------------------------

def short_starts(at: list[int], window: int) -> dict[int, list[int]]:
    """The cuts that are just a short window before a cut, of each cut that has any."""
    places = np.asarray(at)
    found: dict[int, list[int]] = {}
    for n in (n for n in SHORT_WINDOWS if n < window):
        before = np.searchsorted(places, places - n, "right") - 1
        cuts = np.flatnonzero((before >= 0) & (places[before] == places - n))
        for j, k in zip(cuts.tolist(), before[cuts].tolist(), strict=True):
            found.setdefault(j, []).append(k)
    return found


def choose_cuts(at: list[int], penalty: list[float], window: int = WINDOW) -> tuple[list[float], list[int]]:
    """For each possible cut ``at`` (ascending from 0, at most a window apart) the
    cost of the best way to it and the cut before it on that way."""
    cost, back, queue = [0.0] * len(at), [0] * len(at), deque([0])
    level = [0.0] * len(at)  # cost + position: what the queue is ordered by
    level[0] = float(at[0])
    short = short_starts(at, window)
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best = level[i] + window - p
        for k in short.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        best += penalty[j] + SEQUENCE
        cost[j], back[j], level[j] = best, i, best + p
        while queue and level[queue[-1]] >= level[j]:
            queue.pop()
        queue.append(j)
    return cost, back


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, coder: Encoder) -> tuple[list[int], list[float]]:
    """Where ``ids`` may be cut, from 0, and the penalties."""
    sentence = np.flatnonzero(coder.ends[ids[:-1]] & coder.opens[ids[1:]]) + 1
    places = np.unique(np.concatenate([[0], sentence, doc_ends]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > HARD_STEP)
    hard = [np.arange(places[k] + HARD_STEP, places[k + 1], HARD_STEP) for k in wide]
    hard = np.concatenate([np.zeros(0, np.int64), *hard])
    at = np.sort(np.concatenate([places, hard]))
    penalty = np.full(len(at), SENTENCE_CUT)
    penalty[np.isin(at, hard)] = HARD_CUT
    penalty[np.isin(at, doc_ends)] = 0.0
    return at.tolist(), penalty.tolist()


class Stream:
    """The tokens that are not packed yet, and the documents that they belong to."""

    def __init__(self, coder: Encoder, first_sequence: int, window: int):
        self.coder, self.sequence, self.window = coder, first_sequence, window
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # id, start of the rest, tokens, the rest
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.waiting += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """The pieces of finished sequences. Unless ``last``, the tokens after the
        cheapest of the final cuts stay."""
        if not self.docs:
            return []
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        at, penalty = possible_cuts(ids, ends, self.coder)
        cost, back = choose_cuts(at, penalty, self.window)
        j = len(at) - 1
        if not last:
            j = min((k for k in range(1, len(at)) if at[k] > at[-1] - self.window), key=lambda k: cost[k] - at[k] * 1e-3)
        bounds = [at[j]]
        while j:
            j = back[j]
            bounds.append(at[j])
        bounds.reverse()
        rows, doc, begin = [], 0, 0  # begin: where the current document's rest begins
        for a, b in zip(bounds, bounds[1:], strict=False):
            here = a
            while here < b:
                while ends[doc] <= here:
                    begin = int(ends[doc])
                    doc += 1
                name, start, tokens, _ = self.docs[doc]
                stop = min(b, int(ends[doc]))
                rows.append((name, start + here - begin, stop - here, zlib.crc32(ids[here:stop].tobytes()), tokens,
                             self.sequence, here - a, b - a))
                here = stop
            self.sequence += 1
        end, rest, begin = bounds[-1], [], 0
        for (name, start, tokens, own), stop in zip(self.docs, ends, strict=True):
            if stop > end:
                skip = max(0, end - begin)
                rest.append((name, start + skip, tokens, own[skip:]))
            begin = int(stop)
        self.docs, self.waiting = rest, int(ends[-1]) - end
        return rows


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, start and length in the document's ids,
    their crc32, the document's tokens, the sequence, the offset there and the
    sequence's tokens. ``tokenizer`` is a file that every node has. A sequence's
    number holds its partition, and its order there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        stream = Stream(coder, TaskContext.get().partitionId() << 40, window)
        closing = np.array([CLOSING_ID], "<u4")

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(texts), strict=True):
                    stream.add(doc_id, np.concatenate([ids, closing]))
                if stream.waiting > GATHER_TOKENS and (rows := stream.pack(False)):
                    yield out(rows)
        if rows := stream.pack(True):
            yield out(rows)

    names = [x.split()[0] for x in PIECES.split(", ")]
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, PIECES)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
