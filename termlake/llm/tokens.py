"""Token ids of whole texts, part by part.

A byte-level tokenizer splits a text before it merges, and where it splits can be
told from white space: a single space goes with what follows, other white space is
by itself. So the ids of a text are those of its parts, one after the other, and the
ids of parts that came up lately are looked up."""

from __future__ import annotations

import json
import re
import sys
from array import array

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pieces of text whose ids a worker remembers, in each of two generations.
REMEMBERED = 100_000

#: Fixed value: how byte-level tokenizers split a text before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def printed_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(source: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file."""
    vocabulary, byte_of = json.loads(source)["model"]["vocab"], printed_bytes()
    out = [b""] * (max(vocabulary.values(), default=0) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of.get(c, 0) for c in token)
    return out


def merger(source: str):
    """The merges of a byte-level tokenizer file as a tiktoken encoding, which runs
    them faster; None unless the file says that both give the same ids."""
    import tiktoken
    spec = json.loads(source)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type"), before.get("type")) != ("BPE", "ByteLevel") or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    byte_of = printed_bytes()
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ids = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [ids["".join(m)] for m in pairs]
    if merged != sorted(merged):  # tiktoken takes the ids for the order of the merges
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items()}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: what the split above takes for white space.
_S = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space and a word; all white space but the last before a word; that last one.
PART = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]")


class Memory(dict):
    """What was computed for parts of text lately: two generations of about ``size``
    each. A part of the older one that comes up again moves on."""

    def __init__(self, compute, size: int = REMEMBERED):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, part: str):
        value = self.old.get(part)
        if value is None:
            value = self.compute(part)
        self[part] = value
        return value

    def learn(self, parts: set[str], compute) -> None:
        """Know all of ``parts``; ``compute`` gives those of a list that are new."""
        new = []
        for part in parts:
            if part not in self:
                value = self.old.get(part)
                if value is None:
                    new.append(part)
                else:
                    self[part] = value
        self.update(zip(new, compute(new), strict=True))

    def settle(self) -> None:
        """Start a new generation if this one is full."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class ByteLevel:
    """A byte-level tokenizer file. ``specials`` says whether the strings of special
    tokens inside texts become those tokens; if not they are ordinary text."""

    def __init__(self, path: str, specials: bool, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        source = self.tokenizer.to_str()
        self.merger, self.bytes = merger(source), token_bytes(source)
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.special = re.compile("|".join(names) or r"(?!)")
        self.memory = Memory(lambda part: array("I", self.merger.encode_ordinary(part)).tobytes(), remembered)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids as unsigned 32-bit numbers in this machine's byte order."""
        if self.merger is None:
            return self.whole(texts)
        self.memory.settle()
        known = self.memory.__getitem__
        return [b"".join(map(known, PART.findall(x))) if not self.special.search(x) else self.whole([x])[0] for x in texts]
