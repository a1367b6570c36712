"""Column functions on text, names and paths. All of them are built-in
expressions, so they stay on the JVM and inside the scan's stage."""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a maximal run of letters and digits, lower-cased.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
PIECES = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-cased tokens in text order; the index in the array is the position.

    ``split`` on the gaps costs about half of ``regexp_extract_all`` on the
    tokens. It can only leave an empty string at either end, which is removed."""
    return F.array_remove(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), TOKEN_BREAK), "")


def query_tokens(text: str) -> list[tuple[int, str]]:
    """(offset, token) of a condition's own words, cut as the documents are."""
    runs = ("".join(g) for is_tok, g in groupby(
        text.lower(), key=lambda ch: unicodedata.category(ch)[0] in "LN") if is_tok)
    return list(enumerate(runs))


def filename_of(path) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(_col(path), "/"), -1)


def ext_of(path) -> Column:
    """Lower-cased last extension; empty for none and for a bare dotfile."""
    return F.lower(F.regexp_extract(_col(path), r"[^/]\.([^./]*)$", 1))


def mtime_millis(ts) -> Column:
    """Modification time in epoch milliseconds, 0 where it is unknown."""
    return F.coalesce(F.unix_millis(_col(ts)), F.lit(0).cast("bigint"))


def slugify(name) -> Column:
    """Directory-safe form of a collection name."""
    dashed = F.regexp_replace(_col(name), "[^A-Za-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(F.lower(dashed), F.lit("-")), F.lit("")), F.lit("index"))


# --- decoding ---------------------------------------------------------------

SNIFFED = 8192  # fixed value: bytes that are looked at for a NUL


def looks_binary(raw) -> Column:
    """A NUL byte among the first 8192 bytes."""
    return F.contains(F.substring(_col(raw), 1, SNIFFED), F.lit(b"\x00"))


def _windows_1252() -> tuple[str, str]:
    """Latin-1's control characters that windows-1252 uses for text, and that text."""
    pairs = []
    for byte in range(0x80, 0xA0):
        try:
            pairs.append((chr(byte), bytes([byte]).decode("cp1252")))
        except UnicodeDecodeError:  # not assigned: stays the control character
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


WINDOWS_1252 = _windows_1252()


def _utf16_units(raw: Column, big_endian: bool) -> Column:
    """The two-byte units as four hex digits and a blank each."""
    order = "$1$2 " if big_endian else "$2$1 "
    return F.regexp_replace(F.hex(raw), "(..)(..)", order)


def decode_text(raw) -> Column:
    """Bytes to text without ever failing: byte-order marks first, then UTF-8
    where the bytes are valid UTF-8, else windows-1252, which accepts any byte
    (those that it leaves open are control characters, as in Latin-1).

    Spark's ``decode`` raises on malformed input, so each branch is guarded."""
    raw = _col(raw)
    body8 = F.substring(raw, 4, 2147483647).cast("string")
    be, le = (F.startswith(raw, F.lit(mark)) for mark in (b"\xfe\xff", b"\xff\xfe"))
    lone_surrogate = r"D[89AB].. (?!D[C-F])|(?<!D[89AB].. )D[C-F].. "
    whole_units = F.octet_length(raw) % 2 == 0
    return (
        F.when(F.startswith(raw, F.lit(b"\xef\xbb\xbf")) & F.is_valid_utf8(body8), body8)
        .when(be & whole_units & ~_utf16_units(raw, True).rlike(lone_surrogate),
              F.decode(raw, "UTF-16"))
        .when(le & whole_units & ~_utf16_units(raw, False).rlike(lone_surrogate),
              F.decode(raw, "UTF-16"))
        .when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        .otherwise(F.translate(F.decode(raw, "ISO-8859-1"), *WINDOWS_1252))
    )


# --- patterns ---------------------------------------------------------------

def glob_to_regex(glob: str) -> str:
    """``*`` is any run of characters, ``?`` exactly one, all else literal."""
    parts = re.split(r"([*?])", glob)  # literal text and wildcards in turn
    return "".join(re.escape(p) if i % 2 == 0 else ".*" if p == "*" else "." for i, p in enumerate(parts))


def glob_pattern(glob) -> Column:
    """``glob_to_regex`` of a column of patterns."""
    escaped = F.regexp_replace(_col(glob), r"([^\p{L}\p{N}*?])", r"\\$1")
    return F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))


def fuzzy_distance(digits: str) -> int:
    """Edit distance written after a word: 1 when absent or over 255, at most 2."""
    n = int(digits) if digits else 1
    return 1 if n > 255 else min(max(n, 1), 2)


def whole_token(pattern: str) -> str:
    """Anchor a pattern to the whole token."""
    return rf"\A(?:{pattern})\z"


GRAM = 3


def grams_of(term) -> Column:
    """The different runs of three characters in a term."""
    t = _col(term)
    starts = F.when(F.char_length(t) >= GRAM, F.sequence(F.lit(1), F.greatest(F.char_length(t) - (GRAM - 1), F.lit(1))))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(GRAM))))


def literal_runs(pattern: str) -> list[str]:
    """Strings that every match of a regular expression holds: its letters and
    digits outside of groups and sets, as far as none may be left out. With an
    alternative outside of groups there are none, and none are looked for beside
    flags, sets in sets and characters given by number."""
    if re.search(r"\(\?[^:]|\[[^\]]*\[|\\[^dwsp\W]", pattern):
        return []
    runs, run, depth, i = [], "", 0, 0

    def ends():
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c, after = pattern[i], pattern[i + 1:i + 2]
        if c == "\\":
            ends()
            i += 2
            continue
        if c == "[":
            ends()
            close = pattern.find("]", i + (3 if after == "^" else 2))
            i = close + 1 if close > 0 else len(pattern)
            continue
        if c in "()":
            ends()
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return []
        elif c == "{":
            ends()
            close = pattern.find("}", i)
            i = close + 1 if close > 0 else len(pattern)
            continue
        elif depth == 0 and c.isalnum() and after not in ("?", "*", "{"):
            run += c
            if after == "+":
                ends()
        else:
            ends()
        i += 1
    ends()
    return [r for r in runs if r]


def required_gram(runs: list[str]) -> str | None:
    """One run of three characters that a term must hold, from the longest string."""
    best = max(runs, key=len, default="")
    return best[:GRAM] if len(best) >= GRAM else None
