"""Conditions a user combines into a search.

    all_of(term("invoice"), wildcard("2025*"), exclude(phrase("first draft")))
    any_of(all_of(term("a"), term("b")), fuzzy("paymnet"))

A search is an OR of AND-groups of required or excluded conditions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import fuzzy_distance, query_tokens
from ..schema import TEXT_FIELDS, VERBATIM_FIELDS


@dataclass(frozen=True)
class Leaf:
    """One condition. ``kind`` is words, pattern, fuzzy, equal or all."""
    kind: str
    text: str = ""
    words: tuple[tuple[int, str], ...] = ()
    fields: tuple[str, ...] = ("content",)
    bound: int = 0  # slop of words, distance of fuzzy

    @property
    def is_term(self) -> bool:
        return self.kind == "words" and len(self.words) == 1

    @property
    def is_near(self) -> bool:
        return self.kind == "words" and len(self.words) > 1 and self.bound > 0


@dataclass(frozen=True)
class Exclude:
    leaf: Leaf


@dataclass(frozen=True)
class AllOf:
    parts: tuple[Leaf | Exclude, ...]


@dataclass(frozen=True)
class AnyOf:
    groups: tuple[AllOf | Leaf | Exclude, ...]


Condition = Leaf | Exclude | AllOf | AnyOf


def _words(text: str, slop: int, fields: tuple[str, ...]) -> Leaf:
    return Leaf("words", text, tuple(query_tokens(text)), fields, slop)


def term(word: str) -> Leaf:
    """A plain word, in content or filename. A word that holds several tokens is
    their exact phrase; one that holds none matches nothing."""
    return _words(word, 0, TEXT_FIELDS)


def phrase(text: str) -> Leaf:
    """The tokens of ``text`` next to each other and in this order."""
    if not text.strip():
        raise ValueError("empty phrase")
    return _words(text, 0, TEXT_FIELDS)


def near(text: str, slop: int) -> Leaf:
    """The tokens of ``text`` close together: moving them into the order of
    ``text`` costs at most ``slop`` steps, so a swapped pair costs 2."""
    if slop < 0:
        raise ValueError("slop must not be negative")
    if not text.strip():
        raise ValueError("empty phrase")
    return _words(text, slop, TEXT_FIELDS)


def wildcard(glob: str) -> Leaf:
    """``*`` any run, ``?`` one character, against whole content tokens."""
    if not glob:
        raise ValueError("empty wildcard")
    return Leaf("glob", glob.lower())


# Constructs a token pattern cannot use: it always matches a whole token, from
# left to right, without looking around or back.
UNSUPPORTED = r"\(\?(?:[=!>]|<[=!])|\\[1-9kbBAzZG]"
#: Escapes and sets, outside of which an anchor is bare.
BRACKETS, BARE_ANCHORS = r"\\.|\[\^?\]?[^\]]*\]", r"[\^$]"


def regex(pattern: str) -> Leaf:
    r"""A regular expression against whole content tokens. The pattern is
    lower-cased like the tokens, so ``\W`` means ``\w``."""
    pattern = pattern.lower()
    bare = re.sub(r"\\\\", "", pattern)
    outside_sets = re.sub(BRACKETS, "", bare)
    if re.search(UNSUPPORTED, bare) or re.search(BARE_ANCHORS, outside_sets):
        raise ValueError(f"unsupported construct in pattern {pattern!r}")
    return Leaf("regex", pattern)


def fuzzy(word: str, distance: int | str = 1) -> Leaf:
    """Content tokens within 1 or 2 edits; swapping neighbours is one edit."""
    if not word:
        raise ValueError("empty word")
    return Leaf("fuzzy", word.lower(), bound=fuzzy_distance(str(distance)))


def match_all() -> Leaf:
    return Leaf("all")


def match_field(field: str, value: str) -> Leaf:
    """A word in one field: equality on ext and path, tokens elsewhere."""
    if field in VERBATIM_FIELDS:
        return Leaf("equal", value, fields=(field,))
    if field in TEXT_FIELDS:
        return _words(value, 0, (field,))
    raise ValueError(f"no searchable field named {field!r}")


def match_path(path: str) -> Leaf:
    return match_field("path", path)


def exclude(leaf: Leaf) -> Exclude:
    if not isinstance(leaf, Leaf):
        raise ValueError("only a single condition can be excluded")
    return Exclude(leaf)


def all_of(*parts: Leaf | Exclude) -> AllOf:
    for p in parts:
        if not isinstance(p, (Leaf, Exclude)):
            raise ValueError("all_of takes single conditions and exclusions")
    return AllOf(tuple(parts))


def any_of(*groups: AllOf | Leaf | Exclude) -> AnyOf:
    for g in groups:
        if not isinstance(g, (AllOf, Leaf, Exclude)):
            raise ValueError("any_of takes groups or single conditions")
    return AnyOf(tuple(groups))


Group = list[tuple[Leaf, bool]]


def groups_of(condition: Condition) -> list[Group]:
    """OR-groups of (condition, required). Empty groups drop out; a group of
    exclusions only is given every document to subtract from."""
    parts = condition.groups if isinstance(condition, AnyOf) else (condition,)
    groups: list[Group] = []
    for part in parts:
        members = part.parts if isinstance(part, AllOf) else (part,)
        group = [(m.leaf, False) if isinstance(m, Exclude) else (m, True) for m in members]
        if not group:
            continue
        if not any(required for _, required in group):
            group.insert(0, (match_all(), True))
        groups.append(group)
    if not groups:
        raise ValueError("empty query")
    return groups


def leaves_of(groups: list[Group]) -> list[Leaf]:
    """Distinct conditions in order of first use."""
    return list(dict.fromkeys(leaf for g in groups for leaf, _ in g))
