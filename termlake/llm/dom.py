"""A page as a tree: tolerant of unclosed and crossed tags, comments, raw text
elements and cut-off ends. Only what extraction needs is kept."""

from __future__ import annotations

import html
import re
import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select "
                  "summary table tbody td tfoot th thead title tr ul".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
#: Elements that such an end does not reach beyond.
WALLS = frozenset("ul ol dl table body html article section div".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACES = re.compile(r"[\x20\x09-\x0D\xa0]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Page:
    nodes: list[Node]
    #: (node, block, text): runs of text in page order; runs of a block are one line.
    runs: list[tuple[int, int, str]]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if "=" in text else {}


def parse(source: str | None) -> Page:
    nodes, runs = [Node("#root", -1, 0)], []
    stack, block, at, source = [0], 0, 0, source or ""

    def text(upto: int) -> None:
        if upto > at and (piece := source[at:upto]).strip():
            runs.append((stack[-1], block, piece))
        elif upto > at and runs and runs[-1][1] == block:
            runs.append((stack[-1], block, " "))

    def open_at(tags) -> int:
        return next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag in tags), 0)

    while at < len(source):
        m = _MARKUP.search(source, at)
        if m is None:
            text(len(source))
            break
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            block += 1
        if m[1]:
            if k := open_at((tag,)):
                del stack[k:]
            continue
        if tag in BLOCK and (k := open_at(("p", *WALLS))) and nodes[stack[k]].tag == "p":
            del stack[k:]
        if tag in ENDS and (k := open_at((*ENDS[tag], *(WALLS - {tag})))) and nodes[stack[k]].tag in ENDS[tag]:
            del stack[k:]
        if tag == "br" and runs and runs[-1][1] == block:
            runs.append((stack[-1], block, " "))
        nodes.append(Node(tag, stack[-1], len(stack), _attributes(m[3])))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
            close = source.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(len(nodes) - 1)
    return Page(nodes, runs)


def lines(page: Page, keep: list[bool]) -> list[str]:
    """The kept text, a line for each block: references decoded, white space one space."""
    out, parts, current = [], [], None
    for node, block, piece in [*page.runs, (0, None, "")]:
        if block != current:
            line = _SPACES.sub(" ", html.unescape("".join(parts))).strip(" ")
            if line:
                out.append(line)
            parts, current = [], block
        if keep[node]:
            parts.append(piece)
    return out
