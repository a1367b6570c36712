"""Main text of web pages by boosted trees over the nodes of the page.

Every element gets features of its subtree (text, links, density, sentence marks),
of its place (depth, order, share of the page before it), of its siblings, of its
tag and of the words in its class, id and role, with those of its ancestors. Boosted
trees give each element a probability of lying in the main text. Decoding picks
the most probable labels that agree with the tree: an element is before, in or out
of the main text; below "in" there is "in" or "out", below "out" only "out". So no
element is kept inside a dropped one, and what is dropped inside a kept one is
dropped with all that it holds.

The model is trained here, on a bounded sample: ``sample_pages`` pages with the
lowest hash of their html. Pages with one <article> or <main> say what their main
text is. Their paragraphs, put into ``LAYOUTS`` others with the containers renamed
and with menus, notices, forms, sharing bars and reader comments around and inside
the main text, are further examples, so that the trees do not hang on one tag.

Null and empty pages have no text. Rows are judged one by one, so repeated rows
agree. Without a page that says what its main text is, layouts around all its
paragraphs are the only examples; without any text nothing is kept. An empty table
gives an empty result."""

from __future__ import annotations

import html
import random
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .dom import Page, lines, parse

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_PAGES, LAYOUTS = 150, 3
#: Pages whose elements are put to the trees together.
BATCH_PAGES = 64

#: Words in names of elements, by what they usually hold.
NAMED = {
    "content": ("article", "content", "post", "entry", "main", "story", "body", "text"),
    "menu": ("nav", "menu", "breadcrumb", "toc", "pager", "pagination", "tabs"),
    "header": ("header", "masthead", "top", "banner", "logo"),
    "footer": ("footer", "bottom", "copyright", "legal", "colophon"),
    "side": ("sidebar", "aside", "side", "widget", "rail", "related", "recommended"),
    "advert": ("ad", "ads", "advert", "advertisement", "promo", "sponsor", "sponsored"),
    "notice": ("notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "newsletter", "subscribe"),
    "comment": ("comment", "comments", "reply", "replies", "discussion", "disqus", "responses"),
    "form": ("form", "login", "search", "signup"),
    "share": ("share", "social", "follow", "tags"),
}
TAGS = (("article", "main"), ("section",), ("div",), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"),
        ("ul", "ol", "dl"), ("li", "dt", "dd"), ("a",), ("nav", "menu"), ("header",), ("footer",), ("aside", "dialog"),
        ("form", "button", "input", "select", "label", "option", "fieldset"), ("table", "tr", "td", "th", "tbody"),
        ("script", "style", "noscript", "iframe", "svg", "template", "textarea"), ("head", "title", "meta", "link"),
        ("figure", "figcaption", "img"), ("body", "html", "#root"))
_TAG = {t: k for k, group in enumerate(TAGS) for t in group}
_NAME = {w: k for k, words in enumerate(NAMED.values()) for w in words}
_OTHER = [k for k, name in enumerate(NAMED) if name not in ("content", "header")]
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.!?,;:]")


def _named(attributes: dict[str, str]) -> list[int]:
    text = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
    return [k for w in _WORDS.findall(text) if (k := _NAME.get(w.lower())) is not None]


def features(page: Page) -> np.ndarray:
    """A row for each element of the page."""
    n, kinds, names = len(page.nodes), len(TAGS), len(NAMED)
    parent = np.array([x.parent for x in page.nodes])
    tag = np.array([_TAG.get(x.tag, kinds) for x in page.nodes])
    own, marks, before = np.zeros(n), np.zeros(n), np.zeros(n)
    total, seen = 0, np.zeros(n, bool)
    for node, _, piece in page.runs:
        if not seen[node]:
            seen[node], before[node] = True, total
        own[node] += len(piece)
        marks[node] += len(_MARKS.findall(piece))
        total += len(piece)
    named, above = np.zeros((n, names)), np.zeros((n, names + kinds + 1))
    for i, x in enumerate(page.nodes):
        if x.attributes:
            named[i, _named(x.attributes)] = 1
        if i:
            above[i] = above[x.parent]
            above[i, :names] = np.maximum(above[i, :names], named[x.parent])
            above[i, names + tag[x.parent]] = 1
    text, links, dots, nodes, paragraphs = own.copy(), np.where(tag == _TAG["a"], own, 0.0), marks.copy(), np.ones(n), (tag == _TAG["p"]) * 1.0
    children, order = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        order[i] = children[parent[i]]
        children[parent[i]] += 1
    for i in range(n - 1, 0, -1):  # children stand after their parent
        if tag[i] == _TAG["a"]:
            links[i] = text[i]
        for v in (text, links, dots, nodes, paragraphs):
            v[parent[i]] += v[i]
        if seen[i] and (not seen[parent[i]] or before[i] < before[parent[i]]):
            before[parent[i]], seen[parent[i]] = before[i], True
    up = np.maximum(parent, 0)
    whole = max(total, 1)
    columns = [np.array([x.depth for x in page.nodes]), order, children, children[up], text, own, text / nodes,
               links / np.maximum(text, 1), dots / np.maximum(text, 1), text / whole, before / whole, nodes, paragraphs,
               paragraphs[up], text[up], links[up] / np.maximum(text[up], 1), text / np.maximum(text[up], 1),
               dots / np.maximum(nodes, 1)]
    one_hot = np.zeros((n, kinds + 1))
    one_hot[np.arange(n), tag] = 1
    return np.concatenate([np.stack(columns, axis=1), one_hot, named, above], axis=1).astype(np.float32)


# --- decoding -------------------------------------------------------------------

BEFORE, IN, OUT = range(3)


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The labelling with the highest likelihood among those that agree."""
    parent = [x.parent for x in page.nodes]
    yes, no = (-np.logaddexp(0, -margin)).tolist(), (-np.logaddexp(0, margin)).tolist()
    n = len(parent)
    inside, outside, ahead = list(yes), list(no), list(no)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        outside[p] += outside[i]
        inside[p] += max(inside[i], outside[i])
        ahead[p] += max(ahead[i], inside[i], outside[i])
    state = [BEFORE] * n
    for i in range(1, n):
        s = state[parent[i]]
        if s == OUT:
            state[i] = OUT
        elif s == IN:
            state[i] = IN if inside[i] > outside[i] else OUT
        else:
            state[i] = IN if inside[i] > max(ahead[i], outside[i]) else BEFORE if ahead[i] > outside[i] else OUT
    return [s == IN for s in state]


# --- training ---------------------------------------------------------------------

def _below(page: Page, wanted) -> np.ndarray:
    flag = np.zeros(len(page.nodes), bool)
    for i, x in enumerate(page.nodes):
        flag[i] = wanted(x) or (i > 0 and flag[x.parent])
    return flag


def _boxed(node) -> bool:
    """A container whose names say that it holds something else than main text."""
    return node.tag in ("div", "section", "ul") and any(k in _OTHER for k in _named(node.attributes)) and not any(
        k == 0 for k in _named(node.attributes))


def own_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that has one <article>, or else one <main>, with some text."""
    for tag in ("article", "main"):
        if sum(x.tag == tag for x in page.nodes) == 1:
            drop = _below(page, lambda x: x.tag in ("nav", "aside", "footer", "form", "script", "style", "button") or _boxed(x))
            label = _below(page, lambda x, tag=tag: x.tag == tag) & ~drop
            if any(label[node] for node, _, _ in page.runs):
                return label
    return None


def layout(rng: random.Random, title: str, paragraphs: list[str], others: list[str]) -> str:
    """A page around ``paragraphs``; ``data-in`` and ``data-out`` mark its parts."""
    say = lambda: html.escape(rng.choice(others)[:rng.choice((30, 80, 200, 600))])
    part = lambda kind: rng.choice(NAMED[kind])

    def box(kind: str, inner: str, *tags: str) -> str:
        tag = rng.choice(tags)
        name = "" if tag not in ("div", "section", "ul", "p") and rng.random() < 0.6 else f' {rng.choice(("class", "id"))}="{rng.choice(("", "site-", "page-", "x-"))}{part(kind)}"'
        return f"<{tag}{name} data-out='1'>{inner}</{tag}>"

    menu = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{say()[:25]}</a></li>' for k in range(rng.randint(3, 12))) + "</ul>"
    remark = lambda: "".join(f"<div><b>{say()[:15]}</b><p>{say()}</p></div>" for _ in range(rng.randint(1, 5)))
    small = [lambda: box("advert", say(), "div", "aside", "p"), lambda: box("share", menu(), "div", "ul"),
             lambda: box("notice", f"<p>{say()}</p>", "div", "section", "aside"),
             lambda: box("form", f"<label>{say()[:40]}</label><input><button>ok</button>", "form"),
             lambda: box("side", f"<h3>{say()[:30]}</h3>{menu()}", "aside", "div")]
    inner = [f"<p>{html.escape(x)}</p>" for x in paragraphs]
    for _ in range(rng.choice((0, 0, 1, 2))):
        inner.insert(rng.randint(0, len(inner)), rng.choice(small)())
    comments = box("comment", remark(), "section", "div", "aside") if rng.random() < 0.6 else ""
    inside = rng.random() < 0.5
    tag = rng.choice(("article", "main", "div", "div", "section"))
    name = f' {rng.choice(("class", "id"))}="{part("content")}"' if tag in ("div", "section") else ""
    main = f"<{tag}{name} data-in='1'><h1>{html.escape(title)}</h1>{''.join(inner)}{comments * inside}</{tag}>{comments * (not inside)}"
    head = [box("header", f"<b>{say()[:30]}</b>", "header", "div"), box("menu", menu(), "nav", "div", "ul")]
    tail = [box("footer", f"&copy; {say()}", "footer", "div")]
    for _ in range(rng.randint(0, 3)):
        rng.choice((head, tail)).append(rng.choice(small)())
    rng.shuffle(head)
    wrapped = "".join(head) + main + "".join(tail[::-1])
    for _ in range(rng.choice((0, 0, 1, 2))):
        wrapped = f"<div>{wrapped}</div>"
    return f"<html><head><title>{html.escape(title)}</title></head><body>{wrapped}</body></html>"


def train(sources: list[str], layouts: int = LAYOUTS) -> trees.Trees | None:
    """The model of a sample of pages; None if they hold no text."""
    pages = [p for p in map(parse, sources) if p.runs]
    texts = [lines(p, [True] * len(p.nodes)) for p in pages]
    others = [x for t in texts for x in t]
    if not others:
        return None
    rng, rows, labels = random.Random(7), [], []
    for page, all_lines in zip(pages, texts, strict=True):
        label = own_labels(page)
        if label is not None:
            rows.append(features(page))
            labels.append(label)
        own = lines(page, label.tolist()) if label is not None else [x for x in all_lines if len(x) > 80] or all_lines
        for _ in range(layouts):
            made = parse(layout(rng, own[0][:80], own[rng.choice((0, 1)):] or own, others))
            rows.append(features(made))
            labels.append(_marked(made))
    return trees.fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def _marked(page: Page) -> np.ndarray:
    return _below(page, lambda x: "data-in" in x.attributes) & ~_below(page, lambda x: "data-out" in x.attributes)


# --- the operator -----------------------------------------------------------------

def extract(sources: list[str | None], model: trees.Trees | None) -> list[str]:
    pages = [parse(x) for x in sources]
    if model is None or not pages:
        return [""] * len(pages)
    rows = [features(p) for p in pages]
    margin, at, out = model.margin(np.concatenate(rows)), 0, []
    for page, own in zip(pages, rows, strict=True):
        out.append("\n".join(lines(page, decode(page, margin[at:at + len(own)]))))
        at += len(own)
    return out


def sample(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, html_col: str = "html") -> list[str]:
    """At most ``sample_pages`` different pages, those with the lowest hash. Different
    pages are counted, so that only about as many as are wanted leave their tasks,
    each once however often it occurs; if the count misled, all of them are ordered."""
    source = F.col(f"`{html_col}`").cast("string")
    rows = pages.select(source.alias("html"), F.shiftrightunsigned(F.xxhash64(source), 1).alias("h")).filter("html is not null")
    different = rows.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    share = min(1.0, (3.0 * sample_pages + 64) / max(1, different))
    few = lambda some: (some.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(sample_pages).collect())
    found = few(rows.filter(F.col("h") <= min(int(share * (1 << 63)), (1 << 63) - 1)))
    if share < 1 and len(found) < sample_pages:
        found = few(rows)
    return [r["html"] for r in found]


def main_text(pages: DataFrame, model: trees.Trees | None = None, html_col: str = "html",
              sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``pages`` with ``text`` in place of the html column, and ``n_chars``. Without a
    ``model`` one is trained on a sample of ``pages``."""
    model = model or train(sample(pages, sample_pages, html_col))
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    inner = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                         F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(at, BATCH_PAGES)
                text = extract(part.column(part.num_columns - 1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                    names=[*part.schema.names[:-1], "text", "n_chars"])

    out = inner.mapInArrow(run, inner.drop("html").schema.add("text", "string").add("n_chars", "long"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
