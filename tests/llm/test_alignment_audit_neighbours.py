"""Nearest neighbours, token alignment and the filter audit against brute force, and
on what inputs may hold."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlake.llm import filter_audit, neighbours, packing, queries, token_alignment
from termlake.llm.tokens import ByteLevel

from .test_operators import SCHEMA, WORD, odd_rows

# --- 11 ----------------------------------------------------------------------------

def every_20th():
    return F.col("vec_id") % 20 == 0


def neighbours_of(rows, every, k=20):
    """(query, [(vec_id, score)]) by all inner products, over rows that take part."""
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and all(map(np.isfinite, v)) and any(v):
            usable[i] = v
    ids = sorted(usable)
    vectors = np.array([usable[i] for i in ids], float)
    out = {}
    for i in ids:
        if i % every == 0:
            score = (vectors * np.array(usable[i], float)).sum(axis=1)
            best = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(ids[j], score[j]) for j in best]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = neighbours_of(rows, 20)
    got = found(neighbours.nearest(table, every_20th(), block_vectors=600))  # several blocks
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.95
    score = {q: dict(x) for q, x in neighbours_of(rows, 20, len(rows)).items()}
    assert all(s == pytest.approx(score[q][i], abs=1e-12) for q, x in got.items() for i, s in x)
    assert all(x == sorted(x, key=lambda y: (-y[1], y[0])) for x in got.values())


def test_neighbours_of_copies_ties_and_odd_vectors(spark):
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    common, rows = vec(), []
    for i in range(240):
        rows.append((i, common if i % 3 == 0 else vec()))
    rows += [(300, None), (320, []), (340, [0.0] * 6), (360, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (380, [float("nan")] * 6), (None, vec()),
             (400, [1.0, 2.0]), (420, [float("inf")] + [0.0] * 5), (440, [-0.0] * 5 + [1e-30]), (460, [x * 1e20 for x in vec()]), (3, common)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.withColumn("score", table.vec_id).withColumn("key", table.vec_id).repartition(5)
    plain = [r for r in rows if r[1] is None or len(r[1]) == 6]
    got = found(neighbours.nearest(table, every_20th(), k=20))
    want = neighbours_of(plain, 20)
    assert got.keys() == want.keys()
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert right >= 0.95 * sum(map(len, want.values()))
    for q in (0, 60, 120):  # among copies the order is by id
        assert [i for i, _ in got[q]][:20] == [i for i, _ in want[q]][:20]
    assert neighbours.nearest(table.limit(0), every_20th()).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(two, every_20th()).collect()] == [(0, 1, 7, 0.5)]


def test_windows_gain_what_they_would_have_held():
    """Collisions counted by widening equal those of a window opened at once."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(500, 12))
    rows = neighbours.directions(13)
    block = neighbours.Block(vectors, [np.array([i]) for i in range(500)], rows, len(rows) + 1)
    lifted = np.concatenate([vectors / block.scale, np.sqrt(np.maximum(block.norm ** 2 - ((vectors / block.scale) ** 2).sum(axis=1), 0))[:, None]], axis=1)
    centre = rows[:, :-1] @ vectors[3] / block.scale
    for radius in (0.01, 0.3, 1.0, 50.0):
        inside = np.abs(lifted @ rows.T - centre) <= neighbours.WIDTH * radius
        low, high = block._bounds(centre - neighbours.WIDTH * radius, "left"), block._bounds(centre + neighbours.WIDTH * radius, "right")
        counts = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(block.order, low, high)]), minlength=500)
        assert (counts == inside.sum(axis=1)).all()


# --- 12 ----------------------------------------------------------------------------

def aligned_by_hand(text, a, b, coder, pieces):
    """n_a, n_b, groups, pairs and digest, by sets of ends."""
    whole = (" " + (text or "")).encode()
    ids = [coder.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")]
    parts = [[side.bytes[i] for i in x] for side, x in zip((a, b), ids)]
    if not text or any(b"".join(x) != whole for x in parts):
        return 0, 0, 0, collections.Counter(), ""
    ends = [list(itertools.accumulate(map(len, x))) for x in parts]
    at, pairs, groups = [0, 0], collections.Counter(), []
    for cut in sorted(set(ends[0]) & set(ends[1])):
        own = []
        for k in range(2):
            begin = at[k]
            while at[k] < len(ends[k]) and ends[k][at[k]] <= cut:
                at[k] += 1
            own.append(ids[k][begin:at[k]])
        pairs.update(itertools.product(*own))
        groups.append("|".join(",".join(map(str, x)) for x in own))
    return len(ids[0]), len(ids[1]), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    paths = packing.public_tokenizer(), packing.public_tokenizer("piece_bpe_32k.model")
    return paths, *token_alignment.sides(*paths), ByteLevel(paths[0], specials=False).tokenizer, SentencePieceProcessor(model_file=paths[1])


def odd_texts():
    rng = random.Random(6)
    pieces = ["a", "Don't", " ", "  ", "\n", "\n\n", "\t", "é", "12", "...", "　", "<|endoftext|>", "\0", "日本語", "x's", "▁", "<s>", "<0x41>",
              "😀", "́", " the", "ing", "\x1c", "\x85", "​", "\r\n"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)]


def check_alignment(df, both):
    paths, *tools = both
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    by_hand = [aligned_by_hand(t, *tools) for _, t in rows]
    count = collections.Counter(p for x in by_hand for p in x[3])
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = [(str(d), x[0], x[1], x[2], sum(x[3].values()), sum(n for p, n in x[3].items() if count[p] == most[p[0]]),
             sum(n * count[p] for p, n in x[3].items()), x[4]) for (d, _), x in zip(rows, by_hand)]
    out = token_alignment.alignment(df, *paths).collect()
    assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(want)
    return out


def test_alignment_against_sets_of_ends(spark, sf_dir, both, monkeypatch):
    monkeypatch.setattr(token_alignment, "WIDE_GROUP", 6)
    monkeypatch.setattr(token_alignment, "GATHER_PAIRS", 500)
    texts = odd_texts() + ["日本語のテキスト、" * 40, "word " * 3000]
    check_alignment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), both)


def test_alignment_of_documents_and_odd_rows(spark, sf_dir, both):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert any(r.n_best < r.n_links for r in check_alignment(docs, both))
    odd = spark.createDataFrame(odd_rows(), SCHEMA).withColumnsRenamed({"lang": "row", "source": "bucket"}).repartition(3)
    out = check_alignment(odd, both)
    assert {tuple(r)[1:] for r in out if r.doc_id == 3} == {(0, 0, 0, 0, 0, 0, "")}
    assert token_alignment.alignment(odd.limit(0), *both[0]).collect() == []


def test_order_by_several_keys_with_and_without_room():
    rng = np.random.default_rng(7)
    for high in (3, 1 << 15, 1 << 31):
        keys = rng.integers(0, 4, 500), rng.integers(0, high, 500), rng.integers(0, high, 500), np.arange(500)
        assert token_alignment.order_of(*keys).tolist() == np.lexsort(keys[::-1]).tolist()
    assert token_alignment.order_of(keys[0][:0], keys[1][:0]).tolist() == []


def test_new_parts_are_encoded_in_one_call(both):
    pieces, texts = token_alignment.Pieces(both[0][1]), odd_texts() + ["a b\nc", "", "\n \n"]
    real, calls = pieces.model, []

    class Counted:
        def encode(self, text, **kw):
            calls.append(text)
            return real.encode(text, **kw)

    pieces.model = Counted()
    got = pieces.encode(texts)
    assert pieces.apart and [np.frombuffer(x, np.uint32).tolist() for x in got] == [real.encode(x) for x in texts]
    parts = [x for x in calls if isinstance(x, list)]
    assert len(parts) == 1 and len(calls) == 1 + sum("▁" in x or not x for x in texts)
    pieces.memory.old, calls[:] = dict(pieces.memory), []
    pieces.memory.clear()
    assert pieces.encode(texts) == got and [x for x in calls if isinstance(x, list)] == [[]]


def test_galloping_finds_what_is_there():
    rng = np.random.default_rng(4)
    for _ in range(200):
        long = np.unique(rng.integers(0, 300, rng.integers(0, 80)))
        short = np.unique(rng.integers(0, 300, rng.integers(0, 40)))
        got = token_alignment.gallop(short, long, rng.integers(-5, 90, len(short)))
        place = {v: i for i, v in enumerate(long.tolist())}
        assert got.tolist() == [place.get(v, -1) for v in short.tolist()]


def test_ids_of_parts_are_ids_of_texts(both):
    _, a, b, coder, pieces = both
    texts = odd_texts()
    for side, lead, want in ((a, " ", lambda t: coder.encode(" " + t, add_special_tokens=False).ids), (b, "", pieces.encode)):
        got = side.encode([lead + t for t in texts])
        assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [want(t) for t in texts]


# --- 13 ----------------------------------------------------------------------------

def audit_by_hand(rows, labels):
    first, mark = {}, collections.defaultdict(set)
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, quality, toxic in labels:
        mark[d] |= {name for name, value in (("good", quality), ("toxic", toxic)) if value == 1}
    docs = collections.defaultdict(list)
    for d, t, lang, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        least = first.get(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": least is not None and (d is None or least < d)}
        docs[lang or ""].append((fails, mark[d] if d is not None else set()))
    out = {}
    for part, own in docs.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, name in enumerate(order):
                removed = [x for x in left if x[0][name]]
                left = [x for x in left if not x[0][name]]
                shapley[name] += len(removed)
                fails = [x for x in own if x[0][name]]
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(fails) - len(removed),
                                                    sum(sum(x[0].values()) == 1 for x in fails),
                                                    sum("good" in x[1] for x in removed), sum("toxic" in x[1] for x in removed), name]
        for key, value in out.items():
            if key[0] == part:
                value[6] = shapley[value[6]]
    return out


def check_audit(docs, labels):
    want = audit_by_hand([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()],
                         [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    out = filter_audit.filter_audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in out} == want and len(out) == len(want)


def test_audit_by_removing(spark, sf_dir):
    check_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_audit_of_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = odd_rows() + [(20, long, "en", None, 1), (21, long, "de", None, 1), (21, long, "de", None, 1), (None, long, "en", None, 1),
                         (None, "never seen", "en", None, 1), (None, "never seen", "en", None, 1), (22, long + " #A", "", None, 1), (19, "AB", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"source": "digest", "n_chars": "mask"}).repartition(3)
    labels = spark.createDataFrame([(20, 1, 0), (21, 0, 1), (21, 1, None), (None, 1, 1), (1, None, 1), (99, 1, 1), (22, 1, 1), (22, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    check_audit(docs, labels)
    check_audit(docs, labels.limit(0))
    assert filter_audit.filter_audit(docs.limit(0), labels).collect() == []


def test_swaps_go_through_all_orders():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in filter_audit.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == len(filter_audit.adjacent_swaps(n)) + 1


def test_swapped_diagrams_equal_built_ones():
    rng = random.Random(9)
    masks = {m: (rng.randint(0, 2), 0, 0) for m in range(32)}
    diagram = filter_audit.Diagram("ABCDE", masks)
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
        at = {name: k for k, name in enumerate(diagram.order)}
        moved = {sum(1 << at["ABCDE"[b]] for b in range(5) if m >> b & 1): w for m, w in masks.items()}
        fresh = filter_audit.Diagram("".join(diagram.order), moved)
        assert diagram.steps() == fresh.steps()
        assert [len(x) for x in diagram.levels] == [len(x) for x in fresh.levels]  # as reduced as a new one


def test_new_queries_cover_their_tables(spark, sf_dir):
    assert queries.op13_filter_audit(spark, sf_dir).count() % 600 == 0
    assert queries.op12_token_alignment(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
