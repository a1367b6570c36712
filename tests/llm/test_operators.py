"""Each operator against a brute-force version, on small fixtures and on whole
tables of the smallest size, and on what inputs may hold: nulls, empty and long
texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termlake.llm import (common, components, dom, exact_dedup, html_extract, langid, license_scan, lm_score, mixing,
                          packing, quality, queries, simhash, substring_dedup, trees)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


def odd_rows(rng=random.Random(5)):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, long = say(40), say(30_000)
    return [(1, a, "en", "s1", 1), (2, a, "en", "s1", 1), (2, a, "en", "s1", 1), (3, None, None, None, None),
            (None, a + " more", "de", None, 3), (None, None, None, "s2", None), (4, "", "en", "s2", 0), (5, " \t\n ", "en", "s2", 4),
            (6, long, "fr", "s1", 9), (7, long + " x", "fr", "s3", 9), (8, "1234 5678", "es", "s3", 9), (9, "ab", None, "s3", 2),
            (2, a.replace(" ", "  "), "en", "s1", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---------------------------------------------------------------------------

def test_language_id_held_out(spark, sf_dir, docs):
    out = queries.op1_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == docs.count() and len(held)
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(out.doc_id, out.held_out))


def test_language_scores_equal_kernels():
    rng = np.random.default_rng(1)
    present = (rng.random((12, langid.SLOTS)) < 0.01).astype(np.uint8)
    model = langid.fit(["a", "b"], np.array([0, 1] * 6), np.packbits(present, axis=1), landmarks=3)
    kernel = np.array([[(x & y).sum() / math.sqrt(x.sum() * y.sum()) for y in model.landmarks] for x in present])
    assert np.allclose(langid.scores(present, model.folded()), kernel @ model.weights, atol=1e-4)
    many = langid.fit([f"l{k}" for k in range(12)], np.arange(12), np.packbits(present, axis=1), all_landmarks=5)
    kernel = np.array([[(x & y).sum() / math.sqrt(x.sum() * y.sum()) for y in many.landmarks] for x in present])
    assert len(many.landmarks) == 5 and len(many.folded()) == 2
    assert np.allclose(langid.scores(present, many.folded()), kernel @ many.weights, atol=1e-4)


def test_classifier_is_ridge_regression_in_the_landmarks_space():
    """With every row a landmark, scores are those of kernel ridge regression."""
    rng = np.random.default_rng(2)
    present = (rng.random((10, langid.SLOTS)) < 0.01).astype(np.uint8)
    labels = np.array([0, 1] * 5)
    model = langid.fit(["a", "b"], labels, np.packbits(present, axis=1), landmarks=9, ridge=0.5)
    sizes = np.sqrt(present.sum(axis=1))
    kernel = (present.astype(float) @ present.T) / sizes[:, None] / sizes
    target = np.where(labels[:, None] == [0, 1], 1.0, -1.0)
    dual = np.linalg.solve(kernel + 0.5 * 2 / 10 * 5 * np.eye(10), target)  # each row weighs 1/5
    assert np.allclose(langid.scores(present, model.folded()), kernel @ dual, atol=1e-4)


def test_samples_survive_repeated_rows(spark):
    rng = random.Random(1)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    for different in (1, 3):
        texts = [(f"l{k}", say("abcd"[k:k + 2])) for k in range(different)]
        rows = [(i, text, lang) for i, (lang, text) in enumerate(texts * (3000 // different))]
        model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7))
        assert model.languages == [x for x, _ in texts]
        pages = [f"<html><body><nav>menu</nav><article><p>{say('abc')}.</p><p>{say('abc')}.</p></article></body></html>" for _ in range(different)]
        table = spark.createDataFrame([(i, x) for i, x in enumerate(pages * (3000 // different))], "page_id long, html string")
        assert sorted(html_extract.sample(table)) == sorted(pages)
        assert all(r.text and "menu" not in r.text for r in html_extract.main_text(table).limit(50).collect())
    varied = [(i, say("abcdef"), "varied") for i in range(900)] + [(1000 + i, "xyz zyx xzy " * 9, "same") for i in range(3000)]
    docs = spark.createDataFrame(varied, "doc_id long, text string, lang string").repartition(5)
    model = langid.train(docs)
    assert model.languages == ["same", "varied"]
    right = langid.predict(docs, model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99
    odd = langid.train(docs, all_rows=2)
    assert odd.languages == ["same", "varied"] and len(odd.landmarks) == 2


def test_trees_fit_what_they_are_given():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(1500, 5)).astype(np.float32)
    label = (rows[:, 1] > 0.3) ^ (rows[:, 3] < -0.2)
    model = trees.fit(rows[:1000], label[:1000].astype(float))
    assert ((model.margin(rows[1000:]) > 0) == label[1000:]).mean() > 0.95


def test_language_id_odd_rows(docs, odd, none):
    model = langid.train(docs)
    out = {(r.doc_id, r.text): r for r in langid.predict(odd.withColumn("score", F.lit("own")), model).collect()}
    assert len(langid.predict(odd, model).collect()) == len(odd_rows())
    for text in (None, "", " \t\n ", "1234 5678"):
        assert all(r.lang_pred == "und" and r.score == 0 for (_, t), r in out.items() if t == text)
    assert langid.predict(none, model).count() == 0 and langid.train(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


# --- 2 -----------------------------------------------------------------------------

def test_main_text_of_layouts(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    model = html_extract.train(pages[:25])
    texts = [dom.lines(p, html_extract.own_labels(p).tolist()) for p in map(dom.parse, pages)]
    got = html_extract.extract(pages[25:], model)
    assert np.mean([g == "\n".join(t) for g, t in zip(got, texts[25:])]) > 0.98
    rng, right = random.Random(3), []
    for own in texts[25:]:
        made = html_extract.layout(rng, own[0], own[1:] or own, [x for t in texts[25:] for x in t])
        page = dom.parse(made)
        right.append(html_extract.extract([made], model)[0] == "\n".join(dom.lines(page, html_extract._marked(page).tolist())))
    assert np.mean(right) > 0.9


def test_decoding_is_the_best_that_agrees():
    rng = np.random.default_rng(2)
    for _ in range(30):
        page = dom.parse("<div>" * 2 + "<p>a</p><ul><li>b<li>c</ul>" + "</div>" + "<p>d")
        n = len(page.nodes)
        margin = rng.normal(0, 3, n)
        margin[0] = -9
        up = [x.parent for x in page.nodes]
        agree = lambda s: s[0] == 0 and all(s[i] in ((0, 1, 2), (1, 2), (2,))[s[up[i]]] for i in range(1, n))
        value = lambda keep: sum(-np.logaddexp(0, -m if k else m) for k, m in zip(keep, margin))
        every = ([k // 3 ** i % 3 for i in range(n)] for k in range(3 ** n))
        best = max(value([x == 1 for x in s]) for s in every if agree(s)) if n <= 8 else None
        if best is not None:
            assert abs(value(html_extract.decode(page, margin)) - best) < 1e-9


def test_parsing_odd_pages():
    every = lambda s: dom.lines(p := dom.parse(s), [True] * len(p.nodes))
    assert every("<p>a &amp; b<p>c\n\n d<b>x</b><!-- <p>no --> f<script>y='</p>'</script>") == ["a & b", "c dx f"]
    assert every("<div>a<br>b</div></p>c<b>d") == ["a b", "cd"]
    assert every(None) == every("") == []
    assert every("<ul><li>x<li>y<ul><li>z</ul></ul>") == ["x", "y", "z"]


def test_named_boxes_are_no_main_text():
    page = dom.parse("<article><p>one two</p><div class='comments'><p>reader</p></div><section id='cookie-notice'>ok</section>"
                     "<div class='story-body'><p>three</p></div></article>")
    assert dom.lines(page, html_extract.own_labels(page).tolist()) == ["one two", "three"]


def test_main_text_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>one"), (1, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    out = html_extract.main_text(pages).collect()
    assert len(out) == 4 and all(r.text == "" and r.n_chars == 0 for r in out if r.page_id is not None)
    assert html_extract.main_text(pages.limit(0)).collect() == []


# --- 3 -------------------------------------------------------------------------------

def base_of(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), failed)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality_counts(request, table):
    source = request.getfixturevalue(table)
    out = quality.quality(source).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                         "base_failed", "kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((r.doc_id, *base_of(r.text)) for r in source.collect()), key=key)
    assert sorted((tuple(r)[:7] for r in out), key=key) == want
    assert not any(r.kept and r.base_failed for r in out)


def test_words_end_where_the_text_does(spark):
    texts = ["a b \x85", "a b \u2028", "\u2029 a b", "a b\n", " \n\x85", "a\x85", "\x85 "]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_words for r in quality.quality(table).orderBy("doc_id").collect()] == [len(WORD.findall(t)) for t in texts]


def test_quality_keeps_good_documents(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.quality(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    share = dict(map(tuple, out.collect()))
    assert share[1] > 0.99 and share.get(0, 0) < 0.2


def test_quality_runs_no_python(docs, none):
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert quality.quality(none).collect() == []


def test_quality_of_a_long_text_is_filtered_in_time(spark):
    words = 60_000
    text = " ".join(f"w{i % 50_000}" for i in range(words))
    out = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).filter("not base_failed").collect()
    assert [(r.n_words, r.n_repeat_words) for r in out] == [(words, 20_000)]


def test_quality_cuts_a_text_into_words_once(docs):
    plan = quality.quality(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # words and lines


@pytest.mark.parametrize("bits", [3, 5, 8, 62])
def test_repeated_words_where_hashes_clash_or_places_do_not_fit(spark, monkeypatch, bits):
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(n)) for n in (*range(12), *range(20, 300, 9))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    out = quality.quality(table).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in out] == [base_of(t)[4] for t in texts]


def test_stop_words_in_capitals(spark):
    row = quality.quality(spark.createDataFrame([(1, "The THE the\tThat nicht NICHT Theatre \u0130n")], "doc_id long, text string")).first()
    assert (row.n_stop_words, row.n_upper, row.n_letters, row.n_lines) == (6, 12, 32, 1)


# --- 4 ---------------------------------------------------------------------------------

def test_scores_against_brute_force(spark, odd):
    rows = odd_rows()[:6] + [(8, "1234 5678", None, None, None), (11, "1234 56x8", None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    grams = lm_score.count_grams(table, F.col("doc_id") == 8)
    text = lambda t: "\x02" * 3 + re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ")
    models = []
    for chosen in (lambda d: True, lambda d: d == 8):
        count = collections.Counter(text(t)[i - n + 1:i + 1] for d, t, *_ in rows if chosen(d)
                                    for i in range(3, len(text(t))) for n in range(1, 5))
        models.append(count)
    v = sum(len(k) == 1 for k in models[0])

    def p(c, k):
        if len(k) == 1:
            return (c[k] + 1) / (sum(n for x, n in c.items() if len(x) == 1) + v)
        after = [n for x, n in c.items() if len(x) == len(k) and x[:-1] == k[:-1]]
        return (c[k] + len(after) * p(c, k[1:])) / (sum(after) + len(after)) if after else p(c, k[1:])

    for most in (10**6, 0):  # broadcast and join
        out = lm_score.cross_entropy_difference(table, grams, most).collect()
        assert len(out) == len(rows)
        for r in out:
            ts = [text(t) for d, t, *_ in rows if d == r.doc_id and max(0, len(text(t)) - 3) == r.n_tokens]
            assert ts
            if r.n_tokens == 0:
                assert r.score is None
            elif len(set(ts)) == 1:
                want = [-sum(math.log2(p(c, ts[0][i - 3:i + 1])) for i in range(3, len(ts[0]))) / r.n_tokens for c in models]
                assert r.background_loss == pytest.approx(want[0]) and r.target_loss == pytest.approx(want[1])


def test_scores_of_an_empty_table(none):
    assert lm_score.cross_entropy_difference(none, lm_score.count_grams(none, F.lit(True))).collect() == []


# --- 5 -----------------------------------------------------------------------------------

def test_packing_is_a_round_trip(docs, odd):
    from tokenizers import Tokenizer
    path = packing.public_tokenizer()
    coder = Tokenizer.from_file(path)
    for table in (docs, odd.select("doc_id", "text").dropDuplicates(["doc_id"])):
        out = packing.pack(table, path).toPandas()
        for doc_id, text in table.select("doc_id", "text").collect():
            ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            own = out[out.doc_id == doc_id if doc_id is not None else out.doc_id.isna()].sort_values("start")
            assert list(own.start) == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids)
            assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
                       for r in own.itertuples())
        by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert (by.length.sum() <= 2048).all()
        assert all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    assert len(packing.pack(odd, path).toPandas().query("start == 0")) == len(odd_rows())


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(40):
        at, window = [0], 64
        while len(at) < 25:
            at.append(at[-1] + rng.randint(1, 40))
        penalty = [rng.choice((0.0, 8.0, 64.0)) for _ in at]
        best = [0.0] + [math.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = at[j] - at[i]
                if n <= window:
                    pad = 0 if n in packing.SHORT_WINDOWS and n < window else window - n
                    best[j] = min(best[j], best[i] + pad + penalty[j] + packing.SEQUENCE)
        cost, back = packing.choose_cuts(at, penalty, window)
        assert cost == pytest.approx(best) and all(at[j] - at[back[j]] <= window for j in range(1, len(at)))


def test_short_windows_are_found_at_once():
    at = [0, 30, 32, 64, 70, 96, 128, 256]
    want = {j: [at.index(p - n) for n in packing.SHORT_WINDOWS if n < 128 and p - n in at] for j, p in enumerate(at)}
    assert packing.short_starts(at, 128) == {j: k for j, k in want.items() if k}


def test_parts_have_the_ids_of_whole_texts():
    path = packing.public_tokenizer()
    coder = packing.Encoder(path)
    pieces = ["a", "Don't", " ", "  ", "\n", "\n\n", "\t", "é", "12", "...", "　", "<|endoftext|>", "\0", "日本", "x's"]
    rng = random.Random(6)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [e.ids for e in coder.tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want


# --- 6 -------------------------------------------------------------------------------------

def test_planted_licenses():
    index, rng = license_scan.Index(license_scan.TEMPLATES), random.Random(8)
    for name, template in license_scan.TEMPLATES.items():
        words = template.split()
        for _ in range(len(words) // 25):
            words[rng.randrange(len(words))] = "changed"
        before = " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(50)))
        text = f"{before} {' '.join(words)} and more"
        (found,) = license_scan.scan_text(text, index)
        assert found[0] == name and found[1] >= 0.8
        assert abs(found[6] - len(before) - 1) <= 30 and abs(found[7] - len(text) + len(" and more")) <= 30


def test_repeated_notices_are_all_found():
    index = license_scan.Index(license_scan.TEMPLATES)
    notice, other = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0"
    for n in (1, 2, 10, 200):
        for between in (" ", " and then some other words here ", f" {other} "):
            text = "İİ " + between.join([notice] * n)
            mine = [f for f in license_scan.scan_text(text, index) if text[f[6]:f[7]].startswith("Released")]
            places = [m.start() for m in re.finditer("Released", text)]
            assert [f[6] for f in mine] == places and all(text[f[6]:f[7]] + "." == notice for f in mine)


def test_banded_alignment_is_exact_in_its_band():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        score = [[0.0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                step = license_scan.MATCH if a[j - 1] == b[i - 1] else license_scan.MISS
                score[i][j] = max(0, score[i - 1][j - 1] + step, score[i - 1][j] + license_scan.GAP, score[i][j - 1] + license_scan.GAP)
        top = max(map(max, score))
        matched, start, end = license_scan.align(a, b, -20, 20)
        assert (matched == 0) == (top == 0) and matched >= top and 0 <= start <= end <= len(a)


def test_license_scan_odd_rows(odd, none):
    assert license_scan.scan_licenses(odd).collect() == [] == license_scan.scan_licenses(none).collect()


# --- 7 ---------------------------------------------------------------------------------------

def removed_of(rows):
    seen, out = set(), {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                covered[i:i + 20] = [True] * 20
            seen.add(window)
        kept = [w for w, c in zip(words, covered) if not c]
        out[doc_id] = (len(words), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring_dedup(spark, docs, plain):
    out = substring_dedup.substring_dedup(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == removed_of(plain)


def test_substring_dedup_of_periodic_and_spliced_texts(spark):
    rng = random.Random(10)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(80)) for _ in range(4)]
    rows = [(i, " ".join(" ".join(rng.choice(base).split()[rng.randint(0, 40):][:rng.randint(10, 60)]) for _ in range(4))) for i in range(60)]
    rows += [(100 + i, " ".join(["x", "y", "z"][:1 + i % 3] * 20)) for i in range(6)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == removed_of(rows)


def test_first_rows_of_keys_that_agree_in_one_part():
    rng = np.random.default_rng(8)
    for n in (1, 2, 50, 400):
        a, b = rng.integers(0, 9, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint32)
        for key, more in ((a, None), (a, b), (a, (a * np.uint64(3)).astype(np.uint32))):
            seen = {}
            for i, k in enumerate(zip(a.tolist(), [0] * n if more is None else more.tolist(), strict=True)):
                seen.setdefault(k, []).append(i)
            first, count = substring_dedup._firsts(key, more)
            assert [(int(i), int(c)) for i, c in zip(first, count, strict=True)] == [(x[0], len(x)) for _, x in sorted(seen.items())]


def test_suspects_are_found_without_set_look_ups(monkeypatch):
    rng = random.Random(9)
    words = [rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(400)]
    hashes = substring_dedup.word_hashes(words)
    _, of_window = substring_dedup.window_anchors(hashes, 20)
    at, h = substring_dedup.anchors_of(hashes, 20)
    monkeypatch.setattr(np, "isin", None)
    for share in (0, 3, 1):
        single = at[[i for i in range(len(at)) if share and i % share == 0]]
        alone = set(h[np.searchsorted(at, single)].tolist())
        start, same = substring_dedup._suspects(words, single, 20)
        assert start.tolist() == [i for i, x in enumerate(of_window.tolist()) if x not in alone] and (same == hashes).all()
    assert substring_dedup._suspects(words[:19], at[:0], 20)[0].tolist() == []


def test_substring_dedup_odd_rows(odd, none):
    out = substring_dedup.substring_dedup(odd).collect()
    rows = odd_rows()
    assert sorted((r.doc_id or 0, r.n_words) for r in out) == sorted((d or 0, len(WORD.findall(t or ""))) for d, t, *_ in rows)
    # equal rows count as earlier and later ones: one copy stays, whole
    assert sum(r.n_words == 40 and r.n_removed == 40 for r in out) == 3
    assert substring_dedup.substring_dedup(none).collect() == []


# --- 8 -----------------------------------------------------------------------------------------

def check_exact(table):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for doc_id, text in table.select("doc_id", "text").collect():
        groups[norm(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = exact_dedup.exact_dedup(table).collect()
    assert len(out) == sum(map(len, groups.values()))
    by = collections.defaultdict(list)
    for r in out:
        by[bytes(r.digest)].append(r)
    assert len(by) == len(groups)
    for text, rows in groups.items():
        own = by[hashlib.sha256(text.encode()).digest()]
        best = min(rows, key=lambda x: x[:3])
        assert sum(r.kept for r in own) == 1
        assert all(r.group_size == len(rows) and r.keep_id == best[3] for r in own)
        assert [(r.doc_id, r.n_chars) for r in own if r.kept] == [(best[3], -best[0])]
    return len(groups)


def test_exact_dedup(docs, odd, none):
    groups = check_exact(docs)
    assert exact_dedup.keep_first(docs).count() == groups
    groups = check_exact(odd)
    clash = odd.withColumnsRenamed({"lang": "digest", "source": "row"})
    kept = exact_dedup.keep_first(clash)
    assert kept.columns == clash.columns and kept.count() == groups
    assert exact_dedup.exact_dedup(none).collect() == []


def test_perfect_hash():
    rng = np.random.default_rng(11)
    digests = rng.integers(0, 256, (5000, 32), np.uint8)
    levels = exact_dedup.build_hash(digests)
    assert sorted(exact_dedup.slots_of(levels, digests)) == list(range(5000))
    assert exact_dedup.slots_of(levels, rng.integers(0, 256, (1000, 32), np.uint8)).max() < 5000


# --- 9 -------------------------------------------------------------------------------------------

def fingerprint_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(prints):
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= 4) + i + 1:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_simhash(request, table):
    source = request.getfixturevalue(table)
    rows = [tuple(r) for r in source.select("doc_id", "text").collect()]
    prints = [fingerprint_of(t) for _, t in rows]
    roots = roots_of(prints)
    least = {}
    for (d, _), r in zip(rows, roots):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    want = sorted(((d, p, least[r]) for (d, _), p, r in zip(rows, prints, roots)), key=key)
    out = simhash.near_duplicates(source).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in out), key=key) == want
    assert simhash.keep_one(source).count() == len(set(roots)) == sum(r.kept for r in out)


@pytest.mark.parametrize(("segments", "block"), [(3, 4096), (2, 4096), (3, 16)])
def test_links_of_dense_groups(spark, monkeypatch, segments, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, prints = random.Random(12), set()
    for _ in range(8):
        center = rng.getrandbits(64)
        for _ in range(rng.choice((3, 120))):
            flips = rng.sample(range(64), rng.randint(0, 6))
            prints.add(center ^ sum(1 << b for b in flips))
    prints = sorted(prints)
    signed = [(p - (1 << 64) * (p >> 63),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long").repartition(4), segments=segments)
    found = {r.node: r.root for r in components.components(links).collect()}
    mine = {p: found.get(p, p) for (p,) in signed}
    want = collections.defaultdict(set)
    for (p,), r in zip(signed, roots_of(prints)):
        want[r].add(p)
    assert sorted(map(sorted, want.values())) == sorted(
        sorted(k for k in mine if mine[k] == r) for r in set(mine.values()))
    assert links.count() < 40 * len(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000), (7, 3)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)}


def test_simhash_of_an_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []


# --- 10 --------------------------------------------------------------------------------------------

def targets_of(sizes, budget):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        over = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / over for s in sizes}
        more = {s for s in sizes if s not in full and target[s] >= 2 * sizes[s]}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mixing(request, table):
    source = request.getfixturevalue(table)
    sizes = collections.Counter()
    for r in source.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets_of(sizes, 1.5 * sum(sizes.values()))
    out = mixing.mix(source).collect()
    assert len(out) == source.count()
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = mixing.mix(source.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.row_key, tuple(r.positions))
    assert sorted((tuple(r)[:-1] for r in sorted(out, key=key)), key=str) == sorted((tuple(r)[:-1] for r in sorted(again, key=key)), key=str)
    table = common.written(source, "mix-in")
    order = mixing.training_order(table)
    assert order.columns == source.columns and order.count() == sum(r.copies for r in out)
    by = {r.row: r for r in mixing.mix(table).collect()}
    places = mixing.curriculum(mixing.mix(table)).orderBy("at").collect()
    assert [p["at"] for p in places] == list(range(len(places)))
    assert [p.position for p in places] == sorted(x for r in by.values() for x in r.positions)
    totals = mixing.taken_words(table).collect()
    pair = lambda r: (r.doc_id is None, r.doc_id or 0, r.row_key, r.taken)
    assert sorted(map(pair, totals)) == sorted(map(pair, out))


def test_map_columns_and_clashing_names(spark, odd):
    clash = odd.withColumn("tags", F.create_map(F.lit("a"), F.col("source"))).withColumnsRenamed(
        {"lang": "row", "source": "row_key"}).withColumn("source", F.lit("s")).withColumn("position", F.lit(1))
    table = common.written(clash, "clash")
    assert mixing.training_order(table).columns == clash.columns
    assert mixing.taken_words(table).count() == simhash.near_duplicates(table).count() == table.count()
    assert simhash.keep_one(table).columns == exact_dedup.keep_first(table).columns == clash.columns


def test_slices_do_not_change_the_mix(docs, monkeypatch):
    one = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == one


def test_positions_invert_the_schedule(spark):
    for points in mixing.SCHEDULES:
        share = lambda t, points=points: sum(
            (m0 + (m1 - m0) * (min(t, t1) - t0) / (t1 - t0) / 2) * (min(t, t1) - t0)
            for (t0, m0), (t1, m1) in zip(points, points[1:]) if t > t0)
        rows = spark.range(101).select((F.col("id") / 100).alias("q")).withColumn("t", mixing.position_at(F.col("q"), points)).collect()
        assert all(share(r.t) / share(1.0) == pytest.approx(r.q, abs=1e-9) for r in rows)


def test_mixing_of_an_empty_table(none):
    assert mixing.mix(none).collect() == [] == mixing.training_order(none).collect()
