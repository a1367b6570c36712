"""Queries that apply each operator, with production parameters, to whole tables,
and the SQL of those results that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, filter_audit, html_extract, langid, license_scan, lm_score, mixing, neighbours, packing, quality,
               simhash, substring_dedup, token_alignment)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)


def op2_html_extraction(spark, sf_dir):
    return html_extract.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality_rules(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_lm_scoring(spark, sf_dir):
    return lm_score.score_against_labels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), packing.public_tokenizer())


def op6_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op8_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark, sf_dir):
    return mixing.taken_words(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.array_min("positions").alias("first_position"), "first_at")


def op11_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_token_alignment(spark, sf_dir):
    return token_alignment.alignment(_table(spark, sf_dir, "documents"), packing.public_tokenizer(),
                                     packing.public_tokenizer("piece_bpe_32k.model"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_html_extraction, op3_quality_rules, op4_lm_scoring, op5_packing, op6_license_scan, op7_substring_dedup, op8_exact_dedup, op9_simhash_near_dedup, op10_mixing, op11_nearest_neighbours,
                                  op12_token_alignment, op13_filter_audit)}


_SPACE = r"[\x20\x09-\x0D]"

_WORD = r"[^\x20\x09-\x0D]+"


def _in_range(rule: quality.Rule) -> str:
    a, b = {"mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
            "stop_word_ratio": ("n_stop_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
            "repeat_word_ratio": ("n_repeat_words", "n_words"), "upper_ratio": ("n_upper", "n_letters")}[rule.ratio]
    value = f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"
    return " AND ".join([f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None))


_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words}))

SQL = {
    "op3_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM d),
x AS (SELECT r, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS i FROM w),
stop AS (SELECT r, count(*) AS n_stop_words FROM x WHERE lower(x) IN ({_STOP}) GROUP BY r),
three AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM three WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
c AS (SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
             len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS n_upper, len(regexp_replace(t, '\\P{{L}}', '', 'g')) AS n_letters,
             coalesce(n_stop_words, 0) AS n_stop_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN stop USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(_in_range, quality.RULES))} AS kept FROM b""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
i AS (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM d),
again AS (SELECT r, i FROM (SELECT r, doc_id, i, array_to_string(words[i:i + 19], ' ') AS w FROM i)
          QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, i) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM again),
word AS (SELECT r, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS j FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm
           FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op13_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
              100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
              first IS NOT NULL AND (doc_id IS NULL OR first < doc_id)] AS fails
      FROM w JOIN first USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM v a, v b, v c, v d, v e
      WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, step, instr('ABCDE', substr(filter_order, step, 1)) AS own,
             [instr('ABCDE', substr(filter_order, j, 1)) FOR j IN range(1, step)] AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT *, fails[own] AS failed, len([j FOR j IN before IF fails[j]]) > 0 AS gone, len([z FOR z IN fails IF z]) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(g) FILTER (failed AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(x) FILTER (failed AND NOT gone), 0)::BIGINT AS toxic_lost FROM m GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
