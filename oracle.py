"""The results of ``queries()`` stated in DuckDB SQL over the given tables."""

from __future__ import annotations

SNIPPET_WEIGHTS = {"the": 0.25, "of": 0.5, "worthless": 1.0}

TOKEN = r"[\p{L}\p{N}]+"

CORPUS = """v0 AS (
  SELECT doc_id, lang, source, text AS content,
         CASE lang WHEN 'en' THEN 'txt' WHEN 'de' THEN 'md' WHEN 'fr' THEN 'log' ELSE 'bin' END AS ext,
         1700000000000 + doc_id * 1000 AS modified, strlen(text) AS size
  FROM documents),
v AS (SELECT source || '/' || doc_id || '.' || ext AS path, doc_id || '.' || ext AS filename, * FROM v0)"""

TOKENS = CORPUS + f""",
toks AS (
  SELECT path, 'content' AS field, regexp_extract_all(lower(content), '{TOKEN}') AS ts FROM v
  UNION ALL SELECT path, 'filename', regexp_extract_all(lower(filename), '{TOKEN}') FROM v)"""

INDEX = """,
occ AS (SELECT path, field, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM toks),
kept AS (SELECT * FROM occ),
dls AS (SELECT t.path, t.field, count(k.term) AS dl
        FROM toks t LEFT JOIN kept k ON t.path = k.path AND t.field = k.field GROUP BY ALL),
stats AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM dls GROUP BY field),
post AS (SELECT path, field, term, count(*) AS tf FROM kept GROUP BY ALL),
vocab AS (SELECT term, field, count(*) AS df FROM post GROUP BY ALL),
idf AS (SELECT term, field, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM vocab JOIN stats USING (field))"""

SEARCH = TOKENS + INDEX

BM25 = "{w} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * dl / avgdl))"

SYNC = CORPUS + """,
stored AS (SELECT path, modified - (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS modified, size FROM v
           WHERE doc_id % 10 <> 0 AND (lang <> 'es' OR doc_id % 3 = 0)),
listed AS (SELECT path, modified, size, content, ext FROM v WHERE doc_id % 13 <> 0),
seen AS (SELECT l.path, l.modified, l.size, l.content,
           CASE WHEN l.ext = 'bin' OR l.size > 20971520 THEN 'ineligible'
                WHEN s.modified = l.modified THEN 'unchanged' ELSE 'changed' END AS status
         FROM listed l LEFT JOIN stored s ON l.path = s.path),
removed AS (SELECT path FROM stored WHERE path NOT IN (SELECT path FROM seen WHERE status <> 'ineligible')),
fresh AS (SELECT path, modified, size, content FROM seen WHERE status = 'changed')"""


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def term_leaf(word: str, fields=("content", "filename")) -> str:
    return (f"SELECT path, sum({BM25.format(w='idf', tf='tf')}) AS s FROM post JOIN dls USING (path, field) "
            f"JOIN stats USING (field) JOIN idf USING (term, field) WHERE term = '{word}' "
            f"AND field IN {_in(fields)} GROUP BY path")


def words_leaf(words: list[str], slop: int = 0) -> str:
    """Words in order with moves that cost at most ``slop``: one join per word."""
    n = range(len(words))
    joins = "kept p0 " + " ".join(
        f"JOIN kept p{i} ON p{i}.path = p0.path AND p{i}.field = p0.field" for i in n if i)
    move = lambda i: f"abs((p{i}.pos - {i}) - (p{i - 1}.pos - {i - 1}))"
    cost = " + ".join(move(i) for i in n if i)
    terms = " AND ".join(f"p{i}.term = '{w}'" for i, w in enumerate(words))
    apart = " AND ".join(f"p{i}.pos <> p{j}.pos" for i in n for j in range(i))
    idf = " + ".join(f"(SELECT coalesce(max(idf), 0) FROM idf WHERE term = '{w}' AND field = f.field)" for w in words)
    return (f"SELECT path, sum({BM25.format(w='w', tf='tf')}) AS s FROM ("
            f"SELECT p0.path, p0.field, count(DISTINCT p0.pos) AS tf FROM {joins} "
            f"WHERE {terms} AND {apart} AND {cost} <= {slop} GROUP BY ALL) JOIN dls USING (path, field) "
            f"JOIN stats USING (field) JOIN (SELECT field, {idf} AS w FROM stats f) USING (field) GROUP BY path")


def pattern_leaf(test: str) -> str:
    return f"SELECT DISTINCT path, 1.0 AS s FROM post WHERE field = 'content' AND {test}"


def rows_leaf(test: str = "true") -> str:
    return f"SELECT path, 1.0 AS s FROM v WHERE {test}"


GLOB_TH = "regexp_full_match(term, 'th.n')"
# damerau_levenshtein counts bytes. The words looked for are ASCII, so any other
# character is as far from theirs as a "#" is.
DISTANCE = lambda word: rf"damerau_levenshtein(regexp_replace(term, '[^\x00-\x7f]', '#', 'g'), '{word}')"
FUZZY = lambda word, d: f"{DISTANCE(word)} <= {d}"

LEAVES = {
    "the": term_leaf("the"), "of": term_leaf("of"), "this": term_leaf("this"), "und": term_leaf("und"),
    "der": term_leaf("der"), "worthless": term_leaf("worthless"),
    "of_the": words_leaf(["of", "the"]),
    "g_und": pattern_leaf("term LIKE 'und%'"), "g_e": pattern_leaf("term LIKE 'e%'"),
    "thet": pattern_leaf(FUZZY("thet", 1)),
    "every": rows_leaf(),
}


def combined(*groups: tuple[list[str], list[str]]) -> str:
    """SQL for OR-groups of (required, excluded) leaves."""
    used = list(dict.fromkeys(l for g in groups for part in g for l in part))
    ctes = "".join(f",\nleaf_{l} AS ({LEAVES[l]})" for l in used)
    flags = [" AND ".join([f"{l}.s IS NOT NULL" for l in req] + [f"{l}.s IS NULL" for l in exc]) for req, exc in groups]
    sums = [" + ".join(f"{l}.s" for l in req) for req, _ in groups]
    joins = " ".join(f"LEFT JOIN leaf_{l} {l} ON {l}.path = v.path" for l in used)
    total = " + ".join(f"(CASE WHEN {f} THEN {s} ELSE 0 END)" for f, s in zip(flags, sums))
    where = " OR ".join(f"({f})" for f in flags)
    return f"WITH {SEARCH}{ctes},\nfound AS (SELECT v.path, round({total}, 6) AS score FROM v {joins} WHERE {where})\n"


def scored(leaf: str) -> str:
    return f"WITH {SEARCH},\nleaf AS ({leaf})\nSELECT path, round(s, 6) AS score FROM leaf"


ALL_FOUND = "SELECT path, score FROM found"
TOP = "SELECT path, score FROM found ORDER BY score DESC, path LIMIT {n}"
HIT = ("SELECT v.path, v.filename, v.ext, v.size, v.modified, h.score FROM "
       "(SELECT * FROM found ORDER BY score DESC, path LIMIT {n}) h JOIN v ON v.path = h.path")

SLICE = combined((["the"], ["der"]))
COMBINED = combined((["the", "of_the"], []), (["g_und"], ["der"]), (["every"], ["g_e"]))

ESCAPE = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ESCAPE_Q = "replace(replace(" + ESCAPE + ", '\"', '&quot;'), '''', '&#x27;')"
BLANK = r"[\t-\r\x{85}\p{Z}]"


def fallback(x: str) -> str:
    trimmed = rf"regexp_replace(regexp_replace({x}, '^{BLANK}+', ''), '{BLANK}+$', '')"
    return ESCAPE.format(x=f"substring({trimmed}, 1, 220)")


def highlight(x: str, words: list[str]) -> str:
    pieces = rf"regexp_extract_all({x}, '{TOKEN}|[^\p{{L}}\p{{N}}]+')"
    esc = ESCAPE_Q.format(x="p")
    return (f"coalesce(list_aggregate(list_transform({pieces}, lambda p: CASE WHEN lower(p) IN {_in(words)} "
            f"THEN '<b>' || {esc} || '</b>' ELSE {esc} END), 'string_agg', ''), '')")


def window_fold(weights: dict) -> str:
    """A fold over the pieces; each piece has the shape of the state."""
    weight = "CASE lower(p) " + " ".join(f"WHEN '{w}' THEN {x}" for w, x in weights.items()) + " ELSE 0.0 END"
    tok = rf"regexp_matches(p, '^[\p{{L}}\p{{N}}]')"
    state = lambda t, n, pos, s, w, bs, be, bw: (
        f"{{'t': {t}, 'n': {n}, 'pos': {pos}, 's': {s}, 'w': ({w})::DOUBLE, 'bs': {bs}, 'be': {be}, 'bw': ({bw})::DOUBLE}}")
    piece = state(tok, "length(p)::BIGINT", "0::BIGINT", "0::BIGINT", weight, "0::BIGINT", "0::BIGINT", "0.0")
    start = state("false", "0::BIGINT", "0::BIGINT", "(-1)::BIGINT", "0.0", "0::BIGINT", "0::BIGINT", "0.0")
    opens = "(a.s < 0 OR a.pos + x.n - a.s > 220)"
    s = f"(CASE WHEN {opens} THEN a.pos ELSE a.s END)"
    w = f"((CASE WHEN {opens} THEN 0.0 ELSE a.w END) + x.w)"
    better = f"({w} > a.bw + 1e-12)"
    # An excerpt ends with the last token of its window.
    grown = state("false", "0::BIGINT", "a.pos + x.n", s, w, f"CASE WHEN {better} THEN {s} ELSE a.bs END",
                  f"CASE WHEN {better} OR ({s} = a.bs AND a.bw > 0) THEN a.pos + x.n ELSE a.be END",
                  f"CASE WHEN {better} THEN {w} ELSE a.bw END")
    passed = state("false", "0::BIGINT", "a.pos + x.n", "a.s", "a.w", "a.bs", "a.be", "a.bw")
    pieces = rf"regexp_extract_all(content, '{TOKEN}|[^\p{{L}}\p{{N}}]+')"
    return (f"list_reduce(list_transform({pieces}, lambda p: {piece}), "
            f"lambda a, x: CASE WHEN x.t THEN {grown} ELSE {passed} END, {start})")


def _search_hits() -> str:
    """Hits of: worthless, or und with "of the"; with the excerpts they show."""
    words = ["worthless", "und", "of", "the"]
    dfs = ", ".join(f"(SELECT coalesce(max(df), 0) FROM vocab WHERE field = 'content' AND term = '{w}') AS df_{w}"
                    for w in words)
    fold = window_fold({w: f"(1.0::DOUBLE / (1 + df_{w}))" for w in words})
    part = highlight("substring(content, r.bs + 1, r.be - r.bs)", words)
    return (combined((["worthless"], []), (["und", "of_the"], [])).rstrip() + f""",
h AS (SELECT * FROM found ORDER BY score DESC, path LIMIT 50),
f AS (SELECT v.*, h.score, {fold} AS r FROM h JOIN v ON v.path = h.path CROSS JOIN (SELECT {dfs}))
SELECT path, filename, ext, size, modified, score,
       CASE WHEN r.bw > 0 THEN {part} ELSE {fallback('content')} END AS snippet FROM f""")


MANIFEST = CORPUS + """,
log AS (SELECT upper(source[1]) || source[2:] || ' ' || upper(lang) AS name, source || '-' || lang AS dir,
               source AS folders, lang, count(*) AS n, max(modified) AS last FROM v GROUP BY ALL),
now AS (SELECT name, dir, folders, CASE WHEN lang = 'fr' THEN 0 ELSE n END AS doc_count,
               CASE WHEN lang = 'fr' THEN NULL ELSE last END AS last_built FROM log WHERE lang <> 'es')"""

MANY = SEARCH + """,
src AS (SELECT split_part(path, '/', 1) AS query_id, unnest(ts) AS word FROM toks WHERE field = 'content'),
cnt AS (SELECT query_id, word, count(*) AS n FROM src WHERE length(word) >= 6 GROUP BY ALL),
best AS (SELECT query_id, word FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, word DESC) AS r
         FROM cnt) WHERE r = 1),
ts2 AS (SELECT path, term, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
        FROM post JOIN dls USING (path, field) JOIN stats USING (field) JOIN idf USING (term, field)
        WHERE term IN (SELECT word FROM best) OR term IN ('the', 'und', 'der') GROUP BY ALL),
g1 AS (SELECT b.query_id, a.path, a.s + t.s AS s FROM best b JOIN ts2 a ON a.term = b.word
       JOIN ts2 t ON t.path = a.path AND t.term = 'the'),
g2 AS (SELECT b.query_id, u.path, u.s FROM best b JOIN ts2 u ON u.term = 'und'
       WHERE u.path NOT IN (SELECT path FROM ts2 WHERE term = 'der')),
both_groups AS (SELECT query_id, path, round(sum(s), 6) AS score FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY ALL)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, path, score
               FROM both_groups) WHERE rank <= 20"""

TALK = f"""v AS (SELECT conv_id || '/' || turn AS path, role AS filename, text AS content FROM conversations),
toks AS (
  SELECT path, 'content' AS field, regexp_extract_all(lower(content), '{TOKEN}') AS ts FROM v
  UNION ALL SELECT path, 'filename', regexp_extract_all(lower(filename), '{TOKEN}') FROM v)""" + INDEX


def _ignore() -> str:
    """Directories first, then files; the last rule that bears on a name decides."""
    return f"""WITH {CORPUS}
SELECT path, size FROM v
WHERE source <> 'src1'
  AND NOT (ext = 'log' AND source <> 'src2')
  AND NOT (source = 'src3' AND filename LIKE '1%.txt' AND filename NOT LIKE '%3.txt')
  AND NOT (source = 'src4' AND filename LIKE '%2.md')
  AND NOT (source = 'src7' AND filename LIKE '2%.txt')
  AND NOT (source = 'src5' AND regexp_matches(filename, '^[0-4][^/]*\\.txt$'))"""


def statements() -> dict[str, str]:
    o: dict[str, str] = {}
    last = r"regexp_extract(url, '[^/]\.([^./]*)$', 1)"
    o["ignore_rules"] = _ignore()
    o["ext_of"] = f"SELECT url, lower({last}) AS ext FROM pages"
    o["filename_of"] = "SELECT url, split_part(url, '/', -1) AS filename FROM pages"
    o["filter_ext"] = f"WITH {CORPUS} SELECT path, ext FROM v WHERE ext <> 'bin'"
    o["filter_size"] = f"WITH {CORPUS} SELECT path, size AS length FROM v WHERE size <= 2000"
    o["filter_binary"] = f"WITH {CORPUS} SELECT path FROM v WHERE NOT (doc_id % 5 = 0 AND size < 8192)"
    # The second third is windows-1252 where all of a text is Latin-1, and ends with bytes that only the former has.
    latin = r"doc_id % 3 = 2 AND regexp_full_match(content, '[\x{0}-\x{ff}]*', 's')"
    o["decode_text"] = f"WITH {CORPUS} SELECT path, CASE WHEN {latin} THEN content || ' “€”' ELSE content END AS content FROM v"
    o["documents"] = (f"WITH {CORPUS} SELECT path, filename, ext, CASE WHEN doc_id % 5 = 0 THEN content || chr(0) "
                      "ELSE content END AS content, modified, size FROM v WHERE ext <> 'bin' AND size <= 50000 "
                      "AND NOT (doc_id % 5 = 0 AND size < 8192)")
    o["mtime_millis"] = "SELECT event_id, coalesce(epoch_us(ts) // 1000, 0) AS modified FROM events"
    ignored = ("(source = 'src1' AND ext = 'log') OR (source = 'src3' AND ext = 'md') "
               "OR (source = 'src2' AND filename LIKE '1%.txt' AND filename NOT LIKE '%3.txt')")
    named = ("f AS (SELECT *, source || '/' || name AS place FROM (SELECT *, (CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END) || filename "
             "AS name FROM v))")
    o["scan_files"] = f"WITH {CORPUS}, {named} SELECT place AS path, ext, size AS length FROM f WHERE doc_id % 11 <> 0"
    o["build_full"] = (f"WITH {CORPUS}, {named} SELECT place AS path, name AS filename, ext, size, length(content) AS chars FROM f "
                       f"WHERE ext <> 'bin' AND NOT ({ignored.replace('filename', 'name')})")
    synced = (f"{CORPUS}, {named}, now AS (SELECT place AS path, name, ext, doc_id % 7 = 0 AS changed, "
              "content || CASE WHEN doc_id % 7 = 0 THEN ' again' ELSE '' END AS text FROM f WHERE ext <> 'bin' "
              "UNION ALL SELECT 'more/' || place, name, ext, true, content FROM f WHERE ext <> 'bin' AND doc_id % 10 = 0)")
    o["read_changed_only"] = f"WITH {synced} SELECT path, strlen(text) AS size, length(text) AS chars FROM now WHERE changed"
    o["build_files"] = (f"WITH {synced} SELECT path, name AS filename, ext, strlen(text) AS size, "
                        f"list_contains(regexp_extract_all(lower(text), '{TOKEN}'), 'again') AS hit FROM now")
    o["open_or_create"] = f"WITH {CORPUS} SELECT path, modified, size FROM v"
    o["read_snapshot"] = f"WITH {CORPUS} SELECT path, modified FROM v"
    o["count_docs"] = "SELECT count(*) AS n_docs FROM documents"

    o["classify_changes"] = f"WITH {SYNC} SELECT path, status FROM seen"
    o["upsert_documents"] = (f"WITH {SYNC} SELECT path, modified, size FROM stored WHERE path NOT IN "
                             "(SELECT path FROM fresh) UNION ALL SELECT path, modified, size FROM fresh")
    o["removed_documents"] = f"WITH {SYNC} SELECT path FROM removed"
    o["update_incremental"] = o["update_in_memory"] = (
        f"WITH {SYNC} SELECT path, modified, size FROM seen WHERE status <> 'ineligible'")
    o["update_vocabulary"] = (
        f"WITH {SYNC}, t AS (SELECT path, 'content' AS field, content AS x FROM seen WHERE status <> 'ineligible' UNION ALL "
        "SELECT path, 'filename', split_part(path, '/', -1) FROM seen WHERE status <> 'ineligible'), "
        f"d AS (SELECT DISTINCT path, field, unnest(regexp_extract_all(lower(x), '{TOKEN}')) AS term FROM t) "
        "SELECT term, field, count(*) AS df FROM d GROUP BY ALL")
    o["build_stats"] = (
        f"WITH {SYNC} SELECT count(*) FILTER (status = 'changed') AS indexed, "
        "count(*) FILTER (status = 'ineligible') AS skipped, count(*) AS files_seen, "
        "count(*) FILTER (status = 'unchanged') AS unchanged, (SELECT count(*) FROM removed) AS removed FROM seen")

    o["tokenize"] = f"WITH {SEARCH} SELECT path, pos, term FROM kept WHERE field = 'content'"
    o["postings"] = (f"WITH {SEARCH} SELECT term, field, path, count(*) AS tf, "
                     "string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions, any_value(dl) AS dl "
                     "FROM kept JOIN dls USING (path, field) GROUP BY term, field, path")
    o["load_collection"] = f"WITH {SEARCH} SELECT term, field, path, tf, dl FROM post JOIN dls USING (path, field)"
    o["vocabulary"] = f"WITH {SEARCH} SELECT term, field, df FROM vocab"
    o["field_stats"] = f"WITH {SEARCH} SELECT field, n AS n_docs, round(avgdl, 6) AS avgdl FROM stats"

    o["match_term"] = scored(term_leaf("the"))
    o["match_term_split"] = o["match_phrase"] = scored(words_leaf(["of", "the"]))
    o["match_phrase_three"] = scored(words_leaf(["that", "is", "the"]))
    o["match_near"] = scored(words_leaf(["the", "of"], 3))
    o["match_near_three"] = scored(words_leaf(["and", "of", "the"], 4))
    o["match_near_repeated"] = scored(words_leaf(["the", "the"], 3))
    o["match_wildcard"] = scored(pattern_leaf(GLOB_TH))
    o["match_wildcard_prefix"] = scored(pattern_leaf("term LIKE 'tion%'"))
    o["match_wildcard_any"] = scored(pattern_leaf("true"))
    o["match_wildcard_wide"] = scored(pattern_leaf("regexp_full_match(term, '.*t.*')"))
    o["match_regex"] = scored(pattern_leaf("regexp_full_match(term, 'th(e|at|is)[a-e]?')"))
    o["match_fuzzy"] = scored(pattern_leaf(FUZZY("teh", 1)))
    o["match_fuzzy_two"] = scored(pattern_leaf(FUZZY("wihch", 2)))
    o["match_all"] = scored(rows_leaf())
    o["match_field"] = scored(rows_leaf("ext = 'md'"))
    o["match_field_filename"] = scored(term_leaf("txt", ("filename",)))
    o["match_path"] = scored(rows_leaf("path = 'src1/1.txt'"))
    o["all_of"] = combined((["the", "of", "this"], [])) + ALL_FOUND
    o["any_of"] = combined((["worthless"], []), (["the", "und"], [])) + ALL_FOUND
    o["exclude"] = combined((["the"], ["of_the"])) + ALL_FOUND
    o["exclude_only"] = combined((["every"], ["the", "und"])) + ALL_FOUND
    o["score_combined"] = COMBINED + ALL_FOUND
    for name in ("match_term", "match_phrase", "match_near", "match_near_three", "match_near_repeated",
                 "match_wildcard", "match_regex", "match_fuzzy", "match_field", "any_of", "exclude",
                 "exclude_only", "score_combined"):
        o[f"scan_{name}"] = f"SELECT path FROM ({o[name]})"
    o["match_no_token"] = o["score_bm25"] = scored(term_leaf("und"))
    o["score_phrase"] = scored(words_leaf(["in", "the"]))
    o["score_const"] = combined((["g_und"], []), (["thet"], [])) + ALL_FOUND
    o["top_k"] = combined((["the"], [])) + TOP.format(n=50)
    o["search"] = SLICE + HIT.format(n=50)
    o["search_beyond_key_limit"] = combined((["the"], [])) + HIT.format(n=100_000)
    o["hit_projection"] = (
        f"WITH {SEARCH}, found AS (SELECT path, round(s, 6) AS score FROM ({term_leaf('txt', ('filename',))})) "
        f"SELECT v.path, v.filename, v.ext, v.size, v.modified, h.score, {fallback('v.content')} AS snippet FROM "
        "(SELECT * FROM found ORDER BY score DESC, path LIMIT 100) h JOIN v ON v.path = h.path")
    o["search_many"] = f"WITH {MANY}"
    o["conversation_search"] = (
        f"WITH {TALK}, the AS ({term_leaf('the')}), usr AS ({term_leaf('user')}), dela AS ({words_leaf(['de', 'la'])}), "
        "j AS (SELECT v.path, the.s AS a, usr.s AS u, dela.s AS b FROM v LEFT JOIN the ON the.path = v.path "
        "LEFT JOIN usr ON usr.path = v.path LEFT JOIN dela ON dela.path = v.path) "
        "SELECT path, round((CASE WHEN a IS NOT NULL AND u IS NULL THEN a ELSE 0 END) + coalesce(b, 0), 6) AS score "
        "FROM j WHERE (a IS NOT NULL AND u IS NULL) OR b IS NOT NULL")
    o["page_scan"] = (
        f"WITH t AS (SELECT *, split_part(url, '/', -1) AS filename, regexp_extract_all(lower(html), '{TOKEN}') AS c, "
        f"regexp_extract_all(lower(split_part(url, '/', -1)), '{TOKEN}') AS n FROM pages) "
        f"SELECT url AS path, filename, lower({last}) AS ext FROM t WHERE "
        "(list_contains(c, 'nav') OR list_contains(n, 'nav')) AND "
        "(contains(' ' || array_to_string(c, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(n, ' ') || ' ', ' of the '))")

    o["search_hits"] = _search_hits()
    o["snippet_best"] = (f"WITH {CORPUS}, f AS (SELECT path, {window_fold(SNIPPET_WEIGHTS)} AS r FROM v) "
                         "SELECT path, r.bs AS from_char, r.be AS to_char, round(r.bw, 6) AS weight FROM f")
    o["snippet_highlight"] = f"WITH {CORPUS} SELECT path, {highlight('content', ['the', 'of'])} AS snippet FROM v"
    o["snippet_fallback"] = f"WITH {CORPUS} SELECT path, {fallback('content')} AS snippet FROM v"
    o["snippet_text"] = f"WITH {CORPUS} SELECT path, translate(content, chr(10) || chr(13), '  ') AS line FROM v"
    o["slugify"] = (
        f"WITH {CORPUS} SELECT path, coalesce(nullif(trim(lower(regexp_replace(content, "
        "'[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'index') AS slug FROM v")
    o["glob_to_regex"] = (f"WITH {SEARCH} SELECT term, df FROM vocab WHERE field = 'content' "
                          "AND regexp_full_match(term, 't.e.*n')")
    within = ", ".join(f"distance <= {most} AS within_{d}" for d, most in
                       (("none", 1), ("0", 1), ("2", 2), ("9", 2), ("300", 1)))
    o["fuzzy_distance"] = (f"WITH {SEARCH}, d AS (SELECT term, least({DISTANCE('thier')}, 3) AS distance "
                           f"FROM vocab WHERE field = 'content') SELECT term, distance, {within} FROM d")

    o["list_collections"] = f"WITH {MANIFEST} SELECT name, dir, folders, doc_count, last_built FROM now"
    o["get_collection"] = ("SELECT 'Docs en' AS name, 'docs-en' AS dir, 'en' AS folders, count(*) AS doc_count "
                           "FROM documents WHERE lang = 'en'")
    made = ("(SELECT 'Docs: ' || source AS name, 'docs-' || lower(source) AS dir, source || ',more/' || source AS folders, "
            "row_number() OVER (ORDER BY source) AS r FROM (SELECT DISTINCT source FROM documents))")
    o["create_collection"] = f"SELECT name, dir, folders, 0::BIGINT AS doc_count, NULL::BIGINT AS last_built FROM {made}"
    o["drop_collection"] = f"SELECT name, dir FROM {made} WHERE r % 2 = 0"
    o["empty_query"] = (
        f"WITH {MANY[:MANY.index('g1 AS')].rstrip().rstrip(',')}, "
        "f AS (SELECT b.query_id, a.path, round(a.s, 6) AS score FROM best b JOIN ts2 a ON a.term = b.word "
        "WHERE regexp_extract(query_id, '[0-9]+')::INT % 2 = 0) "
        "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, path, score FROM f) "
        "WHERE rank <= 20")
    asked = {"near": scored(words_leaf(["and", "of", "the"], 4)), "self": scored(words_leaf(["the", "the"], 3)),
             "regex": scored(pattern_leaf("regexp_full_match(term, 'th(e|at|is)[a-e]?')")), "field": scored(rows_leaf("ext = 'md'")),
             "phrase": combined((["of_the"], ["der"])) + ALL_FOUND, "mixed": COMBINED + ALL_FOUND, "const": o["score_const"],
             "not": combined((["every"], ["the", "und"])) + ALL_FOUND}
    o["search_many_conditions"] = " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{name}' AS query_id, row_number() OVER (ORDER BY score DESC, path) AS rank, path, score FROM ({sql})) "
        "WHERE rank <= 30" for name, sql in asked.items())
    # A fold over the names of a stem: the state is the list of directories given so far.
    taken = "list_contains(a.given, {})"
    free = (f"CASE WHEN NOT {taken.format('x.slug')} THEN x.slug ELSE x.slug || '-' || list_filter("
            f"range(2, len(a.given) + 3), lambda n: NOT {taken.format("x.slug || '-' || n")})[1] END")
    o["unique_dir"] = (
        "WITH t AS (SELECT split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 7 = 0 THEN ' 2' WHEN p_partkey % 11 = 0 "
        "THEN '-3' ELSE '' END AS name, p_partkey AS ord FROM part), "
        "s AS (SELECT name, ord, coalesce(nullif(trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), "
        "'index') AS slug FROM t), "
        "g AS (SELECT list(name ORDER BY ord) AS names, list(ord ORDER BY ord) AS ords, "
        "list({'slug': slug, 'given': []::VARCHAR[]} ORDER BY ord) AS l FROM s "
        "GROUP BY regexp_replace(slug, '(-[0-9]+)+$', '')), "
        "f AS (SELECT names, ords, list_reduce(l, lambda a, x: {'slug': x.slug, 'given': list_append(a.given, "
        f"{free})}}, {{'slug': '', 'given': []::VARCHAR[]}}) AS r FROM g) "
        "SELECT unnest(names) AS name, unnest(ords) AS ord, unnest(r.given) AS dir FROM f")
    o["build_collection"] = (f"WITH {SYNC} SELECT 'Synced' AS name, 'synced' AS dir, count(*) AS doc_count "
                             "FROM seen WHERE status <> 'ineligible'")
    return o
