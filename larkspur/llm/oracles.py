"""DuckDB SQL for the queries of near duplicates, quality rules and decontamination; written for tables of a few thousand documents."""

from __future__ import annotations

from larkspur.llm.quality_rules import CLASSES, COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_SHARE, PROFILE_WEIGHT, PROFILES, SYMBOLS

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = f"""
WITH RECURSIVE rows AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM rows),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS both_
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * both_ >= 80 * (n + m - both_)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, l.b) AS component_id, s.doc_id = least(s.doc_id, l.b) AS kept FROM sets s LEFT JOIN least_ l ON s.doc_id = l.a
"""


def _profiles() -> str:
    rows = []
    for lang, profile in PROFILES.items():
        common = list(COMMON_WORDS[lang].values())
        for kind, counts in (("class", profile), ("word", [*common, 1000 - sum(common)])):
            rows += [f"('{lang}', '{kind}', {k}, {x / sum(counts)!r}::DOUBLE)" for k, x in enumerate(counts)]
    return ", ".join(rows)


def _quality_rules() -> str:
    counted = [r"[\x20\x09-\x0D]", SYMBOLS, r"[^\x00-\x7F]", *CLASSES]
    classes = ", ".join(f"length(text) - length(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in counted)
    lists = " ".join(f"WHEN '{lang}' THEN [" + ", ".join(f"'{w}'" for w in words) + "]" for lang, words in COMMON_WORDS.items())
    half = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
    return f"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
parts AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, [{classes}] AS c,
  CASE lang {lists} ELSE []::VARCHAR[] END AS frequent FROM given),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM parts WHERE len(w) > 2),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY r),
base AS (SELECT p.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) - c[1] AS BIGINT) AS word_chars, CAST(c[2] AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words,
  list_append(c, length(text) - list_sum(c)) AS classes, list_transform(frequent, lambda f: len(list_filter(w, lambda x: lower(x) = f))) AS commons FROM parts p LEFT JOIN repeats q ON p.r = q.r),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
shares AS (SELECT r, lang, base_failed, 'class' AS kind, unnest(range(len(classes))) AS k, unnest(classes) / greatest(list_sum(classes), 1) AS v FROM judged
  UNION ALL SELECT r, lang, base_failed, 'word', unnest(range(len(commons) + 1)), unnest(list_append(commons, n_words - coalesce(list_sum(commons), 0))) / greatest(n_words, 1) FROM judged WHERE len(commons) > 0),
profiles AS (SELECT * FROM (VALUES {_profiles()}) AS t(lang, kind, k, v)),
usual AS (SELECT kind, k, avg(v) AS v FROM profiles WHERE kind = 'class' GROUP BY kind, k),
sums AS (SELECT lang, kind, k, sum(v) AS v, count(*) AS n FROM shares WHERE NOT base_failed GROUP BY lang, kind, k),
refs AS (SELECT s.lang, s.kind, s.k, ({PROFILE_WEIGHT} * coalesce(p.v, u.v) + s.v) / ({PROFILE_WEIGHT} + s.n) AS v, len(list_filter([s.kind], lambda x: x = 'word')) AS word
  FROM sums s LEFT JOIN profiles p ON s.lang = p.lang AND s.kind = p.kind AND s.k = p.k LEFT JOIN usual u ON s.kind = u.kind AND s.k = u.k),
far AS (SELECT lang, sqrt(sum({half("p", "v")} + {half("v", "p")}) / 2) AS d FROM (SELECT lang, v, CASE WHEN k = max(k) OVER (PARTITION BY lang) THEN 1.0 ELSE 0.0 END AS p FROM refs WHERE kind = 'word') GROUP BY lang),
distance AS (SELECT s.r, s.kind, s.lang, sqrt(greatest(0, sum({half("s.v", "q.v")} + {half("q.v", "s.v")}) / 2)) AS d FROM shares s JOIN refs q ON s.lang = q.lang AND s.kind = q.kind AND s.k = q.k GROUP BY s.r, s.kind, s.lang),
gone AS (SELECT DISTINCT d.r FROM distance d LEFT JOIN far f ON d.lang = f.lang WHERE d.kind = 'class' AND d.d > {MAX_CLASS_DISTANCE} OR d.kind = 'word' AND d.d > {MAX_WORD_SHARE} * f.d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM gone) AS kept FROM judged
"""


QUALITY_RULES = _quality_rules()

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
places AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
known AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS window_ FROM places),
sizes AS (SELECT DISTINCT n FROM known),
at_ AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT a.r, a.i, a.n, k.item FROM at_ a JOIN known k ON a.n = k.n AND array_to_string(a.w[a.i : a.i + a.n - 1], ' ') = k.window_),
words AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(n)) AS j FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words h ON d.r = h.r LEFT JOIN items t ON d.r = t.r
"""
