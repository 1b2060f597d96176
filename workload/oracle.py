"""The same queries as DuckDB SQL, written on their own from the rules of each operator."""

from __future__ import annotations

from wageband.functions import vocab
from wageband.schemas import (
    BAND_LABELS, FIVE_BANDS, FLAG_COLUMNS, LOW_BAND_LABELS, NA_TOKENS, TARGET_PER_CLASS, WAGE_BANDS,
)
from wageband.sources.registry import KEYWORD_BATCHES, LOW_WAGE_KEYWORDS
from workload.adapters import FILLER, KEYWORDS, PHONE, PLACES, SENTENCES, TITLES
from workload.queries import QUOTA, SITE, SMALL_QUOTA

WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
      r"\x{3000}]+")


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS)}, ' ', 'g'))"


def has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def flag(text: str, words) -> str:
    return f"CAST({has(text, words)} AS INTEGER)"


def chain(text: str, rules, rest: str) -> str:
    whens = " ".join(f"WHEN {has(text, words)} THEN {q(label)}" for label, words in rules)
    return f"CASE {whens} ELSE {rest} END"


def pick(values, index: str) -> str:
    return f"list_extract({qlist(values)}, CAST({index} AS INTEGER) + 1)"


def band(x: str, bands=WAGE_BANDS) -> str:
    whens = " ".join(f"WHEN {x} >= {b.lower} THEN {i}"
                     for i, b in reversed(list(enumerate(bands))))
    return f"CAST(CASE {whens} END AS INTEGER)"


def label(x: str, bands=WAGE_BANDS) -> str:
    whens = " ".join(f"WHEN {x} >= {b.lower} THEN {q(b.label)}" for b in reversed(bands))
    return f"CASE {whens} ELSE 'unknown' END"


DOTS = ("CAST(amt // 1000000 AS VARCHAR) || '.' || lpad(CAST((amt // 1000) % 1000 AS VARCHAR), 3, '0')"
        " || '.' || lpad(CAST(amt % 1000 AS VARCHAR), 3, '0')")
POSTINGS = f"""
base AS (SELECT o_orderkey AS k, c_name, o_orderdate,
                CAST(floor(o_totalprice * 30) AS BIGINT) AS amt
         FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
shaped AS (SELECT *, amt // 1000000 AS m, (amt // 100000) % 10 AS d, {DOTS} AS dots FROM base),
postings AS (SELECT k AS pos, CAST(k % 4 AS INTEGER) AS piece,
  {pick(KEYWORDS, 'k % 8')} AS source_keyword,
  {pick(TITLES, 'k % 12')} AS job_title,
  CASE WHEN k % 13 <> 0 THEN c_name END AS company,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN '  '
       ELSE {pick(PLACES, '(k * 7) % 20')} END AS location,
  CASE k % 10 WHEN 1 THEN 'Rp ' || dots WHEN 2 THEN 'Rp ' || dots || ' - Rp ' || dots || ' per bulan'
       WHEN 3 THEN m || ',' || d || ' juta' WHEN 4 THEN 'IDR ' || amt
       WHEN 5 THEN 'rp ' || (amt // 1000) || 'k' WHEN 6 THEN 'Kompetitif'
       WHEN 7 THEN m || ' - ' || (m + 2) || ' juta' WHEN 8 THEN 'gaji ' || m || '.' || d || 'jt per month'
       WHEN 9 THEN ' ' END AS salary_text,
  {pick(SENTENCES, 'k % 16')} || CASE WHEN k % 11 = 0 THEN {q(PHONE)} ELSE '' END AS job_description,
  CASE WHEN k % 23 <> 0 THEN 'https://jobs.example.org/job/'
       || CASE WHEN k % 5 < 2 THEN k // 4 ELSE k END END AS job_url,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS scraped_at FROM shaped)"""
RAW = "source_keyword, job_title, company, location, salary_text, job_description, job_url, scraped_at"


def parsed(source: str, key: str, text: str, name: str = "pay") -> str:
    """CTEs that give salary_min/max/avg per key of ``source`` from the SQL text expression."""
    hits = "list_concat(list_concat({}, {}), list_concat({}, {}))".format(
        *[f"regexp_extract_all(t, {q(p)})" for p, _ in vocab.AMOUNT_PATTERNS])
    return f"""
{name}_hits AS (SELECT {key}, unnest({hits}) AS h FROM (SELECT {key}, {text} AS t FROM {source})),
{name}_parts AS (SELECT {key}, regexp_extract(h, '[0-9][0-9.,]*') AS num,
  (contains(h, 'juta') OR contains(h, 'jt')) AS mil FROM {name}_hits),
{name}_digits AS (SELECT *, TRY_CAST(regexp_replace(num, '[.,]', '', 'g') AS BIGINT) AS w,
  TRY_CAST(replace(num, ',', '.') AS DOUBLE) AS x FROM {name}_parts),
{name}_values AS (SELECT {key}, CASE
  WHEN mil AND regexp_matches(num, '[.,]') THEN TRY_CAST(trunc(x * 1000000) AS BIGINT)
  WHEN mil AND w < 1000 THEN w * 1000000
  WHEN w >= 1000 AND w < 100000 THEN w * 1000 ELSE w END AS v FROM {name}_digits),
{name}_range AS (SELECT {key}, min(v) AS lo, max(v) AS hi FROM {name}_values
  WHERE v BETWEEN {vocab.LOWEST_PAY} AND {vocab.HIGHEST_PAY} GROUP BY {key}),
{name} AS (SELECT s.*, lo AS salary_min, hi AS salary_max, (lo + hi) // 2 AS salary_avg,
  {band('(lo + hi) // 2')} AS salary_range_id, {label('(lo + hi) // 2')} AS salary_range_label,
  CAST(lo IS NOT NULL AS INTEGER) AS salary_available
  FROM {source} s LEFT JOIN {name}_range r ON s.{key} = r.{key})"""


PAY_TEXT = collapse("lower(concat_ws(' ', salary_text, job_title, job_description))")
PAY = POSTINGS + "," + parsed("postings", "pos", PAY_TEXT)
FEATURE_TEXT = collapse("lower(concat_ws(' ', " + ", ".join(
    f"coalesce({c}, 'nan')" for c in ("job_title", "company", "location", "salary_text",
                                      "job_description")) + "))")
GPA = "coalesce({})".format(", ".join(
    f"CASE WHEN {x} BETWEEN 0 AND 4 THEN {x} END" for x in (
        f"TRY_CAST(replace(nullif(regexp_extract(t, {q(p)}, 1), ''), ',', '.') AS DOUBLE)"
        for p in vocab.GPA_PATTERNS)))
# The long form of the first pattern, with the words that may stand before the number.
YEAR_PATTERNS = [
    r"(?:minimal|min|minimum|at least)?\s*(\d+)\s*(?:tahun|thn|year|years)\s*(?:pengalaman|experience)",
    r"(?:pengalaman|experience)\s*(?:minimal|min|minimum)?\s*(\d+)\s*(?:tahun|thn|year|years)",
]
YEARS = ("coalesce(list_min(list_transform(list_concat(" + ", ".join(
    f"regexp_extract_all(t, {q(p)}, 1)" for p in YEAR_PATTERNS)
    + "), lambda x: TRY_CAST(x AS INTEGER))), 0)")
TEXTS = f"texts AS (SELECT *, {FEATURE_TEXT} AS t FROM postings)"
REGION_TEXT = collapse("lower(coalesce(location, 'nan'))")
REGION = chain(REGION_TEXT, vocab.REGIONS,
               f"CASE WHEN {REGION_TEXT} <> '' THEN 'lainnya' ELSE 'unknown' END")
REPAIRED = chain(collapse("lower(coalesce(location, ''))"), vocab.REPAIR_REGIONS, "'lainnya'")
FAMILY = chain("t", vocab.JOB_FAMILIES, "'other'")


def _flags() -> str:
    out = []
    for name in FLAG_COLUMNS:
        if name == "f_min_gpa":
            out.append(f"coalesce({GPA}, 0.0) AS f_min_gpa")
        elif name == "f_experience_years_min":
            out.append(f"CAST({YEARS} AS INTEGER) AS f_experience_years_min")
        elif name == "f_ipk_required":
            out.append(f"CAST({GPA} IS NOT NULL OR {has('t', vocab.FLAG_KEYWORDS[name])} AS INTEGER)"
                       f" AS {name}")
        elif name == "f_work_experience_required":
            out.append(f"CAST({YEARS} > 0 OR {has('t', vocab.FLAG_KEYWORDS[name])} AS INTEGER)"
                       f" AS {name}")
        else:
            out.append(f"{flag('t', vocab.FLAG_KEYWORDS[name])} AS {name}")
    return ", ".join(out)


FLAGS = _flags()
KEPT = ", ".join(f"coalesce({c}, '') AS {c}" for c in (
    "source_keyword", "scraped_at", "job_title", "company", "location", "job_url", "salary_text"))
PROXY = PAY + f""",
proxy AS (SELECT row_number() OVER (ORDER BY pos) AS source_id, pos, piece, {KEPT},
  salary_min, salary_max, salary_avg, salary_range_id, salary_range_label, salary_available,
  {FLAGS}, {FAMILY} AS job_family, {REGION} AS region_group
  FROM (SELECT *, {FEATURE_TEXT} AS t FROM pay))"""
PROXY_OUT = "* EXCLUDE (pos, piece)"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def kept(source: str, keys: str, order: str, columns: str = "*", where: str = "true") -> str:
    return (f"SELECT {columns} FROM {source} WHERE {where} "
            f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1")


def known_accept(source: str, counts: str, known: str, target: int, labels) -> str:
    """CTE body: first arrivals not known, ranked per class against the room left."""
    return f"""
firsts AS ({kept(source, 'job_url', 'pos', where='job_url IS NOT NULL')}),
fresh AS (SELECT * FROM firsts WHERE job_url NOT IN (SELECT job_url FROM ({known}) WHERE job_url IS NOT NULL)),
room AS (SELECT l.salary_range_label, {target} - coalesce(c.n, 0) AS room
  FROM (SELECT unnest({qlist(labels)}) AS salary_range_label) l LEFT JOIN ({counts}) c USING (salary_range_label)),
ranked AS (SELECT f.*, room, row_number() OVER (PARTITION BY f.salary_range_label ORDER BY pos) AS rn
  FROM fresh f JOIN room USING (salary_range_label))"""


def _keyword_cap(n: int = 100, more: str = "true") -> str:
    steps, taken = [], []
    for i, word in enumerate(KEYWORDS):
        free = "".join(f" AND job_url NOT IN (SELECT job_url FROM {t})" for t in taken)
        steps.append(
            f"k{i} AS MATERIALIZED (SELECT * FROM ({kept('postings', 'job_url', 'pos', where=f'source_keyword = {q(word)} AND job_url IS NOT NULL AND {more}')}) "
            f"WHERE true{free} ORDER BY pos LIMIT {n})")
        taken.append(f"k{i}")
    union = " UNION ALL ".join(
        f"SELECT pos, source_keyword, job_title, job_url FROM {t}" for t in taken)
    return with_(POSTINGS + ", " + ", ".join(steps), union)


SNIPPET_CARDS = f"""
cards AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN {collapse("coalesce(salary_text, '')")} ELSE '' END AS given,
  {collapse("concat_ws(' ', job_title, company, location, salary_text, job_description)")} AS card FROM postings),"""
LISTING_CARDS = f"""
cards AS (SELECT pos, {collapse("coalesce(salary_text, '')")} AS given,
  {collapse(f"concat_ws(' ', job_title, company, location, salary_text, job_description, {q(FILLER)})")} AS card FROM postings),"""
SNIPPET_OF = """
words AS (SELECT pos, given, string_split(card, ' ') AS w FROM cards),
marks AS (SELECT *, list_filter(range(1, len(w) + 1),
  lambda i: regexp_matches(lower(w[i]), 'rp|idr|juta|jt'))[1:3] AS spots FROM words)
SELECT pos, CASE WHEN given <> '' THEN given ELSE array_to_string(list_transform(spots,
  lambda i: array_to_string(w[greatest(i - 6, 1):least(i + 9, len(w))], ' ')), ' | ') END AS salary_text
FROM marks"""
SNIPPET = SNIPPET_CARDS + SNIPPET_OF
SNIPPET_OF_CTE = "WITH " + SNIPPET_OF.strip()

GUESSES = PAY + f""",
guesses AS (SELECT salary_range_label AS actual,
  {pick(BAND_LABELS, f"(salary_range_id + CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END) % {len(BAND_LABELS)}")} AS predicted
  FROM pay WHERE salary_range_label <> 'unknown')"""

SPLIT = """
classes AS (SELECT salary_range_label, count(*) AS n FROM {src} WHERE salary_range_label <> 'unknown' GROUP BY ALL),
totals AS (SELECT sum(n) AS total, count(*) AS k, min(n) AS smallest FROM classes),
shares AS (SELECT c.*, total, total - CAST(ceil(total * 0.2::DOUBLE) AS BIGINT) AS train_total,
  smallest >= 2 AND total >= 5 * k AS stratified FROM classes c, totals),
floors AS (SELECT *, (train_total * n) // total AS fl, (train_total * n) % total AS rest FROM shares),
sizes AS (SELECT salary_range_label, n, stratified, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, salary_range_label)
  <= train_total - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM floors)"""

FILES = "printf('raw_batch_%02d.csv', piece)"


# The test pages have plain anchors, no card elements and a handful of entities, so plain patterns
# can say what the page operators must find. The general cases are tests on small pages.
PAGE_TEXT = collapse("""regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html,
  '<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'gs'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', chr(169)),
  '&middot;', chr(183)), '&amp;?', '&', 'g')""")
PAGES = f"""
anchors AS (SELECT page_id, url, generate_subscripts(h, 1) AS i, unnest(h) AS href, unnest(t) AS title FROM (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)),
firsts AS (SELECT page_id, i, regexp_extract(url, '^[a-z]+://[^/]+') || href AS job_url,
    {collapse('title')} AS job_title FROM anchors WHERE length({collapse('title')}) >= 3
  QUALIFY row_number() OVER (PARTITION BY page_id, job_url ORDER BY i) = 1),
links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS link_no,
  job_url, job_title FROM firsts),
cards AS (SELECT *, '' AS card_text, '' AS company, '' AS location, '' AS salary_text FROM links),
details AS (SELECT page_id, url, substring({PAGE_TEXT}, 1, 12000) AS detail_text FROM pages)"""


def oracle() -> dict[str, str]:
    labelled = PAY + "," + SPLIT.format(src="pay")
    whole_batches = ", ".join(
        f"({i}, {q(name)}, {j}, {q(word)})" for i, (name, words) in
        enumerate(KEYWORD_BATCHES.items(), 1) for j, word in enumerate(words, 1))
    names = list(KEYWORD_BATCHES)
    na = inlist(NA_TOKENS)
    band_list = qlist(BAND_LABELS)
    cell = "CASE WHEN {c} NOT IN " + na + " THEN {c} END AS {c}"
    report_classes = """
p AS (SELECT predicted AS label, count(*) AS np FROM guesses GROUP BY 1),
a AS (SELECT actual AS label, count(*) AS na, count(*) FILTER (actual = predicted) AS hits FROM guesses GROUP BY 1),
j AS (SELECT coalesce(a.label, p.label) AS label, coalesce(hits, 0) AS hits, coalesce(na, 0) AS support,
  coalesce(np, 0) AS np FROM a FULL JOIN p ON a.label = p.label),
s AS (SELECT label, hits, support, CASE WHEN np = 0 THEN 0.0 ELSE hits::DOUBLE / np END AS pr,
  CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END AS re FROM j),
f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM s)"""
    accepted_columns = "pos, source_keyword, job_title, job_url, salary_range_label"
    sql = {
        "salary_parse": with_(PAY, "SELECT pos, salary_min, salary_max, salary_avg, salary_available FROM pay"),
        "salary_parse_documents": with_(
            parsed("documents", "doc_id", collapse("lower(text)")),
            "SELECT doc_id, salary_min, salary_max, salary_avg, salary_range_id, salary_range_label FROM pay"),
        "salary_band_distribution": with_(
            PAY, "SELECT salary_range_label, count(*) AS n FROM pay GROUP BY 1"),
        "relabel_bands": f"""
WITH s AS (SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN 'inf'
  WHEN o_orderkey % 17 = 0 THEN '5000000d' WHEN o_orderkey % 11 <> 0
  THEN CAST(CAST(floor(o_totalprice * 30) AS BIGINT) AS VARCHAR) || '.0' END AS a FROM orders),
n AS (SELECT source_id, CASE WHEN regexp_matches(a, '^[0-9.]+$') THEN TRY_CAST(a AS DOUBLE) END AS salary_avg FROM s)
SELECT source_id, salary_avg, CAST(source_id % 7 AS INTEGER) AS salary_range_id,
  {label('salary_avg')} AS salary_range_label FROM n""",
        "band_override": f"""
WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * 30) AS BIGINT) AS a FROM orders)
SELECT o_orderkey, {band('a', FIVE_BANDS)} AS range_id, {label('a', FIVE_BANDS)} AS range_label FROM s""",
        "salary_snippet_window": with_(POSTINGS + "," + SNIPPET, ""),
        "normalize_text": f"""
SELECT doc_id, {collapse("lower(concat_ws(' ', source, text))")} AS normalized,
  {collapse("coalesce(text, '')")} AS cleaned FROM documents""",
        "min_gpa": with_(POSTINGS + "," + TEXTS, f"SELECT pos, {GPA} AS min_gpa FROM texts"),
        "experience_years": with_(
            POSTINGS + "," + TEXTS, f"SELECT pos, CAST({YEARS} AS INTEGER) AS experience_years FROM texts"),
        "keyword_flags": with_(POSTINGS + "," + TEXTS, f"SELECT pos, {FLAGS} FROM texts"),
        "job_family": with_(POSTINGS + "," + TEXTS, f"SELECT pos, {FAMILY} AS job_family FROM texts"),
        "region_group": with_(POSTINGS, f"SELECT pos, {REGION} AS region_group FROM postings"),
        "region_repair": with_(POSTINGS, f"SELECT pos, location, {REPAIRED} AS region_group FROM postings"),
        "region_repair_diff": with_(POSTINGS, f"""
SELECT region, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after FROM (
  SELECT {REGION} AS region, 1 AS b, 0 AS a FROM postings UNION ALL
  SELECT {REPAIRED}, 0, 1 FROM postings) GROUP BY region"""),
        "region_drilldown": with_(POSTINGS, f"""
SELECT * FROM (SELECT job_title, company, location, {REPAIRED} AS region_group FROM postings)
WHERE region_group = 'kalimantan'"""),
        "slug_names": r"""
SELECT p_partkey, trim(regexp_replace(lower(trim(' ' || p_name || '! ' || ' / ' || p_brand || ' / ' || p_type)),
  '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""",
        "proxy_dataset": with_(PROXY, f"SELECT {PROXY_OUT} FROM proxy"),
        "rf_ready": with_(PROXY, """
SELECT * EXCLUDE (pos, piece, source_keyword, scraped_at, salary_text, salary_min, salary_max, salary_available)
FROM proxy WHERE salary_available = 1 AND salary_range_label <> 'unknown'"""),
        "dedup_keep_last": with_(POSTINGS, kept("postings", "job_url", "pos DESC", where="job_url IS NOT NULL")),
        "dedup_keep_first": with_(POSTINGS, kept("postings", "job_url", "pos", where="job_url IS NOT NULL")),
        "dedup_keep_nulls": with_(POSTINGS, kept("postings", "job_url", "pos DESC")),
        "dedup_cascade": with_(POSTINGS, kept(
            "postings", "job_title, company", "pos", "* EXCLUDE (job_url) RENAME (job_title AS title)")),
        "dedup_whole_rows": with_(POSTINGS, """
SELECT max(pos) AS pos, source_keyword, job_title, location FROM postings GROUP BY 2, 3, 4"""),
        "seen_url_anti_join": with_(POSTINGS, kept(
            "postings", "job_url", "pos",
            where="piece >= 2 AND job_url IS NOT NULL AND job_url NOT IN "
                  "(SELECT job_url FROM postings WHERE piece < 2 AND job_url IS NOT NULL)")),
        "merge_session": with_(POSTINGS, kept(
            "(SELECT * REPLACE (CASE WHEN piece = 0 THEN NULL ELSE scraped_at END AS scraped_at), "
            "least(piece, 2) AS piece_no FROM postings)",
            "job_url", "least(piece, 2) DESC, pos DESC", where="job_url IS NOT NULL")),
        "merge_latest_wins": with_(POSTINGS, kept(
            "(SELECT *, piece AS piece_no FROM postings)", "job_url", "piece DESC, pos DESC",
            where="job_url IS NOT NULL")),
        "merge_incremental": with_(POSTINGS, kept(
            "postings", "job_url", "piece DESC, pos DESC", where="job_url IS NOT NULL")),
        "merge_first_wins": with_(POSTINGS, kept(
            f"(SELECT *, {FILES} AS source_batch_file FROM postings)", "job_url", "piece, pos")),
        "merge_existing_wins": with_(POSTINGS, kept(
            "(SELECT *, least(piece, 1) AS piece_no FROM postings)", "job_url", "piece_no, pos",
            where="job_url IS NOT NULL")),
        "merge_stats": with_(POSTINGS, f"""
SELECT source_batch_file, count(*) AS rows_before, count(*) FILTER (rn = 1) AS rows_after,
  count(*) FILTER (rn > 1) AS rows_removed FROM (
  SELECT source_batch_file, row_number() OVER (PARTITION BY job_url ORDER BY source_batch_file NULLS FIRST, pos) AS rn
  FROM (SELECT *, CASE WHEN piece < 3 THEN {FILES} END AS source_batch_file FROM postings))
GROUP BY 1"""),
        "low_band_augment": with_(PROXY + f""",
low_raw AS ({kept('postings', 'job_url', 'piece DESC, pos DESC', where='piece < 2 AND job_url IS NOT NULL')}),
low AS (SELECT 1 AS piece_no, p.* FROM proxy p JOIN low_raw l ON p.pos = l.pos
  WHERE p.salary_range_label IN {inlist(LOW_BAND_LABELS)}),
both_ AS (SELECT 0 AS piece_no, p.* FROM proxy p WHERE piece >= 2 AND salary_available = 1
  UNION ALL SELECT * FROM low),
one AS ({kept('both_', 'job_url', 'piece_no DESC, pos DESC', where="job_url <> ''")}),
placed AS (SELECT *, row_number() OVER (PARTITION BY salary_range_label ORDER BY piece_no, pos) AS rn FROM one)""",
            f"""
SELECT piece_no, pos, job_url, CAST(salary_avg AS DOUBLE) AS salary_avg, salary_range_id, salary_range_label,
  job_family, region_group, f_min_gpa FROM placed
WHERE rn <= {QUOTA} OR salary_range_label NOT IN {inlist(LOW_BAND_LABELS)}"""),
        "class_deficit": with_(PAY, f"""
SELECT l.salary_range_label, coalesce(n, 0) AS n, greatest({TARGET_PER_CLASS} - coalesce(n, 0), 0) AS deficit,
  least(coalesce(n, 0), {TARGET_PER_CLASS}) AS capped
FROM (SELECT unnest({band_list}) AS salary_range_label) l
LEFT JOIN (SELECT salary_range_label, count(*) AS n FROM pay GROUP BY 1) c USING (salary_range_label)"""),
        "targets_done": with_(PAY, f"""
SELECT count(*) = {len(BAND_LABELS)} AS done FROM (SELECT salary_range_label FROM pay
  WHERE salary_range_label <> 'unknown' GROUP BY 1 HAVING count(*) >= {TARGET_PER_CLASS})"""),
        "balance_cap": with_(PAY, f"""
SELECT pos, job_title, job_url, salary_avg, salary_range_id, salary_range_label FROM pay
WHERE salary_range_label <> 'unknown'
QUALIFY row_number() OVER (PARTITION BY salary_range_label ORDER BY pos) <= {QUOTA}"""),
        "selective_cap": with_(PAY, f"""
SELECT pos, job_url, salary_avg, salary_range_label FROM pay WHERE salary_range_label <> 'unknown'
QUALIFY salary_range_label NOT IN {inlist(LOW_BAND_LABELS)}
  OR row_number() OVER (PARTITION BY salary_range_label ORDER BY pos) <= {QUOTA}"""),
        "quota_accept": with_(PAY + "," + known_accept(
            "(SELECT * FROM pay WHERE piece > 0)",
            "SELECT salary_range_label, count(*) AS n FROM pay WHERE piece = 0 GROUP BY 1",
            "SELECT job_url FROM postings WHERE piece = 0", QUOTA, BAND_LABELS),
            f"SELECT {accepted_columns} FROM ranked WHERE rn <= room"),
        "low_quota_accept": with_(PAY + "," + known_accept(
            "pay", "SELECT salary_range_label, 0 AS n FROM pay GROUP BY 1",
            "SELECT job_url FROM postings WHERE false", QUOTA, LOW_BAND_LABELS),
            "SELECT pos, job_url, salary_range_label FROM ranked WHERE rn <= room"),
        "stream_quota_full": with_(PAY + "," + known_accept(
            "pay", "SELECT salary_range_label, 0 AS n FROM pay GROUP BY 1",
            "SELECT job_url FROM postings WHERE false", SMALL_QUOTA, BAND_LABELS),
            f"SELECT {accepted_columns} FROM ranked WHERE rn <= room"),
        "quota_run": with_(PAY + "," + known_accept(
            "(SELECT * FROM pay WHERE piece > 0)",
            "SELECT salary_range_label, count(*) AS n FROM pay WHERE piece = 0 GROUP BY 1",
            "SELECT job_url FROM postings WHERE piece = 0", QUOTA, BAND_LABELS) + """,
published AS (SELECT pos, job_url, salary_avg, salary_range_label FROM pay WHERE piece = 0
  UNION ALL SELECT pos, job_url, salary_avg, salary_range_label FROM ranked WHERE rn <= room),
numbered AS (SELECT *, row_number() OVER (ORDER BY pos) AS source_id FROM published)""", """
SELECT source_id, coalesce(job_url, '') AS job_url, salary_avg, salary_range_label FROM numbered
WHERE salary_range_label <> 'unknown'"""),
        "published_combined": with_(PAY + f""",
merged AS ({kept('pay', 'job_url', 'piece DESC, pos DESC', where='job_url IS NOT NULL')}),
numbered AS (SELECT *, row_number() OVER (ORDER BY piece, pos) AS source_id FROM merged)""", """
SELECT source_id, job_url, salary_avg, salary_range_label FROM numbered WHERE salary_range_label <> 'unknown'"""),
        "keyword_cap": _keyword_cap(),
        "keyword_cap_known": _keyword_cap(
            more="piece > 0 AND job_url NOT IN (SELECT job_url FROM postings WHERE piece = 0 AND job_url IS NOT NULL)"),
        "candidate_label": with_(POSTINGS + "," + parsed("postings", "pos", collapse(
            "lower(concat_ws(' ', salary_text, job_title, concat_ws(' ', job_title, company, location), "
            "job_description))")), "SELECT pos, salary_avg, salary_range_label FROM pay"),
        "batch_listing": with_(POSTINGS + f""",
registry(batch_no, batch_name, keyword_no, keyword) AS (VALUES {whole_batches}),
found AS (SELECT source_keyword AS keyword, count(*) AS c FROM postings GROUP BY 1)""", """
SELECT batch_no, batch_name, count(*) AS keywords, CAST(coalesce(sum(c), 0) AS BIGINT) AS postings,
  string_agg(keyword, ', ' ORDER BY keyword_no) AS keyword_list
FROM registry LEFT JOIN found USING (keyword) GROUP BY 1, 2"""),
        "batch_select": with_(POSTINGS + f""",
arguments AS (SELECT DISTINCT unnest(string_split(source_keyword || ' ' || job_title, ' ')) AS argument FROM postings
  UNION SELECT CAST(p_size AS VARCHAR) FROM part),
hits AS (SELECT argument, list_filter({qlist(names)}, lambda n: contains(lower(n), lower(argument))) AS h,
  TRY_CAST(argument AS INTEGER) AS no FROM arguments)""", f"""
SELECT argument,
  CASE WHEN no IS NOT NULL THEN CASE WHEN no BETWEEN 1 AND {len(names)} THEN {qlist(names)}[no] END
       WHEN len(h) = 1 THEN h[1] END AS batch_name,
  CASE WHEN no IS NOT NULL THEN CASE WHEN no NOT BETWEEN 1 AND {len(names)} THEN 'no such number' END
       WHEN len(h) = 1 THEN NULL WHEN len(h) > 1 THEN 'ambiguous' ELSE 'not found' END AS problem FROM hits"""),
        "crawl_frontier": with_(POSTINGS + """,
words AS (SELECT DISTINCT source_keyword AS keyword FROM postings
  UNION SELECT DISTINCT p_name || ' ~*' || p_brand FROM part),
paged AS (SELECT keyword, CAST(unnest(range(1, 11)) AS INTEGER) AS page FROM words)""", f"""
SELECT keyword, page, '{SITE}/jobs?keywords=' || replace(url_encode(keyword), '%20', '+')
  || '&page=' || page AS search_url FROM paged"""),
        "low_wage_frontier": with_(POSTINGS + f""",
words AS (SELECT unnest({qlist(LOW_WAGE_KEYWORDS)}) AS keyword,
  CAST(unnest(range(1, {len(LOW_WAGE_KEYWORDS)} + 1)) AS INTEGER) AS keyword_no),
texts AS (SELECT {collapse("lower(concat_ws(' ', job_title, job_description))")} AS t FROM postings),
found AS (SELECT keyword, count(*) AS c FROM words JOIN texts ON contains(t, keyword) GROUP BY 1),
paged AS (SELECT *, CAST(unnest(range(1, 41)) AS INTEGER) AS page FROM words LEFT JOIN found USING (keyword))""", f"""
SELECT keyword_no, keyword, coalesce(c, 0) AS mentioned, page,
  '{SITE}/jobs?keywords=' || replace(url_encode(keyword), '%20', '+') || '&page=' || page AS search_url FROM paged"""),
        "alumni_bands": f"""
WITH s AS (SELECT CAST(c_custkey AS INTEGER) AS respondent_id, c_mktsegment AS employment_industry,
  CASE WHEN c_custkey % 10 <> 0 THEN CAST(floor(c_acctbal * 1000) AS BIGINT) END AS starting_salary FROM customer)
SELECT *, {band('starting_salary')} AS salary_range_id, {label('starting_salary')} AS salary_range_label FROM s""",
        "page_links": with_(PAGES, "SELECT page_id, link_no, job_url, job_title FROM links"),
        "page_cards": with_(PAGES, "SELECT * FROM cards"),
        "listing_cards": with_(POSTINGS + "," + LISTING_CARDS + "paid AS (" + SNIPPET_OF_CTE + ")", f"""
SELECT p.pos AS page_id, CAST(1 AS INTEGER) AS link_no, 'https://jobs.example.org/job/' || p.pos || '?ref=1' AS job_url,
  {collapse('job_title')} AS job_title, card AS card_text, {collapse("coalesce(company, '')")} AS company,
  {collapse("coalesce(location, '')")} AS location, paid.salary_text
FROM postings p JOIN cards ON cards.pos = p.pos JOIN paid ON paid.pos = p.pos"""),
        "listing_details": with_(POSTINGS, f"""
SELECT pos AS page_id, {collapse(f"concat_ws(' ', job_description, {q(FILLER)})")} AS detail_text FROM postings"""),
        "page_text": with_(PAGES, "SELECT * FROM details"),
        "page_postings": with_(PAGES, f"""
, one AS ({kept('cards', 'job_url', 'page_id, link_no')}),
found AS ({kept('details', 'url', 'page_id')})
SELECT one.*, detail_text, {collapse("concat_ws(' ', card_text, detail_text)")} AS job_description
FROM one LEFT JOIN found ON url = job_url"""),
        "delimited_layouts": with_(POSTINGS, "SELECT pos, piece, 'raw batch ' || piece || ' 50%' AS source, " + ", ".join(
            cell.format(c=c) for c in RAW.split(", ")) + " FROM postings"),
        "row_id_null_groups": with_(POSTINGS, """
SELECT *, row_number() OVER (ORDER BY grp NULLS FIRST, pos NULLS FIRST) AS source_id FROM (
  SELECT CASE WHEN pos % 6 <> 0 THEN 'g' || piece END AS grp, CASE WHEN pos <> 1 THEN pos END AS pos, job_title
  FROM postings)"""),
        "impute_embeddings": "SELECT " + ", ".join(
            f"median(CAST(embedding[{i + 1}] AS DOUBLE)) AS e{i}" for i in range(64)) + """,
  (SELECT CAST(label AS VARCHAR) FROM embeddings WHERE label IS NOT NULL GROUP BY label
   ORDER BY count(*) DESC, CAST(label AS VARCHAR) LIMIT 1) AS salary_range_label FROM embeddings""",
        "delimited_round_trip": with_(POSTINGS, "SELECT pos, piece, " + ", ".join(
            cell.format(c=c) for c in RAW.split(", ")) + " FROM postings"),
        "stream_dedup_quota": with_(PAY + "," + known_accept(
            "pay", "SELECT salary_range_label, 0 AS n FROM pay GROUP BY 1",
            "SELECT job_url FROM postings WHERE pos % 50 = 0", QUOTA, BAND_LABELS),
            f"SELECT {accepted_columns} FROM ranked WHERE rn <= room"),
        "stream_new_urls": with_(
            POSTINGS, "SELECT DISTINCT job_url FROM postings WHERE job_url IS NOT NULL"),
        "stream_class_counts": with_(
            PAY, "SELECT salary_range_label, count(*) AS n FROM pay GROUP BY 1"),
        "class_weights": with_(labelled, """
SELECT salary_range_label, n, (SELECT sum(n) FROM classes)::DOUBLE / ((SELECT count(*) FROM classes) * n) AS weight
FROM classes"""),
        "stratified_split_sizes": with_(labelled, """
SELECT salary_range_label, n, n_train, n - n_train AS n_test, stratified FROM sizes"""),
        "stratified_split": with_(labelled, """
SELECT pos, salary_range_label, row_number() OVER (PARTITION BY salary_range_label
  ORDER BY md5(CAST(pos AS VARCHAR) || ':42'), pos) <= n - n_train AS is_test
FROM pay JOIN sizes USING (salary_range_label)"""),
        "rf_shape": with_(PROXY + "," + SPLIT.format(src="proxy") + """,
marked AS (SELECT p.*, row_number() OVER (PARTITION BY salary_range_label
  ORDER BY md5(CAST(pos + 1 AS VARCHAR) || ':42'), pos) <= n - n_train AS is_test
  FROM proxy p JOIN sizes USING (salary_range_label)),
named AS (SELECT 'cat__job_family_' || job_family AS f FROM marked WHERE NOT is_test
  UNION SELECT 'cat__region_group_' || region_group FROM marked WHERE NOT is_test
  UNION SELECT 'num__' || unnest(""" + qlist(FLAG_COLUMNS) + """))""", """
SELECT 'n_rows' AS item, count(*)::DOUBLE AS value FROM marked
UNION ALL SELECT 'n_train', count(*) FILTER (NOT is_test)::DOUBLE FROM marked
UNION ALL SELECT 'n_test', count(*) FILTER (is_test)::DOUBLE FROM marked
UNION ALL SELECT 'n_classes', count(DISTINCT salary_range_label)::DOUBLE FROM marked
UNION ALL SELECT 'importance', 1::DOUBLE
UNION ALL SELECT 'feature ' || f, 1::DOUBLE FROM named
UNION ALL SELECT 'support ' || salary_range_label, count(*)::DOUBLE FROM marked WHERE is_test GROUP BY ALL
UNION ALL SELECT 'target ' || salary_range_label, count(*)::DOUBLE FROM marked GROUP BY ALL"""),
        "impute_median_mode": with_(PROXY, """
, holes AS (SELECT CASE WHEN pos % 5 <> 0 THEN f_min_gpa END AS g,
  CASE WHEN pos % 3 <> 0 THEN f_experience_years_min END AS y,
  CASE WHEN pos % 4 <> 0 THEN job_family END AS f, CASE WHEN pos % 6 <> 0 THEN region_group END AS r FROM proxy),
fc AS (SELECT f FROM holes WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1),
rc AS (SELECT r FROM holes WHERE r IS NOT NULL GROUP BY r ORDER BY count(*) DESC, r LIMIT 1)
SELECT CAST(median(g) AS DOUBLE) AS f_min_gpa, CAST(median(y) AS DOUBLE) AS f_experience_years_min,
  (SELECT f FROM fc) AS job_family, (SELECT r FROM rc) AS region_group FROM holes"""),
        "confusion_matrix": with_(GUESSES, f"""
SELECT l.actual, {", ".join(f'count(*) FILTER (predicted = {q(v)}) AS "{v}"' for v in BAND_LABELS)}
FROM (SELECT unnest({band_list}) AS actual) l LEFT JOIN guesses g ON g.actual = l.actual GROUP BY l.actual"""),
        "confusion_cells": with_(GUESSES + """,
labels AS (SELECT actual AS label FROM guesses UNION SELECT predicted FROM guesses)""", """
SELECT a.label AS actual, p.label AS predicted, count(g.actual) AS n FROM labels a CROSS JOIN labels p
LEFT JOIN guesses g ON g.actual = a.label AND g.predicted = p.label GROUP BY 1, 2"""),
        "classification_report": with_(GUESSES + "," + report_classes, """
SELECT label, pr AS precision, re AS recall, f1, support FROM f
UNION ALL SELECT 'accuracy', sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support),
  sum(hits)::DOUBLE / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f"""),
        "prediction_accuracy": with_(
            GUESSES, "SELECT avg(CAST(actual = predicted AS DOUBLE)) AS accuracy FROM guesses"),
    }
    # Streams that must give what the batch operator gives.
    sql["stream_seen_ledger"] = sql["seen_url_anti_join"]
    sql["stream_quota_batches"] = sql["quota_accept"]
    # The same table by its single steps.
    sql["low_band_tables"] = sql["low_band_augment"]
    sql["page_postings_joined"] = sql["page_postings"]
    return {name: text.strip() for name, text in sql.items()}
