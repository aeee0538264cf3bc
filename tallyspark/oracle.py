"""DuckDB SQL for the rows of the poll queries. Only the mapping of the test tables to poll tables is shared with them."""

from __future__ import annotations

from .functions.rules import CATALOG, ROLLUP
from .plans.views import ANSWERS, COLUMNS, QUESTIONS, SOURCES


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _pick(values: tuple, n: str) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values)) + " END"


_POLLS = f"""polls AS (
  SELECT *, {_pick(tuple(t for t, _ in QUESTIONS), "question_no")} AS title, {_pick(tuple(p for _, p in QUESTIONS), "question_no")} AS prompt
  FROM (SELECT o_orderkey AS poll_key, {_pick(SOURCES, "o_custkey % 4")} AS source_id, CAST(o_custkey % 4 AS INTEGER) AS source_rank, CAST(o_orderdate AS DATE) AS published_on,
    'poll-' || CAST(o_orderkey // 2 AS VARCHAR) AS article_url, CAST(o_orderkey % {len(QUESTIONS)} AS INTEGER) AS question_no FROM orders))"""
_LINES = "lines AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_CELLS = f"""{_POLLS}, {_LINES}, cells AS (
  SELECT p.poll_key AS structure_idx, p.source_id, p.source_rank, p.title, p.prompt, l.l_linenumber AS row_idx, {_pick(ANSWERS, "l.l_linenumber - 1")} AS row_label, k.col_idx,
    CASE k.col_idx WHEN 0 THEN 'Total' WHEN 1 THEN {_pick(tuple(c for c, _ in COLUMNS), "p.poll_key % 7")} ELSE {_pick(tuple(c for c, _ in COLUMNS), "p.poll_key % 5")} END AS column_label,
    CASE k.col_idx WHEN 0 THEN NULL WHEN 1 THEN {_pick(tuple(g for _, g in COLUMNS), "p.poll_key % 7")} ELSE {_pick(tuple(g for _, g in COLUMNS), "p.poll_key % 5")} END AS group_title,
    l.v + k.col_idx * (l.l_linenumber % 3) AS value
  FROM lines l JOIN polls p ON l.l_orderkey = p.poll_key, (VALUES (0), (1), (2)) AS k(col_idx))"""
#: Topic of each wording by hand: source rules go first, so that some wordings differ by source.
_TOPIC = """CASE
  WHEN source_id = 'gallup' AND low LIKE '%president%' AND low LIKE '%approval%' THEN 'presidential-approval|trend_comparable'
  WHEN source_id = 'yougov' AND (low LIKE '%direction of country%' OR (low LIKE '%right direction%' AND low LIKE '%wrong track%')) THEN 'right-direction|exact_wording'
  WHEN source_id = 'yougov' AND low LIKE '%trump approval%' THEN 'presidential-approval|equivalent_wording'
  WHEN source_id = 'ipsos' AND low LIKE '%cp1.%' THEN 'important-problem|exact_wording'
  WHEN source_id = 'ipsos' AND low LIKE '%tm1128y17\\_25.%' ESCAPE '\\' THEN 'foreign-policy-approval|exact_wording'
  WHEN (low LIKE '%approve or disapprove%' OR low LIKE '%approval%' OR low LIKE '%job performance%') AND (low LIKE '%president%' OR low LIKE '%donald trump%' OR low LIKE '%trump approval%') THEN 'presidential-approval|equivalent_wording'
  WHEN low LIKE '%right direction%' AND low LIKE '%wrong track%' THEN 'right-direction|exact_wording'
  WHEN (low LIKE '%u.s. congress%' OR low LIKE '%generic ballot%') AND low LIKE '%democratic%' AND low LIKE '%republican%' THEN 'generic-ballot|equivalent_wording'
  WHEN low LIKE '%most important problem%' OR low LIKE '%main problem facing%' THEN 'important-problem|equivalent_wording'
  WHEN low LIKE '%handling the economy%' OR low LIKE '%u.s. economy%' THEN 'economy-approval|equivalent_wording'
  WHEN low LIKE '%inflation%' OR low LIKE '%rising prices%' OR low LIKE '%cost of living%' THEN 'inflation-approval|equivalent_wording'
  WHEN low LIKE '%immigration%' AND (low LIKE '%approve%' OR low LIKE '%handling%') THEN 'immigration-approval|equivalent_wording'
  WHEN low LIKE '%foreign policy%' AND (low LIKE '%approve%' OR low LIKE '%handling%') THEN 'foreign-policy-approval|equivalent_wording'
  WHEN low LIKE '%donald trump%' AND low LIKE '%favorable%' AND low LIKE '%unfavorable%' THEN 'trump-favorability|equivalent_wording' END"""


def _slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


_MATCHED = f"""{_CELLS}, matched AS (SELECT *, split_part(t, '|', 1) AS topic_id FROM (SELECT *, {_TOPIC} AS t FROM (SELECT *, lower(title || ' ' || prompt) AS low FROM cells)) WHERE t IS NOT NULL)"""
_DEMO = """CASE lower(column_label) WHEN 'total' THEN 'total' WHEN 'dem' THEN 'party-democrat' WHEN 'republican' THEN 'party-republican' WHEN 'male' THEN 'gender-male' WHEN '18-29' THEN 'age-18-29' WHEN 'rural' THEN 'custom-rural' WHEN 'white' THEN 'race-white' ELSE 'party-independent' END"""
_GROUP = """CASE group_title WHEN 'Party ID' THEN 'party-id' WHEN 'Sex' THEN 'gender' WHEN 'Age' THEN 'age' WHEN 'Area Type' THEN 'area-type' WHEN 'Race' THEN 'race' END"""
#: The seven labels; in approval topics two pairs are components and one is the net row.
_ANSWER = f"""CASE WHEN topic_id LIKE '%-approval' AND row_idx IN (1, 2, 6) THEN 'approve|Approve|' || CASE row_idx WHEN 6 THEN '3' ELSE '1' END
  WHEN topic_id LIKE '%-approval' AND row_idx IN (3, 4) THEN 'disapprove|Disapprove|1' WHEN row_idx = 5 THEN 'unsure|Unsure|3'
  WHEN topic_id LIKE '%-approval' OR topic_id IN ('trump-favorability', 'right-direction', 'generic-ballot') THEN CASE WHEN row_idx = 7 THEN 'skipped|Skipped|3' ELSE {_slug("row_label")} || '|' || row_label || '|3' END
  WHEN row_idx = 7 THEN 'skipped|Skipped|3' ELSE CASE WHEN topic_id = 'important-problem' THEN 'issue-' ELSE '' END || {_slug("row_label")} || '|' || row_label || '|3' END"""


def _rolled(source: str, keys: str) -> str:
    return f"""SELECT {keys}, answer_id, CASE WHEN max(p) = 3 THEN arg_min(label, row_idx) FILTER (p = 3) ELSE arg_min(label, row_idx) FILTER (p = 1) END AS answer_label,
      CASE WHEN max(p) = 3 THEN arg_min(value, row_idx) FILTER (p = 3) ELSE sum(value) FILTER (p = 1) END AS value
    FROM (SELECT *, split_part(a, '|', 1) AS answer_id, split_part(a, '|', 2) AS label, CAST(split_part(a, '|', 3) AS INTEGER) AS p FROM (SELECT *, {_ANSWER} AS a FROM {source})) GROUP BY {keys}, answer_id"""


_ANSWERS = f"""{_MATCHED}, named AS (SELECT *, {_DEMO} AS demographic_id, {_GROUP} AS group_id FROM matched),
  firsts AS (SELECT structure_idx, demographic_id, min(col_idx) AS col_idx FROM named GROUP BY ALL),
  answers AS ({_rolled("(SELECT n.* FROM named n JOIN firsts f ON n.structure_idx = f.structure_idx AND n.demographic_id = f.demographic_id AND n.col_idx = f.col_idx)", "structure_idx, source_rank, topic_id, demographic_id, column_label, group_id, group_title")})"""
_POOLED = f"""{_ANSWERS}, keyed AS (SELECT *, CAST(source_rank AS BIGINT) * 1000000000000 + structure_idx AS o FROM answers),
  demo AS (SELECT topic_id, demographic_id, arg_min(column_label, o) AS demographic_label, arg_min(group_id, o) AS group_id, arg_min(group_title, o) AS group_label FROM keyed GROUP BY ALL),
  pooled AS (SELECT k.topic_id, k.demographic_id, d.demographic_label, d.group_id, d.group_label, k.answer_id, arg_min(k.answer_label, k.o) AS id, round(avg(k.value), 6) AS value, count(*) AS observation_count
    FROM keyed k JOIN demo d ON k.topic_id = d.topic_id AND k.demographic_id = d.demographic_id GROUP BY 1, 2, 3, 4, 5, 6)"""
_QUESTION = "regexp_replace(trim(prompt), '^[0-9]+[a-zA-Z]?\\.\\s*', '')"
_PART = f"""questions AS (SELECT *, {_pick(tuple(t for t, _ in QUESTIONS), "n")} AS title, {_pick(tuple(p for _, p in QUESTIONS), "n")} AS prompt FROM (SELECT *, {_pick(SOURCES, "p_partkey % 4")} || ':' || CAST(p_partkey AS VARCHAR) AS obs_id, p_partkey % {len(QUESTIONS)} AS n FROM part))"""
_WS = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _search(x: str) -> str:
    for old, new in (("u.s.", " us "), ("u. s.", " us "), ("united states", " us "), ("don''t", " dont "), ("don’t", " dont ")):
        x = f"replace({x}, '{old}', '{new}')"
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


#: Lower case of A-Z only.
def _ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_CHOSEN = "min(CASE WHEN lower(column_label) = '{0}' THEN col_idx END)"

ORACLE_SQL = {
    "pooled_topic_by_demographic": f"WITH {_POOLED} SELECT * FROM pooled WHERE topic_id = 'presidential-approval'",
    "pooled_all_topics": f"WITH {_POOLED} SELECT * FROM pooled",
    "pooled_nested": f"WITH {_POOLED} SELECT topic_id, demographic_id, count(*) AS n_answers, string_agg(id, '|' ORDER BY id) AS ids FROM pooled GROUP BY ALL",
    "answer_rollup": f"WITH {_MATCHED} {_rolled('(SELECT * FROM matched WHERE col_idx = 0)', 'structure_idx, topic_id')}",
    "demographic_mapping": f"WITH {_CELLS} SELECT column_label, {_DEMO} AS demographic_id, column_label AS demographic_label, {_GROUP} AS group_id, group_title AS group_label, count(*) AS n_cells FROM cells GROUP BY ALL",
    "dedupe_demographics": f"WITH {_ANSWERS} SELECT structure_idx, count(DISTINCT demographic_id) AS n_demographics, sum(value) AS total FROM answers GROUP BY ALL",
    "structures_to_answers": f"WITH {_CELLS} SELECT structure_idx, CAST(row_number() OVER (PARTITION BY structure_idx ORDER BY row_idx) - 1 AS INTEGER) AS row_idx, row_label, 'Total' AS column_label, value + CASE WHEN structure_idx % 3 = 2 THEN 1 ELSE 0 END AS value FROM cells WHERE col_idx = 0",
    "topic_matching": f"""WITH {_POLLS}, m AS (SELECT source_id, title, {_TOPIC} AS t FROM (SELECT *, lower(title || ' ' || prompt) AS low FROM polls))
      SELECT source_id, title, split_part(t, '|', 1) AS topic_id, split_part(t, '|', 2) AS compatibility, CASE split_part(t, '|', 1) WHEN 'presidential-approval' THEN 'Presidential approval' WHEN 'right-direction' THEN 'Right direction / wrong track' WHEN 'generic-ballot' THEN 'Generic congressional ballot'
        WHEN 'important-problem' THEN 'Most important problem' WHEN 'economy-approval' THEN 'Economy approval' WHEN 'inflation-approval' THEN 'Inflation and cost of living approval' WHEN 'immigration-approval' THEN 'Immigration approval' WHEN 'foreign-policy-approval' THEN 'Foreign policy approval' WHEN 'trump-favorability' THEN 'Donald Trump favorability' END AS catalog_label, count(*) AS n
      FROM m GROUP BY ALL""",
    "latest_n_polls": f"WITH {_POLLS} SELECT source_id, poll_key, published_on, place FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_on DESC, poll_key) AS place FROM polls WHERE published_on >= DATE '2001-02-02') WHERE place <= 25",
    "scope_cutoffs": f"WITH {_POLLS} SELECT source_id, min(published_on - 1) AS min_days, min(published_on - 7) AS min_weeks, CAST(min(published_on - INTERVAL 1 MONTH) AS DATE) AS min_months, CAST(min(published_on - INTERVAL 1 YEAR) AS DATE) AS min_years, CAST(max(published_on - INTERVAL 1 MONTH) AS DATE) AS max_months, CAST(max(published_on - INTERVAL 1 YEAR) AS DATE) AS max_years FROM polls GROUP BY ALL",
    "dedupe_releases": f"WITH {_POLLS} SELECT source_id, article_url, min(poll_key) AS poll_key, arg_min(published_on, poll_key) AS published_on, count(*) AS copies FROM polls GROUP BY ALL",
    "ingest_accounting": f"""WITH {_POLLS}, s AS (SELECT source_id, poll_key, article_url, CASE WHEN poll_key % 11 = 0 THEN 'failed' WHEN poll_key % 7 = 0 THEN 'skipped' ELSE 'ok' END AS status FROM polls), f AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY poll_key) AS k FROM s WHERE status = 'failed')
      SELECT s.source_id, count(*) AS candidates, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'ok') AS structures, any_value(g.t) AS failure_samples, count(*) FILTER (status = 'failed') = count(*) AS all_failed
      FROM s LEFT JOIN (SELECT source_id, string_agg(article_url, '|' ORDER BY poll_key) AS t FROM f WHERE k <= 3 GROUP BY 1) g ON s.source_id = g.source_id GROUP BY 1""",
    "keyword_filter": f"SELECT doc_id FROM documents WHERE contains({_ascii_lower('text')}, 'the')",
    "source_overview": f"""WITH {_POLLS}, c AS (SELECT source_id, count(*) AS n, count(*) FILTER (poll_key % 3 < 2) AS g FROM polls WHERE source_id <> 'yougov' GROUP BY 1), s AS (SELECT unnest(['emerson', 'gallup', 'ipsos', 'yougov']) AS source_id)
      SELECT s.source_id, CASE WHEN n IS NULL THEN 'Unavailable' ELSE 'Synced' END AS status, coalesce(n, 0) AS structures, coalesce(g, 0) AS graphs, coalesce(n, 0) || CASE WHEN n = 1 THEN ' structure, ' ELSE ' structures, ' END || coalesce(g, 0) || CASE WHEN g = 1 THEN ' graph' ELSE ' graphs' END AS summary FROM s LEFT JOIN c ON s.source_id = c.source_id""",
    "collection_subtitles": f"WITH {_POLLS} SELECT source_id, 'Latest collection: ' || min(published_on) || ' to ' || max(published_on) || ' (' || count(*) || ' articles)' AS subtitle FROM polls GROUP BY 1",
    "text_normalise": f"SELECT doc_id, md5(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS normal_md5, md5({_search(_ascii_lower('text'))}) AS search_md5, md5(trim(regexp_replace({_ascii_lower('text')}, '[^a-z0-9]+', '-', 'g'), '-')) AS slug_md5 FROM documents",
    "intent_detection": f"""WITH {_PART}, t AS (SELECT obs_id, {_search("lower(title || ' ' || prompt)")} AS x FROM questions)
      SELECT obs_id, CASE WHEN x LIKE '%have you heard%' OR x LIKE '%heard about%' THEN 'awareness' WHEN x LIKE '%vote for%' OR x LIKE '%would you vote%' THEN 'vote-choice' WHEN (x LIKE '%support%' AND x LIKE '%oppose%') OR x LIKE 'support for %' OR x LIKE '% support for %' THEN 'support-oppose'
        WHEN (x LIKE '%approve%' AND x LIKE '%disapprove%') OR x LIKE '%approval%' THEN 'approval' WHEN (x LIKE '%favorable%' AND x LIKE '%unfavorable%') OR x LIKE '%favorability%' THEN 'favorability' WHEN x LIKE '%right direction%' AND x LIKE '%wrong track%' THEN 'direction' END AS intent FROM t""",
    "iso_dates_in_text": f"WITH {_POLLS} SELECT poll_key, CASE WHEN poll_key % 5 = 0 THEN NULL ELSE CAST(published_on AS VARCHAR) END AS poll_date FROM polls",
    "text_dates": f"WITH {_POLLS} SELECT poll_key, published_on AS long_date, published_on AS short_date FROM polls",
    "trend_series": f"""WITH {_CELLS}, q AS (SELECT *, {_QUESTION} AS question FROM cells), w AS (SELECT structure_idx, coalesce({_CHOSEN.format('male')}, min(col_idx)) AS c FROM q GROUP BY 1), v AS (SELECT q.question, q.structure_idx, arg_min(q.value, q.row_idx) AS value FROM q JOIN w ON q.structure_idx = w.structure_idx AND q.col_idx = w.c GROUP BY 1, 2)
      SELECT question, structure_idx, value, row_number() OVER (PARTITION BY question ORDER BY structure_idx DESC) AS place FROM v""",
    "latest_snapshot": f"""WITH {_CELLS}, q AS (SELECT *, {_QUESTION} AS question FROM cells), f AS (SELECT question, min(structure_idx) AS s FROM q GROUP BY 1), w AS (SELECT structure_idx, coalesce({_CHOSEN.format('republican')}, min(col_idx)) AS c FROM q GROUP BY 1)
      SELECT q.question, q.structure_idx, q.row_idx, q.row_label, q.value FROM q JOIN f ON q.question = f.question AND q.structure_idx = f.s JOIN w ON q.structure_idx = w.structure_idx AND q.col_idx = w.c""",
    "wide_series": f"WITH {_CELLS} SELECT structure_idx, row_idx, row_label, " + ", ".join(f"arg_min(value, col_idx) FILTER (column_label = '{c}') AS {c.lower()}" for c in ("Total", "Dem", "Republican", "Male")) + " FROM cells GROUP BY 1, 2, 3",
    "builder_options": f"WITH {_CELLS} SELECT {_QUESTION} AS question, column_label, min(structure_idx) AS first_seen, CAST(min(structure_idx * 10 + col_idx) % 10 AS INTEGER) AS first_col FROM cells GROUP BY 1, 2",
    "page_urls": """SELECT page_id, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') AS clean_url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, ends_with(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), 'example.com') AND contains(url, '/en/') AND NOT contains(url, '/en/1') AS is_article, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') || '/dataset.csv' AS dataset_url FROM pages""",
    "page_assets": """SELECT page_id, 'stub' AS kind, 'Poll ' || page_id AS title, 'https://polls.example.com/poll/' || page_id AS url FROM pages UNION ALL SELECT page_id, 'chart', 'Gallup chart', 'https://datawrapper.dwcdn.net/' || page_id || '/dataset.csv' FROM pages UNION ALL SELECT page_id, 'pdf', 'pdf', 'https://polls.example.com/a.pdf' FROM pages""",
    "chart_csv_tables": f"""WITH {_LINES} SELECT l_orderkey AS chart_id, CASE WHEN l_orderkey % 2 = 0 THEN 'line' ELSE 'crosstab' END AS kind, count(*) AS n_rows, round(CAST(sum(2 * floor(v)) AS DOUBLE), 6) AS total FROM lines GROUP BY 1""",
    "sheet_topline": f"WITH {_LINES} SELECT l_orderkey AS workbook, 'Question ' || l_orderkey AS question, {_pick(ANSWERS, 'l_linenumber - 1')} AS label, v AS value FROM lines",
    "sheet_crosstab": f"""WITH {_LINES}, d AS (SELECT *, l_linenumber + 2 AS r FROM lines), ended AS (SELECT *, max(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY r) AS e, max(CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY r) AS odd
        FROM (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY l_orderkey ORDER BY r), 3) AS gap FROM d))
      SELECT l_orderkey AS workbook, 'Do you approve?' AS question, a.answer, CASE WHEN odd IS NULL THEN 'Group 1' ELSE 'Group ' || CAST((odd + 1) // 2 AS VARCHAR) END AS group_title, 'Demo ' || l_linenumber AS demographic,
        round(CASE a.answer WHEN 'Approve' THEN CASE WHEN v / 100 <= 1.5 THEN v / 100 * 100 ELSE v / 100 END ELSE CASE WHEN v <= 1.5 THEN v * 100 ELSE v END END, 6) AS value
      FROM ended, (VALUES ('Approve'), ('Disapprove')) AS a(answer) WHERE e = 0""",
    "topline_text_tables": f"""WITH {_LINES}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS row_idx FROM lines)
      SELECT l_orderkey AS doc_id, 'CP1. In your opinion, is it good?' AS question, row_idx, {_pick(ANSWERS, 'l_linenumber - 1')} AS row_label, c.col_idx, CASE c.col_idx WHEN 0 THEN 'Total' ELSE 'Independent/Something else' END AS column_label, CAST(CASE c.col_idx WHEN 0 THEN floor(v) ELSE CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END END AS DOUBLE) AS value
      FROM n, (VALUES (0), (1)) AS c(col_idx)""",
    "latest_snapshot_state": f"""SELECT {_pick(SOURCES, 'user_id % 4')} AS source_id, event_type AS scope, arg_max(event_id, ts) AS snapshot_id, count(*) AS readable_count, epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(max(ts)) <= 3600000000 AS fresh FROM events WHERE value > 5 GROUP BY 1, 2""",
    "incremental_ingest": f"SELECT source_id, count(*) AS n_releases, count(*) AS n_urls FROM (SELECT DISTINCT {_pick(SOURCES, 'user_id % 4')} AS source_id, user_id, event_type FROM events) GROUP BY 1",
    "headline_topics": f"""WITH {_POLLS}, m AS (SELECT *, {_TOPIC} AS t FROM (SELECT *, lower(title || ' ' || prompt) AS low, CASE WHEN poll_key % 3 > 0 THEN CAST(published_on AS VARCHAR) END AS poll_date, 'week ' || weekofyear(published_on) AS wk FROM polls)), h AS (SELECT *, 'headline-' || {_slug('title')} AS topic_id FROM m WHERE t IS NULL)
      SELECT topic_id, arg_min(title, poll_key) AS topic_label, count(*) AS observation_count, count(DISTINCT source_id || ':' || wk || ':' || coalesce(poll_date, '')) AS poll_count, count(DISTINCT source_id) AS source_count, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources, max(poll_date) AS latest_date, arg_min(title, poll_key) AS sample_questions FROM h GROUP BY 1""",
    "battery_items": f"WITH {_PART} SELECT obs_id, CASE WHEN n = 15 THEN 'Senator Smith ' || p_name ELSE p_name END AS item FROM questions",
}

#: White space of any kind, as one class of DuckDB's expressions.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CLEAN = f"trim(regexp_replace(replace(replace(x, 'TOPLINE & METHODOLOGY', ''), 'Annotated Questionnaire', ''), '{_WHITE}', ' ', 'g'), ' ')"
_PAGE = r"(line SIMILAR TO '[0-9]{1,4}' OR regexp_matches(line, '(?i)^page [0-9]+( of [0-9]+)?$'))"
_NOISE = "lower(line) IN ('topline & methodology', '2020 k street, nw, suite 410', 'washington dc 20006', '+1 202 463-7300', 'contact:', 'email:', 'annotated questionnaire')"
_QUESTION = r"(regexp_matches(line, '^[A-Z][A-Za-z0-9_-]{0,24}\. \S|^[0-9]{1,3}[A-Za-z]?\. \S') AND len(list_filter(string_split(line, ' '), lambda w: w <> '')) >= 3)"
ORACLE_SQL |= {
    "line_kinds": rf"""WITH raw AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), l AS (SELECT {_CLEAN} AS line FROM raw)
        SELECT CASE WHEN line = '' THEN 'blank' WHEN {_PAGE} THEN 'page' WHEN line SIMILAR TO '[0-9]+' OR {_NOISE} THEN 'noise' WHEN regexp_matches(line, '\.\s*\.\s*\.') THEN 'contents'
            WHEN {_QUESTION} THEN 'question' WHEN regexp_matches(line, '^\(?N\s*=\s*([0-9,]+)\)?$') THEN 'size' WHEN regexp_matches(line, '\s(?:[0-9]+%?|\*|-)$') THEN 'row' ELSE 'text' END AS kind, count(*) AS n
        FROM l GROUP BY ALL""",
    "document_headers": rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_CLEAN}), lambda line: line <> '' AND NOT {_PAGE}) AS l FROM documents)
        SELECT doc_id, l[1] AS title, l[2] AS subtitle FROM d WHERE len(l) > 0""",
}

#: FNV-1a of an ASCII text in 64 bits, with its fixed values, as 16 hexadecimal digits.
_FNV = "lower(lpad(to_hex(CAST(list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT)), 16, '0'))"
ORACLE_SQL |= {
    "text_hashes": f"""WITH {_PART} SELECT obs_id, {_FNV.format("obs_id || '|' || p_name")} AS hash16, right({_FNV.format("p_name")}, 8) AS hash8 FROM questions""",
    "number_parsing": """WITH l AS (SELECT l_partkey % 5 AS k, CAST(floor(l_quantity) AS DOUBLE) AS whole, l_quantity / 10 AS tenth, CAST(l_linenumber AS DOUBLE) AS percent FROM lineitem),
        c AS (SELECT *, CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN whole ELSE 1000 + whole END AS chart FROM l)
        SELECT chart, coalesce(chart, 0.0) AS topline, percent, 'Right direction' AS label, count(*) AS n, round(CAST(sum(CASE WHEN tenth <= 1.5 THEN tenth * 100 ELSE tenth END) AS DOUBLE), 6) AS scaled, round(sum(percent + whole), 6) AS row_sum
        FROM c GROUP BY ALL""",
}

_PANELS = f"lines AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS INTEGER) AS v, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY ALL), bare AS (SELECT l_orderkey, max(r) AS r FROM lines GROUP BY 1)"
_PANEL_COLUMNS = (("Total", None), ("Male", "Sex"), ("Female", "Sex"), ("White", "Race"), ("Black", "Race"), ("Hispanic", "Race"), ("18-29", "Age"), ("30-44", "Age"), ("45-64", "Age"), ("65+", "Age"), ("No degree", "Education"), ("College grad", "Education"))
ORACLE_SQL |= {
    "topline_panels": f"""WITH {_PANELS}, k AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_text(c)}, {'NULL' if g is None else _text(g)})" for i, (c, g) in enumerate(_PANEL_COLUMNS))}) AS k(col_idx, column_label, group_title))
        SELECT '15. Support for the war' AS question, {_pick(ANSWERS, "l_linenumber - 1")} AS row_label, col_idx, column_label, group_title, count(*) AS n, CAST(sum(v + col_idx) AS DOUBLE) AS total
        FROM lines JOIN bare USING (l_orderkey) CROSS JOIN k WHERE bare.r = 0 GROUP BY ALL""",
    "classifier_log": f"""SELECT DISTINCT {_FNV.format("p_name")} AS question_fingerprint, p_name AS canonical_topic_id, CASE WHEN p_name LIKE '%ring%' THEN 'second' ELSE 'first' END AS canonical_label, 'accepted' AS review_status,
        CASE WHEN p_name LIKE '%ring%' THEN 1 ELSE 0 END AS failures, CASE WHEN p_name LIKE '%ring%' THEN 'TimeoutError: first' END AS reason FROM part""",
    "topline_pages": f"""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS INTEGER) AS v, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS row_idx, {_pick(ANSWERS, "l_linenumber - 1")} AS label FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey AS doc_id, '15. Support for the war' AS question, 'Do you support or oppose the war of order ' || l_orderkey || '?' AS prompt, p.panel, row_idx, label AS row_label, p.n, p.last_group, CAST(p.n * v + p.n * (p.n + 1) // 2 AS DOUBLE) AS total FROM l, (VALUES (0, 12, 'Education'), (1, 11, 'Party ID')) AS p(panel, n, last_group)
        UNION ALL SELECT l_orderkey, '17A. Trust', '', 0, row_idx, 'Other or ' || label, 12, 'Education', CAST(12 * v + 78 AS DOUBLE) FROM l""",
    "topline_fallback": f"""WITH {_PANELS}, t AS (SELECT l_orderkey, string_agg({_pick(ANSWERS, "l_linenumber - 1")} || ' ' || array_to_string(list_transform(range(12), lambda k: CAST(v + k AS VARCHAR) || '%'), ' '), chr(10) ORDER BY l_linenumber) AS body FROM lines GROUP BY 1)
        SELECT l_orderkey AS doc_id, CASE r WHEN 0 THEN 'Crosstab' ELSE 'Unstructured' END AS type, CASE r WHEN 1 THEN md5('The Poll' || chr(10) || '15. Support for the war' || chr(10) || body || chr(10) || 'Totals 100% 100%' || chr(10)) END AS data_md5 FROM t JOIN bare USING (l_orderkey)""",
    "source_union": f"WITH {_POLLS} SELECT source_id, source_rank, count(*) AS n_polls, false AS failed FROM polls GROUP BY ALL UNION ALL SELECT 'lost', NULL, 0, true",
    "topic_lookup": f"""WITH {_POLLS}, c AS (SELECT * FROM (VALUES {", ".join(f"({_text(i)}, {_text(label)})" for i, label in CATALOG)}) AS c(topic_id, label)), seen AS (SELECT 'headline-' || question_no AS topic_id, arg_min(source_id || ' ' || title, poll_key) AS own FROM polls GROUP BY 1)
        SELECT topic_id, label AS topic_label, 'stable' AS status FROM c UNION ALL
        SELECT w.topic_id, own, CASE WHEN own IS NULL THEN 'not found' ELSE 'headline' END FROM (SELECT DISTINCT 'headline-' || p_size AS topic_id FROM part) w LEFT JOIN seen ON w.topic_id = seen.topic_id""",
    "question_index_store": f"""WITH {_PART} SELECT {_FNV.format("obs_id || '|' || p_name")} AS question_fingerprint, {_pick(SOURCES, "p_partkey % 4")} AS source_id, CAST(CASE WHEN p_size > 25 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS model FROM questions""",
}
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_INDEX = f"""seen AS (SELECT *, p_name || '|' || p_type AS f, CASE WHEN p_size <= 30 THEN 'headline-candidate-' || p_partkey ELSE 'generic-ballot' END AS own FROM part),
  records AS (SELECT p_name || '|' || p_type AS f, p_name, p_type, min(p_partkey) % 4 AS k FROM part WHERE p_type <> 'ECONOMY' GROUP BY 2, 3),
  usable AS (SELECT f, CASE k WHEN 0 THEN 'headline-' || {_SLUG.format("p_name")} WHEN 1 THEN 'headline-' || {_SLUG.format("p_name")} || '-ai' WHEN 2 THEN 'generic-ballot' ELSE 'headline-us-' || {_SLUG.format("p_type")} END AS topic,
    CASE k WHEN 1 THEN p_name || ' AI' END AS label FROM records WHERE p_type <> 'PROMO' AND NOT starts_with(p_name, 'large')),
  shown AS (SELECT f, topic, coalesce(label, array_to_string(list_transform(string_split(regexp_replace(topic, '^headline-', ''), '-'), lambda w: CASE WHEN w IN ('ai', 'us', 'uk') THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ')) AS label FROM usable)"""
ORACLE_SQL |= {
    "index_application": f"""WITH {_INDEX}, j AS (SELECT s.*, topic, label, topic IS NOT NULL AND starts_with(own, 'headline-candidate-') AS applied FROM seen s LEFT JOIN shown USING (f))
        SELECT p_partkey AS obs_ord, CASE WHEN applied THEN topic ELSE own END AS topic_id, CASE WHEN applied THEN label ELSE p_name END AS topic_label, CASE WHEN applied THEN {_text(ROLLUP)} ELSE 'own' END AS compatibility, applied FROM j""",
    "index_new_questions": f"""WITH {_INDEX} SELECT f AS question_fingerprint, min(p_partkey) AS obs_ord, arg_min(p_name, p_partkey) AS title FROM seen WHERE starts_with(own, 'headline-candidate-') AND f NOT IN (SELECT f FROM records) GROUP BY 1""",
    "classifier_output": """WITH l AS (SELECT *, doc_id % 13 = 0 AS bad, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 3 <> 0 THEN 'topic ' || doc_id WHEN doc_id % 2 = 1 THEN 'headline-the-label' ELSE '' END AS topic FROM labels),
          x AS (SELECT *, CASE WHEN toxic = 1 AND NOT bad THEN 'toxic' WHEN topic = '' THEN 'model returned no canonical topic id' END AS why, CAST(CASE WHEN bad THEN 0 WHEN quality = 1 THEN 0.84 ELSE 0.5 END AS DOUBLE) AS sure FROM l)
        SELECT doc_id, topic AS canonical_topic_id, CASE WHEN bad OR doc_id % 2 = 0 THEN '' ELSE 'The Label' END AS canonical_label, sure AS confidence, CASE WHEN bad THEN '' ELSE 'iran|military-action' END AS subjects, why AS exclude_reason, bad AS rejected,
          CASE WHEN why IS NOT NULL THEN 'excluded' WHEN sure < 0.55 THEN 'needs-review' ELSE 'accepted' END AS review_status
        FROM x""",
}
#: Words too general to join two wordings, as far as the parts have them.
_WEAK = "['approval', 'price', 'policy']"
ORACLE_SQL["similar_parts"] = f"""
    WITH p AS (SELECT p_partkey, p_brand, list_sort(list_distinct(list_concat(string_split(lower(p_name || ' ' || p_type), ' '), ['size' || p_size, CASE p_partkey % 3 WHEN 0 THEN 'approval' WHEN 1 THEN 'price' ELSE 'policy' END]))) AS f FROM part),
      n AS (SELECT p_brand, f, min(p_partkey) AS node, array_to_string(f, ' ') AS signature, list_filter(f, lambda w: NOT list_contains({_WEAK}, w)) AS s FROM p GROUP BY p_brand, f),
      j AS (SELECT a.node AS "left", b.node AS "right", a.s AS a, b.s AS b, len(list_intersect(a.f, b.f)) AS shared, len(a.f) AS na, len(b.f) AS nb, jaro_winkler_similarity(a.signature, b.signature) AS fuzzy
        FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.node < b.node WHERE len(list_intersect(a.s, b.s)) > 0),
      k AS (SELECT *, shared / (na + nb - shared) AS jaccard, shared / least(na, nb) AS containment FROM j
        WHERE NOT (list_sort(a) <> list_sort(b) AND least(len(a), len(b)) <= 2 AND len(list_intersect(a, b)) = least(len(a), len(b)))),
      x AS (SELECT *, CASE WHEN shared >= 2 AND (jaccard >= 0.25 OR containment >= 0.5 OR fuzzy >= 0.86) THEN greatest(jaccard, 0.8 * containment, 0.65 * fuzzy) WHEN shared = 1 AND fuzzy >= 0.92 THEN 0.55 * fuzzy END AS score FROM k)
    SELECT "left", "right", round(score + 3e-7, 3) AS score FROM x WHERE score IS NOT NULL"""
ORACLE_SQL["snapshot_ingest"] = f"SELECT {_pick(SOURCES, 'user_id % 4')} AS source_id, 'u' || user_id || '-' || event_type AS article_url, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2"
ORACLE_SQL["pooled_incrementally"] = ORACLE_SQL["pooled_all_topics"]
ORACLE_SQL["question_index_upserts"] = f"""SELECT {_FNV.format("p_name")} AS question_fingerprint, p_name AS title, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'small') THEN 'small' ELSE 'first' END AS model FROM (SELECT DISTINCT p_name FROM part)"""
#: Feature sets of the wordings that no rule matches, by hand: (number of the wording, features).
_FEATURES = ((9, "iran military-conflict"), (10, "iran military-conflict"), (11, "betting legal onlin sports state"), (12, "betting legal onlin state"), (13, "ai artifici heard intellig school tool"), (14, "ai heard school tool work"), (15, "senat smith"))
ORACLE_SQL["collection_observations"] = f"""WITH {_CELLS}, f AS (SELECT n, 'headline-candidate-' || right({_FNV.format("features")}, 8) AS candidate FROM (VALUES {", ".join(f"({n}, '{t}')" for n, t in _FEATURES)}) AS v(n, features)),
  s AS (SELECT *, structure_idx % 5 = 0 AS tab, CASE WHEN structure_idx % 5 = 0 THEN title ELSE title || ' ' || prompt END AS shown FROM cells WHERE structure_idx % 5 = 0 OR (structure_idx % 5 < 4 AND col_idx = 0)),
  hits AS (SELECT s.*, lower(title || ' ' || prompt) AS low FROM s), matched AS (
    SELECT h.*, coalesce(split_part(t, '|', 1), candidate) AS topic_id, coalesce(split_part(t, '|', 2), '{ROLLUP}') AS compatibility FROM (SELECT *, {_TOPIC} AS t FROM hits) h LEFT JOIN f ON h.structure_idx % {len(QUESTIONS)} = f.n WHERE t IS NOT NULL OR candidate IS NOT NULL),
  named AS (SELECT *, {_DEMO} AS demographic_id FROM matched), firsts AS (SELECT structure_idx, demographic_id, min(col_idx) AS col_idx FROM named GROUP BY ALL),
  answers AS ({_rolled("(SELECT n.* FROM named n JOIN firsts f ON n.structure_idx = f.structure_idx AND n.demographic_id = f.demographic_id AND n.col_idx = f.col_idx)", "structure_idx, topic_id, demographic_id")}),
  summed AS (SELECT structure_idx, count(DISTINCT demographic_id) AS n_demographics, count(*) AS n_answers, round(sum(value), 6) AS total FROM answers GROUP BY 1),
  shown AS (SELECT DISTINCT structure_idx, source_id, topic_id, compatibility, tab, prompt, shown, CASE WHEN source_id IN ('ipsos', 'yougov') THEN regexp_replace(regexp_replace(shown, '^.*TM1128Y17_25\\. ', ''), '^(CP1|15)\\. ', '') ELSE regexp_replace(shown, '^(CP1|15)\\. ', '') END AS question_title FROM matched)
  SELECT source_id || ':' || topic_id || ':' || structure_idx AS id, topic_id, compatibility, 'week ' || weekofyear(published_on) AS source_collection,
    coalesce(nullif(regexp_extract(shown, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), ''), CASE WHEN structure_idx % 3 > 0 THEN CAST(published_on AS VARCHAR) END) AS poll_date, question_title, CASE WHEN tab THEN prompt ELSE question_title END AS prompt, n_demographics, n_answers, total
  FROM shown JOIN summed USING (structure_idx) JOIN (SELECT poll_key, published_on FROM polls) p ON structure_idx = p.poll_key"""
ORACLE_SQL["snapshot_refresh"] = f"""WITH {_POLLS}, old AS (SELECT source_id, count(*) AS n, sum(poll_key) AS total FROM polls WHERE published_on < DATE '1997-01-01' GROUP BY 1), every AS (SELECT source_id, count(*) AS n, sum(poll_key) AS total FROM polls GROUP BY 1)
  SELECT c.scope, c.source_id, c.call, c.state, c.warning, x.n, x.total FROM (VALUES {", ".join(f"({_text(scope)}, {_text(name)}, {call}, {_text(state)}, {which}, {warned})" for scope, call, state, which, warned in (
      ("missing", 1, "refreshed", 1, "false"), ("fresh", 1, "fresh", 0, "false"), ("future", 1, "fresh", 0, "false"), ("unreadable", 1, "fresh", 0, "false"), ("stale", 1, "refreshed", 1, "false"), ("failing", 1, "stale", 0, "true"), ("failing", 2, "fresh", 0, "false"), ("lost", 1, "unavailable", 2, "true")) for name in SOURCES)}) AS c(scope, source_id, call, state, which, warning)
  LEFT JOIN (SELECT 0 AS which, * FROM old UNION ALL SELECT 1, * FROM every) x ON x.which = c.which AND x.source_id = c.source_id"""
_CHARTS = f"""{_LINES}, c AS (SELECT l_orderkey AS chart_id, l_orderkey % 10 AS k, {_pick(SOURCES, "l_orderkey % 4")} AS source_id, count(*) AS n FROM lines GROUP BY 1),
  charts AS (SELECT source_id, chart_id, CASE WHEN k < 2 THEN 'failed' WHEN k < 4 THEN 'skipped' ELSE 'ok' END AS status, CASE k WHEN 0 THEN 'undecodable text' WHEN 1 THEN 'Error' END AS reason, CASE WHEN k < 4 THEN 0 WHEN k = 4 THEN n + 1 ELSE n END AS n_rows FROM c)"""
ORACLE_SQL["source_failures"] = f"WITH {_CHARTS} SELECT * FROM charts"
ORACLE_SQL["source_account"] = f"""WITH {_CHARTS}, f AS (SELECT source_id, string_agg(chart_id || ' ' || reason, '|' ORDER BY chart_id) AS failure_samples FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chart_id) AS r FROM charts WHERE status = 'failed') WHERE r <= 3 GROUP BY 1)
  SELECT source_id, count(*) AS candidates, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'ok') AS structures, any_value(failure_samples) AS failure_samples, bool_and(status = 'failed') AS all_failed FROM charts LEFT JOIN f USING (source_id) GROUP BY 1"""
#: Bytes of a text in UTF-8, for hashes of texts that are not ASCII.
_FNV_BYTES = "(SELECT lower(lpad(to_hex(CAST(list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(1, length(h), 2), lambda i: CAST(16 * strpos('123456789ABCDEF', substr(h, i, 1)) + strpos('123456789ABCDEF', substr(h, i + 1, 1)) AS UHUGEINT))), lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT)), 16, '0')) FROM (SELECT hex(encode({0})) AS h))"
#: Labels of terms of the wordings that no rule matches, by hand: those before the words of a part's name, whether these count, and those after.
_LABELS = ((9, "Military conflict|Iran", 1, ""), (10, "Military conflict|Iran", 1, ""), (11, "Sports|Betting", 1, "Legal|Online|State"), (12, "Online|Betting", 1, "Legal|State"), (13, "AI|Artificial|Intelligence", 1, "Heard|Tool|School"), (14, "AI|Work", 1, "Heard|Tool|School"), (15, "Senator|Smith", 0, ""))
#: Titles without codes and dates, by hand.
_BARE = "CASE n WHEN 1 THEN 'Direction of the country' WHEN 3 THEN 'Main problem' WHEN 5 THEN 'Inflation' WHEN 7 THEN 'Foreign policy' ELSE title END"
_CLEANED = f"CASE WHEN n IN (3, 5, 7) THEN {_BARE} || ': ' || prompt ELSE prompt END"
_CAPITAL = "upper(left({0}, 1)) || substr({0}, 2)"
_SEEN = f"""{_PART}, asked AS (SELECT obs_id, p_partkey AS obs_ord, n, title, p_name, p_type, t, source_id, CASE WHEN t IS NULL THEN p_name || ' ' || prompt ELSE prompt END AS prompt FROM (SELECT *, {_TOPIC} AS t FROM (SELECT *, {_pick(SOURCES, "p_partkey % 4")} AS source_id, lower(title || ' ' || prompt) AS low FROM questions))),
  hand AS (SELECT f.n, f.features, l.before, l.own, l.after FROM (VALUES {", ".join(f"({n}, '{t}')" for n, t in _FEATURES)}) f(n, features) JOIN (VALUES {", ".join(f"({n}, '{b}', {w}, '{a}')" for n, b, w, a in _LABELS)}) l(n, before, own, after) ON f.n = l.n),
  named AS (SELECT a.*, string_split(replace(p_name, 'large', 'larg'), ' ') AS stems, list_transform(string_split(p_name, ' '), lambda w: {_CAPITAL.format("w")}) AS shown, features, before, own, after FROM asked a LEFT JOIN hand h ON a.t IS NULL AND a.n = h.n),
  keyed AS (SELECT *, {_search(f"lower({_CLEANED})")} AS key, array_to_string(list_sort(list_concat(string_split(features, ' '), CASE own WHEN 1 THEN stems ELSE [] END)), ' ') AS signature,
    list_filter(list_concat(string_split(before, '|'), CASE own WHEN 1 THEN shown ELSE [] END, string_split(after, '|')), lambda w: w <> '') AS labels FROM named),
  seen AS (SELECT *, {_FNV_BYTES.format("'v1|' || key || '|approve: ' || p_type || '|unsure: Unsure'")} AS question_fingerprint, t IS NULL AS candidate, CASE WHEN t IS NULL THEN 'headline-candidate-' || right({_FNV.format("signature")}, 8) ELSE split_part(t, '|', 1) END AS topic_id,
    CASE WHEN t IS NULL THEN array_to_string(labels[1:5], ' ') ELSE title END AS topic_label, CASE WHEN t IS NULL THEN '{ROLLUP}' ELSE split_part(t, '|', 2) END AS compatibility FROM keyed),
  firsts AS (SELECT question_fingerprint, min(obs_ord) AS first_ord, arg_min(source_id, obs_ord) AS first_source, arg_min(title, obs_ord) AS first_title FROM seen WHERE candidate GROUP BY 1)"""
ORACLE_SQL |= {
    "question_cleaning": f"""WITH {_PART}, p AS (SELECT *, {_pick(SOURCES, "p_partkey % 4")} AS source_id, {_BARE} AS bare FROM questions)
      SELECT obs_id, {_CLEANED} AS cleaned, CASE WHEN n = 1 OR (n = 7 AND source_id IN ('emerson', 'gallup')) THEN title ELSE bare END AS by_source, lower(bare) AS question_key, CASE n WHEN 15 THEN prompt || ' Senator Smith' ELSE bare || ': ' || prompt END AS wording FROM p""",
    "question_fingerprint": f"WITH {_SEEN} SELECT obs_id, question_fingerprint FROM seen",
    "new_questions": f"WITH {_SEEN} SELECT question_fingerprint, first_ord AS obs_ord, first_source AS source_id, first_title AS title FROM firsts WHERE first_ord % 3 > 0",
    "apply_question_index": f"""WITH {_SEEN}, records AS (SELECT question_fingerprint, 'headline-' || {_slug("first_title")} AS topic, CASE WHEN first_ord % 6 > 0 THEN first_title ELSE replace(array_to_string(list_transform(string_split({_slug("first_title")}, '-'), lambda w: {_CAPITAL.format("w")}), ' '), 'Ai ', 'AI ') END AS label FROM firsts WHERE first_ord % 3 = 0 AND first_ord % 9 > 0)
      SELECT s.obs_id, CASE WHEN r.topic IS NULL THEN s.topic_id ELSE r.topic END AS topic_id, coalesce(r.label, s.topic_label) AS topic_label, s.compatibility, r.topic IS NOT NULL AS applied FROM seen s LEFT JOIN records r ON s.candidate AND s.question_fingerprint = r.question_fingerprint""",
    "enrichment_batch": f"""WITH {_SEEN} SELECT question_fingerprint, first_source AS source_id, CASE WHEN first_ord % 6 = 0 THEN '/api/v1/topics/' || first_title WHEN first_ord % 3 = 0 THEN '' ELSE 'headline-' || {_slug("first_title")} END AS canonical_topic_id, CASE WHEN first_ord % 3 = 0 THEN 'seed' ELSE 'rules' END AS model, 'accepted' AS review_status FROM firsts""",
}
#: Intents of the wordings that no rule matches, by hand: support or oppose (9 to 12), awareness (13, 14), favorability (15).
ORACLE_SQL["similar_question_pairs"] = f"""
    WITH {_SEEN}, n AS (SELECT CASE WHEN n <= 12 THEN 1 WHEN n <= 14 THEN 2 ELSE 3 END AS intent, signature, string_split(signature, ' ') AS f, min(obs_ord) AS node FROM seen WHERE candidate GROUP BY 1, 2),
      j AS (SELECT a.node AS "left", b.node AS "right", a.f AS a, b.f AS b, len(list_intersect(a.f, b.f)) AS shared, jaro_winkler_similarity(a.signature, b.signature) AS fuzzy FROM n a JOIN n b ON a.intent = b.intent AND a.node < b.node),
      k AS (SELECT *, shared / (len(a) + len(b) - shared) AS jaccard, shared / least(len(a), len(b)) AS containment FROM j WHERE shared > 0 AND NOT (least(len(a), len(b)) <= 2 AND shared = least(len(a), len(b)))),
      x AS (SELECT *, CASE WHEN shared >= 2 AND (jaccard >= 0.25 OR containment >= 0.5 OR fuzzy >= 0.86) THEN greatest(jaccard, 0.8 * containment, 0.65 * fuzzy) WHEN shared = 1 AND fuzzy >= 0.92 THEN 0.55 * fuzzy END AS score FROM k)
    SELECT "left", "right", round(score + 3e-7, 3) AS score FROM x WHERE score IS NOT NULL"""
