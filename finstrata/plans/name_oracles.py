"""SQL for the queries on symbols, names and their contexts."""

from __future__ import annotations

from finstrata.functions.lexicons import COMPANY_NAMES, NOT_COMPANIES, NOT_TICKERS, STOCKS
from finstrata.operators.names import CLAUSE_ENDS
from finstrata.plans.oracles import SCORED, SKIPPED, _SHORT, words
from finstrata.plans.queries import UNIVERSE
from finstrata.sources.proxies import TEXTS


def rows(values: list[tuple], *columns: str) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in values) + f") v({', '.join(columns)})"


COMPANIES = f"""companies AS (
  SELECT ticker, company_name, nth FROM {rows([(t, n, i) for i, (t, n) in enumerate(STOCKS)], 'ticker', 'company_name', 'nth')}
  UNION ALL SELECT 'T' || s_suppkey, s_name || ' Inc.', 1000 + s_suppkey FROM supplier)"""
INDEX = f"""{COMPANIES}, d AS (
  SELECT ticker, nth AS pos, lower(trim(company_name)) AS a, lower(trim({_SHORT})) AS b, lower(string_split(company_name, ' ')[1]) AS f FROM companies
), every_name AS (
  SELECT a AS name, ticker, 0 AS priority, -pos AS o FROM d UNION ALL SELECT b, ticker, 2, pos FROM d
  UNION ALL SELECT f, ticker, 3, pos FROM d WHERE length(f) > 3 AND NOT list_contains({words(SKIPPED)}, f)
), index AS (
  SELECT name, ticker, priority FROM every_name WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY priority > 0, o, priority, ticker) = 1)"""
NEWS = """texts AS (
  SELECT doc_id, 'Shares of ' || s_name || CASE WHEN doc_id % 2 = 0 THEN ' Inc.' ELSE '' END || ' rose, and Bank of America Corporation fell; ' || coalesce(text, '') AS text
  FROM documents JOIN supplier ON s_suppkey = doc_id % 10)"""

_W = r"[\p{L}\p{N}_]"
_ESCAPED = r"regexp_replace(name, '([^\p{L}\p{N}\s])', '\\\1', 'g')"
# a name's end is where a word ends, or, after another character, where one begins
_FOUND = rf"'(?:^|[^\p{{L}}\p{{N}}_])(' || {_ESCAPED} || CASE WHEN regexp_matches(name, '{_W}$') THEN ')(?:$|[^\p{{L}}\p{{N}}_])' ELSE '){_W}' END"


def detected(universe: str, names: str) -> str:
    """CTEs up to ``found`` over ``texts``: universe (ticker), names (name, ticker, first, word)."""
    return rf"""universe AS ({universe}), names AS ({names}), tags AS (
  SELECT doc_id, unnest(range(len(x))) AS nth, unnest(list_transform(x, lambda s: replace(upper(s), '.', '-'))) AS ticker
  FROM (SELECT doc_id, regexp_extract_all(text, '\$([A-Za-z]{{1,5}}(?:\.[A-Za-z])?)\b', 1) AS x FROM texts)
), greedy AS (
  SELECT doc_id, regexp_extract_all(text, '(?:^|[^A-Za-z0-9])([A-Z]{{2,5}}(?:\.[A-Z])?[a-z]?)', 1) AS x FROM texts
), fitted AS (
  SELECT doc_id, list_filter(list_transform(x, lambda w: CASE WHEN NOT regexp_matches(w, '[a-z]$') THEN w WHEN contains(w, '.') THEN regexp_extract(w, '^[A-Z]+') ELSE w[1:len(w) - 2] END), lambda w: len(w) > 1) AS x FROM greedy
), bare AS (
  SELECT doc_id, unnest(range(len(x))) AS nth, unnest(x) AS form FROM fitted
), patterns AS (
  SELECT *, '(?i)' || {_FOUND} AS pattern FROM names
), lows AS MATERIALIZED (
  SELECT doc_id, text, lower(text) AS low FROM texts
), named AS MATERIALIZED (
  SELECT doc_id, first, word, ticker, regexp_extract(text, pattern, 1) AS form FROM lows JOIN patterns ON contains(low, name)
), hits AS (
  SELECT doc_id, 0 AS kind, 0 AS first, '' AS word, nth, ticker, '$' || ticker AS form FROM tags WHERE ticker IN (FROM universe)
  UNION ALL SELECT doc_id, 1, 0, '', nth, replace(form, '.', '-'), form FROM bare
    WHERE replace(form, '.', '-') IN (FROM universe) AND NOT list_contains({words(NOT_TICKERS)}, replace(form, '.', '-'))
  UNION ALL SELECT doc_id, 2, first, word, 0, ticker, form FROM named WHERE form <> ''
), once AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, ticker ORDER BY kind, first, word, nth) = 1
), found AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind, first, word, nth)::INTEGER AS position, ticker, form AS mentioned_as FROM once)"""


_CURATED = f"SELECT name, ticker, first, name AS word FROM {rows([(n, t, i) for i, (n, t) in enumerate(COMPANY_NAMES.items())], 'name', 'ticker', 'first')}"
_SEVEN = f"SELECT * FROM {rows([(t,) for t in UNIVERSE], 'ticker')}"
DETECTED = f"{TEXTS}, {detected(_SEVEN, _CURATED)}"

_TRIM = "trim({}, E' \\t\\n\\r' || chr(11) || chr(12))".format


def part_at(text: str, pattern: str, at: str, gap: int) -> str:
    parts = f"regexp_split_to_array({text}, '{pattern}')"
    start = f"coalesce(list_sum(list_transform(p[1:i - 1], lambda q: length(q))), 0) + {gap} * (i - 1)"
    return f"(SELECT p[list_filter(range(1, len(p) + 1), lambda i: {start} <= {at} AND {at} < {start} + length(p[i]))[1]] FROM (SELECT {parts} AS p))"


_BARE = r"regexp_replace(mentioned_as, '^\$', '')"
_QUOTED = rf"regexp_replace(regexp_replace({_BARE}, '([^\p{{L}}\p{{N}}\s])', '\\\1', 'g'), '\\-', '[.-]', 'g')"
_ANY_CASE = rf"(mentioned_as[1] = '$' OR NOT regexp_matches({_BARE}, '^[A-Z.]+$'))"
CONTEXTS = rf"""{DETECTED}, placed AS (
  SELECT found.*, text, length({_BARE}) AS size, length(regexp_extract(text, '(?s)^(.*?)' || CASE WHEN {_ANY_CASE} THEN '(?i:' ELSE '(?:' END || '\b' || {_QUOTED} || ')', 1)) AS start
  FROM found JOIN texts USING (doc_id) WHERE length(text) >= 10
), windows AS (
  SELECT *, greatest(start - 80, 0) AS f0, substr(text, greatest(start - 80, 0) + 1, start + size + 80 - greatest(start - 80, 0)) AS win FROM placed
), clauses AS (
  SELECT *, [{', '.join(_TRIM(part_at('win', '(?i)' + end, '(start - f0)', 5)) for end in CLAUSE_ENDS)}] AS c FROM windows
), shortest AS (
  SELECT *, {_TRIM("list_reduce(c, lambda b, x: CASE WHEN length(x) < length(b) AND length(x) > 10 THEN x ELSE b END, win)")} AS b FROM clauses
), contexts AS (
  SELECT doc_id, position, ticker, mentioned_as, CASE WHEN length(b) < 20 THEN coalesce(nullif({_TRIM(part_at('text', '[.!?]+', 'start', 1))}, ''), b) ELSE b END AS context FROM shortest)"""

_RUN = r"(?:^|[^\p{L}\p{Nd}])(\p{Lu}(?:[.&''’#-]?[\p{L}\p{Nd}])*(?: (?:(?:of|and|the|for|&) )?[\p{Lu}\p{Nd}](?:[.&''’#-]?[\p{L}\p{Nd}])*)*)"
ENTITIES = rf"""{INDEX}, {NEWS}, found_runs AS (
  SELECT doc_id, unnest(range(len(x))) AS run, string_split(unnest(x), ' ') AS w FROM (SELECT doc_id, regexp_extract_all(text, '{_RUN}', 1) AS x FROM texts)
), starts AS (
  SELECT *, unnest(range(1, len(w) + 1)) AS i FROM found_runs
), parts AS (
  SELECT *, unnest(range(i, least(len(w), i + 5) + 1)) AS j FROM starts
), entities AS (
  SELECT DISTINCT doc_id, run, array_to_string(w[i:j], ' ') AS entity FROM parts WHERE regexp_matches(w[i], '^\p{{Lu}}') AND regexp_matches(w[j], '^[\p{{Lu}}\p{{Nd}}]'))"""

# The longest common subsequence of two names, a row of the table in one integer; all pairs.
RESOLVED = rf"""
WITH companies AS (
  SELECT 'P' || page_id AS ticker, regexp_extract(html::VARCHAR, '(?is)<title[^>]*>(.*?)</title>', 1) AS company_name, page_id AS nth FROM pages
), d AS (
  SELECT ticker, nth AS pos, lower(trim(company_name)) AS a, lower(trim({_SHORT})) AS b, lower(regexp_split_to_array(company_name, '\s+')[1]) AS f FROM companies
), every_name AS (
  SELECT a AS name, ticker, 0 AS priority, -pos AS o FROM d UNION ALL SELECT b, ticker, 2, pos FROM d
  UNION ALL SELECT f, ticker, 3, pos FROM d WHERE length(f) > 3 AND NOT list_contains({words(SKIPPED)}, f)
), index AS (
  SELECT name AS known, ticker FROM every_name WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY priority > 0, o, priority, ticker) = 1
), names AS (
  SELECT DISTINCT CASE nth % 3 WHEN 0 THEN '$' || ticker WHEN 1 THEN company_name ELSE company_name[1:2] || company_name[4:] END AS name FROM companies
), asked AS (
  SELECT name, regexp_replace(lower(trim(name)), '^\$', '') AS q FROM names WHERE trim(name) <> '' AND NOT list_contains({words(NOT_COMPANIES)}, lower(trim(name)))
), exact AS (
  SELECT name, ticker, 0 AS o, 'ticker' AS method FROM asked JOIN companies ON replace(upper(q), '.', '-') = ticker
  UNION ALL SELECT name, ticker, 1, 'name' FROM asked JOIN index ON q = known
), rest AS (
  SELECT name, q, length(q) AS n, string_split(q, '') AS letters FROM asked WHERE name NOT IN (SELECT name FROM exact)
), places AS (
  SELECT known, unnest(string_split(known, '')) AS c, unnest(range(length(known))) AS i FROM index
), masks AS MATERIALIZED (
  SELECT known, length(known) AS m, (1::HUGEINT << length(known)) - 1 AS whole, map_from_entries(list((c, mask))) AS held FROM (SELECT known, c, sum(1::HUGEINT << i)::HUGEINT AS mask FROM places GROUP BY 1, 2) GROUP BY known
), pairs AS (
  SELECT name, known, n + m AS s, m - bit_count(list_reduce(list_transform(letters, lambda c: coalesce(held[c], 0::HUGEINT)), lambda v, x: ((v + (v & x)) | (v - (v & x))) & whole, whole)) AS l
  FROM rest JOIN masks ON abs(n - m) <= 0.16 * (n + m)
), fuzzy AS (
  SELECT name, ticker, 2 AS o, 'fuzzy' AS method, round_even(200.0 * l / s, 0) / 100 AS score FROM pairs JOIN index USING (known) WHERE round_even(200.0 * l / s, 0) >= 85
)
SELECT name, ticker, method, score FROM (SELECT *, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT * FROM fuzzy)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY o, score DESC, ticker) = 1
"""

NAME_ORACLES: dict[str, str] = {
    "ticker_detect": f"WITH {DETECTED} SELECT * FROM found",
    "company_detect": f"WITH {INDEX}, {NEWS}, {detected('SELECT ticker FROM companies', 'SELECT name, ticker, priority AS first, name AS word FROM index')} SELECT * FROM found",
    "mention_contexts": f"WITH {CONTEXTS} SELECT * FROM contexts",
    "scored_mentions": f"WITH {CONTEXTS}, {SCORED.replace(TEXTS, 'rows_of AS (SELECT context AS text, min(doc_id) AS doc_id, NULL AS source FROM contexts GROUP BY context)').replace('FROM texts', 'FROM rows_of')} SELECT c.*, sentiment_label, sentiment_score FROM contexts AS c JOIN scored ON scored.text = c.context",
    "entity_candidates": f"WITH {ENTITIES} SELECT doc_id, count(*) AS candidates, md5(string_agg(entity, chr(10) ORDER BY entity, run)) AS digest FROM entities GROUP BY doc_id",
    "entities": f"WITH {ENTITIES} SELECT doc_id, run::INTEGER AS run, entity, ticker FROM entities JOIN index ON name = lower(entity) QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY length(entity) DESC, entity) = 1",
    "entity_resolve": RESOLVED,
    "name_index": f"WITH {INDEX} SELECT * FROM index",
    "stock_search": f"WITH {COMPANIES} SELECT ticker, company_name, {_SHORT} AS short_name, CASE WHEN ticker = 'INC' THEN 0 ELSE 1 END AS rank FROM companies WHERE ticker = 'INC' OR contains(lower(company_name), 'inc') ORDER BY rank, ticker LIMIT 10",
}
