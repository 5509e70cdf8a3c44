"""SQL for queries over sentences and articles."""

from __future__ import annotations

from finstrata.functions.lexicons import ASPECT_KEYWORDS
from finstrata.plans.oracles import SCORED, quoted
from finstrata.sources.proxies import TEXTS

_ENDS = r"E'^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$'"


def has_any(text: str, phrases: list[str]) -> str:
    words = [p for p in phrases if " " not in p]
    one = [f"contains({text}, {quoted(p)})" for p in phrases if " " in p]
    pattern = "|".join("".join("\\" + c if c in "/." else c for c in p) for p in words)
    return " OR ".join([*one, f"regexp_matches({text}, '(^|[^A-Za-z0-9_])(?:{pattern})($|[^A-Za-z0-9_])')"])


_NAMED = "[" + ", ".join(f"CASE WHEN {has_any('lower(sentence)', k)} THEN {i} END" for i, k in enumerate(ASPECT_KEYWORDS.values())) + "]"
_NAMES = "[" + ", ".join(quoted(a) for a in ASPECT_KEYWORDS) + "]"

ASPECTS = rf"""{TEXTS}, whole AS (
  SELECT doc_id, regexp_replace(text, {_ENDS}, '', 'g') AS t FROM texts
), parts AS (
  SELECT doc_id, t, list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, {_ENDS}, '', 'g')) AS p FROM whole
), cut AS (
  SELECT doc_id, t, list_transform(list_filter(p, lambda x: length(x) >= 12), lambda x: x[1:2000]) AS p FROM parts
), sentences AS (
  SELECT doc_id, unnest(range(len(p))) AS s, unnest(p) AS sentence FROM (SELECT doc_id, CASE WHEN len(p) > 0 THEN p WHEN t <> '' THEN [t[1:2000]] ELSE [] END AS p FROM cut)
), named AS (
  SELECT doc_id, s, sentence, unnest(list_filter({_NAMED}, lambda x: x IS NOT NULL)) AS a FROM sentences
), few AS (
  SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY doc_id, a ORDER BY s) <= 2
), aspects AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, a))::INTEGER AS position, {_NAMES}[a + 1] AS aspect,
    CASE WHEN length(sentence) <= 320 THEN sentence ELSE sentence[1:319] || '…' END AS snippet
  FROM few QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, a) <= 8
)"""
# each snippet is scored as a text
SCORES = SCORED.replace(TEXTS, "snippets AS (SELECT snippet AS text, min(doc_id) AS doc_id, NULL AS source FROM aspects GROUP BY snippet)").replace("FROM texts", "FROM snippets")

TEXT_ORACLES: dict[str, str] = {
    "aspects": f"WITH {ASPECTS} SELECT * FROM aspects",
    "scored_aspects": f"WITH {ASPECTS}, {SCORES} SELECT a.doc_id, to_json(list({{'aspect': aspect, 'snippet': snippet, 'label': sentiment_label, 'score': sentiment_score}} ORDER BY position))::VARCHAR AS aspects FROM aspects AS a JOIN scored AS s ON s.text = a.snippet GROUP BY a.doc_id",
    "dedupe_url_title": r"""
WITH RECURSIVE articles AS (
  SELECT 2 * page_id AS ordinal, url, regexp_extract(html::VARCHAR, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages
  UNION ALL SELECT 2 * doc_id + 1, NULL, text FROM documents
), numbered AS (
  SELECT row_number() OVER (ORDER BY ordinal) AS i, ordinal, nullif(trim(url), '') AS u, md5(lower(coalesce(title, ''))) AS t FROM articles
), loop AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS ordinal, false AS keep, []::VARCHAR[] AS urls, []::VARCHAR[] AS titles
  UNION ALL
  SELECT n.i, n.ordinal, k, CASE WHEN k AND u IS NOT NULL THEN list_append(urls, u) ELSE urls END, CASE WHEN k THEN list_append(titles, t) ELSE titles END
  FROM (SELECT x.*, l.urls, l.titles, NOT (coalesce(list_contains(l.urls, x.u), false) OR list_contains(l.titles, x.t)) AS k FROM loop AS l JOIN numbered AS x ON x.i = l.i + 1) AS n
)
SELECT a.ordinal, a.url, md5(a.title) AS digest FROM articles AS a JOIN loop ON loop.ordinal = a.ordinal WHERE keep
""",
}
