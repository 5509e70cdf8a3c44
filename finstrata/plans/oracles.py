"""SQL that says what the catalogue's queries return, for another engine to run on the same tables."""

from __future__ import annotations

import re

from finstrata.functions.lexicons import CHANNELS, EMOTION_PHRASES, EMOTIONS, FINANCIAL_TERMS, INTENSITY_WORDS, LABELS, NEGATIVE_WORDS, POSITIVE_WORDS, SPAM_PATTERNS, STOP_WORDS
from finstrata.functions.sentiment import SAID
from finstrata.functions.text import EMOJI, MOVEMENT, PUNCTUATION, SENTENCE_END, TREEBANK_FIRST, TREEBANK_THEN
from finstrata.operators.entities import CONTEXT, SKIPPED, SUFFIXES
from finstrata.plans.queries import COMPARED, END, START
from finstrata.sources.proxies import PRICES, RECORDS, TEXTS


def r(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def words(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def pct(x: str) -> str:
    return f"round_even({x} * 100, 0)::INTEGER || '%'"


def said(name: str, **parts: str) -> str:
    pieces = re.split(r"\{(\w+)\}", SAID[name])
    return "(" + " || ".join(parts[x] if k % 2 else quoted(x) for k, x in enumerate(pieces)) + ")"


COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (sentiment_label = '{x}') AS {x}" for x in LABELS)
PERCENTS = ", ".join(f"CASE WHEN total = 0 THEN 0.0 ELSE {r(f'{x} * 100.0 / total', 2)} END AS {x}_pct" for x in LABELS)
STOCKS = f"WITH {RECORDS}, s AS (SELECT * FROM recs WHERE ticker IS NOT NULL)"
NET = "(positive - negative) / greatest(total, 1)"


def pearson(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


MERGED = f"""{STOCKS}, {PRICES},
rets AS (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS returns FROM prices) WHERE returns IS NOT NULL),
daily AS (SELECT ticker, CAST(published_at AS DATE) AS date, {COUNTS}, avg(sentiment_score) AS avg_score FROM s GROUP BY 1, 2),
joined AS (SELECT d.ticker, d.date, d.total AS mention_count, {NET} AS net_sentiment, r.returns FROM daily d JOIN rets r ON d.ticker = r.ticker AND d.date = r.date),
trail AS (SELECT *, avg(net_sentiment) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trailing_net_sentiment FROM joined),
spied AS (SELECT t.*, p.returns AS spy_returns FROM trail t JOIN rets p ON p.ticker = 'SPY' AND p.date = t.date),
betas AS (SELECT ticker, CASE WHEN var_pop(spy_returns) >= 1e-16 AND count(*) >= 2 THEN covar_pop(returns, spy_returns) / var_pop(spy_returns) ELSE 1.0 END AS beta FROM spied GROUP BY ticker),
m AS (SELECT x.*, b.beta, returns - beta * spy_returns AS excess_returns, lead(returns) OVER w AS forward_1d_return,
  lead(returns) OVER w - beta * lead(spy_returns) OVER w AS forward_1d_excess_return FROM spied x JOIN betas b ON x.ticker = b.ticker WINDOW w AS (PARTITION BY x.ticker ORDER BY x.date))"""


def correlation(x: str, y: str) -> str:
    return f"""SELECT ticker, n, {r('v', 4)} AS pearson_r, CASE WHEN v IS NULL THEN NULL WHEN abs(v) >= 0.7 THEN 'strong' WHEN abs(v) >= 0.4 THEN 'moderate' WHEN abs(v) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength
FROM (SELECT ticker, count(*) AS n, CASE WHEN count(*) >= 5 THEN {pearson(x, y)} END AS v FROM m WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ticker)"""


SWEEP = f"""n AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker) AS k, net_sentiment AS x, returns AS y FROM m),
pairs AS (SELECT a.ticker, l.lag, a.x, b.y FROM n a CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) l JOIN n b ON a.ticker = b.ticker AND a.rn + l.lag = b.rn WHERE a.k >= 10),
sweep AS (SELECT ticker, lag, count(*) AS n, {r(f"CASE WHEN count(*) >= 5 THEN {pearson('x', 'y')} END", 4)} AS r FROM pairs GROUP BY ticker, lag)"""
ROLLING = f"""rolling AS (SELECT ticker, window_start, window_end, {r('c / nullif(sp, 0)', 4)} AS r FROM (
  SELECT ticker, date AS window_end, min(date) OVER w AS window_start, count(*) OVER w AS n, covar_pop(net_sentiment, returns) OVER w AS c, stddev_pop(net_sentiment) OVER w * stddev_pop(returns) OVER w AS sp, count(*) OVER (PARTITION BY ticker) AS k
  FROM m WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) WHERE n = 14 AND k >= 16 AND sp > 1e-12)"""

JUDGED = """j AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS truth, CASE WHEN length(text) > 1000 THEN 'positive' ELSE 'negative' END AS first,
  CASE WHEN toxic = 0 THEN 'positive' ELSE 'negative' END AS second FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

# the keyword scorer on texts, words being runs of a-z that no other word character touches
SCORED = f"""{TEXTS},
w AS (SELECT doc_id, text, source, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '[a-z]+'))) AS ws FROM texts),
c AS (SELECT *, len(list_filter(ws, lambda x: list_contains({words(POSITIVE_WORDS)}, x))) AS g, len(list_filter(ws, lambda x: list_contains({words(NEGATIVE_WORDS)}, x))) AS b FROM w),
k AS (SELECT *, CASE WHEN g + b = 0 THEN NULL ELSE (g - b) / (g + b) END AS bal FROM c),
scored AS (SELECT doc_id, text, source, CASE WHEN bal > 0.15 THEN 'positive' WHEN bal < -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN bal IS NULL THEN 0.5 WHEN bal > 0.15 THEN {r('least(0.95, 0.6 + g / (g + b) * 0.3)', 4)} WHEN bal < -0.15 THEN {r('least(0.95, 0.6 + b / (g + b) * 0.3)', 4)} ELSE {r('0.5 + abs(bal) * 0.2', 4)} END AS sentiment_score FROM k)"""
SHARES = "shared AS (SELECT *, " + ", ".join(f"CASE WHEN sentiment_label = '{x}' THEN sentiment_score ELSE greatest(0.0, (1 - sentiment_score) / 2) END AS p{i}" for i, x in enumerate(LABELS)) + " FROM scored)"
_P = [f"greatest(p{i}, 1e-12) / (greatest(p0, 1e-12) + greatest(p1, 1e-12) + greatest(p2, 1e-12))" for i in range(3)]
UNSURE = "unsure AS (SELECT *, lower(text) AS low, (" + " + ".join(f"-({p}) * ln({p})" for p in _P) + ") / ln(3.0) AS h FROM shared)"


def phrase_hits(emotion: str) -> str:
    one = lambda p: f"contains(low, '{p}')" if " " in p else f"regexp_matches(low, '(^|[^a-z0-9_]){p}($|[^a-z0-9_])')"
    return " + ".join(f"CAST({one(p)} AS INTEGER)" for p in EMOTION_PHRASES[emotion])


RAW = "hit AS (SELECT *, " + ", ".join(f"{phrase_hits(e)} AS n_{e}" for e in EMOTION_PHRASES) + " FROM unsure)"
EMOTION_RAW = """raw AS (SELECT *, 0.05 + p1 * 0.55 + CASE WHEN p1 >= 0.58 AND h <= 0.55 THEN 0.12 ELSE 0.0 END + n_fear * 0.16 AS r_fear, 0.05 + p0 * 0.65 + n_optimism * 0.16 AS r_optimism,
  0.05 + p2 * 0.2 + h * 0.65 + CASE WHEN h >= 0.78 THEN 0.2 ELSE 0.0 END + n_uncertainty * 0.16 + CASE WHEN n_uncertainty >= 2 THEN 0.08 ELSE 0.0 END AS r_uncertainty,
  0.05 + p0 * 0.35 + CASE WHEN p0 >= 0.58 AND h <= 0.55 THEN 0.12 ELSE 0.0 END + n_confidence * 0.16 AS r_confidence, 0.05 + p1 * 0.35 + n_skepticism * 0.16 AS r_skepticism,
  0.03 + greatest(0.0, h - 0.72) * 0.9 + CASE WHEN h >= 0.78 THEN 0.18 ELSE 0.0 END + CASE WHEN n_fear > 0 AND n_optimism > 0 THEN 0.12 ELSE 0.0 END AS r_mixed FROM hit)"""
_SUM = " + ".join(f"r_{e}" for e in EMOTIONS)
FELT = "felt AS (SELECT doc_id, source, h, " + ", ".join(f"{r(f'r_{e} / ({_SUM})', 4)} AS emotion_{e}" for e in EMOTIONS) + " FROM raw)"
_SORTED = "list_reverse_sort([" + ", ".join(f"emotion_{e}" for e in EMOTIONS) + "])"
NAMED = f"""named AS (SELECT *, CASE WHEN t[1] < 0.24 OR t[1] - t[2] < 0.06 OR h >= 0.88 THEN 'mixed' {' '.join(f"WHEN emotion_{e} = t[1] THEN '{e}'" for e in EMOTIONS)} END AS emotion_label FROM (SELECT *, {_SORTED} AS t FROM felt))"""
EMOTIONAL = f"WITH {SCORED}, {SHARES}, {UNSURE}, {RAW}, {EMOTION_RAW}, {FELT}, {NAMED}"


def variant(name: str, changed: str) -> str:
    """The emotions of the same texts with some of what they are made of replaced."""
    steps = f"hit AS (SELECT * REPLACE ({changed}) FROM hit), {EMOTION_RAW}, {FELT}, {NAMED}"
    for x in ("hit", "raw", "felt", "named"):
        steps = steps.replace(f"{x} AS (", f"{x}_{name} AS (").replace(f"FROM {x}", f"FROM {x}_{name}")
    return steps.replace(f"FROM hit_{name}), ", "FROM hit), ", 1)


VARIED = f"{EMOTIONAL}, {variant('h', '0.0 AS h')}, {variant('l', ', '.join(f'0 AS n_{e}' for e in EMOTION_PHRASES))}, v AS (SELECT a.doc_id, a.emotion_label AS f, b.emotion_label AS no_entropy, c.emotion_label AS no_lexicon FROM named a JOIN named_h b ON a.doc_id = b.doc_id JOIN named_l c ON a.doc_id = c.doc_id)"


def emotions(key: str = "") -> str:
    k = f"{key}, " if key else ""
    inner = ", ".join(f"count(*) FILTER (emotion_label = '{e}') AS {e}" for e in EMOTIONS)
    most = "greatest(" + ", ".join(EMOTIONS) + ")"
    return f"""{EMOTIONAL}, d AS (SELECT {k}count(*) AS total, {inner} FROM named {f'GROUP BY {key}' if key else ''})
SELECT *, {', '.join(f"{r(f'{e} * 100.0 / total', 2)} AS {e}_pct" for e in EMOTIONS)}, CASE {' '.join(f"WHEN {e} = {most} THEN '{e}'" for e in EMOTIONS)} END AS top_emotion FROM d"""


def prf(which: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{x}' AS label, count(*) FILTER (truth = '{x}' AND {which} = '{x}') AS tp, count(*) FILTER (truth <> '{x}' AND {which} = '{x}') AS fp, count(*) FILTER (truth = '{x}' AND {which} <> '{x}') AS fn FROM j" for x in ("positive", "negative")
    )
    return f"""SELECT label, {r('coalesce(tp / nullif(tp + fp, 0), 0.0)', 4)} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0.0)', 4)} AS recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)', 4)} AS f1, tp + fn AS support FROM ({each})"""


def overall(which: str) -> str:
    return f"""SELECT '{which}' AS model, (SELECT count(*) FROM j) AS n, (SELECT {r(f'count(*) FILTER (truth = {which}) / count(*)', 4)} FROM j) AS accuracy, {', '.join(f"{r(f'avg({c})', 4)} AS macro_{c}" for c in ('precision', 'recall', 'f1'))} FROM ({prf(which)})"""


_QUALITY = f"""q AS (SELECT ticker, count(*) AS total, count(*) FILTER (sentiment_label = 'neutral') AS neutral, {', '.join(f"count(*) FILTER (data_source = '{c}') AS n_{c}" for c in CHANNELS)} FROM s WHERE CAST(published_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ticker)"""
_GAP = f"""dd AS (SELECT DISTINCT ticker, CAST(published_at AS DATE) AS day FROM s WHERE CAST(published_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'),
g AS (SELECT ticker, day, coalesce(lead(day) OVER (PARTITION BY ticker ORDER BY day), DATE '{END}' + 1) - day - 1 AS gap FROM dd),
gaps AS (SELECT ticker, count(*) AS days_with_mentions, greatest(max(gap), min(day) - DATE '{START}') AS longest_gap FROM g GROUP BY ticker)"""
_PUNCT = PUNCTUATION.replace("'", "''")



def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g'), 'https?://[^\\s]+', '', 'g'), '\\[\\+[0-9]+ chars\\]', '', 'g'), '(?i)\\[Removed\\]', '', 'g'), '\\s+', ' ', 'g'))"


_EMOTIONS = words(EMOTIONS)
_WORD = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"
_LOW = f"WITH {TEXTS}, low AS (SELECT doc_id, text, lower(text) AS l FROM texts)"
_FLAGS = ", ".join(f"regexp_matches(l, '\\b(?:{w})\\b') AS has_{n}" for n, w in CONTEXT.items())
_UP = "regexp_matches(lower(m), '^(gained|gain|rose|increased|increase|up)\\s')"
_ENDED = "CASE " + " ".join(f"WHEN ends_with(lower(company_name), '{x.lower()}') THEN company_name[:-{len(x) + 1}]" for x in SUFFIXES) + " ELSE company_name END"
_SHORT = f"trim(regexp_replace(regexp_replace({_ENDED}, '\\s*[-/]\\s*[A-Z]{{2}}$', ''), '(?i)^the ', ''))"
_SPAM = "|".join(f"(?:{p})" for p in SPAM_PATTERNS).replace("'", "''")
_LEMMA = "CASE WHEN regexp_matches(w, '(?i)[a-z]{2,}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?i)(ss|us|is)$') THEN w WHEN regexp_matches(w, '(?i)(sh|ch|x|z|ss)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '(?i)[a-z]{2,}s$') THEN regexp_replace(w, 's$', '') ELSE w END"

_URL = "https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),\\\\]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"


def normal(x: str) -> str:
    """Without URLs, addresses, mentions and punctuation, tags opened (three humps at most), in one line of lower case."""
    out = f"regexp_replace(regexp_replace(regexp_replace({x}, '{_URL}', '', 'g'), '[^\\s]+@[^\\s]+', '', 'g'), '@{_WORD}+', '', 'g')"
    for _ in range(3):
        out = f"regexp_replace({out}, '(#{_WORD}*[a-z])([A-Z])', '\\1 \\2', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '#({_WORD}+)', '\\1', 'g'), '[!-/:-@\\[-`{{-~]+', '', 'g')"
    return f"lower(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


_NORMAL = f"WITH {TEXTS}, n AS (SELECT doc_id, text, {normal('text')} AS t FROM texts)"
_NEG = "regexp_matches(ws[i], '(?i)^(not|no|never|neither|nobody|nothing|nowhere|n''t)($|[^0-9A-Za-z_\\p{L}\\p{M}\\p{Nd}])')"
_share = lambda x, digits, of="len(a)": r(f"coalesce({x}::DOUBLE / nullif({of}, 0), 0.0)", digits)
_STOPPED = words([w for w in STOP_WORDS if w not in {*FINANCIAL_TERMS, *INTENSITY_WORDS}])
_SPLIT = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')".format
_TREEBANK = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
for _p, _by in TREEBANK_FIRST:
    _TREEBANK = f"regexp_replace({_TREEBANK}, {quoted(_p)}, {quoted(_by)}, 'g')"
_TREEBANK = f"' ' || {_TREEBANK} || ' '"
for _p, _by in TREEBANK_THEN:
    _TREEBANK = f"regexp_replace({_TREEBANK}, {quoted(_p)}, {quoted(_by)}, 'g')"
_TREEBANK = _SPLIT(_TREEBANK)
_TOTALS = "count(*) AS total_records, CAST(sum(k) AS BIGINT) AS total_tokens, floor(sum(k)::DOUBLE / count(*) * 100 + 0.5) / 100 AS avg_tokens_per_record"
_HINTS = "list_filter(list_transform(" + _SPLIT("text") + ", lambda w: replace(upper(replace(regexp_replace(trim(w), '^[$]+', ''), 'ß', 'SS')), '.', '-')), lambda w: regexp_full_match(w, '[A-Z0-9]{1,5}'))"
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)".format

ORACLES: dict[str, str] = {
    "upsert": f"WITH {RECORDS} SELECT ticker, CASE WHEN sentiment_label = 'negative' THEN 'neutral' ELSE sentiment_label END AS sentiment_label, count(*) AS n FROM recs GROUP BY 1, 2",
    "purge_backfill": f"WITH {RECORDS} SELECT CASE WHEN data_source IS NULL AND ticker IS NOT NULL THEN 'news' ELSE data_source END AS data_source, count(*) AS n FROM recs WHERE NOT coalesce(data_source = 'reddit' AND published_at < TIMESTAMP '{START}', false) GROUP BY 1",
    "record_limits": f"WITH {TEXTS} SELECT doc_id, concat_ws(',', CASE WHEN length(text) NOT BETWEEN 15 AND 2000 THEN 'text' END, CASE WHEN doc_id % 7 > 5 THEN 'score' END, CASE WHEN doc_id % 13 > 10 THEN 'ticker' END) AS broken, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) > 50000 THEN 'too_long' WHEN length(trim(text)) > 10000 THEN 'long' ELSE 'ok' END AS guard FROM texts",
    "channels": "WITH c AS (SELECT ['twitter', 'twitter', 'news', 'news', 'reddit', NULL, NULL][event_id % 7 + 1] AS channel FROM events) SELECT channel, coalesce(channel, 'other') AS named, count(*) AS n FROM c GROUP BY 1, 2",
    "engagement": "SELECT CASE WHEN event_id % 3 = 0 THEN user_id % 6 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN event_id % 4 ELSE 0 END + 1 >= 5 AS engaged, count(*) AS n FROM events GROUP BY 1",
    "symbol_hints": f"WITH {TEXTS}, h AS (SELECT doc_id, {_HINTS} AS h FROM texts), u AS (SELECT doc_id, {_UNIQUE('h')} AS h, ['AAPL', 'BRK.B'] AS s FROM h) SELECT doc_id, array_to_string(h, ',') AS hints, array_to_string(s, ',') AS symbols, array_to_string(CASE WHEN list_contains(h, 'AAPL') THEN h ELSE list_append(h, 'AAPL') END, ',') AS joined FROM u",
    "annotation_task": "SELECT row_number() OVER (ORDER BY doc_id, text) - 1 AS idx, md5(text) AS digest FROM documents",
    "classify_column": f"WITH {SCORED} SELECT 'doc_' || substr(sha1('csv|' || doc_id || '|'), 1, 16) AS id, sentiment_label, sentiment_score, CASE WHEN doc_id % 2 = 0 THEN '2026-01-05 10:00:00' ELSE '2026-02-01 00:00:00' END AS published_at FROM scored WHERE length(trim(text)) > 0",
    "normalize_records": "WITH b AS (SELECT doc_id, nullif(trim(CASE WHEN doc_id % 2 = 0 THEN source END), '') AS t, nullif(trim(CASE WHEN doc_id % 3 > 0 THEN text END), '') AS s, nullif(trim(CASE WHEN doc_id % 7 > 0 THEN text END), '') AS x FROM documents), c AS (SELECT *, CASE WHEN t IS NOT NULL AND s IS NOT NULL THEN t || chr(10) || chr(10) || s ELSE coalesce(t, x) END AS full_text FROM b) SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'stocks' ELSE 'unknown' END AS source, CASE doc_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'twitter' ELSE '' END AS data_source, md5(full_text) AS digest, ['2026-01-05 10:00:00', '2026-01-05 10:00:00', '2026-01-05 00:00:00', '2026-01-05 00:00:00', '2026-02-01 00:00:00'][doc_id % 5 + 1] AS published_at FROM c WHERE full_text IS NOT NULL",
    "normalize_article": f"SELECT CAST(page_id AS VARCHAR) AS source_id, {clean('url')} AS clean_title, md5({clean('html')}) AS description, md5({clean("(html || ' [+12 chars]')")}) AS content FROM pages",
    "normalize_tweet": f"WITH {TEXTS} SELECT CAST(doc_id AS VARCHAR) AS id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\s]+', '', 'g'), '@{_WORD}+', '', 'g'), '#({_WORD}+)', '\\1', 'g'), '\\s+', ' ', 'g'))) AS digest, doc_id % 5 AS retweet_count, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS reply_count, 0::BIGINT AS like_count FROM texts",
    "batch_summary": f"WITH {SCORED} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (sentiment_label = '{x}') AS {x}" for x in LABELS)}, count(*) FILTER (doc_id % 10 = 0) AS failed, {r('avg(sentiment_score)', 6)} AS mean_confidence FROM scored",
    "tokens_quality": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT doc_id, {_SPLIT('text')} AS b, {normal('text')} AS t FROM d), a AS (SELECT *, {_SPLIT('t')} AS a FROM n) SELECT doc_id, {_share('len(a)', 3, 'len(b)')} AS retention_rate, {_share('len(list_distinct(a))', 3)} AS unique_token_ratio, {_share(f'len(list_filter(a, lambda w: list_contains({words(FINANCIAL_TERMS)}, lower(w))))', 3)} AS financial_term_density, {_share("length(array_to_string(a, ''))", 2)} AS avg_token_length, CAST(len(list_distinct(regexp_extract_all(t, '\\$[A-Z]{{1,5}}\\b'))) AS INTEGER) AS ticker_count, contains(t, '_') OR contains(t, 'not') OR contains(t, 'no') OR contains(t, 'never') OR contains(t, 'neither') AS has_negations FROM a",
    "negation_join": f"WITH {TEXTS}, s AS (SELECT doc_id, {_SPLIT('text')} AS ws FROM texts), w AS (SELECT doc_id, i, ws[i] AS w, {_NEG} AS neg FROM s, unnest(range(1, len(ws) + 1)) AS t(i)), g AS (SELECT *, neg AND (i - coalesce(max(CASE WHEN NOT neg THEN i END) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 2 = 1 AS held FROM w), h AS (SELECT *, coalesce(lag(held) OVER o, false) AS taken, lead(w) OVER o AS after FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)), j AS (SELECT doc_id, string_agg(CASE WHEN held AND after IS NOT NULL THEN regexp_replace(w, '[.,!?;:]+$', '') || '_' || after ELSE w END, ' ' ORDER BY i) AS t FROM h WHERE NOT taken GROUP BY doc_id) SELECT s.doc_id, md5(coalesce(t, '')) AS digest FROM s LEFT JOIN j ON s.doc_id = j.doc_id",
    "normalize_text": f"{_NORMAL} SELECT doc_id, md5(t) AS digest FROM n",
    "preprocess_stats": f"{_NORMAL}, w AS (SELECT {_SPLIT('t')} AS ws FROM n) SELECT 'minimal' AS preset, {_TOTALS} FROM (SELECT len(ws) AS k FROM w) UNION ALL SELECT 'standard', {_TOTALS} FROM (SELECT len(list_filter(ws, lambda x: NOT list_contains({_STOPPED}, x))) AS k FROM w)",
    "top_stocks_named": f"{STOCKS}, t AS (SELECT ticker, {COUNTS} FROM s GROUP BY ticker ORDER BY total DESC, ticker LIMIT 10) SELECT t.*, coalesce(s_name, ticker) AS company_name FROM t LEFT JOIN supplier ON ticker = 'T' || s_suppkey",
    "statistics": f"{STOCKS}, k AS (SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, ticker, coalesce(data_source, 'unknown') AS source, sentiment_label FROM s) SELECT CASE WHEN source IS NOT NULL THEN 'source' WHEN ticker IS NOT NULL THEN 'ticker' WHEN day IS NOT NULL THEN 'day' ELSE 'all' END AS section, coalesce(source, ticker, day, '') AS key, {COUNTS} FROM k GROUP BY GROUPING SETS ((), (source), (ticker), (day))",
    "page_with_total": f"WITH {RECORDS}, f AS (SELECT *, count(*) OVER () AS total FROM recs WHERE sentiment_label = 'negative' AND CAST(published_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}') SELECT id, ticker, total, total > 60 AS has_more FROM f ORDER BY published_at DESC, id LIMIT 20 OFFSET 40",
    "mention_page": f"WITH {RECORDS}, f AS (SELECT *, count(*) OVER () AS total_count FROM recs WHERE ticker = 'T3' AND data_source = 'reddit') SELECT id, sentiment_label, total_count FROM f ORDER BY published_at DESC, id LIMIT 50 OFFSET 10",
    "record_lookup": f"WITH {RECORDS} SELECT id, ticker, sentiment_label FROM recs ORDER BY published_at DESC, id LIMIT 1",
    "emotion_days": f"{STOCKS}, e AS (SELECT ticker, {day('published_at')} AS day, coalesce({_EMOTIONS}[event_id % 7 + 1], 'mixed') AS e FROM s), c AS (SELECT ticker, day, count(*) AS total_mentions, {', '.join(f"count(*) FILTER (e = '{x}') AS {x}" for x in EMOTIONS)} FROM e GROUP BY 1, 2) SELECT *, CASE greatest({', '.join(EMOTIONS)}) {' '.join(f"WHEN {x} THEN '{x}'" for x in EMOTIONS)} END AS top_emotion FROM c",
    "window_mentions": f"{STOCKS}, {PRICES}, p AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM prices), b AS (SELECT ticker, CAST(min(date) AS TIMESTAMP) AS a, CAST(max(date) + 1 AS TIMESTAMP) - INTERVAL 1 SECOND AS z FROM p WHERE date > last - 20 GROUP BY ticker) SELECT s.ticker, {stamp('a')} AS start_at, {stamp('z')} AS end_at, count(*) AS mentions FROM s JOIN b ON s.ticker = b.ticker AND published_at BETWEEN a AND z GROUP BY 1, 2, 3",
    "headline_records": f"WITH h AS (SELECT {clean('text')} AS t, CASE WHEN doc_id % 3 <> 0 THEN 'https://example.org/' || doc_id ELSE '' END AS url, source, doc_id FROM documents) SELECT substr(sha256(url || chr(10) || substr(t, 1, 200)), 1, 32) AS source_id, substr(trim(regexp_replace(source, '\\s+', ' ', 'g')), 1, 80) AS source_name, md5(t) AS digest, url, CASE WHEN doc_id % 2 = 0 THEN 'AAPL' ELSE '' END AS hints FROM h WHERE length(t) >= 12",
    "archive_records": f"WITH a AS (SELECT doc_id, source, {clean('text')} AS b, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'abc' ELSE {clean('text')} END AS t, CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id ELSE '' END AS url FROM documents WHERE lang IS NULL OR lower(lang) IN ('en', 'eng')) SELECT substr(sha256(CASE WHEN url <> '' THEN url ELSE 'f' || doc_id END), 1, 32) AS source_id, substr(trim(source), 1, 80) AS source_name, md5(CASE WHEN t <> '' THEN t WHEN length(b) > 240 THEN substr(b, 1, 240) || '…' ELSE b END) AS title, md5(CASE WHEN length(b) > 12000 THEN substr(b, 1, 12000) || '…' ELSE b END) AS body, url FROM a WHERE NOT (length(t) < 6 AND length(b) < 30)",
    "clean_tweet": f"WITH {TEXTS} SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\s]+', '', 'g'), '@{_WORD}+', '', 'g'), '#({_WORD}+)', '\\1', 'g'), '\\s+', ' ', 'g'))) AS digest FROM texts",
    "lemmas": f"WITH {TEXTS} SELECT doc_id, md5(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda w: {_LEMMA}), ' ')) AS digest FROM texts",
    "article_quality": f"WITH a AS (SELECT {clean('text')} AS c, coalesce(text, '') AS t FROM documents) SELECT length(c) >= 10 AND NOT contains(lower(t), '[removed]') AND (c = '' OR length(c) >= 100) AND c <> '' AS keep, count(*) AS n FROM a GROUP BY 1",
    "tweet_quality": f"{_LOW}, e AS (SELECT *, len(regexp_extract_all(text, '{EMOJI}')) AS emoji FROM low) SELECT NOT regexp_matches(l, '{_SPAM}') AND length(trim(text)) >= CASE WHEN contains(text, '$') THEN 8 ELSE 15 END AND emoji <= 8 AND length(text) - length(replace(text, '#', '')) <= 12 AND length(text) - length(replace(text, '$', '')) <= 15 AND NOT regexp_matches(text, '^[\\x{{1F000}}-\\x{{1FFFF}}\\s]{{12,}}') AS keep, count(*) AS n FROM e GROUP BY 1",
    "movements": f"WITH {TEXTS}, m AS (SELECT doc_id, regexp_extract_all(text, '{MOVEMENT}') AS ms FROM texts), f AS (SELECT doc_id, ms, ms[1] AS m FROM m) SELECT doc_id, CAST(len(ms) AS INTEGER) AS n, CASE WHEN m IS NULL THEN '' WHEN {_UP} THEN 'positive' ELSE 'negative' END AS direction FROM f",
    "context_flags": f"{_LOW}, f AS (SELECT doc_id, {_FLAGS} FROM low) SELECT *, {' + '.join(f'CAST(has_{n} AS INTEGER)' for n in CONTEXT)} >= 2 AS financial FROM f",
    "sentence_split": f"WITH {TEXTS}, w AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM texts), p AS (SELECT doc_id, t, len(list_filter(string_split(regexp_replace(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 12)) AS k FROM w) SELECT doc_id, CAST(CASE WHEN k > 0 THEN k WHEN t <> '' THEN 1 ELSE 0 END AS INTEGER) AS sentences FROM p",
    "class_agreement": f"WITH {JUDGED} SELECT truth AS label, count(*) AS n, count(*) FILTER (truth = second) AS agree, {r('count(*) FILTER (truth = second) / count(*)', 4)} AS agreement FROM j GROUP BY 1",
    "daily_trend": f"{STOCKS} SELECT {day('d')} AS day, total, {r(NET, 4)} AS net FROM (SELECT CAST(published_at AS DATE) AS d, {COUNTS} FROM s GROUP BY 1)",
    "label_distribution": f"{STOCKS} SELECT total, positive, negative, neutral, {PERCENTS} FROM (SELECT {COUNTS} FROM s)",
    "label_distribution_by_source": f"{STOCKS} SELECT data_source, total, positive, negative, neutral, {PERCENTS} FROM (SELECT data_source, {COUNTS} FROM s WHERE data_source IS NOT NULL GROUP BY 1)",
    "top_stocks": f"{STOCKS} SELECT ticker, {COUNTS} FROM s GROUP BY ticker ORDER BY total DESC, ticker LIMIT 10",
    "distinct_tickers": f"{STOCKS} SELECT count(DISTINCT ticker) AS tickers FROM s",
    "date_range": f"{STOCKS} SELECT {stamp('min(published_at)')} AS first_at, {stamp('max(published_at)')} AS last_at FROM s",
    "recent_activity": f"{STOCKS}, x AS (SELECT max(published_at) AS n FROM s) SELECT " + ", ".join(f"count(*) FILTER (published_at >= n - INTERVAL {k} DAY) AS last_{k}" for k in (1, 7, 30)) + " FROM s, x",
    "source_comparison": f"{STOCKS}, f AS (SELECT data_source, {COUNTS} FROM s GROUP BY 1), a AS (SELECT c.data_source, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral FROM (SELECT unnest({words(CHANNELS)}) AS data_source) c LEFT JOIN f ON c.data_source = f.data_source) SELECT data_source, total, positive, negative, neutral, {PERCENTS} FROM a",
    "source_disagreement": f"{STOCKS}, a AS (SELECT CAST(published_at AS DATE) AS d, data_source, {COUNTS} FROM s WHERE data_source IS NOT NULL GROUP BY 1, 2), b AS (SELECT d, total, CASE WHEN total >= 3 THEN {r(NET, 4)} END AS net FROM a) SELECT {day('d')} AS day, CAST(sum(total) AS BIGINT) AS total_mentions, count(net) AS channels, CASE WHEN count(net) >= 2 THEN {r('max(net) - min(net)', 4)} END AS net_range, CASE WHEN count(net) >= 2 THEN {r('stddev_pop(net)', 4)} END AS net_std FROM b GROUP BY d",
    "trailing_days_stats": f"{STOCKS}, t AS (SELECT * FROM s WHERE data_source = 'reddit'), x AS (SELECT max(published_at) AS n FROM t) SELECT total, positive, negative, neutral, {PERCENTS} FROM (SELECT {COUNTS} FROM t, x WHERE published_at >= n - INTERVAL 7 DAY)",
    "ticker_aggregate": f"{STOCKS} SELECT ticker, {COUNTS}, {r('avg(sentiment_score)', 4)} AS avg_score FROM s GROUP BY ticker",
    "compare_tickers": f"{STOCKS}, a AS (SELECT ticker, {COUNTS}, {r('avg(sentiment_score)', 4)} AS avg_score FROM s GROUP BY ticker) SELECT q.position, q.ticker, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(avg_score, 0.0) AS avg_score FROM (VALUES {', '.join(f'({i}, {t!r})' for i, t in enumerate(COMPARED))}) q(position, ticker) LEFT JOIN a ON q.ticker = a.ticker",
    "trending": f"{STOCKS}, x AS (SELECT max(published_at) AS n FROM recs) SELECT ticker, count(*) AS mentions FROM s, x WHERE published_at >= n - INTERVAL 24 HOUR GROUP BY ticker HAVING count(*) >= 5 ORDER BY mentions DESC, ticker LIMIT 10",
    "global_stats": f"WITH {RECORDS} SELECT count(*) AS total, count(DISTINCT ticker) AS tickers, {stamp('max(published_at)')} AS last_updated FROM recs",
    "daily_sentiment": f"{STOCKS} SELECT ticker, {day('d')} AS date, total AS mention_count, {r('a', 6)} AS avg_score, {', '.join(f'{r(f'{x} / total', 6)} AS {x}_ratio' for x in LABELS)} FROM (SELECT ticker, CAST(published_at AS DATE) AS d, {COUNTS}, avg(sentiment_score) AS a FROM s GROUP BY 1, 2)",
    "recent_summary": f"{STOCKS}, t AS (SELECT * FROM s WHERE ticker = 'T3' ORDER BY published_at DESC, id LIMIT 100) SELECT total, positive, negative, neutral, {PERCENTS}, avg_score FROM (SELECT {COUNTS}, {r('avg(sentiment_score)', 3)} AS avg_score FROM t)",
    "data_signature": f"{STOCKS} SELECT ticker, substr(sha256(count(*) || '|' || strftime(min(published_at), '%Y-%m-%dT%H:%M:%S') || '|' || strftime(max(published_at), '%Y-%m-%dT%H:%M:%S')), 1, 48) AS signature FROM s GROUP BY ticker",
    "label_by_source": f"WITH {RECORDS} SELECT sentiment_label AS label, coalesce(data_source, 'unknown') AS source, count(*) AS n FROM recs GROUP BY 1, 2",
    "longest_gap": f"{STOCKS}, {_GAP} SELECT * FROM gaps",
    "stock_quality": f"""{STOCKS}, {_GAP}, {_QUALITY}, x AS (SELECT q.*, days_with_mentions, longest_gap, DATE '{END}' - DATE '{START}' + 1 AS cal, neutral / greatest(total, 1) AS ns, greatest({', '.join(f'n_{c}' for c in CHANNELS)}) AS most FROM q JOIN gaps ON q.ticker = gaps.ticker),
f AS (SELECT *, ns >= 0.58 AS heavy, most / total >= 0.82 AND total >= 8 AS skew, cal >= 14 AND days_with_mentions / cal < 0.25 AND total >= 5 AS sparse, longest_gap >= 14 AND cal >= 21 AS quiet FROM x),
z AS (SELECT *, {r('CASE WHEN total < 5 THEN 0.28 WHEN total < 15 THEN 0.48 WHEN total < 40 THEN 0.72 ELSE 1.0 END * CASE WHEN heavy THEN 0.92 ELSE 1.0 END * CASE WHEN skew THEN 0.86 ELSE 1.0 END * CASE WHEN sparse THEN 0.82 ELSE 1.0 END * CASE WHEN quiet THEN 0.9 ELSE 1.0 END', 2)} AS score FROM f)
SELECT ticker, total, {r('ns', 4)} AS neutral_share, days_with_mentions, CAST(cal AS INTEGER) AS calendar_days, {r('days_with_mentions / cal', 4)} AS coverage, CAST(longest_gap AS INTEGER) AS longest_gap,
concat_ws(',', CASE WHEN total < 5 THEN 'very_thin_sample' WHEN total < 15 THEN 'thin_sample' WHEN total < 40 THEN 'moderate_sample' END, CASE WHEN heavy THEN 'neutral_heavy' END, CASE WHEN skew THEN 'channel_skew' END, CASE WHEN sparse THEN 'sparse_calendar_coverage' END, CASE WHEN quiet THEN 'long_quiet_period' END) AS flags,
score, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.42 THEN 'medium' ELSE 'low' END AS confidence FROM z""",
    "predictions_page": f"{STOCKS} SELECT id, ticker, sentiment_label, data_source FROM s WHERE sentiment_label = 'positive' ORDER BY published_at DESC, id LIMIT 20 OFFSET 40",
    "prediction_stats": f"WITH {RECORDS} SELECT sentiment_label, data_source, count(*) AS n, {r('avg(sentiment_score)', 4)} AS mean_confidence, {stamp('min(published_at)')} AS first_at, {stamp('max(published_at)')} AS last_at FROM recs GROUP BY 1, 2",
    "run_summary": f"WITH {RECORDS} SELECT sentiment_label, {r('avg(sentiment_score)', 6)} AS mean, {r('coalesce(stddev_samp(sentiment_score), 0)', 6)} AS std, min(sentiment_score) AS min, max(sentiment_score) AS max, count(sentiment_score) AS n FROM recs GROUP BY 1",
    "record_ids": f"WITH {RECORDS} SELECT event_id, id, 'doc_' || substr(sha1('events|' || event_id || '|'), 1, 16) AS doc_id FROM recs",
    "daily_returns": f"WITH {PRICES}, r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS v FROM prices) SELECT ticker, {day('date')} AS date, {r('v', 6)} AS returns FROM r WHERE v IS NOT NULL",
    "sma": f"WITH {PRICES} SELECT ticker, {day('date')} AS date, close, " + ", ".join(f"CASE WHEN count(close) OVER w{n} = {n} THEN {r(f'avg(close) OVER w{n}', 4)} END AS sma_{n}" for n in (5, 20)) + " FROM prices WINDOW " + ", ".join(f"w{n} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 20)),
    "merged_series": f"{MERGED} SELECT ticker, {day('date')} AS date, mention_count, {r('net_sentiment', 6)} AS net_sentiment, {r('returns', 6)} AS returns FROM m",
    "trailing_net": f"{MERGED} SELECT ticker, {day('date')} AS date, {r('trailing_net_sentiment', 4)} AS trailing_net FROM m",
    "forward_return": f"{MERGED} SELECT ticker, {day('date')} AS date, {r('forward_1d_return', 6)} AS forward_return FROM m",
    "spy_beta_excess": f"{MERGED} SELECT ticker, {day('date')} AS date, {r('beta', 4)} AS beta, {r('excess_returns', 5)} AS excess, {r('forward_1d_excess_return', 5)} AS forward_excess FROM m",
    "pearson_by_ticker": f"{MERGED} {correlation('trailing_net_sentiment', 'returns')}",
    "pearson_forward_excess": f"{MERGED} {correlation('trailing_net_sentiment', 'forward_1d_excess_return')}",
    "spearman_by_ticker": f"{MERGED}, k AS (SELECT ticker, " + ", ".join(f"rank() OVER (PARTITION BY ticker ORDER BY {c}) + (count(*) OVER (PARTITION BY ticker, {c}) - 1) / 2 AS {a}" for c, a in (("net_sentiment", "rx"), ("returns", "ry"))) + f" FROM m) SELECT ticker, count(*) AS n, {r(f'CASE WHEN count(*) >= 5 THEN {pearson('rx', 'ry')} END', 4)} AS spearman_r FROM k GROUP BY ticker",
    "lag_sweep": f"{MERGED}, {SWEEP} SELECT ticker, CAST(lag AS INTEGER) AS lag, n, r FROM sweep",
    "best_lag": f"{MERGED}, {SWEEP} SELECT ticker, CAST(lag AS INTEGER) AS lag, n, r FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(r) DESC, lag) AS k FROM sweep WHERE r IS NOT NULL) WHERE k = 1",
    "rolling_corr_14": f"{MERGED}, {ROLLING} SELECT ticker, {day('window_start')} AS window_start, {day('window_end')} AS window_end, r FROM rolling",
    "rolling_corr_summary": f"{MERGED}, {ROLLING} SELECT ticker, count(*) AS windows, {r('avg(r)', 4)} AS mean, {r('stddev_pop(r)', 4)} AS std, min(r) AS least, max(r) AS most, count(*) FILTER (r > 0) AS positive, count(*) FILTER (r < 0) AS negative FROM rolling GROUP BY ticker",
    "out_of_sample": f"""{MERGED}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker) AS k FROM m),
p AS (SELECT ticker, CASE WHEN rn <= floor(k * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part, net_sentiment AS x, returns AS y, date FROM n), g AS (SELECT ticker, part, count(*) AS n, {r(pearson('x', 'y'), 4)} AS r, min(date) AS f FROM p GROUP BY 1, 2)
SELECT a.ticker, a.n AS train_n, a.r AS train_r, b.n AS test_n, b.r AS test_r, {day('b.f')} AS split_date FROM g a JOIN g b ON a.ticker = b.ticker AND a.part = 'train' AND b.part = 'test' WHERE a.n >= 5 AND b.n >= 5""",
    "correlation_overview": f"{MERGED}, c AS ({correlation('net_sentiment', 'returns')}), t AS (SELECT * FROM c WHERE n >= 5 AND pearson_r IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY abs(pearson_r) DESC, ticker) AS INTEGER) AS rank, ticker, n, pearson_r, 0.05::DOUBLE / (SELECT count(*) FROM t) AS bonferroni_alpha FROM t",
    "scatter_fit": f"""{MERGED}, p AS (SELECT ticker, net_sentiment AS x, returns * 100 AS y FROM m), f AS (SELECT ticker, count(*) AS n, CASE WHEN var_pop(x) * count(*) < 1e-14 THEN 0.0 ELSE covar_pop(x, y) / var_pop(x) END AS sl, avg(x) AS mx, avg(y) AS my,
count(*) FILTER (x >= 0 AND y >= 0) AS up_up, count(*) FILTER (x >= 0 AND y < 0) AS up_down, count(*) FILTER (x < 0 AND y >= 0) AS down_up, count(*) FILTER (x < 0 AND y < 0) AS down_down FROM p GROUP BY ticker)
SELECT ticker, n, {r('sl', 4)} AS slope, {r('my - sl * mx', 4)} AS intercept, up_up, up_down, down_up, down_down FROM f""",
    "keyword_sentiment": f"WITH {SCORED} SELECT doc_id, sentiment_label, sentiment_score FROM scored",
    "entropy": f"WITH {SCORED}, {SHARES}, {UNSURE} SELECT doc_id, {r('h', 6)} AS uncertainty FROM unsure",
    "emotion_infer": f"{EMOTIONAL} SELECT doc_id, emotion_label, {', '.join(f'emotion_{e}' for e in EMOTIONS)} FROM named",
    "emotion_distribution": emotions(),
    "emotion_ablation": f"{VARIED} " + " UNION ALL ".join(f"SELECT '{x}' AS variant, {r(f'count(*) FILTER ({x} IS DISTINCT FROM f) / count(*)', 4)} AS flipped FROM v" for x in ("no_entropy", "no_lexicon")),
    "emotion_variants": f"{VARIED} " + " UNION ALL ".join(f"SELECT '{x}' AS variant, {c} AS label, count(*) AS n FROM v GROUP BY 2" for x, c in (("full", "f"), ("no_entropy", "no_entropy"), ("no_lexicon", "no_lexicon"))),
    "emotion_timeline": emotions("source"),
    "stopword_filter": f"WITH {TEXTS} SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '' AND NOT list_contains({words([w for w in STOP_WORDS if w not in {*FINANCIAL_TERMS, *INTENSITY_WORDS}])}, lower(x)))) AS INTEGER) AS kept FROM texts",
    "cashtags": f"WITH {TEXTS} SELECT doc_id, array_to_string(regexp_extract_all(text, '\\$[A-Z]{{1,5}}\\b'), ',') AS cashtags FROM texts",
    "clean_html_news": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), 'https?://[^\\s]+', '', 'g'), '\\[\\+[0-9]+ chars\\]', '', 'g'), '(?i)\\[Removed\\]', '', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages",
    "dedupe_posts": "SELECT event_id % 500 AS id, max(event_id) AS ordinal, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1",
    "excerpts": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 80)",
    "cashtag_forms": f"WITH {TEXTS}, t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\$([A-Z]{{1,5}})\\b', 1))) AS a, list_transform(regexp_extract_all(text, '\\$([A-Za-z]{{1,6}})\\b', 1), lambda x: upper(x)) AS b FROM texts) SELECT doc_id, array_to_string(a, ',') AS tickers, array_to_string({_UNIQUE('b')}, ',') AS tags FROM t",
    "article_hints": f"WITH a AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['T' || (doc_id % 11), 'T' || (doc_id % 7)] ELSE [] END, CASE WHEN doc_id % 3 > 0 THEN ['T' || (doc_id % 7), upper(replace(source, '.', '-')), 'T' || (doc_id % 5)] ELSE [] END, ['T0', 'NOBODY', 'T' || (doc_id % 10)]) AS h FROM documents), u AS (SELECT list('T' || s_suppkey) AS u FROM supplier), f AS (SELECT doc_id, list_filter(h, lambda t: list_contains(u, t)) AS h FROM a, u) SELECT doc_id, array_to_string({_UNIQUE('h')}, ',') AS hints FROM f",
    "scraped_posts": f"WITH {TEXTS}, t AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '\\$([A-Za-z]{{1,6}})\\b', 1), lambda x: upper(x)) AS b FROM texts) SELECT doc_id AS id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\s]+', '', 'g'), '@{_WORD}+', '', 'g'), '#({_WORD}+)', '\\1', 'g'), '\\s+', ' ', 'g'))) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'AAPL,TSLA' ELSE array_to_string({_UNIQUE('b')}, ',') END AS hints, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '' END AS author_id, '2026-01-05T10:00:00' AS created_at, (doc_id % 5)::INTEGER AS retweet_count, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END::INTEGER AS reply_count, 0 AS like_count, 1 AS quote_count FROM t",
    "data_signature_ingested": f"{STOCKS} SELECT ticker, substr(sha256(count(*) || '|' || strftime(min(published_at), '%Y-%m-%dT%H:%M:%S') || '|' || strftime(max(published_at), '%Y-%m-%dT%H:%M:%S') || '|' || strftime(max(published_at + to_days((event_id % 9)::INTEGER)), '%Y-%m-%dT%H:%M:%S')), 1, 48) AS signature FROM s GROUP BY ticker",
    "time_series": f"{MERGED}, more AS (SELECT m.*, p.close, {', '.join(r(f'd.{x} / d.total', 6) + f' AS {x}_ratio' for x in LABELS)}, {r('d.avg_score', 6)} AS avg_score FROM m JOIN daily d ON d.ticker = m.ticker AND d.date = m.date JOIN prices p ON p.ticker = m.ticker AND p.date = m.date) SELECT ticker, {day('date')} AS date, mention_count, {r('close', 2)} AS close, {', '.join(r(x, 6) + f' AS {n}' for x, n in (('returns', 'returns'), ('spy_returns', 'spy_returns'), ('excess_returns', 'excess_returns'), ('forward_1d_return', 'forward_1d_return'), ('forward_1d_excess_return', 'forward_excess_return')))}, {', '.join(r(x, 4) + f' AS {n}' for x, n in (('avg_score', 'avg_sentiment_score'), ('net_sentiment', 'net_sentiment'), ('trailing_net_sentiment', 'trailing_net_sentiment'), *((f'{x}_ratio', f'{x}_ratio') for x in LABELS)))} FROM more",
    "table_posts": f"WITH {TEXTS}, t AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['TSLA'] ELSE [] END, list_transform(regexp_extract_all(text, '\\$([A-Za-z]{{1,6}})\\b', 1), lambda x: upper(x))) AS b, text FROM texts) SELECT array_to_string({_UNIQUE('b')}, ',') AS hints, CASE WHEN doc_id % 4 > 0 THEN '2026-01-05' ELSE '' END AS created_at, count(*) AS n, count(DISTINCT (doc_id % 4 > 0, text, doc_id % 2 = 0)) AS ids FROM t GROUP BY 1, 2",
    "rationales": f"WITH {SCORED}, {SHARES}, {UNSURE}, o AS (SELECT *, list_sort([{{'p': -p0, 'i': 0, 'x': 'positive'}}, {{'p': -p1, 'i': 1, 'x': 'negative'}}, {{'p': -p2, 'i': 2, 'x': 'neutral'}}])[2] AS r FROM unsure) SELECT doc_id, concat_ws(' ', {said('top', label='sentiment_label', top=pct('sentiment_score'), p=pct('p0'), n=pct('p1'), neu=pct('p2'))}, CASE WHEN h >= 0.88 THEN {said('high')} WHEN h >= 0.75 THEN {said('mixed')} END, CASE WHEN -r.p >= 0.22 AND sentiment_score < 0.65 THEN {said('second', second='r.x', share=pct('-r.p'))} END, CASE WHEN p2 >= 0.35 AND sentiment_label <> 'neutral' THEN {said('neutral')} END) AS rationale FROM o",
    "insert_if_absent": f"WITH {RECORDS} SELECT ticker, count(*) AS n FROM recs WHERE data_source IS DISTINCT FROM 'reddit' GROUP BY ticker",
    "stored_insert": f"WITH {RECORDS} SELECT ticker, sentiment_label, count(*) AS n FROM recs GROUP BY 1, 2",
    "stored_upsert": f"WITH {RECORDS} SELECT ticker, CASE WHEN sentiment_label = 'negative' THEN 'neutral' ELSE sentiment_label END AS sentiment_label, count(*) AS n FROM recs GROUP BY 1, 2",
    "source_kinds": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'twitter' WHEN doc_id % 7 = 1 THEN 'news' WHEN doc_id % 5 = 0 THEN 'reddit' WHEN doc_id % 5 = 1 THEN 'twitter' WHEN doc_id % 5 = 2 THEN 'news' ELSE 'unknown' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "treebank_tokens": f"WITH {TEXTS}, p AS (SELECT doc_id, string_split(regexp_replace(text, {quoted(SENTENCE_END)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM texts), w AS (SELECT doc_id, flatten(list_transform(s, lambda x: {_TREEBANK})) AS w FROM p) SELECT doc_id, len(w)::INTEGER AS n, md5(array_to_string(w, ' ')) AS digest FROM w",
    "insert_again": f"WITH {RECORDS} SELECT ticker, count(*) AS n FROM recs WHERE ticker IS DISTINCT FROM 'T0' GROUP BY ticker",
    "prune_oldest": f"WITH {RECORDS} SELECT count(*) AS rows, {stamp('min(published_at)')} AS first_at, {stamp('max(published_at)')} AS last_at FROM (SELECT * FROM recs ORDER BY published_at, id OFFSET 500)",
    "confusion": f"WITH {JUDGED} SELECT t AS truth, p AS predicted, count(j.doc_id) AS n FROM (SELECT unnest(['positive', 'negative']) AS t) CROSS JOIN (SELECT unnest(['positive', 'negative']) AS p) LEFT JOIN j ON truth = t AND first = p GROUP BY 1, 2",
    "class_scores": f"WITH {JUDGED} {prf('first')}",
    "model_comparison": f"WITH {JUDGED}, a AS ({overall('first')} UNION ALL {overall('second')}), f AS (SELECT accuracy AS fa, macro_f1 AS ff FROM a WHERE model = 'first') SELECT n, accuracy, macro_precision, macro_recall, macro_f1, model, {r('accuracy - fa', 4)} AS accuracy_delta, {r('macro_f1 - ff', 4)} AS macro_f1_delta FROM a, f",
    "mcnemar": f"WITH {JUDGED}, x AS (SELECT count(*) FILTER (first = truth AND second <> truth) AS b, count(*) FILTER (first <> truth AND second = truth) AS c FROM j) SELECT b, c, b + c AS discordant, {r('coalesce((abs(b - c) - 1) * (abs(b - c) - 1) / nullif(b + c, 0), 0.0)', 6)} AS chi2 FROM x",
    "kappa": f"""WITH {JUDGED}, t AS (SELECT count(*) AS n, count(*) FILTER (first = second) / count(*) AS po FROM j), e AS (SELECT sum(x * y) / ((SELECT n FROM t) * (SELECT n FROM t)) AS pe FROM (SELECT first AS a, count(*) AS x FROM j GROUP BY 1) JOIN (SELECT second AS b, count(*) AS y FROM j GROUP BY 1) ON a = b),
k AS (SELECT n, po, pe, (po - pe) / (1 - pe) AS kappa, sqrt(po * (1 - po) / n) / (1 - pe) AS se FROM t, e) SELECT n, {r('po', 4)} AS observed, {r('pe', 4)} AS expected, {r('kappa', 4)} AS kappa, {r('se', 4)} AS se, {r('kappa / se', 4)} AS z FROM k""",
    "stratified_folds": f"WITH {JUDGED}, s AS (SELECT truth, count(*) AS k FROM j GROUP BY 1) SELECT truth, CAST(fold AS INTEGER) AS fold, (k - fold - 1) // 5 + 1 AS n FROM s, (SELECT unnest(range(5)) AS fold) WHERE k > fold",
}
