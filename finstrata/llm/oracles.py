"""DuckDB SQL for the rows of those queries that SQL can express on whole tables."""

SUBSTRING_DEDUP = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT r, i, list_aggregate(words[i:i + 34], 'string_agg', ' ') AS path FROM docs, unnest(range(1, len(words) - 33)) AS t(i)
), repeated AS (
    SELECT r, i FROM windows WHERE path IN (SELECT path FROM windows GROUP BY path HAVING count(*) > 1)
), gone AS (
    SELECT DISTINCT r, i + d AS at FROM repeated, unnest(range(0, 35)) AS t(d)
), each AS (
    SELECT d.r, t.i, d.words[t.i] AS word FROM docs AS d, unnest(range(1, len(d.words) + 1)) AS t(i)
), kept AS (
    SELECT e.r, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.i) AS text FROM each AS e ANTI JOIN gone AS g ON e.r = g.r AND e.i = g.at GROUP BY e.r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.r = kept.r
"""

# All pairs of texts with a shingle in common, verified; classes by following links until nothing changes.
JACCARD_JOIN = r"""
WITH RECURSIVE docs AS (
    SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
), rows AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM docs
), sets AS (
    SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS s FROM rows, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(i) WHERE len(words) > 0
), sizes AS (
    SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS same FROM sets GROUP BY r
), kinds AS (  -- a set stands for all rows that have it
    SELECT same, min(r) AS k, any_value(n) AS n, count(*) AS copies FROM sizes GROUP BY same
), of AS (
    SELECT k, s FROM kinds JOIN sets ON sets.r = kinds.k
), shared AS (
    SELECT a.k AS a, b.k AS b, count(*) AS c FROM of AS a JOIN of AS b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k
), links AS (
    SELECT a, b FROM shared JOIN kinds AS x ON x.k = a JOIN kinds AS y ON y.k = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-4
), reached AS (
    SELECT k, k AS near FROM kinds UNION SELECT reached.k, links.b FROM reached JOIN links ON links.a = reached.near
), lows AS (
    SELECT kinds.k, min(doc_id) AS low FROM kinds JOIN sizes USING (same) JOIN rows ON rows.r = sizes.r GROUP BY kinds.k
), classes AS (
    SELECT reached.k, min(low) AS class FROM reached JOIN lows ON lows.k = reached.near GROUP BY reached.k
), others AS (
    SELECT a AS k, sum(copies) AS o FROM links JOIN kinds ON kinds.k = b GROUP BY a
)
SELECT rows.doc_id, CASE WHEN n IS NULL THEN rows.doc_id ELSE class END AS class_id, CASE WHEN n IS NULL THEN rows.doc_id ELSE low END AS copy_id,
    coalesce(n, 0)::BIGINT AS n_shingles, coalesce(copies - 1 + coalesce(o, 0), 0)::BIGINT AS n_links
FROM rows LEFT JOIN (SELECT sizes.r, kinds.k, kinds.n, copies, class, low, o FROM sizes JOIN kinds USING (same) JOIN classes USING (k) JOIN lows USING (k) LEFT JOIN others USING (k)) AS x ON x.r = rows.r
"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_PRODUCTS = f"""
WITH rows AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {FINITE}
), scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS c_row, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
    FROM rows AS q JOIN rows AS c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, c_row)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def centroids(k: int = 8, rounds: int = 10) -> str:
    """All distances in every round."""
    parts = [f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE}
), c0 AS MATERIALIZED (
    SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept) WHERE c < {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (
    SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}
), a{i} AS MATERIALIZED (
    SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS nearest FROM d{i}) WHERE nearest = 1
)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
    SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i} JOIN kept USING (r), unnest(range(1, 65)) AS t(i) GROUP BY c, i
), c{i + 1} AS MATERIALIZED (
    SELECT c{i}.c, coalesce(q, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM m{i} GROUP BY c) AS x ON x.c = c{i}.c
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


COLLOCATIONS = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), places AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS s(k)
), grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places
), f AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), found AS MATERIALIZED (
    SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30
), cuts AS (
    SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM found)
), scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score, c
    FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = c.first AND x.k = c.c JOIN f AS y ON y.lang = c.lang AND y.phrase = c.rest AND y.k = c.k - c.c
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), longer AS (
    SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM found, (VALUES (2), (3)) AS s(n) WHERE n < k) GROUP BY ALL
), ranked AS (
    SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank FROM lowest AS x LEFT JOIN longer AS y ON x.lang = y.lang AND x.phrase = y.phrase
    WHERE most IS NULL OR 100 * most < 80 * a
), sizes AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
