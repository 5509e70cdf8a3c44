import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from finstrata.llm.ann import cost_of_parallel, encode, fit_books, nearest, subvectors
from finstrata.llm.html_text import extract_text, main_text

LONG = "This is the long text of an article that has many words in it, and it goes on for a while so that it is clear."


CHINESE = "今天的天气很好，我们一起去公园散步，看到很多人在那里运动，还有孩子们在草地上玩耍，大家都觉得非常开心。" * 2


@pytest.mark.parametrize("part", ["<p class=\"a", "<a href='", "<", "<!-", "<div ", "<script>", "</", "a&amp;", "<p><b><i>", "<div>", "<div>a", "<div class=comment>a</p>", "</div><div>"])
def test_long_broken_pages_take_no_long(part):
    import time

    began = time.perf_counter()
    main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>Title</h1><p>Short.</p></article>", "Title\n\nShort."),
        (f"<div><p>{LONG}</p><p>Short.</p></div>", f"{LONG}\n\nShort."),
        (f"<header><p>{LONG}</p></header><main><p>A &amp; B&nbsp;&#8212;\n  C</p></main>", "A & B — C"),
        (f"<article><p>{LONG}<div class='ad'>{LONG}</div><p>End</p></article><section id=comments><p>{LONG}</p></section>", f"{LONG}\n\nEnd"),
        (f"<nav>{LONG}</nav><p>{LONG}</p><footer>{LONG}</footer>", LONG),
        (f"<script>var a='<p>{LONG}</p>';</script><style>p{{}}</style><p>{LONG}", LONG),
        (f"<!-- <p>{LONG}</p> --><p>{LONG}<br>next<br><br>par</p>", f"{LONG} next\n\npar"),
        (f"<div class='cookie-notice'><p>{LONG}</p></div><form><p>{LONG}</p></form><p>{LONG}</p>", LONG),
        (f"<p>{LONG}</p><ul><li><a href=x>one link here</a></li><li><a href=y>two links</a></li></ul>", LONG),
        ("just text", ""),
        *((f"<nav><a href=x>Home</a></nav><div class='{name}'><p>{LONG}</p><p>Short.</p></div>", f"{LONG}\n\nShort.") for name in ("comment", "widget", "related", "teaser", "notice", "text social")),
        *((f"<div class='{name}'><p>{LONG}</p></div><div class='{name}'><p>{LONG}</p></div><div><p>{LONG}</p></div>", LONG) for name in ("comment", "teaser")),
        (f"<div class=notice><p>{LONG}</p></div><div><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class='cc-window'><p>{LONG}</p></div>", LONG),
        ("<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000, LONG),
        (LONG, LONG),
        (f"<div class='content has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div class='post share-buttons-on'><p>{LONG}</p></div>", LONG),
        (f"<div class='entry no-comments wide'><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div>", LONG),
        (f"<div id='related-work'><p>{LONG}</p><p>Short.</p></div>", f"{LONG}\n\nShort."),
        (f"<p>{LONG}</p><div id='related-work'><p>{LONG[:80]}</p></div>", LONG),
        (f"<nav><a href=x>一</a></nav><p>{CHINESE}</p><div class=ad>{CHINESE}</div>", CHINESE),
        ("<h2>Notes</h2><p>It rains.</p><p>It stops.</p><ul><li><a href=x>Home.</a></li></ul>", "Notes\n\nIt rains.\n\nIt stops."),
        (f"<article><p>{LONG}</p><ul><li><a href=x>{LONG[:60]}</a></li></ul><p>%%% $$$ {'q1x ' * 30}</p></article>", f"{LONG}\n\n%%% $$$ {('q1x ' * 30).strip()}"),
        ("<p>unclosed <b>and <i>wrong</p></b> " + LONG, f"unclosed and wrong\n\n{LONG}"),
    ],
)
def test_main_text(page, want):
    assert main_text(page or "")[0] == want


def test_pages(spark):
    rows = [(1, "u", f"<p>{LONG} 🙂</p>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", f"<p>{LONG} 🙂</p>", "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", f"{LONG} 🙂", len(LONG) + 2), (2, None, "", 0), (None, "v", "", 0), (1, "u", f"{LONG} 🙂", len(LONG) + 2)]
    assert extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def vectors(seed=0, n=600, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    x = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dims))
    x[100:140] = x[100]  # ties
    return x


def test_nearest_against_brute_force(spark):
    x = vectors()
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)]
    rows += [(7, [9.0] * 16), (700, [1e-200] * 16), (701, [3e-320] + [0.0] * 15), (702, [1e200, -1e200] * 8), (750, [1.7e308] * 16), (800, [1e-300, 1e-290] * 8)]  # tiny and huge
    rows += [(100, [2 * v for v in rows[101][1]]), (0, rows[0][1]), (0, rows[33][1])]  # repeated ids
    taken, x = rows, np.array([v for _, v in rows])
    rows = rows + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [None] * 16), (904, [1.0] * 3), (905, []), (950, [math.inf] + [0.0] * 15), (None, [1.0] * 16)]
    frame = spark.createDataFrame([(*r, 1, 9.0) for r in rows], "vec_id long, embedding array<double>, row int, score double")
    got = nearest(frame, lambda c: c % 50 == 0, rerank=60, block=5, group=150).toPandas()
    unit = [[Fraction(v) / max(map(abs, map(Fraction, a))) for v in a] for _, a in taken]
    unit = np.array([[float(v) for v in a] for a in unit])
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    ids, right, want = np.array([i for i, _ in taken]), 0, Counter()
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        cosine[q] = -9
        order = np.lexsort((ids, -np.round(cosine, 12)))[:5]
        want[int(ids[q])] += 5
        mine = got[got.query_id == ids[q]]
        assert set(np.round(mine.score, 9)) <= set(np.round(unit @ unit[ids == ids[q]].T, 9).ravel())
        right += sum(ids[o] in set(mine.vec_id) for o in order)
    assert Counter(got.query_id.tolist()) == want and set(got["rank"]) == {1, 2, 3, 4, 5}
    assert right / sum(want.values()) >= 0.9
    assert sorted(got[(got.query_id == 0) & (got["rank"] == 1)].vec_id) == [0, 0, 33]
    assert got[(got.query_id == 750) & (got["rank"] == 1)].vec_id.tolist() == [7]


def test_recall_on_many_vectors(spark):
    """Random vectors, the hardest case: neighbours are hardly nearer than others."""
    x = np.random.default_rng(3).normal(size=(50_000, 32)).astype(np.float32)
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x))}))
    got = nearest(frame, lambda c: c % 1000 == 0).toPandas()
    x = x.astype(np.float64)
    x /= np.sqrt((x**2).sum(1))[:, None]
    right = 0
    for q in range(0, len(x), 1000):
        cosine = x @ x[q]
        cosine[q] = -9
        right += len(set(np.argsort(-cosine)[:5]) & set(got[got.query_id == q].vec_id))
    assert len(got) == 250 and right / 250 >= 0.9


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), lambda c: c % 50 == 0).count() == 0
    got = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema), lambda c: c % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 2), (0, 1)]
    assert nearest(spark.createDataFrame([(1, [1.0])], schema), lambda c: c % 50 == 0).count() == 0


def test_anisotropic_codes_keep_more_of_the_parallel_part():
    x = vectors(1, 800)
    x = x / np.sqrt((x**2).sum(1))[:, None]
    error = {}
    for eta in (1.0, cost_of_parallel(16, 0.4)):
        books = fit_books(x, 2, eta)
        codes = encode(x, books, eta)
        rebuilt = np.stack([books[j, codes[:, j]] for j in range(len(books))], 1)
        error[eta] = float((((subvectors(x, 2) - rebuilt) * subvectors(x, 2)).sum((1, 2)) ** 2).mean())
    assert error[max(error)] < error[1.0]


@pytest.mark.parametrize("kind", ["offset", "clusters", "plane", "spread"])
def test_nearest_are_found_however_vectors_lie(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    if kind == "offset":
        x = 30 + 0.3 * x
    elif kind == "clusters":
        x = rng.normal(size=(10, 32))[np.arange(6000) % 10] + 0.002 * x
    elif kind == "plane":
        x = x[:, :2] @ rng.normal(size=(2, 32)) + 0.001 * x
    else:
        x *= np.exp(-np.arange(32))
    x = x.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(frame, lambda c: c % 500 == 0).toPandas()
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    for q in range(0, 6000, 500):
        score = unit @ unit[q]
        score[q] = -2
        mine = got[got["query_id"] == q].sort_values("rank")
        assert np.allclose(mine["score"], np.sort(score)[::-1][:5], rtol=0, atol=1e-13)
        assert np.allclose(score[mine["vec_id"]], mine["score"], rtol=0, atol=1e-13)
