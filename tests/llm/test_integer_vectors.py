"""Centroid clustering and exact top-k search against plain Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from finstrata.llm import clustering
from finstrata.llm.clustering import Centroids, exponion, next_centroids, searched, squared, to_all
from finstrata.llm.top_k import Search, exact_top_k

# extra columns, named like those that the operators use inside
SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance double, block string, v long, row long, part int, rank int, score string, round int"


def frame(spark, rows, kind="double"):
    filled = [(i, v, 1, 1, 1.0, "x", 1, 1, 1, 1, "x", 1) for i, v in rows]
    return spark.createDataFrame(filled, SCHEMA.replace("array<double>", f"array<{kind}>"))


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(Fraction(x) * scale) for x in v]


def as_long(x):
    return x if x is not None and -(2**63) <= x < 2**63 else None


def k_means(rows, k, rounds, dims, scale, seed=3):
    kept = [(i, floors(v, scale)) for i, v in rows if good(v) and len(v) == dims]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min(range(len(at)), key=lambda c: (far(v, at[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(at)):
                mine = [v for (_, v), x in zip(kept, near, strict=True) if x == c]
                at[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else at[c]
    d = [far(v, at[c]) for (_, v), c in zip(kept, near, strict=True)]
    per = {c: sum(x for x, y in zip(d, near, strict=True) if y == c) for c in near}
    whole = sum(d) if all(as_long(x) is not None for x in d) else None
    own = {c: None if any(as_long(x) is None for x, y in zip(d, near, strict=True) if y == c) else as_long(s) for c, s in per.items()}
    digest = lambda c: hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()
    return sorted(((i, c, as_long(x), own[c], as_long(whole), digest(c)) for (i, _), c, x in zip(kept, near, d, strict=True)), key=str)


def clustered(rng, n, dims, centres=6):
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [[x + rng.gauss(0, 0.3) for x in rng.choice(middle)] for _ in range(n)]


BAD = [(700, None), (701, [math.nan] * 4), (702, [None, 1.0, 1.0, 1.0]), (703, [1.0] * 3), (704, []), (705, [math.inf, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("case", ["mixed", "grid", "huge", "few", "one", "equal"])
def test_exponion_against_plain_k_means(spark, case):
    rng = random.Random(case)
    rows = list(enumerate(clustered(rng, 150, 4)))
    if case == "grid":  # many equal distances, many equal rows
        rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(120)]
    elif case == "huge":
        rows = rows[:30] + [(200, [1e5, -1e5, 0.0, 0.0]), (201, [1e200] * 4), (202, [1e200, -3e199, 1e-300, 5.0]), (203, [-1.7e308] * 4)]
    elif case == "few":
        rows = rows[:3]
    elif case == "one":
        rows = rows[:1]
    elif case == "equal":
        rows = [(i, [0.5, -0.25, 0.001, -0.001]) for i in range(20)] + [(30, [0.0] * 4)]
    else:
        rows += [(5, [0.0] * 4), rows[7], rows[7], (None, rows[9][1])] + BAD
    got = exponion(frame(spark, rows), k=5, rounds=4, dims=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == k_means(rows, 5, 4, 4, 1024)


def test_exponion_without_vectors(spark):
    assert exponion(frame(spark, [])).count() == 0
    empty = exponion(frame(spark, [(1, [1.0] * 63), (2, None)]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = exponion(frame(spark, [(1, [0.5] * 64), (None, [0.5] * 64)], "float")).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.inertia) for r in got), key=str) == [(1, 0, 0, 0), (None, 0, 0, 0)]


def test_sums_of_many_limbs():
    x = np.array([[2**200, -(2**130)], [-5, 7], [-(2**199), 3]], object)
    flat = clustering.gains(x, np.array([-1, -1, -1], np.int32), np.array([0, 0, 1], np.int32))
    sums = {}
    for i in range(0, len(flat), 5):
        c, limb, _, *s = flat[i : i + 5]
        assert all(-(2**63) <= v < 2**63 for v in s)
        sums[c] = [a + (b << (clustering.LIMB * limb)) for a, b in zip(sums.get(c, [0, 0]), s, strict=True)]
    assert sums == {0: [2**200 - 5, 7 - 2**130], 1: [-(2**199), 3]}


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(30, 8))[rng.integers(0, 30, 4000)] * 900 + rng.normal(size=(4000, 8)) * 90).astype(np.int64)
    at = x[:40].copy()
    cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros(len(x))
    computed, moved = [], np.zeros(len(at))
    for _ in range(8):
        computed.append(searched(x, cluster, upper, lower, Centroids(at, moved)))
        d = np.sqrt(to_all(x, at).astype(float))
        assert (cluster == d.argmin(1)).all()
        own = d[np.arange(len(x)), cluster]
        d[np.arange(len(x)), cluster] = np.inf
        assert (own <= upper).all() and (lower <= d.min(1)).all()
        sums = [[int(s) for s in x[cluster == c].sum(0)] for c in range(len(at))]
        at, moved = next_centroids(at, sums, [int((cluster == c).sum()) for c in range(len(at))])
    assert computed[-1] < 0.25 * len(x) * len(at)  # all distances in each round would be len(x) * len(at)
    assert (squared(x, at[0]) == ((x - at[0]) ** 2).sum(1)).all()


def top(rows, k, scale):
    kept = [(i, floors(v, scale)) for i, v in rows if i is not None and good(v)]
    out = []
    for n, (q, v) in enumerate(kept):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for m, (i, w) in enumerate(kept) if m != n)
            out += [(q, r + 1, i, as_long(-s)) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["mixed", "ties", "huge", "few", "long", "zero"])
def test_top_k_against_plain_products(spark, case):
    rng = random.Random(case)
    rows = list(enumerate(clustered(rng, 260, 20)))
    if case == "ties":
        rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(5)]) for i in range(210)]
    elif case == "huge":
        rows = rows[:40] + [(50, [1e6] * 20), (100, [-1e9, 1e9] * 10), (101, [1e9, -1e-300] * 10), (150, [3e4] * 20)]
    elif case == "few":
        rows = rows[:3]
    elif case == "long":  # other lengths, repeated ids, bad rows
        rows += [(50, [5.0] * 3), (50, [5.0] * 3), (51, [9.0] * 25), (100, []), rows[7], rows[7], (None, [9.0] * 20), (300, None), (350, [math.nan] * 20), (400, [None] * 20)]
    elif case == "zero":
        rows = [(i, [0.0] * 20 if i % 3 else v) for i, v in rows]
    got = exact_top_k(frame(spark, rows), lambda c: c % 50 == 0, group=60, block=2, step=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == top(rows, 5, 256)


def test_top_k_without_queries_or_candidates(spark):
    ask = lambda rows: exact_top_k(frame(spark, rows, "float"), lambda c: c % 50 == 0).collect()
    assert ask([]) == ask([(1, [1.0]), (2, [2.0])]) == ask([(0, [1.0])]) == ask([(0, None), (1, [1.0])]) == []
    assert [tuple(r) for r in ask([(0, []), (1, [])])] == [(0, 1, 1, 0)]


def test_search_drops_what_cannot_win():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(10, 64))[rng.integers(0, 10, 5000)].T * 40 + rng.normal(size=(64, 5000)) * 4).astype(np.int64)
    q = x[:, :3].T.copy()
    search, read = Search(x, q, 5, 8), []
    whole = search.x

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.ndarray.__getitem__(self, at)
            read.append(out.size)
            return np.asarray(out)

    search.x = whole.view(Counted)
    for i in range(3):
        at, scores = search.best(i, np.asarray(search.first(np.array([i]))[0]), None, np.arange(5000) == i)
        products = q[i] @ x
        products[i] = -(10**9)
        assert at.tolist() == np.lexsort((np.arange(5000), -products))[:5].tolist() and (scores == products[at]).all()
    assert sum(read) < 0.6 * 3 * x.size
