"""The operators' helpers against plain versions of what they compute."""

import numpy as np
import pytest

from finstrata.llm.decontamination import align
from finstrata.llm.near_join import banding, overlaps
from finstrata.llm.quality import STYLE, CoTraining, View, calibrated, margins
from finstrata.llm.shingles import WordHashes, long_windows, mixed, shingles, windows
from finstrata.llm.exchange import by_place, from_places, ranges
from finstrata.llm.substring_dedup import anchors, suffix_tree


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 35, 36, 64])
def test_window_hashes_tell_windows_apart(k):
    words = mixed(np.random.default_rng(k).integers(0, 3, 2000).astype(np.uint64))
    for f in (windows, long_windows):
        found = f(words, k)
        assert len(found) == 2000 - k + 1
        pairs = {(tuple(words[i : i + k].tolist()), int(h)) for i, h in enumerate(found)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        assert len(f(words[: k - 1], k)) == 0


def test_anchor_is_the_first_smallest():
    grams = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    for span in (1, 2, 7, 28):
        want = [i + int(np.argmin(grams[i : i + span])) for i in range(500 - span + 1)]
        assert anchors(grams, span).tolist() == want


@pytest.mark.parametrize("least", [1, 3, 7])
def test_suffix_tree_has_all_repeats(least):
    rng = np.random.default_rng(least)
    pieces = [b" ".join(b"abc"[x : x + 1] for x in rng.integers(0, 3, n)) for n in rng.integers(1, 30, 25)]
    pieces = list(dict.fromkeys(pieces))
    tree = suffix_tree(pieces, least)
    words = [p.split() for p in pieces]
    suffixes = [(*words[p][o:],) for p, o in zip(tree.piece.tolist(), tree.offset.tolist(), strict=True)]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}  # words are in the order of their first places
    assert suffixes == sorted(suffixes, key=lambda x: [number[w] for w in x]) and len(suffixes) == sum(max(0, len(w) - least + 1) for w in words)
    follow = {}
    for x in suffixes:
        for n in range(least, len(x) + 1):
            follow.setdefault(x[:n], []).append(x[n : n + 1])
    # an internal node: a run of words that stands twice or more, not always with the same word behind it
    want = {(len(run), len(after)) for run, after in follow.items() if len(after) > 1 and (len(set(after)) > 1 or after[0] == ())}
    got = tree.deep_nodes()
    assert {(d, end - first) for d, first, end in got} == want
    assert all(len({x[:d] for x in suffixes[first:end]}) == 1 for d, first, end in got)
    assert tree.repeated().tolist() == [len(follow[x[:least]]) > 1 for x in suffixes]


def test_exchanged_arrays_come_back():
    import pyarrow as pa

    values = np.sort(mixed(np.arange(1000, dtype=np.uint64)))
    assert (from_places(pa.scalar(by_place(values)), np.uint64) == values).all()
    parts = list(ranges(values, 7))
    assert [lo for _, lo, _ in parts] + [1000] == [0] + [hi for _, _, hi in parts] and len(parts) == 7
    assert list(ranges(values[:0], 7)) == []


def test_banding_reaches_its_recall():
    bands, rows = banding(0.8, 0.9995, 100)
    assert bands * rows <= 100 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (0, 5, 20, 30)]
    got = overlaps(sets, 3)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        best, i0, i1, j0, j1 = align(a, b)
        assert best == plain_align(a.tolist(), b.tolist())
        assert best == 0 or plain_align(a[i0:i1].tolist(), b[j0:j1].tolist()) == best


def test_shingles_of_short_texts():
    words = WordHashes()
    assert len(shingles(words.of([]), 5)) == 0
    assert len(shingles(words.of([b"a", b"b"]), 5)) == 1


def test_co_training_helps_the_view_that_knows_less():
    rng = np.random.default_rng(5)
    n, known = 2000, 120
    truth = rng.integers(0, 2, n).astype(float)
    # the text has one of 400 words that tell its class, most of which no label shows; the metadata is right 9 times of 10
    word = np.where(truth > 0, rng.integers(100, 500, n), rng.integers(500, 900, n)).astype(np.int32)
    items = np.stack([np.full(n, 1), word, rng.integers(900, 2000, n)], 1).astype(np.int32).reshape(-1)
    text = View(items, np.arange(n + 1) * 3, np.ones((n, len(STYLE))) * 0.1)
    seen = np.where(rng.random(n) < 0.1, 1 - truth, truth)
    meta = View(np.stack([np.zeros(n), 1 + seen], 1).astype(np.int32).reshape(-1), np.arange(n + 1) * 2, None)
    part = lambda v, of: View(np.concatenate([v.items[v.ends[i] : v.ends[i + 1]] for i in of]), np.concatenate([[0], np.cumsum(np.diff(v.ends)[of])]), None if v.dense is None else v.dense[of])
    first, rest = np.arange(known), np.arange(known, n - 500)
    training = CoTraining((part(text, first), part(meta, first)), truth[first])
    before = training.fit()
    test = np.arange(n - 500, n)
    right = lambda m: ((m.log_odds(margins(m.weights, part(text, test).rows(np.arange(500)), 500)) > 0) == (truth[test] > 0)).mean()
    odds = before[1].log_odds(margins(before[1].weights, part(meta, rest).rows(np.arange(len(rest))), len(rest)))
    after = training.fit(((part(text, rest), (odds > 0).astype(float)), (meta, np.zeros(0))))
    assert right(after[0]) > right(before[0]) + 0.05
    assert training.combine(after).shape == (3,)


def test_labels_of_one_class_or_none_give_their_share():
    none = View(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, len(STYLE))))
    assert CoTraining((none, View(none.items, none.ends, None)), np.zeros(0)).fit()[0].shift == 0


def test_calibration_of_one_class_changes_nothing():
    assert calibrated(np.zeros(3), np.ones(4), np.ones(4)).slope == 1.0
