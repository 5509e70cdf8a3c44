"""Phrase collocations against counts of all phrases in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from finstrata.llm.collocations import LOWERED, collocations, numbered, scores

SCHEMA = "doc_id long, text string, lang string, block string, level string, spot int, id string, f string, a string, n long, phrase int"


def frame(spark, rows):
    return spark.createDataFrame([(1, text, lang, "x", "x", 1, "x", "x", "x", 1, 1) for lang, text in rows], SCHEMA)


def plain(rows, least, longest=4, percent=80, top=2000):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found, longer = {p: a for p, a in f.items() if len(p) > 2 and a >= least}, Counter()
    for (lang, *words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, *words[i : i + k])
                longer[part] = max(longer[part], a)
    out = []
    for p, a in found.items():
        lang, words = p[0], p[1:]
        score, k = min((2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        if not 100 * longer[p] >= percent * a:
            out.append((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "ÉÉ", "the", "The", "x1", "it's", "a-b", "\x1f", "\xa0", "\U0001f642", "퟿", " "]
    glue = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", " :; "]
    rows = []
    for _ in range(60):
        text = "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(rng.randrange(80)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    rows += [("en", None), (None, ""), ("en", " \t\n"), ("en", "."), ("de", "no" * 40_000), rows[0], rows[0], ("fr", "only white, words")]
    return rows + [("en", "of the same " * 400), ("en", "of the same, " * 200), ("hot", "a " * 900)]


@pytest.mark.parametrize("size", [40, 700, 8 << 20])
def test_against_all_phrases(spark, size):
    rows = corpus(size)
    got = collocations(frame(spark, rows).repartition(3), least=4, size=size, top=25, places_in_bin=200)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 4, top=25)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_other_lengths_and_limits(spark):
    rows = corpus(1)
    for longest, percent, least in ((2, 80, 3), (3, 50, 2), (5, 100, 6)):
        assert sorted(map(tuple, collocations(frame(spark, rows), least, longest, percent).collect())) == plain(rows, least, longest, percent)


def test_nothing_to_find(spark):
    for rows in ([], [("en", None), (None, "")], [("en", "all words are here once")]):
        assert collocations(frame(spark, rows)).count() == 0


def test_a_text_larger_than_many_blocks(spark):
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice(["up", "down", "left", "right.", "on"]) for _ in range(300_000))), ("en", "up " * 50_000)]
    assert sorted(map(tuple, collocations(frame(spark, rows), size=100_000).collect())) == plain(rows, 30)


def test_numbers_of_words_and_breaks():
    words, places = numbered("One two.. two\tone\n\nthree  one".encode().translate(LOWERED))
    assert [words[int(i)].as_py().decode() if i >= 0 else None for i in places] == ["one", "two", None, "two", "one", None, "three", "one", None]
    assert numbered(b"")[1].tolist() == numbered(b" \n ")[1].tolist() == []


def test_scores_beyond_64_bits():
    a = np.array([3 * 2**44, 5])
    score, left, right = scores(a, [(a + 7, a + 9), (a, a), (a + 7, a + 9)])
    assert score.tolist() == [2_000_000 * int(x) // (2 * int(x) + 16) for x in a] and (left == a + 7).all() and (right == a + 9).all()
