"""Operators on documents, against brute force, and at the edges: nulls, empty and long texts, repeated rows, empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from finstrata.llm import queries as Q
from finstrata.llm.components import components
from finstrata.llm.decontamination import align, decontaminate
from finstrata.llm.license_scan import NOTICES, PHRASES, scan_licenses
from finstrata.llm.lm_scoring import END, lm_scores
from finstrata.llm.near_join import near_join
from finstrata.llm.packing import pack
from finstrata.llm.quality import first_by_hash, score_quality
from finstrata.llm.substring_dedup import substring_dedup
from finstrata.llm.token_counts import START, pieces, token_counts

EDGES = [None, "", " \t\n", "one", "A b c d\x1fe", "x " * 3000, "same text here for all of us", "same text here for all of us"]


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(n))


def edited(rng, text, rate):
    """Words left out, put in and replaced."""
    out = []
    for w in text.split():
        x = rng.random()
        out += [] if x < rate / 3 else ["put", w] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
    return " ".join(out)


def corpus(seed=0):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " tail", texts[7].replace("w1 ", "w2 ", 1)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(4)]
    return texts + EDGES


# 2: language model


class Walker:
    """The automaton of all n-grams in plain dictionaries: one token after the other, one arc or failure arc at a time."""

    def __init__(self, texts, strength):
        self.k = strength
        self.counts = Counter(t[i : i + n] for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1))
        self.total = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.words = [g for g in self.counts if len(g) == 1]

    def chance(self, history, word):
        if not history:
            return (self.counts[word,] + 1) / (self.total + len(self.words) + 1)
        k, of = self.k[len(history) - 1], self.counts[history]
        return (self.counts[*history, word] + k * self.chance(history[1:], word)) / (of + k)

    def score(self, text):
        out, state = 0.0, ()
        for word in text:
            while state and (*state, word) not in self.counts:  # failure arc
                k = self.k[len(state) - 1]
                out += math.log10(k / (self.counts[state] + k))
                state = state[1:]
            out += math.log10(self.chance(state, word))
            state = (*state, word)[-2:]
            while state and state not in self.counts:
                state = state[1:]
        return out


@pytest.mark.parametrize("files", [1, 5])
def test_lm_scores(spark, documents, files):
    texts, strength = corpus(), (7.0, 2.0)
    docs = documents(*texts, ids=[None if i == 30 else i for i in range(len(texts))]).repartition(files)
    got = {r.doc_id: r for r in lm_scores(docs, F.col("doc_id") % 7 != 2, strength=strength).collect()}
    split = [tuple((t or "").encode().lower().split()) + (END,) for t in texts]
    walker = Walker([ws for i, ws in enumerate(split) if i % 7 != 2 or i == 30], strength)
    for i, ws in enumerate(split):
        r = got[None if i == 30 else i]
        base = sum(math.log10(walker.chance((), w)) for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(walker.score(ws), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trains) == (len(ws), sum(walker.counts[w,] > 0 for w in ws), walker.total, i % 7 != 2 or i == 30)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    for history in [(), split[3][:1], split[3][4:6], split[8][2:4]]:  # chances sum to one, with that of all unseen words
        unseen = walker.chance(history, b"not seen")
        assert sum(walker.chance(history, w) for (w,) in walker.words) + unseen == pytest.approx(1)


def test_lm_scores_of_pairs_only_and_of_nothing_to_learn(spark, documents):
    texts = corpus()
    assert {r.score for r in lm_scores(documents(*texts), F.lit(False)).collect()} == {0.0}
    one = {r.doc_id: r for r in lm_scores(documents(*texts), F.lit(True), order=1).collect()}
    assert all(r.score == pytest.approx(r.base_score) for r in one.values())
    two = {r.doc_id: r for r in lm_scores(documents(*texts), F.lit(True), order=2).collect()}
    assert two[0].score > one[0].score
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


# 3: packing


def test_packing_is_an_exact_round_trip(spark, documents):
    from tokenizers import Tokenizer

    path = Q.tokenizer("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    texts = [*corpus(), "foo<|ENDOFTEXT|>bar FOO<|endoftext|>Bar <|EndOfText|> <|startoftext|> A <| B|> <|STARTOFTEXT|>", "Émile's café, l'été: don't <|endoftext|> 12345 a.b!! ...$$$", "é Kİ ǅ 你好 🙂🙂"]
    got = pack(documents(*texts), path, window=256, shortest=64, group_tokens=1024).toPandas()
    for i, text in enumerate(texts):
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        mine = got[got.doc_id == i].sort_values("start")
        assert b"".join(mine.ids) == np.array(ids, "<u4").tobytes()
        assert (mine.doc_tokens == len(ids)).all() and mine.start.tolist() == [0, *mine.length.cumsum().tolist()][:-1]
    for _, inside in got.sort_values("offset").groupby("sequence_id"):
        assert inside.offset.tolist() == [0, *inside.length.cumsum().tolist()][:-1]
        size = int(inside.length.sum())
        assert size == inside.tier.iloc[0] <= 256 and size & (size - 1) == 0


def test_pool_stays_small_with_short_documents():
    from finstrata.llm.packing import Pool

    pool, out = Pool(256, 64), []
    for i in range(5000):
        pool.add(i, 0, b"\0" * 4 * (1 + i % 7), 1 + i % 7)
        if i % 500 == 499:
            out += [s for t in pool.tiers for s in pool.fill(t)]
            assert sum(pool.tokens.values()) < 256 and sum(map(len, pool.lists.values())) < 256
    assert all(sum(p[0] for p in s) == 64 for s in out)


# 7: substring dedup


@pytest.mark.parametrize(("window", "most", "files"), [(35, 1000, 3), (35, 1, 3), (12, 3, 2), (8, 1000, 1)])
def test_substring_dedup(spark, documents, window, most, files):
    texts = [*corpus(), "loop a b c " * 30, "loop a b c " * 30]
    got = {r.doc_id: r for r in substring_dedup(documents(*texts).repartition(files), window=window, most=most).collect()}
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for i, words in enumerate(split):
        gone = {j for k in range(len(words) - window + 1) if counts[tuple(words[k : k + window])] > 1 for j in range(k, k + window)}
        assert (got[i].n_words, got[i].n_removed) == (len(words), len(gone))
        assert bytes(got[i].kept) == b" ".join(w for j, w in enumerate(words) if j not in gone)
    assert sum(r.n_removed for r in got.values()) > 400
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


# 9: Jaccard join


def test_near_join(spark, documents):
    rng = random.Random(1)
    base = prose(rng, 120, 5000)
    words = base.split()
    near = [" ".join(w if rng.random() > 0.02 else "edit" for w in words) for _ in range(25)]
    texts = [*corpus(), *near, *[base] * 5]
    got = {r.doc_id: r for r in near_join(documents(*texts), chunk=8).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    near, parent = defaultdict(int), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            near[a] += 1
            near[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: (r.n_links, r.class_id) for i, r in got.items()} == {i: (near[i], root(i)) for i in range(len(texts))}
    assert len({r.copy_id for r in got.values()}) == len({s for s in sets if s}) + sum(not s for s in sets)


def test_near_join_of_one_id_with_several_texts(spark, documents):
    a, b = prose(random.Random(8), 50, 4000), prose(random.Random(9), 50, 4000)
    near = b + " tail"
    got = near_join(documents(a, b, a, near, near, a, "", None, a, ids=[1, 1, 2, 3, None, None, None, 4, 1])).collect()
    none = lambda x: (x is None, x or 0)
    assert sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in got), key=lambda x: [none(y) for y in x]) == [(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (3, 1, 3, 2), (4, 4, 4, 0), (None, 1, 1, 2), (None, 1, 3, 2), (None, None, None, 0)]
    unnamed = near_join(documents(b, near, ids=[None, None])).collect()
    assert [(r.class_id, r.n_links) for r in unnamed] == [(None, 1)] * 2


def test_components_of_long_chains_and_a_star(spark):
    chain, star = [(i, i + 1) for i in range(0, 300)], [(1000, i) for i in range(1001, 1400)]
    edges = [*chain, *star, (5, 5), (2000, 2000), (1, 0)]
    random.Random(2).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}, 2000: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6: decontamination


def test_decontamination(spark, documents):
    rng = random.Random(2)
    items = [prose(rng, 40, 4000) for _ in range(12)]
    edited = items[3].split()
    edited[5], edited[20] = "changed", "changed"
    edited.insert(30, "added")
    texts = [*corpus(), f"{prose(rng, 50)} {items[0].upper()}. {prose(rng, 50)}", f"{prose(rng, 30)} {' '.join(edited)}", *[f"{items[7]} {prose(rng, 9)}"] * 3, " ".join(items[9].split()[:9]) + prose(rng, 60)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "two words"), (93, items[7])], "item_id long, text string")
    got = decontaminate(documents(*texts), bench).collect()
    n = len(corpus())
    assert {(r.doc_id, r.item_id) for r in got} == {(n, 0), (n + 1, 3), *((n + 2 + i, k) for i in range(3) for k in (7, 93))}
    assert all(r.score == 1.0 for r in got if r.item_id != 3) and 0.8 < next(r.score for r in got if r.item_id == 3) < 1
    whole = next(r for r in got if r.item_id == 0)
    assert (whole.doc_start, whole.doc_end, whole.item_start, whole.item_end) == (50, 90, 0, 40)


def test_decontamination_finds_edited_copies_beside_a_verbatim_one(spark, documents):
    rng = random.Random(3)
    item = prose(rng, 40, 4000).split()
    edited = list(item)
    edited[10], edited[25] = "changed", "changed"
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = decontaminate(documents(" ".join(item), *[f"{prose(rng, 20, 4000)} {' '.join(edited)}" for _ in range(12)]), bench).collect()
    assert {r.doc_id for r in got} == set(range(13))


def test_decontamination_aligns_parts_far_apart(spark, documents):
    rng = random.Random(4)
    item, short = prose(rng, 400, 40000).split(), prose(rng, 40, 40000)
    other = " ".join(f"other{i}" for i in range(100))
    holed = " ".join(item[:150]) + f" {other} " + " ".join(item[250:])
    start = " ".join(item[:190] + ["new"] * 200)  # less than half of the item
    late = f"{other} " * 30 + holed
    bench = spark.createDataFrame([(0, " ".join(item)), (1, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate(documents(holed, late, start, " ".join(item), *[" ".join(item[:350])] * 20, f"{late} {short}"), bench).collect()}
    assert set(got) == {(i, 0) for i in (0, 1, 3, *range(4, 25))} | {(24, 1)}
    assert got[0, 0].score == 0.625 and (got[1, 0].doc_start, got[1, 0].doc_end) == (3000, 3400) and got[3, 0].score == 1 and got[4, 0].score == 0.875
    assert (got[24, 1].doc_start, got[24, 1].doc_end, got[24, 1].score) == (3400, 3440, 1)


def spread_edits(rng, words, every, how):
    """Every so manieth word replaced, put in or taken away."""
    out = []
    for i, w in enumerate(words):
        hit = i % every == every - 1
        out += [w, f"put{rng.randrange(999)}"] if hit and how == "put" else [] if hit and how == "cut" else [f"new{rng.randrange(999)}"] if hit and how == "new" else [w]
    return out


def test_decontamination_finds_edits_spread_evenly(spark, documents):
    rng = random.Random(8)
    items = [[f"i{n}w{i}" for i in range(size)] for n, size in enumerate((100, 100, 60, 31, 16, 15, 9, 6))]
    cases = [(n, every, how) for n in range(len(items)) for every, how in ((4, "new"), (3, "new"), (5, "new"), (3, "put"), (2, "put"), (4, "cut"), (3, "cut"))]
    made = [spread_edits(rng, items[n], every, how) for n, every, how in cases]
    texts = [f"{prose(rng, 30)} {' '.join(m)} {prose(rng, 30)}" for m in made]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate(documents(*texts), spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string")).collect()}
    number = {w: k for k, w in enumerate(sorted({w for t in [*made, *items] for w in t}))}
    coded = lambda words: np.array([number[w] for w in words], np.uint64)
    want = {(i, n): align(coded(items[n]), coded(made[i]))[0] / (2 * len(items[n])) for i, (n, _, _) in enumerate(cases)}
    over = {key for key, score in want.items() if score > 0.5}
    assert over <= set(got) <= {key for key, score in want.items() if score >= 0.5} and len(over) > 40
    assert all(abs(got[key] - want[key]) < 1e-9 for key in got)


def test_seeds_lose_no_copy_with_replaced_words():
    from finstrata.llm.decontamination import kind_of, seeds_of

    words = np.arange(1, 25, dtype=np.uint64)
    for n in (5, 7, 11, 15, 16, 17):
        own, kind = np.sort(seeds_of(words[:n], kind_of(n, 4))[0]), kind_of(n, 4)
        for kept in itertools.product((True, False), repeat=n):
            if sum(kept) * 3 < 2 * n:
                continue
            score = best = 0
            for k in kept:
                score = max(0, score + (2 if k else -1))
                best = max(best, score)
            if best > n:  # more than half of 2 n
                copy = np.where(kept, words[:n], words[:n] + np.uint64(1000))
                assert np.isin(seeds_of(copy, kind)[0], own).any(), kept


def test_decontamination_with_a_phrase_that_all_have(spark, documents):
    rng = random.Random(9)
    stock = "which of the following is the best answer to the question"
    bench = spark.createDataFrame([(n, f"{stock} {' '.join(f'q{n}x{i}' for i in range(20))}") for n in range(60)], "item_id long, text string")
    texts = [f"{prose(rng, 40)} {stock} {prose(rng, 40)}" for _ in range(1500)]
    leak = f"{stock} " + " ".join(f"q7x{i}" if i % 4 else "no" for i in range(20))
    got = decontaminate(documents(*texts, leak), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1500, 7)]


def test_decontamination_against_all_pairs(spark, documents):
    rng = random.Random(11)
    items = [prose(rng, n, 3000) for n in (1, 2, 3, 8, 20, 20, 60, 120)]
    items[1], items[2] = "short item", "three odd words"

    texts = [f"{prose(rng, 30, 3000)} {edited(rng, rng.choice(items[3:]), rng.random() * 0.6)} {prose(rng, 30, 3000)}" for _ in range(120)]
    texts += ["a short item here", "short of one item", "so three odd words", "three words", None, ""]
    ids = [None if i % 50 == 7 else i % 100 for i in range(len(texts))]
    bench = spark.createDataFrame([*enumerate(items), (3, items[3]), (8, None), (None, items[5])], "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.score, 6)) for r in decontaminate(documents(*texts, ids=ids), bench).collect()}
    number = {w: i for i, w in enumerate({w for t in (*texts, *items) for w in (t or "").split()})}
    of = lambda t: np.array([number[w] for w in (t or "").split()], np.uint64)
    want = set()
    for i, text in zip(ids, texts, strict=True):
        for k, item in [*enumerate(items), (None, items[5])]:
            score = align(of(item), of(text))[0] / (2 * len(item.split()))
            if score >= 0.5 and (len(item.split()) >= 4 or f" {item} " in f" {text} "):
                want.add((i, k, round(score, 6)))
    assert got <= want and len(got) >= 0.9 * len(want) > 50, (len(got), len(want), sorted(want - got, key=str))
    assert {(i, k) for i, k, _ in got if k in (1, 2)} == {(20, 1), (22, 2)}
    assert decontaminate(documents(*texts), bench.limit(0)).count() == 0


# 8: licenses


def test_license_scan(spark, documents):
    notices = {label: text for label, text in NOTICES}
    holed = notices["bsd"].split()
    del holed[4], holed[15]
    texts = [*corpus(), "Under the MIT  License, or CC-BY; gnu general\npublic LICENSE.", "x " + " ".join(holed), notices["bsd"].upper() + " cc by cc by", "mit licensed; apache", "Émit license"]
    got = {r.doc_id: r for r in scan_licenses(documents(*texts)).collect()}
    for i, text in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
    n = len(corpus())
    assert got[n].labels == "cc-by,gpl,mit" and got[n + 1].labels == "bsd" and 0.7 <= got[n + 1].score < 1 and got[n + 2].labels == "bsd,cc-by"
    assert got[n + 1].spans[0].start == 1 and got[0].score == 0


def scanned(words, k=3, apart=2, least=0.7):
    """(labels, share, spans) by loops over all pairs of places."""
    spans = []
    for label, notice in NOTICES:
        of = notice.split()
        diagonals = defaultdict(list)
        for p, i in itertools.product(range(len(words) - k + 1), range(len(of) - k + 1)):
            if words[p : p + k] == of[i : i + k]:
                diagonals[p - i].append((p, i))
        groups = []
        for d in sorted(diagonals):
            if groups and d - groups[-1][0] <= apart:
                groups[-1] = (d, groups[-1][1] + diagonals[d])
            else:
                groups.append((d, diagonals[d]))
        for _, hits in groups:
            covered = len({i + j for _, i in hits for j in range(k)})
            start, end = min(p for p, _ in hits), max(p for p, _ in hits) + k
            if covered >= least * len(of) and covered >= least * (end - start):
                spans.append((start, end, label, covered, covered / len(of)))
    kept = [s for s in spans if not any(t[2] != s[2] and t[3] > s[3] and t[0] < s[1] and s[0] < t[1] for t in spans)]
    return sorted({s[2] for s in kept}), max((s[4] for s in kept), default=0.0), sorted((s[0], s[1], s[2], s[4]) for s in kept)


def test_license_votes_against_loops(spark, documents):
    rng = random.Random(12)

    texts = ["the WOR\u212a is licensed under cc by 4 0", "this wor\u212a is licensed under cc by 4 0", "THIS WORK IS LICENSED UNDER CC BY 4 0", "İ mit license", None, "", "...", " mit license ", "mit license " * 400]
    for _ in range(60):
        words = prose(rng, 20).split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words))
            words[at:at] = edited(rng, rng.choice(NOTICES)[1], rng.random() * 0.25).split()
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    got = {r.doc_id: r for r in scan_licenses(documents(*texts)).collect()}
    for i, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        labels, share, spans = scanned(words)
        r = got[i]
        assert r.labels == ",".join(sorted({*labels, *filter(None, r.base_labels.split(","))})) and [tuple(x) for x in r.spans] == spans
        assert r.score == (1.0 if r.n_base else share) and r.n_words == len(words)
    assert sum(len(r.spans) for r in got.values()) > 30 and got[8].n_base == 400 and got[2].spans[0].share == 1 > got[1].spans[0].share
    tied = "this work is licensed under a creative commons attribution 4 0 international license"
    one = scan_licenses(documents(tied), notices=(("b", tied), ("a", tied), ("c", "short one"))).first()
    assert one.labels == "a,b" and one.score == 1.0
    share_alike = "this work is licensed under a creative commons attribution sharealike 4 0 international license"
    assert scan_licenses(documents(share_alike)).first().labels == "cc-by-sa"


# 10: token counts


def test_token_counts(spark, documents):
    texts = [*corpus(), "über Straße 你好 🙂 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa unbelievably"]
    model = Q.tokenizer("piece_bpe_32k.model")
    scores = pieces(model)
    byte = min(scores.values()) - 2

    def count(word):
        text = START + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(best[end - 1][0] + size * byte, best[end - 1][1] + size)]
            options += [(best[i][0] + scores[text[i:end]], best[i][1] + 1) for i in range(end) if text[i:end] in scores]
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        return best[-1]

    got = {r.doc_id: r for r in token_counts(documents(*texts), model).collect()}
    for i, text in enumerate(texts):
        words = [w.decode() for w in (text or "").encode().split()]
        memo = {w: count(w) for w in set(words)}
        assert (got[i].n_pretokens, got[i].n_tokens, got[i].n_chars) == (len(words), sum(memo[w][1] for w in words), len(text or ""))
        assert got[i].log_prob == pytest.approx(sum(memo[w][0] for w in words))


def test_token_counts_with_scores_of_their_own(spark, documents):
    scores = {"▁": -9.0, "▁a": -2.0, "a": -3.0, "ab": -1.0, "b": -7.0, "▁ab": -8.0, "aba": -0.5}
    got = {r.doc_id: r for r in token_counts(documents("aba ab", "b", "zz", None), scores=scores).collect()}
    assert (got[0].n_tokens, got[0].log_prob) == (3, pytest.approx(-9 - 0.5 - 8))
    assert (got[1].n_tokens, got[1].log_prob) == (2, pytest.approx(-16)) and got[3].n_tokens == 0
    byte = min(scores.values()) - 2
    assert (got[2].n_tokens, got[2].log_prob) == (3, pytest.approx(-9 + 2 * byte))


# 1: quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.filter("doc_id % 3 <> 0")
    got = score_quality(docs, learn).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    right = (got.keep == ((got.quality == 1) & (got.toxic == 0))).mean()
    assert right > 0.85, right


def test_rows_to_learn_from_are_those_with_the_smallest_hashes(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("view"), (F.col("id") % 3 > 0).cast("int").alias("label"))
    got = first_by_hash(rows, 50).groupBy("view", "label").agg(F.count("*").alias("n"), F.max(F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).alias("last")).collect()
    every = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).groupBy("view", "label").agg(F.sort_array(F.collect_list("h"))[49].alias("last")).collect()
    assert {(r.view, r.label, r.last) for r in got} == {(r.view, r.label, r.last) for r in every} and {r.n for r in got} == {50}
    assert first_by_hash(rows.filter("doc_id < 30"), 50).count() == 30 and first_by_hash(rows.limit(0), 50).count() == 0


def test_quality_at_the_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_quality(documents(*EDGES), none).collect()
    assert len(got) == len(EDGES) and {round(r.score, 6) for r in got} == {0.5}
    odd = spark.createDataFrame([(0, None, 0), (1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(documents(*EDGES, ids=[0, 1, 2, 3, 4, 5, None, 6]), odd).count() == len(EDGES)


# all of them


def operators(spark):
    bench = spark.createDataFrame([(1, "a test item with some words")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "lm": lambda d: lm_scores(d, F.col("doc_id") % 7 != 2), "pack": lambda d: pack(d, Q.tokenizer("word_bpe_49k.json")), "dedup": substring_dedup, "near": near_join,
        "leaks": lambda d: decontaminate(d, bench), "licenses": scan_licenses, "tokens": lambda d: token_counts(d, Q.tokenizer("piece_bpe_32k.model")), "quality": lambda d: score_quality(d, labels),
    }


@pytest.mark.parametrize("name", ["lm", "pack", "dedup", "near", "leaks", "licenses", "tokens", "quality"])
def test_empty_table_and_null_ids(spark, documents, name):
    run = operators(spark)[name]
    assert run(documents("x").limit(0)).count() == 0
    twice = documents("same row", "same row", "other", None, ids=[1, 1, None, None])
    n = run(twice).count()
    assert n >= 4 if name == "pack" else n == {"leaks": 0, "near": 3}.get(name, 4)


# the pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).cache()
        assert set(after.columns) == set(docs.columns) and after.count() <= kept.count()
        seen.append((name, kept, after))
        kept = after
    by = {name: (a, b) for name, a, b in seen}
    before, after = by["near_duplicates"]
    classes = near_join(before).toPandas()
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(classes[classes.doc_id == classes.class_id].doc_id)
    before, after = by["leaks"]
    leaks = {r.doc_id for r in decontaminate(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()} - leaks
    before, after = by["repeated_passages"]
    assert after.count() == before.count() and after.filter(F.length("text") != F.col("n_chars")).count() == 0
    pieces_ = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces_.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_tells_rows_apart(spark, documents, tmp_path):
    rng = random.Random(5)
    one, two, item = (prose(rng, 60, 4000) for _ in range(3))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = one.replace(one.split()[0], "first", 1)
    docs = documents(one, two, near, near, two, item, one, ids=[1, 1, 2, None, None, None, 3])
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (1, two), (0, item)])
    kept = corpus_pipeline.leaks(spark, documents(one, two, item, item, ids=[None, 4, None, 4]), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, one), (4, two)]


def test_digests(spark):
    sf = "/root/testdata/sf0.001"
    row = Q.op7_suffix_tree_dedup(spark, sf).filter("n_removed = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()
    piece = Q.op3_hierarchical_packing(spark, sf).filter("start = 0 and length = doc_tokens").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id") == piece.doc_id).first().text
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, 1]
    assert piece.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_stage_at_the_edges(spark, documents, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "no document holds this test item"), (None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b = prose(random.Random(1), 80, 4000), prose(random.Random(2), 80, 4000)
    rows = [*EDGES, a, b, a]
    docs = documents(*rows, ids=[None, 1, 1, 2, 3, None, 4, 5, 6, 6, None])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        got = stage(spark, docs, str(tmp_path))
        if name != "packed":
            assert tuple(got.columns) == corpus_pipeline.COLUMNS
        kept = [(r.doc_id, r.text) for r in got.collect()] if name != "packed" else []
        if name in ("repeated_passages", "leaks"):
            assert len(kept) == len(rows), name
        if name == "near_duplicates":  # of the copies the one with the smallest id, and all that has no words
            assert sorted(kept, key=str) == sorted([*zip([None, 1, 1, 2, 3, None, 4, 6, 6], [*EDGES[:7], a, b], strict=True)], key=str)
    assert corpus_pipeline.written(docs.limit(0)).count() == 0
