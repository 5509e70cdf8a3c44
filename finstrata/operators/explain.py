"""Why a scorer says what it says.

explain() leaves out words at random and fits a weighted linear model of the scores (LIME); attributions() shares what the
scores of a text and of an empty text differ by among the text's words (Owen values, as SHAP's partition explainer does).

The default scorer knows a text by its distinct lexicon words. Which tokens hold which of them is found once, in the JVM; from
then on a sample of a text is a row of numbers, and no copy of the text is ever made. Each text is one row's work. Other scorers
get the copies.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.columns import strings
from finstrata.functions.lexicons import LABELS, NEGATIVE_WORDS, POSITIVE_WORDS
from finstrata.functions.sentiment import Scorer, distinct_words, keyword_scorer, keyword_shares
from finstrata.functions.text import tokens

GOOD = frozenset(POSITIVE_WORDS)


#: So many words' samples are drawn at once.
DRAWN = 512


@lru_cache(64)
def drawn(seed: int, samples: int, block: int) -> np.ndarray:
    """(words, bytes): in which samples, a bit each, the words of a block are."""
    return np.random.default_rng([seed, 1, block + 1]).integers(0, 256, (DRAWN, -(-samples // 8)), np.uint8)


def drawn_bits(words: int, samples: int, seed: int) -> np.ndarray:
    return np.concatenate([drawn(seed, samples, b) for b in range(-(-max(words, 1) // DRAWN))])[:words]


def turned(key: object, words: int, seed: int) -> np.ndarray:
    """Which words of a text are left out where they were drawn, and kept where they weren't."""
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())]).integers(0, 2, words, np.uint8)


def masks(key: object, words: int, samples: int, seed: int) -> np.ndarray:
    """Which words each sample of a text keeps; sample 0 keeps all.

    What is drawn is the same for all texts, but each text turns words of its own over (a random digital shift): its samples are independent
    and uniform, and what sampling errs by isn't alike in two texts, though a place's samples are the same in both, or opposite. The
    systems of all texts of a length then have nearly the same factors, but for signs.
    """
    chosen = np.unpackbits(drawn_bits(words, samples, seed), axis=1, count=samples).T ^ turned(key, words, seed)
    chosen[:1] = 1
    return chosen


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Few rows, each much work: dealt out to all cores, whatever their size."""
    return rows.repartition(tasks(rows), key)


def tasks(rows: DataFrame) -> int:
    return 8 * rows.sparkSession.sparkContext.defaultParallelism


def perturbed(rows: DataFrame, key: str, text: str, samples: int, seed: int, at_once: int = 200_000) -> DataFrame:
    """(key, sample, kept): so many copies of each text, each without the words that its mask leaves out."""
    words = dealt(rows.select(F.col(key), tokens(F.col(text)).alias("words")), key)

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k, words_ in zip(batch.column(key), batch.column("words"), strict=True):
                own = words_.as_py()
                chosen, step = masks(k.as_py(), len(own), samples, seed), max(1, at_once // max(len(own), 1))
                for first in range(0, samples, step):
                    kept = [" ".join(compress(own, mask)) for mask in chosen[first : first + step].tolist()]
                    columns = {key: pa.array([k.as_py()] * len(kept), k.type), "sample": pa.array(range(first, first + len(kept)), pa.int32()), "kept": pa.array(kept, pa.string())}
                    yield pa.RecordBatch.from_pydict(columns)

    return words.mapInArrow(made, f"{key} {rows.schema[key].dataType.simpleString()}, sample int, kept string")


def factored(gram: np.ndarray, step: int = 256) -> np.ndarray:
    """The lower triangle L of L L' = gram, in place, by blocks of columns: nearly all of it is products of matrices."""
    for lo in range(0, len(gram), step):
        hi = min(lo + step, len(gram))
        gram[lo:, lo:hi] -= gram[lo:, :lo] @ gram[lo:hi, :lo].T
        gram[lo:hi, lo:hi] = top = np.linalg.cholesky(gram[lo:hi, lo:hi])
        if hi < len(gram):
            gram[hi:, lo:hi] = np.linalg.solve(top, gram[hi:, lo:hi].T).T
    return gram


def triangle_solved(lower: np.ndarray, b: np.ndarray, step: int = 128) -> np.ndarray:
    """x of L L' x = b, by blocks."""
    x, n = b.astype(lower.dtype), len(b)
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        x[lo:hi] = np.linalg.solve(lower[lo:hi, lo:hi], x[lo:hi] - lower[lo:hi, :lo] @ x[:lo])
    for lo in reversed(range(0, n, step)):
        hi = min(lo + step, n)
        x[lo:hi] = np.linalg.solve(lower[lo:hi, lo:hi].T, x[lo:hi] - x[hi:] @ lower[hi:, lo:hi])
    return x.astype(b.dtype)


#: Of all regressions.
PENALTY = 1 + 1e-9


def ridge(chosen: np.ndarray, y: np.ndarray, near: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Weights of a weighted ridge regression on zeros and ones with a free intercept; the smaller of its two systems is solved.

    The system is made and factored in single precision, which is half the work; conjugate gradients on the samples themselves, in double
    precision, take the solution from there to full precision in a few steps.
    """
    samples, words = chosen.shape
    if np.ptp(y) == 0:
        return np.zeros(words)
    penalty, root = PENALTY, np.sqrt(near)
    y = (y - near @ y / near.sum()) * root
    step = max(1, block // words)
    parts = [(slice(lo, lo + step), chosen[lo : lo + step]) for lo in range(0, samples, step)]
    mean = sum(near[at] @ part.astype(np.float64) for at, part in parts) / near.sum()

    def across(v: np.ndarray) -> np.ndarray:
        """v' X for the centred and weighted samples X."""
        v = v * root
        return sum(v[at] @ part.astype(np.float64) for at, part in parts) - v.sum() * mean

    def along(p: np.ndarray) -> np.ndarray:
        return (np.concatenate([part.astype(np.float64) @ p for _, part in parts]) - mean @ p) * root

    def square(p: np.ndarray) -> np.ndarray:
        """X' X p, in one pass."""
        out, all_, shift = np.zeros(words), 0.0, mean @ p
        for at, part in parts:
            x = part.astype(np.float64)
            v = (x @ p - shift) * near[at]
            out, all_ = out + v @ x, all_ + v.sum()
        return out - all_ * mean

    x = chosen.astype(np.float32)
    x -= mean.astype(np.float32)
    x *= root[:, None].astype(np.float32)
    narrow = words <= samples
    gram = x.T @ x if narrow else x @ x.T
    del x
    gram[np.diag_indices(len(gram))] += np.float32(penalty)
    lower = factored(gram)
    of = (lambda p: square(p) + penalty * p) if narrow else (lambda p: along(across(p)) + penalty * p)
    right = across(y) if narrow else y
    found, rest = np.zeros(len(right)), right.copy()
    way, size = None, 1.0
    for _ in range(50):
        if np.abs(rest).max() <= 1e-11 * np.abs(right).max():
            break
        better = triangle_solved(lower, rest)
        before, size = size, rest @ better
        way = better if way is None else better + size / before * way
        image = of(way)
        far = size / (way @ image)
        found, rest = found + far * way, rest - far * image
    return found if narrow else across(found)


def largest(weights: np.ndarray, most: int) -> list[tuple[int, float]]:
    """The places of the largest weights, and they."""
    order = np.lexsort((np.arange(len(weights)), -np.abs(weights)))[:most]
    return [(int(i), float(weights[i])) for i in order]


def nearness(kept: np.ndarray, width: float) -> np.ndarray:
    """How much samples count that keep such a share of a text."""
    return np.exp(-((1 - np.sqrt(kept)) ** 2) / width**2)


def weighed(chosen: np.ndarray, shares: np.ndarray, most: int, width: float) -> list[tuple[int, float]]:
    """The places of the words with the largest weights in a linear model of the samples' shares; samples that keep more count more."""
    return largest(ridge(chosen, shares, nearness(chosen.mean(1), width)), most)


class Triangle:
    """A lower triangle L, for many right sides at once; the leading part of a solution is that of the leading part of L."""

    def __init__(self, lower: np.ndarray, step: int = 256):
        self.lower = lower
        blocks = [(lo, min(lo + step, len(lower))) for lo in range(0, len(lower), step)]
        self.blocks = [(lo, hi, np.linalg.inv(lower[lo:hi, lo:hi])) for lo, hi in blocks]

    def forward(self, x: np.ndarray) -> np.ndarray:
        """L^-1 x, in place."""
        for lo, hi, inverse in self.blocks:
            x[lo:hi] = inverse @ (x[lo:hi] - self.lower[lo:hi, :lo] @ x[:lo])
        return x

    def backward(self, x: np.ndarray) -> np.ndarray:
        """L'^-1 x, in place."""
        for lo, hi, inverse in reversed(self.blocks):
            x[lo:hi] = inverse.T @ (x[lo:hi] - self.lower[hi:, lo:hi].T @ x[hi:])
        return x


class Regressions:
    """ridge() for many texts of ``least`` to ``words`` words at once, by what they have in common: the samples drawn.

    With 1 and -1 for words kept and left out, a text's samples are those drawn times a sign for each word. So its system is one that all
    texts share, but for signs, for sample 0, and for how much samples count, which differs little. The shared one is factored once, in
    single precision; conjugate gradients take each text's own system from there to full precision in a few steps. The leading part of
    a factor is the factor of the leading part, so it does for texts of all lengths. With more words than samples (``wide``) the system is
    that of the samples, with ``least`` words; what further words add to it is of low rank and has a factor of its own, with leading parts too.
    """

    def __init__(self, least: int, words: int, samples: int, seed: int, width: float):
        self.words, self.samples, self.width, self.wide = words, samples, width, least > samples
        bits = drawn_bits(words, samples, seed)
        self.signs = []  # (words, samples) of each block
        for lo in range(0, words, DRAWN):
            self.signs.append(np.unpackbits(bits[lo : lo + DRAWN], axis=1, count=samples).view(np.int8) * np.int8(2) - np.int8(1))
            self.signs[-1][:, 0] = 0  # sample 0 isn't drawn
        size = samples if self.wide else words
        gram = np.zeros((size, size), np.float32)
        if self.wide:
            for lo, signs in zip(range(0, least, DRAWN), self.signs, strict=False):
                x = signs[: least - lo].astype(np.float32)
                gram += x.T @ x
        else:
            for lo in range(0, samples, 1000):
                x = np.concatenate([signs[:, lo : lo + 1000] for signs in self.signs]).astype(np.float32)
                gram += x @ x.T
        gram *= np.float32(nearness(np.float64(0.5), width) / 4)
        gram[np.diag_indices(size)] += np.float32(PENALTY)
        if self.wide:
            gram[0, 0] += np.float32(nearness(np.float64(0.5), width) * least / 4)
        self.factor, self.least = Triangle(factored(gram)), least
        if self.wide:
            further = np.concatenate([*self.signs, np.zeros((1, samples), np.int8)])[least:].T * np.float32(np.sqrt(nearness(np.float64(0.5), width) / 4))
            self.further = self.factor.forward(further)
            self.core = Triangle(factored(self.further.T @ self.further + np.eye(further.shape[1], dtype=np.float32)))

    def nearly(self, b: np.ndarray, scale: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Solutions of the shared system of texts of such sizes, with its rows and columns divided by ``scale``."""
        x = self.factor.forward((b * scale).astype(np.float32))
        if self.wide:
            inside = np.arange(self.further.shape[1])[:, None] < sizes - self.least
            x -= self.further @ self.core.backward(self.core.forward(self.further.T @ x) * inside)
        else:
            x *= np.arange(self.words)[:, None] < sizes
        return self.factor.backward(x) * scale

    def sums(self, p: np.ndarray) -> np.ndarray:
        """Of each drawn sample, the sum of p with its signs."""
        out = np.zeros((self.samples, p.shape[1]))
        for lo, signs in zip(range(0, self.words, DRAWN), self.signs, strict=True):
            out += signs.astype(np.float64).T @ p[lo : lo + DRAWN]
        return out

    def sums_of_samples(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([signs.astype(np.float64) @ v for signs in self.signs])

    def fitted(self, turns: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        """The weights of texts whose words are turned over so; y: (samples, texts)."""
        sizes = np.array([len(t) for t in turns])
        sign = np.zeros((self.words, len(turns)))
        for i, turn in enumerate(turns):
            sign[: len(turn), i] = 1 - 2.0 * turn
        inside = sign != 0
        kept = self.sums(sign)
        kept[0] = sizes
        near = nearness((sizes + kept) / (2 * sizes), self.width)
        all_ = near.sum(0)
        y = np.where(np.ptp(y, 0) > 0, y - (near * y).sum(0) / all_, 0.0)
        mean = (sign * self.sums_of_samples(near) + inside * near[0]) / all_

        def along(p: np.ndarray) -> np.ndarray:
            """X p of the centred samples X of each text."""
            out = self.sums(sign * p)
            out[0] = p.sum(0)
            out -= (mean * p).sum(0)
            out *= 0.5
            return out

        def across(v: np.ndarray) -> np.ndarray:
            """X' v"""
            out = self.sums_of_samples(v)
            out *= sign
            out += inside * v[0]
            out -= v.sum(0) * mean
            out *= 0.5
            return out

        def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """a b, in place of a."""
            a *= b
            return a

        if self.wide:
            root = np.sqrt(near)
            found = self.conjugate(root * y, lambda a: times(along(across(root * a)), root), np.sqrt(nearness(np.float64(0.5), self.width)) / root, sizes)
            found = across(root * found)
        else:
            found = self.conjugate(across(near * y), lambda p: across(times(along(p), near)), sign, sizes)
        return [found[:size, i] for i, size in enumerate(sizes)]

    def conjugate(self, right: np.ndarray, of: Callable[[np.ndarray], np.ndarray], scale: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """x of of(x) + PENALTY x = right"""
        found, rest, way, size = np.zeros(right.shape), right.copy(), np.zeros(right.shape), np.ones(right.shape[1])
        enough = 1e-11 * np.abs(right).max(0)
        for _ in range(500):
            open_ = np.abs(rest).max(0) > enough
            if not open_.any():
                break
            better = self.nearly(rest, scale, sizes)
            before, size = size, np.einsum("ij,ij->j", rest, better)
            way *= np.divide(size, before, out=np.zeros_like(size), where=before > 0)
            way += better
            image = of(way)
            image += PENALTY * way
            below = np.einsum("ij,ij->j", way, image)
            far = np.divide(size, below, out=np.zeros_like(size), where=open_ & (below > 0))
            found += far * way
            image *= far
            rest -= image
        return found


def classes(samples: int) -> list[int]:
    """The least words of each class of lengths: a fifth more than the one before, and one begins where there are more words than samples."""
    edges, most = [1], 2**31 - 1
    while edges[-1] < most:
        more = max(edges[-1] + 128, int(edges[-1] * 1.2))
        edges.append(min(more, most if edges[-1] > samples else samples + 1))
    return edges


def lexicon_words(text: Column) -> Column:
    """Of each of a text's tokens that holds lexicon words its place, itself and the distinct words that it holds."""
    listed = [*POSITIVE_WORDS, *NEGATIVE_WORDS]
    held = F.transform(tokens(text), lambda t, i: F.struct(i.alias("at"), t.alias("token"), F.filter(distinct_words(t), lambda w: w.isin(listed)).alias("words")))
    return F.filter(held, lambda x: F.size(x["words"]) > 0)


def places(held: dict[int, list[str]]) -> dict[str, list[int]]:
    """The tokens that hold each lexicon word of a text."""
    found: dict[str, list[int]] = {}
    for i, words in held.items():
        for w in words:
            found.setdefault(w, []).append(i)
    return found


def counts(bits: np.ndarray, turn: np.ndarray, samples: int, held: dict[int, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct good and bad words each sample of a text has: a word is there if any of its tokens is."""
    good, bad = np.zeros(samples, np.int64), np.zeros(samples, np.int64)
    for word, at in places(held).items():
        there = np.bitwise_or.reduce(bits[at] ^ (turn[at] * np.uint8(255))[:, None], 0)
        there[0] |= 128
        count = good if word in GOOD else bad
        count += np.unpackbits(there, count=samples)
    return good, bad


def by_row(rows: DataFrame, key: str, text: str, schema: str, found: Callable[[object, Sequence[str], int, list[dict]], Iterable[tuple]], whole: bool) -> DataFrame:
    """Applies a function of (key, tokens, their number, lexicon words by token) to each text; the tokens are sent if ``whole``."""
    words = tokens(F.col(text))
    words = dealt(rows.select(F.col(key), (words if whole else strings([]).cast("array<string>")).alias("words"), F.size(words).alias("size"), lexicon_words(F.col(text)).alias("held")), key)

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        fields = [(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))]
        for batch in batches:
            for k, own, size, held in zip(*(batch.column(c) for c in (key, "words", "size", "held")), strict=True):
                out = list(found(k.as_py(), own, size.as_py(), held.as_py())) if size.as_py() else []
                columns = [pa.array([k.as_py()] * len(out), k.type), *(pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([(key, k.type), *fields]))

    return words.mapInArrow(made, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")


def fitted_rows(rows: DataFrame, key: str, text: str, samples: int, seed: int, most: int, width: float) -> DataFrame:
    """explain() with the default scorer: texts of like lengths come together, and are fitted many at a time."""
    words = tokens(F.col(text))
    rows = rows.select(F.col(key), F.array_join(words, " ").alias("words"), F.size(words).alias("size"), lexicon_words(F.col(text)).alias("held")).filter("size > 0")
    rows = rows.withColumn("held", F.transform("held", lambda x: F.struct(x["at"], x["words"])))
    edges = classes(samples)
    kind = reduce(lambda found, edge: F.when(F.col("size") >= edge, F.lit(edge)).otherwise(found), edges[1:], F.lit(1))
    parts = F.when(F.col("least") < 513, 16).when(F.col("least") < 1300, 8).otherwise(4)  # of a class; few where its factors take long
    rows = rows.withColumn("least", kind).repartition(tasks(rows), "least", F.pmod(F.xxhash64(F.col(key).cast("string")), parts)).sortWithinPartitions("least", F.desc("size"))

    def solved(shared: Regressions | None, held: list[tuple]) -> Iterator[tuple]:
        turns = [turned(k, size, seed) for k, _, size, _ in held]
        bits = drawn_bits(held[0][2], samples, seed)  # the first is the longest
        found = [counts(bits, turn, samples, {x["at"]: x["words"] for x in own}) for turn, (_, _, _, own) in zip(turns, held, strict=True)]
        shares = [keyword_shares(good, bad) for good, bad in found]
        labels = [int(x[0].argmax()) for x in shares]
        y = np.stack([x[:, label] for x, label in zip(shares, labels, strict=True)], 1)
        if shared is not None:
            weights = shared.fitted(turns, y)
        else:
            chosen = (masks(k, size, samples, seed) for k, _, size, _ in held)
            weights = [ridge(x, y[:, i], nearness(x.mean(1), width)) for i, x in enumerate(chosen)]
        for (k, words_, _, _), label, of in zip(held, labels, weights, strict=True):
            own = words_.split(" ")
            for i, x in largest(of, most):
                yield k, own[i], x, LABELS[label]

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shared, least, waiting, schema = None, 0, [], None

        def out() -> pa.RecordBatch:
            nonlocal shared
            if shared is None and len(waiting) > 1:  # that takes about as long as one text alone
                shared = Regressions(least, waiting[0][2], samples, seed, width)
            columns = zip(*solved(shared, waiting), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field(key), ("token", pa.string()), ("weight", pa.float64()), ("predicted_class", pa.string())])
            for row in zip(*(batch.column(c) for c in (key, "words", "size", "held", "least")), strict=True):
                *row, of = (x.as_py() for x in row)
                if waiting and (of != least or len(waiting) == 128 or len(waiting) * row[2] > 1 << 20):
                    yield out()
                    waiting = []
                if of != least:
                    shared, least = None, of
                waiting.append(row)
        if waiting:
            yield out()

    return rows.mapInArrow(made, f"{key} {rows.schema[key].dataType.simpleString()}, token string, weight double, predicted_class string")


def explain(rows: DataFrame, key: str, text: str, scorer: Scorer = keyword_scorer, samples: int = 5000, seed: int = 42, most: int = 10, width: float = 0.25) -> DataFrame:
    """(key, token, weight, predicted_class): the words with the largest weights for the class that the whole text has.

    Samples follow from the key and the seed. Texts without words give no rows.
    """
    schema = "token string, weight double, predicted_class string"
    if scorer is keyword_scorer:
        return fitted_rows(rows, key, text, samples, seed, most, width)

    scored = scorer(perturbed(rows, key, text, samples, seed), "kept").select(key, "sample", "sentiment_label", "score_positive", "score_negative", "score_neutral")

    def fitted(of: tuple, group: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(group) or not len(words := list(texts["words"].iloc[0])):
            return pd.DataFrame(columns=[key, "token", "weight", "predicted_class"], dtype=object)
        group = group.drop_duplicates("sample").sort_values("sample")
        label = group["sentiment_label"].iloc[0]
        best = weighed(masks(of[0], len(words), samples, seed), group[f"score_{label}"].to_numpy(float), most, width)
        return pd.DataFrame({key: of[0], "token": [words[i] for i, _ in best], "weight": [x for _, x in best], "predicted_class": label}, dtype=object)

    kind = rows.schema[key].dataType.simpleString()
    words = rows.select(F.col(key), tokens(F.col(text)).alias("words"))
    return dealt(scored, key).groupBy(key).cogroup(dealt(words, key).groupBy(key)).applyInPandas(fitted, f"{key} {kind}, {schema}")


def owen(tokens_: list[list[str]]) -> dict[int, np.ndarray]:
    """owen_values() of a text's tokens, given the lexicon words of each."""
    return owen_values(len(tokens_), {i: words for i, words in enumerate(tokens_) if words})


def owen_values(size: int, held: dict[int, list[str]]) -> dict[int, np.ndarray]:
    """For each token with lexicon words what it adds to the three shares: its Owen value in a hierarchy that halves the text.

    A token adds something to what is there already: of each part of the text beside its own, on all levels, all or nothing, each with
    a chance of one half. What is there matters by its numbers of good and bad words alone, but for words that other
    tokens hold too, which count once. So the states on the way down are few: two numbers and the set of such words.
    """
    found, at = places(held), sorted(held)
    again = {w: 1 << i for i, w in enumerate(sorted(w for w, in_ in found.items() if len(in_) > 1))}
    good_again = sum(bit for w, bit in again.items() if w in GOOD)

    def part(lo: int, hi: int) -> tuple[int, int, int]:
        """Good and bad words that stand only here, and the set of others, of tokens lo to hi."""
        words = {w for i in at[bisect_left(at, lo) : bisect_left(at, hi)] for w in held[i]}
        alone = [w for w in words if w not in again]
        good = sum(w in GOOD for w in alone)
        return good, len(alone) - good, sum(again[w] for w in words if w in again)

    def numbers(state: tuple[int, int, int]) -> tuple[int, int]:
        good, bad, shared = state
        g = (shared & good_again).bit_count()
        return good + g, bad + shared.bit_count() - g

    def together(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
        return a[0] + b[0], a[1] + b[1], a[2] | b[2]

    values: dict[int, np.ndarray] = {}
    open_ = [(0, size, {(0, 0, 0): 1.0})]
    while open_:
        lo, hi, states = open_.pop()
        own = part(lo, hi)
        if own == (0, 0, 0):
            continue
        if hi - lo == 1:
            chance = np.array(list(states.values()))
            before, after = (np.array([numbers(s) for s in x]) for x in (states, [together(s, own) for s in states]))
            values[lo] = chance @ (keyword_shares(*after.T) - keyword_shares(*before.T))
            continue
        middle = (lo + hi) // 2
        for first, end, other in ((lo, middle, part(middle, hi)), (middle, hi, part(lo, middle))):
            below: dict[tuple[int, int, int], float] = {}
            for state, chance in states.items():
                for s in (state, together(state, other)):
                    below[s] = below.get(s, 0.0) + chance / 2
            open_.append((first, end, below))
    return values


def attributions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, token, positive, negative, neutral): what each token adds to the three shares of the default scorer.

    Together they are what the text's shares and those of an empty text differ by. Tokens without lexicon words add nothing and are left
    out; exact, no samples are drawn.
    """

    def found(_: object, words: Sequence, size: int, held: list[dict]) -> Iterator[tuple]:
        values = owen_values(size, {x["at"]: x["words"] for x in held})
        return ((x["at"], x["token"], *(float(v) for v in values[x["at"]])) for x in held)

    return by_row(rows, key, text, "position int, token string, positive double, negative double, neutral double", found, False)


def summary(weights: DataFrame, most: int = 20) -> DataFrame:
    """Mean size of a token's weight, over texts and without case, for each class."""
    means = weights.groupBy(F.lower("token").alias("token"), "predicted_class").agg(F.avg(F.abs("weight")).alias("mean_weight"), F.count("*").alias("n"))
    return means.withColumn("k", F.row_number().over(Window.partitionBy("predicted_class").orderBy(F.desc("mean_weight"), "token"))).filter(F.col("k") <= most).drop("k")
