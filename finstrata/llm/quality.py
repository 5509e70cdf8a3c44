"""Quality classifier by co-training (operator 1).

Two classifiers see two views of a document: its text (words, their beginnings, and the text's style) and its metadata
(source, language, length). Both start from the labelled rows. In each round both score all unlabelled rows, and each labels those
that it is sure of for the other one to learn from. At last each view is calibrated on labelled rows that it didn't learn
from, the calibrated views are combined on others, and all documents are scored.

The models are fitted on the driver, on bounded samples of labelled rows: at most ``most_labelled`` rows with labels, and
in each round at most ``per_round`` more rows of each class and view that the other view has labelled. Of all rows that a view
is sure of, those with the smallest hashes of their ids are taken, a uniform sample. Only these rows' features come
to the driver; whole texts of all rows are scored in the tasks that read them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import carried, rows_as, settle, texts

BITS = 18
#: Style features follow the hashed ones.
STYLE = ("bias", "capitals", "digits", "symbols", "bars", "exclamations", "distinct", "word length", "few words", "repeated word")
SIZE = (1 << BITS) + len(STYLE)
FEATURES = "doc_id long, view int, label int, items array<int>, style array<double>, meta array<int>"
SURE = "doc_id long, view int, label int"
SCORES = "doc_id long, p_text double, p_meta double, score double, keep boolean"
META = 1 << 12
#: Characters that prose has few of, and the ends of words that don't count.
SYMBOLS, ENDS = b"#$%&*+/<=>@[\\]^_`{|}~", b".,;:!?\"'()"
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


class Items(dict):
    """word -> its two features: itself without case and punctuation, and its first five bytes."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(ENDS).lower()
        value = self[word] = (zlib.crc32(bare) >> (32 - BITS), zlib.crc32(b"^" + bare[:5]) >> (32 - BITS))
        return value


def style(body: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    """The style features, each between 0 and about 1."""
    n, w = max(len(body), 1), max(len(words), 1)
    share = lambda chars: 1 - len(body.translate(None, chars)) / n
    again = sum(map(eq, words, words[1:])) / w
    return [1.0, 2 * share(CAPITALS), 3 * share(DIGITS), 6 * share(SYMBOLS), 20 * body.count(b"|") / n, 20 * body.count(b"!") / n, len(distinct) / w, (n / w) / 10, 1.0 if len(words) < 8 else 0.0, again]


def meta_items(source: str | None, lang: str | None, length: int) -> list[int]:
    """Features of the metadata: source, language, their pair, and the length's magnitude (also within the language)."""
    size = int(2 * math.log2(length + 1))
    named = [f"s{source}", f"l{lang}", f"s{source}l{lang}", f"n{size}", f"l{lang}n{size}"]
    return [0] + [1 + zlib.crc32(x.encode()) % (META - 1) for x in named]


@dataclass
class Linear:
    """A logistic regression over sparse rows; after calibrate(), its margins are log odds."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, margin):
        return np.clip(self.slope * margin + self.shift, -12, 12)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def margins(weights: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int = 0) -> np.ndarray:
    items, values, of = rows
    return np.bincount(of, weights[items] * values, n)


def fit(rows: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, importance: np.ndarray, size: int, steps: int = 60, l2: float = 2e-4) -> np.ndarray:
    """Weights by full-batch gradient steps with a rate for each feature (AdaGrad).

    A hashed feature counts as much as the log ratio of its shares among good and bad rows, so that rare telling words are not
    drowned by common ones.
    """
    items, values, of = rows
    dense = len(STYLE) if size == SIZE else 0
    good, bad = (np.bincount(items, (importance * t)[of], minlength=size)[: size - dense] + 1 for t in (y, 1 - y))
    ratio = np.concatenate([np.log(good / good.sum() * bad.sum() / bad), np.ones(dense)])
    rows = items, values * ratio[items], of
    values = rows[1]
    weights, squares = np.zeros(size), np.full(size, 1e-8)
    total = max(importance.sum(), 1e-9)
    for _ in range(steps):
        error = (sigmoid(margins(weights, rows)) - y) * importance / total
        gradient = np.bincount(items, values * error[of], minlength=size) + l2 * weights
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
    return weights * ratio


def logistic(x: np.ndarray, target: np.ndarray, prior: np.ndarray, ridge: float) -> np.ndarray:
    """Few weights by Newton's steps, each halved until it helps; drawn to ``prior``."""
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w) + ridge / 2 * ((w - prior) ** 2).sum()
    w = prior.astype(float)
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - target) + ridge * (w - prior))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrated(weights: np.ndarray, margin: np.ndarray, y: np.ndarray) -> Linear:
    """Slope and shift of the margins as log odds (Platt), with smoothed targets."""
    if len(y) == 0 or y.min() == y.max():
        return Linear(weights)
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = logistic(np.stack([margin, np.ones_like(margin)], 1), target, np.array([1.0, 0.0]), 1e-3)
    return Linear(weights, max(float(slope), 0.0), float(shift))


def scale(distinct: int) -> float:
    """What a word's features count in a text of so many different words."""
    return 5 / math.sqrt(distinct + 1)


@dataclass
class View:
    """What one classifier sees of the sampled rows: their items one after the other, where each row's end, style features."""

    items: np.ndarray
    ends: np.ndarray
    dense: np.ndarray | None

    def __len__(self) -> int:
        return len(self.ends) - 1

    def rows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The given rows as items, values, and the (new) row that each belongs to."""
        first, sizes = self.ends[of], self.ends[of + 1] - self.ends[of]
        row = np.repeat(np.arange(len(of), dtype=np.int32), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
        if self.dense is None:
            return self.items[at], np.ones(len(row), np.float32), row
        weigh = np.array([scale(n // 2) for n in sizes.tolist()], np.float32)
        k = self.dense.shape[1]
        return (
            np.concatenate([self.items[at], np.tile(np.arange(SIZE - k, SIZE, dtype=np.int32), len(of))]),
            np.concatenate([weigh[row], self.dense[of].reshape(-1).astype(np.float32)]),
            np.concatenate([row, np.repeat(np.arange(len(of), dtype=np.int32), k)]),
        )


def appended(a: tuple, b: tuple, n: int) -> tuple:
    """Two sets of rows as one; the first has n rows."""
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2] + np.int32(n)])


def one_class(y: np.ndarray) -> tuple[Linear, Linear]:
    """With labels of one class or none, its share is all there is to learn."""
    odds = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return Linear(np.zeros(SIZE), 0.0, odds), Linear(np.zeros(META), 0.0, odds)


class CoTraining:
    """Fits both views' classifiers on labelled rows, of which every eighth calibrates them and another eighth combines them."""

    def __init__(self, views: tuple[View, View], y: np.ndarray):
        turn = np.arange(len(y)) % 8
        learn, check, mix = (np.flatnonzero(x) for x in ((turn != 3) & (turn != 7), turn == 3, turn == 7))
        self.y = tuple(y[of] for of in (learn, check, mix))
        self.learned, self.checked, self.mixed = ([v.rows(of) for v in views] for of in (learn, check, mix))
        self.trivial = one_class(y) if len(y) == 0 or self.y[0].min(initial=1) == self.y[0].max(initial=0) else None

    def fit(self, pseudo: tuple[tuple[View, np.ndarray], tuple[View, np.ndarray]] | None = None) -> tuple[Linear, Linear]:
        """pseudo: for each view, rows that the other one has labelled, and their labels; they weigh half, and no more than labels."""
        if self.trivial:
            return self.trivial
        learn, check, _ = self.y
        models = []
        for k, size in enumerate((SIZE, META)):
            rows, targets, weigh = self.learned[k], learn, np.ones(len(learn))
            if pseudo is not None and len(pseudo[k][1]):
                view, labels = pseudo[k]
                rows, targets = appended(rows, view.rows(np.arange(len(view))), len(learn)), np.concatenate([learn, labels])
                weigh = np.concatenate([weigh, np.full(len(labels), 0.5 * min(1.0, len(learn) / len(labels)))])
            weights = fit(rows, targets, weigh, size)
            models.append(calibrated(weights, margins(weights, self.checked[k], len(check)), check))
        return models[0], models[1]

    def combine(self, models: tuple[Linear, Linear]) -> np.ndarray:
        """Weights of both views' log odds (text, meta, bias)."""
        _, _, y = self.y
        if self.trivial or not len(y):
            return np.array([0.5, 0.5, 0.0])
        odds = np.stack([m.log_odds(margins(m.weights, rows, len(y))) for m, rows in zip(models, self.mixed, strict=True)] + [np.ones(len(y))], 1)
        return logistic(odds, y, np.array([1.0, 0.5, 0.0]), 0.1)


def featured(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema, items = rows_as(FEATURES), Items()
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("source", "lang", "length")]
        for body, source, lang, length in zip(batch.column("body"), *columns, strict=True):
            text = body.as_py()
            words = text.split()
            distinct = set(words)
            out.append((sorted(x for w in distinct for x in items[w]), style(text, words, distinct), meta_items(source, lang, length)))
        features = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, list(schema)[3:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "view", "label")), *features], schema=schema)


def views_of(features) -> tuple[View, View]:
    flat = lambda c: features.column(c).combine_chunks()
    items, meta = ((np.asarray(x.flatten(), np.int32), np.concatenate([[0], np.cumsum(np.asarray(x.value_lengths()))]).astype(np.int64)) for x in map(flat, ("items", "meta")))
    return View(*items, np.asarray(flat("style").flatten()).reshape(features.num_rows, len(STYLE))), View(*meta, None)


class WordWeights(dict):
    """word -> the sum of its two features' weights."""

    def __init__(self, weights: np.ndarray, most: int = 600_000):
        self.weights, self.items, self.most = weights, Items(), most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        a, b = self.items.__missing__(word)
        self.items.clear()
        value = self[word] = float(self.weights[a] + self.weights[b])
        return value


class Scorer:
    """Both views' log odds of a batch of rows."""

    def __init__(self, text: Linear, meta: Linear):
        self.text, self.meta = text, meta
        self.words, self.dense, self.meta_weights = WordWeights(text.weights), text.weights[1 << BITS :].tolist(), meta.weights.tolist()

    def __call__(self, batch) -> tuple[np.ndarray, np.ndarray]:
        weight, dense, meta_weights, a, b = self.words.__getitem__, self.dense, self.meta_weights, [], []
        columns = [batch.column(c).to_pylist() for c in ("source", "lang", "length")]
        for body, source, lang, size in zip(batch.column("body"), *columns, strict=True):
            text = body.as_py()
            tokens = text.split()
            distinct = set(tokens)
            a.append(scale(len(distinct)) * math.fsum(map(weight, distinct)) + sum(x * y for x, y in zip(style(text, tokens, distinct), dense, strict=True)))
            b.append(sum(meta_weights[i] for i in meta_items(source, lang, size)))
        return self.text.log_odds(np.array(a)), self.meta.log_odds(np.array(b))


def sure_finder(fitted, least: float):
    def found(batches: Iterator) -> Iterator:
        """(doc_id, view, label): the rows that the other view is sure of, for the view to learn from."""
        import pyarrow as pa

        odds_of = Scorer(*fitted.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for view, odds in enumerate(reversed(odds_of(batch))):  # the text's view learns from the metadata's odds
                at = np.flatnonzero(np.abs(odds) >= least)
                labels = (odds[at] > 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), view, np.int32)), pa.array(labels)], schema=rows_as(SURE))

    return found


def first_by_hash(found: DataFrame, most: int) -> DataFrame:
    """Of each view and label the ``most`` rows with the smallest hashes of their ids.

    Hashes are spread evenly, so the smallest ones lie below a bound that follows from the number of rows (with 6 standard deviations to
    spare): what meets in one task is little more than what is taken, however many rows and tasks there are.
    """
    hash_ = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    sizes = found.groupBy("view", "label").agg(F.count("*").alias("n"))  # four rows at most
    near = found.join(F.broadcast(sizes), ["view", "label"]).filter(hash_ / F.lit(2.0**63) * F.col("n") <= most + 6 * math.sqrt(most) + 10)
    nth = F.row_number().over(Window.partitionBy("view", "label").orderBy(hash_, "doc_id"))
    return near.withColumn("nth", nth).filter(F.col("nth") <= most).select("doc_id", "view", "label")


def score_quality(docs: DataFrame, labels: DataFrame, most_labelled: int = 6000, rounds: int = 2, sure: float = 0.98, per_round: int = 800, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, p_text, p_meta, score (chance of being good), keep, and carried
    (a struct of the columns of ``docs`` that ``carry`` names).

    Good are documents labelled quality 1 and toxic 0; labels with a null are left out, and of repeated ones the worst
    counts. Null texts are empty ones, null metadata is a value of its own; rows without an id are scored, but not learned from. Without
    labels of both classes, the score is the (smoothed) share of good ones. Repeated rows score alike; of rows with one id, any one
    is learned from. Ties in choosing rows go to smaller ids. An empty table gives no rows.
    """
    spark = docs.sparkSession
    along, kind = carried(docs, carry)
    length = F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("length")
    rows = texts(docs, id_col, text_col, F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"), length, along)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).dropna().groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("label"))

    def features(wanted: DataFrame):
        """Of rows (doc_id, view, label), so few that they can be broadcast: their features, on the driver."""
        mine = rows.drop("carried").join(F.broadcast(wanted), "doc_id").mapInArrow(featured, FEATURES)
        return mine.dropDuplicates(["doc_id", "view"]).toArrow().sort_by([("doc_id", "ascending"), ("view", "ascending")])

    ids = rows.select("doc_id").distinct()
    known = marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = features(known.select("doc_id", F.lit(-1).alias("view"), "label"))
    training = CoTraining(views_of(sample), np.asarray(sample.column("label"), float))
    models = training.fit()
    for turn in range(0 if training.trivial else rounds):
        found = rows.filter("doc_id is not null").mapInArrow(sure_finder(spark.sparkContext.broadcast(models), math.log(sure / (1 - sure))), SURE)
        found = settle(found.join(marks.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "view"]))
        chosen = features(first_by_hash(found, per_round * (turn + 1)))
        of = np.asarray(chosen.column("view"))
        parts = [chosen.filter(of == k) for k in (0, 1)]
        models = training.fit(tuple((views_of(p)[k], np.asarray(p.column("label"), float)) for k, p in enumerate(parts)))
    mix = training.combine(models)
    fitted = spark.sparkContext.broadcast(models)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        odds_of = Scorer(*fitted.value)
        for batch in batches:
            by_text, by_meta = odds_of(batch)
            score = sigmoid(mix[0] * by_text + mix[1] * by_meta + mix[2])
            columns = [batch.column("doc_id"), *map(pa.array, (sigmoid(by_text), sigmoid(by_meta), score, score >= threshold)), batch.column("carried")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p_text", "p_meta", "score", "keep", "carried"])

    return rows.mapInArrow(scored, f"{SCORES}, carried {kind}")
