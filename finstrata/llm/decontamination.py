"""Benchmark decontamination (operator 6): n-gram seeds, then Smith-Waterman alignment.

Seeds are rare n-grams: of four words, which hardly any two texts share by chance, one after the other or with one word left out
between them. A document and an item that share any are a pair, whatever the other documents hold. Left-out words make up for
edits that are spread so evenly that no four words in a row stay: of copies with replaced words that score more than half,
every one shares a seed with its item (of three words for items under 16 words), and as both sides leave words out, so do copies
with words put in or taken away as evenly. Around the seeds of a pair the document's words are aligned with the item's, as far on both sides as an alignment that
scores enough can reach (``span``). The local alignment's score, as a share of
the item's score with itself, tells copies, edited ones included, from texts that only share a phrase. Pairs whose shared
words can't reach the score that counts are left out before they are aligned.

Documents are filtered in the tasks that read them by two bitmaps of the items' n-grams, of a fixed size however large the
benchmark is; exact joins follow. What is shuffled is a row for each seed that a document shares, and the words around it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import bitmap, marked, rows_as, settle, texts
from finstrata.llm.near_join import word_hashes
from finstrata.llm.shingles import MIX, WordHashes, mixed

GRAMS = "item_id long, gram long, words binary"
HITS = "doc_id long, _row long, first int, around binary, grams array<long>, lows array<int>, highs array<int>"
ALIGNED = "doc_id long, _row long, item_id long, score double, matched int, doc_start long, doc_end long, item_start int, item_end int"
#: Bits of each of the two bitmaps: 4 MB. One is of the hashes' top bits, the other of those from LOW on.
BITS, LOW = 25, 39


def shared_grams(cells: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> np.ndarray:
    """Places of the n-grams that both bitmaps let pass."""
    at = np.flatnonzero(marked(cells[0], grams, BITS))
    return at[marked(cells[1], grams[at] << np.uint64(LOW), BITS)]


def kind_of(n: int, k: int) -> int:
    """What seeds an item of n words has: k words with gaps; of a short one, one word less; of up to k words (negative), itself."""
    return k if n >= 4 * k else k - 1 if n > k else -n


def seeds_of(hashes: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first places) of the runs of so many words, also of those with one word left out; a negative kind is without gaps."""
    grams, places = [], []
    for gap in range(kind if kind > 0 else 1):  # the word after the first ``gap`` words is left out; 0: none is
        offsets = [i + (0 < gap <= i) for i in range(abs(kind))]
        n = max(0, len(hashes) - offsets[-1])
        total = hashes[:n].copy()
        for i in offsets[1:]:
            total = total * MIX + hashes[i : i + n]
        grams.append(mixed(total))
        places.append(np.arange(n))
    return np.concatenate(grams), np.concatenate(places)


def item_grams(k: int):
    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema, words = rows_as(GRAMS), WordHashes()
        for batch in batches:
            ids, grams, own = [], [], []
            for item, body in zip(batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                hashes = word_hashes(body.as_py(), words)
                if len(hashes):
                    g = np.unique(seeds_of(hashes, kind_of(len(hashes), k))[0])
                    ids += [item] * len(g)
                    grams.append(g.view(np.int64))
                    own += [hashes.tobytes()] * len(g)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(grams) if grams else [], pa.int64()), pa.array(own, pa.binary())], schema=schema)

    return made


def span(size: int, least: float) -> int:
    """The most words of a document that an alignment with an item of ``size`` words takes and still scores ``least``.

    It scores 2 for each matched word, ``size`` at most, and loses 1 for each word of the document that has none.
    """
    return size + math.ceil(2 * size * (1 - least))


def seed_finder(kinds: list[int], shared, reach: int):
    def found(batches: Iterator) -> Iterator:
        """For each run of places where a document holds seeds: the seeds, each one's first and last place, and the words around, ``reach`` on either side."""
        import pyarrow as pa

        schema, words, cells = rows_as(HITS), WordHashes(), shared.value
        for batch in batches:
            rows = []
            keys = batch.column("_row").to_pylist()
            for doc_id, key, body in zip(batch.column("doc_id").to_pylist(), keys, batch.column("body"), strict=True):
                hashes = word_hashes(body.as_py(), words)
                grams, at = zip(*((g[x], p[x]) for g, p in (seeds_of(hashes, kind) for kind in kinds) for x in [shared_grams(cells, g)]), strict=True)
                grams, at = np.concatenate(grams), np.concatenate(at)
                order = np.argsort(at, kind="stable")
                grams, at = grams[order], at[order].tolist()
                i = 0
                while i < len(at):  # neighbours share their words
                    j = i
                    while j + 1 < len(at) and at[j + 1] - at[j] <= reach and at[j + 1] - at[i] <= 4 * reach:
                        j += 1
                    first = max(0, at[i] - reach)
                    places, run = np.array(at[i : j + 1]), grams[i : j + 1]
                    held, low = np.unique(run, return_index=True)
                    high = len(places) - 1 - np.unique(run[::-1], return_index=True)[1]
                    rows.append((doc_id, key, first, hashes[first : at[j] + max(map(abs, kinds)) + 1 + reach].tobytes(), held.view(np.int64).tolist(), places[low].tolist(), places[high].tolist()))
                    i = j + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return found


def align(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int, int, int, int]:
    """Smith-Waterman: (score, start and end in a, start and end in b) of the best local alignment of two word sequences.

    A row of the table at a time: gaps along the row are a running maximum, as each costs the same. Of equal scores, the
    alignment that ends first in a, then in b, counts.
    """
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), np.int32)
    slope = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        row[1:] = np.maximum(0, np.maximum(table[i - 1, :-1] + np.where(b == a[i - 1], match, miss), table[i - 1, 1:] + gap))
        table[i] = np.maximum.accumulate(row - slope) + slope
    best = int(table.max(initial=0))
    if best == 0:
        return 0, 0, 0, 0, 0
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    end = int(i), int(j)
    while table[i, j] > 0:
        if table[i, j] == table[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else miss):
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return best, int(i), end[0], int(j), end[1]


def aligner(k: int, least: float):
    def aligned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = rows_as(ALIGNED)
        for batch in batches:
            rows, known = [], {}
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "_row", "item_id", "first", "low", "high", "around", "words")]
            for doc_id, key, item, first, low, high, around, words in zip(*columns, strict=True):
                reach = span(len(words) // 8, least)  # the item's own; the run's is the longest item's
                cut = max(0, low - reach - first)
                first, around = first + cut, around[8 * cut : 8 * (high + k + 1 + reach - first)]
                if (found := known.get((around, words))) is None:
                    a, b = np.frombuffer(words, np.uint64), np.frombuffer(around, np.uint64)
                    reached = 2 * int(np.isin(a, b).sum()) >= least * 2 * len(a)  # else no alignment can
                    found = known[around, words] = (*(align(a, b) if reached else (0, 0, 0, 0, 0)), len(a))
                best, item_start, item_end, start, end, size = found
                if best >= least * 2 * size:
                    rows.append((doc_id, key, item, best / (2 * size), item_end - item_start, first + start, first + end, item_start, item_end))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return aligned


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 4, least: float = 0.5, item_words: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and test item that the document holds a copy or an edited copy of.

    Returns doc_id, _row, item_id, score (Smith-Waterman, as a share of the item's own; ``least`` at least), matched (the item's
    words spanned), doc_start and doc_end, item_start and item_end (in words). Words are lowered, punctuation parts them.

    Texts and items without words (null, empty) match nothing. An item of up to k words is a seed as a whole: it is found
    where all its words stand one after the other, not where a part of them does. Items longer than ``item_words`` are
    compared in pieces of so many words, which overlap by half. Of a pair's alignments the best stays, of equal ones
    the first. Repeated rows and items give rows each; null ids stay null. Other columns are not read. Empty tables give none.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("_row"))
    items = settle(texts(benchmark, "item_id", "text").mapInArrow(item_pieces(item_words), "doc_id long, body binary").mapInArrow(item_grams(k), GRAMS).withColumn("piece", F.xxhash64("words")))
    cells = spark.sparkContext.broadcast((bitmap(items, "gram", BITS), bitmap(items.withColumn("low", F.shiftleft("gram", LOW)), "low", BITS)))
    seeds, pieces, named = items.select("piece", "gram").distinct(), items.select("piece", "words").distinct(), items.select("item_id", "piece").distinct()
    longest = (items.agg(F.max(F.length("words"))).first()[0] or 0) // 8  # item_words at most
    kinds = sorted({kind_of(r[0] // 8, k) for r in items.select(F.length("words")).distinct().collect()}) or [k]  # of item_words lengths at most
    hits = settle(rows.mapInArrow(seed_finder(kinds, cells, span(longest, least)), HITS))
    # a pair is a candidate once, however many seeds it shares; then the words of both come to it
    shared = hits.select("_row", "first", F.explode(F.arrays_zip("grams", "lows", "highs")).alias("g")).select("_row", "first", F.col("g.grams").alias("gram"), F.col("g.lows").alias("low"), F.col("g.highs").alias("high"))
    pairs = shared.join(seeds, "gram").groupBy("_row", "first", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = pairs.join(pieces, "piece").join(named, "piece").join(hits.drop("grams", "lows", "highs"), ["_row", "first"])
    found = pairs.mapInArrow(aligner(k, least), ALIGNED)
    best = F.max_by(F.struct("doc_id", "score", "matched", "doc_start", "doc_end", "item_start", "item_end"), F.struct("score", -F.col("doc_start"), -F.col("item_start")))
    return found.groupBy("_row", "item_id").agg(best.alias("b")).select("b.doc_id", "_row", "item_id", *(f"b.{c}" for c in ("score", "matched", "doc_start", "doc_end", "item_start", "item_end")))


def item_pieces(size: int):
    """Items of more than ``size`` words as pieces of so many, which overlap by half."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, bodies = [], []
            for item, body in zip(batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                words = body.as_py().split()
                for at in range(0, max(1, len(words) - size // 2), size // 2) if len(words) > size else [0]:
                    ids.append(item)
                    bodies.append(b" ".join(words[at : at + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], schema=rows_as("doc_id long, body binary"))

    return pieces
