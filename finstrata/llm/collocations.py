"""Phrase collocation mining with vertical positional inverted lists (operator 11).

A phrase has a list of the places where it starts, and its length is the phrase's frequency. The lists of phrases of one more
word are made by merging: a phrase's places, moved on by its length, meet the places of words, and its list falls apart into one
for each word that follows. Only frequent phrases are extended, and only where what is left without their first word is
frequent too, as no others can be frequent.

Texts are cut into blocks as tasks read them, at the ends of pieces, so that no phrase crosses two blocks; a block keeps the places
of its words, as numbers of its own. A level takes two steps. Each block sends the lengths of its new lists, one number for each
different phrase, to bins by the phrases' hashes; a bin adds them up, and tells each block which of its phrases are frequent, and
the block drops all other lists. A phrase is known by its beginning's name and its last word's name, and gets a name of its own
from its bin: names are exact, hashes only choose bins. In the end the first block that holds a phrase, and so all of its parts,
knows all numbers that its score takes. No list leaves its block; phrases do, as often as there are blocks that hold them, sorted
and by place, which compresses well. There are so many bins that one holds a bounded part of all places.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.llm.common import Blocks, rows_as, settle, utf8
from finstrata.llm.exchange import as_table, by_place, from_places
from finstrata.llm.lm_scoring import mixed

#: A block's rows. Level 0: the places of its words (a). -1, by language: its words' lengths (a), bytes (b) and counts (c). 1 and
#: more, by bin: which of the phrases that it sent are frequent (a), their names (b) and frequencies (c), and which it is the first to hold (d).
ROWS = "block long, level int, bin int, lang string, n long, a binary, b binary, c binary, d binary"
#: What a block sends to a bin: its lists' first and last names (level 1: the words' lengths and bytes, by language), and their lengths.
SENT = "bin int, block long, lang string, first binary, last binary, n binary"
SCORED = "lang string, phrase string, level int, id long, a long, l long, r long, score long, part_levels array<int>, part_ids array<long>"
BIN = 40  # bits of a name within its bin
FULL = 2_000_000  # of the score

#: A-Z become lower case, tabs spaces, and all ends of pieces line feeds.
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def numbered(text: bytes) -> tuple[Any, np.ndarray]:
    """The different words of a lowered text, and the number of the word at each place; between pieces there is a -1."""
    import pyarrow as pa

    letters = np.frombuffer(text, np.uint8)
    inner = (letters != 32) & (letters != 10)
    edges = np.flatnonzero(np.diff(inner, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inner])]).dictionary_encode()
    piece = np.cumsum(letters == 10)[starts]
    at = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    places = np.full(at[-1] + 2 if len(at) else 0, -1, np.int32)
    places[at] = words.indices.to_numpy()
    return words.dictionary, places


def as_bytes(words: Any) -> tuple[np.ndarray, bytes]:
    """The lengths and bytes of an Arrow array of words."""
    import pyarrow as pa

    words = pa.concat_arrays([words])  # from its own beginning
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32)
    letters = words.buffers()[2]
    return np.diff(offsets).astype(np.uint32), letters.to_pybytes()[offsets[0] : offsets[-1]] if letters else b""


def as_words(lengths: Any, letters: Any) -> Any:
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(from_places(lengths, np.uint32))]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters.as_py())])


def binned(first: np.ndarray, last: np.ndarray, bins: int) -> np.ndarray:
    """A bin for each pair of names."""
    return (mixed(mixed(first.astype(np.uint64)) + last.astype(np.uint64)) % np.uint64(bins)).astype(np.int64)


def binned_words(words: Any, bins: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.uint32, len(words)).astype(np.int64) % bins


class Cutter:
    """Gathers a task's texts by language, and cuts blocks of about ``size`` bytes."""

    def __init__(self, task: int, size: int):
        self.block, self.size, self.held, self.texts = task << 12, size, 0, {}

    def add(self, lang: str, text: bytes) -> Iterator[Any]:
        """Blocks that became full; long texts are cut at the ends of pieces."""
        text, start = text.translate(LOWERED), 0
        while start < len(text):
            end = len(text)
            if self.held + end - start > self.size:
                cut = text.rfind(b"\n", start, start + self.size - self.held)
                cut = text.find(b"\n", start) if cut < 0 and not self.held else cut  # a piece longer than a block
                end = end if cut < 0 and not self.held else cut + 1
            if end > start:
                self.texts.setdefault(lang, []).append(text[start:end])
                self.held += end - start
                start = end
            if self.held >= self.size or start < len(text):
                yield self.cut()

    def cut(self) -> Any:
        """The rows of ROWS of what was gathered; words are numbered by language."""
        rows, places, first = [], [], 0
        for lang, texts in sorted(self.texts.items()):
            found, at = numbered(b"\n".join(texts))
            counts = np.bincount(at[at >= 0], minlength=len(found))
            places.append(np.where(at >= 0, at + first, -1).astype(np.int32))
            lengths, letters = as_bytes(found)
            rows.append((self.block, -1, None, lang, int(counts.sum()), by_place(lengths), letters, by_place(counts.astype(np.uint32)), None))
            first += len(found)
        rows.append((self.block, 0, None, None, first, np.concatenate([*places, np.full(1, -1, np.int32)]).tobytes(), None, None, None))
        self.block, self.held, self.texts = self.block + 1, 0, {}
        return as_table(rows, ROWS)


def cutter(size: int):
    def blocks(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        cut = Cutter(TaskContext.get().partitionId(), size)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("body"), strict=True):
                for rows in cut.add(lang.as_py(), text.as_py()):
                    yield from rows.to_batches()
        if cut.held:
            yield from cut.cut().to_batches()

    return blocks


class Lists:
    """The inverted lists of one level in a block: phrase i starts at places[bounds[i]:bounds[i + 1]], in rising order."""

    def __init__(self, first: np.ndarray, last: np.ndarray, places: np.ndarray, bounds: np.ndarray):
        self.first, self.last, self.places, self.bounds = first, last, places, bounds
        self.ids = self.f = self.own = np.zeros(0, np.int64)

    def frequent(self, taken: np.ndarray, ids: np.ndarray, f: np.ndarray, own: np.ndarray) -> Lists:
        """The lists of the phrases that are taken, with names and frequencies; all others are dropped."""
        lengths = np.diff(self.bounds)
        kept = Lists(self.first[taken], self.last[taken], self.places[np.repeat(taken, lengths)], np.concatenate([[0], np.cumsum(lengths[taken])]))
        kept.ids, kept.f, kept.own = ids[taken], f[taken], own[taken]
        return kept

    def at(self, size: int) -> np.ndarray:
        """The number of the phrase that starts at each place, or -1."""
        out = np.full(size, -1, np.int64)
        out[self.places] = np.repeat(np.arange(len(self.first)), np.diff(self.bounds))
        return out


def fallen(first: np.ndarray, last: np.ndarray, places: np.ndarray, n_last: int) -> Lists:
    """Lists by (first, last); within a list places keep their order."""
    key = first * n_last + last
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return Lists(key[starts] // max(1, n_last), key[starts] % max(1, n_last), places[order], np.concatenate([starts, [len(key)]]))


def dealt(bins_of: np.ndarray, *keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bin, positions): what goes to each bin, in the order of the keys."""
    order = np.lexsort((*keys[::-1], bins_of))
    sorted_ = bins_of[order]
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return ((int(sorted_[lo]), order[lo:hi]) for lo, hi in itertools.pairwise([*starts, len(order)]))


def summed(least: int):
    def totals(key: tuple, held: Any) -> Any:
        """A bin's phrases, added up; for each block which of its are frequent, under what names, and which it is the first to hold."""
        of_bin, rows, named = key[0].as_py(), [], 0
        langs, blocks = np.array(held.column("lang").to_pylist(), object), held.column("block").to_numpy()
        for lang in sorted(set(langs), key=str):
            at = np.flatnonzero(langs == lang)
            at = at[np.argsort(blocks[at])]
            if lang is None:  # names of beginnings and of words
                first, last = (np.concatenate([rising(held.column(c)[i]) if c == "first" else from_places(held.column(c)[i], np.uint64) for i in at]) for c in ("first", "last"))
                order = np.lexsort((last, first))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)
                number = np.empty(len(order), np.int64)
                number[order] = np.cumsum(new) - 1
            else:
                import pyarrow as pa

                number = pa.chunked_array([as_words(held.column("first")[i], held.column("last")[i]) for i in at]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            n = np.concatenate([from_places(held.column("n")[i], np.uint32) for i in at]).astype(np.int64)
            f = np.bincount(number, n).astype(np.int64)
            frequent = f >= least
            ids = (of_bin << BIN) + named + np.cumsum(frequent) - 1
            named += int(frequent.sum())
            holder = np.zeros(len(number), bool)
            holder[np.unique(number, return_index=True)[1]] = True  # blocks rise
            start = 0
            for i in at:
                size = len(from_places(held.column("n")[i], np.uint32))
                mine = number[start : start + size]
                taken = frequent[mine]
                if taken.any():
                    rows.append((int(blocks[i]), None, of_bin, lang, size, np.packbits(taken).tobytes(), by_place(ids[mine][taken]), by_place(f[mine][taken]), np.packbits(holder[start : start + size][taken]).tobytes()))
                start += size
        return as_table(rows, ROWS)

    return totals


def rising(data: Any) -> np.ndarray:
    return np.cumsum(from_places(data, np.uint64), dtype=np.uint64)


class Block:
    """A block's lists of all levels that are settled, from its rows."""

    def __init__(self, rows: Any, levels: int, bins: int):
        self.rows = {n: rows.column(n) for n in rows.column_names}
        self.levels, self.bins = np.asarray(rows.column("level").to_numpy()), bins
        words = np.frombuffer(self.rows["a"][int(np.flatnonzero(self.levels == 0)[0])].as_py(), np.int32).astype(np.int64)
        self.size = len(words)
        self.vocabulary = sorted((self.rows["lang"][int(i)].as_py(), int(i)) for i in np.flatnonzero(self.levels == -1))
        self.words = [as_words(self.rows["a"][i], self.rows["b"][i]) for _, i in self.vocabulary]
        at = np.flatnonzero(words >= 0)
        self.lists = [fallen(np.zeros(len(at), np.int64), words[at], at, sum(map(len, self.words)))]
        self.ats: list[np.ndarray] = []
        if levels:
            self.settle(1)
        for level in range(2, levels + 1):
            self.lists.append(self.extended())
            self.settle(level)

    def sent(self) -> Iterator[tuple[tuple[int, str | None], np.ndarray]]:
        """((bin, language), positions in the last lists), in the order in which they are sent."""
        if len(self.lists) == 1:
            first = 0
            for (lang, _), words in zip(self.vocabulary, self.words, strict=True):
                yield from (((b, lang), at + first) for b, at in dealt(binned_words(words, self.bins), np.arange(len(words))))
                first += len(words)
        else:
            first, last = self.names()
            yield from (((b, None), at) for b, at in dealt(binned(first, last, self.bins), first, last))

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        lists, below = self.lists[-1], self.lists[-2]
        return below.ids[lists.first], self.lists[0].ids[lists.last]

    def settle(self, level: int) -> None:
        """Keeps of the last lists those that the bins say are frequent."""
        lists = self.lists[-1]
        taken, own = np.zeros(len(lists.first), bool), np.zeros(len(lists.first), bool)
        ids, f = (np.zeros(len(lists.first), np.int64) for _ in "if")
        answers = {(self.rows["bin"][int(i)].as_py(), self.rows["lang"][int(i)].as_py()): int(i) for i in np.flatnonzero(self.levels == level)}
        for key, at in self.sent():
            if (i := answers.get(key)) is not None:
                mine = at[bits(self.rows["a"][i], len(at))]
                taken[mine] = True
                ids[mine], f[mine] = from_places(self.rows["b"][i], np.int64), from_places(self.rows["c"][i], np.int64)
                own[mine] = bits(self.rows["d"][i], len(mine))
        self.lists[-1] = lists.frequent(taken, ids, f, own)
        if level == 1:
            self.kept = np.flatnonzero(taken)
        self.ats.append(self.lists[-1].at(self.size))

    def extended(self) -> Lists:
        """The longest lists, merged with those of the words that follow."""
        longest, level = self.lists[-1], len(self.lists)
        phrase = np.repeat(np.arange(len(longest.first)), np.diff(longest.bounds))
        on = np.minimum(longest.places + level, self.size - 1)  # a block ends with a -1
        word = self.ats[0][on]
        goes_on = (word >= 0) & (self.ats[-1][longest.places + 1] >= 0)
        return fallen(phrase[goes_on], word[goes_on], longest.places[goes_on], len(self.lists[0].first))


def bits(data: Any, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data.as_py(), np.uint8), count=count).astype(bool)


def sender(level: int, bins: int):
    def lengths(key: tuple, rows: Any) -> Any:
        """The lengths of a block's lists of one level, for the bins."""
        block, of = Block(rows, level - 1, bins), key[0].as_py()
        if level > 1:
            block.lists.append(block.extended())
            first, last = block.names()
        n, out = np.diff(block.lists[-1].bounds).astype(np.uint32), []
        for (b, lang), at in block.sent():
            if level == 1:
                start = next(s for s, (of_lang, _) in zip(np.cumsum([0, *map(len, block.words)]), block.vocabulary, strict=False) if of_lang == lang)
                mine = as_bytes(block.words[[x for x, _ in block.vocabulary].index(lang)].take(at - start))
                out.append((b, of, lang, by_place(mine[0]), mine[1], by_place(n[at])))
            else:
                out.append((b, of, None, by_place(np.diff(first[at], prepend=0).astype(np.uint64)), by_place(last[at].astype(np.uint64)), by_place(n[at])))
        return as_table(out, SENT)

    return lengths


def scores(a: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """(score, l, r) of the lowest-scoring cut, ties to the first. Exact: Python's integers where 64 bits might not do."""
    a = a.astype(object) if a.max(initial=0) >= 2**41 else a
    out: list[np.ndarray] = []
    for left, right in cuts:
        score = (FULL * a // (left.astype(a.dtype) + right)).astype(np.int64)
        better = score < out[0] if out else np.ones(len(score), bool)
        out = [np.where(better, new, old) for new, old in zip((score, left, right), out or (score, left, right), strict=True)]
    return out


def scorer(longest: int, bins: int):
    def scored(key: tuple, rows: Any) -> Any:
        """The frequent phrases of which this block is the first, with their scores and the names of their parts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        block = Block(rows, longest, bins)
        number_of_lang = np.repeat(np.arange(len(block.words)), [len(w) for w in block.words])[block.kept]
        langs = pa.array([lang for lang, _ in block.vocabulary], pa.string())
        words = pa.concat_arrays([*block.words, pa.array([], pa.binary())]).take(pa.array(block.kept)).cast(pa.string())
        tables, kinds = [], rows_as(SCORED)
        for level in range(2, longest + 1):
            lists = block.lists[level - 1]
            mine = np.flatnonzero(lists.own)
            at, a = lists.places[lists.bounds[:-1][mine]], lists.f[mine]
            part = lambda start, n, at=at: block.ats[n - 1][at + start]
            f = lambda start, n, part=part: block.lists[n - 1].f[part(start, n)]
            score, left, right = scores(a, [(f(0, k), f(k, level - k)) for k in range(1, level)])
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(part(i, 1))) for i in range(level)), " ")
            parts = [(n, start) for n in range(2, level) for start in range(level - n + 1)]
            ids = np.array([block.lists[n - 1].ids[part(start, n)] for n, start in parts], np.int64).reshape(len(parts), len(mine)).T
            nested = lambda flat, kind, n=len(mine), w=len(parts): pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(flat, kind))
            plain = [np.full(len(mine), level), lists.ids[mine], a, left, right, score]
            columns = [langs.take(pa.array(number_of_lang[part(0, 1)])), phrase, *(pa.array(c, kinds[i + 2].type) for i, c in enumerate(plain))]
            columns += [nested(np.tile([n for n, _ in parts], len(mine)), pa.int32()), nested(ids.ravel(), pa.int64())]
            tables.append(pa.Table.from_arrays(columns, schema=kinds))
        return pa.concat_tables(tables)

    return scored


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000, size: int = 8 << 20, places_in_bin: int = 4 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z lowered, fall into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. Everything counts by
    language; a null one is ``und``. A phrase's frequency a is the number of all places within pieces where it stands, overlaps
    included; n is the number of all words. A cut after the first words gives l and r, the frequencies of both parts, and the score
    floor(2,000,000 a / (l + r)); the lowest-scoring cut counts, ties to the first. Phrases with a >= ``least`` are candidates, but
    those that stand within a longer candidate (dropped or not) of at least ``percent`` % of their frequency are dropped. Of each
    language the ``top`` first come back, by score and a, largest first, and phrase, in the order of UTF-8 bytes.

    A null text is an empty one, and gives no words; repeated rows count each. Texts of any length are cut at the ends of pieces.
    Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), utf8(text_col).alias("body"))
    with Blocks(spark) as kept:
        rows = kept.add(texts.mapInArrow(cutter(size), ROWS))
        sizes = settle(rows.filter("level = -1").groupBy("lang").agg(F.sum("n").alias("n")))
        bins = max(kept.buckets, -(-int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // places_in_bin))
        for level in range(1, longest + 1):
            lengths = spark.table(kept.name).groupBy("block").applyInArrow(sender(level, bins), SENT)
            answers = lengths.groupBy("bin").applyInArrow(summed(least), ROWS)
            kept.add_dealt(answers.withColumn("level", F.lit(level)))
        found = settle(spark.table(kept.name).groupBy("block").applyInArrow(scorer(longest, bins), SCORED))
    parts = found.select("a", F.explode(F.arrays_zip("part_levels", "part_ids")).alias("p"))
    longer = parts.groupBy(F.col("p.part_levels").alias("level"), F.col("p.part_ids").alias("id")).agg(F.max("a").alias("most"))
    whole = found.join(longer, ["level", "id"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = whole.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
