"""Substring dedup by prefix-partitioned suffix trees (operator 7).

A suffix starts at each word. The tree of all of them is never built: suffixes are split by their prefixes, what can't repeat
ends there, and a tree is built for each group of the rest, which fits in a task's memory.

* A suffix's prefix ends with its anchor, which is the ``prefix`` words with the smallest hash among its first ``window`` words;
  so prefixes have ``prefix`` to ``window`` words, and equal windows have equal prefixes. A prefix whose anchor stands once in all
  the corpus has a subtree that is a single leaf: its suffixes end there.
* Neighbouring suffixes mostly share an anchor. They travel as one piece of text, of under two windows, to the group of their
  anchor (a range of hashes; as anchors are the smallest of many hashes, these are mixed once more, or the first ranges would get
  nearly all). Equal pieces of a block of documents travel once, with their number.
* In a group, the pieces' suffixes are sorted, word by word, and the longest common prefixes of neighbours give the tree: an
  internal node at least ``window`` words deep is a repeat, and all its leaves are windows that stand elsewhere too. A large group
  is taken by parts of its range, each with a tree of its own, as pieces of different anchors share no window.
* An anchor that stands more than ``most`` times would make its group too large. Its suffixes are split further, by prefixes as long as
  the window: then a group is a node, known by two 64-bit hashes of its path, and travels without its words.

Blocks of documents get back, for each piece, which of its suffixes repeat, and take out the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import Blocks, block, carried, rows_as, texts
from finstrata.llm.exchange import ANSWERS, SENT, as_table, by_place, from_places, ranges, sent, settle_totals, totals
from finstrata.llm.shingles import MIX, WordHashes, long_windows, mixed

#: kind 0: pieces, in which 256th of the bin's range their anchors lie, and their texts (a line each, words parted by spaces). kind 1: windows
#: of frequent anchors, and their second hashes.
PIECES = "bin int, block long, kind int, keys binary, counts binary, parts binary, texts binary"
#: Of a piece, which suffixes repeat, as bits from its first; of windows, those that repeat.
REPEATED = "block long, kind int, keys binary, starts binary"
KEPT = "_row long, doc_id long, n_words long, n_removed long, kept binary"


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes, the position of its smallest (of equal ones, the first)."""
    n = max(0, len(grams) - span + 1)
    best = np.arange(len(grams), dtype=np.int32)
    reach = 1
    while reach < span and n:  # minima of runs of 2, 4, 8 ..., then of two that overlap
        step = min(reach, span - reach)
        a, b = best[:-step], best[step:]
        best = np.where(grams[a] <= grams[b], a, b)
        reach += step
    return best[:n]


@dataclass
class BlockPieces:
    """A block's texts one after the other, as word hashes, and the pieces of neighbouring windows with one anchor."""

    lengths: np.ndarray
    words: np.ndarray
    grams: np.ndarray  # hash of the ``prefix`` words at each place, mixed: those of anchors are even
    first: np.ndarray  # each piece's first window
    sizes: np.ndarray  # and how many it has
    anchor: np.ndarray  # and its anchor's place
    window: int

    @property
    def firsts(self) -> np.ndarray:
        """Each text's first word."""
        return np.cumsum(self.lengths) - self.lengths

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each piece, and of each window."""
        runs = long_windows(self.words, self.window)
        if not len(self.first):
            return np.zeros(0, np.uint64), runs
        return mixed(runs[self.first] * MIX + runs[self.first + self.sizes - 1] + self.sizes.astype(np.uint64)), runs

    def windows(self, pieces: np.ndarray) -> np.ndarray:
        """The windows of these pieces."""
        sizes = self.sizes[pieces]
        return np.repeat(self.first[pieces] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def block_pieces(bodies: Any, window: int, prefix: int) -> BlockPieces:
    words = WordHashes()
    parts = [words.of(b.as_py().split()) for b in bodies]
    lengths = np.array([len(p) for p in parts], np.int64)
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    grams = long_windows(hashes, prefix)
    at = anchors(grams, window - prefix + 1)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(hashes))  # words to the end of the text
    own = np.flatnonzero(left[: len(at)] >= window)  # windows that lie within a text
    at = at[own]
    new = np.ones(len(own), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)
    starts = np.flatnonzero(new)
    return BlockPieces(lengths, hashes, mixed(grams), own[starts], np.diff(np.append(starts, len(own))), at[starts], window)


def anchor_finder(window: int, prefix: int, bins: int):
    def found(key: tuple, docs: Any) -> Any:
        """A block's anchors, and how often each stands."""
        of = block_pieces(docs.column("body"), window, prefix)
        distinct, counts = np.unique(of.grams[np.unique(of.anchor)], return_counts=True)
        return as_table(sent(key[0].as_py(), 0, distinct, counts, bins), SENT)

    return found


def parts_of(hashes: np.ndarray, bin_: int, bins: int) -> np.ndarray:
    """In which 256th of a bin's range each hash lies."""
    return np.clip((hashes / 2.0**64 * bins - bin_) * 256, 0, 255).astype(np.uint8)


def piece_finder(window: int, prefix: int, bins: int, groups: int, most: int):
    def found(key: tuple, docs: Any, answers: Any) -> Any:
        """A block's pieces whose anchor stands more than once; of frequent anchors, the windows."""
        if not len(docs):
            return as_table([], PIECES)
        block_, bodies = key[0].as_py(), docs.column("body")
        of = block_pieces(bodies, window, prefix)
        hashes = of.grams[of.anchor]
        places = np.unique(of.anchor)
        distinct, counts = np.unique(of.grams[places], return_counts=True)
        settle_totals(distinct, counts, answers, 0, bins)
        often = counts[np.searchsorted(distinct, hashes)] if len(distinct) else np.zeros(0, np.int64)
        keys, runs = of.keys()
        rows = []
        if len(few := np.flatnonzero((often > 1) & (often <= most))):
            _, at, counts = np.unique(keys[few], return_index=True, return_counts=True)
            few = few[at]
            order = np.argsort(hashes[few], kind="stable")
            few, counts = few[order], counts[order]
            lines: list[bytes] = [b""] * len(few)
            doc = np.searchsorted(of.firsts, of.first[few], side="right") - 1
            by_doc, firsts, split = np.argsort(doc, kind="stable").tolist(), of.firsts.tolist(), (-1, [])
            for i in by_doc:
                if split[0] != (d := int(doc[i])):
                    split = d, bodies[d].as_py().split()
                start = int(of.first[few[i]]) - firsts[d]
                lines[i] = b" ".join(split[1][start : start + int(of.sizes[few[i]]) + window - 1])
            rows += [(b, block_, 0, by_place(keys[few[lo:hi]]), by_place(counts[lo:hi].astype(np.uint32)), parts_of(hashes[few[lo:hi]], b, groups).tobytes(), b"\n".join(lines[lo:hi])) for b, lo, hi in ranges(hashes[few], groups)]
        if len(many := np.flatnonzero(often > most)):
            starts = of.windows(many)
            node, at, counts = np.unique(runs[starts], return_index=True, return_counts=True)
            second = long_windows(mixed(of.words ^ MIX), window)[starts[at]]
            rows += [(b, block_, 1, by_place(node[lo:hi]), by_place(counts[lo:hi].astype(np.uint32)), b"", by_place(second[lo:hi])) for b, lo, hi in ranges(node, groups)]
        return as_table(rows, PIECES)

    return found


@dataclass
class SuffixTree:
    """Those suffixes of some pieces of text that have ``least`` words or more, in order; their common prefixes are the tree."""

    common: np.ndarray  # how many words each suffix shares with the one before it; 0 where it is less than ``least``
    piece: np.ndarray  # the piece that it belongs to
    offset: np.ndarray  # and its place there

    def repeated(self) -> np.ndarray:
        """The leaves that are below a deep internal node."""
        below = self.common > 0
        below[:-1] |= self.common[1:] > 0
        return below

    def deep_nodes(self) -> list[tuple[int, int, int]]:
        """(depth, first, end) of the internal nodes of ``least`` words or more: runs of suffixes that share so many words, not more."""
        out, open_ = [], []
        for i, depth in enumerate([*self.common.tolist(), 0]):
            first = i - 1
            while open_ and open_[-1][0] > depth:
                d, first = open_.pop()
                out.append((d, first, i))
            if depth and (not open_ or open_[-1][0] < depth):
                open_.append((depth, first))
        return out


def suffix_tree(pieces: list[bytes], least: int) -> SuffixTree:
    """Words are told apart by themselves, not by hashes; a suffix ends with its piece, and the end comes before any word."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number) + 1) for w in p.split(b" ")] for p in pieces]
    sizes = np.array([len(w) for w in words], np.int64)
    longest, size = int(sizes.max()), len(number) + 1
    ids = np.zeros(int(sizes.sum()) + longest, np.int64)
    ids[: sizes.sum()] = np.concatenate([np.array(w, np.int64) for w in words])
    counts = np.maximum(sizes - least + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, left = (np.cumsum(sizes) - sizes)[piece] + offset, sizes[piece] - offset
    per = max(1, int(62 // np.log2(size + 1)))  # so many words fit in a number
    columns = []
    for at in range(0, longest, per):
        column = np.zeros(len(starts), np.int64)
        for i in range(at, at + per):
            column = column * size + (np.where(i < left, ids[starts + min(i, longest)], 0) if i < longest else 0)
        columns.append(column)
    order = np.lexsort(columns[::-1])
    common, alike = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for column in columns:
        one, other = column[order[1:]], column[order[:-1]]
        for digits in range(per - 1, -1, -1):
            common[1:] += alike & (one // size**digits == other // size**digits)
        alike &= one == other
    common[1:] = np.minimum(common[1:], np.minimum(left[order[1:]], left[order[:-1]]))
    common[common < least] = 0
    return SuffixTree(common, piece[order], offset[order])


def repeats_of_pieces(held: list[tuple[int, np.ndarray, np.ndarray, list[bytes]]], window: int) -> list[tuple]:
    """held: (block, keys, counts, pieces). Rows of REPEATED."""
    number: dict[bytes, int] = {}
    of = [np.array([number.setdefault(p, len(number)) for p in pieces], np.int64) for _, _, _, pieces in held]
    times = np.bincount(np.concatenate(of), np.concatenate([counts for _, _, counts, _ in held]))
    tree = suffix_tree(list(number), window)
    repeated = tree.repeated() | (times[tree.piece] > 1)
    bits = np.zeros(len(number), np.uint64)
    np.bitwise_or.at(bits, tree.piece[repeated], np.uint64(1) << tree.offset[repeated].astype(np.uint64))
    return [(block_, 0, by_place(keys[take]), by_place(bits[mine][take])) for (block_, keys, _, _), mine in zip(held, of, strict=True) if (take := bits[mine] > 0).any()]


def repeats_of_windows(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple]:
    """held: (block, hashes, counts, second hashes). Rows of REPEATED."""
    first, second, counts = (np.concatenate([h[i] for h in held]) for i in (1, 3, 2))
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    repeated = np.split((np.bincount(node, counts) > 1)[node], np.cumsum([len(h[1]) for h in held])[:-1])
    return [(block_, 1, by_place(keys[take]), b"") for (block_, keys, _, _), take in zip(held, repeated, strict=True) if take.any()]


def by_parts(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]], at_once: int) -> Iterator[list[tuple]]:
    """held: (block, keys, counts, parts, pieces), sorted by part. Runs of parts with so many pieces together, or one part, without its number."""
    ends = np.cumsum(np.bincount(np.concatenate([h[3] for h in held]), minlength=256))
    first = 0
    while first < 256:
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        edges = [(h, *np.searchsorted(h[3], [first, end]).tolist()) for h in held]
        if chosen := [(h[0], h[1][lo:hi], h[2][lo:hi], h[4][lo:hi]) for h, lo, hi in edges if lo < hi]:
            yield chosen
        first = end


def group_repeats(window: int, at_once: int = 10_000):
    def found(key: tuple, held: Any) -> Any:
        """A group's repeats, for each block that holds some of them."""
        pieces, windows_ = [], []
        for block_, kind, keys, counts, parts, body in zip(held.column("block").to_pylist(), held.column("kind").to_pylist(), held.column("keys"), held.column("counts"), held.column("parts"), held.column("texts"), strict=True):
            own = block_, from_places(keys, np.uint64), from_places(counts, np.uint32)
            if kind:
                windows_.append((*own, from_places(body, np.uint64)))
            else:
                pieces.append((*own, np.frombuffer(parts.as_py(), np.uint8), body.as_py().split(b"\n")))
        rows = repeats_of_windows(windows_) if windows_ else []
        for part in by_parts(pieces, at_once) if pieces else []:
            rows += repeats_of_pieces(part, window)
        return as_table(rows, REPEATED)

    return found


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def repeated_windows(of: BlockPieces, found: Any) -> np.ndarray:
    """The places of the block's windows that stand elsewhere too."""
    sides: list[list[np.ndarray]] = [[], []]
    bits = [from_places(x, np.uint64) for x, kind in zip(found.column("starts"), found.column("kind").to_pylist(), strict=True) if kind == 0]
    for keys, kind in zip(found.column("keys"), found.column("kind").to_pylist(), strict=True):
        sides[kind].append(from_places(keys, np.uint64))
    keys, runs = of.keys()
    out = []
    if sides[0]:
        known, starts = np.concatenate(sides[0]), np.concatenate(bits)
        order = np.argsort(known)
        known, starts = known[order], starts[order]
        mine = np.flatnonzero(within(keys, known))
        places = of.windows(mine)
        nth = (places - np.repeat(of.first[mine], of.sizes[mine])).astype(np.uint64)
        out.append(places[(np.repeat(starts[np.searchsorted(known, keys[mine])], of.sizes[mine]) >> nth) & np.uint64(1) > 0])
    if sides[1]:
        places = of.windows(np.arange(len(of.first)))
        out.append(places[within(runs[places], np.sort(np.concatenate(sides[1])))])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def remover(window: int, prefix: int, one_space: bool):
    def removed(key: tuple, docs: Any, found: Any) -> Any:
        """A block's documents without the words that a repeated window covers."""
        import pyarrow as pa

        schema = rows_as(KEPT).append(docs.schema.field("carried"))
        if not len(docs):
            return schema.empty_table()
        bodies = docs.column("body")
        if len(found):
            of = block_pieces(bodies, window, prefix)
            at, edges, lengths = repeated_windows(of, found), np.zeros(len(of.words) + 1, np.int64), of.lengths
            np.add.at(edges, at, 1)
            np.add.at(edges, at + window, -1)
            stays = np.cumsum(edges[:-1]) == 0
        else:
            lengths = np.array([len(b.as_py().split()) for b in bodies], np.int64)
            stays = np.ones(lengths.sum(), bool)
        counted = np.concatenate([[0], np.cumsum(~stays)])
        ends = np.cumsum(lengths)
        gone = counted[ends] - counted[ends - lengths]
        kept = []
        for body, n, end, out in zip(bodies, lengths.tolist(), ends.tolist(), gone.tolist(), strict=True):
            text = body.as_py()
            if out:
                tokens = text.split()
                text = b" ".join([tokens[i] for i in np.flatnonzero(stays[end - n : end]).tolist()])
            elif one_space:
                text = b" ".join(text.split())
            kept.append(text)
        return pa.Table.from_arrays([docs.column("_row"), docs.column("doc_id"), pa.array(lengths), pa.array(gone.astype(np.int64)), pa.array(kept, pa.binary()), docs.column("carried")], schema=schema)

    return removed


def substring_dedup(docs: DataFrame, window: int = 35, prefix: int = 8, most: int = 1000, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), one_space: bool = True) -> DataFrame:
    """Removes the words covered by a window of words that also starts anywhere else; one row for each row of ``docs``.

    Returns _row (unique), doc_id, n_words, n_removed, kept (UTF-8: the words that stay, joined by one space; without
    ``one_space``, a text that loses none stays as it is), carried (the columns that ``carry`` names). Words are parted by
    ASCII white space and compared as they are. Windows lie within one document and are judged on the input;
    overlapping repeats within a document count. ``window`` is at most ``prefix`` + 63.

    A null or empty text has no words; one of fewer words than the window loses none. Repeated rows repeat each other. Null ids
    stay null. Other columns are not read. An empty table gives no rows.
    """
    if not prefix <= window <= prefix + 63:
        raise ValueError("a piece has a bit for each of its windows: 64 at most")
    along, kind = carried(docs, carry)
    rows = texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("_row"), along)
    with Blocks(docs.sparkSession) as kept:
        rows, bins = kept.add(rows.withColumn("block", block(4))), kept.buckets
        bodies = rows.select("block", "body").groupBy("block")
        seen = bodies.applyInArrow(anchor_finder(window, prefix, bins), SENT).groupBy("bin", "n").applyInArrow(totals, ANSWERS).filter("block >= 0").select("block", "bin", "n", "shared", "counts")
        pieces = bodies.cogroup(seen.groupBy("block")).applyInArrow(piece_finder(window, prefix, bins, 4 * bins, most), PIECES)  # some groups for each task
        found = pieces.groupBy("bin").applyInArrow(group_repeats(window), REPEATED)
        return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remover(window, prefix, one_space), f"{KEPT}, carried {kind}")
