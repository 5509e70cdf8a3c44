"""Language-model scoring with a weighted backoff automaton (operator 2).

The model is an n-gram model with Dirichlet smoothing over all n-grams of the training texts, rare ones included:

    P(w | h) = (c(hw) + k P(w | h')) / (c(h) + k),    h': h without its first word,    P(w) = (c(w) + 1) / (N + V + 1)

As an automaton: the states are the contexts that training holds; a state has an arc for each word that followed it, weighted
with the probability above, and a failure arc to the state of h', weighted with k / (c(h) + k). A text is scored in one
traversal from left to right that carries the state and adds up the weights.

The whole model fits nowhere, so each block of texts (some MB) gets the part that its texts can reach:

* Blocks hash their texts' n-grams and send the distinct ones, with their training counts, to bins by hash. A bin adds up the
  counts, and answers each block with the totals of those n-grams that other blocks hold too; others' totals are the block's own.
* Words and pairs go in one pass. An n-gram of three words or more is sent only if other blocks hold both n-grams of one
  word less within it: otherwise no other block can hold it.
* A last pass builds each block's automaton and walks its texts.

What is sent is sorted hashes, as bytes by place, which compress: some 6 bytes an n-gram. Hashes of words have 64
bits, those of longer n-grams 56: n-grams with equal hashes count as one. Nothing is cut, and nothing grows on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import Blocks, block, rows_as, texts
from finstrata.llm.exchange import ANSWERS, SENT, as_table, sent, settle_totals, totals
from finstrata.llm.shingles import MIX, WordHashes, mixed

#: The token after a text's last word; no word is empty.
END = b""
SCORES = "doc_id long, trains boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Level:
    """The n-grams of one order in a block: the distinct ones, sorted, their counts, and for each place which it holds (-1: none)."""

    grams: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    shared: np.ndarray | None = None  # which of them other blocks hold too

    def settle(self, n: int, answers: Any, bins: int, sent: np.ndarray | None = None) -> None:
        """Own counts become totals. sent: at which places the n-grams stand that were sent; all, if not given."""
        if sent is None:
            self.shared = settle_totals(self.grams, self.counts, answers, n, bins)
            return
        which = np.zeros(len(self.grams), bool)
        which[self.at[sent & (self.at >= 0)]] = True
        counts = self.counts[which]
        self.shared = np.zeros(len(self.grams), bool)
        self.shared[which] = settle_totals(self.grams[which], counts, answers, n, bins)
        self.counts[which] = counts

    def both(self) -> np.ndarray:
        """Places where two n-grams end, at the place and before it, which other blocks hold too."""
        held = self.of(self.shared, False)
        held[1:] &= held[:-1]
        return held

    def of(self, values: np.ndarray, none: Any) -> np.ndarray:
        """By place."""
        return np.where(self.at >= 0, values[self.at], none) if len(values) else np.full(len(self.at), none)


class BlockTexts:
    """A block's texts one after the other, as hashes of their tokens; texts that train come first."""

    def __init__(self, docs: Any, words: WordHashes):
        trains = docs.column("trains").to_numpy()
        self.order = np.argsort(~trains, kind="stable")
        bodies, parts = docs.column("body"), []
        for i in self.order.tolist():
            tokens = bodies[i].as_py().lower().split()
            tokens.append(END)
            parts.append(words.of(tokens))
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.tokens = np.concatenate(parts)
        self.trained = int(self.lengths[: int(trains.sum())].sum())
        #: How many tokens of its text stand before each token.
        self.before = (np.arange(len(self.tokens)) - np.repeat(self.ends - self.lengths, self.lengths)).astype(np.int32)

    def grams(self, n: int, where: np.ndarray | None = None) -> Level:
        """The n-grams by their last token's place; only those ``where`` says, if given."""
        here = self.before >= n - 1
        if where is not None:
            here &= where
        last = np.flatnonzero(here)
        code = self.tokens[last - (n - 1)]
        for i in range(n - 2, -1, -1):
            code = code * MIX + self.tokens[last - i]
        if n > 1:
            code = mixed(code + np.uint64(n)) & np.uint64(2**64 - 256)
        code, inverse = np.unique(code, return_inverse=True)
        at = np.full(len(self.tokens), -1, np.int32)
        at[last] = inverse
        return Level(code, np.bincount(inverse[: np.searchsorted(last, self.trained)], minlength=len(code)), at)


def counter(bins: int, order: int):
    def counted(key: tuple, docs: Any) -> Any:
        """The words and pairs of a block."""
        texts_, rows = BlockTexts(docs, WordHashes()), []
        for n in range(1, min(order, 2) + 1):
            level = texts_.grams(n)
            rows += sent(key[0].as_py(), n, level.grams, level.counts, bins)
        return as_table(rows, SENT)

    return counted


def levels(texts_: BlockTexts, answers: Any, order: int, bins: int) -> list[Level]:
    """The block's n-grams by order, with their totals; from 3 on, only n-grams that another block may hold were sent."""
    out: list[Level] = []
    for n in range(1, order + 1):
        level = texts_.grams(n)
        level.settle(n, answers, bins, out[-1].both() if n > 2 else None)
        out.append(level)
    return out


def sender(n: int, bins: int):
    def found(key: tuple, docs: Any, answers: Any) -> Any:
        """The n-grams of a block whose both n-grams of one word less are held by other blocks."""
        if not len(docs) or not len(answers):
            return as_table([], SENT)
        texts_ = BlockTexts(docs, WordHashes())
        if n > 3:
            below = levels(texts_, answers, n - 1, bins)[-1]
        else:
            below = texts_.grams(2)
            below.settle(2, answers, bins)
        level = texts_.grams(n, below.both())
        return as_table(sent(key[0].as_py(), n, level.grams, level.counts, bins), SENT)

    return found


def log_probabilities(orders: list[Level], strength: tuple[float, ...], n_tokens: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: training count, log10 of the add-one unigram, log10 of what the walk adds.

    The state that a token is read in is that of the longest of the words before it that training holds. All tokens walk at
    once, from the longest contexts down: those whose state has the arc take it; the others take the failure arc.
    """
    count = orders[0].of(orders[0].counts, 0)
    base = (count + 1) / (n_tokens + n_words + 1)
    chance, arcs, fails = base, [], []
    for lower, level, k in zip(orders, orders[1:], strength, strict=False):
        context = np.concatenate([[0], lower.of(lower.counts, 0)[:-1]])  # the state's own count
        context[level.at < 0] = 0
        own = level.of(level.counts, 0)
        chance = np.where(context > 0, (own + k * chance) / (context + k), chance)
        arcs.append(np.where((context > 0) & (own > 0), chance, 0))
        fails.append(np.where(context > 0, k / (context + k), 1.0))
    walked, above = np.zeros(len(base)), np.ones(len(base), bool)
    for arc, fail in zip(reversed(arcs), reversed(fails), strict=True):
        taken = above & (arc > 0)
        walked[taken] += np.log10(arc[taken])
        above &= ~taken
        walked[above] += np.log10(fail[above])
    base = np.log10(base)
    walked[above] += base[above]
    return count, base, walked


def scorer(order: int, strength: tuple[float, ...], n_tokens: int, n_words: int, bins: int):
    def scored(key: tuple, docs: Any, answers: Any) -> Any:
        if not len(docs):
            return as_table([], SCORES)
        texts_ = BlockTexts(docs, WordHashes())
        count, base, walked = log_probabilities(levels(texts_, answers, order, bins), strength, n_tokens, n_words)
        first = texts_.ends - texts_.lengths
        known, base, walked = (np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), base, walked))
        taken = docs.take(texts_.order)
        import pyarrow as pa

        return pa.Table.from_arrays([taken.column("doc_id"), taken.column("trains"), pa.array(texts_.lengths), pa.array(known), pa.array(base), pa.array(walked)], schema=rows_as(SCORES))

    return scored


def lm_scores(docs: DataFrame, trains: Column, order: int = 3, strength: tuple[float, ...] = (500.0, 5.0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows of which ``trains`` holds, and scores every row's whole text.

    Tokens are words parted by ASCII white space, A-Z lowered, then one end. Returns doc_id, trains, n_tokens, n_known (tokens
    that training has), train_tokens, base_score (log10 with add-one unigrams) and score (log10 probability under the model).
    ``strength`` has the k of contexts of one word, of two, and so on, for each order up to ``order``.

    A null text is an empty one: its end is its only token. Where ``trains`` is null, a row trains. Repeated rows are scored
    each by itself; null ids stay null. Without training tokens all scores are 0. Other columns are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col, F.coalesce(trains, F.lit(True)).alias("trains"), F.monotonically_increasing_id().alias("_row"))
    with Blocks(spark) as texts_, Blocks(spark) as kept:
        rows = texts_.add(rows.withColumn("block", block(8)).drop("_row"))
        in_bins = lambda df: kept.add_dealt(df.groupBy("bin", "n").applyInArrow(totals, ANSWERS))
        together = lambda f, schema: rows.groupBy("block").cogroup(answers.select("block", "bin", "n", "shared", "counts").filter("block >= 0").groupBy("block")).applyInArrow(f, schema)
        answers = in_bins(rows.groupBy("block").applyInArrow(counter(kept.buckets, order), SENT))
        n_words, n_tokens = answers.filter("block = -1 and n = 1").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        for n in range(3, order + 1):
            answers = in_bins(together(sender(n, kept.buckets), SENT))
        scores = together(scorer(order, strength, n_tokens, n_words, kept.buckets), SCORES)
    return scores.select("doc_id", "trains", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
