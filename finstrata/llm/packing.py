"""Hierarchical multi-length packing (operator 3).

Documents are tokenised and cut at the longest window. What is left of each is routed to the tier (context size) that
is the smallest power of two to hold it. Tiers are packed from the longest down: a window starts with the longest piece
of its own tier, takes the longest pieces that still fit, from its own and then from shorter tiers, and what gap is left is
filled by cutting a shorter piece. So every window is exactly full. The tail of a task, too small for a window, becomes
sequences whose lengths are powers of two. Sequences are dealt to step groups of equal token counts.

All of it happens inside the task that reads the documents, a pool of pieces at a time: nothing is shuffled, a long
document or a hot source costs its own tokens only, and a lost executor's task starts again with the same result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame

from finstrata.llm.common import quiet_tokenizers, rows_as, texts

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class WordIds(dict):
    """Token ids of a white-space-separated chunk of text as little-endian 32-bit bytes, encoded when first asked for.

    The tokenizer drops white space and splits letters from other characters, so ids of a text are those of its chunks,
    and those of ``word,`` are those of ``word`` and ``,``. At ``most`` entries it starts afresh, which bounds memory.
    Special tokens are found in a text as it is, all else in lower case; so chunks that may hold one keep their case.
    """

    def __init__(self, path: str, most: int = 700_000):
        import re

        from tokenizers import Tokenizer

        quiet_tokenizers()
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = sorted({t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.model = self.tokenizer.model  # a run of a-z is one pre-token, which normalising leaves as it is
        self.most, self.letters, self.parts = most, re.compile(rb"[a-z]+").fullmatch, re.compile(rb"([a-z]+)([.,!?;:%&#*$|]+)").fullmatch

    def chunks(self, body: bytes) -> list[bytes]:
        if any(m in body for m in self.marks):
            return [c if any(m in c for m in self.marks) else c.lower() for c in body.split()]
        return body.lower().split()

    def __missing__(self, word: bytes) -> bytes:
        import numpy as np

        if m := self.parts(word):
            ids = self[m[1]] + self[m[2]]
        elif self.letters(word):
            ids = np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids


class Pool:
    """Pieces (length, serial, doc_id, start, ids, doc_tokens), each in the tier of its length; lists are sorted by length."""

    def __init__(self, window: int, shortest: int):
        self.tiers = [window >> k for k in range(window.bit_length()) if window >> k >= shortest]
        self.lists: dict[int, list] = {t: [] for t in self.tiers}
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.serial = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        n = len(ids) // 4
        tier = max(self.tiers[-1], 1 << (n - 1).bit_length())
        self.serial += 1
        self.tokens[tier] += n
        insort(self.lists[tier], (n, self.serial, doc_id, start, ids, doc_tokens))

    def take(self, tier: int, at: int):
        piece = self.lists[tier].pop(at)
        self.tokens[tier] -= piece[0]
        return piece

    def fitting(self, tier: int, room: int):
        """The longest piece of this tier that fits, or None."""
        at = bisect_right(self.lists[tier], (room, float("inf")))
        return self.take(tier, at - 1) if at else None

    def fill(self, window: int):
        """Full windows of this size, as lists of pieces, for as long as this tier has pieces and they and shorter ones suffice."""
        below = [t for t in self.tiers if t <= window]
        while self.lists[window] and sum(self.tokens[t] for t in below) >= window:
            inside = [self.take(window, -1)]
            room = window - inside[0][0]
            while room:
                piece = next((p for t in below if (p := self.fitting(t, room))), None)
                if piece is None:  # all are longer than the gap: the shortest is cut
                    _, _, doc_id, start, ids, total = self.take(next(t for t in reversed(below) if self.lists[t]), 0)
                    piece = (room, 0, doc_id, start, ids[: 4 * room], total)
                    self.add(doc_id, start + room, ids[4 * room :], total)
                inside.append(piece)
                room -= piece[0]
            yield inside

    def rest(self):
        """What no tier can fill any more: sequences whose lengths are powers of two, the longest first."""
        pieces = [p for t in reversed(self.tiers) for p in self.lists[t]]  # the longest last
        total = sum(self.tokens.values())
        while total:
            room = min(self.tiers[0], 1 << (total.bit_length() - 1))
            total -= room
            inside = []
            while room:
                n, _, doc_id, start, ids, all_ = pieces.pop()
                if n > room:
                    pieces.append((n - room, 0, doc_id, start + room, ids[4 * room :], all_))
                    n, ids = room, ids[: 4 * room]
                inside.append((n, 0, doc_id, start, ids, all_))
                room -= n
            yield inside


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, shortest: int = 512, end_id: int = 1, group_tokens: int = 65_536, pool_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents into sequences of at most ``window`` tokens; one row for each piece.

    doc_id, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens (with
    the end id), sequence_id, offset in the sequence, tier (the sequence's length, a power of two, so none is padded),
    step_group (sequences of one training step; groups of a pool hold about ``group_tokens`` tokens each; a pool is a task's, so
    groups are balanced within it).

    Null or empty texts give the end id alone. Rows with a null or repeated id are packed like any other. Other columns are
    not read. An empty table gives no rows. A text of any length is cut as often as needed. Pieces of equal length are taken
    latest first.
    """
    if window & (window - 1) or shortest & (shortest - 1) or not 0 < shortest <= window:
        raise ValueError("window and shortest must be powers of two")
    schema = rows_as(SCHEMA)

    def packed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, end, pool, held = WordIds(tokenizer), np.array([end_id], "<u4").tobytes(), Pool(window, shortest), 0
        first = sequence = group = TaskContext.get().partitionId() << 33
        wholes: list[list] = []

        def out(sequences: list[list]):
            nonlocal sequence, group
            sequences.sort(key=lambda s: -sum(p[0] for p in s))
            lengths = [sum(p[0] for p in s) for s in sequences]
            groups = max(1, round(sum(lengths) / group_tokens))
            load, rows = [(0, g) for g in range(groups)], []
            import heapq

            for inside, n in zip(sequences, lengths, strict=True):
                tokens, g = heapq.heappop(load)
                heapq.heappush(load, (tokens + n, g))
                at = 0
                for k, _, doc_id, start, ids, total in inside:
                    rows.append((doc_id, start, k, ids, total, sequence, at, n, group + g))
                    at += k
                sequence += 1
            group += groups
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(words.__getitem__, words.chunks(body.as_py()))) + end
                total = len(ids) // 4
                cut = total - total % window
                for at in range(0, cut, window):
                    wholes.append([(window, 0, doc_id, at, ids[4 * at : 4 * (at + window)], total)])
                if cut < total:
                    pool.add(doc_id, cut, ids[4 * cut :], total)
                held += total
                if held >= pool_tokens:
                    full = wholes + [s for t in pool.tiers for s in pool.fill(t)]
                    wholes, held = [], 0
                    if full:
                        yield out(full)
        full = wholes + [s for t in pool.tiers for s in pool.fill(t)] + list(pool.rest())
        if full:
            yield out(full)

    return texts(docs, id_col, text_col).mapInArrow(packed, SCHEMA)
