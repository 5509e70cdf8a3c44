"""How blocks of documents and bins of hashes exchange sorted hashes with counts.

A block sends its distinct hashes to bins, which are ranges of hashes; a bin adds up what all blocks sent, and answers
each block with the totals of the hashes that other blocks hold too. A hash costs a block one entry, however often the
block holds it. Arrays travel as bytes by place, which compress well where numbers are sorted or small. An answer holds no
hashes: it is a bit for each hash in the order in which they were sent, and the totals; a block makes its hashes again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np

from finstrata.llm.common import rows_as

SENT = "bin int, block long, n int, grams binary, counts binary"
ANSWERS = "bin int, block long, n int, shared binary, counts binary, words long, tokens long"


def by_place(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_places(data: Any, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data.as_py(), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def as_table(rows: list[tuple], schema: str):
    import pyarrow as pa

    kind = rows_as(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)


def ranges(hashes: np.ndarray, bins: int) -> Iterator[tuple[int, int, int]]:
    """(bin, first, end) of the sorted hashes; bins that get none are left out."""
    edges = (np.arange(1, bins, dtype=np.float64) * (2.0**64 / bins)).astype(np.uint64)
    bounds = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
    return ((b, lo, hi) for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if lo < hi)


def sent(block: int, n: int, hashes: np.ndarray, counts: np.ndarray, bins: int) -> list[tuple]:
    """Rows of SENT for a block's distinct, sorted hashes of kind ``n``."""
    return [(b, block, n, by_place(hashes[lo:hi]), by_place(counts[lo:hi].astype(np.uint32))) for b, lo, hi in ranges(hashes, bins)]


def totals(key: tuple, held: Any) -> Any:
    """A bin's hashes of one kind, added up: for each block, those that other blocks hold too; and (block -1) how many there are in all."""
    n = key[1].as_py()
    own = [from_places(x, np.uint64) for x in held.column("grams")]
    sizes = [len(g) for g in own]
    distinct, inverse = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.concatenate([from_places(x, np.uint32) for x in held.column("counts")])
    total = np.bincount(inverse, counts, len(distinct)).astype(np.uint64)
    shared = np.bincount(inverse, minlength=len(distinct)) > 1
    rows, first = [(key[0].as_py(), -1, n, None, None, int((total > 0).sum()), int(total.sum()))], 0
    for of, size in zip(held.column("block").to_pylist(), sizes, strict=True):
        at = inverse[first : first + size]
        if (take := shared[at]).any():
            rows.append((key[0].as_py(), of, n, np.packbits(take).tobytes(), by_place(total[at][take]), 0, 0))
        first += size
    return as_table(rows, ANSWERS)


def settle_totals(hashes: np.ndarray, counts: np.ndarray, answers: Any, n: int, bins: int) -> np.ndarray:
    """Makes totals of a block's own counts; which of its hashes, those that it sent as kind ``n``, other blocks hold too."""
    shared = np.zeros(len(hashes), bool)
    rows = {b: i for i, (b, kind) in enumerate(zip(answers.column("bin").to_pylist(), answers.column("n").to_pylist(), strict=True)) if kind == n}
    for b, lo, hi in ranges(hashes, bins):
        if (i := rows.get(b)) is not None:
            mine = np.unpackbits(np.frombuffer(answers.column("shared")[i].as_py(), np.uint8), count=hi - lo).astype(bool)
            shared[lo:hi] = mine
            counts[lo:hi][mine] = from_places(answers.column("counts")[i], np.uint64)
    return shared
