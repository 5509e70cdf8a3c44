"""Operator 7: groups of anchors are even, and a large one is taken in parts."""

import numpy as np
import pyarrow as pa

from finstrata.llm.exchange import as_table, from_places
from finstrata.llm.substring_dedup import PIECES, REPEATED, block_pieces, group_repeats, piece_finder


def pieces_of(texts, groups):
    """Pieces of three blocks that hold the same texts; answers say that all anchors stand in all blocks."""
    bodies = pa.table({"body": pa.array(texts, pa.binary())})
    of = block_pieces(bodies.column("body"), 12, 4)
    n = len(np.unique(of.grams[of.anchor]))
    answers = pa.table({"bin": pa.array([0], pa.int32()), "n": pa.array([0], pa.int32()), "shared": pa.array([np.packbits(np.ones(n, bool)).tobytes()], pa.binary()), "counts": pa.array([np.full(n, 3, np.uint64).view(np.uint8).reshape(n, 8).T.tobytes()], pa.binary())})
    find = piece_finder(12, 4, 1, groups, 1000)
    return pa.concat_tables([find((pa.scalar(block),), bodies, answers) for block in range(3)])


def texts():
    rng = np.random.default_rng(5)
    return [b" ".join(b"w%d" % x for x in rng.integers(0, 5000, 400)) for _ in range(50)]


def test_groups_are_even():
    groups = 64
    held = pieces_of(texts(), groups)
    sizes = np.zeros(groups)
    for b, keys in zip(held.column("bin").to_pylist(), held.column("keys"), strict=True):
        sizes[b] += len(from_places(keys, np.uint64))
    assert sizes.sum() > 5000 and sizes.max() < 3 * sizes.mean()


def test_a_group_in_parts_has_the_same_repeats():
    held = pieces_of([*texts()[:20], b"x " * 40], 1)

    def repeats(at_once):
        found = group_repeats(12, at_once)((pa.scalar(0),), held)
        assert found.column_names == as_table([], REPEATED).column_names
        rows = list(zip(found.column("block").to_pylist(), found.column("keys"), found.column("starts"), strict=True))
        return {(b, k, s) for b, keys, starts in rows for k, s in zip(from_places(keys, np.uint64).tolist(), from_places(starts, np.uint64).tolist(), strict=True)}, len(rows)

    whole, rows = repeats(1 << 30)
    assert rows == 3 and len(whole) > 1000 and held.column_names == as_table([], PIECES).column_names
    for at_once in (1, 100):
        parts, more = repeats(at_once)
        assert parts == whole and more > 3
