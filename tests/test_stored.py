"""Tables that change in whole steps: against sets of rows, with failing writers, replays and limits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstrata.sources import stored as S
from finstrata.streaming import jobs


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, v long")


def held(spark, path):
    found = S.read(spark, path)
    return sorted(map(tuple, found.select("id", "v").collect())) if found is not None else []


def test_filters_let_all_their_keys_pass_and_few_others():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(-(2**63), 2**63 - 1, n) for n in (5000, 20_000))
    bits = S.filter_of(keys)
    assert S.may_hold(bits, keys).all() and S.may_hold(bits, others).mean() < 0.03
    assert not S.may_hold(S.filter_of(keys[:0]), others).any()


def test_inserts_and_upserts_against_a_dict(spark, tmp_path):
    rng, path, want = random.Random(2), str(tmp_path / "t"), {}
    assert S.read(spark, path) is None and S.rows_in(spark, path) == 0
    for turn in range(6):
        ids = [f"k{rng.randrange(60)}" for _ in range(25)]
        rows = {i: turn * 100 + n for n, i in enumerate(ids)}
        batch = frame(spark, list(rows.items()))
        if turn % 2:
            assert S.upsert(batch, path, ["id"]) >= len(rows)
            want |= rows
        else:
            fresh = {i: v for i, v in rows.items() if i not in want}
            assert S.insert_if_absent(batch, path) == len(fresh)
            assert S.insert_if_absent(batch, path) == 0
            want |= fresh
        assert held(spark, path) == sorted(want.items()) and S.rows_in(spark, path) == len(want)
    again = frame(spark, [("new", 1), ("new", 1), (None, 2)])
    assert S.insert_if_absent(again, path) == 2
    assert S.overwrite(frame(spark, [("a", 1)]), path, ["id"]) == 1 and held(spark, path) == [("a", 1)]
    assert S.append(frame(spark, [("a", 1)]), path, ["id"]) == 1 and held(spark, path) == [("a", 1), ("a", 1)]


def test_small_batches_read_only_files_that_may_hold_their_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(8):
        S.append(frame(spark, [(f"k{n}_{i}", i) for i in range(400)]).coalesce(1), path, ["id"])
    files = S.listed(spark, path)
    assert files.count() == 8
    one = S.candidates(frame(spark, [("k3_7", 0), ("k3_9", 0)]), files, ["id"])
    assert 1 <= len(one) <= 2 and {"k3_7", "k3_9"} <= {r.id for r in S.read(spark, path, one).collect()}
    assert len(S.candidates(frame(spark, [("nowhere", 0)]), files, ["id"])) <= 1
    before = {r.file for r in files.collect()}
    assert S.upsert(frame(spark, [("k3_7", -1)]), path, ["id"]) < 1200
    assert len(before & {r.file for r in S.listed(spark, path).collect()}) >= 6


@pytest.mark.parametrize("write", [S.append, S.overwrite, S.upsert, lambda rows, path, keys: S.insert_if_absent(rows, path)])
def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path, write):
    path = str(tmp_path / "t")
    S.append(frame(spark, [("a", 1), ("b", 2)]), path, ["id"])
    bad = frame(spark, [(f"x{i}", i) for i in range(50)]).withColumn("v", F.when(F.col("v") == 37, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        write(bad, path, ["id"])
    assert held(spark, path) == [("a", 1), ("b", 2)]
    assert S.insert_if_absent(frame(spark, [("b", 9), ("c", 3)]), path) == 1
    assert held(spark, path) == [("a", 1), ("b", 2), ("c", 3)]


def test_a_failed_switch_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    S.append(frame(spark, [("a", 1)]), path, ["id"])
    monkeypatch.setattr(S, "version", lambda spark, path: 0)  # as a writer that hasn't seen the first list
    with pytest.raises(RuntimeError, match="another writer"):
        S.overwrite(frame(spark, [("z", 1)]), path, ["id"])
    monkeypatch.undo()
    assert held(spark, path) == [("a", 1)]


def test_a_stream_ends_at_its_limit_also_after_a_restart(spark, tmp_path):
    landing, path = tmp_path / "in", str(tmp_path / "t")
    landing.mkdir()
    write = lambda n, first: (landing / f"{n}.json").write_text("\n".join(f'{{"id": "{i}", "text": "Tesla shares surge {i}", "source": "news", "published_at": "2026-01-02"}}' for i in range(first, first + 8)))
    run = lambda most: jobs.import_stream(spark, str(landing), "id string, text string, source string, published_at string", path, str(tmp_path / "cp"), ["TSLA"], "2026-01-01T00:00:00", files_per_batch=1, most=most).awaitTermination(120)
    for n in range(3):
        write(n, 8 * n)
    run(11)
    assert S.rows_in(spark, path) == 11
    write(3, 100)
    run(11)
    assert S.rows_in(spark, path) == 11 == S.read(spark, path).select("id").distinct().count()
    run(14)
    assert 11 <= S.rows_in(spark, path) <= 14
