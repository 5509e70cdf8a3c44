"""N-gram Jaccard join by MinHash banding (operator 9).

Texts are sets of word five-grams; documents are linked where the sets' Jaccard similarity is 0.8 or more. Documents with
equal sets are one class of copies, and one of them stands for it. Bands of the representatives' MinHash signatures are
shuffled; where a bucket holds more than one, its pairs are verified on the full sets. The number of bands and rows follows
from the recall asked for at the threshold.

Large groups: copies collapse before anything is compared. A bucket with the members of an earlier one is left out. A
bucket's members are dealt to chunks, and each pair of chunks is verified by a task of its own, as a product of incidence
matrices; it returns a row per member (its links, its component there), never a row per pair. A pair that shares
several bands is counted in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.common import rows_as, settle, texts
from finstrata.llm.components import components
from finstrata.llm.shingles import WordHashes, mixed, shingles

SIGNED = "key long, doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"
SETS = "rep long, bands array<long>, shingles binary"
FOUND = "rep long, n_links long, least long"


def banding(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which at most ``hashes`` hashes find a pair at the threshold with that chance."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def word_hashes(body: bytes, words: WordHashes) -> np.ndarray:
    """Words: runs of letters, digits and other non-ASCII characters, lowered; punctuation doesn't count."""
    return words.of(body.lower().translate(SPACED).split())


SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def print_terms(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of a set's elements; their sums over the set, and its size, are equal for equal sets."""
    return mixed(values + np.uint64(1)), mixed(values ^ np.uint64(0x5555555555555555))


def signer(bands: int, rows: int, k: int):
    random = np.random.default_rng(20)
    factors = random.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = random.integers(0, 2**63, bands * rows, np.uint64)

    def signed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema, words = rows_as(SIGNED), WordHashes()

        def out(keys: list, ids: list, sets: list[np.ndarray]):
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            n = len(ids)
            signature, prints = np.zeros((n, bands, rows), np.uint64), np.zeros((2, n), np.uint64)
            if len(full):
                values, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for i in range(bands * rows):
                    signature[full, i // rows, i % rows] = np.minimum.reduceat(values * factors[i] + offsets[i], starts)
                prints[:, full] = [np.add.reduceat(x, starts) for x in print_terms(values)]
            band = np.zeros((n, bands), np.uint64)
            for j in range(rows):
                band = mixed(band * np.uint64(31) + signature[:, :, j] + np.arange(bands, dtype=np.uint64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), flat], schema=schema)

        for batch in batches:
            keys, ids, sets, held = [], [], [], 0
            for key, doc_id, body in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                keys.append(key)
                ids.append(doc_id)
                sets.append(shingles(word_hashes(body.as_py(), words), k))
                held += len(sets[-1])
                if held > 200_000:
                    yield out(keys, ids, sets)
                    keys, ids, sets, held = [], [], [], 0
            if keys:
                yield out(keys, ids, sets)

    return signed


def set_maker(k: int):
    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema, words = rows_as(SETS), WordHashes()
        for batch in batches:
            sets = pa.array([shingles(word_hashes(b.as_py(), words), k).tobytes() for b in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("bands"), sets], schema=schema)

    return made


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Shared elements of each of the first ``split`` sets with each set, as a product of incidence matrices in slices."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    width = max(1, 4_000_000 // len(sets))
    total = np.zeros((split, len(sets)), np.float32)
    for first in range(0, len(values), width):
        lo, hi = np.searchsorted(at, [first, first + width])
        inside = np.zeros((len(sets), min(width, len(values) - first)), np.float32)
        inside[row[lo:hi], at[lo:hi] - first] = 1
        total += inside[:split] @ inside.T
    return total


def verifier(threshold: float):
    def verified(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        """The links between two chunks of a bucket, or within one: for each member, how many, and its component's least."""
        _, i, j, band = key
        members = members.sort_values(["chunk", "rep"], kind="stable") if i <= j else members
        sets = [np.frombuffer(s, np.uint64) for s in members["shingles"]]
        reps, mult, chunk = members["rep"].to_numpy(), members["copies"].to_numpy(), members["chunk"].to_numpy()
        split = int((chunk == i).sum())
        shared = overlaps(sets, split)
        sizes = np.array([len(s) for s in sets], np.float32)
        linked = shared >= threshold * (sizes[:split, None] + sizes[None, :] - shared) - 1e-4
        bands = np.stack([np.asarray(b[:band], np.int64) for b in members["bands"]]) if band else np.zeros((len(sets), 0), np.int64)
        for b in range(band):  # seen in an earlier band
            linked &= bands[:split, None, b] != bands[None, :, b]
        n = len(sets)
        both = np.zeros((n, n), bool)
        both[:split] = linked
        if i == j:
            np.fill_diagonal(both, False)
        else:
            both[:split, :split] = False
            both |= both.T
        label = np.arange(n)
        while True:  # components within this pair of chunks
            near = np.where(both, label[None, :], n).min(axis=1, initial=n)
            new = np.minimum(label, near)
            new = new[new]
            if (new == label).all():
                break
            label = new
        links = both @ mult
        has = links > 0
        return pd.DataFrame({"rep": reps[has], "n_links": links[has], "least": reps[label][has]})

    return verified


def near_join(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9995, hashes: int = 100, chunk: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id, copy_id, n_shingles, n_links, and row_key (a hash of id and text).

    n_links is the number of other documents whose k-word shingle sets have a Jaccard similarity of ``threshold`` or more,
    copies among them. copy_id is the smallest doc_id with the same set, class_id the smallest doc_id that links lead to. Pairs
    are verified on the full sets; a pair at the threshold is found with a chance of ``recall`` at least.

    Words are lowered, and punctuation parts them. A text of fewer than k words is one shingle; one without words (null,
    empty) has no links, and is a class of its own. Rows with the same id and text count once; different texts of one id, and
    of rows without an id, are documents of their own. class_id and copy_id are null where no document of the class
    has an id. Other columns are not read. An empty table gives no rows.
    """
    bands, rows = banding(threshold, recall, hashes)
    body = texts(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "body"))
    signed = body.mapInArrow(signer(bands, rows, k), SIGNED)
    signed = settle(signed.dropDuplicates(["key"]))
    sets = ["fp1", "fp2", "n_shingles"]
    classes = settle(signed.filter("n_shingles > 0").groupBy(*sets).agg(F.min("key").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    # buckets with more than one member; of those with the same members, the first
    buckets = (
        classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
        .groupBy("band", "bucket")
        .agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("z"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep") % 1_000_003).alias("y"))
        .filter("n > 1")
        .groupBy("n", "a", "z", "x", "y")
        .agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select("b.band", "b.bucket", "n")
    )
    members = settle(
        classes.select("rep", "copies", F.posexplode("bands").alias("band", "bucket")).join(buckets, ["band", "bucket"]).withColumn("chunks", F.ceil(F.col("n") / chunk))
    )
    needed = members.select("rep").distinct().join(classes.select("rep", "bands"), "rep")
    full = body.join(needed, body.key == needed.rep).select("rep", "bands", "body").mapInArrow(set_maker(k), SETS)
    full = full.dropDuplicates(["rep"])
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    pairs = F.expr("transform(sequence(0, chunks - 1), c -> struct(least(c, chunk) as i, greatest(c, chunk) as j))")
    work = members.withColumn("chunk", mine).select("rep", "copies", "band", "bucket", "chunk", F.explode(pairs).alias("p")).join(full, "rep")
    found = work.select("rep", "copies", "chunk", "bands", "shingles", "bucket", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "band")
    found = settle(found.groupBy("bucket", "i", "j", "band").applyInPandas(verifier(threshold), FOUND))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    near = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    linked = settle(classes.select("rep", "low").join(near, F.col("rep") == F.col("node")).select("rep", "low", "component"))
    lowest = linked.groupBy("component").agg(F.min("low").alias("lowest"))
    linked = linked.join(lowest, "component").select("rep", F.col("lowest").alias("class"), F.lit(True).alias("linked"))
    known = classes.join(links, "rep", "left").join(linked, "rep", "left")
    known = known.select(*sets, "low", F.when(F.col("linked"), F.col("class")).otherwise(F.col("low")).alias("class"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    alone = F.col("n_shingles") == 0
    return signed.join(known, sets, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("low")).alias("copy_id"),
        "n_shingles", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("key").alias("row_key"),
    )
