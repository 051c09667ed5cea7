"""Benchmark decontamination: short test items found inside documents of any length.

An item is in a document when at least ``threshold`` of the item's distinct word shingles are among the
document's. Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased (A-Z).

The search is a MinHash containment search partitioned by size. An item of q shingles can lack at most
``q - ceil(threshold * q)`` of them, so among that many plus one of its shingles with the least hashes at least
one is in every document that holds the item. Items are partitioned by q, each partition with its own sketch
length, and a document's shingles are looked up in the sketches; a long document needs no sketch of its own, and no
link is lost. Every candidate is verified by the exact count of shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep
from .textkit import ALPHANUMERIC, distinct_by_doc, shingle_hashes, slices, word_hashes

HITS = "doc_id long, item_id long, n_shared int, n_item int, containment double"


def item_shingles(items: DataFrame, words: int) -> DataFrame:
    """item_id, the distinct shingle hashes of its text ascending; items without a word are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in slices(batch.column(1)):
                h, d = distinct_by_doc(*shingle_hashes(*word_hashes(raw, off, ALPHANUMERIC), j - i, words))
                for k in np.unique(d):
                    own = pa.array([h[d == k].astype(np.int64).tolist()], type=pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + int(k), 1), own], ["item_id", "shingles"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "item_id long, shingles array<long>")


def _index(block: list, threshold: Fraction):
    """Sorted sketch hashes with their items, and all shingles of the items with theirs."""
    sketch, owner, full, full_owner = [], [], [], []
    for k, row in enumerate(block):
        own = np.array(row["shingles"], dtype=np.int64).astype(np.uint64)  # ascending as unsigned
        q = len(own)
        own = np.sort(own)
        need = -(-threshold.numerator * q // threshold.denominator)
        n = q - need + 1
        sketch.append(own[:n])
        owner.append(np.full(n, k))
        full.append(own)
        full_owner.append(np.full(q, k))
    sketch, owner, full, full_owner = map(np.concatenate, (sketch, owner, full, full_owner))
    a, b = np.argsort(sketch, kind="stable"), np.argsort(full, kind="stable")
    return sketch[a], owner[a], full[b], full_owner[b]


def _matches(table: np.ndarray, owner: np.ndarray, h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, owner) for every pair of equal hashes."""
    lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
    n = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    return np.repeat(d, n), owner[at]


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = 5, block_shingles: int = 500_000) -> DataFrame:
    """One row for each (document, item) with a containment of at least ``threshold``.

    Returns doc_id, item_id, n_shared, n_item (distinct shingles of the item) and containment. Items are handled in
    blocks of at most ``block_shingles`` shingles, each compared with all documents, so what is sent to the tasks
    is bounded however many items there are. Null or wordless texts and items match nothing; items or documents of
    fewer words than a shingle count as one shingle; repeated rows of one id give repeated rows; equal items all match;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    share = Fraction(str(threshold))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(block: list, alone: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast((_index(block, share), np.array([r["item_id"] for r in block]), np.array([len(r["shingles"]) for r in block])))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (sketch, owner, full, full_owner), item_id, q = sent.value
            need = np.array([-(-share.numerator * n // share.denominator) for n in q.tolist()])
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[(sketch >> np.uint64(44)).astype(np.int64)] = True
            for batch in batches:
                out: list[tuple[np.ndarray, ...]] = []
                for i, j, raw, off in slices(batch.column(1)):
                    h, d = shingle_hashes(*word_hashes(raw, off, ALPHANUMERIC), j - i, words)
                    near = maybe[(h >> np.uint64(44)).astype(np.int64)]
                    cand_d, cand_k = _matches(sketch, owner, h[near], d[near])
                    if not len(cand_d):
                        continue
                    pairs = np.unique(cand_d * len(q) + cand_k)
                    some = np.isin(d, pairs // len(q))
                    h, d = distinct_by_doc(h[some], d[some])
                    got_d, got_k = _matches(full, full_owner, h, d)
                    pair, shared = np.unique(got_d * len(q) + got_k, return_counts=True)
                    ok = np.isin(pair, pairs) & (shared >= need[pair % len(q)])
                    pair, shared = pair[ok], shared[ok]
                    out.append((pair // len(q) + i, pair % len(q), shared))
                if out:
                    row, k, shared = (np.concatenate(x) for x in zip(*out))
                    cols = [batch.column(0).take(pa.array(row)), pa.array(item_id[k]), pa.array(shared.astype(np.int32)), pa.array(q[k].astype(np.int32)), pa.array(shared / q[k])]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        hits = texts.mapInArrow(rows, HITS)
        if not alone:
            hits = keep(hits, "hits")
            sent.destroy()
        return hits

    def blocks() -> Iterator[list]:
        block, size = [], 0
        for row in item_shingles(items, words).toLocalIterator():
            if block and size + len(row["shingles"]) > block_shingles:
                yield block
                block, size = [], 0
            block.append(row)
            size += len(row["shingles"])
        if block:
            yield block

    parts, block = [], None
    for more in blocks():
        if block is not None:  # one of several: written out, so that one block at a time is held
            parts.append(search(block, alone=False))
        block = more
    if block is None:
        return spark.createDataFrame([], HITS)
    last = search(block, alone=not parts)
    return reduce(DataFrame.unionByName, [*parts, last])


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` without the documents that hold an item; columns and all other rows stay as they are."""
    hits = find_items(docs, items, threshold, words).select(F.col("doc_id").alias("hit_id_")).distinct()
    return docs.join(hits, docs["doc_id"].cast("long") == hits["hit_id_"], "left_anti")
