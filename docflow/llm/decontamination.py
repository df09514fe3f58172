"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are dealt by size into classes [2**k, 2**(k+1)) of distinct five-word shingles. A document is cut into blocks
of consecutive shingles, about twice as long as the largest item of the class and overlapping by half, so that an item is
never small against the block that holds it. An item and a block that share one of ``PERMUTATIONS`` minimum
hashes are candidates; a candidate document is verified with all of its shingles. An item held to 0.8 by a block
has a Jaccard of at least 0.15 with it, so it is missed with a chance below 3e-5; scattered parts of an
item meet in several blocks.

Items are compared in blocks of ``ITEMS`` against all documents, one pass each; documents are never shuffled.

Defined results
    null or empty text, either side   never matches
    fewer than five words             the whole sequence is the one shingle
    very long text                    is read whole
    null id                           a match has a null id
    repeated rows                     each document row gives its own matches; items that repeat id and text count once
    empty tables                      no matches
    other columns                     are not read (``drop_leaks`` hands those of documents on)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.arrays import byte_rows, mix, shingle_hashes, shingle_set, word_hashes

CONTAINMENT = 0.8
PERMUTATIONS = 64
#: Items held by a task at a time.
ITEMS = 20_000
_BITS = 18
_PART = 1 << 18  # shingles whose minima are computed at a time; a longer text is cut with an overlap

_rng = np.random.default_rng(97)
_FACTORS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the runs of hashes that start at ``cuts``: permutations x runs.

    The permutations act on the high half of a hash; what that confuses is sorted out by the verification.
    """
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((PERMUTATIONS, len(cuts)), dtype=np.uint32)
    for k, factor in enumerate(_FACTORS):
        np.minimum.reduceat(high * factor, cuts, out=out[k])
    return out


@dataclass
class SizeClass:
    block: int  # shingles of half a block: above the size of every item of the class
    key: np.ndarray  # sorted (permutation, minimum) hashes
    item: np.ndarray  # item of each key
    present: np.ndarray  # quick filter by the low bits of a key


def _keys(low: np.ndarray) -> np.ndarray:
    return mix(low.astype(np.uint64) + (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32))[:, None])


def size_classes(sets: list[np.ndarray]) -> list[SizeClass]:
    """The classes in order of size; each block is twice the one before or a larger power of two of it."""
    order = np.array([len(s).bit_length() for s in sets])
    classes = []
    for k in np.unique(order[order > 0]).tolist():
        items = np.flatnonzero(order == k)
        joined = np.concatenate([sets[i] for i in items])
        lengths = np.array([len(sets[i]) for i in items])
        key = _keys(minima(joined, np.cumsum(lengths) - lengths))
        item = np.broadcast_to(items, key.shape).ravel()
        key = key.ravel()
        by = np.argsort(key, kind="stable")
        present = np.zeros(1 << _BITS, dtype=bool)
        present[(key & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        classes.append(SizeClass(1 << k, key[by], item[by], present))
    return classes


def _cuts(lengths: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of sequences that lie one after the other, and the sequence of each block."""
    n = -(-lengths // block)
    owner = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[owner] + block * within, owner


def _search(pieces: list[np.ndarray], classes: list[SizeClass]) -> tuple[np.ndarray, np.ndarray]:
    """Piece and item of all pairs that share a minimum. The minima of small blocks give those of larger ones."""
    lengths = np.array([len(p) for p in pieces])
    low, block = None, 0
    found = []
    for c in classes:
        if low is None:
            cuts, owner = _cuts(lengths, c.block)
            low = minima(np.concatenate(pieces), cuts)
        else:
            cuts, owner = _cuts(-(-lengths // block), c.block // block)
            low = np.minimum.reduceat(low, cuts, axis=1)
        block = c.block
        follows = np.r_[owner[1:] == owner[:-1], False]
        at = np.arange(len(owner))
        key = _keys(np.minimum(low, low[:, np.where(follows, at + 1, at)]))
        hit = c.present[(key & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
        _, run = np.nonzero(hit)
        key = key[hit]
        a, b = np.searchsorted(c.key, key, "left"), np.searchsorted(c.key, key, "right")
        some = a < b
        n = (b - a)[some]
        item = c.item[np.repeat(a[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        found.append(np.stack([np.repeat(owner[run[some]], n), item], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def contained(texts: Iterator[np.ndarray], sets: list[np.ndarray], classes: list[SizeClass], least: float) -> list[tuple[int, int, int]]:
    """Text, item and shared shingles for each item that a text holds to ``least``; texts are looked at in groups."""
    if not classes:
        return []
    overlap = 2 * classes[-1].block
    out, group, size = [], [], 0

    def verify() -> None:
        owners, pieces = [], []
        for k, (_, shingles) in enumerate(group):
            for start in range(0, max(len(shingles) - overlap, 1), _PART):
                owners.append(k)
                pieces.append(shingles[start : start + _PART + overlap])
        piece, item = _search(pieces, classes)
        pairs = np.unique(np.stack([np.array(owners)[piece], item], axis=1), axis=0)
        for k, i in pairs.tolist():
            number, shingles = group[k]
            shared = int(np.isin(sets[i], shingles).sum())
            if shared >= least * len(sets[i]) - 1e-9:
                out.append((number, i, shared))

    for number, data in enumerate(texts):
        shingles = shingle_hashes(word_hashes(data, lower=True))
        if not len(shingles):
            continue
        group.append((number, shingles))
        size += len(shingles)
        if size >= _PART:
            verify()
            group, size = [], 0
    if group:
        verify()
    return out


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets of the items, ``ITEMS`` or so at a time, in a fixed deal by hash."""
    rows = items.select(F.col("item_id"), "text").where(F.length("text") > 0).distinct()
    n = max(1, -(-rows.count() // ITEMS))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        block = rows.where(deal == k).orderBy("item_id", "text").toArrow()
        sets = [shingle_set(t) for c in block.column("text").chunks for t in byte_rows(c)]
        ids = block.column("item_id").to_pylist()
        yield [i for i, s in zip(ids, sets, strict=True) if len(s)], [s for s in sets if len(s)]


def find_leaks(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` for every document that holds an item to ``least`` or more."""
    schema = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = items.withColumn("item_id", F.col("item_id").cast("bigint"))

    def search(ids: list, sets: list[np.ndarray]) -> DataFrame:
        classes = size_classes(sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs = batch.column(0).to_pylist()
                hits = contained(byte_rows(batch.column(1)), sets, classes, least)
                rows = [(docs[k], ids[i], len(sets[i]), shared) for k, i, shared in hits]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in columns], names=["doc_id", "item_id", "n_item", "n_shared"])

        return texts.mapInArrow(run, schema)

    out = None
    for ids, sets in item_blocks(items):
        out = search(ids, sets) if out is None else out.unionByName(search(ids, sets))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item to ``least`` or more, with all their columns and no shuffle."""
    at = docs.columns.index("text")
    schema = docs.schema

    def without(left: DataFrame, sets: list[np.ndarray]) -> DataFrame:
        classes = size_classes(sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[k for k, _, _ in contained(byte_rows(batch.column(at)), sets, classes, least)]] = False
                yield batch.filter(pa.array(clean))

        return left.mapInArrow(run, schema)

    for _, sets in item_blocks(items):
        docs = without(docs, sets)
    return docs
