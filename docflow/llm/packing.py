"""Packing of tokenised documents into sequences of one length, best fit decreasing.

Each task tokenises its documents and cuts overlong ones into full windows. The remainders of a bounded
pool of documents are placed in order of falling length: a segment tree over the possible remaining
capacities finds the tightest open sequence in a few steps. Sequences that still have a wide gap at the end of
a pool are levelled: the emptiest ones are taken apart and their pieces, cut where needed, fill the gaps of
the fullest; what is left over becomes sequences of power-of-two length, which need no padding.
Nothing is shuffled, and a task holds one pool at a time, so memory doesn't grow with the input.

Defined results
    null or empty text   the separator token alone
    very long text       is tokenised whole, white space run by white space run, in order
    null doc_id          is packed like any other, with a null id
    repeated rows        are packed one by one
    empty table          no rows
    other columns        are not read
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
SEPARATOR = 0
#: Documents whose remainders are packed together at most.
POOL = 16_384
#: A gap of more than this share of a sequence is levelled.
GAP = 1 / 64
#: Texts of more words than this hand their tokens on in parts.
_WORDS_AT_ONCE = 50_000
#: Runs whose ids a task remembers, and as many of the time before; some 200 bytes each.
REMEMBERED = 800_000

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)
# White space of Unicode. A byte-level pre-tokeniser never joins other text with white space after it,
# so runs that begin with white space can be encoded one by one.
_W = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")


class _Runs(dict):
    """Little-endian 32-bit ids of each run seen lately; runs of the generation before are kept once more."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self._most = most
        self._encode = Tokenizer.from_file(path).encode
        self._before: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self._most:
            self._before = dict(self)
            self.clear()
        found = self._before.get(run)
        if found is None:
            found = np.asarray(self._encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(run) < 64:
            self[run] = found
        return found


_tokenisers: dict[tuple[str, int], _Runs] = {}


def token_bytes(text: str, path: str, remembered: int = REMEMBERED) -> bytes:
    """The ids of a text as little-endian 32-bit numbers."""
    runs = _tokenisers.get((path, remembered))
    if runs is None:
        runs = _tokenisers[path, remembered] = _Runs(path, remembered)
    found = iter(_RUN.finditer(text)) if len(text) > 1_000_000 else None
    if found is None:
        return b"".join(map(runs.__getitem__, _RUN.findall(text)))
    parts = []
    while part := [m.group() for m in islice(found, _WORDS_AT_ONCE)]:
        parts.append(b"".join(map(runs.__getitem__, part)))
    return b"".join(parts)


class _Capacities:
    """Segment tree over remaining capacities 0..size: which of them some open sequence has."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.full = [False] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = capacity + self.width
        while at and not self.full[at]:
            self.full[at] = True
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return a sequence of the smallest capacity that holds ``least``."""
        at = least + self.width
        if not self.full[at]:
            while at > 1 and (at & 1 or not self.full[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.full[2 * at] else 2 * at + 1
        capacity = at - self.width
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            while at and not (at < self.width and (self.full[2 * at] or self.full[2 * at + 1])):
                self.full[at] = False
                at >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Items of each sequence; every item is at most ``size`` long."""
    tree, sequences = _Capacities(size), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        if found := tree.take(n):
            capacity, sequence = found
            sequences[sequence].append(item)
        else:
            capacity, sequence = size, len(sequences)
            sequences.append([item])
        if capacity > n:
            tree.add(capacity - n, sequence)
    return sequences


Piece = tuple[int, int, int]  # item, start in it, length


def level(sequences: list[list[Piece]], size: int, gap: int) -> list[list[Piece]]:
    """Fill gaps wider than ``gap`` from the emptiest sequences; the last one is cut at powers of two."""
    loads = [sum(p[2] for p in s) for s in sequences]
    done = [s for s, n in zip(sequences, loads, strict=True) if size - n <= gap]
    loose = sorted(((n, i) for i, n in enumerate(loads) if size - n > gap))
    low, high = 0, len(loose) - 1
    spare: list[Piece] = []
    while low <= high or spare:
        if low > high:  # what no gap took: full sequences, then powers of two
            left = sum(p[2] for p in spare)
            room = size if left >= size else 1 << (left.bit_length() - 1)
            if left < size and size - left <= gap:
                room = left
            target: list[Piece] = []
        else:
            load, i = loose[high]
            high -= 1
            target, room = list(sequences[i]), size - load
            while low <= high and sum(p[2] for p in spare) < room:
                spare.extend(sequences[loose[low][1]])
                low += 1
            if sum(p[2] for p in spare) < room:
                spare.extend(target)
                continue
        while room:
            item, start, n = spare.pop()
            used = min(n, room)
            target.append((item, start, used))
            room -= used
            if used < n:
                spare.append((item, start + used, n - used))
        done.append(target)
    return done


def pack(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, separator: int = SEPARATOR, pool: int = POOL,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (32-bit, little-endian).

    ``remembered`` bounds the memory that reused Python workers keep, at the price of encoding more runs again.
    """
    end = np.asarray([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        start: list[int] = []
        total: list[int] = []
        tail: list[bytes] = []
        out: list[tuple] = []

        def row(doc, at, content, whole, place, offset):
            out.append((doc, at, len(content) // 4, zlib.crc32(content), whole, place, offset, content))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])
            out.clear()
            return batch

        def pack_pool() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            lengths = np.asarray([len(t) // 4 for t in tail], dtype=np.int64)
            packed = [[(i, 0, int(lengths[i])) for i in s] for s in best_fit_decreasing(lengths, size)]
            for pieces in level(packed, size, int(size * GAP)):
                offset = 0
                for item, at, n in pieces:
                    row(ids[item], start[item] + at, tail[item][4 * at : 4 * (at + n)], total[item], sequence, offset)
                    offset += n
                sequence += 1
                if len(out) >= 4096:
                    yield flush()
            for rows in (ids, start, total, tail):
                rows.clear()
            yield flush()

        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                content = (token_bytes(text, tokenizer, remembered) if text else b"") + end
                whole = len(content) // 4
                for k in range(whole // size):
                    row(doc, k * size, content[4 * k * size : 4 * (k + 1) * size], whole, sequence, 0)
                    sequence += 1
                    if len(out) >= 4096:
                        yield flush()
                if whole % size:
                    ids.append(doc)
                    start.append(whole - whole % size)
                    total.append(whole)
                    tail.append(content[4 * (whole - whole % size) :])
                    if len(tail) >= pool:
                        yield from pack_pool()
        yield from pack_pool()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
