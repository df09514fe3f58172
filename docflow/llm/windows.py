"""Repeated windows of tokens over a whole corpus, found level by level without shuffling every position.

A window of ``width`` tokens is dealt by its minimiser: the leftmost of its grams (runs of ``gram`` tokens)
with the smallest hash. Equal windows have equal minimisers, so a window whose minimiser occurs once in the
corpus occurs once itself. Each level counts the minimisers of the windows that are left and drops
the others; the last level compares the windows themselves within their minimiser. Only about
``2 / (width - gram + 2)`` of all positions are minimisers, and only repeated ones go on.

Hot grams: what repeats within one Arrow batch is decided there and sent on once, so a passage that a third of
all documents share gives a row per batch. Windows of a frequent minimiser are dealt by their own hash too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.arrays import _BYTE, _power_tables, byte_rows, mix
from docflow.runtime import CLEAN, forget, materialize, scratch_path, settings

#: Rows of a minimiser above which its windows are also dealt by their own hash.
FREQUENT = 50_000
#: Values that a reducing task holds before it hands on complete groups.
_HELD = 1 << 21
_SPAN = 1 << 20  # positions of one text handled at a time
_PIECE = 1 << 21  # windows of one batch that are compared at a time

#: Token values of a text, one per token.
Tokens = Callable[[np.ndarray], np.ndarray]


def identity(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``uid, tag`` of a row: its id (a hash of the text if null) and 31 bits of the text's hash.

    Rows that repeat id and text have one identity; rows that share the id alone have two.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return [F.coalesce(F.col(id_col).cast("bigint"), h).alias("uid"), h.bitwiseAND(0x7FFFFFFF).cast("int").alias("tag")]


class SumHash:
    """Hash of any run of token values in constant time."""

    def __init__(self, values: np.ndarray):
        if values.dtype == np.uint8:
            values = _BYTE[values]
        powers, self._back = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers[: len(values)], out=self._sums[1:])

    def runs(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self._sums[starts + length] - self._sums[starts]) * self._back[starts] + np.uint64(length))

    def all_runs(self, length: int) -> np.ndarray:
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._back[:n] + np.uint64(length))


def spans(values: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cut the tokens of one text so that every window lies in exactly one part."""
    for start in range(0, max(len(values) - width + 1, 0), _SPAN):
        yield start, values[start : start + _SPAN + width - 1]


def minimisers(grams: np.ndarray, per_window: int) -> np.ndarray:
    """For each window of ``per_window`` grams, the position of its leftmost smallest gram."""
    bits = np.uint64(21)
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= per_window:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < per_window:
        rest = per_window - step
        packed = np.minimum(packed[:-rest], packed[rest:])
    return (packed & np.uint64((1 << 21) - 1)).astype(np.int64)


def _runs_of(values: np.ndarray, starts: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of equal ``values`` at consecutive ``starts``; ``single`` ones stand alone."""
    ends = (np.diff(values) != 0) | (np.diff(starts) != 1)
    if single is not None:
        ends |= single[1:]
    cut = np.flatnonzero(ends) + 1
    return np.r_[0, cut], np.r_[cut, len(values)] - 1


def _candidates(n: int, offset: int, ranges) -> np.ndarray:
    """Window starts of a part that lie in the ranges (all without ranges)."""
    if ranges is None:
        return np.arange(n)
    steps = np.zeros(n + 1, dtype=np.int32)
    first, last = np.clip(ranges[0] - offset, 0, n), np.clip(ranges[1] + 1 - offset, 0, n)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def _dealt(data: np.ndarray, tokens: Tokens, width: int, gram: int, ranges):
    """Parts of a text: offset, hashes, gram hash, first and last start of each minimiser's run, all starts."""
    values = tokens(data)
    for offset, part in spans(values, width):
        starts = _candidates(len(part) - width + 1, offset, ranges)
        if not len(starts):
            continue
        hashes = SumHash(part)
        grams = hashes.all_runs(gram)
        at = minimisers(grams, width - gram + 1)[starts]
        a, b = _runs_of(at, starts)
        yield offset, part, hashes, grams[at[a]], starts[a], starts[b], starts


def _ranges(column: pa.Array, i: int):
    """First and last starts of the ranges of a row and their flags, from the numbers of ``_packed``."""
    if not column[i].is_valid:
        return None
    packed = column[i].values.to_numpy(zero_copy_only=False)
    return packed >> 32, (packed >> 1) & 0x7FFFFFFF, (packed & 1).astype(bool)


def _packed(found: DataFrame, flag: Column | None = None) -> DataFrame:
    """``uid, tag, ranges``: the distinct ranges of a document in order, each one number of first, last and flag."""
    flag = F.lit(0) if flag is None else flag.cast("bigint")
    one = F.shiftleft(F.col("first").cast("bigint"), 32) + F.shiftleft(F.col("last").cast("bigint"), 1) + flag
    return found.groupBy("uid", "tag").agg(F.sort_array(F.collect_set(one)).alias("ranges"))


def _level(docs: DataFrame, tokens: Tokens, width: int, gram: int) -> DataFrame:
    """``uid, tag, first, last``: window starts whose minimiser gram ``key`` occurs ``n`` >= 2 times.

    ``n`` is the count of the whole corpus in rows of salt 0; each repeated gram has such a row.

    ``docs`` has ``uid, tag, text`` and, from the second level on, ``ranges``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            parts = [[] for _ in range(4)]
            for i, data in enumerate(byte_rows(batch.column(2))):
                ranges = _ranges(batch.column(3), i) if batch.num_columns > 3 else None
                for offset, _, _, keys, a, b, _ in _dealt(data, tokens, width, gram, ranges):
                    for out, part in zip(parts, (keys, a + offset, b + offset, np.full(len(keys), i)), strict=True):
                        out.append(part)
            if not parts[0]:
                continue
            key, first, last, row = (np.concatenate(p) for p in parts)
            _, lead, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            known = n[which] > 1
            salt = np.where(known, 1 + (uid[row] & 0x3FFFFFFF), 0).astype(np.int32)
            extra = lead[n > 1]  # stand for the batch among the other batches
            pick = np.r_[np.arange(len(key)), extra]
            salt = np.r_[salt, np.zeros(len(extra), dtype=np.int32)]
            count = np.r_[n[which], n[n > 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[pick].view(np.int64)), pa.array(salt), pa.array(uid[row[pick]]), pa.array(tag[row[pick]]),
                 pa.array(first[pick].astype(np.int32)), pa.array(last[pick].astype(np.int32)), pa.array(count.astype(np.int64))],
                names=["key", "salt", "uid", "tag", "first", "last", "n"],
            )

    rows = docs.mapInArrow(run, "key bigint, salt int, uid bigint, tag int, first int, last int, n bigint")
    total = F.sum("n").over(Window.partitionBy("key", "salt"))
    return rows.withColumn("n", total).where("n >= 2")


def _with_ranges(docs: DataFrame, found: DataFrame, flag: Column | None = None) -> DataFrame:
    """The texts that have ranges, with them in order; ``flag`` is a property of a range besides its ends."""
    return docs.join(_packed(found, flag), ["uid", "tag"])


def _mark_often(found: DataFrame) -> DataFrame:
    """Ranges with ``often``: whether their gram has more than ``FREQUENT`` occurrences in the corpus."""
    frequent = found.where((F.col("salt") == 0) & (F.col("n") > FREQUENT)).select("key").distinct()
    # less than one of FREQUENT rows is such a gram, so they fit a broadcast
    found = found.join(F.broadcast(frequent.withColumn("often", F.lit(True))), "key", "left")
    return found.withColumn("often", F.coalesce("often", F.lit(False)))


def _slices(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of 64-bit values as binary rows."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(8 * sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bodies(parts: list, which: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> pa.Array:
    """The bytes that the windows from ``first`` to ``last`` cover."""
    rows = []
    for k, a, b in zip(which.tolist(), first.tolist(), last.tolist(), strict=True):
        offset, part = parts[k]
        rows.append(part[a - offset : b - offset + width].tobytes())
    return pa.array(rows, type=pa.binary())


def _compared(docs: DataFrame, tokens: Tokens, width: int, gram: int, settle, content: bool) -> DataFrame:
    """``uid, tag, first, last``: starts of the windows to remove among the candidates.

    Rows go to the reducing tasks by minimiser: window hashes, or with ``content`` the bytes that the windows
    cover. ``settle(key, uid, tag, start, values)`` tells which windows of one task are to be removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            texts = list(byte_rows(batch.column(2)))
            parts, cells, size = [], [[] for _ in range(7)], 0  # per run: document, part, gram, often, windows; per window: start, hash
            for i in np.lexsort((tag, uid)).tolist():
                ranges = _ranges(batch.column(3), i)
                for offset, part, hashes, keys, a, b, starts in _dealt(texts[i], tokens, width, gram, ranges):
                    often = ranges[2][np.searchsorted(ranges[0], a + offset)]
                    found = (np.full(len(keys), i), np.full(len(keys), len(parts)), keys, often, b - a + 1, (starts + offset).astype(np.int32), hashes.runs(starts, width))
                    for cell, values in zip(cells, found, strict=True):
                        cell.append(values)
                    parts.append((offset, part))
                    size += len(starts)
                    if size >= _PIECE:
                        yield from piece(uid, tag, parts, cells)
                        parts, cells, size = [], [[] for _ in range(7)], 0
            if parts:
                yield from piece(uid, tag, parts, cells)

    def piece(uid, tag, parts, cells) -> Iterator[pa.RecordBatch]:
        """Rows of some windows of a batch; ``cells`` are emptied."""
        row, which_part, keys, often, sizes, start, window = (np.concatenate(x) for x in cells)
        cells.clear()
        owner = np.repeat(np.arange(len(row), dtype=np.int32), sizes)
        doc = row.astype(np.int32)[owner]
        order = np.argsort(window, kind="stable")
        new = np.r_[True, np.diff(window[order]) != 0]
        lead = np.empty(len(order), dtype=np.int32)  # the first window like this one
        lead[order] = order[np.flatnonzero(new)[np.cumsum(new, dtype=np.int32) - 1]]
        leads = np.flatnonzero(lead == np.arange(len(window)))
        if content:  # the first stays; rows that repeat id and text are one document
            removed = (uid[doc] != uid[doc[lead]]) | (tag[doc] != tag[doc[lead]]) | (start != start[lead])
        else:
            removed = np.empty(len(order), dtype=bool)
            removed[order] = ~(new & np.r_[new[1:], True])
        out = []
        for at, send in ((np.flatnonzero(removed), False), (leads, True)):
            if not len(at):
                continue
            # what is decided here already needs no minimiser any more: whole runs of a document
            x, y = _runs_of(owner[at], at, often[owner[at]]) if send else _runs_of(doc[at], start[at])
            p, q = at[x], at[y]
            own = owner[p]
            if not send:
                sub, bodies = (uid[row[own]] * 31 + start[p]) & 0x7FFFFFFF, pa.nulls(len(p), pa.binary())
            else:
                sub = np.where(often[own], window[p].view(np.int64), 0)
                bodies = _bodies(parts, which_part[own], start[p], start[q], width) if content else _slices(window[at], y - x + 1)
            columns = [keys[own].view(np.int64), sub, uid[row[own]], tag[row[own]], start[p].astype(np.int32), start[q].astype(np.int32)]
            out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), bodies], names=NAMES))
        yield from out

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < _HELD * 8:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, sub = (table.column(k).to_numpy() for k in range(2))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(sub) != 0))
            if len(cut):
                yield removed_runs(table.slice(0, int(cut[-1]) + 1))
                held = table.slice(int(cut[-1]) + 1).to_batches()
            else:
                held = table.to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield removed_runs(pa.Table.from_batches(held).combine_chunks())

    def _alike(at, bodies, uid, tag, first) -> tuple[np.ndarray, np.ndarray]:
        """One row for all with the same body, the earliest, and the rows that are removed as a whole.

        Equal bodies have equal windows one by one, so only one of them needs to meet the others.
        """
        code = bodies.take(pa.array(at)).dictionary_encode().indices.to_numpy()
        order = np.lexsort((first[at], tag[at], uid[at], code))
        at, code = at[order], code[order]
        new = np.r_[True, np.diff(code) != 0]
        lead = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if content:  # the first stays; rows that repeat id and text are one document
            gone = (uid[at] != uid[lead]) | (tag[at] != tag[lead]) | (first[at] != first[lead])
        else:
            gone = ~(new & np.r_[new[1:], True])
        return at[new], at[gone]

    def removed_runs(table: pa.Table) -> pa.RecordBatch:
        key, sub, uid, tag, first, last = (table.column(k).to_numpy() for k in range(6))
        bodies = table.column(6).combine_chunks()
        bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
        sent = np.asarray(bodies.is_valid())
        parts = [(uid[~sent], tag[~sent], first[~sent], last[~sent])]
        if sent.any():
            at, whole = _alike(np.flatnonzero(sent), bodies, uid, tag, first)
            parts.append((uid[whole], tag[whole], first[whole], last[whole]))
            sizes = last[at] - first[at] + 1
            owner = np.repeat(at, sizes)
            start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values = list(byte_rows(bodies.take(pa.array(at))))
            gone = np.flatnonzero(settle(key[owner], uid[owner], tag[owner], start, sizes, values))
            if len(gone):
                a, b = _runs_of(owner[gone], start[gone])
                parts.append((uid[owner[gone[a]]], tag[owner[gone[a]]], start[gone[a]], start[gone[b]]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], names=["uid", "tag", "first", "last"])

    NAMES = ["key", "sub", "uid", "tag", "first", "last", "body"]
    rows = docs.select("uid", "tag", "text", "ranges").mapInArrow(
        run, "key bigint, sub bigint, uid bigint, tag int, first int, last int, body binary"
    )
    rows = rows.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return rows.mapInArrow(reduce, "uid bigint, tag int, first int, last int")


def removed_windows(docs: DataFrame, tokens: Tokens, width: int, levels: tuple[int, ...], settle, content: bool) -> tuple[DataFrame, DataFrame]:
    """The texts by identity (``uid, tag, doc_id, text``) and the window starts to remove (``uid, tag, first, last``)."""
    spark = docs.sparkSession
    base = docs.select(*identity(), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Every level meets the texts again by identity; bucketed once, they aren't shuffled for it.
    path = scratch_path(spark, "texts")
    name = "texts_" + path[-32:]
    writer = base.repartition(buckets, "uid", "tag").write.format("parquet").option("path", path).option("compression", "zstd")
    with settings(spark, **CLEAN):
        writer.bucketBy(buckets, "uid", "tag").saveAsTable(name)
    texts = spark.table(name)
    left, kept = base.select("uid", "tag", "text"), []
    for gram in levels:
        found = _level(left, tokens, width, gram)
        if gram == levels[-1]:
            found = materialize(found, "candidates")  # read twice
            left = _with_ranges(texts.select("uid", "tag", "text"), _mark_often(found), F.col("often"))
        else:
            # written so that a level's shuffles are gone before the next ones
            found = materialize(found.select("uid", "tag", "first", "last"), "candidates")
            left = _with_ranges(texts.select("uid", "tag", "text"), found)
        forget(*kept)
        kept = [found]
    removed = materialize(_compared(left, tokens, width, levels[-1], settle, content), "removed")
    forget(*kept)
    return texts, removed


def cover(texts: DataFrame, removed: DataFrame) -> DataFrame:
    """``texts`` with ``ranges`` of removed window starts (null if none)."""
    return texts.join(_packed(removed), ["uid", "tag"], "left")


def covered(n: int, ranges, width: int) -> np.ndarray:
    """Flags of the tokens that windows starting in the ranges cover."""
    steps = np.zeros(n + 1, dtype=np.int32)
    if ranges is not None:
        np.add.at(steps, ranges[0], 1)
        np.add.at(steps, ranges[1] + width, -1)
    return np.cumsum(steps[:-1]) > 0
