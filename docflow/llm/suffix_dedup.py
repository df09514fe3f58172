"""Suffix-array dedup over bytes: depth-limited radix sort of the suffixes.

Suffixes are ordered only through their first 100 bytes. The first digit deals them to tasks: the minimiser gram
of the 100 bytes, see ``windows``; a suffix whose digit is alone in the corpus leaves. Each task then runs
most-significant-digit passes of eight bytes over what it got, and suffixes that are alone leave after each
pass. Groups that are left after the last digit are exactly the repeated windows, of which the earliest stays.

Defined results
    null or empty text       no bytes, nothing removed
    fewer than 100 bytes     nothing removed
    very long text           is cut into overlapping parts; no window is lost
    null doc_id              such rows are placed among the ids by a hash of their text
    rows that share an id    are ordered by a hash of their text; if they share the text too, they are one
                             document and get the same result
    empty table              no rows
    other columns            are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docflow.llm.arrays import byte_rows
from docflow.llm.windows import _ranges, cover, covered, removed_windows

WINDOW = 100
FIRST_DIGIT = 32
DIGIT = 8


def radix_groups(content: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``at`` that equal another one of their group through ``depth`` bytes: index and group of each.

    ``content`` has at least ``DIGIT`` bytes after the deepest digit.
    """
    digits = np.ndarray(shape=(len(content) - DIGIT + 1,), dtype=">u8", buffer=content, strides=(1,))
    index = np.arange(len(at))
    for pass_at in range(0, depth, DIGIT):
        digit = digits[at[index] + pass_at].astype(np.uint64)
        if depth - pass_at < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - depth + pass_at))
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        new = np.r_[True, (np.diff(group) != 0) | (digit[1:] != digit[:-1])] if len(index) else np.zeros(0, dtype=bool)
        group = np.cumsum(new)
        alone = new & np.r_[new[1:], True] if len(index) else new
        index, group = index[~alone], group[~alone]
    return index, group


def _later(key, uid, tag, start, sizes, values) -> np.ndarray:
    """Flags of the windows that an earlier equal one precedes."""
    content = np.concatenate([*values, np.zeros(DIGIT, dtype=np.uint8)])
    lengths = np.array([len(v) for v in values])
    at = np.repeat(np.cumsum(lengths) - lengths, sizes) + np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index, group = radix_groups(content, at, key, int(lengths[0] - sizes[0] + 1))
    order = np.lexsort((start[index], tag[index], uid[index], group))
    index, group = index[order], group[order]
    gone = np.zeros(len(start), dtype=bool)
    if len(index):
        first = index[np.flatnonzero(np.r_[True, np.diff(group) != 0])[np.cumsum(np.r_[True, np.diff(group) != 0]) - 1]]
        gone[index] = (uid[index] != uid[first]) | (tag[index] != tag[first]) | (start[index] != start[first])
    return gone


def byte_values(data: np.ndarray) -> np.ndarray:
    return data


def remove_repeats(docs: DataFrame, window: int = WINDOW, first_digit: int = FIRST_DIGIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row; ``kept`` has the bytes that are left."""
    levels = (min(first_digit, window),)
    texts, removed = removed_windows(docs, byte_values, window, levels, _later, content=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in enumerate(byte_rows(batch.column(1))):
                flags = covered(len(data), _ranges(batch.column(2), i), window)
                spans = int(np.count_nonzero(np.diff(np.r_[False, flags].astype(np.int8)) == 1))
                rows.append((len(data), int(flags.sum()), spans, data[~flags].tobytes()))
            columns = [batch.column(0), *(pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = cover(texts, removed).select("doc_id", "text", "ranges")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
