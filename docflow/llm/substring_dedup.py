"""Substring dedup over words: level-wise doubling of repeated windows.

Level one counts runs of 8 words, the next runs of twice that length, and so on up to the window (35 words).
Only windows whose run was repeated at one level are extended at the next. At each level a window is
represented by its minimiser run, see ``windows``; the last level compares whole windows.

Defined results
    null, empty or blank text   no words, nothing removed, the kept text is empty
    fewer words than a window   nothing removed
    very long text              is cut into overlapping parts; no window is lost
    null doc_id                 such rows are told apart by their text
    repeated rows               are occurrences of their own, so all their windows are repeated
    empty table                 no rows
    other columns               are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docflow.llm.arrays import byte_rows, segments, token_bounds, word_hashes
from docflow.llm.windows import _ranges, cover, covered, removed_windows

WINDOW = 35
FIRST = 8


def doubling(first: int, window: int) -> tuple[int, ...]:
    """Run lengths of the levels below the window: each twice the one before."""
    lengths = [min(first, window)]
    while 2 * lengths[-1] < window:
        lengths.append(2 * lengths[-1])
    return tuple(lengths)


def _repeated(key, uid, tag, start, sizes, values) -> np.ndarray:
    window = np.concatenate([v.view(np.uint64) for v in values])
    _, which, n = np.unique(window, return_inverse=True, return_counts=True)
    return n[which] > 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; ``kept`` joins the words left by single spaces."""
    texts, removed = removed_windows(docs, word_hashes, window, doubling(first, window), _repeated, content=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for i, data in enumerate(byte_rows(batch.column(1))):
                bounds = [(token_bounds(data[a:b]), a) for a, b in segments(data)]
                starts = np.concatenate([s + a for (s, _), a in bounds])
                ends = np.concatenate([e + a for (_, e), a in bounds])
                flags = covered(len(starts), _ranges(batch.column(2), i), window)
                content = data.tobytes()
                words = [content[s:e] for s, e in zip(starts[~flags].tolist(), ends[~flags].tolist(), strict=True)]
                total.append(len(starts))
                gone.append(int(flags.sum()))
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    rows = cover(texts, removed).select("doc_id", "text", "ranges")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
