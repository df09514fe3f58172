"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased). Words are ordered by rarity, counted over all lines in hash cells;
two lines of Jaccard 0.8 share one of their first ``n - ceil(0.8 n) + 1`` words in that order. Lines that share a
prefix word meet if their lengths allow 0.8, the places of the word leave room for enough common words and the
parities of 128 hash cells don't differ too often; what is left is verified. A line is removed if an earlier one (by document id, then line) matches it;
matches are judged on the input, so a removed line still removes later ones.

Equal lines are one node with its first place. As one earlier match is enough, each node of a shard is
first compared with the shard's earliest one and the first that fits; only nodes that stay are compared with all
earlier ones that fit. Shards of more than ``SHARD`` nodes are cut into blocks that meet two by two.

Defined results
    null or empty text       has one empty line; nothing removed
    lines of few words       fewer than ``least_words`` distinct words: always stay; the default takes every line with a word
    very long text or line   is read whole, in segments of bounded size
    null doc_id              such documents are placed among the ids by a hash of their text
    repeated rows            rows that repeat id and text are one document and get the same result
    empty table              no rows
    other columns            are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.arrays import _is, byte_rows, mix, segments, token_bounds, word_hashes
from docflow.llm.jaccard_join import BROADCAST_KEYS, BROADCAST_NODES, _whole_groups, needed
from docflow.llm.jaccard_join import _verified as verified
from docflow.llm.windows import identity
from docflow.runtime import forget, materialize

LEAST_WORDS = 1
#: Hash cells in which words are counted; a task holds a byte for each.
CELL_BITS = 23
CELLS = 1 << CELL_BITS
SHARD = 4096
#: Bytes of texts whose words are cut, sorted and measured at a time.
BLOCK = 1 << 19
#: Shards up to this number of nodes are compared many at a time, so many pairs at once.
SMALL, AT_ONCE = 64, 1 << 19
_NEWLINE = _is(10)
_END = np.array([10], dtype=np.uint8)
_SALT = np.uint64(0x5851F42D4C957F2D)


def line_sets(data: np.ndarray, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct word hashes of each line with enough words."""
    number = 0
    for a, b in segments(data, _NEWLINE):
        part = data[a:b]
        words = word_hashes(part, lower=True)
        starts = np.concatenate([token_bounds(part[x:y])[0] + x for x, y in segments(part)])
        line = np.searchsorted(np.flatnonzero(part == 10), starts)
        cut = np.flatnonzero(np.diff(line)) + 1
        for x, y in zip(np.r_[0, cut].tolist(), np.r_[cut, len(line)].tolist(), strict=True):
            if y - x >= least_words:
                found = np.unique(words[x:y])
                if len(found) >= least_words:
                    yield number + int(line[x]), found
        number += int(np.count_nonzero(part == 10))


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _pieces(texts: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, number of the first line and bytes of whole lines of the texts."""
    for row, data in enumerate(texts):
        number = 0
        for a, b in segments(data, _NEWLINE):
            yield row, number, data[a:b]
            number += int(np.count_nonzero(data[a:b] == 10))


def _blocks(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts about ``BLOCK`` bytes at a time: hashes of all words, the line that each is in, row and number of each line."""

    def cut(held) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.concatenate([x for _, _, part in held for x in (part, _END)])
        words = word_hashes(data, lower=True)
        starts = np.concatenate([token_bounds(data[x:y])[0] + x for x, y in segments(data)])
        ends = np.flatnonzero(data == 10)
        piece_of = np.repeat(np.arange(len(held)), np.diff(np.searchsorted(ends, np.cumsum([0, *(len(part) + 1 for _, _, part in held)]))))
        first = np.searchsorted(piece_of, np.arange(len(held)))
        number = np.arange(len(ends)) - first[piece_of] + np.array([n for _, n, _ in held])[piece_of]
        return words, np.searchsorted(ends, starts), np.array([row for row, _, _ in held])[piece_of], number

    held, size = [], 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[2]) + 1
        if size >= BLOCK:
            yield cut(held)
            held, size = [], 0
    if held:
        yield cut(held)


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often the words of each hash cell occur in all lines, as levels (``CELLS`` bytes).

    Level 1 is a single time, so its word can't be shared; above, a level is an eighth of a doubling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int32)  # a task's words are far fewer than 2**31
        for batch in batches:
            for words, *_ in _blocks(list(byte_rows(batch.column(0)))):
                cells, n = np.unique(_cell(words).astype(np.int32), return_counts=True)
                total[cells] += n.astype(np.int32)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 18):
            cells = at[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells].astype(np.int64))], names=["cell", "n"])

    table = docs.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    level = F.when(F.col("n") == 1, 1).otherwise(F.least(F.lit(127), 2 + F.floor(8 * F.log2("n")))).cast("tinyint")
    table = table.select("cell", level.alias("level")).toArrow()  # at most CELLS rows of five bytes
    levels = np.zeros(CELLS, dtype=np.uint8)
    levels[table["cell"].to_numpy()] = table["level"].to_numpy()
    return levels


def prefix(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest words of a line, as many as make two matching lines share one; ``measured_lines`` takes many lines."""
    size = len(words) - (4 * len(words) + 4) // 5 + 1
    return words[np.lexsort((mix(words), counts[_cell(words)]))[:size]]


def bitmap(words: np.ndarray) -> np.ndarray:
    """Parity of the words in each of 128 hash cells, as two numbers: sets differ in at least as many words as bits."""
    cells = np.bincount((mix(words) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)  # of a signed number it counts the absolute value


def measured_lines(words: np.ndarray, line: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all lines with words: line, node, size, prefix words that no other line has, how many more, these, bitmap.

    A node is 64 bits of a hash of the distinct words, in whatever order they come.
    """
    at, spread = np.cumsum(np.r_[False, np.diff(line) != 0]), mix(words)
    # line, level and 37 bits of the hash in one number, so that one sort does; equal numbers of two words are rare
    key = at.astype(np.uint64) << np.uint64(44) | levels[_cell(words)].astype(np.uint64) << np.uint64(37) | spread >> np.uint64(27)
    order = np.argsort(key)
    tied = np.diff(key[order]) == 0
    if (tied & (np.diff(words[order]) != 0)).any():
        order = np.lexsort((spread, key))
    new = np.r_[True, (np.diff(key[order]) != 0) | (np.diff(words[order]) != 0)]
    order = order[new]
    words, spread, at = words[order], spread[order], at[order]
    first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
    n = np.diff(np.r_[first, len(at)])
    size = n - (4 * n + 4) // 5 + 1
    alone = np.minimum(np.add.reduceat(levels[_cell(words)] == 1, first, dtype=np.int64), size)
    place = np.arange(len(at)) - np.repeat(first, n)
    shared = words[(place >= np.repeat(alone, n)) & (place < np.repeat(size, n))]
    node = mix(np.add.reduceat(mix(words ^ _SALT), first) + n.astype(np.uint64))
    cell = spread & np.uint64(127)
    bit = np.uint64(1) << (cell & np.uint64(63))
    bits = [np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), first).view(np.int64) for half in (cell < 64, cell >= 64)]
    return line[np.flatnonzero(np.r_[True, np.diff(line) != 0])], node.view(np.int64), n, alone, size - alone, shared.view(np.int64), *bits


def _lines(docs: DataFrame, levels: np.ndarray, least_words: int) -> DataFrame:
    """``uid, tag, line, node, n, alone, first, b0, b1``: a row per line.

    Shared prefix words, how many come before them and the bitmap stand at the least place of equal lines in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = list(byte_rows(batch.column(2))), []
            # rows come in any order, and the first of equal lines must be the one of the least place
            rows = np.lexsort([batch.column(k).to_numpy() for k in (1, 0)])
            for words, line, row, number in _blocks([texts[i] for i in rows.tolist()]):
                if len(words):
                    at, *rest = measured_lines(words, line, levels)
                    found.append((rows[row[at]], number[at], *rest))
            if not found:
                continue
            row, line, node, n, alone, many, shared, *bits = (np.concatenate(c) for c in zip(*found, strict=True))
            enough = n >= least_words
            again = np.ones(len(node), dtype=bool)
            again[np.unique(node, return_index=True)[1]] = False
            sent = np.where(again, 0, many)
            shared = shared[np.repeat(~again & enough, many)]
            offsets = pa.array(np.r_[0, np.cumsum(sent[enough])].astype(np.int32))
            again, at = again[enough], pa.array(row[enough])
            first = pa.ListArray.from_arrays(offsets, pa.array(shared), mask=pa.array(again))
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(line[enough].astype(np.int32)), pa.array(node[enough]), pa.array(n[enough].astype(np.int32))]
            columns += [pa.array(alone[enough].astype(np.int32), mask=again), first, *(pa.array(b[enough], mask=again) for b in bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "tag", "line", "node", "n", "alone", "first", "b0", "b1"])

    rows = docs.select(*identity(), "text")
    return rows.mapInArrow(run, "uid bigint, tag int, line int, node bigint, n int, alone int, first array<bigint>, b0 bigint, b1 bigint")


def _nodes(lines: DataFrame) -> DataFrame:
    """``node, f, n, alone, first, b0, b1`` of the nodes with a shared prefix word; ``f`` is a node's first place."""
    place = F.struct("uid", "tag", "line")
    # each batch that holds a node has sent its least place there, so the least of them is the node's first one
    nodes = lines.where("first is not null").groupBy("node").agg(
        F.min(place).alias("f"), F.any_value(F.struct("n", "alone", "first", "b0", "b1")).alias("r")
    )
    return materialize(nodes.select("node", "f", "r.*").where("size(first) > 0"), "line-nodes")


def _shared(nodes: DataFrame) -> DataFrame:
    """``key, m``: prefix words of several nodes; ``m`` is their number if it is above ``SHARD``, else null."""
    shared = nodes.select(F.explode("first").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("nodes"))
    return materialize(shared.where("nodes > 1").select("key", F.when(F.col("nodes") > SHARD, F.col("nodes")).alias("m")), "shared-words")


def _shards(nodes: DataFrame, shared: DataFrame, small: bool) -> DataFrame:
    """Nodes with a common prefix word: ``key, node, n, pos, b0, b1, f, m``.

    They go straight into the shuffle that deals them: written, they would be many times the nodes.
    """
    more = [c for c in nodes.columns if c not in ("alone", "first")]
    keyed = nodes.select(*more, "alone", F.posexplode("first").alias("at", "key"))
    members = keyed.join(F.broadcast(shared) if small else shared, "key")
    return members.select("key", *more, (F.col("at") + F.col("alone")).alias("pos"), "m")


def _pairs(shards: DataFrame, mode: str) -> DataFrame:
    """Distinct ``a, b``: nodes that may match, a earlier than b.

    Mode ``some`` gives for each node the shard's earliest one if it fits, and the first fitting one on
    either side, so every node that fits any other one is named. Mode ``all`` gives all that fit a node that stays.
    """

    few, at_once = SMALL, AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            key, x, y, left, node, n, pos, b0, b1, uid, tag, line, stays = (table.column(k).to_numpy() for k in range(13))
            n, pos = n.astype(np.int64), pos.astype(np.int64)

            def fits(p, q) -> np.ndarray:
                room = np.minimum(pos[p], pos[q]) + np.minimum(n[p] - pos[p], n[q] - pos[q])
                apart = differing_bits(b0[p], b0[q]) + differing_bits(b1[p], b1[q])
                least = needed(n[p], n[q])
                enough = (room >= least) & (apart <= n[p] + n[q] - 2 * least)
                return enough & (5 * np.minimum(n[p], n[q]) >= 4 * np.maximum(n[p], n[q])) & ((x[p] == y[p]) | (left[p] != left[q]))

            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(key)]
            group = np.repeat(np.arange(len(start)), end - start)
            placed = np.lexsort((line, tag, uid, group))
            found = []
            # small shards: every node that stays with all earlier ones, many nodes at a time
            late = np.flatnonzero(((end - start) <= few)[group] & stays[placed])
            many = late - start[group[late]]
            late, many = late[many > 0], many[many > 0]
            parts = np.r_[0, np.flatnonzero(np.diff((np.cumsum(many) - many) // at_once)) + 1, len(late)]
            for k, m in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
                count = many[k:m]
                q = np.repeat(late[k:m], count)
                p = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + start[group[q]]
                ok = fits(placed[p], placed[q])
                p, q = p[ok], q[ok]
                if mode == "some" and len(p):
                    kept = p == start[group[p]]
                    kept |= np.r_[True, np.diff(q) != 0]
                    kept[np.unique(p, return_index=True)[1]] = True
                    p, q = p[kept], q[kept]
                if len(p):
                    found.append(np.stack([node[placed[p]], node[placed[q]]], axis=1))
            large = (end - start) > few
            for a, b in zip(start[large].tolist(), end[large].tolist(), strict=True):
                order = placed[a:b]
                later = np.flatnonzero(stays[order])
                later = later[later > 0]
                named = np.zeros(b - a, dtype=bool)
                for k in range(0, len(later), 64):  # 64 nodes against all earlier ones at a time
                    late = later[k : k + 64]
                    early = np.arange(int(late[-1]))
                    ok = (early[None, :] < late[:, None]) & fits(order[early][None, :], order[late][:, None])
                    if mode == "some":
                        rows, new = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0) & ~named[early])
                        named[new] = True
                        q = np.r_[rows, ok[:, new].argmax(axis=0), np.flatnonzero(ok[:, 0])]
                        p = np.r_[ok[rows].argmax(axis=1), new, np.zeros(int(ok[:, 0].sum()), dtype=np.int64)]
                    else:
                        q, p = np.nonzero(ok)
                    if len(p):
                        found.append(np.stack([node[order[early[p]]], node[order[late[q]]]], axis=1))
            if found:
                pairs = np.concatenate(found)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                pairs = pairs[np.r_[True, (np.diff(pairs, axis=0) != 0).any(axis=1)]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    # A shard of m nodes has ceil(m / SHARD) blocks; each pair of blocks is one group of rows.
    last = F.coalesce(F.ceil(F.col("m") / SHARD).cast("int") - 1, F.lit(0))
    block = F.when(last == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), last + 1).cast("int"))
    rows = shards.withColumn("last", last).withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") <= F.col("other")).cast("int").alias("left"),
        "node", "n", "pos", "b0", "b1", "f.uid", "f.tag", "f.line", "stays",
    )
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, least_words: int) -> DataFrame:
    """``node, set`` of the lines ``uid, tag, line, node``. Up to ``BROADCAST_NODES`` of them go to the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sets = [], []
            for i, data in enumerate(byte_rows(batch.column(0))):
                want = dict(zip(*(batch.column(1).field(k)[i].as_py() for k in range(2)), strict=True))
                for number, words in line_sets(data, least_words):
                    if number in want:
                        node.append(want[number])
                        sets.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, type=pa.int64()), pa.array(sets, type=pa.binary())], names=["node", "set"])

    per_doc = wanted.groupBy("uid", "tag").agg(F.collect_list(F.struct("line", "node")).alias("w"))
    per_doc = per_doc.select("uid", "tag", F.struct(F.col("w.line").alias("line"), F.col("w.node").alias("node")).alias("w"))
    if wanted.count() <= BROADCAST_NODES:
        per_doc = F.broadcast(per_doc)
    rows = docs.select(*identity(), "text").join(per_doc, ["uid", "tag"]).select("text", "w")
    return rows.mapInArrow(run, "node bigint, set binary").dropDuplicates(["node"])


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``uid, tag, line`` of every line that an earlier one matches (lines count from 0)."""
    measured = materialize(_lines(docs, word_counts(docs), least_words), "lines")
    nodes = _nodes(measured)
    lines = materialize(measured.select("node", "uid", "tag", "line"), "line-places")
    forget(measured)
    shared = _shared(nodes)
    small = shared.count() <= BROADCAST_KEYS
    firsts = lines.groupBy("node").agg(F.min(F.struct("uid", "tag", "line")).alias("f"))
    some = materialize(_pairs(_shards(nodes, shared, small).withColumn("stays", F.lit(True)), "some"), "line-pairs-some")
    paired = some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct()
    paired = materialize(paired, "paired-lines")
    wanted = materialize(firsts.join(paired, "node").select("node", "f.uid", "f.tag", "f.line"), "wanted-lines")
    sets = materialize(_sets(docs, wanted, least_words), "line-sets")
    near = materialize(verified(some, sets).select(F.col("b").alias("node")).distinct(), "matched-some")
    forget(some, wanted)
    left = nodes.join(paired, "node", "left_semi").join(near.withColumn("gone", F.lit(True)), "node", "left")
    left = materialize(left.withColumn("stays", F.col("gone").isNull()).drop("gone"), "paired-nodes")
    forget(nodes, paired)
    pairs = materialize(_pairs(_shards(left, shared, small), "all"), "line-pairs-all")
    forget(left, shared)
    rest = materialize(verified(pairs, sets).select(F.col("b").alias("node")).distinct(), "matched-all")
    forget(pairs, sets)
    firsts = firsts.join(near.unionByName(rest).withColumn("gone", F.lit(True)), "node", "left")
    rows = lines.select("node", "uid", "tag", "line").join(firsts, "node")
    rows = rows.where(F.col("gone").isNotNull() | (F.struct("uid", "tag", "line") != F.col("f")))
    out = materialize(rows.select("uid", "tag", "line").distinct(), "removed-lines")
    forget(lines, near, rest)
    return out


def remove_matching_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept`` for every row; ``kept`` joins the lines left by newlines.

    Lines of fewer than ``least_words`` distinct words stay. 1 judges every line that has a word.
    """
    if least_words < 1:
        raise ValueError("a line without words matches nothing: least_words must be 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for i, data in enumerate(byte_rows(batch.column(1))):
                lines = data.tobytes().split(b"\n")
                out = set(batch.column(2)[i].as_py() or ())
                total.append(len(lines))
                gone.append(len(out))
                kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in out))
            columns = [batch.column(0), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_removed", "kept"])

    out = removed_lines(docs, least_words).groupBy("uid", "tag").agg(F.collect_list("line").alias("out"))
    rows = docs.select(*identity(), F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(out, ["uid", "tag"], "left")
    return rows.select("doc_id", "text", "out").mapInArrow(run, "doc_id bigint, n_lines bigint, n_removed bigint, kept string")
