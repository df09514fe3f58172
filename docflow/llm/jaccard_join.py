"""N-gram Jaccard join over count vectors in R-trees.

A text is its set of five-word shingles. Shingles are hashed to ``GROUPS`` groups, and the counts per group are
the text's point. For two texts the sum of the smaller coordinates bounds the size of the intersection, and for a
tree node the coordinate maxima bound all its points at once. Pairs that pass the bound are verified exactly.

Points meet only in shards. In an order of all shingles two sets of Jaccard 0.8 share one of their first
``n - ceil(0.8 n) + 1`` shingles, so each of these names a shard, and a shard of one set is dropped. The order puts
shingles of frequent hash cells last and goes by hash within, so that a passage that many texts share names
few shards; the cells are counted over all texts.

Three passes link the texts of a shard: first each one with the shard's most central point and with the point
nearest by bound, then each with the nearest of another component, then with all of other components that
the bound leaves. Links inside a component that is known already are not looked for, so copies of one
text don't meet pair by pair, and none that joins two components is missed. Shards beyond ``SHARD`` points are cut
into blocks that meet two by two.

Defined results
    null, empty or blank text   no shingles, no link, its own component
    fewer than five words       the whole sequence is the one shingle
    very long text              is read whole, in segments of bounded size
    null doc_id                 takes part; a component of such rows alone has a null id
    repeated rows               equal sets link; rows that share the id alone are documents of their own
    empty table                 no rows
    other columns               are not read (``drop_near_copies`` hands them on)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.arrays import byte_rows, fixed_rows, mix, shingle_set
from docflow.llm.components import components
from docflow.llm.windows import identity
from docflow.runtime import forget, materialize

GROUPS = 256
CELLS = 1 << 16
SHARD = 2048
FANOUT = 16
#: Rows with whole sets that Python gets at a time.
SET_ROWS = 200
#: Keys of shared shards up to this number are broadcast (at most 16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Documents (node and identity, 20 bytes) up to this number are broadcast to the texts.
BROADCAST_NODES = 1_000_000


def needed(a, b):
    """Least intersection of sets of sizes a and b with 100 * intersection >= 80 * union: ceil(4 (a + b) / 9)."""
    return (4 * (a + b) + 8) // 9


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Group counts as bytes, followed by what exceeds 255 in all groups together (four bytes)."""
    counts = np.bincount((shingles % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    over = np.maximum(counts - 255, 0).sum()
    return np.r_[np.minimum(counts, 255).astype(np.uint8), np.frombuffer(np.uint32(over).tobytes(), dtype=np.uint8)]


def cell_counts(docs: DataFrame) -> np.ndarray:
    """How often each hash cell of the shingle space occurs over all texts (``CELLS`` numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for data in byte_rows(batch.column(0)):
                total += np.bincount((shingle_set(data) >> np.uint64(48)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = rows.toPandas()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[table["cell"].to_numpy(dtype=np.int64)] = table["n"]
    return counts


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for cells of usual size, one more for each eighth of a doubling beyond the mean."""
    ratio = counts / max(counts.mean(), 1.0)
    return np.minimum(np.floor(8 * np.log2(np.maximum(ratio, 1))), 255).astype(np.uint8)


def prefix(shingles: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of the common order; two sets of Jaccard 0.8 share one of them."""
    n = len(shingles)
    size = n - (4 * n + 4) // 5 + 1
    spread = mix(shingles)
    order = np.lexsort((spread, level[(shingles >> np.uint64(48)).astype(np.int64)]))
    return shingles[order[:size]]


class CountTree:
    """R-tree over count vectors, packed bottom-up: points sorted by size, then by their heaviest groups."""

    def __init__(self, points: np.ndarray, over: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.points, self.over, self.sizes, self.component = points, over, sizes, component
        peaks = np.argsort(-points.astype(np.int16), axis=1, kind="stable")[:, :4]
        self.order = np.lexsort((*peaks.T[::-1], sizes))
        self.levels = []  # from leaves upwards: maxima, over, least size, component or -1
        top, o, s, c = (x[self.order] for x in (points, over, sizes, component))
        big = s
        while True:
            cuts = np.arange(0, len(s), FANOUT)
            top, o = np.maximum.reduceat(top, cuts), np.maximum.reduceat(o, cuts)
            low, high = np.minimum.reduceat(c, cuts), np.maximum.reduceat(c, cuts)
            s, big = np.minimum.reduceat(s, cuts), np.maximum.reduceat(big, cuts)
            c = np.where((low == high) & (low >= 0), low, -1)
            self.levels.append((top, o, s, big, c))
            if len(s) <= FANOUT:
                break

    def search(self, points, over, sizes, component) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (query, point, bound) for points of other components whose bound suffices."""
        for a in range(0, len(sizes), 128):
            q = np.arange(a, min(a + 128, len(sizes)))
            who = np.repeat(q, len(self.levels[-1][2]))
            node = np.tile(np.arange(len(self.levels[-1][2])), len(q))
            for depth in range(len(self.levels) - 1, -1, -1):
                top, o, s, big, c = self.levels[depth]
                fits = (c[node] != component[who]) & (5 * big[node] >= 4 * sizes[who]) & (5 * sizes[who] >= 4 * s[node])
                who, node = who[fits], node[fits]
                bound = _bounds(points, over, who, top, o, node)
                fits = bound >= needed(sizes[who], s[node])
                who, node = who[fits], node[fits]
                below = len(self.levels[depth - 1][2]) if depth else len(self.order)
                who = np.repeat(who, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                who, node = who[node < below], node[node < below]
            at = self.order[node]
            fits = self.component[at] != component[who]
            who, at = who[fits], at[fits]
            bound = _bounds(points, over, who, self.points, self.over, at)
            fits = bound >= needed(sizes[who], self.sizes[at])
            yield who[fits], at[fits], bound[fits]


def _bounds(a, a_over, i, b, b_over, j) -> np.ndarray:
    """Summed coordinate minima of rows i of a and j of b, in blocks of bounded size."""
    out = np.empty(len(i), dtype=np.int64)
    for k in range(0, len(i), 16_384):
        x, y = i[k : k + 16_384], j[k : k + 16_384]
        out[k : k + 16_384] = np.minimum(a[x], b[y]).sum(axis=1, dtype=np.int64) + np.minimum(a_over[x], b_over[y])
    return out


def _shard_pairs(shards: DataFrame, mode: str) -> DataFrame:
    """Distinct pairs ``a, b`` (a < b) of sets in one shard that the bound leaves; see the module text.

    Before mode ``all`` a set gets one nearest and one central partner at most, the best of all its shards.
    """

    def pairs_of(ids, central, component, vectors, left_of, right_of) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        points = vectors[:, :GROUPS]
        over = vectors[:, GROUPS:].copy().view(np.uint32)[:, 0].astype(np.int64)
        sizes = points.sum(axis=1, dtype=np.int64) + over
        q, t = np.flatnonzero(left_of), np.flatnonzero(right_of)
        two_blocks = not left_of[t].all()
        # nearest points are sought from either block, all pairs need one direction
        for q, t in [(q, t), (t, q)] if two_blocks and mode != "all" else [(q, t)]:
            tree = CountTree(points[t], over[t], sizes[t], component[t])
            near, best = np.full(len(q), -1), np.zeros(len(q))
            for who, at, bound in tree.search(points[q], over[q], sizes[q], component[q]):
                if mode == "all":
                    yield q[who], t[at], np.zeros(len(who)), 0
                    continue
                share = bound / (sizes[q[who]] + sizes[t[at]])
                order = np.lexsort((-ids[t[at]], share))
                who, at, share = who[order], at[order], share[order]
                near[who], best[who] = at, share  # the last one of each query is its best
            if mode != "all":
                has = near >= 0
                yield q[has], t[near[has]], best[has], 0
        if mode == "first":
            every = np.arange(len(ids))
            hub = np.full(len(ids), np.argmax(central))
            bound = _bounds(points, over, every, points, over, hub)
            fits = (every != hub) & (bound >= needed(sizes, sizes[hub]))
            yield every[fits], hub[fits], (bound / (sizes + sizes[hub]))[fits], 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            key, x, y, i, j = (table.column(k).to_numpy() for k in range(5))
            ids, central, component = (table.column(k).to_numpy() for k in (5, 6, 7))
            vectors = fixed_rows(table.column(8).combine_chunks(), GROUPS + 4)
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            found = []
            for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(key)].tolist(), strict=True):
                s = slice(a, b)
                if component[s].min() == component[s].max():
                    continue
                for p, q, share, kind in pairs_of(ids[s], central[s], component[s], vectors[s], i[s] == 1, j[s] == 1):
                    found.append((ids[s][p], ids[s][q], share, np.full(len(p), kind)))
            if found:
                p, q, share, kind = (np.concatenate(c) for c in zip(*found, strict=True))
                if mode == "all":
                    p, q = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0).T
                    share, kind = np.zeros(len(p)), np.zeros(len(p), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, q, share, kind)], names=["a", "b", "share", "kind"])

    # A shard of n points has ceil(n / SHARD) blocks; each pair of blocks is one group of rows.
    last = F.ceil(F.col("n") / SHARD).cast("int") - 1
    block = F.when(last == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), last + 1).cast("int"))
    rows = shards.withColumn("last", last).withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") <= F.col("other")).cast("int").alias("i"), (F.col("block") >= F.col("other")).cast("int").alias("j"),
        "id", "central", "component", "vector",
    )
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    pairs = rows.mapInArrow(run, "a bigint, b bigint, share double, kind bigint")
    if mode != "all":
        pairs = pairs.groupBy("a", "kind").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 23) -> Iterator[pa.Table]:
    """Tables of some MB that end where a (key, x, y) group ends."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, x, y = (table.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))
        if len(cut):
            yield table.slice(0, int(cut[-1]) + 1)
            held = table.slice(int(cut[-1]) + 1).to_batches()
        else:
            held = table.to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def parities(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of a power of two of hash cells, as bytes: about a bit for each shingle."""
    cells = max(64, 1 << int(len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8))


def least_apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many elements two sets differ at least, by their parities; the finer ones are folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _not_apart(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose parities leave Jaccard 0.8 open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            apart = np.array([least_apart(a, b) for a, b in zip(byte_rows(batch.column(4)), byte_rows(batch.column(5)), strict=True)], dtype=np.int64)
            keep = apart <= n + m - 2 * needed(n, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "oa", "ob")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _named(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, set`` of the sets that a pair names. Up to ``BROADCAST_NODES`` names go to the sets."""
    names = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if pairs.count() <= BROADCAST_NODES // 2:
        names = F.broadcast(names)
    return sets.select("node", "set").join(names, "node", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets reach Jaccard 0.8. Sets are joined twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(byte_rows(batch.column(2)), byte_rows(batch.column(3)), strict=True):
                a, b = (np.frombuffer(s.tobytes(), dtype=np.uint64) for s in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= 80 * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _node(shingles: np.ndarray) -> int | None:
    """64 bits of a digest of the set: equal sets are one node."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _measure(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """``doc_id, uid, tag, node, n_shingles, first, vector``: identity, node of the set, size, prefix, point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, firsts, vectors = [], [], [], []
            for data in byte_rows(batch.column(3)):
                shingles = shingle_set(data)
                nodes.append(_node(shingles))
                sizes.append(len(shingles))
                firsts.append(prefix(shingles, level).view(np.int64) if len(shingles) else np.empty(0, dtype=np.int64))
                vectors.append(count_vector(shingles).tobytes())
            columns = [*batch.columns[:3], pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(firsts, type=pa.list_(pa.int64())), pa.array(vectors, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "tag", "node", "n_shingles", "first", "vector"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *identity(), "text")
    return rows.mapInArrow(run, "doc_id bigint, uid bigint, tag int, node bigint, n_shingles bigint, first array<bigint>, vector binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, odd, set`` of the documents ``uid, tag, node`` that stand for their set: size, parities, shingles.

    Up to ``BROADCAST_NODES`` of them go to the texts; more meet them in a join of both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(data) for data in byte_rows(batch.column(1))]
            columns = [pa.array([len(s) for s in sets], type=pa.int64()), *(pa.array([x.tobytes() for x in c], type=pa.binary()) for c in (map(parities, sets), sets))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "n", "odd", "set"])

    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    # rows that repeat id and text are one document; only texts that are wanted move for that
    rows = docs.select(*identity(), "text").join(wanted, ["uid", "tag"]).dropDuplicates(["uid", "tag"])
    return rows.select("node", "text").mapInArrow(run, "node bigint, n bigint, odd binary, set binary")


def _shards(measured: DataFrame) -> DataFrame:
    """``key, n, node, central``: members of each set of nodes that share a prefix shingle.

    Keys of one node alone fall away in an aggregation; keys with the same members are one shard.
    """
    keyed = measured.select("node", F.explode("first").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    shared = materialize(shared, "shared-keys")
    small = shared.count() <= BROADCAST_KEYS
    members = keyed.join(F.broadcast(shared) if small else shared, "key").distinct()
    members = materialize(members, "members")
    kinds = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")
    )
    kinds = kinds.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key", "n")
    degree = members.groupBy("node").agg(F.count(F.lit(1)).alias("central"))
    shards = materialize(members.join(kinds, "key").join(degree, "node"), "shards")
    forget(shared, members)
    return shards


def _components(docs: DataFrame) -> DataFrame:
    """``doc_id, uid, tag, node, n_shingles, component`` for every row; null nodes have no component."""
    measured = materialize(_measure(docs, _levels(cell_counts(docs))), "measured", batch_rows=2000)
    members = _shards(measured)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "uid", "tag").alias("p")
    stand_in = measured.where("node is not null").groupBy("node").agg(F.min(F.struct(place, "vector")).alias("p"))
    stand_in = stand_in.select("node", "p.p.uid", "p.p.tag", "p.vector").join(members.select("node").distinct(), "node", "left_semi")
    stand_in = materialize(stand_in, "stand-ins")
    sizes = materialize(measured.drop("first", "vector"), "sizes")
    forget(measured)
    shards = members.join(stand_in.select("node", "vector"), "node").withColumnRenamed("node", "id")
    links, found, sets = [], None, None
    for mode in ("first", "next", "all"):
        if found is None:
            points = shards.withColumn("component", F.col("id"))
        else:
            points = shards.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        pairs = materialize(_shard_pairs(points, mode), f"pairs-{mode}")
        if sets is None:
            # The first pass pairs every set that the bound leaves a partner; only these go on.
            paired = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            sets = materialize(_sets(docs, stand_in.drop("vector").join(paired, "node")), "sets", batch_rows=1000)
            shards = materialize(shards.join(paired.withColumnRenamed("node", "id"), "id", "left_semi"), "paired-shards")
            forget(members, stand_in)
        else:
            forget(found)
        near = materialize(_not_apart(pairs, sets), f"near-{mode}", batch_rows=2000)
        forget(pairs)
        links.append(materialize(_verified(near, _named(sets, near)), f"links-{mode}", batch_rows=SET_ROWS))
        forget(near)
        found = materialize(components(reduce(DataFrame.unionByName, links)), "components")
    forget(shards, sets, *links)
    named = found.select(F.col("id").alias("node"), "component")
    rows = materialize(sizes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    forget(sizes, found)
    return rows


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the own one included.
    """
    rows = _components(docs)
    low = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("component is not null").join(low, "component")
    alone = rows.where("component is null").withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "n_shingles", "component_id")
    return linked.select(*columns).unionByName(alone.select(*columns))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents themselves, with all their columns: of each component the row of the smallest id.

    Texts without words stay. A component without ids keeps one of its rows.
    """
    rows = _components(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "uid", "tag")
    best = rows.where("component is not null").groupBy("component").agg(F.min(place).alias("p"))
    winners = best.select("component", F.col("p.uid").alias("uid"), F.col("p.tag").alias("tag"))
    copies = rows.join(winners.withColumnRenamed("component", "c"), ["uid", "tag"]).where("component = c")
    copies = copies.groupBy("uid", "tag").agg(F.count(F.lit(1)).alias("copies"))
    empty = rows.where("component is null").select("uid", "tag", F.lit(1).cast("bigint").alias("copies")).distinct()
    stay = materialize(copies.unionByName(empty), "stay")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # apart from the columns used here
    named, place = docs.select(row, *identity()), ["uid", "tag"]
    once = named.join(stay.where("copies = 1"), place, "left_semi")
    often = named.join(stay.where("copies > 1"), place, "left_semi").dropDuplicates(place)
    return once.unionByName(often).select("row.*")
