"""Groups of spelling variants over a bit-sliced position index.

Words are counted in one pass over the texts. The vocabulary then becomes bitsets, one for each position and
letter, with a bit for each word. A word is looked up by walking its letters: two sets of words are carried
along, those equal so far and those with one error so far, and every step is a few operations on whole machine
words. Substitutions stay at their position; an inserted letter reads the bitset one position further on. Words
of length m meet those of m and of m + 1, and what is found counts for both.

The index is cut into parts so that two near words share one: an error lies in the first or in the second half of
the shorter word, so the other half is the same in both. Halves are dealt to buckets by hash. A bucket too large
for a task becomes a grid of cells, each with some words as queries and some as index, so one half that most
words share is still spread, and no cell is larger than a bound.

Defined results
    null text       no words; the same for texts without a run that is long enough
    null doc_id     prints as nothing before the colon
    long texts      are cut between words, never inside one, and read whole
    repeated rows   count each time
    ties            of near words that occur equally often the first in code-point order is the form
    empty table     no rows
    other columns   are not read
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm import arrays
from docflow.runtime import materialize

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One in so many words of a document, by its hash, loses a letter.
ONE_IN = 97
#: Bytes and texts counted at a time; letters in a bucket on average, and in a part of one that is cut into cells.
SLICE, TEXTS, BUCKET, PART = 8 << 20, 1 << 16, 1 << 17, 1 << 19
#: Machine words of a set times queries looked up together; bytes of bitsets kept between batches of queries.
TOGETHER, KEEP = 1 << 16, 64 << 20

#: U+00C0 to U+00FF are this byte and a continuation.
_LEAD = 0xC3
_ASCII = arrays._is(*range(65, 91), *range(97, 123))
#: After any of these bytes a text can be cut without cutting a word.
_BETWEEN = ~arrays._is(*range(65, 91), *range(97, 123), *range(0x80, 0xC0), _LEAD)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: Words of up to so many bytes have their hash put together from the hash of the id and their own.
_SHORT = 64


def _shifted(crcs: np.ndarray) -> np.ndarray:
    """What each hash becomes by 0 to ``_SHORT`` bytes of zeros: a row for each number of bytes."""
    out = np.empty((_SHORT + 1, len(crcs)), dtype=np.uint32)
    out[0] = crcs
    for k in range(_SHORT):
        out[k + 1] = (out[k] >> 8) ^ _CRC[out[k] & 0xFF]
    return out


def _runs(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts of the runs of at least ``least`` letters, their lengths in bytes, and the runs in lower case."""
    lead = data == _LEAD
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = letter
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    leads = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(lead, out=leads[1:])
    long = (ends - starts) - (leads[ends] - leads[starts]) >= least
    starts, ends = starts[long], ends[long]
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    edges[starts] = 1
    edges[ends] = -1
    kept = arrays.LOWER[data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return starts, ends - starts, words


def _counted(ids: list, at: list[int], data: np.ndarray, least: int, one_in: int) -> pa.RecordBatch:
    """``word, n`` of some texts; ``at`` has the place in ``data`` where the text of each id begins."""
    starts, sizes, runs = _runs(data, least)
    coded = runs.dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    own = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint32)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    doc = np.searchsorted(at, starts, "right") - 1
    hashes = _shifted(before)[np.minimum(sizes, _SHORT), doc] ^ own[code]
    for k in np.flatnonzero(sizes > _SHORT):
        hashes[k] = zlib.crc32(words[code[k]].encode(), int(before[doc[k]]))
    changed = hashes % one_in == 0
    counts = np.bincount(code[~changed], minlength=len(words))
    others: Counter[str] = Counter()
    for k in np.flatnonzero(changed):
        word = words[code[k]]
        drop = int(hashes[k]) % len(word)
        if len(word) > least:
            others[word[:drop] + word[drop + 1 :]] += 1
    seen = np.flatnonzero(counts)
    return pa.record_batch(
        [
            pa.concat_arrays([coded.dictionary.take(pa.array(seen)), pa.array(list(others), pa.string())]),
            pa.array(np.concatenate([counts[seen], np.fromiter(others.values(), np.int64, len(others))])),
        ],
        names=["word", "n"],
    )


def _count_words(least: int, one_in: int):
    space = np.array([32], dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        at: list[int] = []
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), arrays.byte_rows(batch.column(1)), strict=True):
                for start, end in arrays.segments(text, _BETWEEN):
                    ids.append(doc_id)
                    at.append(size)
                    parts += [text[start:end], space]
                    size += end - start + 1
                    if size >= SLICE or len(ids) >= TEXTS:
                        yield _counted(ids, at, np.concatenate(parts), least, one_in)
                        ids, at, parts, size = [], [], [], 0
        if size:
            yield _counted(ids, at, np.concatenate(parts), least, one_in)

    return run


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, one_in: int = ONE_IN,
) -> DataFrame:
    """``word, n``: words of at least so many letters that occur at least so often in all texts."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    counts = source.mapInArrow(_count_words(least_letters, one_in), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets of words of one length: for each position and letter, which words have it there."""

    def __init__(self, letters: np.ndarray):
        self.n, self.length = letters.shape
        self.width = -(-self.n // 64)
        self.known = np.unique(letters)
        #: Row of a letter in a position's table; the last row is empty, for letters that no word has.
        self.row = np.full(256, len(self.known), dtype=np.intp)
        self.row[self.known] = np.arange(len(self.known))
        self._letters = letters
        self._kept: dict[int, np.ndarray] = {}
        self._room = KEEP // max(1, (len(self.known) + 1) * self.width * 8)

    def bits(self, flags: np.ndarray) -> np.ndarray:
        """Rows of flags, one for each word, as rows of machine words."""
        wide = np.zeros((len(flags), self.width * 64), dtype=bool)
        wide[:, : self.n] = flags
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        table = self._kept.get(position)
        if table is None:
            table = np.zeros((len(self.known) + 1, self.width), dtype=np.uint64)
            table[:-1] = self.bits(self._letters[:, position] == self.known[:, None])
            if len(self._kept) < self._room:
                self._kept[position] = table
        return table

    def everything(self, queries: int) -> np.ndarray:
        return np.repeat(self.bits(np.ones((1, self.n), dtype=bool)), queries, axis=0)

    def one_replaced(self, queries: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Sets of the words that differ from each query of their length in one letter; ``own`` is its bit or -1."""
        equal = self.everything(len(queries))
        mine = np.flatnonzero(own >= 0)
        bit = own[mine]
        equal[mine, bit // 64] &= ~(np.uint64(1) << (bit % 64).astype(np.uint64))
        one = np.zeros_like(equal)
        for j in range(self.length):
            here = self.at(j)[self.row[queries[:, j]]]
            one &= here
            one |= equal & ~here
            equal &= here
            if j % 4 == 3 and not (equal.any() or one.any()):
                break
        return one

    def one_inserted(self, queries: np.ndarray) -> np.ndarray:
        """Sets of the words that have one letter more than each query and are equal otherwise."""
        equal = self.everything(len(queries))
        one = np.zeros_like(equal)
        for j in range(self.length - 1):
            rows = self.row[queries[:, j]]
            one |= equal
            one &= self.at(j + 1)[rows]
            equal &= self.at(j)[rows]
            if j % 4 == 3 and not (equal.any() or one.any()):
                return one
        return one | equal


def set_bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all bits that are set."""
    row, word = np.nonzero(sets)
    flags = np.unpackbits(sets[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(flags)
    return row[k], word[k] * 64 + bit


def _letters(words: list[str]) -> np.ndarray:
    """One byte for each letter, a row for each word; all words have one length."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def _near_pairs(cell: pa.Table) -> pa.Table:
    """``word, near, near_n`` in both directions for the near words of a cell, each pair in one cell alone."""
    words = np.array(cell.column("word").to_pylist(), dtype=object)
    kind, longer, asked = (cell.column(c).to_numpy() for c in ("kind", "longer", "asked"))
    order = np.argsort(kind, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0, True])
    lefts, rights = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        rows = order[start:end]
        of_prefix, half = kind[rows[0]] % 2 == 0, int(kind[rows[0]] // 2) // 2
        queries = rows[asked[rows] != 0]
        held = rows[(asked[rows] != 1) & ~longer[rows]]
        held_longer = rows[longer[rows]]
        if not len(queries):
            continue
        q = _letters(words[queries].tolist())
        for index_rows, inserted in ((held, False), (held_longer, True)):
            if not len(index_rows) or (not inserted and np.array_equal(index_rows, queries) and len(queries) < 2):
                continue
            w = _letters(words[index_rows].tolist())
            index = PositionIndex(w)
            place = {x: k for k, x in enumerate(words[index_rows])} if not inserted else {}
            step = max(1, TOGETHER // index.width)
            for k in range(0, len(queries), step):
                some = q[k : k + step]
                if inserted:
                    found = index.one_inserted(some)
                else:
                    own = np.array([place.get(x, -1) for x in words[queries[k : k + step]]], dtype=np.int64)
                    found = index.one_replaced(some, own)
                a, b = set_bits(found)
                # Where the first halves are equal the pair belongs to the bucket of the first half, else of the second.
                same = (some[a, :half] == w[b, :half]).all(1)
                mine = same if of_prefix else ~same
                a, b = queries[k + a[mine]], index_rows[b[mine]]
                lefts += [a, b] if inserted else [a]
                rights += [b, a] if inserted else [b]
    left, right = pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))
    return pa.table(
        {"word": cell.column("word").take(left), "near": cell.column("word").take(right), "near_n": cell.column("n").take(right)}
    )


def _cells(words: DataFrame, bucket: int, part: int) -> DataFrame:
    """``bucket, i, j, kind, longer, asked, word, n``: every word in the cells of its halves.

    ``kind`` is twice the length of the shorter word of a pair, plus one for second halves; a word takes part with
    its own length and, as the longer one, with the length below. ``asked``: 0 as index, 1 as query, 2 as both.
    """
    m = F.length("word")
    total = words.agg(F.coalesce(F.sum(F.length("word").cast("bigint")), F.lit(0))).first()[0]
    halves = []
    for longer in (False, True):
        short = m - int(longer)
        for second in (0, 1):
            first = F.floor(short / 2).cast("int")
            half = F.right(F.col("word"), short - first) if second else F.left(F.col("word"), first)
            halves.append(F.struct((2 * short + second).cast("int").alias("kind"), F.lit(longer).alias("longer"), half.alias("half")))
    rows = words.select("word", "n", F.explode(F.array(*halves)).alias("h")).select("word", "n", "h.*")
    buckets = max(1, -(-4 * total // bucket))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("kind", "half"), F.lit(buckets))).drop("half")
    # At most 4 x letters / part buckets of 16 bytes are large: 8 MB for 64 billion letters of words.
    large = rows.groupBy("bucket").agg(F.sum(F.length("word").cast("bigint")).alias("letters"), F.count(F.lit(1)).alias("members"))
    large = large.where(F.col("letters") > part)
    large = large.select("bucket", F.least(F.ceil(F.col("letters") / part), "members").cast("int").alias("parts"))
    rows = rows.join(F.broadcast(materialize(large, "large-buckets")), "bucket", "left")
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("word"), parts).cast("int")

    def place(i, j, asked: int):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(asked).alias("asked"))

    zero, others = F.lit(0), F.sequence(F.lit(0), parts - 1)
    whole = F.array(F.when(F.col("longer"), place(zero, zero, 0)).otherwise(place(zero, zero, 2)))
    held = F.transform(others, lambda k: place(k, mine, 0))
    asks = F.when(F.col("longer"), F.array().cast("array<struct<i:int,j:int,asked:int>>")).otherwise(F.transform(others, lambda k: place(mine, k, 1)))
    at = F.when(parts == 1, whole).otherwise(F.concat(held, asks))
    return rows.select("bucket", "kind", "longer", "word", "n", F.explode(at).alias("p")).select("*", "p.*").drop("p")


def near_words(words: DataFrame, bucket: int = BUCKET, part: int = PART) -> DataFrame:
    """``word, near, near_n``: every two of the distinct words that differ by one letter, in both directions.

    Words hold letters up to U+00FF alone.
    """
    cells = _cells(words, bucket, part)
    return cells.groupBy("bucket", "i", "j").applyInArrow(_near_pairs, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form. Pointers double, so a chain of 2**k steps takes k rounds;
    as counts double with each step, chains are shorter than the logarithm of the largest count."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        state = step.select("word", "root")
        if step.where("moved").isEmpty():
            return state


def group_variants(docs: DataFrame, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the vocabulary of ``docs``; options as in ``vocabulary``.

    A word's form is its most frequent near word, if that occurs at least twice as often; its root is the last word
    that forms lead to, the word itself without a form.
    """
    words = materialize(vocabulary(docs, **options), "vocabulary")
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    rows = words.join(near, "word", "left")
    often = -F.col("best.minus") >= 2 * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n"),
    )
    rows = materialize(rows, "forms")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
