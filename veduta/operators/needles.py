"""Many needles in many texts: every position of a text is looked up in an index of all needles at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of needles in one index, which takes some five times as much; more needles make several, and as many passes.
PART_BYTES = 1 << 24
#: Positions of texts that are looked up at once.
LANE = 1 << 16
#: Hits that wait for being made distinct.
HITS = 1 << 22
#: Repeated keys up to this number are broadcast.
REPEATED = 100_000
_ODD = 0x9E3779B97F4A7C15


def _mix(words: Sequence[np.ndarray], odd: int) -> np.ndarray:
    """A hash of 64 bits of each row of numbers."""
    h = words[0] * np.uint64(odd)
    for w in words[1:]:
        h = ((h ^ (h >> np.uint64(29))) + w) * np.uint64(odd)
    return h


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts, with eight of padding, and where each text begins, then where the last ends."""
    if not len(texts):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary())
    _, offsets, held = texts.buffers()
    starts = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.zeros(starts[-1] - starts[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(held, np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def _slots(numbers: np.ndarray, shift: int) -> np.ndarray:
    return (numbers * np.uint64(_ODD) >> np.uint64(shift)).view(np.int64)


def _numbers(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a number; the last eight bytes only pad."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _at(numbers: np.ndarray, positions: np.ndarray, size: int) -> list[np.ndarray]:
    """The ``size`` bytes from each position on, as numbers of eight; the last ones overlap, and fewer than eight are one."""
    if size < 8:
        return [numbers[positions] & np.uint64((1 << 8 * size) - 1)]
    return [numbers[positions + k] for k in [*range(0, size - 8, 8), size - 8]]


class Needles:
    """An index of distinct needles, numbered as given.

    ``near`` has bits for the beginnings of needles of eight bytes and more by their hash, a bit for lengths of
    equal remainder, and so says which positions of a text are worth a look; shorter needles have a table for
    each length. ``by_size`` has the hashes of all needles of a length in order, their numbers and their bytes,
    with which every find is compared: hashes only lead to it."""

    def __init__(self, words: pa.Array, ranks: np.ndarray) -> None:
        self.words, self.ranks = words, ranks
        data, ends = _bytes(words)
        numbers = _numbers(data)
        sizes = np.diff(ends)
        self.by_size: dict[int, tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]] = {}
        self.tables: dict[int, np.ndarray] = {}
        self.shift = 64 - min(24, max(10, 3 + len(words).bit_length()))
        self.near = np.zeros(1 << 64 - self.shift, np.uint8)
        for size in np.unique(sizes[sizes > 0]).tolist():
            ids = np.flatnonzero(sizes == size)
            parts, odd = _at(numbers, ends[:-1][ids], size), _ODD
            while len(np.unique(hashes := _mix(parts, odd))) < len(ids):  # two needles of one hash: another one
                odd = (odd * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
            order = np.argsort(hashes)
            self.by_size[size] = odd, hashes[order], ids[order], [p[order] for p in parts]
            table = self.near if size >= 8 else self.tables.setdefault(size, np.zeros_like(self.near))
            np.bitwise_or.at(table, _slots(parts[0], self.shift), np.uint8(1 << size % 8))

    @classmethod
    def of(cls, needles: Sequence[bytes], ranks: Sequence[int]) -> Needles:
        return cls(pa.array(needles, pa.binary()), np.array(ranks, np.int64))

    def hits(self, texts: pa.Array | Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, needle), each pair once, sorted: which texts hold which needles."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        data, starts = _bytes(texts)
        numbers, ends = _numbers(data), starts[1:]
        pairs, waiting, limit = [np.zeros(0, np.int64)], 0, HITS
        for a in range(0, len(data) - 8, LANE):
            for found in self._lane(numbers, ends, a, min(a + LANE, len(data) - 8)):
                pairs.append(found)
                waiting += len(found)
            if waiting > limit:
                pairs = [np.unique(np.concatenate(pairs))]
                waiting = len(pairs[0])
                limit = 2 * waiting + HITS
        text, needle = np.divmod(np.unique(np.concatenate(pairs)), max(len(self.words), 1))
        keep = texts.is_valid().to_numpy(zero_copy_only=False)[text]
        return text[keep], needle[keep]

    def _lane(self, numbers: np.ndarray, ends: np.ndarray, a: int, b: int) -> Iterator[np.ndarray]:
        """text * needles + needle of every find that begins at positions ``a`` to ``b``."""
        here = numbers[a:b].copy()
        near, marks = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if any(size >= 8 for size in self.by_size):
            bits = self.near[_slots(here, self.shift)]
            near = np.flatnonzero(bits)
            marks = bits[near]
            near += a
        for size, (odd, hashes, ids, parts) in self.by_size.items():
            if size >= 8:
                at = near[(marks & np.uint8(1 << size % 8)) > 0]
            else:
                at = a + np.flatnonzero(self.tables[size][_slots(here & np.uint64((1 << 8 * size) - 1), self.shift)])
            at = at[at + size <= ends[-1]]
            if not len(at):
                continue
            words = _at(numbers, at, size)
            h = _mix(words, odd)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[place] == h
            at, place = at[same], place[same]
            same = np.logical_and.reduce([w[same] == p[place] for w, p in zip(words, parts, strict=True)])
            at, place = at[same], place[same]
            owner = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[owner]
            yield owner[inside] * len(self.words) + ids[place[inside]]


#: What the index was called when it was a table of states.
Automaton = Needles


def indexes(needles: DataFrame, needle: str, rank: str) -> Iterator[Broadcast]:
    """An index of each part: distinct non-empty needles in the order of their least rank.

    Parts are by hash and hold some ``PART_BYTES``; one at a time is at the driver."""
    rows = needles.where(F.coalesce(needle, F.lit("")) != "").groupBy(F.col(needle).alias("needle")).agg(F.min(F.col(rank).cast("long")).alias("rank"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()[0]
    parts = -(-held // PART_BYTES)
    for i in range(parts):
        part = rows.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == i) if parts > 1 else rows
        table = part.orderBy("rank", "needle").toArrow()
        words, ranks = (table.column(c).combine_chunks() for c in ("needle", "rank"))
        yield needles.sparkSession.sparkContext.broadcast(Needles(words.cast(pa.string()), ranks.to_numpy()))


def _found(texts: DataFrame, key: str, text: str, shared: list[Broadcast]) -> DataFrame:
    """(key, rank, needle): what each row of ``texts`` holds."""
    names, kind = [key, "rank", "needle"], texts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, rank long, needle string"
    out = texts.sparkSession.createDataFrame([], schema)
    for index in shared:

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text_at, needle_at = index.value.hits(b.column(1))
                found = [pa.array(index.value.ranks[needle_at]), index.value.words.take(pa.array(needle_at))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text_at)), *found], names=names)

        out = out.unionByName(texts.select(key, text).mapInArrow(search, schema))
    return out


def _counted(texts: DataFrame, key: str, text: str, shared: list[Broadcast]) -> DataFrame:
    """(key, rank, needle, needles): the first that each row of ``texts`` holds, and how many."""
    names, kind = [key, "rank", "needle", "needles"], texts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, rank long, needle string, needles long"
    out = texts.sparkSession.createDataFrame([], schema)
    for index in shared:

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text_at, needle_at = index.value.hits(b.column(1))
                holding, at, n = np.unique(text_at, return_index=True, return_counts=True)
                first, counts = np.full(b.num_rows, -1), np.zeros(b.num_rows, np.int64)
                first[holding], counts[holding] = needle_at[at], n
                best = pa.array(first, mask=first < 0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index.value.ranks).take(best), index.value.words.take(best), pa.array(counts)], names=names)

        out = out.unionByName(texts.select(key, text).mapInArrow(search, schema))
    return out


def needle_hits(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, rank: str) -> DataFrame:
    """(key, rank, needle): every needle that a text contains, once a row of ``texts``; null texts hold none.

    Plain substrings, compared as they are. One Arrow pass over the texts for each index that the words fill,
    broadcast. Needles that are equal count once, with their least rank; ranks may repeat."""
    return _found(texts, key, text, list(indexes(needles, needle, rank)))


def first_needles(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, rank: str) -> DataFrame:
    """One row per text key: ``rank`` and ``needle`` of the first rule that it holds (null: none), and how many
    different needles it holds. Rows of one key count together.

    A task counts for itself what a row holds; only keys of several rows have their finds shuffled."""
    shared = list(indexes(needles, needle, rank))
    several = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    n = several.limit(REPEATED + 1).count()
    best = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "needle"))).alias("_b")
    rows = texts.where(F.col(key).isNotNull())
    again = None
    if n:
        several = F.broadcast(several) if n <= REPEATED else several
        again, rows = rows.join(several, key, "left_semi"), rows.join(several, key, "left_anti")
    out = _counted(rows, key, text, shared).groupBy(key).agg(best, F.sum("needles").alias("needles"))
    if again is not None:
        out = out.unionByName(_found(again, key, text, shared).groupBy(key).agg(best, F.count_distinct("needle").alias("needles")))
    return texts.select(key).distinct().join(out, key, "left").select(key, F.col("_b.rank").alias("rank"), F.col("_b.needle").alias("needle"), F.coalesce("needles", F.lit(0)).alias("needles"))
