"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification.

A document is contaminated by a benchmark item if some stretch of its words lies within the allowed
word edit distance of the item (a quarter of the item's words). The CGK random walk maps a word
sequence to a longer one whose Hamming distance follows the edit distance; every window of an
item's length in a document is embedded and looked up in tables keyed by a few sampled positions
of the embedding. Embeddings are repeated until simulated pairs at the full allowed distance are
found with the target recall; what is found is verified by exact edit distance. Short items are
found without loss: of an item cut into one piece more than the allowed edits, one piece stays whole.
The allowed share of edits is the same for all lengths.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.llm.tables import discard, stored
from veduta.llm.wordhash import blocks, mix, words

#: Allowed edits as a share of an item's words, rounded down; items of fewer than SHORT words are found by pieces.
EDIT_SHARE, SHORT = 0.25, 12
#: Sampled positions in a table's key, tables per embedding, embeddings at most, target recall. Where
#: so many embeddings do not reach the recall, keys of that length have fewer positions.
SAMPLED, TABLES, MOST_EMBEDDINGS, RECALL = 3, 8, 128, 0.99
#: Lengths at which embeddings are counted, simulated pairs of each, and words of items with one count.
CALIBRATED, SIMULATED, TYPICAL = 12, 200, 64
#: Items, and words of them, searched for in one pass over the documents; bounds what is collected and broadcast.
ITEMS_AT_ONCE, WORDS_AT_ONCE = 20_000, 1_000_000
_GRAM_BITS = 20
#: Pairs of a place and a short item compared at once.
_PAIRS_AT_ONCE = 1 << 15
_FOLD = np.uint64(0x9E3779B97F4A7C15)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[i for i in range(128) if not chr(i).isalnum()]] = True
#: General punctuation, Latin-1 punctuation and no-break space in UTF-8.
_WIDE = re.compile(rb"\xe2[\x80\x81][\x80-\xbf]|\xc2[\xa0-\xbf]|\xe3\x80[\x80-\x9f]")


def _encode(text: str) -> bytes:
    data = text.lower().encode("utf-8", "surrogatepass")
    return data if text.isascii() else _WIDE.sub(b" ", data)


def word_hashes(texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) by block; words are runs of
    letters and digits, lower-cased."""
    for first, end, data, starts in blocks(texts, encode=_encode):
        value, _, _, row = words(data, starts, _SEPARATOR, lower=False)
        yield first, end, value, row


def allowed_edits(n: int) -> int:
    return int(n * EDIT_SHARE)


def _gram_size(n: int) -> int:
    return min(2, n)


def _grams(value: np.ndarray, q: int) -> np.ndarray:
    out = value if q == 1 else mix(value[:-1] * _FOLD + value[1:])
    return (out >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)


def embedding_keys(windows: np.ndarray, embeddings: range, sampled: int = SAMPLED) -> np.ndarray:
    """Table keys (windows x embeddings * TABLES) of equally long word-hash windows, of ``sampled`` positions each.

    At every step the walk emits the word it stands on, then moves on or stays by a random bit of
    (embedding, step, word); past the end it emits 0. Sampled steps lie within twice the window's
    length, where the walk's end is expected."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1)
    share = np.stack([np.random.default_rng(1000 + e).random((TABLES, SAMPLED))[:, :sampled] for e in embeddings])
    steps = (share * 2 * n).astype(int)  # embeddings x tables x samples
    number = np.array(embeddings, np.uint64)
    emitted = np.empty((count, *steps.shape), np.uint64)
    at, pointer = np.arange(count)[:, None], np.zeros((count, len(number)), np.int64)
    for j in range(int(steps.max()) + 1):
        symbol = padded[at, pointer]
        e, t, k = np.nonzero(steps == j)
        if len(e):
            emitted[:, e, t, k] = symbol[:, e]
        move = mix(symbol ^ mix(number * np.uint64(65537) + np.uint64(j + 1))) >> np.uint64(63)
        pointer = np.minimum(pointer + move.astype(np.int64), n)
    key = np.broadcast_to((number[:, None] * np.uint64(TABLES) + np.arange(TABLES, dtype=np.uint64)), emitted.shape[:3])
    for k in range(sampled):
        key = mix(key * _FOLD + emitted[..., k] + steps[..., k].astype(np.uint64))
    return key.reshape(count, -1)


def edit_distance_in(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least word edit distance of ``item`` to any stretch of ``region``, and that stretch's end."""
    row = np.zeros(len(region) + 1, np.int64)
    at = np.arange(len(region) + 1)
    for i, w in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (region != w))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - at) + at  # insertions, left to right
    end = int(row.argmin())
    return int(row[end]), end


def piece_bounds(n: int) -> list[int]:
    """Ends of an item's pieces, one more than its allowed edits."""
    many = allowed_edits(n) + 1
    return [n * k // many for k in range(many + 1)]


def _piece_keys(value: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each word on."""
    key = mix(value[: len(value) - size + 1] + np.uint64(size))
    for k in range(1, size):
        key = mix(key * _FOLD + value[k : len(value) - size + 1 + k])
    return key


def within(items: np.ndarray, regions: np.ndarray, edits: int) -> np.ndarray:
    """Whether each item (a row of words) lies within ``edits`` of a stretch of its region."""
    at = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(items), len(at)), np.int64)
    for i in range(items.shape[1]):
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != items[:, i : i + 1]))
        new = np.concatenate([np.full((len(items), 1), i + 1), new], axis=1)
        row = np.minimum.accumulate(new - at, axis=1) + at
    return row.min(axis=1) <= edits


@dataclass
class ItemIndex:
    """A bounded slice of the benchmark, indexed by word length."""

    ids: list[int]
    items: list[np.ndarray]
    #: Embeddings and sampled positions per length.
    embeddings: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: Per gram size a bitmap: bit k is set where an item of the k-th length (mod 64) has the gram.
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    #: Per length its bit, sorted table keys and their items.
    tables: dict[int, tuple[int, np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: Per piece size a bitmap: bit n is set where a short item of n words has the piece.
    seen: dict[int, np.ndarray] = field(default_factory=dict)
    #: Per (item length, piece size) the sorted pieces, their items and their places in them.
    pieces: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def build(self, recall: float) -> ItemIndex:
        by_length: dict[int, list[int]] = {}
        for i, words_ in enumerate(self.items):
            if len(words_):
                by_length.setdefault(len(words_), []).append(i)
        self._cut({n: by_length.pop(n) for n in sorted(by_length) if n < SHORT})
        self.embeddings = self._calibrated(by_length, recall)
        for k, (n, own) in enumerate(sorted(by_length.items())):
            seen = self.grams.setdefault(_gram_size(n), np.zeros(1 << _GRAM_BITS, np.uint64))
            for i in own:
                seen[_grams(self.items[i], _gram_size(n))] |= np.uint64(1 << k % 64)
            keys = self._keys(n, np.stack([self.items[i] for i in own]))
            flat, item = keys.ravel(), np.repeat(np.array(own), keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.tables[n] = k % 64, flat[order], item[order]
        return self

    def _keys(self, n: int, windows: np.ndarray) -> np.ndarray:
        many, sampled = self.embeddings[n]
        return embedding_keys(windows, range(many), sampled)

    def _cut(self, short: dict[int, list[int]]) -> None:
        """Indexes short items by their pieces."""
        for n, own in short.items():
            items, bounds = np.stack([self.items[i] for i in own]), piece_bounds(n)
            sizes: dict[int, list[int]] = {}
            for a, b in zip(bounds, bounds[1:], strict=False):
                sizes.setdefault(b - a, []).append(a)
            for size, places in sizes.items():
                keys = np.concatenate([_piece_keys(items[:, a : a + size].T, size)[0] for a in places])
                seen = self.seen.setdefault(size, np.zeros(1 << _GRAM_BITS, np.uint16))
                seen[keys >> np.uint64(64 - _GRAM_BITS)] |= np.uint16(1 << n)
                order = np.argsort(keys, kind="stable")
                self.pieces[n, size] = keys[order], np.tile(np.array(own), len(places))[order], np.repeat(np.array(places), len(own))[order]

    def short_places(self, value: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, short item, place) near which the row holds the item within the allowed distance."""
        for size, seen in self.seen.items():
            if len(value) < size:
                continue
            every = _piece_keys(value, size)
            mask = seen[every >> np.uint64(64 - _GRAM_BITS)]
            some = np.flatnonzero(mask)
            some = some[some + size <= row[np.searchsorted(row, some, "right")]]
            for n in range(SHORT):
                if (n, size) not in self.pieces:
                    continue
                keys, item, place = self.pieces[n, size]
                at = some[(mask[some] >> np.uint16(n)) & np.uint16(1) == 1]
                low = np.searchsorted(keys, every[at], "left")
                many = np.searchsorted(keys, every[at], "right") - low
                at, low, many = at[many > 0], low[many > 0], many[many > 0]
                ends = np.cumsum(many)
                first = 0
                while first < len(at):
                    before = ends[first] - many[first]
                    last = max(first + 1, int(np.searchsorted(ends, before + _PAIRS_AT_ONCE, "right")))
                    count = many[first:last]
                    hit = np.repeat(low[first:last] - (ends[first:last] - count - before), count) + np.arange(count.sum())
                    yield from self._near(n, item[hit], np.repeat(at[first:last], count), place[hit], value, row)
                    first = last

    def _near(self, n: int, item: np.ndarray, at: np.ndarray, place: np.ndarray, value: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        d = allowed_edits(n)
        r = np.searchsorted(row, at, "right") - 1
        start = at - place
        take = (start - d)[:, None] + np.arange(n + 2 * d)[None, :]
        inside = (take >= row[r][:, None]) & (take < row[r + 1][:, None])
        regions = np.where(inside, value[np.clip(take, 0, len(value) - 1)], np.uint64(0))
        close = within(np.stack([self.items[i] for i in item.tolist()]), regions, d)
        yield from zip(r[close].tolist(), item[close].tolist(), start[close].tolist(), strict=True)

    def _calibrated(self, by_length: dict[int, list[int]], recall: float) -> dict[int, tuple[int, int]]:
        """Per length the embeddings, and positions in a key, that find the target share of simulated
        pairs at the full allowed distance: measured at some lengths, none with an easier setting than
        a shorter one needs. The worst length of up to TYPICAL words decides for all of them, as
        the measure of a single one is rough."""
        random = np.random.default_rng(5)
        lengths = sorted(by_length)
        measured: dict[int, tuple[int, int]] = {}
        for n in (lengths[i] for i in np.unique(np.linspace(0, len(lengths) - 1, CALIBRATED).astype(int))) if lengths else ():
            measured[n] = self._embeddings_for(n, by_length[n], recall, random)
        hardness = lambda x: (-x[1], x[0])
        at, most = list(measured), list(accumulate(measured.values(), lambda x, y: max(x, y, key=hardness)))
        typical = max([e for n, e in measured.items() if n <= TYPICAL], default=(0, SAMPLED), key=hardness)
        return {n: max(typical, most[bisect_left(at, n)], key=hardness) for n in lengths}

    def _embeddings_for(self, n: int, own: list[int], recall: float, random: np.random.Generator) -> tuple[int, int]:
        """Embeddings and sampled positions that reach the recall on simulated pairs.

        With fewer positions in a key more windows meet an item by chance; the exact check sorts them out."""
        edited = []
        chosen = random.choice(own, SIMULATED)
        for i in chosen:
            w = list(self.items[i])
            for _ in range(allowed_edits(n)):
                kind, at = random.integers(3), random.integers(len(w))
                fresh = np.uint64(random.integers(1, 1 << 62))
                if kind == 0:
                    w[at] = fresh
                elif kind == 1:
                    w.insert(at, fresh)
                elif len(w) > 1:
                    del w[at]
            edited.append((w + [np.uint64(random.integers(1, 1 << 62)) for _ in range(n)])[:n])
        a, b = np.stack([self.items[i] for i in chosen]), np.array(edited, np.uint64)
        for sampled in range(SAMPLED, 0, -1):
            found = np.zeros(len(a), bool)
            for first in range(0, MOST_EMBEDDINGS, 8):
                some = range(first, min(first + 8, MOST_EMBEDDINGS))
                same = (embedding_keys(a, some, sampled) == embedding_keys(b, some, sampled)).reshape(len(a), len(some), TABLES).any(axis=2)
                for e, hit in zip(some, same.T, strict=True):
                    found |= hit
                    if found.mean() >= recall:
                        return e + 1 + (e + 2) // 2, sampled  # half as many more, as the measure is rough
        raise ValueError(f"{MOST_EMBEDDINGS} embeddings find {found.mean():.3f} of simulated pairs of {n} words, less than {recall:.3f}")

    def windows(self, value: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the windows that may lie within the allowed distance of an item.

        A stretch within d edits of an item of n words has n + d words at most and shares at least
        n - q + 1 - q * d of the item's q-grams. So some start of a window is skipped only where the
        n + d words from it hold fewer of the grams of that length's items. Grams are tested in a
        bitmap of fixed size, whose collisions only add windows."""
        last = np.repeat(row[1:], np.diff(row))
        for q, seen in self.grams.items():
            if len(value) < q:
                continue
            mask = seen[_grams(value, q)]
            some = np.flatnonzero(mask)
            some = some[some + q <= last[some]]
            mask = mask[some]
            for n, (bit, *_) in self.tables.items():
                if _gram_size(n) != q:
                    continue
                d = allowed_edits(n)
                own = some[(mask >> np.uint64(bit)) & np.uint64(1) == 1]
                least = n - q + 1 - q * d
                if len(own) < least:
                    continue
                first, final = own[: len(own) - least + 1], own[least - 1 :]
                close = (final - first <= n + d - q) & (last[first] == last[final])
                first, final = first[close], final[close]
                if not len(first):
                    continue
                begin = row[np.searchsorted(row, first, "right") - 1]
                low = np.maximum(begin, final - (n + d - q))
                many = first - low + 1
                start = np.unique(np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()))
                yield n, start[start + n <= last[start] + d]

    def looked_up(self, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share a table key."""
        _, keys, item = self.tables[n]
        own = self._keys(n, windows)
        low, high = np.searchsorted(keys, own.ravel(), "left"), np.searchsorted(keys, own.ravel(), "right")
        many = high - low
        spread = np.repeat(np.arange(len(many)), many)
        offset = np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)
        pair = np.unique((spread // own.shape[1]) * len(self.items) + item[low[spread] + offset])
        return pair // len(self.items), pair % len(self.items)

    def matches(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, distance, end word) for every text and item within the allowed distance."""
        parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        candidates: dict[tuple[int, int, int], list[int]] = {}
        for first, _, value, row in word_hashes(texts):
            any_here = False
            for n, start in self.windows(value, row):
                if len(start):
                    take = start[:, None] + np.arange(n)[None, :]
                    inside = take < row[np.searchsorted(row, start, "right")][:, None]
                    found.setdefault(n, []).append((len(parts), start, np.where(inside, value[np.minimum(take, len(value) - 1)], np.uint64(0))))
                    any_here = True
            for r, i, start in self.short_places(value, row):
                candidates.setdefault((len(parts), r, i), []).append(start)
                any_here = True
            if any_here:
                parts.append((first, value, row))
        for n, pieces in found.items():
            windows = np.concatenate([w for *_, w in pieces])
            part = np.repeat([p for p, *_ in pieces], [len(s) for _, s, _ in pieces])
            start = np.concatenate([s for _, s, _ in pieces])
            at_once = max(64, 30_000 // self.embeddings[n][0])
            for k in range(0, len(windows), at_once):
                w, item = self.looked_up(n, windows[k : k + at_once])
                for x, i in zip((w + k).tolist(), item.tolist(), strict=True):
                    row = parts[part[x]][2]
                    candidates.setdefault((int(part[x]), int(np.searchsorted(row, start[x], "right")) - 1, i), []).append(int(start[x]))
        for (p, r, i), places in sorted(candidates.items()):
            first, value, row = parts[p]
            n, d = len(self.items[i]), allowed_edits(len(self.items[i]))
            best: tuple[int, int] | None = None
            for a, b in _regions(sorted(places), n + 2 * d):
                a, b = max(int(row[r]), a - d), min(int(row[r + 1]), b + n + d)
                distance, end = edit_distance_in(self.items[i], value[a:b])
                if distance <= d and (best is None or distance < best[0]):
                    best = distance, a + end - int(row[r])
            if best:
                yield first + r, i, *best


def _regions(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of sorted places no more than ``gap`` apart."""
    first = before = places[0]
    for p in places[1:]:
        if p - before > gap:
            yield first, before
            first = p
        before = p
    yield first, before


_RESULT = "doc_id long, item_id long, item_words int, edit_distance int, end_word long"


def _search(docs: DataFrame, shared: Broadcast[ItemIndex]) -> DataFrame:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            ids, out = [int(x) if isinstance(x, str) else None for x in batch["doc_id"]], []
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for r, i, distance, end in index.matches(texts):
                out.append((ids[r], index.ids[i], len(index.items[i]), distance, end))
            named = pd.DataFrame(out, columns=["doc_id", "item_id", "item_words", "edit_distance", "end_word"])
            yield named.assign(doc_id=pd.array([o[0] for o in out], dtype="Int64"), item_id=pd.array([o[1] for o in out], dtype="Int64"))

    # Ids go as text, so that nulls among them do not turn the rest into floats.
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").where("text is not null").mapInPandas(search, _RESULT)


def _holds(text: Column, shared: Broadcast[ItemIndex]) -> Column:
    """Whether a text holds an item."""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts), bool)
            out[[r for r, *_ in shared.value.matches([t if isinstance(t, str) else None for t in texts])]] = True
            yield pd.Series(out)

    return holds(text)


def item_slices(benchmark: DataFrame, recall: float, at_once: int, words_at_once: int = WORDS_AT_ONCE) -> list[Callable[[], ItemIndex]]:
    """Loaders of the slices of a benchmark, of about ``at_once`` items and ``words_at_once`` words each at most."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    many, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    slices = max(1, -(-many // at_once), -(-total // words_at_once))

    def load(s: int) -> ItemIndex:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).orderBy("item_id", "text").collect()
        hashes = [value[row[k] : row[k + 1]] for _, end, value, row in word_hashes([r["text"] for r in own]) for k in range(len(row) - 1)]
        return ItemIndex([r["item_id"] for r in own], hashes).build(recall)

    return [lambda s=s: load(s) for s in range(slices)]


def contaminated(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """One row per (document, item) found: doc_id, item_id, item_words, edit_distance, end_word.

    edit_distance is the exact least word edit distance of the item to a stretch of the document,
    end_word the number of the document's words up to that stretch's end. Documents without a
    match have no row. Null or empty texts and items match nothing; repeated documents or items
    give rows each; a row without doc_id is searched and reported with a null doc_id. A benchmark
    of more than ``at_once`` items (or WORDS_AT_ONCE words) is searched for in several passes, one
    after the other, each of which reads the documents. Texts are not shuffled."""
    slices, out = item_slices(benchmark, recall, at_once), []
    for load in slices:
        shared = docs.sparkSession.sparkContext.broadcast(load())
        if len(slices) == 1:
            return _search(docs, shared)
        out.append(stored(_search(docs, shared)))
        shared.destroy()  # driver and executors hold one slice at a time
    return reduce(DataFrame.unionByName, out)


def decontaminated(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    Every row is judged by its own text in the task that reads it, without joins or shuffles, so
    rows without doc_id, or that share one, stay or go singly. Rows without text stay."""
    slices = item_slices(benchmark, recall, at_once)
    kept: DataFrame = docs
    for load in slices:
        shared = docs.sparkSession.sparkContext.broadcast(load())
        before, kept = kept, kept.where(~_holds(F.col("text"), shared))
        if len(slices) > 1:
            kept = stored(kept)
            shared.destroy()
            discard(before)
    return kept
