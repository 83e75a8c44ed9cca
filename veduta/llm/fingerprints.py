"""Document fingerprints from spot signatures: chains of content words behind common words.

A signature is an anchor (a common word) with the content words that follow it at fixed distance.
A fingerprint is the multiset of a text's signatures; texts are partitioned by the size of
that set, and sets are compared by a Jaccard similarity that stops once it cannot be reached.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta.llm.components import components
from veduta.llm.near_dedup import BLOCK, linked_within, spanning
from veduta.llm.tables import discard, stored
from veduta.llm.wordhash import blocks, mix, words

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which who will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer eines er es für hat ich im ist mit nach nicht noch oder sich sie sind über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos entre era esta este fue ha las lo los más me muy no nos o para pero por porque sin sobre su sus también y ya yo"
).split()
#: Content words of a chain, and the distance in content words from one to the next.
CHAIN, DISTANCE = 2, 1
#: Content words in a row behind which, until the next common word, every word is an anchor.
STRETCH = 8
#: Least similarity of near-duplicates.
LEAST = 0.75
#: Bytes of text of one range of ids.
RANGE_BYTES = 256 << 20
#: Most first keys of ranges that are broadcast (under 100 bytes each).
GUARDS = 500_000
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- signatures ------------------------------------------------------------------------------


@cache
def anchor_hashes(anchors: tuple[str, ...]) -> np.ndarray:
    (_, _, data, starts), *_ = blocks([" ".join(anchors)])
    return np.unique(words(data, starts, _SEPARATOR)[0])


def _folded(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for y in more:
        x = mix(x * _STEP + y)
    return x


def _elements(signatures: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set of 48-bit numbers: a signature's second occurrence is another element."""
    value = np.sort(signatures)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    again = np.arange(len(value)) - np.repeat(first, np.diff(np.append(first, len(value))))
    return np.unique(mix(value + again.astype(np.uint64) * _STEP) >> np.uint64(16))


def spot_signatures(texts: Sequence[str | None], anchors: Sequence[str] = ANCHORS, chain: int = CHAIN, distance: int = DISTANCE) -> Iterator[np.ndarray]:
    """Per text its elements: chains of ``chain`` content words behind every anchor.

    Words are runs of ASCII letters and digits and of other characters than ASCII, A-Z lower-cased.
    Tables and lists have few common words, so from STRETCH content words in a row on the following ones are anchors
    too. Where no anchor has a whole chain (texts of few words) every word is an anchor, followed by the next
    words; with no more than ``chain`` words the whole sequence is the one signature. Null, empty and
    wordless texts have none."""
    known = anchor_hashes(tuple(anchors))
    for first, end, data, starts in blocks(texts):
        value, _, _, row = words(data, starts, _SEPARATOR)
        common = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
        content = np.flatnonzero(~common)
        place = np.arange(len(value))
        row_of = np.searchsorted(row, place, side="right") - 1
        before = np.maximum(np.maximum.accumulate(np.where(common, place, -1)), row[row_of] - 1)
        spots = np.flatnonzero(common | (place - before > STRETCH))
        start = np.searchsorted(content, spots, side="right") + distance - 1  # the first content word of the chain
        last = start + (chain - 1) * distance
        inside = last < len(content)
        inside[inside] = row_of[content[last[inside]]] == row_of[spots[inside]]
        spots, start = spots[inside], start[inside]
        signature = _folded(value[spots], *[value[content[start + k * distance]] for k in range(chain)])
        cut = np.searchsorted(spots, row)
        for i in range(end - first):
            own = signature[cut[i] : cut[i + 1]]
            if not len(own):
                text = value[row[i] : row[i + 1]]
                if len(text) > chain:
                    own = _folded(text[: len(text) - chain], *[text[k : len(text) - chain + k] for k in range(1, chain + 1)])
                elif len(text):
                    own = _folded(np.array([len(text)], np.uint64), *[text[k : k + 1] for k in range(len(text))])
            yield _elements(own)


def encoded(elements: np.ndarray) -> str:
    """The fingerprint as text: the elements in order, eight base64 characters each."""
    return base64.b64encode(elements.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).copy().view(">u8").ravel().astype(np.uint64)


# --- comparison ------------------------------------------------------------------------------


def length_partition(size: Column | int, least: float = LEAST) -> Column | int:
    """Sizes whose ratio can reach ``least`` lie in the same or in neighbouring partitions."""
    step = math.log(1 / least)
    return math.floor(math.log(size) / step) if isinstance(size, int) else F.floor(F.log(size.cast("double")) / step).cast("int")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0, piece: int = 512) -> float:
    """Jaccard similarity of two sets of elements, or 0 if it is below ``least``; two empty sets are alike.

    Sets whose sizes differ too much are not compared, and the comparison of sorted pieces stops
    when the rest cannot reach ``least`` any more."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    common, needed = 0, least / (1 + least) * (len(a) + len(b))  # |A & B| where the similarity is least
    piece = piece if least > 0 else len(a)
    for k in range(0, len(a), piece):
        part = a[k : k + piece]
        at = np.minimum(np.searchsorted(b, part), len(b) - 1)
        common += int((b[at] == part).sum())
        if common + len(a) - k - len(part) < needed - 1e-9:
            return 0.0
    alike = common / (len(a) + len(b) - common)
    return alike if alike >= least else 0.0


def similar_sets(payloads: list[bytes], least: float = LEAST) -> np.ndarray:
    """Labels under the pairs of fingerprints whose likeness reaches ``least``; shorter sets come first, so
    that each is compared with those that are not too long only."""
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    label, left, right = np.arange(len(sets)), [], []
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if least * len(sets[j]) > len(sets[i]):
                break
            if label[i] != label[j] and likeness(sets[i], sets[j], least):
                left.append(i)
                right.append(j)
                label[label == label[j]] = label[i]
    return spanning(len(sets), np.array(left, np.int64), np.array(right, np.int64))


def near_classes(docs: DataFrame, least: float = LEAST, anchors: Sequence[str] = ANCHORS) -> DataFrame:
    """One row per document: doc_id, n_signatures, component_id, kept.

    Documents are linked if the likeness of their fingerprints is ``least`` or more; component_id is
    the least doc_id reachable. Texts without words link with nothing. Equal fingerprints are
    compared once. A pair that is alike shares one of the rarest elements of both and lies in
    the same or neighbouring length partitions; only such pairs meet. Rows without doc_id have null
    components and are kept; a doc_id that repeats has the links of all its rows."""
    anchors = tuple(anchors)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(spot_signatures([t if isinstance(t, str) else None for t in b["text"]], anchors))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "size": [len(s) for s in sets], "elements": [s.view(np.int64) for s in sets]})

    # Rows without an id travel apart, so that ids stay longs in pandas.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, size long, elements array<long>"
    signed = stored(texts.where("doc_id is not null").mapInPandas(sign, schema))
    digest = signed.select("doc_id", "size", F.sha2(F.array_join("elements", ",").cast("binary"), 256).alias("digest"))
    classes = digest.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = stored(digest.join(classes, "digest", "left").select("doc_id", "size", "digest", F.coalesce("rep", "doc_id").alias("rep")))
    firsts = members.where("size > 0 and doc_id = rep").select("doc_id", "digest").distinct()
    named = signed.withColumn("digest", F.sha2(F.array_join("elements", ",").cast("binary"), 256))
    sets = stored(named.join(firsts, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).drop("digest"))

    # The rarest elements of a set, as many as one of them must be shared.
    each = sets.select("doc_id", "size", F.explode("elements").alias("element"))
    often = each.groupBy("element").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = each.join(often, "element").groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("e"))
    # Elements in one set only are the rarest of all and meet nobody.
    needed = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1 - (F.col("size") - F.size("e"))
    prefix = ordered.where(needed > 0).select("doc_id", "size", F.explode(F.slice("e", F.lit(1), needed.cast("int"))).alias("e"))
    place = length_partition(F.col("size"), least)
    keyed = prefix.select("doc_id", F.explode(F.array(place, place + 1)).alias("p"), F.col("e.element").alias("element"))
    grouped = keyed.select("doc_id", F.xxhash64("p", "element").alias("grp")).distinct()
    sizes = grouped.groupBy("grp", F.pmod("grp", F.lit(1)).alias("_z")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = stored(grouped.join(sizes.select("grp", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "grp"))
    payload = sets.select("doc_id", F.col("elements"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(payload=[np.asarray(e, np.int64).tobytes() for e in b["elements"]])[["doc_id", "payload"]]

    rows = placed.join(payload.mapInPandas(packed, "doc_id long, payload binary"), "doc_id")
    links = linked_within(rows, lambda group: similar_sets(group, least))
    ties = members.where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    several = members.groupBy("doc_id").agg(F.count_distinct("rep").alias("n")).where("n > 1").select("doc_id")
    reached = components(links.unionByName(ties.join(several, F.col("u") == F.col("doc_id"), "left_semi")))
    discard(signed, sets, placed)
    component = F.coalesce("component", "rep")
    out = members.join(reached, F.col("rep") == F.col("node"), "left")
    named = out.select("doc_id", F.col("size").alias("n_signatures"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    lost = texts.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInPandas(sign, schema)
    none = F.lit(None).cast("long")
    return named.unionByName(lost.select(none.alias("doc_id"), F.col("size").alias("n_signatures"), none.alias("component_id"), F.lit(True).alias("kept")))


# --- documents beside their next -------------------------------------------------------------


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) of every row, in the order of doc_id; after the last comes the first.

    Rows are dealt to ranges of (doc_id, hash of the text), whose bounds come from a sample of the
    keys, about one range for ``RANGE_BYTES`` of text and four for each shuffle partition; the first row
    of each range is also put behind the range before, so no row looks beyond its range. Texts are
    shuffled once. Null ids come last, rows of one doc_id by a hash of their texts; null texts count as
    empty. What a range table costs the driver is one key a range."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    keys = stored(keyed.select("doc_id", "h", F.octet_length("text").alias("size")))
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["size"] // RANGE_BYTES))
    rate = min(1.0, 20 * ranges / max(1, total["n"]))
    hit = F.pmod(F.xxhash64(F.lit("range"), "doc_id", "h"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1
    order = lambda k: (k[0] is None, 0 if k[0] is None else k[0], k[1])
    sample = sorted({order(r) for r in keys.where(hit).select("doc_id", "h").distinct().toLocalIterator()})
    bounds = spark.sparkContext.broadcast(sample[:: max(1, len(sample) // ranges)])

    @F.pandas_udf("int")
    def range_of(missing: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds.value, (bool(m), 0 if m else i, h)) for m, i, h in zip(missing, ids, hashes, strict=True)], dtype="int32")

    # A missing id goes in as that of a flag, since pandas would turn longs with nulls into doubles.
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = F.lit("" if kind == "string" else 0).cast(kind)
    at = range_of(F.col("doc_id").isNull(), F.coalesce("doc_id", some), F.col("h"))
    first = keys.select("doc_id", "h", at.alias("at")).groupBy("at").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    heads = sorted((r["at"], r["k"]["doc_id"], r["k"]["h"]) for r in first.collect()) if total["n"] else []
    before = [(heads[i - 1][0], *heads[i][1:]) for i in range(len(heads))]
    guards = spark.createDataFrame(before, f"range int, guard_id {kind}, guard_h long")
    guards = F.broadcast(guards) if len(before) <= GUARDS else guards  # else texts are shuffled a second time
    found = keyed.join(guards, F.col("doc_id").eqNullSafe(F.col("guard_id")) & (F.col("h") == F.col("guard_h"))).groupBy("range", "doc_id", "h").agg(F.first("text").alias("text"))
    every = keyed.select(at.alias("range"), "doc_id", "h", "text", F.lit(False).alias("guard")).unionByName(found.withColumn("guard", F.lit(True)))
    window = Window.partitionBy("range").orderBy("guard", F.col("doc_id").asc_nulls_last(), "h", "text")
    return every.withColumn("next_text", F.lead("text").over(window)).where(~F.col("guard")).select("doc_id", "text", "next_text")


def edited_text(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) is replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's with its last half replaced by the start of the next document's
    (``with_next_text``: a single row is its own next). Likenesses compare whole fingerprints. A null or empty
    text has an empty fingerprint, which is like another empty one (1) and unlike any other
    (0). Repeated rows each count as a document; other columns are ignored."""
    anchors = tuple(anchors)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, following = b.column(1).to_pylist(), b.column(2).to_pylist()
            edited = [edited_text(t, f) for t, f in zip(texts, following, strict=True)]
            each = {t: k for k, t in enumerate(dict.fromkeys([*texts, *following]))}
            sets = list(spot_signatures(list(each), anchors, chain, distance))
            new = list(spot_signatures(edited, anchors, chain, distance))
            own = [sets[each[t]] for t in texts]
            columns = {
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([encoded(s) for s in own], pa.string()),
                "edited_fingerprint": pa.array([encoded(s) for s in new], pa.string()),
                "near_edited": pa.array([likeness(s, e) for s, e in zip(own, new, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(s, sets[each[f]]) for s, f in zip(own, following, strict=True)], pa.float64()),
            }
            yield pa.RecordBatch.from_arrays([b.column(0), *columns.values()], names=["doc_id", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next_text(docs).mapInArrow(fingerprint, schema)
