"""MinHash near-dedup with sequential Bayesian verification.

Whole texts become sets of five-word shingles. Texts that are equal as word sequences form a class
and are represented by their least doc_id; everything below runs on representatives.

1. Signatures of HASHES minhashes; BANDS bands of ROWS minhashes are bucket keys. A pair of Jaccard
   similarity 0.75 shares no bucket with probability (1 - 0.75**5)**32 = 2e-4.
2. In every bucket the pairs' signatures are compared in batches. After a batch a pair is pruned if
   the posterior probability that its similarity reaches the threshold is below MISS. What
   survives connects candidate clusters; only spanning edges leave a task, never all pairs.
3. Texts of candidate clusters are fetched once and compared exactly on full shingle sets, again
   keeping spanning edges of true links only, which the components of all links need.

A bucket or cluster of BLOCK members (or BLOCK_SHINGLES) at most is one task's group. A larger one
is first compared with HUBS of its members; what is linked through them needs no more comparing,
as only components count. The members outside its largest component are then compared with all its
members, in blocks dealt to many tasks. So a family of near copies that holds a third of all rows
costs rows in proportion to its size, and no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veduta.llm.components import components
from veduta.llm.tables import discard, stored, without
from veduta.llm.wordhash import mix, shingle_sets

SHINGLE_WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Minhashes compared between two looks at the posterior, and the probability of pruning a link.
BATCH, MISS = 32, 1e-5
BLOCK, BLOCK_SHINGLES = 512, 1_500_000
#: Members of a large group that all others are compared with first, and rows compared at once.
HUBS, CHUNK = 3, 256

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minhashes of a non-empty set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        out = np.minimum(out, (x[None, k : k + 512] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _digest(word_hashes: np.ndarray) -> tuple[int, int]:
    at = np.arange(len(word_hashes), dtype=np.uint64)
    one, two = mix(word_hashes + mix(at)), mix((word_hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * (np.uint64(2) * at + np.uint64(1)))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int((two.sum(dtype=np.uint64) + np.uint64(len(at))).view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the word sequence, band keys and signature (16 bits a minhash)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            n, d1, d2, bands, signs = [], [], [], [], []
            for _, shingles, own in shingle_sets(texts, SHINGLE_WORDS):
                n.append(len(shingles))
                a, b = _digest(own)
                d1.append(a)
                d2.append(b)
                signature = minhash(shingles) if len(shingles) else None
                bands.append(None if signature is None else band_keys(signature))
                signs.append(None if signature is None else signature.astype(np.uint16).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_shingles": n, "d1": d1, "d2": d2, "bands": bands, "signature": signs})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInPandas(sign, _SIGNATURE)


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """For 1, 2, ... batches the fewest matches at which P(similarity >= threshold) is ``miss``.

    The similarity has a uniform prior; m matches in n give a Beta(1 + m, 1 + n - m) posterior."""
    s = np.linspace(0, 1, 20001)[1:-1]
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= percent / 100].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def surviving_pairs(signature: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left[i], right[i]) those that no batch prunes."""
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches()):
        part = signature[:, k * BATCH : (k + 1) * BATCH]
        matches = matches + (part[left] == part[right]).sum(axis=1)
        kept = matches >= least
        left, right, matches = left[kept], right[kept], matches[kept]
        if not len(left):
            break
    return left, right


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each node's component under the pairs given."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def exact_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with 100 * intersection >= PERCENT * union, on full sets.

    Intersections are products of 0/1 matrices over the shingles that two sets at least share,
    taken in slices of bounded size."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(value)))
    column = np.cumsum(first) - 1
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), np.float64)
    width = max(1, 2_000_000 // n)
    total = int(column.max()) + 1 if len(column) else 0
    edge = np.searchsorted(column, np.arange(0, total + width, width))
    for k in range(len(edge) - 1):
        part = np.zeros((n, width), np.float32)
        own = slice(edge[k], edge[k + 1])
        part[owner[own], column[own] - k * width] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    linked = (100 * common >= PERCENT * union) & (size[:, None] > 0) & (size[None, :] > 0)
    return np.nonzero(np.triu(linked, 1))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal keys in batches sorted by key, also across batch borders."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        key = batch[keys].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        bounds = [0, *cut.tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield batch.iloc[a:b]
        rest = batch.iloc[bounds[-1] :]
    if rest is not None and len(rest):
        yield rest


def _star(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    moved = np.flatnonzero(ids != ids[label])
    return pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]})


def linked_within(rows: DataFrame, compare: Callable[[list], np.ndarray]) -> DataFrame:
    """(u, v) spanning the links inside every group of ``rows`` (grp, doc_id, payload, blocks).

    ``compare`` labels a list of payloads with the least index linked to each; ``blocks`` is the
    number of bounded blocks that a group needs, 1 for most."""

    def whole_groups(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in _groups(batches, keys):
                if len(g) > 1:
                    yield _star(g["doc_id"].to_numpy(), compare(g["payload"].tolist()))

        return work

    def with_hubs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every block of a group with the group's hubs, which come first in it."""
        for block in _groups(batches, ["grp", "_j"]):
            many = int((block["_hub"] == 0).sum())
            ids, payloads = block["doc_id"].to_numpy(), block["payload"].tolist()
            cuts = np.linspace(many, len(block), max(1, round((len(block) - many) / CHUNK)) + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield _star(np.concatenate([ids[:many], ids[a:b]]), compare([*payloads[:many], *payloads[a:b]]))

    edge = "u long, v long"
    small = rows.where("blocks = 1").select("grp", "doc_id", "payload").repartition("grp").sortWithinPartitions("grp", "doc_id")
    edges = small.mapInPandas(whole_groups(["grp"]), edge)
    large = rows.where("blocks > 1")
    thin = stored(large.select("grp", "doc_id", "blocks").distinct())
    if thin.isEmpty():
        return edges

    # Hubs: the members least by several hashes, so that one odd member doesn't decide.
    chosen = [F.min(F.struct(F.xxhash64(F.lit(i), "doc_id").alias("h"), "doc_id"))["doc_id"] for i in range(HUBS)]
    hubs = thin.groupBy("grp").agg(F.array_distinct(F.array(*chosen)).alias("hubs")).select("grp", F.explode("hubs").alias("doc_id"))
    # Hubs go to each block of their group once, not with each member.
    spread = lambda n: F.pmod(F.xxhash64(F.lit("block"), "doc_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    texts = large.join(hubs, ["grp", "doc_id"], "left_semi").dropDuplicates(["grp", "doc_id"])
    first = texts.select("grp", each("blocks").alias("_j"), F.lit(0).alias("_hub"), "doc_id", "payload")
    blocks = first.unionByName(large.select("grp", spread(F.col("blocks")).alias("_j"), F.lit(1).alias("_hub"), "doc_id", "payload"))
    sorted_blocks = blocks.repartition("grp", "_j").sortWithinPartitions("grp", "_j", "_hub", "doc_id")
    stars = stored(sorted_blocks.mapInPandas(with_hubs, edge).distinct())

    # What no chain of links has brought into its group's largest component so far.
    labels = thin.join(components(stars), F.col("doc_id") == F.col("node"), "left").select("grp", "doc_id", "blocks", F.coalesce("component", "doc_id").alias("component"))
    counts = labels.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("grp", F.pmod("grp", F.lit(1)).alias("_z")).agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("m"), F.max("n").alias("n")).drop("_z")
    left = largest.where("m > n").select("grp", "main", F.ceil((F.col("m") - F.col("n")) / BLOCK).cast("int").alias("lefts"))
    placed = labels.join(left, "grp")
    one = placed.where("component != main").select("grp", "doc_id", spread(F.col("lefts")).alias("_i"), each("blocks").alias("_j"))
    every = placed.select("grp", "doc_id", spread(F.col("blocks")).alias("_j"), each("lefts").alias("_i"))
    pairs = one.unionByName(every).distinct().join(large.select("grp", "doc_id", "payload"), ["grp", "doc_id"])
    pairs = pairs.select("grp", "_i", "_j", "doc_id", "payload").repartition("grp", "_i", "_j").sortWithinPartitions("grp", "_i", "_j", "doc_id")
    return edges.unionByName(stars).unionByName(pairs.mapInPandas(whole_groups(["grp", "_i", "_j"]), edge))


def similar_signatures(payloads: list[bytes]) -> np.ndarray:
    """Labels under the pairs of signatures that survive the sequential test."""
    n = len(payloads)
    signature = np.frombuffer(b"".join(payloads), np.uint16).reshape(n, HASHES)
    label = np.arange(n)
    for a in range(0, n, 64):  # bounds the pairs at hand to 64 x n
        left, right = np.meshgrid(np.arange(a, min(n, a + 64)), np.arange(n), indexing="ij")
        new = (left < right) & (label[left] != label[right])
        left, right = surviving_pairs(signature, left[new], right[new])
        label = spanning(n, np.concatenate([np.arange(n), left]), np.concatenate([label, right]))
    return label


def similar_texts(payloads: list[str]) -> np.ndarray:
    """Labels under the exact links of whole texts."""
    left, right = exact_links([s for _, s, _ in shingle_sets(payloads, SHINGLE_WORDS)])
    return spanning(len(payloads), left, right)


def candidate_edges(representatives: DataFrame) -> DataFrame:
    """(u, v) spanning the pairs that share a bucket and survive the sequential test."""
    keys = representatives.select("doc_id", F.explode("bands").alias("grp"))
    sizes = keys.groupBy("grp", F.pmod("grp", F.lit(1)).alias("_z")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = sizes.select("grp", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    members = stored(keys.join(sizes, "grp"))
    return linked_within(members.join(representatives.select("doc_id", F.col("signature").alias("payload")), "doc_id"), similar_signatures)


def verified_edges(docs: DataFrame, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, v) spanning the true links inside each candidate cluster.

    ``clusters``: (node, component); ``sizes``: (doc_id, n_shingles) of representatives."""
    members = clusters.join(sizes, F.col("node") == F.col("doc_id")).select("doc_id", F.col("component").alias("grp"), "n_shingles")
    weight = members.groupBy("grp", F.pmod("grp", F.lit(1)).alias("_z")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = weight.select("grp", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(blocks, "grp").select(F.col("doc_id").alias("_id"), "grp", "blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("payload")).where("doc_id is not null and text is not null")
    # The texts of clusters leave the documents once.
    rows = stored(texts.join(placed, F.col("doc_id") == F.col("_id")).select("grp", "doc_id", "payload", "blocks"))
    return linked_within(rows, similar_texts)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= 75 * |A | B| for their shingle sets. With fewer than
    five words the whole sequence is the one shingle; null, empty and blank texts have none and
    link with nothing. component_id is the least doc_id reachable, and kept marks that document.
    A doc_id that repeats has the links of all its rows, and all are kept or none; a row without
    doc_id links with nothing, has a null component and is kept."""
    signed = stored(signatures(docs))
    thin = signed.select("doc_id", "n_shingles", "d1", "d2")
    classes = thin.where("n_shingles > 0").groupBy("d1", "d2", F.pmod("d1", F.lit(1)).alias("_z")).agg(F.min("doc_id").alias("rep")).drop("_z")
    members = stored(thin.join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", "d1", "d2", F.coalesce("rep", "doc_id").alias("rep")))
    firsts = members.where("n_shingles > 0 and doc_id = rep").select("doc_id", "d1", "d2").distinct()
    representatives = signed.join(firsts, ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    clusters = components(candidate_edges(representatives))
    sizes = members.where("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    links = verified_edges(docs, clusters, sizes)
    # A doc_id with several texts ties their classes together.
    ties = members.where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    several = members.groupBy("doc_id").agg(F.count_distinct("rep").alias("n")).where("n > 1").select("doc_id")
    reached = components(links.unionByName(ties.join(several, F.col("u") == F.col("doc_id"), "left_semi")))
    discard(signed)
    out = members.join(reached, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    named = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return named.unionByName(_unnamed(docs))


def _unnamed(docs: DataFrame) -> DataFrame:
    """Rows without doc_id."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            yield pd.DataFrame({"n_shingles": [len(s) for _, s, _ in shingle_sets(texts, SHINGLE_WORDS)]})

    lost = docs.where("doc_id is null").select("text").mapInPandas(count, "n_shingles long")
    none = F.lit(None).cast("long")
    return lost.select(none.alias("doc_id"), "n_shingles", none.alias("component_id"), F.lit(True).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component of ``near_duplicates``, with all its columns: that of the least doc_id.

    Of rows that share a kept doc_id one stays, that of the longest text (then the one greatest by
    a hash of the text). Rows without doc_id are stored once with numbers above all ids, take part like any
    others and lose the numbers again: such a row goes if it is like a row with an id, and of
    some that are alike one stays. Null, empty and blank texts link with nothing and stay."""
    lost = docs.where("doc_id is null")
    largest = docs.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if not largest[1]:
        return _without_near_duplicates(docs)
    base = max(0, -1 if largest[0] is None else int(largest[0])) + 1
    if base >= 1 << 62:
        raise ValueError("doc_ids leave no room for numbers of rows without one")
    kind = docs.schema["doc_id"].dataType
    numbered = stored(lost.withColumn("doc_id", F.lit(base) + F.monotonically_increasing_id()))
    every = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(numbered)
    kept = _without_near_duplicates(every)
    return kept.withColumn("doc_id", F.when(F.col("doc_id") < base, F.col("doc_id")).cast(kind)).select(*docs.columns)


def _without_near_duplicates(docs: DataFrame) -> DataFrame:
    dropped = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    rows = without(docs, "_dropped")
    kept = rows.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")
    named = docs.where("doc_id is not null").select(F.col("doc_id").alias("_dropped"), F.pmod("doc_id", F.lit(1)).alias("_z"))
    repeated = stored(named.groupBy("_dropped", "_z").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_dropped"))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, F.col("doc_id") == F.col("_dropped"), "left_semi")
    order = F.struct(F.coalesce(F.octet_length("text"), F.lit(-1)), F.xxhash64("text"))
    one = again.groupBy("doc_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("_one")).select("_one.*")
    return kept.join(repeated, F.col("doc_id") == F.col("_dropped"), "left_anti").unionByName(one)
