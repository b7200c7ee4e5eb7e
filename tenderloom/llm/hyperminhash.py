"""Near-duplicate documents by HyperMinHash (operator 3).

A document's shingle hashes fall into 256 buckets; a bucket keeps its smallest hash as one
byte: leading-zero count (4 bits) and the bits after the leading one (4 bits). Empty buckets
borrow from a filled one by a fixed rule, so that P(equal registers) follows the Jaccard
similarity for short documents too. Bands of buckets join documents that may be similar into clusters. They are keyed by the smallest hashes
themselves: by one byte of each, unrelated documents share a band so often that clusters of a large table grow together. Inside a cluster pairs pass an estimate, corrected for the collisions that both set sizes
let expect, and pairs that pass are confirmed on the full shingle sets.

Rows with null ids are linked with nothing. Texts without words have an empty set and are
linked with nothing. Rows that repeat an id count once per distinct set.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.llm.common import map_batches, map_groups, mixed, shingle_set, stored, texts_as_bytes
from tenderloom.llm.components import components

BUCKETS = 256
MANTISSA = 4
MISS = 1e-6
SIGMAS = 6.0
BLOCK = 512
BLOCK_SHINGLES = 2 << 20


def band_shape(threshold: float) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares no band with probability under ``MISS``."""
    rows = max(1, round(math.log(0.3) / math.log(threshold))) if threshold < 1 else 8
    bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows)) if threshold < 1 else 1
    if bands * rows > BUCKETS:
        raise ValueError("threshold too low for the register count")
    return bands, rows


def _donors() -> np.ndarray:
    """For every bucket, the other buckets in the order in which it borrows from them."""
    keys = np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1 << 40)
    order = np.argsort(mixed(keys).reshape(BUCKETS, BUCKETS), axis=1)
    return order.astype(np.int16)


_DONORS = _donors()


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bucket of a non-empty set of 64-bit hashes, or what an empty bucket borrows."""
    hashes = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    rest = hashes & np.uint64((1 << 56) - 1)
    lowest = np.full(BUCKETS, 1 << 56, np.uint64)
    np.minimum.at(lowest, bucket, rest)
    filled = lowest < np.uint64(1 << 56)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        first = filled[_DONORS[empty]].argmax(axis=1)
        lowest[empty] = lowest[_DONORS[empty, first]]
    return lowest


def shortened(lowest: np.ndarray) -> np.ndarray:
    """Minima as registers of one byte."""
    # 52 bits fit a double exactly, so its exponent is the position of the leading one
    value = (lowest >> np.uint64(4)).astype(np.float64)
    fraction, exponent = np.frexp(np.maximum(value, 1.0))
    zeros = np.minimum(52 - exponent, 15)
    bits = np.floor((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    return (zeros * (1 << MANTISSA) + bits).astype(np.uint8)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """256 one-byte registers of a non-empty set of 64-bit hashes."""
    return shortened(minima(shingles))


STEPS = 4  # set sizes per doubling that the collision table tells apart


@lru_cache(maxsize=1)
def _collisions() -> np.ndarray:
    """P(equal registers of unrelated sets) by the logarithms of both sizes.

    A bucket of a set of n hashes holds about n / 256, and its minimum is above x with probability
    exp(-n x / 256). Two minima give the same register if they fall into the same of its cells: halves,
    quarters and so on of the unit interval, each cut into 2^MANTISSA parts.
    """
    tops = [2.0**-z * (1 - i / (2 << MANTISSA)) for z in range(15) for i in range(1 << MANTISSA)] + [2.0**-15, 0.0]
    edges = np.array(tops)
    sizes = 2.0 ** (np.arange(40 * STEPS) / STEPS)
    above = np.exp(-np.outer(np.maximum(sizes / BUCKETS, 1e-3), edges))
    inside = np.diff(above, axis=1)
    inside /= inside.sum(axis=1, keepdims=True)
    return (inside @ inside.T).astype(np.float32)


def expected_collisions(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """P(two different minima give the same register), for every size of ``a`` with every one of ``b``."""
    at, to = (np.minimum(np.rint(STEPS * np.log2(np.maximum(s, 1))).astype(int), 40 * STEPS - 1) for s in (sizes_a, sizes_b))
    return _collisions()[at[:, None], to[None, :]]


def estimate(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of every sketch of ``a`` with every one of ``b``, corrected for collisions."""
    equal = np.empty((len(a), len(b)), np.float32)
    for i, row in enumerate(a):
        equal[i] = (b == row).mean(axis=1)
    chance = expected_collisions(sizes_a, sizes_b)
    return (equal - chance) / (1 - chance)


def passing(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and which pairs of sketches may belong to sets of a similarity of ``percent`` or more."""
    low = percent / 100
    score = estimate(a, b, sizes_a, sizes_b)
    small, large = np.minimum.outer(sizes_a, sizes_b), np.maximum.outer(sizes_a, sizes_b)
    # a short set fills few buckets, so its estimate scatters more and the floor is lower
    filled = BUCKETS * -np.expm1(-small / BUCKETS)
    return score, (score >= low - SIGMAS * np.sqrt(low * (1 - low) / filled)) & (100 * small >= percent * large)


def band_keys(lowest: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, from its buckets' minima and its number."""
    part = lowest[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32)
    for column in part.T:
        key = mixed(key ^ column) + column
    return key.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits that identify a set of 64-bit hashes."""
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, digest, registers, bands): one pass over the texts."""
    bands, rows = band_shape(threshold)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, sketches, keys = [], [], [], []
        for data in texts_as_bytes(batch.column(1)):
            found = shingle_set(data, shingle)
            lowest = minima(found) if len(found) else None
            sizes.append(len(found))
            digests.append(_digest(found) if len(found) else None)
            sketches.append(shortened(lowest).tobytes() if len(found) else None)
            keys.append(band_keys(lowest, bands, rows) if len(found) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, sketches)), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "registers", "bands"],
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(narrow, work, "doc_id long, n_shingles long, digest binary, registers binary, bands array<long>")


def clusters(heads: DataFrame) -> DataFrame:
    """(id, component): documents that share a band, transitively; a superset of all links.

    A band key links each of its documents to the smallest one, never all pairs.
    """
    keys = heads.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("_last")).filter("head < _last")
    edges = keys.join(shared.select("key", "head"), "key").filter("doc_id <> head")
    return components(edges.select(F.col("head").alias("a"), F.col("doc_id").alias("b")))


# ---------------------------------------------------------------- confirmation


def _weight() -> Column:
    """A row's part of a block: blocks end at ``BLOCK`` rows or ``BLOCK_SHINGLES`` shingles."""
    return 1.0 / BLOCK + F.col("size") / BLOCK_SHINGLES


def _dealt(rows: DataFrame, turn: int) -> DataFrame:
    """``rows`` (doc_id, cluster, comp, size) with the number of blocks of their cluster and their own block."""
    blocks = rows.groupBy("cluster").agg(F.ceil(F.sum(_weight())).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("blocks")).cast("int")
    return rows.join(blocks, "cluster").withColumn("block", block)


def _paired(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, cluster, comp, size, ...) once per pair of blocks they belong to, as (i, j) and which side is theirs.

    A component that fills a block has blocks of its own, which never meet each other: their rows are joined already.
    The others share blocks, and these meet all of the cluster, themselves included.
    """
    per = rows.groupBy("cluster", "comp").agg(F.sum(_weight()).alias("_w"))
    shared = per.groupBy("cluster").agg(F.ceil(F.sum(F.when(F.col("_w") < 1, F.col("_w")).otherwise(0.0))).cast("int").alias("_shared"))
    sized = rows.join(per, ["cluster", "comp"]).join(shared, "cluster")
    own = F.col("_w") >= 1
    placed = sized.select(
        *rows.columns,
        F.when(own, F.col("comp")).otherwise(F.lit(-1)).alias("_of"),
        F.when(own, F.pmod(F.xxhash64("doc_id"), F.ceil("_w"))).otherwise(F.pmod(F.xxhash64("comp"), F.greatest(F.lit(1), "_shared"))).alias("_at"),
        own.alias("_own"),
    )
    placed = stored(placed.withColumn("block", F.xxhash64("_own", "_of", "_at")), "blocks")
    blocks = placed.select("cluster", "block", F.when(F.col("_own"), F.col("comp")).alias("_of")).distinct()
    other = blocks.select("cluster", F.col("block").alias("_other"), F.col("_of").alias("_other_of"))
    met = blocks.join(other, "cluster").filter("_of is null or _other_of is null or _of <> _other_of").select("cluster", "block", "_other")
    return placed.join(met, ["cluster", "block"]).select(
        *rows.columns,
        F.least("block", "_other").alias("i"),
        F.greatest("block", "_other").alias("j"),
        (F.col("block") <= F.col("_other")).alias("first"),
    )


def _forest(frame: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame | None:
    """(a, b): a the smallest of the components that links in a block, or between two blocks, join; b another one."""
    if len(frame) < 2:
        return None
    side = frame["first"].to_numpy()
    one = bool(side.all())
    left, right = np.flatnonzero(side), np.arange(len(frame)) if one else np.flatnonzero(~side)
    if not len(left) or not len(right):
        return None
    sets = [shingle_set(t.encode(), shingle) for t in frame["text"]]
    sizes = np.array([len(x) for x in sets])
    full = sizes > 0
    left, right = left[full[left]], right[full[right]]
    if not len(left) or not len(right):
        return None
    sketches = np.stack([sketch(x) if len(x) else np.zeros(BUCKETS, np.uint8) for x in sets])
    score, passed = passing(sketches[left], sketches[right], sizes[left], sizes[right], percent)
    names, comp = np.unique(frame["comp"].to_numpy(), return_inverse=True)
    passed &= comp[left][:, None] != comp[right][None, :]
    if one:
        passed &= left[:, None] < right[None, :]
    at, to = np.nonzero(passed)
    order = np.argsort(-score[at, to], kind="stable")
    root = np.arange(comp.max() + 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left[at[order]], right[to[order]]):
        p, q = find(comp[x]), find(comp[y])
        if p == q:
            continue
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (sizes[x] + sizes[y] - both):
            root[max(p, q)] = min(p, q)
    head = names[[find(i) for i in range(len(root))]]
    moved = head != names
    return pd.DataFrame({"a": head[moved], "b": names[moved]}) if moved.any() else None


def _candidates(frame: pd.DataFrame, percent: int) -> pd.DataFrame | None:
    """Rows of two blocks whose sketch passes with one of another component, from registers alone."""
    side = frame["first"].to_numpy()
    left, right = np.flatnonzero(side), np.arange(len(frame)) if side.all() else np.flatnonzero(~side)
    if not len(left) or not len(right):
        return None
    sketches = np.stack([np.frombuffer(r, np.uint8) for r in frame["registers"]])
    sizes, comp = frame["n_shingles"].to_numpy(), frame["comp"].to_numpy()
    _, passed = passing(sketches[left], sketches[right], sizes[left], sizes[right], percent)
    passed &= comp[left][:, None] != comp[right][None, :]
    hit = np.union1d(left[passed.any(axis=1)], right[passed.any(axis=0)])
    return frame.iloc[hit][["doc_id", "cluster", "comp", "size"]] if len(hit) else None


MEMBER = "doc_id long, cluster long, comp long, size long"


def confirmed(docs: DataFrame, heads: DataFrame, grouped: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Edges (a, b) that keep the components of all links inside the clusters.

    1. A cluster is cut into blocks of bounded rows and bytes, and every text goes to its block once, which gives the
       components of the block. That settles clusters of one block.
    2. In larger ones, the components' smallest documents stand for them and are dealt to new blocks, as long
       as that joins components. A cluster of near copies needs about one comparison per document for both.
    3. Where components are left apart, registers of 256 bytes are moved between blocks, and only documents whose
       sketch passes with one of another component meet with their texts. So no link is left out.
    """
    percent = round(threshold * 100)
    sizes = heads.groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
    members = grouped.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"), F.col("id").alias("comp")).join(sizes, "doc_id")
    members = stored(members.select(*[f.split()[0] for f in MEMBER.split(", ")]), "members")
    # the only time texts are shuffled by id; a sort-merge join at every size
    texts = stored(docs.join(members.select("doc_id").hint("merge"), "doc_id", "left_semi"), "texts")

    def forest(frame: pd.DataFrame) -> pd.DataFrame | None:
        return _forest(frame, shingle, percent)

    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        met = texts.join(stored(rows, "dealt"), "doc_id")
        return stored(map_groups(met, keys, forest, "a long, b long", order=["doc_id"]), "edges")

    def relabelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
        moved = edges.select(F.col("b").alias("comp"), F.col("a").alias("_to"))
        return stored(rows.join(moved, "comp", "left").select("doc_id", "cluster", F.coalesce("_to", "comp").alias("comp"), "size"), "left")

    def apart(rows: DataFrame) -> DataFrame:
        many = rows.groupBy("cluster").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high")
        return rows.join(many.select("cluster"), "cluster", "left_semi")

    dealt = stored(_dealt(members, 0), "dealt")
    edges = joined(dealt.withColumn("first", F.lit(True)), ["cluster", "block"])
    left = dealt.filter("blocks > 1").drop("blocks", "block")
    if left.isEmpty():
        return edges
    left, turn, before = apart(relabelled(left, edges)), 0, None
    while True:
        heads_left = left.filter("doc_id = comp")
        count = heads_left.count()
        if count == 0:
            return edges
        if before is not None and 2 * count > before:
            break
        turn, before = turn + 1, count
        new = joined(_dealt(heads_left, turn).withColumn("first", F.lit(True)), ["cluster", "block"])
        edges, left = edges.unionByName(new), apart(relabelled(left, new))
    rows = stored(_paired(left), "paired").join(heads.select("doc_id", "registers", "n_shingles"), "doc_id")

    def candidates(frame: pd.DataFrame) -> pd.DataFrame | None:
        return _candidates(frame, percent)

    near = stored(map_groups(rows, ["cluster", "i", "j"], candidates, MEMBER).distinct(), "near")
    return edges.unionByName(joined(_paired(near), ["cluster", "i", "j"]))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over
    links with Jaccard similarity at or above ``threshold``), kept (doc_id is that id).

    Equal sets are one node from the start, so copies are never compared. A repeated doc_id
    belongs to the component of each of its sets; a null doc_id gives a null component.
    """
    rows = stored(profiles(docs, id_col, text_col, shingle, threshold), "profiles")
    known = rows.filter("doc_id is not null and n_shingles > 0")
    same = known.groupBy("digest").agg(F.min("doc_id").alias("head"))
    sets = known.join(same, "digest").select("doc_id", "digest", "head", "n_shingles", "registers", "bands")
    heads = sets.filter("doc_id = head").dropDuplicates(["doc_id", "digest"]).select("doc_id", "n_shingles", "registers", "bands")
    heads = stored(heads, "heads")
    grouped = stored(clusters(heads), "clusters")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        "doc_id is not null and text is not null"
    )
    copies = sets.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    linked = confirmed(texts, heads, grouped, shingle, threshold).unionByName(copies)
    found = components(linked).select(F.col("id").alias("doc_id"), F.col("component").alias("_component"))
    labelled = rows.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("_component", "doc_id")
    return labelled.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
