"""Embedding near-duplicates by an epsilon grid order join (operator 4).

Vectors are scaled to length one, so cosine c means a Euclidean distance of sqrt(2 - 2c).
They are turned onto the principal axes of the whole table, put into grid cells of that
width on the leading axes, sorted by label and cell, and cut into blocks. Intervals of
blocks are joined recursively: a pair of intervals is split as long as the boxes around
them are near enough to hold a link, and dropped as soon as they are not. Pairs of blocks
that are left are compared by exact cosines.

Vectors that are null, zero, or hold null or non-finite components, and rows without a
label or an id, link with nothing. Vectors of different lengths link with nothing. Equal
vectors under one label are one node with a count, so copies are never compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderloom.llm.common import map_batches, map_groups, ship, stored
from tenderloom.llm.components import components

AXES = 8
BLOCK = 512
FAN_BITS = 3
SLACK = 1e-9


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (float64) and lengths of a list column without null elements."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    return flat, lengths


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Distinct (label, vector) with smallest id, number of rows, and dimension; unusable rows left out."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    # a vector is grouped by its values: -0.0 counts as 0.0
    plain = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine & nonzero).withColumn(
        "vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    )
    return plain.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def levelled(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two so that the largest component lies between a half and one: cosines stay
    the same bit by bit, and squares of tiny or huge components neither vanish nor overflow."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes per dimension, from second moments summed over all vectors in the tasks."""

    def moments(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, lengths = _matrix(batch.column(0))
        ends = np.cumsum(lengths)
        dims, sums = [], []
        for d in np.unique(lengths):
            picked = levelled(np.stack([flat[e - d : e] for e, n in zip(ends, lengths) if n == d]))
            picked = picked / np.linalg.norm(picked, axis=1, keepdims=True)
            dims.append(int(d))
            sums.append(np.concatenate([[len(picked)], picked.sum(axis=0), (picked.T @ picked).ravel()]))
        places = [np.arange(len(s)) for s in sums]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(dims, [len(s) for s in sums]), pa.int32()),
                pa.array(np.concatenate(places), pa.int32()),
                pa.array(np.concatenate(sums), pa.float64()),
            ],
            ["dim", "place", "value"],
        )

    parts = map_batches(nodes.select("vector"), moments, "dim int, place int, value double")
    # bounded by the square of the dimension, whatever the number of vectors
    sums = parts.groupBy("dim", "place").agg(F.sum("value").alias("value")).toPandas()
    axes = {}
    for d, frame in sums.groupby("dim"):
        values = frame.sort_values("place")["value"].to_numpy()
        n, mean, second = values[0], values[1 : d + 1] / values[0], values[d + 1 :].reshape(d, d) / values[0]
        _, turned = np.linalg.eigh(second - np.outer(mean, mean))
        axes[int(d)] = turned[:, ::-1][:, :AXES]
    return axes


def blocks(nodes: DataFrame, width: float) -> DataFrame:
    """Nodes with projections, in grid order, and the number of their block."""
    axes = _axes(nodes)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        flat, lengths = _matrix(columns["vector"])
        cells, places = [], []
        start = 0
        for n in lengths:
            row = levelled(flat[None, start : start + n])[0]
            start += n
            at = np.zeros(AXES)
            own = (row / np.linalg.norm(row)) @ axes[int(n)]
            at[: len(own)] = own
            places.append(at)
            cells.append((np.floor(at / width)).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([p.tolist() for p in places], pa.list_(pa.float64())), pa.array([c.tolist() for c in cells], pa.list_(pa.int64()))],
            [*batch.schema.names, "at", "cell"],
        )

    fields = "label string, vector array<double>, id long, n long"
    gridded = map_batches(nodes.select("label", "vector", "id", "n"), place, f"{fields}, at array<double>, cell array<bigint>")
    keys = ["label", "dim", "cell", "id"]  # the id last: a full cell is cut like any other stretch
    ordered = gridded.withColumn("dim", F.size("vector")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ship(nodes.sparkSession)

    def cut(frames):
        from pyspark import TaskContext

        block, filled, label = 0, 0, None
        base = TaskContext.get().partitionId() << 24
        for frame in frames:
            numbers = np.empty(len(frame), np.int64)
            pairs = list(zip(frame["label"], frame["dim"]))
            for i, own in enumerate(pairs):
                if own != label or filled == BLOCK:
                    block, filled, label = block + 1, 0, own
                filled += 1
                numbers[i] = base + block
            yield frame.assign(block=numbers)

    return ordered.mapInPandas(cut, f"{fields}, at array<double>, cell array<bigint>, dim int, block long")


def near_blocks(placed: DataFrame, width: float) -> DataFrame:
    """(label, dim, a, b) with a <= b: pairs of blocks that may hold a link.

    Starts with pairs of the widest intervals and splits both sides by eight at each level;
    only pairs whose boxes are within ``width`` go on. Boxes are minima and maxima of the
    projections, which never overstate a distance.
    """
    box = [F.min(F.col("at")[i]).alias(f"lo{i}") for i in range(AXES)] + [F.max(F.col("at")[i]).alias(f"hi{i}") for i in range(AXES)]
    leaves = stored(placed.groupBy("label", "dim", "block").agg(*box), "boxes")
    top = leaves.agg(F.max("block").alias("b")).first()["b"]
    levels = 0 if top is None else -(-int(top + 1).bit_length() // FAN_BITS)

    def level(n: int) -> DataFrame:
        wider = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(AXES)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(AXES)]
        return leaves.groupBy("label", "dim", F.shiftright("block", FAN_BITS * n).alias("node")).agg(*wider)

    # levels on which no interval has been split yet can be skipped: start where there are at
    # most a few intervals per label
    counts = leaves.select("label", "dim", *[F.shiftright("block", FAN_BITS * n).alias(f"n{n}") for n in range(levels + 1)])
    spread = counts.groupBy("label", "dim").agg(*[F.countDistinct(f"n{n}").alias(f"n{n}") for n in range(levels + 1)])
    widest = spread.agg(*[F.max(f"n{n}").alias(f"n{n}") for n in range(levels + 1)]).first() if levels else None
    start = next((n for n in range(levels + 1) if widest is not None and widest[f"n{n}"] is not None and widest[f"n{n}"] <= 8), levels)

    def sides(boxes: DataFrame, up: str, suffix: str) -> DataFrame:
        names = [c for i in range(AXES) for c in (f"lo{i}", f"hi{i}")]
        return boxes.select("label", "dim", F.col("node").alias(suffix), F.col("up").alias(up), *[F.col(c).alias(f"{c}_{suffix}") for c in names])

    gaps = [
        F.greatest(F.lit(0.0), F.col(f"lo{i}_a") - F.col(f"hi{i}_b"), F.col(f"lo{i}_b") - F.col(f"hi{i}_a")) for i in range(AXES)
    ]
    near = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= F.lit((width + SLACK) ** 2)
    pairs = None
    for n in range(start, -1, -1):
        boxes = level(n).withColumn("up", F.shiftright("node", FAN_BITS) if pairs is not None else F.lit(0).cast("long"))
        above = pairs if pairs is not None else leaves.select("label", "dim").distinct().select("label", "dim", F.lit(0).cast("long").alias("ua"), F.lit(0).cast("long").alias("ub"))
        split = above.join(sides(boxes, "ua", "a"), ["label", "dim", "ua"]).join(sides(boxes, "ub", "b"), ["label", "dim", "ub"])
        kept = split.filter((F.col("a") <= F.col("b")) & near).select("label", "dim", "a", "b").distinct()
        pairs = stored(kept.select("label", "dim", F.col("a").alias("ua"), F.col("b").alias("ub")), "intervals")
    return pairs.select("label", "dim", F.col("ua").alias("a"), F.col("ub").alias("b"))


def _compare(frame: pd.DataFrame, cosine: float) -> pd.DataFrame | None:
    """Per vector of a pair of blocks: how many rows it links to, and edges that keep the components."""
    left = frame["side"].to_numpy() != 2
    right = frame["side"].to_numpy() != 1
    values = levelled(np.stack([np.asarray(v) for v in frame["vector"]]))
    ids, n = frame["id"].to_numpy(), frame["n"].to_numpy()
    norm = np.sqrt((values * values).sum(axis=1))
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    one = len(x) == len(frame) and len(y) == len(frame)
    linked = (values[x] @ values[y].T) / (norm[x][:, None] * norm[y][None, :]) >= cosine
    if one:
        np.fill_diagonal(linked, False)
    degree = np.zeros(len(frame), np.int64)
    degree[x] += linked @ n[y]
    if not one:
        degree[y] += linked.T @ n[x]
    mine = np.full(len(frame), -1)
    root = np.arange(len(frame))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, row in zip(x, linked):
        for j in y[row]:
            p, q = find(i), find(j)
            if p != q:
                low, high = (p, q) if ids[p] <= ids[q] else (q, p)
                root[high] = low
    for i in range(len(frame)):
        mine[i] = find(i)
    some = degree > 0
    if not some.any():
        return None
    return pd.DataFrame({"id": ids[some], "links": degree[some], "head": ids[mine[some]]})


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows at or above ``cosine`` under the same label; component_id is the
    smallest id reachable over links; kept tells whether it is the row's own. Each id is taken
    as one vector: a repeated id counts once per distinct vector.
    """
    width = math.sqrt(max(0.0, 2 - 2 * cosine))
    nodes = stored(usable(vectors, id_col, vector_col, label_col), "nodes")
    placed = stored(blocks(nodes, width), "blocks")
    pairs = stored(near_blocks(placed, width), "pairs")
    # a block goes once to each pair it is part of; both sides of a pair of one block are the same rows
    places = pairs.select(
        "label",
        "dim",
        "a",
        "b",
        F.explode(
            F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(
                F.array(F.struct(F.col("a").alias("block"), F.lit(1).alias("side")), F.struct(F.col("b").alias("block"), F.lit(2).alias("side")))
            )
        ).alias("_p"),
    ).select("label", "dim", "a", "b", F.col("_p.block").alias("block"), F.col("_p.side").alias("side"))
    # a block has one label and one dimension
    dealt = places.drop("label", "dim").join(placed.select("block", "id", "n", "vector"), "block").select("a", "b", "side", "id", "n", "vector")
    found = stored(map_groups(dealt, ["a", "b"], lambda f: _compare(f, cosine), "id long, links long, head long"), "links")
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    # rows of one vector link to each other: a copy joins its node and adds n - 1 links
    members = _members(vectors, nodes, id_col, vector_col, label_col)
    edges = found.select(F.col("head").alias("a"), F.col("id").alias("b")).unionByName(
        members.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    )
    label = components(edges).select(F.col("id"), "component")
    counted = members.join(degree.select(F.col("id").alias("head"), "links"), "head", "left").groupBy("id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"))
    component = F.coalesce("component", "id")
    return (
        rows.join(counted, "id", "left")
        .join(label, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        )
    )


def _members(vectors: DataFrame, nodes: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, head, n): each usable row with its node's smallest id and number of rows."""
    vector = F.transform(F.col(vector_col), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    heads = nodes.select("label", "vector", F.col("id").alias("head"), "n")
    return stored(rows.filter("id is not null").join(heads, ["label", "vector"]).select("id", "head", "n"), "members")
