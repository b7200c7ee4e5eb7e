"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 7).

A component of a vector is a term and its scaled value the weight. Candidates come in
shards; a shard's inverted lists hold, per term, the rows and weights that are not zero, sorted by term
once when the shard is made. A block of queries is scored term by term: each query weight is multiplied into the list
and scattered into a dense array of scores, one row per query. Each array is cut down by
partition selection, and the short lists of all shards are merged.

Scores are 64-bit integers, added up as doubles where no partial sum can leave their exact whole numbers. A vector whose weights could overflow them (the sum of their squares reaches 2^62; by
the inequality of Cauchy and Schwarz no score of two others can) is refused with an error, since a wrapped score
would be a wrong answer. Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part.
An empty vector scores 0 with all. Vectors of other lengths count as zero where they end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderloom.llm.common import ship, stored

SHARD = 4096
QUERIES = 128
SCALE = 256
LARGEST = 1 << 62
EXACT = 1 << 52  # below, every sum of products is a whole number that a double holds exactly


def scaled(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """(id, weights array<bigint>, asked) of usable rows: no null or non-finite component, a vector, an id."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    usable = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0)))
    large = F.raise_error(F.concat(F.lit("scores of vector "), F.col("id"), F.lit(" may exceed 64 bits"))).cast("double")
    checked = F.when(squares < float(LARGEST), squares).otherwise(large) >= 0
    return usable.filter(checked).select("id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("weights"), "asked")


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(ids, rows, terms, weights): up to ``most`` sparse vectors in one row of the table, as lists sorted by term."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids = part.column(0).to_numpy()
                lists = part.column(1)
                values = lists.flatten().to_numpy().astype(np.int64)
                lengths = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
                term = (np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                some = np.flatnonzero(values)
                some = some[np.argsort(term[some], kind="stable")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), row[some], term[some], values[some])],
                    ["ids", "rows", "terms", "weights"],
                )

    ship(rows.sparkSession)
    return rows.mapInArrow(pack, "ids binary, rows binary, terms binary, weights binary")


def _squares(rows: np.ndarray, weights: np.ndarray) -> float:
    """The largest sum of squares of a row."""
    return float(np.bincount(rows, weights.astype(np.float64) ** 2).max(initial=0.0))


def accumulate(queries: tuple, shard: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of each query's ``k`` best rows of the shard, itself left out."""
    q_ids, q_rows, q_terms, q_weights = queries
    ids, rows, terms, weights = shard
    kind = np.float64 if max(_squares(q_rows, q_weights), _squares(rows, weights)) < EXACT else np.int64
    scores = np.zeros((len(q_ids), len(ids)), kind)
    q_weights, weights = q_weights.astype(kind), weights.astype(kind)
    term, q_first = np.unique(q_terms, return_index=True)
    q_last = np.append(q_first[1:], len(q_terms))
    full, part = np.zeros(len(ids), kind), np.zeros(len(ids), kind)
    low, high = np.searchsorted(terms, term), np.searchsorted(terms, term, side="right")
    for first, last, begin, end in zip(q_first, q_last, low, high):
        if begin == end:
            continue
        at, weight = rows[begin:end], weights[begin:end]
        if 4 * len(at) > len(ids):  # a list that most rows are in, spread out once for all queries
            full.fill(0)
            full[at] = weight
            for row, own in zip(q_rows[first:last], q_weights[first:last]):
                np.multiply(full, own, out=part)
                np.add(scores[row], part, out=scores[row])
        else:  # a row has a term once, so the scatter never meets the same cell twice
            for row, own in zip(q_rows[first:last], q_weights[first:last]):
                scores[row][at] += own * weight
    out_q, out_c, out_s = [], [], []
    for query, line in zip(q_ids, scores):
        other = np.flatnonzero(ids != query)
        if len(other) > k:
            line_other = line[other]
            bar = -np.partition(-line_other, k - 1)[k - 1]
            other = other[line_other >= bar]  # all ties of the last place; the smaller ids are kept
        best = other[np.lexsort((ids[other], -line[other]))][:k]
        out_q.append(np.full(len(best), query))
        out_c.append(ids[best])
        out_s.append(line[best].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` rows of largest integer inner product.

    Every query meets every shard once: a task holds one shard and reads all blocks of queries, one at a time
    for the scores. Ties go to the smaller vec_id; a row is never its own result.
    Rows that repeat an id are candidates each; a repeated query id is asked once per distinct row.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, is_query)
    shards = stored(_packed(rows.select("id", "weights"), SHARD), "shards")
    asked = rows.filter("asked").select("id", "weights").distinct()
    blocks = stored(_packed(asked, QUERIES), "queries")
    held = shards.select(F.struct("*").alias("c")).repartition(max(1, shards.count()))
    # a task reads the blocks from their files; Spark would take copies of them for small and bring all to the driver
    met = held.crossJoin(blocks.select(F.struct("*").alias("q")).hint("shuffle_replicate_nl")).select("q", "c")

    kinds = (np.int64, np.int32, np.int32, np.int64)

    def unpack(value: dict) -> tuple:
        return tuple(np.frombuffer(value[n], t) for n, t in zip(("ids", "rows", "terms", "weights"), kinds))

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = accumulate(unpack(batch.column(0)[i].as_py()), unpack(batch.column(1)[i].as_py()), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    ship(spark)
    short = met.mapInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = short.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
