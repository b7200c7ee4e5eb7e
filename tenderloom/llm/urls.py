"""URL filter by rules and a character language-model ratio (operator 10).

Hosts and paths meet the rules as plain column expressions. URLs that no rule judges get
their verdict from two variable-order Markov models of characters, one of accepted and one
of rejected URLs: each order is blended with the next shorter one by Witten-Bell smoothing,
down to a uniform start. A URL's score is the mean log-likelihood difference per character.
The threshold is calibrated on judged URLs that the models have not seen.

Models learn from all URLs that a rule judges. Characters are folded to an alphabet of 40,
so a model is one table of 40^4 cells (10 MB), whatever the number of URLs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.llm.common import map_batches

# The rules of the registered query, host and path together, with their verdicts.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~"  # the last stands for every other character
SIZE = 40
ORDER = 4
BINS = 2000
SPAN = 10.0
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all its subdomains."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _symbols(url: str) -> np.ndarray:
    return _FOLD[np.minimum(np.frombuffer(url.lower().encode("utf-32-le", "surrogatepass"), np.uint32), 127)]


def _fold() -> np.ndarray:
    table = np.full(128, SIZE - 1, np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
    return table


_FOLD = _fold()


def _windows(url: str) -> np.ndarray:
    """The code of every character with its ``ORDER`` - 1 predecessors; the start is padded."""
    symbols = np.concatenate([np.full(ORDER - 1, SIZE - 1), _symbols(url)])
    codes = np.zeros(len(symbols) - ORDER + 1, np.int64)
    for i in range(ORDER):
        codes = codes * SIZE + symbols[i : len(codes) + i]
    return codes


def counts(urls: DataFrame) -> DataFrame:
    """(accepted, code, n) over all of ``urls`` (url, accepted); at most 2 * 40^4 rows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        frames = []
        texts, accepted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for side in (True, False):
            own = [_windows(t) for t, a in zip(texts, accepted) if a is side]
            codes, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_counts=True)
            frames.append(pd.DataFrame({"accepted": side, "code": codes, "n": n}))
        schema = pa.schema([("accepted", pa.bool_()), ("code", pa.int64()), ("n", pa.int64())])
        return pa.RecordBatch.from_pandas(pd.concat(frames), schema, preserve_index=False)

    parts = map_batches(urls.select("url", "accepted"), work, "accepted boolean, code long, n long")
    return parts.groupBy("accepted", "code").agg(F.sum("n").alias("n"))


def log_probabilities(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(character | up to three before it) for all 40^4 windows, Witten-Bell over all orders."""
    full = np.zeros(SIZE**ORDER)
    np.add.at(full, codes, n)
    below = np.full(SIZE, 1.0 / SIZE)
    for order in range(1, ORDER + 1):
        seen = full.reshape(-1, SIZE**order).sum(axis=0).reshape(-1, SIZE)  # context, character
        total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(below.reshape(-1, SIZE), (seen.shape[0] // below.reshape(-1, SIZE).shape[0], 1))
        weight = np.where(total > 0, total + kinds, 1)
        blended = np.where(total > 0, (seen + kinds * shorter) / weight, shorter)
        below = blended.ravel()
    return np.log(below).astype(np.float32)


def ratio_table(found: pd.DataFrame) -> np.ndarray:
    """Log-likelihood difference, accepted minus rejected, per window; zeros unless both sides were seen."""
    sides = [found[found["accepted"] == a] for a in (True, False)]
    if not all(len(s) for s in sides):
        return np.zeros(SIZE**ORDER, np.float32)
    good, bad = (log_probabilities(s["code"].to_numpy(), s["n"].to_numpy()) for s in sides)
    return good - bad


def threshold_of(histogram: list[tuple[bool, int, int]]) -> float:
    """The score from which on to accept, with the largest mean of both sides' hit rates; 0 without both."""
    sums = np.zeros((2, BINS))
    for accepted, bin_, n in histogram:
        sums[int(accepted), bin_] += n
    if not sums.sum(axis=1).all():
        return 0.0
    rejected_below = np.concatenate([[0], np.cumsum(sums[0])]) / sums[0].sum()
    accepted_above = 1 - np.concatenate([[0], np.cumsum(sums[1])]) / sums[1].sum()
    quality = rejected_below + accepted_above
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    cut = best[len(best) // 2]  # the middle of equally good cuts
    return float(cut) / BINS * 2 * SPAN - SPAN


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score per row.

    A null URL or one without ``://`` has no host, path or rule; its verdict is the models', with
    score 0 if it has no character. Every occurrence of a repeated URL counts in training. Without
    judged URLs of both kinds every score is 0 and the threshold 0, so all are allowed.
    """
    url = F.col("url")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")
    )
    judged = base.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    accepted = F.lit(None).cast("boolean")
    for rule, verdict in rules:
        accepted = F.when(F.col("rule") == rule, F.lit(verdict == "allow")).otherwise(accepted)
    unseen = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)) == 0
    labelled = judged.filter("rule is not null").select("url", accepted.alias("accepted"), unseen.alias("unseen"))
    ratio = ratio_table(counts(labelled.filter(~F.col("unseen"))).toPandas())  # bounded by the alphabet
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(ratio)
    scored = _scored(labelled.filter("unseen"), shared)
    bin_ = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    histogram = scored.groupBy("accepted", bin_.alias("bin")).agg(F.count("*").alias("n")).collect()  # at most 2 * BINS
    bar = threshold_of([tuple(r) for r in histogram])
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("score") >= bar, "allow").otherwise("block"))
    for rule, said in rules:
        verdict = verdict.when(F.col("rule") == rule, said)
    return _scored(judged, shared).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _scored(frame: DataFrame, shared) -> DataFrame:
    at = frame.columns.index("url")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = shared.value
        scores = [float(table[_windows(u)].mean(dtype=np.float64)) if u else 0.0 for u in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return map_batches(frame, work, f"{fields}, score double")
