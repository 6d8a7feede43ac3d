"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target texts and one of all
texts, give each document a log ratio: how much likelier it is under the target.
With Gumbel noise added, the k largest keys are a sample without
replacement in proportion to the ratios.  k is the share of rows that the
labels call good.

The model of all texts is counted over every row.  The target model is fitted on
a bounded sample of the good labelled rows.  The k-th key is found digit by digit from
counts, without sorting the rows.

Defined cases: a null or empty text has no n-grams and ratio 0; a null doc_id gets the
noise of id 0; repeated rows get the same key, and ties at the k-th key all stay;
without good labels all rows stay; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.llm.common import WordHashes, bounded_sample, cut, kth_largest, mix64, slices, stream64, text_bytes

#: Buckets of the hashed n-grams, and the words in an n-gram at most.
BUCKETS, NGRAM = 10_000, 2
#: Good labelled rows, about, that the target model is fitted on where there are more.
MAX_TARGET_ROWS = 20_000
SMOOTHING, SEED = 1.0, 7


def buckets(text: bytes | None, known: WordHashes) -> np.ndarray:
    words = known.of((text or b"").lower().split())
    out, gram = [words], words
    with np.errstate(over="ignore"):
        for n in range(1, NGRAM):
            gram = mix64(gram[: max(len(words) - n, 0)] * np.uint64(0x100000001B3) + words[n:])
            out.append(gram)
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64)


def model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TARGET_ROWS) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the share of labelled rows that are good."""
    by_id = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    share = by_id.agg(F.avg((F.col("q") > 0).cast("double"))).first()[0]
    target = bounded_sample(by_id.where("q > 0"), max_rows).select(F.col("doc_id").alias("__id"))
    rows = docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(target), F.col("doc_id") == F.col("__id"), "left").select("t", F.col("__id").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, good = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for start, part in slices(b.column(0)):
                for t, g in zip(part, b.column(1).slice(start, len(part)).to_pylist(), strict=True):
                    n = np.bincount(buckets(t, known), minlength=BUCKETS)
                    raw += n
                    if g:
                        good += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "n_raw", "n_good"])

    sums = rows.mapInArrow(run, "bucket long, n_raw long, n_good long").groupBy("bucket").agg(F.sum("n_raw"), F.sum("n_good")).toArrow()  # BUCKETS rows at most
    counts = np.zeros((2, BUCKETS))
    if sums.num_rows:
        counts[:, sums[0].to_numpy()] = [sums[1].to_numpy(), sums[2].to_numpy()]
    p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return (np.log(p[1]) - np.log(p[0]) if counts[1].any() else np.zeros(BUCKETS)), 1.0 if share is None or not counts[1].any() else float(share)


def sortable(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the given floats."""
    bits = x.astype(np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_ngrams, log_ratio, key, kept."""
    ratios, found = model(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = WordHashes(), shared.value
        for b in batches:
            for start, part in slices(b.column(1)):
                ids = b.column(0).slice(start, len(part))
                got = [buckets(t, known) for t in part]
                ratio = np.array([table[g].sum() for g in got])
                u = (stream64(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), SEED) >> np.uint64(11)).astype(float)
                key = ratio - np.log(-np.log((u + 0.5) / (1 << 53)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(g) for g in got], pa.int64()), pa.array(ratio, pa.float64()), pa.array(key, pa.float64()), pa.array(sortable(key))], names=["doc_id", "n_ngrams", "log_ratio", "key", "__order"])

    rows = cut(docs.select("doc_id", text_bytes()).mapInArrow(run, "doc_id long, n_ngrams long, log_ratio double, key double, __order long"))
    least = kth_largest(rows, "__order", int(np.ceil(rows.count() * (found if share is None else share))))
    return rows.withColumn("kept", F.lit(False) if least is None else F.col("__order") >= F.lit(least)).drop("__order")
