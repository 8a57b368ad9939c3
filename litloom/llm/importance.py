"""Quality classifier by importance resampling.

Words and word pairs are hashed to BUCKETS features. The raw model counts the features of all documents, the target
model those of the documents labelled as good; a document's weight is the log of the ratio of its probabilities under
the two, the sum of the log ratios of its features. With Gumbel noise drawn from a hash of its id the top k are a sample without replacement in
proportion to exp(weight); k is the rate of good among labelled documents, times all.

Counts are vectors of fixed length, summed in the tasks before they are dealt out. The k-th key is found exactly by
radix selection over sortable 64-bit keys, 16 bits a pass; ties at the k-th are all kept.

Defined results: wordless and null texts have weight 0 before noise; without labels all have weight 0 and all are
kept; rows that repeat an id share its noise, and all rows of a labelled id teach; null ids share theirs and teach
nothing; very long texts count with all their features; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_columns, settle
from .rolling import Text, grams, mixed

BUCKETS, SMOOTH = 1 << 16, 0.5
#: The model of good text is fitted on so many labelled documents at most, the first by a hash of their ids.
FITTED = 100_000


def features(text: str | None) -> np.ndarray:
    """The bucket of each word and each pair of words."""
    words = Text((text or "").lower()).words()
    both = np.concatenate([mixed(words + np.uint64(1)), grams(words, 2)])
    return (both >> np.uint64(48)).astype(np.int64)


def counts(docs: DataFrame) -> np.ndarray:
    """(2, BUCKETS): features of all rows of text, good, and of the good ones."""

    def count(batches):
        own = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for t, good in zip(*(c.to_pylist() for c in batch.columns)):
                got = np.bincount(features(t), minlength=BUCKETS)
                own[0] += got
                if good:
                    own[1] += got
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([r.tobytes() for r in own.reshape(4, -1)], pa.binary())], names=["part", "counts"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part long, counts binary"
    out = np.zeros((4, BUCKETS // 2), np.int64)
    for k, raw in map_arrow(map_arrow(docs, count, schema).repartition(4, "part"), add, schema).collect():
        out[k] += np.frombuffer(bytes(raw), np.int64)
    return out.reshape(2, BUCKETS)


def log_ratio(both: np.ndarray) -> np.ndarray:
    raw, target = both + SMOOTH
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if both[1].any() else np.zeros(BUCKETS)


def _weights(ratio):
    def step(keys, seeds, texts):
        weight, order = [], []
        noise = (mixed(np.array(seeds, np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64)
        noise = -np.log(-np.log((noise + 0.5) / 2.0**53))
        for t, g in zip(texts, noise):
            at = features(t)
            w = float(ratio.value[at].sum())
            bits = int(np.float64(w + g).view(np.int64))
            weight.append(w)
            order.append(bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF)
        return keys, weight, order

    return step


def kth(keys: DataFrame, k: int) -> int:
    """The k-th largest of the long column key, by four passes of 65,536 counts at most."""
    digits = keys.select((F.shiftright("key", 48) + 32768).alias("d3"), *[F.shiftright("key", s).bitwiseAND(F.lit(65535)).alias(f"d{s // 16}") for s in (32, 16, 0)])
    prefix: list[int] = []
    for d in (3, 2, 1, 0):
        rows = digits
        for at, v in zip((3, 2, 1), prefix):
            rows = rows.where(F.col(f"d{at}") == v)
        for value, n in sorted(((int(v), n) for v, n in rows.groupBy(f"d{d}").count().collect()), reverse=True):
            if k <= n:
                prefix.append(value)
                break
            k -= n
    a, b, c, d = prefix
    return ((a - 32768) << 48) | (b << 32) | (c << 16) | d


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", rate: float | None = None, fitted: int = FITTED) -> DataFrame:
    """id, weight (log ratio), kept; a row for each row of docs. labels: id, good. rate: the part to keep.

    The model of good text is fitted on the fitted first good ids by hash: that many ids are broadcast, so that no text
    is shuffled. All else (the model of raw text, the rate, the weights, the choice) covers all rows.
    """
    spark = docs.sparkSession
    known = labels.groupBy(F.col(id).alias("of")).agg(F.max(F.col("good").cast("int")).alias("good"))
    share = known.agg(F.avg("good")).first()[0] if rate is None else rate
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    good = F.broadcast(known.where("good = 1").select("of").orderBy(F.xxhash64("of"), "of").limit(fitted))
    target = rows.join(good, F.col("id") == F.col("of"), "left_semi").select("text")
    own = counts(rows.select("text", F.lit(False).alias("good")))
    own[1] = counts(target.select("text", F.lit(True).alias("good")))[1]
    ratio = spark.sparkContext.broadcast(log_ratio(own))
    kind = docs.schema[id].dataType.simpleString()
    scored = settle(map_columns(rows.select("id", F.xxhash64("id", F.lit(9)).alias("seed"), "text"), f"id {kind}, weight double, key long", _weights, ratio), "weights")
    n = scored.count()
    k = n if share is None else int(round(share * n))
    if k <= 0 or not n:
        return scored.select(F.col("id").alias(id), "weight", F.lit(False).alias("kept"))
    least = kth(scored, k)
    return scored.select(F.col("id").alias(id), "weight", (F.col("key") >= least).alias("kept"))
