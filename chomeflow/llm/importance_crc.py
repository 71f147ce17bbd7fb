"""Resampling of a corpus towards a target distribution by importance weights over hashed word n-grams.

One scan of a text emits the buckets of its features.  A ring holds the zlib states of the last n
starts of words; each next word extends every state by a space and the word, and starts a
state of its own.  So each run of 1 to n words costs one call, and no run is ever joined.

Buckets are counted over the whole corpus and over the target.  A bucket's gain is the floored, scaled logarithm of
the ratio of the two smoothed shares, and a document's weight the sum of its features' gains.  Gumbel noise from a hash of
the id turns the highest scores into a sample without replacement, in proportion to the weights.

Scores are put in order by a range sort of a few numbers a document, so no task holds them all.  The driver
holds ``n_buckets`` numbers a table, and one number for each partition of the sort.

A null text has no words.  A document without features has weight 0.  A null id is hashed as an empty
string and stands last among ties.  Each repeated row counts, is scored alike and takes a rank of its own.  A long text is read in
runs of words.  Other columns are ignored.  An empty table gives none; an empty target makes all features equally likely in it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.arrow_text import released, word_runs
from chomeflow.llm.tables import Scratch, free_name

ORDER = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
SCALE = 1000

#: A word is a run of digits, letters a-z after lowering A-Z, and bytes beyond ASCII.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def feature_buckets(text: str, order: int = ORDER, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of words, buckets that occur, how often each) of one text."""
    n, seen, times = 0, [], []
    ring: list[int] = []  # states of the last starts, the earliest first
    for words in word_runs(text.encode(), _TABLE):
        n += len(words)
        out: list[int] = []
        for word in words:
            if ring:
                more = b" " + word
                ring = [crc32(more, state) for state in ring]
            ring.append(crc32(word))
            out += ring
            if len(ring) == order:
                del ring[0]
        b, k = np.unique(np.array(out, np.uint32) % np.uint32(n_buckets), return_counts=True)
        seen.append(b)
        times.append(k)
    if len(seen) > 1:
        b, at = np.unique(np.concatenate(seen), return_inverse=True)
        return n, b, np.bincount(at, np.concatenate(times)).astype(np.int64)
    return (n, seen[0], times[0]) if seen else (0, np.zeros(0, np.uint32), np.zeros(0, np.int64))


def featurised(docs: DataFrame, order: int, n_buckets: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, n_features, buckets, times of each row. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [feature_buckets(t or "", order, n_buckets) for t in part.column(1).to_pylist()]
                words = np.array([n for n, _, _ in got], np.int64)
                total = np.array([int(k.sum()) for _, _, k in got], np.int64)
                arrays = [pa.array([x[i].astype(np.int32) for x in got], pa.list_(pa.int32())) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(total), *arrays], [id_col, "n_words", "n_features", "buckets", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, buckets array<int>, times array<int>")


def totals(features: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket occurs in a table of features. Tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    parts = features.select("buckets", "times").mapInArrow(run, "bucket int, n bigint")
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # n_buckets rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The scaled logarithm, floored, of each bucket's smoothed share in the target over that in the corpus."""
    k = len(corpus)
    in_corpus, in_target = float(int(corpus.sum()) + k), float(int(target.sum()) + k)
    return np.array([math.floor(SCALE * math.log(float(t + 1) * in_corpus / (float(s + 1) * in_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: str, doc_id: object) -> int:
    """Scaled Gumbel noise, floored, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 2**32)))


def resampled(
    docs: DataFrame, target: DataFrame, order: int = ORDER, n_buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    percent: int = PERCENT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_features, weight, score, rank of each document: its place among those drawn, else null.

    Of N documents of ``min_words`` words or more, the floor(N * percent / 100) highest scores are drawn; ties go to the smaller id.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    features = scratch.save(featurised(docs, order, n_buckets, id_col, text_col), "features")
    gain = gains(totals(features, n_buckets), totals(featurised(target.withColumn(id_col, F.lit(0)), order, n_buckets, id_col, text_col), n_buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                buckets, times = b.column(3), b.column(4)
                each = np.concatenate([[0], np.cumsum(gain[buckets.flatten().to_numpy()] * times.flatten().to_numpy())])
                edges = np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())])
                weight = each[edges[1:]] - each[edges[:-1]]
                drawn = weight + np.array([noise(seed, i) for i in b.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight), pa.array(drawn)], [*b.schema.names[:3], "weight", "score"])

    row = free_name(features, "_row")
    kind = features.schema[id_col].dataType.simpleString()
    scored = features.mapInArrow(score, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")
    scored = scratch.save(scored.withColumn(row, F.monotonically_increasing_id()), "scored")
    scratch.drop(features)
    may = F.col("n_words") >= min_words
    quota = scored.where(may).count() * percent // 100
    # after the sort, an id's upper bits are its partition's number and the lower 33 its place in it
    ordered = scored.where(may).orderBy(F.desc("score"), F.col(id_col).asc_nulls_last(), row).withColumn(row, F.monotonically_increasing_id())
    ordered = scratch.save(ordered, "ordered")
    part = F.shiftright(row, 33)
    before, offsets = 0, []
    for p, n in sorted(ordered.groupBy(part).count().collect()):  # a row for each partition of the sort
        offsets.append((p, before))
        before += n
    starts = docs.sparkSession.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_before") + F.col(row).bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.join(F.broadcast(starts), part == F.col("_part")).withColumn("rank", F.when(place <= quota, place))
    short = scored.where(~may).withColumn("rank", F.lit(None).cast("bigint"))
    out = [id_col, "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(short.select(*out))
