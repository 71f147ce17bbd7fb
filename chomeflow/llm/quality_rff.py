"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text becomes a vector of statistics of its characters, words and lines.
Standardised, they go through random Fourier features of a Gaussian kernel.
Each partition sums its own normal equations, the driver adds the few sums and
solves for ridge weights, and isotonic regression of the labels on out-of-fold
scores makes scores probabilities.

The fit uses a sample of labelled rows chosen by a hash of the id, of
``SAMPLE_ROWS`` rows expected at most; that bound is what makes its broadcast and
the sums on the driver safe.  Everything else reads all rows and whole texts.

A null text counts as empty.  Rows with a null id are scored but never fitted.  Several labels of an id
count as the highest; null labels are ignored.  With no label, or labels of one
kind only, every score is that share (0.5 without labels).  Repeated rows get
equal scores; equal raw scores are one point of the isotonic fit.  Only the text is an input of a
score.  Long texts are measured as a whole.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.arrow_text import blocks, randoms, released, word_hashes
from chomeflow.llm.tables import Scratch

SAMPLE_ROWS = 20_000
FIT_PARTITIONS = 8
FOURIER = 192
GAMMA = 0.03
RIDGE = 1e-3
THRESHOLD = 0.7


def _lut(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


_CLASSES = np.stack(
    [
        _lut(range(97, 123)),
        _lut(range(65, 91)),
        _lut("0123456789"),
        _lut(" "),
        _lut("\n"),
        _lut(".,;:'\"()-"),
        _lut("!?"),
        _lut("#$%&*+/<=>@[\\]^_`{|}~"),
        _lut(range(192, 256)),
        _lut(range(128, 192)),
    ]
)
N_STATISTICS = 17


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    out = np.zeros((len(column), N_STATISTICS))
    for i, j, data, off in blocks(column):
        size = np.diff(off).astype(float)
        safe = np.maximum(size, 1)
        for k, lut in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(lut[data])])
            out[i:j, k] = (total[off[1:]] - total[off[:-1]]) / safe
        hashes, at = word_hashes(data, off)
        words = np.diff(at)
        unique = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], float)
        out[i:j, 10] = np.log1p(size)
        out[i:j, 11] = np.log1p(words)
        out[i:j, 12] = unique / np.maximum(words, 1)
        out[i:j, 13] = np.log1p(unique) / np.log1p(np.maximum(words, 1))
        out[i:j, 14] = size / np.maximum(words, 1)
        for r in range(i, j):
            lines = [x for x in (column[r].as_py() or "").split("\n") if x]
            if lines:
                out[r, 15] = 1 - len(set(lines)) / len(lines)
                out[r, 16] = np.log1p(size[r - i] / len(lines))
    out[:, 14] = np.minimum(out[:, 14], 60)
    return out


def fourier(x: np.ndarray) -> np.ndarray:
    """Features of standardised statistics: Fourier ones, the statistics, and 1. Fixed by constants only."""
    rng = np.random.default_rng(20)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATISTICS, FOURIER))
    phase = rng.uniform(0, 2 * np.pi, FOURIER)
    x = np.clip(x, -8, 8)
    return np.hstack([np.sqrt(2 / FOURIER) * np.cos(x @ w + phase), x, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, n, lo, hi = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, hi
    at, value = [], []
    for m, _, lo, hi in pools:
        at += [lo] if lo == hi else [lo, hi]
        value += [m] if lo == hi else [m, m]
    return np.array(at), np.array(value)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = fourier((stats - self.mean) / self.scale) @ self.weights
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(doc, label, fold) of the sample."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("double")).alias("_y"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    return joined.select("_text", "_y", F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(2)).cast("int").alias("_fold"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    scratch = Scratch(docs.sparkSession, "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array(list(statistics(b.column(0))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([stats, b.column(1), b.column(2)], ["x", "y", "fold"])

    sample = _labelled(docs, labels, id_col, text_col, label_col, sample_rows).mapInArrow(measure, "x array<double>, y double, fold int")
    sample = scratch.save(sample, "sample").coalesce(FIT_PARTITIONS)

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_STATISTICS))
        n = ones = 0.0
        for b in batches:
            x = matrix(b)
            total += [x.sum(0), (x * x).sum(0)]
            n, ones = n + len(x), ones + float(np.sum(b.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([float(n)]), pa.array([ones])], ["sums", "n", "ones"])

    parts = sample.mapInArrow(moments, "sums binary, n double, ones double").collect()
    n, ones = sum(r["n"] for r in parts), sum(r["ones"] for r in parts)
    if n == 0 or ones in (0, n):
        scratch.drop(sample)
        share = ones / n if n else 0.5
        zero = np.zeros(N_STATISTICS)
        return Model(zero, zero + 1, np.zeros(FOURIER + N_STATISTICS + 1), (np.zeros(1), np.array([share])))
    total = sum(np.frombuffer(r["sums"]).reshape(2, -1) for r in parts)
    mean = total[0] / n
    scale = np.sqrt(np.maximum(total[1] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    width = FOURIER + N_STATISTICS + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width + 1))
        for b in batches:
            z, y, fold = fourier((matrix(b) - mean) / scale), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in (0, 1):
                zk = z[fold == k]
                sums[k, :, :width] += zk.T @ zk
                sums[k, :, width] += zk.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

    sums = sum(np.frombuffer(r["sums"]).reshape(2, width, width + 1) for r in sample.mapInArrow(equations, "sums binary").collect())

    def solve(s: np.ndarray) -> np.ndarray:
        ridge = RIDGE * n / 2 * np.eye(width)
        ridge[-1, -1] = 1e-9
        return np.linalg.solve(s[:, :width] + ridge, s[:, width])

    crossed = [solve(sums[1]), solve(sums[0])]  # a fold is scored by the fit on the other

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, fold = fourier((matrix(b) - mean) / scale), b.column(2).to_numpy()
            raw = np.where(fold == 0, z @ crossed[0], z @ crossed[1])
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column(1)], ["raw", "y"])

    scored = sample.mapInArrow(out_of_fold, "raw double, y double").toPandas()
    knots = isotonic(scored["raw"].to_numpy(), scored["y"].to_numpy())
    scratch.drop(sample)
    return Model(mean, scale, solve(sums[0] + sums[1]), knots)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id (and the columns in ``keep``), held_out, score, predicted of each row. A narrow pass: no shuffle."""
    keep = [id_col] if keep is None else keep
    src = docs.select(*keep, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("_scored_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s = model.scores(statistics(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "held_out", "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", held_out boolean, score double, predicted int"
    return src.mapInArrow(run, schema)
