"""Repeated passages by sparse suffix arrays.

A text is the sequence of its words (as 64-bit hashes, A-Z lowered).  Suffixes are
kept only at minimiser positions: those where the hash of ``GRAM`` words is the
least among ``WINDOW`` running ones.  Equal passages have equal minimisers, and a
passage of ``PASSAGE`` words has one among its first ``WINDOW`` words, with at least
``ROOT`` words behind it.

A passage belongs to the minimiser of its first ``WINDOW`` words, so equal passages
belong to suffixes of equal roots, a root being the first ``ROOT`` words.  Roots are
counted first; a bitmap of those that occur more than once, of ``bitmaps.BITS`` bits at most,
tells which suffixes go on.  It never misses one, and what it lets through in vain only costs
sorting.  Each suffix that goes on brings the 64-bit hashes of all passages of
``PASSAGE`` words that belong to it.  Suffixes are sorted in all partitions together by
root, and passages with a hash that occurs at another place of the root are repeated.
Longer ones are covered by the passages in them.

Sorting is by range and ranges are cut within groups of equal roots, so no
passage is too common for a task.  The first and last root of a range, and those of
more than ``HELD`` rows, may not be whole in a task: one place of each of their hashes
goes to a second step, which finds those that several tasks have.

Texts of equal words form a class and one of them is sorted; a class of several rows and of
``PASSAGE`` words or more is repeated as a whole.  Null and empty texts have no words.
Rows with a null id are reported with a null id; rows of one id are told apart by their texts.
Repeated rows are copies of each other.  A long text is read as a whole; what it needs grows
with its words.  Other columns are ignored.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.arrow_text import blocks, mix, randoms, released, word_hashes
from chomeflow.llm.bitmaps import Bitmap, bitmap
from chomeflow.llm.tables import Scratch, bounded

PASSAGE = 50
GRAM = 6
WINDOW = 25
ROOT = PASSAGE - WINDOW + 1
#: Suffixes of one root that a task holds at once.
HELD = 50_000

_C = randoms(61, PASSAGE)


def _running(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words running."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            out += words[j : len(words) - n + 1 + j] * _C[j]
        return mix(out)


def minimisers(words: np.ndarray) -> np.ndarray:
    """The minimiser position of each run of WINDOW grams, in order: the least hash, of equal ones the first."""
    grams = _running(words, GRAM)
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if WINDOW > span:
        low = np.minimum(low[: span - WINDOW], low[WINDOW - span :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def text_classes(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of all words of each text."""
    n = np.diff(ends)
    some = np.flatnonzero(n)
    total = np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(1, len(words) + 1) - np.repeat(ends[:-1], n)
        if len(some):
            total[some] = np.add.reduceat(mix(words ^ mix(place.astype(np.uint64))), ends[some])
        return mix(total + n.astype(np.uint64)).view(np.int64)


class _Owned:
    """The passages of some texts, as runs of those that belong to one suffix: text, first passage's start in it, number, root."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = np.maximum(np.diff(ends) - PASSAGE + 1, 0)
        before = np.cumsum(n) - n
        #: places in ``words`` of all passages
        self.at = np.arange(n.sum()) - np.repeat(before, n) + np.repeat(ends[:-1], n)
        text = np.repeat(np.arange(len(n)), n)
        own = minimisers(words)[self.at]
        cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(text) != 0)) + 1
        edge = np.concatenate([[0], cut, [len(own)]]) if len(own) else np.zeros(1, np.int64)
        first = edge[:-1]
        self.n = np.diff(edge)
        self.text = text[first]
        self.start = self.at[first] - ends[self.text]
        self.root = _running(words, ROOT)[own[first]].view(np.int64) if len(own) else np.zeros(0, np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of id, hash, text: id, hash, number of words, class and the roots of the text's suffixes."""
    for batch in released(batches):
        for i, j, data, off in blocks(batch.column(2)):
            words, ends = word_hashes(data, off)
            owned = _Owned(words, ends)
            lists = np.searchsorted(owned.text, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(ends)), pa.array(text_classes(words, ends)), pa.ListArray.from_arrays(lists, pa.array(owned.root))],
                ["_id", "_h", "n_words", "cls", "roots"],
            )


def _passages(shared: Bitmap, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, cls, start, hashes) of each suffix of a shared root: the successive passages that belong to it, and where the first starts."""
    for batch in released(batches):
        for _, _, data, off in blocks(batch.column(0)):
            words, ends = word_hashes(data, off)
            owned = _Owned(words, ends)
            hit = shared.has(owned.root)
            if not hit.any():
                continue
            hashes = _running(words, PASSAGE)[owned.at[np.repeat(hit, owned.n)]]
            edge = np.concatenate([[0], np.cumsum(8 * owned.n[hit])]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(hashes)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(owned.root[hit]), pa.array(text_classes(words, ends)[owned.text[hit]]), pa.array(owned.start[hit].astype(np.int32)), packed], ["root", "cls", "start", "hashes"]
            )


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, cls, start) of each passage of the rows."""
    packed = rows.column(3).combine_chunks()
    _, off, data = packed.buffers()
    off = np.frombuffer(off, np.int32)[packed.offset : packed.offset + len(packed) + 1] // 8
    n = np.diff(off).astype(np.int64)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(data, np.int64)[off[0] : off[-1]], np.repeat(rows.column(1).to_numpy(), n), np.repeat(rows.column(2).to_numpy(), n) + place


def _spans(cls: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cls, start, stop) of passages in order, those that start at successive words as one."""
    cut = np.flatnonzero((np.diff(cls) != 0) | (np.diff(start) != 1)) + 1
    edge = np.concatenate([[0], cut, [len(cls)]]) if len(cls) else np.zeros(1, np.int64)
    return cls[edge[:-1]], start[edge[:-1]], start[edge[1:] - 1] + PASSAGE


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (cls, start, stop) of passages that are repeated here; and, with its hash, one place of each passage of roots that may not be whole here."""
    held: pa.Table | None = None
    cut = None  # a root that may not be whole here

    def resolved(rows: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        # a row may come more than once
        key = [rows.column(k).to_numpy() for k in range(3)]
        fresh = np.ones(rows.num_rows, bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        h, cls, start = _flat(rows.filter(pa.array(fresh)))
        values, first, at, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        some = count[at] > 1
        c, x, y = _spans(cls[some], start[some])
        n, m = len(c), 0 if whole else len(first)
        first, values = first[:m], values[:m]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([c, cls[first]])),
                pa.array(np.concatenate([x, start[first]]).astype(np.int32)),
                pa.array(np.concatenate([y, start[first] + PASSAGE]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(n, np.int64), values]), mask=np.arange(n + m) < n),
            ],
            ["cls", "start", "stop", "h"],
        )

    for batch in released(batches):
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        root = rows.column(0).to_numpy()
        if cut is None:
            cut = root[0]
        a = int(np.searchsorted(root, cut, side="right"))
        last = max(a, int(np.searchsorted(root, root[-1], side="left")))
        yield from resolved(rows.slice(0, a), whole=False)
        yield from resolved(rows.slice(a, last - a), whole=True)
        held = rows.slice(last)
        if held.num_rows > HELD:
            cut = root[-1]
            yield from resolved(held, whole=False)
            held = None
    if held is not None:
        yield from resolved(held, whole=False)


def _matches(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, start, stop) of repeated passages."""
    order = ["root", "cls", "start"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_repeats, "cls bigint, start int, stop int, h bigint")
    found = scratch.save(found, "matches")
    # a task tells a hash once for each piece of a root, so a list here is no longer than the pieces
    told = found.where("h IS NOT NULL").groupBy("h").agg(F.collect_set(F.struct("cls", "start", "stop")).alias("places")).where(F.size("places") > 1)
    return found.where("h IS NULL").drop("h").unionByName(told.select(F.inline("places")))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cls and sorted spans (start, stop): overlapping and touching ones as one, counted, and as text."""
    for batch in batches:
        n, words, shown = [], [], []
        for spans in batch.column(1):
            start, stop = (spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            reach = np.maximum.accumulate(stop)
            first = np.concatenate([[0], np.flatnonzero(start[1:] > reach[:-1]) + 1])
            a, b = start[first], reach[np.concatenate([first[1:] - 1, [len(reach) - 1]])]
            n.append(len(a))
            words.append(int((b - a).sum()))
            shown.append(",".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(shown, pa.string())], ["cls", "n_spans", "repeated_words", "spans"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_spans, repeated_words, spans ("start:stop" in words, joined by commas) of each row with a repeated passage."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    sketches = scratch.save(read.mapInArrow(_sketch, f"_id {kind}, _h bigint, n_words bigint, cls bigint, roots array<bigint>"), "sketches")
    rows = scratch.save(sketches.drop("roots"), "rows")
    one = sketches.groupBy("cls").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("roots").alias("roots"))
    classes = scratch.save(one, "classes")
    shared = classes.select(F.explode("roots").alias("root")).groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    shared = scratch.save(shared, "shared-roots")
    scratch.drop(sketches)

    # copies of a text are left out where they have an id; others are told apart while sorting
    several = classes.where("copies > 1").select("cls", "rep")
    surplus = rows.where("_id IS NOT NULL").join(several, "cls").where((F.col("rep._id") != F.col("_id")) | (F.col("rep._h") != F.col("_h"))).select("_id", "_h").distinct()
    texts = read.join(bounded(scratch.save(surplus, "surplus")), ["_id", "_h"], "left_anti").select("_text")
    marked = bitmap(shared, "root")
    found = texts.mapInArrow(lambda batches: _passages(marked, batches), "root bigint, cls bigint, start int, hashes binary")
    found = scratch.save(found, "suffixes")
    matches = _matches(found, scratch)
    whole = classes.where((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE)).select("cls", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"))
    spans = matches.unionByName(whole).distinct().groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    spans = scratch.save(spans.mapInArrow(_merged, "cls bigint, n_spans bigint, repeated_words bigint, spans string"), "spans")
    scratch.drop(classes, shared, found)
    return rows.join(spans, "cls").select(F.col("_id").alias(id_col), "n_words", "n_spans", "repeated_words", "spans")
