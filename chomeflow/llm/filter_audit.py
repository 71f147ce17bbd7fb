"""Audit of how filters interact: what each removes in every order in which they can be applied.

Five filters A to E have 120 orders.  What a filter does at its step depends only on which filters stand before
it, not on their order, so 80 edges (already applied subset, next filter) of the subset lattice hold all counts.
Documents are first counted by part, set of filters that they fail, and labels; each of these few counts contributes to 80 edges.  An order is a
path of five edges through the lattice: joining the aggregated edges to the 600 steps of all orders gives every step's counts.

A document fails A with fewer than ``MIN_WORDS`` words, B with too few distinct words, C with too many capitals, D with a
symbol, and E if its text is also that of a smaller id.  The smallest id of each text is found by hashes of texts
(SHA-256, 128 bits), aggregated before they are shuffled; documents are then matched with it by text and id together, so copies of one text are spread out.

A null text counts as empty, and so copies an empty one; a null part is the empty string.  A row with a null id is nobody's copy and makes nobody a copy; it has
no labels.  Repeated rows count each; of equal ids none is smaller.  Several labels of an id count as the highest.  A long text is read in runs of words.
Other columns are ignored.  An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chomeflow.llm.arrow_text import released, word_runs
from chomeflow.llm.tables import Scratch, bounded

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_CAPITALS = bytes(range(65, 91))


def failures(text: str) -> int:
    """The filters A to D that a text fails, as bits from the lowest on."""
    data = text.encode()
    n, distinct = 0, set()
    for words in word_runs(data, _SPACES):
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    held = len(data.translate(None, SYMBOLS)) < len(data)
    failed = (n < MIN_WORDS, 100 * len(distinct) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * len(text), held)
    return sum(1 << i for i, x in enumerate(failed) if x)


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask of failed filters A to D, hash of the text. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(2).to_pylist()]
                masks = pa.array([failures(t) for t in texts], pa.int32())
                marks = pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), masks, marks], ["id", "part", "mask", "mark"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, part string, mask int, mark binary")


def labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with good and toxic of their id."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    no = F.lit(False)
    found = rows.where("id IS NOT NULL").join(bounded(known), "id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    return found.unionByName(rows.where("id IS NULL").withColumns({"good": no, "toxic": no}))


def document_classes(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask of failed filters, good, toxic, and n, the number of such documents: a few rows a part."""
    rows = scratch.save(judged(docs, id_col, text_col, part_col), "judged")
    rows = scratch.save(labelled(rows, labels, id_col), "labelled")
    first = rows.where("id IS NOT NULL").groupBy("mark").agg(F.min("id").alias("id"))
    kind = ["part", "mask", "good", "toxic"]
    count = lambda df, name: df.groupBy(*kind).agg(F.count("*").alias(name))
    unlike = count(rows.join(first, ["mark", "id"], "left_semi").unionByName(rows.where("id IS NULL"), allowMissingColumns=True), "passed")
    both = scratch.save(count(rows, "n").join(unlike, kind, "left").withColumn("passed", F.coalesce("passed", F.lit(0))), "classes")
    copies = both.withColumn("mask", F.col("mask") + (1 << FILTERS.index("E"))).withColumn("n", F.col("n") - F.col("passed"))
    return both.withColumn("n", F.col("passed")).unionByName(copies).where("n > 0").drop("passed")


def lattice_edges(classes: DataFrame) -> DataFrame:
    """part, applied (bits of filters before), next (bit of the filter), and the counts of each of the 80 edges."""
    every = [(s, 1 << i) for i in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> i & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in every)))
    each = classes.withColumn("edge", edge).select("*", "edge.applied", "edge.next")
    here = F.col("mask").bitwiseAND(F.col("applied")) == 0
    fails = F.col("mask").bitwiseAND(F.col("next")) != 0
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    which = [here & ~fails, here & fails, ~here & fails, F.col("mask") == F.col("next"), here & fails & F.col("good"), here & fails & F.col("toxic")]
    return each.groupBy("part", "applied", "next").agg(*(total(w).alias(c) for c, w in zip(COUNTS, which, strict=True)))


def permutation_steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied, next of the five steps of each of the 120 orders."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        rows += [(order, k + 1, sum(bits[:k]), bits[k]) for k in range(len(bits))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, the counts of that step, and shapley: what its filter removes, over all orders."""
    scratch = Scratch(docs.sparkSession, "audit")
    edges = scratch.save(lattice_edges(document_classes(docs, labels, scratch, id_col, text_col, part_col)), "edges")
    steps = edges.join(F.broadcast(permutation_steps(docs.sparkSession)), ["applied", "next"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "next"))
    return steps.withColumn("shapley", shapley).select("part", "filter_order", "step", *COUNTS, "shapley")
