"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Up to ``ONE_TASK`` links, a size that is checked, a single task finishes the work by
union-find; the steps are for what is larger, and give the same components.

Links are ``_a`` and ``_b``, two longs.  Each step replaces a link by one to the smaller
end, so the table never grows beyond its links, and a hub's links are joined to
its minimum as two plain shuffled tables, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.tables import Scratch


#: Links that one task may hold: 16 MB of them.
ONE_TASK = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all links that come; the smaller root always wins, so roots are the smallest nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "comp"])


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node with a link to another node; comp is the smallest node reachable."""
    a, b = F.col("_a"), F.col("_b")

    def facing(df: DataFrame) -> DataFrame:
        """Links from the larger to the smaller end, each once."""
        return df.where("_a <> _b").select(F.greatest(a, b).alias("_a"), F.least(a, b).alias("_b")).distinct()

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        return tuple(r)

    now = scratch.save(facing(links), "links")
    was = state(now)
    if was[0] <= ONE_TASK:
        return scratch.save(now.coalesce(1).mapInArrow(_united, "node bigint, comp bigint"), "components")
    while True:
        both = now.unionByName(now.select(b.alias("_a"), a.alias("_b")))
        least = scratch.save(both.groupBy("_a").agg(F.least(F.min("_b"), F.first("_a")).alias("_m")), "least")
        large = facing(both.where("_b > _a").join(least, "_a").select(b.alias("_a"), F.col("_m").alias("_b")))
        large = scratch.save(large, "large")
        least2 = scratch.save(large.groupBy("_a").agg(F.min("_b").alias("_m")), "least")
        small = large.join(least2, "_a").select(b.alias("_a"), F.col("_m").alias("_b")).unionByName(least2.select("_a", F.col("_m").alias("_b")))
        after = scratch.save(facing(small), "links")
        scratch.drop(now, least, large, least2)
        now, before = after, was
        was = state(now)
        if was == before:
            break
    roots = now.groupBy("_b").agg(F.lit(1).alias("_one")).select(F.col("_b").alias("node"), F.col("_b").alias("comp"))
    return scratch.save(now.select(a.alias("node"), b.alias("comp")).unionByName(roots), "components")
