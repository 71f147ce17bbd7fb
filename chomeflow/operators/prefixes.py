"""Longest prefixes by a ladder of hashed prefixes.

The lengths of an index's keys form a balanced search tree.  A key's rungs are its prefixes of the smaller lengths
on the way to its own; each rung knows the longest key that it starts with.  A text is looked up by its prefix of the length at the root;
if that is a rung, the search goes on among longer lengths, else among shorter ones.  So 255
lengths take eight equi-joins, whatever the number of keys, from any offset of the text, and never return to a length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a ladder (a few short columns) that may be broadcast: some 50 MB.
BROADCAST_ROWS = 500_000


@dataclass
class _Node:
    length: int
    shorter: _Node | None = None
    longer: _Node | None = None


def _tree(lengths: list[int]) -> _Node | None:
    if not lengths:
        return None
    mid = len(lengths) // 2
    return _Node(lengths[mid], _tree(lengths[:mid]), _tree(lengths[mid + 1 :]))


@dataclass
class Ladder:
    """``rungs``: prefix, n (its length), key (the longest key that it starts with, or null). ``lengths``: of all keys."""

    rungs: DataFrame
    lengths: list[int]
    small: bool = field(default=False)

    @property
    def levels(self) -> list[list[_Node]]:
        out, level = [], [root] if (root := _tree(self.lengths)) else []
        while level:
            out.append(level)
            level = [x for node in level for x in (node.shorter, node.longer) if x]
        return out


def _way(lengths: list[int], to: int) -> list[int]:
    """The lengths at which the search for a key of length ``to`` finds a rung."""
    node, out = _tree(lengths), []
    while node and node.length != to:
        if node.length < to:
            out.append(node.length)
            node = node.longer
        else:
            node = node.shorter
    return [*out, to]


def prefix_ladder(keys: DataFrame, key: str = "key") -> Ladder:
    """The ladder of the distinct keys of a table; null and empty keys are ignored. The driver gets the lengths that occur."""
    keys = keys.where(F.col(key) != "").select(F.col(key).alias("key")).distinct()
    lengths = sorted(r[0] for r in keys.select(F.length("key")).distinct().collect())
    if not lengths:
        none = keys.select(F.col("key").alias("prefix"), F.length("key").alias("n"), "key")
        return Ladder(none, [], True)
    ways = F.create_map(*[x for n in lengths for x in (F.lit(n), F.array(*[F.lit(m) for m in _way(lengths, n)]))])
    rungs = keys.select("key", F.explode(ways[F.length("key")]).alias("n")).select(F.substring(F.col("key"), F.lit(1), F.col("n")).alias("prefix"), "n").distinct()
    starts = rungs.select("prefix", "n", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("k")).where("k <= n")
    known = starts.select("prefix", F.substring(F.col("prefix"), F.lit(1), F.col("k")).alias("key"), "k").join(keys, "key")
    best = known.groupBy("prefix").agg(F.max_by("key", "k").alias("key"))
    return Ladder(rungs.join(best, "prefix", "left"), lengths)


def bounded(ladder: Ladder) -> Ladder:
    """A ladder to be broadcast in joins if its rungs, which are counted, are few enough."""
    return Ladder(ladder.rungs, ladder.lengths, ladder.rungs.count() <= BROADCAST_ROWS)


def longest_prefix_join(df: DataFrame, text: str, ladder: Ladder, out: str, start: Column | int = 0) -> DataFrame:
    """``out``: key, n and next of the longest key that begins in ``text`` at the offset ``start``, or null; next is the offset behind it.

    A null text or offset, and one before or behind the text, find nothing.  Rows are kept; with a ladder that is broadcast none moves.
    Joins are null-safe, as the planner traces plain equalities through all projections below.
    """
    offset = start if isinstance(start, Column) else F.lit(start)
    n, best = f"_n_{out}", f"_k_{out}"
    levels = ladder.levels
    df = df.withColumns({n: F.lit(levels[0][0].length if levels else 0), best: F.lit(None).cast("string")})
    side = ladder.rungs.select(F.col("prefix").alias("_prefix"), F.col("n").alias("_found"), F.col("key").alias("_best"))
    inside = F.when(offset >= 0, offset + 1).otherwise(F.length(text) + 1)
    for level in levels:
        df = df.join(F.broadcast(side) if ladder.small else side, F.substring(F.col(text), inside, F.col(n)).eqNullSafe(F.col("_prefix")), "left")
        found = F.coalesce(F.col("_found") == F.col(n), F.lit(False))  # a text that ends early is no rung of that length
        further = F.lit(0)
        for node in level:
            after = F.when(found, node.longer.length if node.longer else 0).otherwise(node.shorter.length if node.shorter else 0)
            further = F.when(F.col(n) == node.length, after).otherwise(further)
        df = df.withColumns({best: F.when(found & F.col("_best").isNotNull(), F.col("_best")).otherwise(F.col(best)), n: further}).drop("_prefix", "_found", "_best")
    hit = F.struct(F.col(best).alias("key"), F.length(best).alias("n"), (offset + F.length(best)).alias("next"))
    return df.withColumn(out, F.when(F.col(best).isNotNull(), hit)).drop(n, best)
