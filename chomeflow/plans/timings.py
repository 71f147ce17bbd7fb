"""Aggregates of measured times, by corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which a corpus' values are cut; one part of one corpus is what a task sorts.
PARTS = 100
#: Corpora whose edges (PARTS numbers each) may be broadcast: some 80 MB.
BROADCAST_CORPORA = 100_000


def aggregates(times: DataFrame, corpus: str = "corpus", us: str = "us", parts: int = PARTS) -> DataFrame:
    """corpus, n, total_us, mean_us, p50_us, p90_us, p99_us, min_us, max_us, per_sec.

    The median interpolates; the other percentiles are the value at index int(n * q) of the sorted
    list.  Null times don't count; a null corpus is one of its own.

    Percentiles are exact, and no task holds a corpus: equal values are counted first, an approximate sketch cuts
    each corpus into parts, the parts' sizes tell in which of them an index falls, and only those parts are put in order.
    """
    t = times.where(F.col(us).isNotNull()).select(F.col(corpus).alias("_c"), F.col(us).cast("double").alias("_us"))
    counted = t.groupBy("_c", "_us").agg(F.count("*").alias("_n"))
    edges = counted.groupBy("_c").agg(F.percentile_approx("_us", [k / parts for k in range(1, parts)] or [0.5]).alias("_edges"))
    edges = edges.withColumnRenamed("_c", "_ec")
    edges = F.broadcast(edges) if edges.count() <= BROADCAST_CORPORA else edges
    placed = counted.join(edges, F.col("_c").eqNullSafe(F.col("_ec"))).select("_c", "_us", "_n", F.size(F.filter("_edges", lambda e: e < F.col("_us"))).alias("_part"))
    sizes = placed.groupBy("_c", "_part").agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_c").orderBy("_part")) - F.col("_size")  # of ``parts`` rows at most
    sizes = sizes.withColumn("_before", before)
    whole = t.groupBy("_c").agg(F.count("*").alias("n"), F.sum("_us").alias("total_us"), F.avg("_us").alias("mean_us"), F.min("_us").alias("min_us"), F.max("_us").alias("max_us"))
    n = F.col("n")
    indexes = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p90_us": F.floor(n * 90 / 100), "p99_us": F.floor(n * 99 / 100)}
    wanted = whole.select(F.col("_c").alias("_wc"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("at")) for k, v in indexes.items()])).alias("w")).select("_wc", "w.*")
    inside = (F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_size"))
    wanted = sizes.join(wanted, F.col("_c").eqNullSafe(F.col("_wc")) & inside).select(F.col("_wc"), F.col("_part").alias("_wp"), "_before", "name", "at")
    same = F.col("_c").eqNullSafe(F.col("_wc")) & (F.col("_part") == F.col("_wp"))
    ordered = placed.join(wanted.select("_wc", "_wp", "_before").distinct(), same).drop("_wc", "_wp")
    ordered = ordered.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_c", "_part").orderBy("_us"))).drop("_before")
    hit = same & (F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_n"))
    named = lambda k: F.max(F.when(F.col("name") == k, F.col("_us"))).alias(k)
    found = ordered.join(wanted, hit).groupBy(F.col("_c").alias("_fc")).agg(*map(named, indexes))
    return whole.join(found, F.col("_c").eqNullSafe(F.col("_fc"))).select(
        F.col("_c").alias(corpus), "n", "total_us", "mean_us", (F.col("low") * 0.5 + F.col("high") * 0.5).alias("p50_us"), "p90_us", "p99_us", "min_us", "max_us", (n * 1e6 / F.col("total_us")).alias("per_sec")
    )
