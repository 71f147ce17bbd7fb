"""Administrative resolution: longest-prefix joins against the registry, with ambiguity and contradiction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.functions.text import lstrip, strip
from chomeflow.sources.registry import Registry


def bucketed_prefix_join(df: DataFrame, text: str, index: DataFrame, out: str) -> DataFrame:
    """``out``: the entry of the longest key that ``text`` starts with, or null; for a register's few keys to two first characters.

    One left join on the first two characters (null-safe, as the planner traces
    plain equalities through all projections below); it keeps rows, and with a
    broadcast index it moves none.
    """
    side = index.select(F.col("bucket").alias("_bucket"), F.col("entries").alias("_entries"))
    joined = df.join(side, F.substring(F.col(text), 1, 2).eqNullSafe(F.col("_bucket")), "left")
    best = F.try_element_at(F.filter("_entries", lambda e: F.startswith(F.col(text), e["key"])), F.lit(1))
    return joined.withColumn(out, best).drop("_bucket", "_entries")


def _after(text: Column, entry: Column) -> Column:
    return lstrip(F.substring(text, entry["n"] + 1, F.length(text)))


def _label(cands: Column) -> Column:
    return F.transform(cands, lambda c: F.concat(c["prefecture_name"], c["name"], F.lit(" ("), c["lg_code"], F.lit(")")))


def resolve(df: DataFrame, registry: Registry, text: str = "_text") -> DataFrame:
    """Adds ``_a``: prefecture, municipality, remaining text and flags of each row's ``text``."""
    munis = registry.municipality_index
    df = df.withColumn("_t", strip(F.col(text)))
    df = bucketed_prefix_join(df, "_t", registry.prefecture_index, "_p")
    df = bucketed_prefix_join(df, "_t", munis, "_m0")
    # a bare stem gives way to a longer municipality name at the same place
    hijacked = (F.col("_p.key") != F.col("_p.name")) & (F.coalesce(F.col("_m0.n"), F.lit(0)) > F.col("_p.n"))
    df = df.withColumn("_p", F.when(~F.coalesce(hijacked, F.lit(False)), F.col("_p")))
    df = df.withColumn("_t1", F.when(F.col("_p").isNotNull(), _after(F.col("_t"), F.col("_p"))))
    df = bucketed_prefix_join(df, "_t1", munis, "_m1")

    has_pref = F.col("_p").isNotNull()
    own = F.filter("_m1.cands", lambda c: c["prefecture_code"] == F.col("_p.code"))
    df = df.withColumn("_cands", F.when(has_pref, own).otherwise(F.col("_m0.cands")))
    df = df.withColumn("_hit", F.when(has_pref, F.col("_m1")).otherwise(F.col("_m0"))).withColumn("_from", F.when(has_pref, F.col("_t1")).otherwise(F.col("_t")))
    found = F.col("_hit").isNotNull()
    n = F.coalesce(F.size("_cands"), F.lit(0))
    df = df.withColumn("_rest", F.when(found, _after(F.col("_from"), F.col("_hit"))).otherwise(F.col("_from")))
    one = F.when(found & (n == 1), F.get("_cands", F.lit(0)))
    df = df.withColumn("_one", one)
    # a designated city is followed into its ward
    ward = F.try_element_at(F.filter("_one.wards", lambda w: F.startswith(F.col("_rest"), w["ward"])), F.lit(1))
    df = df.withColumn("_ward", F.when(F.col("_one.entity_type") == "designated_city", ward))
    inside = F.col("_ward").isNotNull()
    contradictory = F.coalesce(has_pref & found & (n == 0), F.lit(False))
    ambiguous = F.coalesce(found & (n > 1), F.lit(False))
    a = F.struct(
        F.coalesce("_p.code", F.col("_one.prefecture_code")).alias("pref_code"),
        F.coalesce("_p.name", F.col("_one.prefecture_name")).alias("pref"),
        F.when(inside, F.col("_ward.lg_code")).otherwise(F.col("_one.lg_code")).alias("lg_code"),
        F.col("_one.city").alias("city"),
        F.when(inside, F.col("_ward.ward")).otherwise(F.col("_one.ward")).alias("ward"),
        F.when(~inside, F.col("_one.county")).alias("county"),
        F.when(contradictory, F.col("_from")).when(inside, lstrip(F.substring(F.col("_rest"), F.length("_ward.ward") + 1, F.length("_rest")))).otherwise(F.col("_rest")).alias("rest"),
        (~has_pref & found).alias("inferred"),
        ambiguous.alias("ambiguous"),
        F.when(ambiguous, _label(F.col("_cands"))).otherwise(F.array().cast("array<string>")).alias("candidates"),
        F.when(ambiguous | contradictory, F.col("_hit.key")).alias("matched"),
        contradictory.alias("contradictory"),
    )
    return df.withColumn("_a", a).drop("_t", "_p", "_m0", "_t1", "_m1", "_cands", "_hit", "_from", "_rest", "_one", "_ward")
