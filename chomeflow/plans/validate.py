"""Validation: ordered rules over a normalised address, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.functions.text import is_blank, strip
from chomeflow.plans.normalize import normalize
from chomeflow.sources.registry import Registry

ACCEPTED, AMBIGUOUS, MALFORMED, UNSUPPORTED = "ACCEPTED", "AMBIGUOUS", "MALFORMED", "UNSUPPORTED"
EXIT_CODES = {ACCEPTED: 0, MALFORMED: 1, AMBIGUOUS: 2, UNSUPPORTED: 3}

_RULES = ["blank", "contradictory", "zero", "ambiguous", "tail", "accepted"]

# Statuses and messages are fixed values.


def validation(n: Column) -> Column:
    """The validation struct of a ``normalized`` struct."""
    c = n["components"]
    tail = F.coalesce(F.length(strip(c["unparsed_tail"])) > 5, F.lit(False))
    rule = (
        F.when(is_blank(n["input_raw"]), "blank")
        .when(c["is_contradictory"], "contradictory")
        .when(n["confidence_score"] == 0.0, "zero")
        .when(c["is_ambiguous"], "ambiguous")
        .when(tail, "tail")
        .when(c["lg_code"].isNotNull() & (n["confidence_score"] >= 0.5), "accepted")
        .otherwise("unresolved")
    )
    count = F.size(c["ambiguous_candidates"]).cast("string")
    status = F.when(rule.isin("blank", "contradictory", "zero"), MALFORMED).when(rule == "ambiguous", AMBIGUOUS).when(rule == "accepted", ACCEPTED).otherwise(UNSUPPORTED)
    message = (
        F.when(rule == "blank", "Empty or whitespace address string.")
        .when(rule == "contradictory", "Contradiction detected: municipality does not belong to specified prefecture.")
        .when(rule == "zero", "Input rejected: no recognized Japanese administrative jurisdiction or structure.")
        .when((rule == "ambiguous") & c["prefecture"].isNotNull(), F.concat(F.lit("Ambiguous administrative jurisdiction matches "), count, F.lit(" candidates.")))
        .when(rule == "ambiguous", F.concat(F.lit("Omitted prefecture matches "), count, F.lit(" statutory municipalities.")))
        .when(rule == "tail", F.concat(F.lit("Input contains unparsed or unsupported tokens: '"), c["unparsed_tail"], F.lit("'.")))
        .when(rule == "accepted", "Local government entity verified against official statutory registry.")
        .otherwise("Administrative entity could not be resolved to a local government code.")
    )
    scored = F.when(rule.isin("blank", "contradictory", "zero"), 0.0).otherwise(n["confidence_score"])
    regime = F.when(rule.isin("blank", "zero"), "unspecified").otherwise(c["address_regime"])
    return F.struct(
        n["input_raw"].alias("raw_input"),
        status.alias("status"),
        (rule == "accepted").alias("valid"),
        scored.alias("confidence_score"),
        regime.alias("address_regime"),
        F.when(rule.isin("tail", "accepted", "unresolved"), c["lg_code"]).alias("lg_code"),
        (rule == "ambiguous").alias("is_ambiguous"),
        F.when(rule == "ambiguous", c["ambiguous_candidates"]).otherwise(F.array().cast("array<string>")).alias("ambiguous_candidates"),
        message.alias("message"),
    )


def validate(df: DataFrame, address: str = "address", out: str = "validation", registry: Registry | None = None) -> DataFrame:
    """``df`` with a struct ``out``."""
    x = normalize(df, address, "_n_" + out, registry)
    return x.withColumn(out, validation(F.col("_n_" + out))).drop("_n_" + out)


def exit_code(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair]), status)
