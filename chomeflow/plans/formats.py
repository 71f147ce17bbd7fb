"""Text and JSON forms of results, as column functions. Lines whose value is null vanish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and sentences of the text forms are fixed values.


def to_json(c: Column) -> Column:
    """A struct as JSON, nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def _line(label: str, value: Column, width: int) -> Column:
    return F.concat(F.lit(f"{label}:".ljust(width)), value.cast("string"))


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def normalized_text(n: Column) -> Column:
    c = n["components"]
    values = {
        "Prefecture": c["prefecture"], "County": c["county"], "City": c["city"], "Ward": c["ward"], "Town": c["town"], "Oaza": c["oaza"], "Koaza": c["koaza"],
        "Kyoto": c["kyoto_direction"]["raw_clause"], "Hokkaido": c["hokkaido_grid"]["raw_clause"], "Chome": c["chome"], "Ban": c["ban"], "Go": c["go"],
        "Banchi": c["banchi"], "Edaban": c["edaban"], "Building": c["building"], "Floor": c["floor"], "Unit": c["unit"], "Regime": c["address_regime"], "LG Code": c["lg_code"],
        "Ambiguity": F.when(c["is_ambiguous"], F.concat(F.lit("AMBIGUOUS ("), F.array_join(c["ambiguous_candidates"], ", "), F.lit(")"))),
        "Confidence": _two(n["confidence_score"]), "Canonical": n["canonical"],
    }
    rejected = F.concat(_line("Input", n["input_raw"], 12), F.lit("\nStatus:     Rejected (unrecognized or malformed address)\nConfidence: 0.00\nCanonical:  "))
    return F.when(n["confidence_score"] == 0.0, rejected).otherwise(F.concat_ws("\n", *[_line(k, v, 12) for k, v in values.items()]))


def parsed_text(n: Column) -> Column:
    c = n["components"]
    inner = lambda label, value: F.concat(F.lit("  " + f"{label}:".ljust(15)), value.cast("string"))
    code = F.coalesce(F.concat(F.lit(" (Code: "), c["prefecture_code"], F.lit(")")), F.lit(""))
    pref = F.concat(c["prefecture"], code, F.when(c["prefecture_inferred"], " [inferred]").otherwise(""))
    k, h = c["kyoto_direction"], c["hokkaido_grid"]
    section = lambda title, *lines: F.concat_ws("\n", F.lit(f"[{title}]"), *lines)
    admin = [("Prefecture", pref), ("County", c["county"]), ("City", c["city"]), ("Ward", c["ward"]), ("LG Code", c["lg_code"]), ("Town", c["town"]), ("Oaza", c["oaza"]), ("Koaza", c["koaza"])]
    place = F.concat(F.lit("Jo="), h["jo"].cast("string"), F.lit(" ("), h["cardinal_ns"], F.lit("), Chome="), h["chome"].cast("string"), F.lit(" ("), h["cardinal_ew"], F.lit(")"))
    regional = [
        ("Thoroughfare", k["street_1"]),
        ("Cross Street", k["street_2"]),
        ("Direction", F.concat(k["direction"], F.lit(" ("), k["cardinal"], F.lit(")"))),
        ("Hokkaido Grid", h["raw_clause"]),
        ("Coordinates", place),
    ]
    block = [("Chome", c["chome"]), ("Ban", c["ban"]), ("Go", c["go"]), ("Banchi", c["banchi"]), ("Edaban", c["edaban"]), ("Regime", c["address_regime"])]
    building = [("Building", c["building"]), ("Floor", c["floor"]), ("Unit", c["unit"])]
    status = [
        ("Confidence", _two(n["confidence_score"])),
        ("Ambiguous", F.when(c["is_ambiguous"], "True").otherwise("False")),
        ("Candidates", F.when(c["is_ambiguous"], F.array_join(c["ambiguous_candidates"], ", "))),
        ("Unparsed Tail", c["unparsed_tail"]),
    ]
    lines = lambda pairs: [inner(a, b) for a, b in pairs]
    whole = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Input: "), n["input_raw"], F.lit("\n")),
        section("Administrative", *lines(admin)),
        F.when(k.isNotNull() | h.isNotNull(), section("Regional Convention", *lines(regional))),
        section("Block & Lot", *lines(block)),
        F.when(F.coalesce(c["building"], c["floor"], c["unit"]).isNotNull(), section("Building & Unit", *lines(building))),
        section("Classification", *lines(status)),
    )
    rejected = F.concat(
        _line("Input", n["input_raw"], 14), F.lit("\nStatus:       Rejected (Confidence: 0.00)\nError:        Could not decompose input into Japanese address components.")
    )
    return F.when(n["confidence_score"] == 0.0, rejected).otherwise(whole)


def _bullets(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("Candidates:\n"), F.array_join(F.transform(items, lambda c: F.concat(F.lit("  • "), c)), "\n")))


def validation_text(v: Column) -> Column:
    pairs = [("Input", v["raw_input"]), ("Status", v["status"]), ("Valid", F.when(v["valid"], "Yes").otherwise("No")), ("Confidence", _two(v["confidence_score"]))]
    pairs += [("LG Code", v["lg_code"]), ("Regime", v["address_regime"]), ("Message", v["message"])]
    return F.concat_ws("\n", *[_line(a, b, 13) for a, b in pairs], _bullets(v["ambiguous_candidates"]))


def geocoded_text(g: Column) -> Column:
    at = F.format_string("%.6f, %.6f (Lat, Lon)", g["coordinates"]["latitude"], g["coordinates"]["longitude"])
    pairs = [("Input", g["query"]), ("Status", g["status"]), ("Provider", g["provider"]), ("Coordinates", F.when(g["coordinates"].isNotNull(), at)), ("Matched", g["matched_address"])]
    return F.concat_ws("\n", *[_line(a, b, 13) for a, b in pairs], _bullets(g["candidates"]), _line("Message", g["error_message"], 13))
