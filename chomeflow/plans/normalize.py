"""The whole pipeline: address text to canonical text, components, tiers and confidence.

Stages are projections; each reads columns that the one before computed once.
Three broadcast joins look up the registry; rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.functions import text as T
from chomeflow.operators import administrative, blocks, regional
from chomeflow.sources.registry import Registry
from chomeflow.sources.registry import registry as session_registry

TIER_1, TIER_2, TIER_3, TIER_4 = "tier_1_statutory", "tier_2_conventional", "tier_3_heuristic", "tier_4_system_assumption"


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def sanitized(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds ``out``, the cleaned text, in two projections: composition isn't deterministic to the planner and must not be repeated."""
    df = df.withColumn("_composed", T.compose_input(F.col(raw)))
    return df.withColumn(out, T.clean_composed(F.col("_composed"))).drop("_composed")


def kanji_converted(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: kanji numerals in numbers as digits.

    The text becomes tokens once, and each numeral is judged by its neighbours; a second step
    reads sequences with hyphens.  Texts without a numeral beside a mark pass by both.
    """
    df = df.withColumn("_tokens", F.expr(f"CASE WHEN `{text}` RLIKE '{T.ANY_STEP}' THEN {T.tokens_sql(f'`{text}`')} END"))
    df = df.withColumn("_told", F.expr(f"CASE WHEN _tokens IS NULL THEN `{text}` ELSE {T.numerals_sql('_tokens')} END"))
    return df.withColumn(out, F.expr(T.sequences_sql("_told"))).drop("_tokens", "_told")


def _street_number(c: Column) -> Column:
    """The last part of a canonical address, from chome on."""
    both = F.concat(c["ban"].cast("string"), F.lit("番"), c["go"].cast("string"), F.lit("号"))
    return F.coalesce(
        both,
        F.concat(c["ban"].cast("string"), F.lit("番")),
        F.concat(c["banchi"].cast("string"), F.lit("番地の"), c["edaban"].cast("string")),
        F.concat(c["banchi"].cast("string"), F.lit("番地")),
    )


def core_address(c: Column) -> Column:
    """Canonical text without building, floor and unit."""
    grid = c["hokkaido_grid"]
    grid_text = F.concat(grid["cardinal_ns"], grid["jo"].cast("string"), F.lit("条"), grid["cardinal_ew"], grid["chome"].cast("string"), F.lit("丁目"))
    chome = F.when(grid.isNull(), F.concat(c["chome"].cast("string"), F.lit("丁目")))
    ward = F.when(~F.contains(F.coalesce(c["city"], F.lit("")), c["ward"]), c["ward"])
    return F.concat_ws("", c["prefecture"], c["county"], c["city"], ward, c["kyoto_direction"]["raw_clause"], c["town"], grid_text, chome, _street_number(c))


def normalize(df: DataFrame, address: str = "address", out: str = "normalized", registry: Registry | None = None) -> DataFrame:
    """``df`` with a struct ``out``: input_raw, input_sanitized, canonical, components, tier_map, confidence_score.

    A null address counts as an empty one.  Other columns pass through, whatever
    their names; a column named ``out`` is replaced.
    """
    registry = registry or session_registry(df.sparkSession)
    x = df.select(F.struct("*").alias("_row") if df.columns else F.lit(None).alias("_row"), F.coalesce(F.col(address).cast("string"), F.lit("")).alias("_raw"))
    x = sanitized(x, "_raw", "_clean")
    x = kanji_converted(x, "_clean", "_text")
    x = administrative.resolve(x, registry)
    a = F.col("_a")

    known = a["pref"].isNotNull()
    ambiguous, inferred = a["ambiguous"], a["inferred"]
    base = (
        F.when(a["contradictory"], 0.0)
        .when(ambiguous, 0.5)
        .when(known & a["lg_code"].isNotNull(), F.when(inferred, 0.85).otherwise(1.0))
        .when(known, 0.7)
        .otherwise(0.42)
    )
    city0 = F.when(ambiguous & ~known, a["matched"]).when(~ambiguous, a["city"])
    ward0 = F.when(ambiguous & known, a["matched"]).when(~ambiguous, a["ward"])
    pref_tier = F.when(a["contradictory"], None).when(known, F.when(inferred, TIER_3).otherwise(TIER_1)).when(ambiguous, TIER_3)
    x = x.withColumns({"_conf": base, "_city": city0, "_wd": ward0, "_pt": pref_tier})

    # Kyoto
    rest = a["rest"]
    kyoto = _is((a["pref_code"] == "26") & F.col("_city").contains("京都")) | regional.has_direction(rest)
    x = x.withColumn("_kc", F.when(kyoto, regional.kyoto_capture(rest)).otherwise(F.array(rest)))
    x = x.withColumn("_k", regional.kyoto_clause(F.col("_kc")))
    k = F.col("_k")
    x = x.withColumn("_r1", F.when(k.isNotNull(), regional.around(F.col("_kc"), 6)).otherwise(rest))
    to_kyoto = k.isNotNull() & a["pref"].isNull()
    x = x.withColumns(
        {
            "_pref": F.when(to_kyoto, "京都府").otherwise(a["pref"]),
            "_pc": F.when(to_kyoto, "26").otherwise(a["pref_code"]),
            "_inf": F.when(to_kyoto, True).otherwise(inferred),
            "_amb": F.when(to_kyoto, False).otherwise(ambiguous),
            "_cands": F.when(to_kyoto, F.array().cast("array<string>")).otherwise(a["candidates"]),
            "_city": F.when(to_kyoto, F.coalesce("_city", F.lit("京都市"))).otherwise(F.col("_city")),
            "_pt": F.when(to_kyoto, TIER_2).otherwise(F.col("_pt")),
        }
    )

    # Hokkaido; the gate looks at the prefecture that the registry found
    r1 = F.col("_r1")
    gate = _is(a["pref_code"] == "01") | (a["pref"].isNull() & r1.contains("条") & r1.contains("丁目") & r1.rlike("北|南"))
    x = x.withColumn("_hc", F.when(gate, regional.grid_capture(r1)).otherwise(F.array(r1)))
    x = x.withColumn("_h", regional.grid_clause("_hc"))
    h = F.col("_h")
    x = x.withColumn("_r2", F.when(h.isNotNull(), regional.around(F.col("_hc"), 7)).otherwise(r1))
    sapporo = h.isNotNull() & F.col("_amb") & _is(a["matched"] == "中央区")
    north = h.isNotNull() & ~sapporo & F.col("_pref").isNull() & ~F.col("_amb")
    either = sapporo | north
    x = x.withColumns(
        {
            "_city": F.when(sapporo, "札幌市").otherwise(F.col("_city")),
            "_wd": F.when(sapporo, "中央区").otherwise(F.col("_wd")),
            "_lg": F.when(sapporo, "011011").otherwise(a["lg_code"]),
            "_conf": F.when(sapporo, 0.85).otherwise(F.col("_conf")),
            "_cands": F.when(sapporo, F.array().cast("array<string>")).otherwise(F.col("_cands")),
            "_pt": F.when(either, TIER_2).otherwise(F.col("_pt")),
            "_inf": F.when(either, True).otherwise(F.col("_inf")),
            "_pc": F.when(either, "01").otherwise(F.col("_pc")),
            "_pref": F.when(either, "北海道").otherwise(F.col("_pref")),
            "_amb": F.when(sapporo, False).otherwise(F.col("_amb")),
        }
    )
    blank = T.is_blank(F.col("_raw"))
    rejected = F.col("_pref").isNull() & F.col("_city").isNull() & ~F.col("_amb") & k.isNull() & h.isNull()
    x = x.withColumn("_out", F.when(blank, "blank").when(rejected, "rejected").otherwise("found"))

    x = blocks.parse_blocks(x, "_r2", h["chome"].isNotNull())
    b = F.col("_b")
    # lots only in Kyoto's street addresses
    lots = k.isNotNull() & b["ban"].isNotNull() & b["banchi"].isNull()
    x = x.withColumns(
        {
            "_chome": F.coalesce(F.when(b["chome"] != 0, b["chome"]), h["chome"]),
            "_ban": F.when(~lots, b["ban"]),
            "_go": F.when(~lots, b["go"]),
            "_banchi": F.when(lots, b["ban"]).otherwise(b["banchi"]),
            "_edaban": F.when(lots, b["go"]).otherwise(b["edaban"]),
            "_regime": F.when(lots, blocks.CHIBAN).otherwise(b["regime"]),
        }
    )
    x = blocks.parse_building(x, b["tail"])
    g = F.col("_g")

    found = F.col("_out") == "found"
    if_found = lambda c: F.when(found, c)
    has_unit = g["building"].isNotNull() | g["floor"].isNotNull() | g["unit"].isNotNull()
    components = F.struct(
        if_found(F.col("_pc")).alias("prefecture_code"),
        if_found(F.col("_pref")).alias("prefecture"),
        (found & F.col("_inf")).alias("prefecture_inferred"),
        if_found(F.col("_lg")).alias("lg_code"),
        if_found(a["county"]).alias("county"),
        if_found(F.col("_city")).alias("city"),
        if_found(F.col("_wd")).alias("ward"),
        if_found(b["oaza"]).alias("oaza"),
        if_found(b["koaza"]).alias("koaza"),
        if_found(F.nullif(b["town"], F.lit(""))).alias("town"),
        if_found(F.col("_chome")).alias("chome"),
        if_found(F.col("_ban")).alias("ban"),
        if_found(F.col("_go")).alias("go"),
        if_found(F.col("_banchi")).alias("banchi"),
        if_found(F.col("_edaban")).alias("edaban"),
        if_found(g["building"]).alias("building"),
        if_found(g["floor"]).alias("floor"),
        if_found(g["unit"]).alias("unit"),
        if_found(k).alias("kyoto_direction"),
        if_found(h).alias("hokkaido_grid"),
        F.when(found, F.col("_regime")).otherwise(blocks.UNSPECIFIED).alias("address_regime"),
        (found & F.col("_amb")).alias("is_ambiguous"),
        F.when(found, F.col("_cands")).otherwise(F.array().cast("array<string>")).alias("ambiguous_candidates"),
        (found & a["contradictory"]).alias("is_contradictory"),
        F.when(F.col("_out") == "rejected", F.col("_clean")).when(found & ~has_unit, F.nullif(b["tail"], F.lit(""))).alias("unparsed_tail"),
    )
    x = x.withColumn("_c", components)
    c = F.col("_c")
    tiers = {
        "prefecture": F.col("_pt"),
        "municipality": F.when(a["lg_code"].isNotNull(), TIER_1).when(ambiguous & a["pref"].isNull(), TIER_3),
        "lg_code": F.when(a["lg_code"].isNotNull(), TIER_1),
        "ward": F.when(ambiguous & a["pref"].isNotNull(), TIER_3),
        "kyoto_direction": F.when(k.isNotNull(), TIER_2),
        "hokkaido_grid": F.when(h.isNotNull(), TIER_2),
        "county": F.when(c["county"].isNotNull(), TIER_1),
    }
    tiers |= {name: F.when(c[name].isNotNull(), TIER_3) for name in ("town", "oaza", "koaza")}
    tiers |= {name: F.when(c[name].isNotNull(), TIER_2) for name in ("chome", "ban", "go", "banchi", "edaban")}
    tiers |= {name: F.when(c[name].isNotNull(), TIER_3) for name in ("building", "floor", "unit")}
    tier_map = F.map_filter(F.create_map(*[y for name, tier in tiers.items() for y in (F.lit(name), tier)]), lambda _, tier: tier.isNotNull())
    secondary = F.concat_ws(" ", c["building"], c["floor"], c["unit"])
    core = core_address(c)
    canonical = F.when(secondary != "", F.concat(core, F.lit(" "), secondary)).otherwise(core)
    result = F.struct(
        F.col("_raw").alias("input_raw"),
        F.when(F.col("_out") == "blank", F.lit("")).otherwise(F.col("_clean")).alias("input_sanitized"),
        F.when(F.col("_out") == "blank", F.lit("")).when(F.col("_out") == "rejected", F.col("_clean")).otherwise(canonical).alias("canonical"),
        c.alias("components"),
        F.when(found, tier_map).otherwise(F.create_map().cast("map<string,string>")).alias("tier_map"),
        F.when(found, F.col("_conf")).otherwise(0.0).alias("confidence_score"),
    )
    rows = [F.col("_row")[name].alias(name) for name in df.columns if name.lower() != out.lower()]
    # A generator of one row: the planner would push filters on results, and trace join
    # keys, through all projections below, writing each into the next.  It interprets what it
    # evaluates, so the struct is made before it, in generated code.
    x = x.withColumn("_result", result)
    return x.select(*rows, F.explode_outer(F.array("_result")).alias(out))


def parse(df: DataFrame, address: str = "address", out: str = "components", registry: Registry | None = None) -> DataFrame:
    """``df`` with the components alone."""
    x = normalize(df, address, "_n_" + out, registry)
    return x.withColumn(out, F.col("_n_" + out)["components"]).drop("_n_" + out)
