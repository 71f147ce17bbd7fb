"""Constructed addresses: deterministic rows from a range, as columns; the parts they are made of stay beside the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What constructed addresses are made of.
PLACES = [("東京都", "港区"), ("東京都", "新宿区"), ("神奈川県", "大磯町"), ("長野県", "長野市"), ("青森県", "八戸市"), ("福島県", "会津若松市"), ("沖縄県", "那覇市"), ("三重県", "津市")]
NORTH_SOUTH_STREETS = ["寺町通", "烏丸通", "河原町通", "新町通", "室町通", "堀川通", "大宮通", "千本通"]
EAST_WEST_STREETS = ["御池通", "四条通", "三条通", "五条通", "六角通", "七条通"]
DIRECTIONS = ["上る", "下る", "東入", "西入", "下ル"]
BUILDINGS = ["タワー", "ヒルズ", "レジデンス", "メゾン", "セントラルビル"]
FLOORS = ["3階", "50F", "地下1階", "B2F", "12F"]


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def standard(keys: DataFrame, i: str = "i") -> DataFrame:
    """Adds prefecture, city, chome, ban, go and the address with marked numbers."""
    n = F.col(i)
    df = keys.withColumns(
        {"prefecture": pick([p for p, _ in PLACES], n), "city": pick([c for _, c in PLACES], n), "chome": n % 8 + 1, "ban": (n * 3) % 25 + 1, "go": (n * 7) % 15 + 1}
    )
    return df.withColumn("address", F.concat("prefecture", "city", F.lit("本町"), _s(F.col("chome")), F.lit("丁目"), _s(F.col("ban")), F.lit("番"), _s(F.col("go")), F.lit("号")))


def intersections(keys: DataFrame, i: str = "i") -> DataFrame:
    """Adds streets, direction, lot and a Kyoto address."""
    n = F.col(i)
    df = keys.withColumns({"street_1": pick(NORTH_SOUTH_STREETS, n), "street_2": pick(EAST_WEST_STREETS, n * 5), "direction": pick(DIRECTIONS, n * 2), "lot": n * 7 + 100})
    return df.withColumn("address", F.concat(F.lit("京都府京都市中京区"), "street_1", "street_2", "direction", F.lit("町"), _s(F.col("lot")), F.lit("番地")))


def grid(keys: DataFrame, i: str = "i") -> DataFrame:
    """Adds the parts of a grid clause, lot and a Sapporo address."""
    n = F.col(i)
    df = keys.withColumns(
        {
            "ns": F.when(n % 2 == 0, "北").otherwise("南"),
            "ew": F.when((n / 2).cast("long") % 2 == 0, "西").otherwise("東"),
            "jo": n % 15 + 1,
            "chome": (n * 3) % 20 + 1,
            "lot": (n * 5) % 30 + 1,
        }
    )
    return df.withColumn("address", F.concat(F.lit("北海道札幌市中央区"), "ns", _s(F.col("jo")), F.lit("条"), "ew", _s(F.col("chome")), F.lit("丁目"), _s(F.col("lot")), F.lit("番地")))


def cadastral(keys: DataFrame, i: str = "i") -> DataFrame:
    """Adds lot, branch and an address by 大字 and 字."""
    n = F.col(i)
    df = keys.withColumns({"lot": n * 11 + 200, "branch": n % 7 + 1})
    return df.withColumn("address", F.concat(F.lit("長野県長野市大字南長野字幅下"), _s(F.col("lot")), F.lit("番地の"), _s(F.col("branch"))))


def untidy(keys: DataFrame, i: str = "i") -> DataFrame:
    """Adds numbers, building, floor and an address without prefecture, in mixed dashes."""
    n = F.col(i)
    df = keys.withColumns({"chome": n % 5 + 1, "ban": n % 20 + 1, "go": n % 10 + 1, "building": F.concat(F.lit("第"), _s(n % 5 + 1), pick(BUILDINGS, n)), "floor": pick(FLOORS, n)})
    return df.withColumn(
        "address", F.concat(F.lit("新宿区本町"), _s(F.col("chome")), F.lit("―"), _s(F.col("ban")), F.lit("～"), _s(F.col("go")), F.lit(" "), "building", F.lit(" "), "floor")
    )


def mixed(keys: DataFrame, i: str = "i") -> DataFrame:
    """(i, corpus, address): a fifth of the rows from each kind."""
    out = None
    for k, (name, make) in enumerate({"standard": standard, "intersections": intersections, "grid": grid, "cadastral": cadastral, "untidy": untidy}.items()):
        part = make(keys.where(F.col(i) % 5 == k), i).select(F.col(i).alias("i"), F.lit(name).alias("corpus"), "address")
        out = part if out is None else out.unionByName(part)
    return out
