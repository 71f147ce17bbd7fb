"""The registry of prefectures and municipalities as DataFrames: scans, builder, key index and lookups."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chomeflow.data import seed
from chomeflow.functions import codes
from chomeflow.operators.prefixes import Ladder, bounded, longest_prefix_join, prefix_ladder
from chomeflow.sources.json_array import write_json_array
from chomeflow.sources.workbook import scan_workbook

PREFECTURE = "code string, name string, stem string, suffix string, kana string, romaji string"
MUNICIPALITY = (
    "prefecture_code string, prefecture_name string, base_code string, check_digit string, lg_code string, name string, "
    "city string, ward string, county string, entity_type string, kana string"
)
#: The statutory register has 1,918 records; a table of several times that isn't one, and isn't broadcast.
MOST_RECORDS = 10_000
FULL_RECORDS = 1_918


def _read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, or of lines with an object each."""
    start = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    whole = start is None or start[0].lstrip("\ufeff \t").startswith("[")
    return spark.read.schema(schema).option("multiLine", whole).option("mode", "FAILFAST").json(path)


def prefectures(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Prefectures from a JSON array or lines, or the bundled 47."""
    if path is None:
        return spark.createDataFrame(seed.prefecture_rows(), PREFECTURE)
    return _read_json(spark, path, PREFECTURE)


def municipalities(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Municipalities from a JSON array or lines, or a Parquet table, or the bundled partial list. A missing path is an error."""
    if path is None:
        return spark.createDataFrame(seed.municipality_rows(), MUNICIPALITY)
    if path.endswith(".parquet"):
        return spark.read.schema(MUNICIPALITY).parquet(path)
    return _read_json(spark, path, MUNICIPALITY)


def county_map(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(base_code, county) from a JSON object of base codes; without a path, from the bundled municipalities."""
    if path is None:
        return municipalities(spark).where("county IS NOT NULL").select("base_code", "county")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("base_code", "county"))


def provenance(path: str | None = None) -> dict:
    """The registry's provenance; empty without a file."""
    if path is None:
        return {"source": "bundled partial list", "prefectures": 47, "municipality_records": len(seed.municipality_rows()), "complete": False}
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


# --- builder -------------------------------------------------------------------------------------

def sheet_frame(spark: SparkSession, rows: list[Mapping[str, str]]) -> DataFrame:
    """(row, code, prefecture, municipality) of rows given by column letters."""
    data = [(i, r.get("A"), r.get("B"), r.get("C")) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row int, code string, prefecture string, municipality string")


def entity_type(prefecture: Column, name: Column, designated: Column) -> Column:
    return (
        F.when((prefecture == "東京都") & name.endswith("区"), "special_ward")
        .when(designated, "designated_city")
        .when(name.endswith("市"), "city")
        .when(name.endswith("町"), "town")
        .when(name.endswith("村"), "village")
        .otherwise(F.raise_error(F.concat(F.lit("no entity type for "), name)).cast("string"))
    )


def split_by_prefix(names: DataFrame, name: str, prefixes: DataFrame, out: str) -> DataFrame:
    """``out``: the longest ``key`` of ``prefixes`` that a name begins with, or null; by equi-joins, not by comparing each pair."""
    return longest_prefix_join(names, name, bounded(prefix_ladder(prefixes)), out).withColumn(out, F.col(out)["key"])


def build(municipal: DataFrame, wards: DataFrame, counties: DataFrame, records: int | None = FULL_RECORDS) -> DataFrame:
    """The register from the two sheets of the statutory workbook and the county map, sorted by code."""

    def coded(df: DataFrame) -> DataFrame:
        code = F.col("code")
        right = codes.check_digit(codes.base_code(code)) == codes.last_digit(code)
        sure = F.when(F.coalesce(right, F.lit(False)), codes.base_code(code)).otherwise(F.raise_error(F.concat(F.lit("wrong check digit: "), code)).cast("string"))
        return df.select(
            codes.prefecture_code(code).alias("prefecture_code"), F.col("prefecture").alias("prefecture_name"), sure.alias("base_code"), codes.last_digit(code).alias("check_digit"),
            code.alias("lg_code"), "municipality",
        )

    rows = lambda df: df.where("row > 0 AND municipality IS NOT NULL AND municipality <> ''")
    cities = rows(wards).where(F.col("municipality").endswith("市")).select(F.col("municipality").alias("designated")).distinct()
    some_counties = F.broadcast(counties) if counties.count() <= MOST_RECORDS else counties
    first = coded(rows(municipal)).join(F.broadcast(cities), F.col("municipality") == F.col("designated"), "left").join(some_counties, "base_code", "left")
    kind = entity_type(F.col("prefecture_name"), F.col("municipality"), F.col("designated").isNotNull())
    plain = first.select(
        "prefecture_code", "prefecture_name", "base_code", "check_digit", "lg_code", F.col("municipality").alias("name"), F.col("municipality").alias("city"),
        F.lit(None).cast("string").alias("ward"), "county", kind.alias("entity_type"), F.lit(None).cast("string").alias("kana"),
    )
    below = split_by_prefix(coded(rows(wards).where(~F.col("municipality").endswith("市"))), "municipality", cities.select(F.col("designated").alias("key")), "designated")
    city = F.coalesce("designated", F.raise_error(F.concat(F.lit("no city for "), F.col("municipality"))).cast("string"))
    inner = below.select(
        "prefecture_code", "prefecture_name", "base_code", "check_digit", "lg_code", F.col("municipality").alias("name"), city.alias("city"),
        F.expr("substring(municipality, length(designated) + 1)").alias("ward"), F.lit(None).cast("string").alias("county"), F.lit("administrative_ward").alias("entity_type"),
        F.lit(None).cast("string").alias("kana"),
    )
    out = plain.unionByName(inner)
    if records is not None and (n := out.count()) != records:
        raise ValueError(f"{n} records; the register has {records}")
    return out.orderBy("lg_code")


def build_from_workbook(spark: SparkSession, workbook: str, counties_path: str | None = None, records: int | None = FULL_RECORDS) -> DataFrame:
    sheet = lambda i: scan_workbook(spark, workbook, [i]).toDF("row", "code", "prefecture", "municipality")
    return build(sheet(1), sheet(2), county_map(spark, counties_path), records)


def write(register: DataFrame, path: str) -> None:
    """In code order: a Parquet table if the path ends in .parquet, else one file with a JSON array, of any number of records."""
    if path.endswith(".parquet"):
        register.orderBy("lg_code").write.mode("overwrite").parquet(path)
        return
    write_json_array(register.orderBy("lg_code"), path, single=True)


# --- key index -----------------------------------------------------------------------------------


def prefecture_keys(prefs: DataFrame) -> DataFrame:
    """(key, code, name): full names, and stems of two characters or more."""
    full = prefs.select(F.col("name").alias("key"), "code", "name")
    return full.unionByName(prefs.where(F.length("stem") >= 2).select(F.col("stem").alias("key"), "code", "name"))


def municipality_keys(munis: DataFrame) -> DataFrame:
    """(key, cands): all names that lead to each record, with the records in code order."""
    wards = munis.where("ward IS NOT NULL").groupBy(F.col("city").alias("_city"), F.col("prefecture_code").alias("_pref")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("lg_code"), F.col("ward")))).alias("wards")
    )
    same = (F.col("entity_type") == "designated_city") & (F.col("city") == F.col("_city")) & (F.col("prefecture_code") == F.col("_pref"))
    rec = munis.join(wards, same, "left").select(
        F.struct("lg_code", "prefecture_code", "prefecture_name", "name", "city", "ward", "county", "entity_type", "wards").alias("rec")
    )
    key = lambda c, where: rec.where(where).select(c.alias("key"), "rec")
    keys = (
        key(F.col("rec.name"), F.lit(True))
        .unionByName(key(F.concat("rec.county", "rec.name"), F.col("rec.county").isNotNull()))
        .unionByName(key(F.col("rec.city"), F.col("rec.entity_type") == "designated_city"))
        .unionByName(key(F.col("rec.ward"), F.col("rec.ward").isNotNull() & (F.col("rec.ward") != F.col("rec.name"))))
    )
    return keys.where("key <> ''").dropDuplicates(["key", "rec"]).groupBy("key").agg(F.sort_array(F.collect_list("rec")).alias("cands"))


def bucketed(keys: DataFrame) -> DataFrame:
    """Keys by their first two characters, longest first: one equi-join then finds all candidates of a text."""
    entry = F.struct(F.length("key").alias("n"), *keys.columns)
    return keys.groupBy(F.substring("key", 1, 2).alias("bucket")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"))


def prefecture_lookup(prefs: DataFrame) -> DataFrame:
    """(key, rec): a prefecture by code, name and stem; a name goes before a stem."""
    rec = F.struct(*prefs.columns).alias("rec")
    ways = [prefs.select(F.col(c).alias("key"), F.lit(rank).alias("rank"), rec) for rank, c in enumerate(("code", "name", "stem"))]
    return functools.reduce(DataFrame.unionByName, ways).where("key <> ''").groupBy("key").agg(F.min_by("rec", "rank").alias("rec"))


def municipality_lookup(munis: DataFrame) -> DataFrame:
    """(key, last, found): records by ``code|`` and code, by ``|`` and name or bare ward, and by prefecture, ``|`` and name: of these only the last."""
    rec = F.struct("lg_code", *[c for c in munis.columns if c != "lg_code"]).alias("rec")
    ways = [
        munis.select(F.concat(F.lit("code|"), "lg_code").alias("key"), rec),
        munis.select(F.concat(F.lit("|"), "name").alias("key"), rec),
        munis.where("ward <> '' AND ward <> name").select(F.concat(F.lit("|"), "ward").alias("key"), rec),
        munis.select(F.concat("prefecture_code", F.lit("|"), "name").alias("key"), rec),
    ]
    found = functools.reduce(DataFrame.unionByName, ways).groupBy("key").agg(F.max_by("rec", "rec.lg_code").alias("last"), F.sort_array(F.collect_list("rec")).alias("found"))
    return found.withColumn("found", F.when(F.col("key").startswith("|"), F.col("found")).otherwise(F.array("last")))


def _looked_up(df: DataFrame, key: Column, index: DataFrame, out: str, value: str, default: Column | None = None) -> DataFrame:
    side = index.select(F.col("key").alias("_key"), F.col(value).alias("_value"))
    got = F.col("_value") if default is None else F.coalesce("_value", default.cast(side.schema["_value"].dataType))
    return df.join(side, key.eqNullSafe(F.col("_key")), "left").withColumn(out, got).drop("_key", "_value")


class Registry:
    """The two dimensions of a session and their indexes.

    ``broadcastable`` is checked against the numbers of records; larger tables
    are joined however Spark likes.  Tables of one's own without any code are an error.
    """

    def __init__(self, spark: SparkSession, municipalities_path: str | None = None, prefectures_path: str | None = None):
        self.spark = spark
        self.prefectures = prefectures(spark, prefectures_path)
        self.municipalities = municipalities(spark, municipalities_path)
        self.complete = municipalities_path is not None
        sizes = [self._checked(df, code) for df, code, path in ((self.prefectures, "code", prefectures_path), (self.municipalities, "lg_code", municipalities_path)) if path is not None]
        self.broadcastable = max(sizes, default=0) <= MOST_RECORDS
        self._muni = self._pref = self._ladder = None
        self._indexes: dict[str, DataFrame] = {}

    @staticmethod
    def _checked(df: DataFrame, code: str) -> int:
        rows, coded = df.agg(F.count("*"), F.count(code)).first()
        if not rows or coded < rows:
            raise ValueError(f"{rows - coded} of {rows} rows of a registry table have no {code}")
        return rows

    def _pinned(self, df: DataFrame) -> DataFrame:
        """A small table without its lineage, so that each query doesn't build it anew."""
        return self.spark.createDataFrame(df.collect(), df.schema) if self.broadcastable else df

    def _hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.broadcastable else df

    @property
    def prefecture_index(self) -> DataFrame:
        if self._pref is None:
            self._pref = self._pinned(bucketed(prefecture_keys(self.prefectures)))
        return self._hint(self._pref)

    @property
    def municipality_index(self) -> DataFrame:
        if self._muni is None:
            self._muni = self._pinned(bucketed(municipality_keys(self.municipalities)))
        return self._hint(self._muni)

    @property
    def municipality_ladder(self) -> Ladder:
        """The keys of municipalities for lookups from any offset."""
        if self._ladder is None:
            made = prefix_ladder(municipality_keys(self.municipalities))
            self._ladder = Ladder(self._pinned(made.rungs), made.lengths, self.broadcastable)
        return self._ladder

    # lookups of whole columns

    def _index(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._indexes:
            self._indexes[name] = self._pinned(make())
        return self._hint(self._indexes[name])

    def join_prefectures(self, df: DataFrame, key: str, out: str = "found") -> DataFrame:
        """``out``: the prefecture whose code, name or stem ``key`` is, or null. Rows are kept."""
        index = self._index("prefectures", lambda: prefecture_lookup(self.prefectures))
        return _looked_up(df, F.col(key), index, out, "rec")

    def join_municipality_by_code(self, df: DataFrame, lg_code: str, out: str = "found") -> DataFrame:
        """``out``: the record of a code, or null. Rows are kept."""
        return _looked_up(df, F.concat(F.lit("code|"), F.col(lg_code)), self._municipality_lookup(), out, "last")

    def join_municipalities(self, df: DataFrame, name: str, prefecture: str | None = None, out: str = "found") -> DataFrame:
        """``out``: all records of a name or a bare ward, in code order; where a column ``prefecture`` is given and not empty, the last record of exactly that name in it.

        Always an array, empty where nothing is found. Rows are kept.
        """
        scope = F.coalesce(F.col(prefecture), F.lit("")) if prefecture else F.lit("")
        return _looked_up(df, F.concat(scope, F.lit("|"), F.col(name)), self._municipality_lookup(), out, "found", F.array())

    def _municipality_lookup(self) -> DataFrame:
        return self._index("municipalities", lambda: municipality_lookup(self.municipalities))

    # lookups of one value, each a filter on a dimension

    def prefecture_by_code(self, code: str) -> DataFrame:
        return self.prefectures.where(F.col("code") == code)

    def prefecture_by_name(self, name: str) -> DataFrame:
        return self.prefectures.where(F.col("name") == name)

    def prefecture_by_stem(self, stem: str) -> DataFrame:
        return self.prefectures.where(F.col("stem") == stem)

    def municipality_by_code(self, lg_code: str) -> DataFrame:
        return self.municipalities.where(F.col("lg_code") == lg_code)

    def find_municipalities(self, name: str, prefecture: str | None = None) -> DataFrame:
        """All records of a name or a bare ward; with a prefecture, the last record of exactly that name."""
        m = self.municipalities
        if prefecture:
            return m.where((F.col("prefecture_code") == prefecture) & (F.col("name") == name)).orderBy(F.desc("lg_code")).limit(1)
        return m.where((F.col("name") == name) | (F.coalesce(F.col("ward"), F.lit("")) == name)).orderBy("lg_code")


_CURRENT: dict[str, Registry] = {}


def registry(spark: SparkSession) -> Registry:
    """The bundled registry of a session, made once."""
    app = spark.sparkContext.applicationId
    if app not in _CURRENT or _CURRENT[app].spark.sparkContext is not spark.sparkContext:
        _CURRENT.clear()
        _CURRENT[app] = Registry(spark)
    return _CURRENT[app]
