"""Queries over whole tables, with SQL that computes the same from other premises.

Round-trip queries build addresses from table keys and read them back; their SQL
computes the expected parts from the keys alone.  Golden queries run fixed
inputs; their SQL states the values that are right for them.
"""

from __future__ import annotations

import json
import re
import urllib.error
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chomeflow import corpus, golden
from chomeflow.data import seed
from chomeflow.functions import codes
from chomeflow.functions import text as T
from chomeflow.operators import blocks, prefixes, regional
from chomeflow.operators.geocode import TableResolver, fetch, geocode, query_text
from chomeflow.plans import formats, timings
from chomeflow.plans.normalize import kanji_converted, normalize, parse, sanitized
from chomeflow.plans.validate import ACCEPTED, AMBIGUOUS, MALFORMED, exit_code, validate, validation
from chomeflow.sources import registry as R
from chomeflow.sources.json_array import write_json_array
from chomeflow.sources.workbook import scan_workbook, write_workbooks
from chomeflow.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of orders, spread: a table of few row groups would keep all work in few tasks."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"))
    return keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i")


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS v({names})"


def _list(values: list[str], i: str) -> str:
    return f"([{', '.join(map(_quoted, values))}])[({i}) % {len(values)} + 1]"


def _normal() -> Column:
    return F.col("normalized")


def _parts() -> Column:
    return _normal()["components"]


def _c(*names: str) -> list[Column]:
    return [_parts()[n].alias(n) for n in names]


# --- registry ------------------------------------------------------------------------------------

_PREFS = _values(seed.prefecture_rows(), "code, name, stem, suffix, kana, romaji")
_MUNIS = _values(
    seed.municipality_rows(), "prefecture_code, prefecture_name, base_code, check_digit, lg_code, name, city, ward, county, entity_type, kana"
)


#: What isn't derived: the SQL makes codes, cities and types from these anew.
_BASES = _values([(r[2], r[5], r[7], r[8]) for r in seed.municipality_rows()], "base, name, ward, county")
_BASE_DIGIT = "((11 - (substr(base, 1, 1)::INT * 6 + substr(base, 2, 1)::INT * 5 + substr(base, 3, 1)::INT * 4 + substr(base, 4, 1)::INT * 3 + substr(base, 5, 1)::INT * 2) % 11) % 10)::VARCHAR"
_DERIVED = f"""
WITH b AS ({_BASES}), d AS (SELECT *, CASE WHEN ward IS NULL THEN name ELSE left(name, length(name) - length(ward)) END AS city FROM b)
SELECT base || {_BASE_DIGIT} AS lg_code, name, city, ward, county,
  CASE WHEN ward IS NOT NULL THEN 'administrative_ward' WHEN name IN (SELECT city FROM d WHERE ward IS NOT NULL) THEN 'designated_city'
    WHEN starts_with(base, '13') AND ends_with(name, '区') THEN 'special_ward' WHEN ends_with(name, '市') THEN 'city' WHEN ends_with(name, '町') THEN 'town' ELSE 'village' END AS entity_type
FROM d"""


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}/{name}"


@query(f"SELECT code, name, left(name, length(name) - 1) AS stem, right(name, 1) AS suffix FROM ({_PREFS})")
def registry_prefectures(spark, sf_dir):
    at = _file(spark, "prefectures.json")
    R.prefectures(spark).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(at)
    return R.prefectures(spark, at).select("code", "name", "stem", "suffix")


@query(_DERIVED)
def registry_municipalities(spark, sf_dir):
    at = _file(spark, "municipalities.json")
    R.write(R.municipalities(spark), at)
    return R.municipalities(spark, at).select("lg_code", "name", "city", "ward", "county", "entity_type")


@query(f"SELECT base AS base_code, county FROM ({_BASES}) WHERE county <> ''")
def county_map(spark, sf_dir):
    at = _file(spark, "counties.json")
    pairs = R.county_map(spark).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("base_code", "county")))).alias("value"))
    pairs.write.text(at)
    return R.county_map(spark, at)


#: The first columns of two sheets, as a statutory workbook has them.
_SHEET_1 = [("code", "prefecture", "municipality"), ("010006", "北海道", None), ("011002", "北海道", "札幌市"), ("013030", "北海道", "当別町"), ("131016", "東京都", "千代田区"), ("322024", "島根県", "浜田市"), ("105619", "群馬県", "上野村")]
_SHEET_2 = [("code", "prefecture", "municipality"), ("011002", "北海道", "札幌市"), ("011011", "北海道", "札幌市中央区"), ("011029", "北海道", "札幌市北区")]


@query(
    f"""WITH s AS ({_values([r for r in _SHEET_1 if r[2]][1:], "code, prefecture, name")}), w AS ({_values(_SHEET_2[2:], "code, prefecture, name")})
    SELECT code AS lg_code, left(code, 5) AS base_code, prefecture AS prefecture_name, name, name AS city, NULL AS ward, CASE code WHEN '013030' THEN '石狩郡' END AS county,
      CASE code WHEN '011002' THEN 'designated_city' WHEN '131016' THEN 'special_ward' ELSE CASE right(name, 1) WHEN '市' THEN 'city' WHEN '町' THEN 'town' ELSE 'village' END END AS entity_type FROM s
    UNION ALL SELECT code, left(code, 5), prefecture, name, '札幌市', substr(name, 4), NULL, 'administrative_ward' FROM w"""
)
def register_build(spark, sf_dir):
    sheet = lambda rows: R.sheet_frame(spark, [dict(zip("ABC", r, strict=True)) for r in rows])
    counties = spark.createDataFrame([("01303", "石狩郡")], "base_code string, county string")
    return R.build(sheet(_SHEET_1), sheet(_SHEET_2), counties, records=None).select("lg_code", "base_code", "prefecture_name", "name", "city", "ward", "county", "entity_type")


@query(
    """WITH p AS (SELECT n_name || ' ' AS key FROM nation UNION SELECT left(n_name, 3) FROM nation),
    t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE left(n_name, 2 + (s_suppkey % 5)::INT) END || CASE WHEN s_suppkey % 3 = 0 THEN substr(n_name, 3 + (s_suppkey % 5)::INT) || ' ' ELSE '-' END || s_suppkey AS name
      FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    j AS (SELECT k, key, row_number() OVER (PARTITION BY k ORDER BY length(key) DESC) AS r FROM t JOIN p ON starts_with(name, key))
    SELECT t.k, name, key AS prefix, substr(name, length(key) + 1) AS remainder FROM t LEFT JOIN j ON j.k = t.k AND r = 1"""
)
def names_by_prefix(spark, sf_dir):
    """Names of suppliers split behind the longest prefix, as the register splits wards behind their cities."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    keys = n.select(F.concat("n_name", F.lit(" ")).alias("key")).unionByName(n.select(F.substring("n_name", 1, 3).alias("key")))
    k, at = F.col("s_suppkey"), (F.col("s_suppkey") % 5).cast("int")
    head = F.when(k % 4 == 0, "").otherwise(F.substring(F.col("n_name"), F.lit(1), 2 + at))
    tail = F.when(k % 3 == 0, F.concat(F.substring(F.col("n_name"), 3 + at, F.length("n_name")), F.lit(" "))).otherwise("-")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(F.broadcast(n), "s_nationkey").select(k.cast("long").alias("k"), F.concat(head, tail, k.cast("string")).alias("name"))
    return R.split_by_prefix(s, "name", keys, "prefix").select("k", "name", "prefix", F.expr("substr(name, length(prefix) + 1)").alias("remainder"))


_KEYS = f"""
WITH m AS ({_MUNIS}), k AS (
  SELECT name AS key, lg_code FROM m
  UNION SELECT county || name, lg_code FROM m WHERE county IS NOT NULL
  UNION SELECT city, lg_code FROM m WHERE entity_type = 'designated_city'
  UNION SELECT ward, lg_code FROM m WHERE ward IS NOT NULL AND ward <> name)
"""


@query(_KEYS + "SELECT key, count(*)::BIGINT AS n, string_agg(lg_code, ',' ORDER BY lg_code) AS codes FROM k GROUP BY key")
def admin_key_index(spark, sf_dir):
    keys = R.municipality_keys(R.municipalities(spark))
    return keys.select("key", F.size("cands").cast("long").alias("n"), F.array_join(F.transform("cands", lambda c: c["lg_code"]), ",").alias("codes"))


@query(
    _KEYS
    + f""", t AS (SELECT o_orderkey AS i, {_list([c for _, c in corpus.PLACES], "o_orderkey")} || '本町' || o_orderkey AS text FROM orders),
j AS (SELECT i, key, row_number() OVER (PARTITION BY i ORDER BY length(key) DESC) AS r FROM t JOIN (SELECT DISTINCT key FROM k) ON starts_with(text, key))
SELECT i, key, length(key)::INT AS n FROM j WHERE r = 1"""
)
def longest_prefix_join(spark, sf_dir):
    df = _keys(spark, sf_dir).select("i", F.concat(corpus.pick([c for _, c in corpus.PLACES], F.col("i")), F.lit("本町"), F.col("i").cast("string")).alias("text"))
    found = prefixes.longest_prefix_join(df, "text", R.registry(spark).municipality_ladder, "hit")
    return found.where("hit IS NOT NULL").select("i", F.col("hit.key").alias("key"), F.col("hit.n").alias("n"))


#: Keys of one to five digits; texts are looked up at their beginning, behind it, and behind a digit of more than one byte.
_DIGIT_KEYS = "(o_orderkey::BIGINT * 7919 % 99991 % (10 ** (1 + o_orderkey % 5))::BIGINT)::VARCHAR"
_DIGIT_TEXT = "'番' || (o_orderkey::BIGINT * 104729 % 1000003)::VARCHAR || '１' || (o_custkey * 31 % 1009)::VARCHAR"


@query(
    f"""WITH k AS (SELECT DISTINCT {_DIGIT_KEYS} AS key FROM orders), t AS (SELECT o_orderkey AS i, {_DIGIT_TEXT} AS text FROM orders),
    s AS (SELECT i, text, unnest([0, 1, 3, 9, 40])::INT AS start FROM t),
    c AS (SELECT i, start, substr(text, start + 1, n) AS key, n FROM s, range(1, 6) AS r(n) WHERE length(text) >= start + n),
    best AS (SELECT i, start, key, n FROM c SEMI JOIN k USING (key) QUALIFY row_number() OVER (PARTITION BY i, start ORDER BY n DESC) = 1)
    SELECT s.i, s.start, key, (s.start + n)::INT AS next FROM s LEFT JOIN best USING (i, start)"""
)
def prefix_ladder_offsets(spark, sf_dir):
    """The longest of some thousand keys, at several offsets of each text."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("i"), "o_custkey")
    ladder = prefixes.bounded(prefixes.prefix_ladder(o.select((F.col("i") * 7919 % 99991 % F.pow(F.lit(10), 1 + F.col("i") % 5).cast("long")).cast("string").alias("key"))))
    text = F.concat(F.lit("番"), (F.col("i") * 104729 % 1000003).cast("string"), F.lit("１"), (F.col("o_custkey") * 31 % 1009).cast("string"))
    df = o.select("i", text.alias("text")).withColumn("start", F.explode(F.array(*map(F.lit, (0, 1, 3, 9, 40)))))
    return prefixes.longest_prefix_join(df, "text", ladder, "hit", F.col("start")).select("i", "start", "hit.key", "hit.next")


@query(f"SELECT c_custkey AS k, p.code, p.name FROM customer JOIN ({_PREFS}) p ON p.code = lpad((c_nationkey + 1)::VARCHAR, 2, '0')")
def prefecture_lookup(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0").alias("code"))
    return c.join(F.broadcast(R.registry(spark).prefectures.select("code", "name")), "code").select("k", "code", "name")


@query(f"SELECT lg_code, name FROM ({_MUNIS}) WHERE name = '泊村' OR ward = '泊村' UNION ALL SELECT lg_code, name FROM ({_MUNIS}) WHERE name = '中央区' OR ward = '中央区'")
def find_municipalities(spark, sf_dir):
    r = R.registry(spark)
    return r.find_municipalities("泊村").select("lg_code", "name").unionByName(r.find_municipalities("中央区").select("lg_code", "name"))


@query(f"SELECT lg_code, name, 'last of the name' AS how FROM (SELECT * FROM ({_MUNIS}) WHERE prefecture_code = '01' AND name = '泊村' ORDER BY lg_code DESC LIMIT 1) UNION ALL SELECT lg_code, name, 'by code' FROM ({_MUNIS}) WHERE lg_code = '131032'")
def municipality_lookup(spark, sf_dir):
    r = R.registry(spark)
    last = r.find_municipalities("泊村", "01").select("lg_code", "name", F.lit("last of the name").alias("how"))
    return last.unionByName(r.municipality_by_code("131032").select("lg_code", "name", F.lit("by code").alias("how")))


@query(f"SELECT code, name, 'code' AS how FROM ({_PREFS}) WHERE code = '26' UNION ALL SELECT code, name, 'name' FROM ({_PREFS}) WHERE name = '大阪府' UNION ALL SELECT code, name, 'stem' FROM ({_PREFS}) WHERE stem = '北海'")
def prefecture_by_each_key(spark, sf_dir):
    r = R.registry(spark)
    found = [(r.prefecture_by_code("26"), "code"), (r.prefecture_by_name("大阪府"), "name"), (r.prefecture_by_stem("北海"), "stem")]
    a, b, c = (df.select("code", "name", F.lit(how).alias("how")) for df, how in found)
    return a.unionByName(b).unionByName(c)


_MUNI_NAMES = ["泊村", "中央区", "港区", "横浜市", "横浜市中区", "神戸市", "無い町"]
_MUNI_PREFS = ["01", "", "13", "14", "28"]


@query(
    f"""WITH r AS (SELECT c_custkey AS k, {_list(_MUNI_NAMES, "c_custkey")} AS name, {_list(_MUNI_PREFS, "(c_custkey // 7)")} AS pref FROM customer), m AS ({_MUNIS}),
    hits AS (SELECT k, lg_code, pref FROM r JOIN m ON CASE WHEN pref = '' THEN m.name = r.name OR m.ward = r.name ELSE m.name = r.name AND prefecture_code = pref END),
    told AS (SELECT k, CASE WHEN any_value(pref) = '' THEN string_agg(lg_code, ',' ORDER BY lg_code) ELSE max(lg_code) END AS codes FROM hits GROUP BY k)
    SELECT k, coalesce(codes, '') AS codes FROM r LEFT JOIN told USING (k)"""
)
def municipality_requests(spark, sf_dir):
    """Municipalities by name, within a prefecture or without, for each customer."""
    k = F.col("c_custkey")
    r = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("long").alias("k"), corpus.pick(_MUNI_NAMES, k).alias("name"), corpus.pick(_MUNI_PREFS, F.floor(k / 7)).alias("pref"))
    found = R.registry(spark).join_municipalities(r, "name", "pref")
    return found.select("k", F.array_join(F.transform("found", lambda x: x["lg_code"]), ",").alias("codes"))


@query(
    f"""WITH r AS (SELECT c_custkey AS k, lpad((c_custkey % 50)::VARCHAR, 2, '0') AS code FROM customer),
    q AS (SELECT k, CASE k % 3 WHEN 0 THEN code WHEN 1 THEN p.name ELSE p.stem END AS asked, p.code, p.romaji FROM r LEFT JOIN ({_PREFS}) p USING (code))
    SELECT k, asked, code, romaji FROM q"""
)
def prefecture_requests(spark, sf_dir):
    """Prefectures by code, name or stem, for each customer; codes over 47 and texts that are null find nothing."""
    k = F.col("k")
    r = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"), F.lpad((F.col("c_custkey") % 50).cast("string"), 2, "0").alias("code"))
    named = R.registry(spark).join_prefectures(r, "code", "p")
    asked = F.when(k % 3 == 0, F.col("code")).when(k % 3 == 1, F.col("p.name")).otherwise(F.col("p.stem"))
    return R.registry(spark).join_prefectures(named.select("k", asked.alias("asked")), "asked", "q").select("k", "asked", F.col("q.code").alias("code"), F.col("q.romaji").alias("romaji"))


# --- codes ---------------------------------------------------------------------------------------

_DIGIT = """(11 - (substr({b}, 1, 1)::INT * 6 + substr({b}, 2, 1)::INT * 5 + substr({b}, 3, 1)::INT * 4 + substr({b}, 4, 1)::INT * 3 + substr({b}, 5, 1)::INT * 2) % 11) % 10"""
_BASE = "lpad((o_orderkey % 100000)::VARCHAR, 5, '0')"


@query(f"SELECT o_orderkey AS i, ({_DIGIT.format(b=_BASE)})::VARCHAR AS digit FROM orders")
def mod11_check_digit(spark, sf_dir):
    base = F.lpad((F.col("i") % 100000).cast("string"), 5, "0")
    return _keys(spark, sf_dir).select("i", codes.check_digit(base).alias("digit"))


@query(f"SELECT o_orderkey AS i, ({_DIGIT.format(b=_BASE)}) = o_orderkey % 10 AS valid FROM orders")
def lg_code_valid(spark, sf_dir):
    code = F.concat(F.lpad((F.col("i") % 100000).cast("string"), 5, "0"), (F.col("i") % 10).cast("string"))
    return _keys(spark, sf_dir).select("i", codes.is_valid_code(code).alias("valid"))


@query("SELECT o_orderkey AS i, o_orderkey % 60 BETWEEN 1 AND 47 AS valid FROM orders")
def pref_code_valid(spark, sf_dir):
    return _keys(spark, sf_dir).select("i", codes.is_prefecture_code(F.lpad((F.col("i") % 60).cast("string"), 2, "0")).alias("valid"))


# --- cleaning and numerals -----------------------------------------------------------------------

#: Inputs with what is right for them.
_SANITIZE = [
    ("東京都千代田区１－２－３", "東京都千代田区1-2-3"), ("５０Ｆ", "50F"), ("1ー2ー3", "1-2-3"), ("六ー十ー一", "六-十-一"), ("タワー", "タワー"), ("センタービル", "センタービル"),
    ("1---2--3", "1-2-3"), ("〒106-0032", ""), ("東京都港区六本木1─2─3", "東京都港区六本木1-2-3"), ("1～2", "1-2"), ("ｾﾝﾀｰ", "センター"), ("a\r\nb", "a b"), ("", ""),
] + [(f"1{d}2{d}3", "1-2-3") for d in T.DASHES]


@query(_values(_SANITIZE, "text, clean"))
def sanitize(spark, sf_dir):
    return sanitized(spark.createDataFrame(_SANITIZE, "text string, expected string"), "text", "clean").select("text", "clean")


@query("SELECT o_orderkey AS i, '東京都千代田区' || (o_orderkey % 90 + 1) || '-' || (o_orderkey % 7) AS clean FROM orders")
def sanitize_round_trip(spark, sf_dir):
    """Full-width digits, varied dashes, a postal code and odd spaces around known text."""
    i = F.col("i")
    wide = F.translate(F.concat((i % 90 + 1).cast("string"), F.lit("-"), (i % 7).cast("string")), "0123456789", "０１２３４５６７８９")
    dashed = F.replace(wide, F.lit("-"), corpus.pick(list(T.DASHES), i))
    raw = F.concat(F.when(i % 2 == 0, "〒100-0001 ").otherwise(" \t"), F.lit("東京都千代田区"), dashed, F.lit("　"))
    return sanitized(_keys(spark, sf_dir).select("i", raw.alias("raw")), "raw", "clean").select("i", "clean")


#: Inputs with what is right for them.
_KANJI = [("一", 1), ("十", 10), ("十二", 12), ("二十", 20), ("二十三", 23), ("百", 100), ("百五", 105), ("百二十三", 123), ("四百八十八", 488), ("千二百三十四", 1234), ("一二三", 123), ("〇", 0), ("零", 0), ("壱", 1), ("弐", 2), ("参", 3), ("拾", 10), ("拾弐", 12), ("五三十", 30), ("x", None), ("", None)]


@query(_values(_KANJI, "token, value").replace("SELECT *", "SELECT token, value::VARCHAR AS value"))
def kanji_number(spark, sf_dir):
    return spark.createDataFrame(_KANJI, "token string, expected long").select("token", T.kanji_number("token").cast("string").alias("value"))


_D = "一二三四五六七八九"


def _kanji(n: Column) -> Column:
    """A number from 1 to 9999 as a kanji numeral with powers."""
    token = F.lit("")
    for power, sign in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = F.floor(n / power) % 10
        digit = F.when((d == 1) & F.lit(power > 1), "").otherwise(F.substring(F.lit(_D), d.cast("int"), F.lit(1)))
        token = F.concat(token, F.when(d > 0, F.concat(digit, F.lit(sign))).otherwise(""))
    return token


@query("SELECT o_orderkey AS i, o_orderkey % 9999 + 1 AS value FROM orders")
def kanji_number_round_trip(spark, sf_dir):
    return _keys(spark, sf_dir).select("i", _kanji(F.col("i") % 9999 + 1).alias("t")).select("i", T.kanji_number("t").alias("value"))


#: Contexts that make a numeral {} a number, and two that don't, {0} staying as it is; {1} is always in digits.
_CONTEXTS = ["本町{}丁目", "{}番地", "{}番号", "{1}丁目{}番", "{1}番{}号", "本町{1}-{}号", "{1}番地の{}", "{1}-{}-{}", "第{0}回", "{1}丁目{0}番館"]


def _context_sql(pattern: str) -> str:
    told = {"": "n::VARCHAR", "0": "k", "1": "m::VARCHAR"}
    parts = [told[x[:-1][1:]] if x.startswith("{") else _quoted(x) for x in re.split(r"(\{[01]?\})", pattern) if x]
    return " || ".join(parts)


_KANJI_SQL = " || ".join(
    f"CASE (o_orderkey % 9999 + 1) // {power} % 10 WHEN 0 THEN '' WHEN 1 THEN '{sign if power > 1 else '一'}' ELSE substr('{_D}', ((o_orderkey % 9999 + 1) // {power} % 10)::INT, 1) || '{sign}' END"
    for power, sign in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))
)


@query(
    f"""WITH o AS (SELECT o_orderkey AS i, o_orderkey % 9999 + 1 AS n, o_custkey % 30 + 1 AS m, {_KANJI_SQL} AS k FROM orders)
    SELECT i, CASE i % {len(_CONTEXTS)} {' '.join(f"WHEN {j} THEN {_context_sql(c)}" for j, c in enumerate(_CONTEXTS))} END AS converted FROM o"""
)
def kanji_contexts(spark, sf_dir):
    """Kanji numerals made from keys, in each context that makes them numbers or doesn't."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("i"), (F.col("o_custkey") % 30 + 1).cast("string").alias("m"))
    k = _kanji(F.col("i") % 9999 + 1)
    text = F.lit(None)
    for j, pattern in enumerate(_CONTEXTS):
        parts = [(F.col("m") if x == "{1}" else k) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{[01]?\})", pattern) if x]
        text = F.when(F.col("i") % len(_CONTEXTS) == j, F.concat(*parts)).otherwise(text)
    return kanji_converted(o.select("i", text.alias("text")), "text", "converted").select("i", "converted")


_BLOCKS = [
    ("港区六本木三丁目", "港区六本木3丁目"), ("四百八十八番地", "488番地"), ("十二丁目五番", "12丁目5番"), ("千代田区一番町一番館301", "千代田区一番町一番館301"),
    ("六本木三-二-一", "六本木3-2-1"), ("六本木3-二-1", "六本木3-2-1"), ("第一-3ビル", "第一-3ビル"), ("三-12ビル", "3-12ビル"), ("5番六号", "5番6号"), ("10番地の二", "10番地の2"),
]


@query(_values(_BLOCKS, "text, converted"))
def kanji_blocks(spark, sf_dir):
    return kanji_converted(spark.createDataFrame(_BLOCKS, "text string, expected string"), "text", "converted").select("text", "converted")


# --- grammars ------------------------------------------------------------------------------------

#: Inputs with what is right for them.
_KYOTO = [
    ("烏丸通七条下ル東塩小路町721-1", "烏丸通", "七条", "下ル", "south", "東塩小路町721-1"),
    ("御池通烏丸西入る西横町123", "御池通", "烏丸", "西入る", "west", "西横町123"),
    ("烏丸御池上る町1", "烏丸", "御池", "上る", "north", "町1"),
    ("函館市本町1-1", None, None, None, None, "函館市本町1-1"),
]


@query(_values(_KYOTO, "text, street_1, street_2, direction, cardinal, rest"))
def kyoto_clause(spark, sf_dir):
    df = spark.createDataFrame([(r[0],) for r in _KYOTO], "text string").withColumn("f", regional.kyoto_capture(F.col("text")))
    k = regional.kyoto_clause(F.col("f"))
    return df.select("text", *[k[c].alias(c) for c in ("street_1", "street_2", "direction", "cardinal")], F.when(k.isNotNull(), regional.around(F.col("f"), 6)).otherwise(F.col("text")).alias("rest"))


#: Inputs with what is right for them.
_GRIDS = [("南三条東四丁目5番", "南", 3, "東", 4, "5番"), ("北1条西2丁目1番地", "北", 1, "西", 2, "1番地"), ("函館市本町1-1", None, None, None, None, "函館市本町1-1")]


@query(_values(_GRIDS, "text, ns, jo, ew, chome, rest").replace("SELECT *", "SELECT text, ns, jo::VARCHAR AS jo, ew, chome::VARCHAR AS chome, rest"))
def hokkaido_grid(spark, sf_dir):
    df = spark.createDataFrame([(r[0],) for r in _GRIDS], "text string").withColumn("f", regional.grid_capture(F.col("text")))
    h = regional.grid_clause("f")
    rest = F.when(h.isNotNull(), regional.around(F.col("f"), 7)).otherwise(F.col("text"))
    return df.select("text", h["cardinal_ns"].alias("ns"), h["jo"].cast("string").alias("jo"), h["cardinal_ew"].alias("ew"), h["chome"].cast("string").alias("chome"), rest.alias("rest"))


#: Fixed values. text -> state, town, chome, ban, go, banchi, edaban, regime, tail
_FSM = [
    ("六本木6丁目10番1号", "chome_named", "六本木", 6, 10, 1, None, None, "gaiku_hoshiki", ""),
    ("六本木3丁目10番地の1", "chome_named", "六本木", 3, None, None, 10, 1, "chiban", ""),
    ("六本木6丁目10-1 森タワー", "chome_hyphen", "六本木", 6, 10, 1, None, None, "gaiku_hoshiki", "森タワー"),
    ("本町2丁目三井ビル", "chome_single", "本町", 2, 3, None, None, None, "gaiku_hoshiki", "井ビル"),
    ("本町3丁目1番館", "chome_named", "本町", 3, 1, None, None, None, "gaiku_hoshiki", "館"),
    ("大手前2丁目", "chome", "大手前", 2, None, None, None, None, "gaiku_hoshiki", ""),
    ("六本木6-10-1", "hyphen", "六本木", 6, 10, 1, None, None, "gaiku_hoshiki", ""),
    ("明神町3-27", "hyphen", "明神町", None, 3, 27, None, None, "unspecified", ""),
    ("大字鮫町字日出町1-1", "hyphen", "大字鮫町字日出町", None, None, None, 1, 1, "chiban", ""),
    ("本町5番地 ABC1-2", "hyphen", "本町5番地 ABC", None, 1, 2, None, None, "unspecified", ""),
    ("上本能寺前町488番地1", "named", "上本能寺前町", None, None, None, 488, 1, "chiban", ""),
    ("麻布十番1", "named", "麻布", None, 10, 1, None, None, "gaiku_hoshiki", ""),
    ("本町5番", "named", "本町", None, 5, None, None, None, "unspecified", ""),
    ("本町7号", "marked", "本町", None, 7, None, None, None, "unspecified", ""),
    ("日本大通1", "bare", "日本大通", None, 1, None, None, None, "unspecified", ""),
    ("大字豊郷9817", "bare", "大字豊郷", None, None, None, 9817, None, "chiban", ""),
    ("麻布十番", "default", "麻布十番", None, None, None, None, None, "unspecified", ""),
    ("", "default", "", None, None, None, None, None, "unspecified", ""),
]
_NUMBERS = ("chome", "ban", "go", "banchi", "edaban")


@query(_values(_FSM, "text, state, town, chome, ban, go, banchi, edaban, regime, tail").replace("SELECT *", "SELECT text, state, town, regime, tail, " + ", ".join(f"{n}::VARCHAR AS {n}" for n in _NUMBERS)))
def fsm_states(spark, sf_dir):
    df = blocks.parse_blocks(spark.createDataFrame([(r[0],) for r in _FSM], "text string"), "text", F.lit(False))
    return df.select("text", *[F.col("_b")[c].cast("string").alias(c) for c in ("state", "town", *_NUMBERS, "regime", "tail")])


#: Texts of each state made of a, b and c, and what is right for them: state, town, chome, ban, go, banchi, edaban, regime, tail. K is a in kanji.
_STATES = [
    ("本町{a}丁目{b}番{c}号", "chome_named", "本町", "a", "b", "c", None, None, "gaiku_hoshiki", ""),
    ("本町{K}丁目{b}番地の{c} 塔", "chome_named", "本町", "a", None, None, "b", "c", "chiban", "塔"),
    ("本町{a}丁目{b}番館", "chome_named", "本町", "a", "b", None, None, None, "gaiku_hoshiki", "館"),
    ("本町{a}丁目 {b}-{c}", "chome_hyphen", "本町", "a", "b", "c", None, None, "gaiku_hoshiki", ""),
    ("本町{a}丁目{b}号 塔", "chome_single", "本町", "a", "b", None, None, None, "gaiku_hoshiki", "塔"),
    ("本町{K}丁目東", "chome", "本町", "a", None, None, None, None, "gaiku_hoshiki", "東"),
    ("本町{a}-{b}-{c} 塔", "hyphen", "本町", "a", "b", "c", None, None, "gaiku_hoshiki", "塔"),
    ("本町{b}-{c}", "hyphen", "本町", None, "b", "c", None, None, "unspecified", ""),
    ("大字本町字上{b}-{c}", "hyphen", "大字本町字上", None, None, None, "b", "c", "chiban", ""),
    ("本町{K}番地{c}", "named", "本町", None, None, None, "a", "c", "chiban", ""),
    ("本町{b}番の{c}号", "named", "本町", None, "b", "c", None, None, "gaiku_hoshiki", ""),
    ("大字本町{b}番", "named", "大字本町", None, None, None, "b", None, "chiban", ""),
    ("本町{K}号", "marked", "本町", None, "a", None, None, None, "unspecified", ""),
    ("本町{b}番町", "bare", "本町", None, "b", None, None, None, "unspecified", "番町"),
    ("字上{c}", "bare", "字上", None, None, None, "c", None, "chiban", ""),
    ("本町{K}番", "default", "本町{K}番", None, None, None, None, None, "unspecified", ""),
]


def _filled(pattern: str, of: dict[str, object], join: Callable) -> object:
    return join([of[x[1]] if x.startswith("{") else x for x in re.split(r"(\{[abcK]\})", pattern) if x])


def _state_sql(column: int) -> str:
    of = {"a": "a::VARCHAR", "b": "b::VARCHAR", "c": "c::VARCHAR", "K": f"({_KANJI_SQL})"}
    text = lambda parts: " || ".join(p if p in of.values() else _quoted(p) for p in parts) or "''"
    what = lambda v: "NULL" if v is None else f"{v}::VARCHAR" if column in range(3, 8) else _filled(v, of, text)
    return f"CASE i % {len(_STATES)} " + " ".join(f"WHEN {j} THEN {what(r[column])}" for j, r in enumerate(_STATES)) + " END"


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderkey // 4 AS i, o_orderkey % 9999 + 1 AS a, o_custkey % 400 + 1 AS b, o_orderkey % 37 + 1 AS c FROM orders)
    SELECT o_orderkey AS i, {', '.join(f'{_state_sql(j)} AS {n}' for j, n in enumerate(("state", "town", *_NUMBERS, "regime", "tail"), 1))} FROM o"""
)
def block_states(spark, sf_dir):
    """Every state, its texts made from keys."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("i"), "o_custkey")
    i = F.col("i")
    of = {"a": (i % 9999 + 1).cast("string"), "b": (F.col("o_custkey") % 400 + 1).cast("string"), "c": (i % 37 + 1).cast("string"), "K": _kanji(i % 9999 + 1)}
    text = F.lit(None)
    for j, row in enumerate(_STATES):
        text = F.when(F.floor(i / 4) % len(_STATES) == j, _filled(row[0], of, lambda parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))).otherwise(text)
    df = blocks.parse_blocks(o.select("i", text.alias("text")), "text", F.lit(False))
    return df.select("i", *[F.col("_b")[c].cast("string").alias(c) for c in ("state", "town", *_NUMBERS, "regime", "tail")])


#: Inputs with what is right for them.
_AZA = [("大字南長野字幅下", "南長野", "幅下"), ("大字豊郷", "豊郷", None), ("字辺土名", None, "辺土名"), ("一箕町大字亀賀字郷之原", "亀賀", "郷之原"), ("本町", None, None)]


@query(_values(_AZA, "town, oaza, koaza"))
def oaza_koaza(spark, sf_dir):
    return spark.createDataFrame([(r[0],) for r in _AZA], "town string").select("town", blocks.oaza(F.col("town")).alias("oaza"), blocks.koaza(F.col("town")).alias("koaza"))


#: Inputs with what is right for them.
_BUILDINGS = [
    ("森タワー50階", "森タワー", "50階", None), ("メゾン早稲田 301号室", "メゾン早稲田", None, "301号室"), ("グランドタワー 3階 302号室", "グランドタワー", "3階", "302号室"), ("飲食プラザ B1F", "飲食プラザ", "B1F", None),
    ("田町タワー 301", "田町タワー", None, "301"), ("地下1階101号室", None, "地下1階", "01号室"), ("", None, None, None),
]


@query(_values(_BUILDINGS, "tail, building, floor, unit"))
def building_floor_unit(spark, sf_dir):
    df = blocks.parse_building(spark.createDataFrame([(r[0],) for r in _BUILDINGS], "tail string"), F.col("tail"))
    return df.select("tail", *[F.col("_g")[c].alias(c) for c in ("building", "floor", "unit")])


# --- whole addresses -----------------------------------------------------------------------------

#: Fixed values. address -> canonical, lg_code, confidence, status
GOLDEN = [
    ("東京都港区六本木6-10-1", "東京都港区六本木6丁目10番1号", "131032", 1.0, "ACCEPTED"),
    ("〒106-0032 東京都港区六本木６－１０－１", "東京都港区六本木6丁目10番1号", "131032", 1.0, "ACCEPTED"),
    ("東京都港区六本木三ー二ー一", "東京都港区六本木3丁目2番1号", "131032", 1.0, "ACCEPTED"),
    ("東京都千代田区三番町三-二-一", "東京都千代田区三番町3丁目2番1号", "131016", 1.0, "ACCEPTED"),
    ("東京都港区六本木6-10-1\n改行", "東京都港区六本木6丁目10番1号 改行", "131032", 1.0, "ACCEPTED"),
    ("東京都千代田区神田錦町1-1 第一-3ビル", "東京都千代田区神田錦町1番1号 第一-3ビル", "131016", 1.0, "ACCEPTED"),
    ("東京都港区六本木1", "東京都港区六本木1番", "131032", 1.0, "ACCEPTED"),
    ("東京都北区十条1", "東京都北区十条1番", "131172", 1.0, "ACCEPTED"),
    ("東京都千代田区一番町1", "東京都千代田区一番町1番", "131016", 1.0, "ACCEPTED"),
    ("東京都港区麻布十番", "東京都港区麻布十番", "131032", 1.0, "ACCEPTED"),
    ("東京都港区麻布十番1-1", "東京都港区麻布十番1番1号", "131032", 1.0, "ACCEPTED"),
    ("中央区南1条西2丁目", "北海道札幌市中央区南1条西2丁目", "011011", 0.85, "ACCEPTED"),
    ("中央区銀座4-1-2", "中央区銀座4丁目1番2号", None, 0.5, "AMBIGUOUS"),
    ("府中市宮西町2-24", "府中市宮西町2番24号", None, 0.5, "AMBIGUOUS"),
    ("神奈川県南区1-1", "神奈川県南区1番1号", None, 0.5, "AMBIGUOUS"),
    ("大阪府北区梅田1-1-1", "大阪府北区梅田1丁目1番1号", None, 0.5, "AMBIGUOUS"),
    ("北海道泊村1-1", "北海道泊村1番1号", None, 0.5, "AMBIGUOUS"),
    ("北海道古宇郡泊村1-1", "北海道古宇郡泊村1番1号", "014036", 1.0, "ACCEPTED"),
    ("愛知郡愛荘町愛知川1", "滋賀県愛知郡愛荘町愛知川1番", "254258", 0.85, "ACCEPTED"),
    ("福島町", "北海道松前郡福島町", "013323", 0.85, "ACCEPTED"),
    ("福島区", "大阪府大阪市福島区", "271039", 0.85, "ACCEPTED"),
    ("京都郡苅田町", "福岡県京都郡苅田町", "406210", 0.85, "ACCEPTED"),
    ("東京都大阪市北区梅田1-1", "東京都大阪市北区梅田1番1号", None, 0.0, "MALFORMED"),
    ("東京タワー", "東京都タワー", None, 0.7, "UNSUPPORTED"),
    ("寺町通御池上る上本能寺前町488", "京都府京都市寺町通御池上る上本能寺前町488番地", None, 0.42, "UNSUPPORTED"),
    ("京都市中京区寺町通御池上る上本能寺前町488", "京都府京都市中京区寺町通御池上る上本能寺前町488番地", "261041", 0.85, "ACCEPTED"),
    ("ランダムな文字列12345", "ランダムな文字列12345", None, 0.0, "MALFORMED"),
    ("123 Main St, New York", "123 Main St, New York", None, 0.0, "MALFORMED"),
    ("", "", None, 0.0, "MALFORMED"),
]


def _golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in GOLDEN], "address string")


@query(_values(GOLDEN, "address, canonical, lg_code, confidence, status").replace("SELECT *", "SELECT address, canonical, confidence::DOUBLE AS confidence"))
def canonical(spark, sf_dir):
    return normalize(_golden(spark)).select("address", _normal()["canonical"].alias("canonical"), _normal()["confidence_score"].alias("confidence"))


_DASHED = "string_split(number, '-')"


@query(
    f"""SELECT prefecture || city || coalesce(o.ward, '') || town || number AS address, prefecture, city, o.ward, town,
    CASE len({_DASHED}) WHEN 3 THEN {_DASHED}[1] END AS chome, CASE len({_DASHED}) WHEN 3 THEN {_DASHED}[2] ELSE {_DASHED}[1] END AS ban,
    CASE len({_DASHED}) WHEN 3 THEN {_DASHED}[3] WHEN 2 THEN {_DASHED}[2] END AS go, m.base || {_BASE_DIGIT} AS lg_code, 1.0::DOUBLE AS confidence
    FROM ({_values(golden.OFFICES, "prefecture, city, ward, town, number")}) o JOIN ({_BASES}) m ON m.name = city || coalesce(o.ward, '')"""
)
def prefectural_offices(spark, sf_dir):
    n = normalize(spark.createDataFrame([("".join(filter(None, r)),) for r in golden.OFFICES], "address string"))
    numbers = [_parts()[k].cast("string").alias(k) for k in ("chome", "ban", "go")]
    return n.select("address", *_c("prefecture", "city", "ward", "town"), *numbers, *_c("lg_code"), _normal()["confidence_score"].alias("confidence"))


_COUNTY = f"SELECT *, {{left}} || county || city || town || number AS address, {{inferred}} AS inferred FROM ({_values(golden.COUNTIES, 'prefecture, county, city, town, number, lot')})"


@query(
    f"""SELECT address, prefecture, county, city, town, CASE WHEN NOT lot THEN number END AS ban, CASE WHEN lot THEN number END AS banchi, inferred
    FROM ({_COUNTY.format(left="prefecture", inferred="false")} UNION ALL {_COUNTY.format(left="''", inferred="true")})"""
)
def county_addresses(spark, sf_dir):
    rows = [("".join(r[k:5]),) for k in (0, 1) for r in golden.COUNTIES]
    n = normalize(spark.createDataFrame(rows, "address string"))
    return n.select("address", *_c("prefecture", "county", "city", "town"), *[_parts()[k].cast("string").alias(k) for k in ("ban", "banchi")], _parts()["prefecture_inferred"].alias("inferred"))


_SHOWN = ["prefecture", "county", "city", "ward", "lg_code", "town", "oaza", "koaza", "chome", "ban", "go", "banchi", "edaban", "building", "floor", "unit", "address_regime"]


@query(_values(golden.HARD, "address, candidates, parts"))
def hard_addresses(spark, sf_dir):
    n = normalize(spark.createDataFrame([(r[0],) for r in golden.HARD], "address string"))
    parts = F.concat_ws(";", *[F.concat(F.lit(k + "="), _parts()[k].cast("string")) for k in _SHOWN])
    return n.select("address", F.size(_parts()["ambiguous_candidates"]).alias("candidates"), parts.alias("parts"))


_CODES = "CASE status WHEN 'ACCEPTED' THEN 0 WHEN 'MALFORMED' THEN 1 WHEN 'AMBIGUOUS' THEN 2 ELSE 3 END::INT AS exit_code"


@query(_values(GOLDEN, "address, canonical, lg_code, confidence, status").replace("SELECT *", f"SELECT address, lg_code, status, status = 'ACCEPTED' AS valid, {_CODES}"))
def validate_status(spark, sf_dir):
    v = F.col("validation")
    return validate(_golden(spark)).select("address", v["lg_code"].alias("lg_code"), v["status"].alias("status"), v["valid"].alias("valid"), exit_code(v["status"]).alias("exit_code"))


_TOTAL = len(seed.municipality_rows())


@query(
    _KEYS.replace("WITH m AS", "WITH p AS (" + _PREFS + "), m AS")
    + f""", o AS (SELECT o_orderkey::BIGINT AS i, o_orderkey // 4 % {_TOTAL} AS place, o_custkey % 4 AS form FROM orders),
    r AS (SELECT *, row_number() OVER (ORDER BY lg_code) - 1 AS place FROM m),
    t AS (
      SELECT i, form, CASE WHEN form = 1 THEN NULL WHEN form = 3 THEN lpad((prefecture_code::INT % 47 + 1)::VARCHAR, 2, '0') ELSE prefecture_code END AS scope,
        CASE WHEN form = 2 THEN coalesce(county, '') || name ELSE name END AS key FROM o JOIN r USING (place)),
    c AS (SELECT i, count(m.lg_code) AS n, max(m.lg_code) AS lg_code FROM t LEFT JOIN k ON k.key = t.key LEFT JOIN m ON m.lg_code = k.lg_code AND (scope IS NULL OR m.prefecture_code = scope) GROUP BY i)
    SELECT i, coalesce(p.name, CASE WHEN n = 1 THEN m.prefecture_name END) AS prefecture, CASE WHEN n = 1 THEN m.lg_code END AS lg_code, CASE WHEN n = 1 THEN m.county END AS county,
      CASE WHEN n = 1 THEN m.city WHEN n > 1 AND scope IS NULL THEN key END AS city, CASE WHEN n = 1 THEN m.ward WHEN n > 1 AND scope IS NOT NULL THEN key END AS ward,
      CASE WHEN n = 0 THEN key ELSE '' END || '本町' AS town, i % 8 + 1 AS chome, i % 25 + 1 AS ban, i % 15 + 1 AS go, scope IS NULL AS inferred, CASE WHEN n > 1 THEN n ELSE 0 END::INT AS candidates,
      n = 0 AS contradictory, CASE WHEN n = 0 THEN 0.0 WHEN n > 1 THEN 0.5 WHEN scope IS NULL THEN 0.85 ELSE 1.0 END::DOUBLE AS confidence,
      CASE WHEN n = 0 THEN '{MALFORMED}' WHEN n > 1 THEN '{AMBIGUOUS}' ELSE '{ACCEPTED}' END AS status
    FROM t JOIN c USING (i) LEFT JOIN m ON m.lg_code = c.lg_code LEFT JOIN p ON p.code = scope"""
)
def municipality_round_trip(spark, sf_dir):
    """Every municipality of the register by its prefecture, without one, with its county, and by a wrong prefecture."""
    reg = R.registry(spark)
    prefs = reg.prefectures.select(F.col("code").alias("_code"), F.col("name").alias("_pref"))
    ranked = sorted(reg.municipalities.select("lg_code", "prefecture_code", "county", "name").collect())
    munis = spark.createDataFrame([(at, *row) for at, row in enumerate(ranked)], "at long, lg_code string, prefecture_code string, county string, name string")
    i = F.col("i")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("i"), (F.col("o_custkey") % 4).alias("form"))
    o = o.withColumn("at", F.floor(i / 4) % _TOTAL).join(F.broadcast(munis), "at")
    scope = F.when(F.col("form") == 1, None).when(F.col("form") == 3, F.lpad((F.col("prefecture_code").cast("int") % 47 + 1).cast("string"), 2, "0")).otherwise(F.col("prefecture_code"))
    o = o.withColumn("scope", scope).join(F.broadcast(prefs), F.col("scope") == F.col("_code"), "left")
    number = F.concat((i % 8 + 1).cast("string"), F.lit("丁目"), (i % 25 + 1).cast("string"), F.lit("番"), (i % 15 + 1).cast("string"), F.lit("号"))
    county = F.when(F.col("form") == 2, F.coalesce("county", F.lit(""))).otherwise("")
    v = validation(F.col("normalized"))
    o = o.select("i", F.concat(F.coalesce("_pref", F.lit("")), county, "name", F.lit("本町"), number).alias("address"))
    return normalize(o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i")).select(
        "i", *_c("prefecture", "lg_code", "county", "city", "ward", "town", "chome", "ban", "go"), _parts()["prefecture_inferred"].alias("inferred"),
        F.size(_parts()["ambiguous_candidates"]).alias("candidates"), _parts()["is_contradictory"].alias("contradictory"), _normal()["confidence_score"].alias("confidence"), v["status"].alias("status"),
    )


#: Inputs with what is right for them.
_TIERS = [
    ("東京都港区六本木1-2-3", "ban=tier_2_conventional,chome=tier_2_conventional,go=tier_2_conventional,lg_code=tier_1_statutory,municipality=tier_1_statutory,prefecture=tier_1_statutory,town=tier_3_heuristic"),
    ("神奈川県南区1-1", "ban=tier_2_conventional,go=tier_2_conventional,prefecture=tier_1_statutory,ward=tier_3_heuristic"),
    ("中郡大磯町大磯1392", "ban=tier_2_conventional,county=tier_1_statutory,lg_code=tier_1_statutory,municipality=tier_1_statutory,prefecture=tier_3_heuristic,town=tier_3_heuristic"),
    ("ランダム", ""),
]


@query(_values(_TIERS, "address, tiers"))
def tier_map(spark, sf_dir):
    n = normalize(spark.createDataFrame([(r[0],) for r in _TIERS], "address string"))
    entries = F.transform(F.sort_array(F.map_entries(_normal()["tier_map"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return n.select("address", F.array_join(entries, ",").alias("tiers"))


#: Inputs with what is right for them.
_CANDIDATES = [
    ("府中市宮西町2-24", "東京都府中市 (132063);広島県府中市 (342084)"), ("伊達市鹿島町20-1", "北海道伊達市 (012335);福島県伊達市 (072133)"), ("北海道泊村1-1", "北海道泊村 (014036);北海道泊村 (016969)"),
    ("神奈川県南区1-1", "神奈川県横浜市南区 (141054);神奈川県相模原市南区 (141534)"), ("東京都港区1", ""),
]


@query(_values(_CANDIDATES, "address, candidates"))
def ambiguity(spark, sf_dir):
    n = normalize(spark.createDataFrame([(r[0],) for r in _CANDIDATES], "address string"))
    return n.select("address", F.array_join(_parts()["ambiguous_candidates"], ";").alias("candidates"))


_I = "o_orderkey"


@query(
    f"""SELECT {_I} AS i, {_list([p for p, _ in corpus.PLACES], _I)} AS prefecture, {_list([c for _, c in corpus.PLACES], _I)} AS city,
    '本町' AS town, {_I} % 8 + 1 AS chome, ({_I} * 3) % 25 + 1 AS ban, ({_I} * 7) % 15 + 1 AS go, 'gaiku_hoshiki' AS address_regime FROM orders"""
)
def round_trip_standard(spark, sf_dir):
    return normalize(corpus.standard(_keys(spark, sf_dir)).select("i", "address")).select("i", *_c("prefecture", "city", "town", "chome", "ban", "go", "address_regime"))


@query(
    f"""SELECT {_I} AS i, {_list(corpus.NORTH_SOUTH_STREETS, _I)} AS street_1, {_list(corpus.EAST_WEST_STREETS, f"{_I} * 5")} AS street_2,
    {_list(corpus.DIRECTIONS, f"{_I} * 2")} AS direction, '町' AS town, {_I} * 7 + 100 AS banchi, '261041' AS lg_code FROM orders"""
)
def round_trip_kyoto(spark, sf_dir):
    n = normalize(corpus.intersections(_keys(spark, sf_dir)).select("i", "address"))
    k = _parts()["kyoto_direction"]
    return n.select("i", *[k[c].alias(c) for c in ("street_1", "street_2", "direction")], *_c("town", "banchi", "lg_code"))


@query(
    f"""SELECT {_I} AS i, CASE WHEN {_I} % 2 = 0 THEN '北' ELSE '南' END AS ns, CASE WHEN ({_I} // 2) % 2 = 0 THEN '西' ELSE '東' END AS ew,
    {_I} % 15 + 1 AS jo, ({_I} * 3) % 20 + 1 AS chome, ({_I} * 5) % 30 + 1 AS banchi FROM orders"""
)
def round_trip_grid(spark, sf_dir):
    n = normalize(corpus.grid(_keys(spark, sf_dir)).select("i", "address"))
    h = _parts()["hokkaido_grid"]
    return n.select("i", h["cardinal_ns"].alias("ns"), h["cardinal_ew"].alias("ew"), h["jo"].alias("jo"), *_c("chome", "banchi"))


@query(f"SELECT {_I} AS i, '南長野' AS oaza, '幅下' AS koaza, {_I} * 11 + 200 AS banchi, {_I} % 7 + 1 AS edaban, 'chiban' AS address_regime FROM orders")
def round_trip_cadastral(spark, sf_dir):
    return normalize(corpus.cadastral(_keys(spark, sf_dir)).select("i", "address")).select("i", *_c("oaza", "koaza", "banchi", "edaban", "address_regime"))


@query(
    f"""SELECT {_I} AS i, '東京都' AS prefecture, true AS prefecture_inferred, {_I} % 5 + 1 AS chome, {_I} % 20 + 1 AS ban, {_I} % 10 + 1 AS go,
    '第' || ({_I} % 5 + 1) || {_list(corpus.BUILDINGS, _I)} AS building, {_list(corpus.FLOORS, _I)} AS floor FROM orders"""
)
def round_trip_untidy(spark, sf_dir):
    n = normalize(corpus.untidy(_keys(spark, sf_dir)).select("i", "address"))
    return n.select("i", *_c("prefecture", "prefecture_inferred", "chome", "ban", "go", "building", "floor"))


@query("SELECT 'ACCEPTED' AS status, count(*)::BIGINT AS n, round(avg(CASE WHEN o_orderkey % 5 = 4 THEN 0.85 ELSE 1.0 END), 6) AS confidence FROM orders")
def validate_rollup(spark, sf_dir):
    v = F.col("validation")
    checked = validate(corpus.mixed(_keys(spark, sf_dir)))
    return checked.groupBy(v["status"].alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(v["confidence_score"]), 6).alias("confidence"))


# --- output forms and geocoding ------------------------------------------------------------------

#: Inputs with what is right for them.
_TEXTS = [
    ("東京都港区六本木6-10-1", "Prefecture: 東京都\nCity:       港区\nTown:       六本木\nChome:      6\nBan:        10\nGo:         1\nRegime:     gaiku_hoshiki\nLG Code:    131032\nConfidence: 1.00\nCanonical:  東京都港区六本木6丁目10番1号"),
    ("ランダム", "Input:      ランダム\nStatus:     Rejected (unrecognized or malformed address)\nConfidence: 0.00\nCanonical:  "),
]


@query(_values(_TEXTS, "address, shown"))
def format_normalize(spark, sf_dir):
    return normalize(spark.createDataFrame([(r[0],) for r in _TEXTS], "address string")).select("address", formats.normalized_text(_normal()).alias("shown"))


#: Inputs with what is right for them.
_VALID_TEXTS = [
    ("東京都港区六本木6-10-1", "Input:       東京都港区六本木6-10-1\nStatus:      ACCEPTED\nValid:       Yes\nConfidence:  1.00\nLG Code:     131032\nRegime:      gaiku_hoshiki\nMessage:     Local government entity verified against official statutory registry."),
    ("府中市宮西町2-24", "Input:       府中市宮西町2-24\nStatus:      AMBIGUOUS\nValid:       No\nConfidence:  0.50\nRegime:      unspecified\nMessage:     Omitted prefecture matches 2 statutory municipalities.\nCandidates:\n  • 東京都府中市 (132063)\n  • 広島県府中市 (342084)"),
]


@query(_values(_VALID_TEXTS, "address, shown"))
def format_validate(spark, sf_dir):
    v = validate(spark.createDataFrame([(r[0],) for r in _VALID_TEXTS], "address string"))
    return v.select("address", formats.validation_text(F.col("validation")).alias("shown"))


@query("SELECT true AS whole, '東京都港区六本木6丁目10番1号' AS canonical, true AS keeps_nulls")
def to_json_normalized(spark, sf_dir):
    j = normalize(spark.createDataFrame([("東京都港区六本木6-10-1",)], "address string")).select(formats.to_json(_normal()).alias("j"))
    text = F.get_json_object("j", "$.canonical")
    return j.select(F.get_json_object("j", "$.components.chome").isNotNull().alias("whole"), text.alias("canonical"), F.contains("j", F.lit('"county":null')).alias("keeps_nulls"))


#: Inputs with what is right for them.
_GEO_QUERIES = [("東京都港区六本木6-10-1 六本木ヒルズ森タワー 50F 5001号室", "東京都港区六本木6丁目10番1号"), ("北海道札幌市中央区北1条西2丁目1番地", "北海道札幌市中央区北1条西2丁目1番地")]


@query(_values(_GEO_QUERIES, "address, query"))
def geocode_query(spark, sf_dir):
    return normalize(spark.createDataFrame([(r[0],) for r in _GEO_QUERIES], "address string")).select("address", query_text(_normal()).alias("query"))


_FEATURE = '{"geometry":{"coordinates":[%s,%s],"type":"Point"},"type":"Feature","properties":{"addressCode":"13103","title":"%s"}}'
_ONE = _FEATURE % ("139.729202", "35.660206", "東京都港区六本木六丁目")
_OTHER = _FEATURE % ("139.5", "35.5", "別の場所")
_ANSWERS = [("東京都港区六本木6丁目10番1号", f"[{_ONE}]"), ("東京都新宿区本町1丁目1番1号", f"[{_ONE},{_OTHER}]"), ("東京都港区六本木7丁目1番1号", f"[{_ONE},{_ONE}]"), ("東京都港区六本木1番", "[]")]
#: Inputs with what is right for them.
_GEO = [
    ("東京都港区六本木6-10-1", "SUCCESS", 35.660206, 139.729202, None),
    ("東京都新宿区本町1-1-1", "AMBIGUOUS", None, None, 2),
    ("東京都港区六本木7-1-1", "SUCCESS", 35.660206, 139.729202, None),
    ("東京都港区六本木1", "NO_MATCH", None, None, None),
    ("府中市宮西町2-24", "AMBIGUOUS", None, None, 2),
    ("東京タワー", "NO_MATCH", None, None, None),
    ("", "NO_MATCH", None, None, None),
]


@query(_values(_GEO, "address, status, latitude, longitude, candidate_count").replace("SELECT *", "SELECT address, status, latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude, candidate_count::VARCHAR AS candidate_count"))
def geojson_resolve(spark, sf_dir):
    answers = TableResolver(spark.createDataFrame(_ANSWERS, "query string, body string"))
    g = F.col("geocoded")
    got = geocode(spark.createDataFrame([(r[0],) for r in _GEO], "address string"), answers)
    return got.select("address", g["status"].alias("status"), g["coordinates"]["latitude"].alias("latitude"), g["coordinates"]["longitude"].alias("longitude"), g["candidate_count"].cast("string").alias("candidate_count"))


#: Inputs with what is right for them.
_GEO_TEXTS = [
    ("東京都港区六本木6-10-1", "Input:       東京都港区六本木6-10-1\nStatus:      SUCCESS\nProvider:    table\nCoordinates: 35.660206, 139.729202 (Lat, Lon)\nMatched:     東京都港区六本木六丁目\nCandidates:\n  • 東京都港区六本木六丁目"),
    ("東京タワー", "Input:       東京タワー\nStatus:      NO_MATCH\nProvider:    table"),
]


@query(_values(_GEO_TEXTS, "address, shown").replace("SELECT *", "SELECT address, shown"))
def format_geocode(spark, sf_dir):
    answers = TableResolver(spark.createDataFrame(_ANSWERS, "query string, body string"))
    got = geocode(spark.createDataFrame([(r[0],) for r in _GEO_TEXTS], "address string"), answers)
    return got.select("address", F.regexp_replace(formats.geocoded_text(F.col("geocoded")), "\nMessage:.*", "").alias("shown"))


#: Inputs with what is right for them.
_PARSE_TEXTS = [
    (
        "東京都港区六本木6-10-1",
        "Input: 東京都港区六本木6-10-1\n\n\n[Administrative]\n  Prefecture:    東京都 (Code: 13)\n  City:          港区\n  LG Code:       131032\n  Town:          六本木\n\n"
        "[Block & Lot]\n  Chome:         6\n  Ban:           10\n  Go:            1\n  Regime:        gaiku_hoshiki\n\n[Classification]\n  Confidence:    1.00\n  Ambiguous:     False",
    ),
    ("ランダム", "Input:        ランダム\nStatus:       Rejected (Confidence: 0.00)\nError:        Could not decompose input into Japanese address components."),
]


@query(_values(_PARSE_TEXTS, "address, shown"))
def format_parse(spark, sf_dir):
    return normalize(spark.createDataFrame([(r[0],) for r in _PARSE_TEXTS], "address string")).select("address", formats.parsed_text(_normal()).alias("shown"))


#: Inputs with what is right for them.
_PARSED = [
    ("東京都港区六本木6-10-1", "東京都", "港区", None, "六本木", "6", "10", "1"),
    ("大阪府大阪市中央区大手前2丁目", "大阪府", "大阪市", "中央区", "大手前", "2", None, None),
    ("ランダム", None, None, None, None, None, None, None),
]


@query(_values(_PARSED, "address, prefecture, city, ward, town, chome, ban, go"))
def parse_components(spark, sf_dir):
    c = parse(spark.createDataFrame([(r[0],) for r in _PARSED], "address string"))
    return c.select("address", *[F.col("components")[k].cast("string").alias(k) for k in ("prefecture", "city", "ward", "town", "chome", "ban", "go")])


class _Answer:
    def __init__(self, code: int, body: bytes):
        self.code, self.body = code, body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def getcode(self):
        return self.code

    def read(self):
        return self.body


def _opener(outcome):
    def ask(request, timeout):
        if isinstance(outcome, Exception):
            raise outcome
        return outcome

    return ask


_FETCHED = [
    ("answer", _Answer(200, b"[]"), "[]", None),
    ("status", _Answer(204, b""), None, "GSI API responded with HTTP status 204."),
    ("http", urllib.error.HTTPError("u", 503, "Busy", None, None), None, "GSI HTTP error: 503 Busy"),
    ("connection", urllib.error.URLError("refused"), None, "GSI connection error: refused"),
    ("timeout", TimeoutError(), None, "GSI request timed out after 5.0s."),
    ("json", json.JSONDecodeError("Expecting value", "x", 0), None, "Failed to decode GSI JSON response: Expecting value: line 1 column 1 (char 0)"),
    ("other", ValueError("odd"), None, "Unexpected error querying GSI: odd"),
]


@query(_values([(k, b, e) for k, _, b, e in _FETCHED], "outcome, body, error"))
def fetch_outcomes(spark, sf_dir):
    return spark.createDataFrame([(k, *fetch("http://localhost/", 5.0, "x", _opener(o))) for k, o, _, _ in _FETCHED], "outcome string, body string, error string")


@query("SELECT c_custkey::VARCHAR AS code, c_name AS name, c_mktsegment AS segment FROM customer")
def workbooks_of_customers(spark, sf_dir):
    """Customers as workbooks from many tasks, scanned by ranges of rows."""
    at = _file(spark, "customers")
    write_workbooks(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"), at)
    return scan_workbook(spark, at, [1], "A string, B string, C string", rows_per_partition=10_000).toDF("code", "name", "segment")


@query("SELECT p_partkey, p_name, p_brand, p_size::INT AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM part")
def json_array_of_parts(spark, sf_dir):
    """Parts by name as arrays from many tasks, read back."""
    at = _file(spark, "parts")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("int").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    write_json_array(parts.orderBy("p_name", "p_partkey"), at)
    return spark.read.schema(parts.schema).option("multiLine", True).option("mode", "FAILFAST").json(at)


@query(
    """WITH t AS (SELECT o_orderkey % 5 AS corpus, ((o_orderkey * 37) % 1009)::DOUBLE AS us FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY us) - 1 AS k, count(*) OVER (PARTITION BY corpus) AS m FROM t)
    SELECT corpus, count(*)::BIGINT AS n, sum(us) AS total_us, round(avg(us), 6) AS mean_us, median(us) AS p50_us, max(us) FILTER (WHERE k = m * 90 // 100) AS p90_us,
      max(us) FILTER (WHERE k = m * 99 // 100) AS p99_us, min(us) AS min_us, max(us) AS max_us, round(count(*) * 1e6 / sum(us), 6) AS per_sec FROM r GROUP BY corpus"""
)
def latency_aggregates(spark, sf_dir):
    times = _keys(spark, sf_dir).select((F.col("i") % 5).alias("corpus"), ((F.col("i") * 37) % 1009).alias("us"))
    return timings.aggregates(times).withColumns({c: F.round(c, 6) for c in ("mean_us", "per_sec")})
