import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chomeflow import Registry, cli, corpus, queries
from chomeflow.data import seed
from chomeflow.functions import codes
from chomeflow.operators.geocode import default_resolver, fetch, geocode
from chomeflow.plans.normalize import normalize
from chomeflow.plans.validate import validate
from chomeflow.sources import registry as R


def _rows(spark, addresses, plan=normalize, out="normalized"):
    df = spark.createDataFrame(list(enumerate(addresses)), "i int, address string")
    return [r[out] for r in plan(df).orderBy("i").collect()]


#: Fixed values. address -> city, ward, town, chome, ban, go, banchi, edaban
PREFECTURAL = [
    ("青森県青森市新町1-1", "青森市", None, "新町", None, 1, 1, None, None),
    ("宮城県仙台市青葉区本町3-8-1", "仙台市", "青葉区", "本町", 3, 8, 1, None, None),
    ("福島県福島市杉妻町2-16", "福島市", None, "杉妻町", None, 2, 16, None, None),
    ("埼玉県さいたま市浦和区高砂3-15-1", "さいたま市", "浦和区", "高砂", 3, 15, 1, None, None),
    ("東京都新宿区西新宿2丁目8番1号", "新宿区", None, "西新宿", 2, 8, 1, None, None),
    ("神奈川県横浜市中区日本大通1", "横浜市", "中区", "日本大通", None, 1, None, None, None),
    ("長野県長野市大字南長野字幅下692-2", "長野市", None, "大字南長野字幅下", None, None, None, 692, 2),
    ("三重県津市広明町13", "津市", None, "広明町", None, 13, None, None, None),
    ("京都府京都市上京区下立売通新町西入薮ノ内町", "京都市", "上京区", "薮ノ内町", None, None, None, None, None),
    ("大阪府大阪市中央区大手前2丁目", "大阪市", "中央区", "大手前", 2, None, None, None, None),
    ("岡山県岡山市北区内山下2-4-6", "岡山市", "北区", "内山下", 2, 4, 6, None, None),
    ("愛媛県松山市一番町4-4-2", "松山市", None, "一番町", 4, 4, 2, None, None),
    ("沖縄県那覇市泉崎1-2-2", "那覇市", None, "泉崎", 1, 2, 2, None, None),
    ("沖縄県国頭郡国頭村字辺土名121", "国頭村", None, "字辺土名", None, None, None, 121, None),
    ("三重県四日市市三番町1-2", "四日市市", None, "三番町", None, 1, 2, None, None),
]


def test_addresses_of_many_prefectures(spark):
    for want, n in zip(PREFECTURAL, _rows(spark, [r[0] for r in PREFECTURAL]), strict=True):
        c = n["components"]
        assert (c["city"], c["ward"], c["town"], c["chome"], c["ban"], c["go"], c["banchi"], c["edaban"]) == want[1:], want[0]
        assert c["lg_code"] and n["confidence_score"] == 1.0


def test_golden_values(spark):
    got = {r["address"]: (r["canonical"], r["confidence"]) for r in queries.QUERIES["canonical"](spark, "").collect()}
    assert got == {r[0]: (r[1], r[3]) for r in queries.GOLDEN}


def test_passes_columns_through_and_takes_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "東京都港区六本木1", "y")], "normalized int, address string, _raw string")
    got = normalize(df, out="result").orderBy("normalized").collect()
    assert [r["_raw"] for r in got] == ["x", "y"]
    assert got[0]["result"]["canonical"] == "" and got[1]["result"]["canonical"] == "東京都港区六本木1番"


def test_filters_on_results_stay_cheap(spark):
    df = corpus.mixed(spark.range(50).select(F.col("id").alias("i")))
    assert validate(df).where(F.col("validation.status") == "ACCEPTED").count() == 50


def test_fact_side_is_not_shuffled(spark):
    plan = normalize(spark.createDataFrame([("東京都",)], "address string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") >= 3 and "Python" not in plan


def test_seed_codes_are_right():
    rows = seed.municipality_rows()
    assert all(seed.check_digit(r[2]) == r[3] for r in rows) and len({r[4] for r in rows}) == len(rows)
    assert sum(r[9] == "administrative_ward" for r in rows) == 171 and sum(r[9] == "designated_city" for r in rows) == 20
    with pytest.raises(ValueError):
        seed.check_digit("1310")


def test_check_digits(spark):
    known = {"01100": "2", "13101": "6", "13102": "4", "13103": "2", "13104": "1", "26100": "9", "27100": "4"}
    df = spark.createDataFrame(list(known.items()), "base string, digit string")
    assert df.where(codes.check_digit(F.col("base")) != F.col("digit")).count() == 0


def test_builds_the_register_from_sheets(spark):
    head = {"A": "code", "B": "prefecture", "C": "municipality"}
    one = [head, {"A": "010006", "B": "北海道"}, {"A": "011002", "B": "北海道", "C": "札幌市"}, {"A": "013030", "B": "北海道", "C": "当別町"}, {"A": "131016", "B": "東京都", "C": "千代田区"}]
    two = [head, {"A": "011002", "B": "北海道", "C": "札幌市"}, {"A": "011011", "B": "北海道", "C": "札幌市中央区"}]
    counties = spark.createDataFrame([("01303", "石狩郡")], "base_code string, county string")
    got = R.build(R.sheet_frame(spark, one), R.sheet_frame(spark, two), counties, records=4).collect()
    assert [(r["lg_code"], r["city"], r["ward"], r["county"], r["entity_type"]) for r in got] == [
        ("011002", "札幌市", None, None, "designated_city"),
        ("011011", "札幌市", "中央区", None, "administrative_ward"),
        ("013030", "当別町", None, "石狩郡", "town"),
        ("131016", "千代田区", None, None, "special_ward"),
    ]
    with pytest.raises(ValueError):
        R.build(R.sheet_frame(spark, one), R.sheet_frame(spark, two), counties, records=5)
    with pytest.raises(Exception, match="wrong check digit"):
        R.build(R.sheet_frame(spark, [head, {"A": "131017", "B": "東京都", "C": "千代田区"}]), R.sheet_frame(spark, [head]), counties, records=1)


def test_registry_from_a_file(spark, tmp_path):
    R.write(R.municipalities(spark).where("prefecture_code = '13'"), f"{tmp_path}/m.parquet")
    r = Registry(spark, f"{tmp_path}/m.parquet")
    n = normalize(spark.createDataFrame([("中央区銀座4-1-2",)], "address string"), registry=r).first()["normalized"]
    assert n["components"]["lg_code"] == "131024" and not n["components"]["is_ambiguous"]


def test_registry_json_comes_back_whole(spark, tmp_path):
    at = f"{tmp_path}/m.json"
    R.write(R.municipalities(spark), at)
    back = R.municipalities(spark, at)
    assert sorted(back.collect()) == sorted(R.municipalities(spark).collect())
    R.municipalities(spark).write.json(f"{tmp_path}/lines.json")
    assert R.municipalities(spark, f"{tmp_path}/lines.json").count() == len(seed.municipality_rows())
    (tmp_path / "odd.json").write_text('[{"name": "no code"}]')
    with pytest.raises(ValueError, match="1 of 1 rows"):
        Registry(spark, f"{tmp_path}/odd.json")
    (tmp_path / "c.json").write_text(json.dumps({"01303": "石狩郡", "01332": "松前郡"}))
    assert {tuple(r) for r in R.county_map(spark, f"{tmp_path}/c.json").collect()} == {("01303", "石狩郡"), ("01332", "松前郡")}


def _sheet_xml(rows, shared):
    cells = lambda i, r: "".join(f'<c r="{c}{i}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>' for c, v in zip("ABC", r, strict=True) if v is not None)
    body = "".join(f'<row r="{i}">{cells(i, r)}</row>' for i, r in enumerate(rows, 1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def test_builds_the_register_from_a_workbook(spark, tmp_path):
    shared = {}
    sheets = [_sheet_xml(rows, shared) for rows in (queries._SHEET_1, queries._SHEET_2)]
    # a reading over the text, and a text in runs
    item = lambda v: f"<si><r><t>{v[:1]}</t></r><r><t>{v[1:]}</t></r><rPh><t>ヨミ</t></rPh></si>" if len(v) > 3 else f"<si><t>{v}</t></si>"
    strings = f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{"".join(map(item, shared))}</sst>'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", strings)
        for i, xml in enumerate(sheets, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", xml)
    (tmp_path / "c.json").write_text(json.dumps({"01303": "石狩郡"}))
    got = R.build_from_workbook(spark, str(tmp_path / "book.xlsx"), f"{tmp_path}/c.json", records=7)
    want = queries.QUERIES["register_build"](spark, "")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    R.write(got, f"{tmp_path}/register.json")
    assert R.municipalities(spark, f"{tmp_path}/register.json").count() == 7


def test_command_line(spark, capsys, monkeypatch):
    assert cli.main(["東京都港区六本木6-10-1", "-c"], spark) == 0
    assert capsys.readouterr().out.strip() == "東京都港区六本木6丁目10番1号"
    assert cli.main(["validate", "府中市宮西町2-24", "--json"], spark) == 2
    assert json.loads(capsys.readouterr().out)["is_ambiguous"] is True
    assert cli.main(["parse", "ランダム"], spark) == 1
    assert cli.main(["validate", "--nonsense"], spark) == 64
    assert cli.main([], spark) == 0


def test_http_errors_are_told():
    def refuse(*a, **b):
        raise TimeoutError

    assert fetch("http://localhost/", 1.0, "x", refuse) == (None, "GSI request timed out after 1.0s.")


def test_default_resolver_is_kept_and_not_asked_in_vain(spark):
    assert default_resolver(5.0) is default_resolver(5.0) and default_resolver(3.0).timeout == 3.0
    got = geocode(spark.createDataFrame([("",), ("東京タワー",)], "address string")).select("geocoded.status", "geocoded.provider").collect()
    assert [tuple(r) for r in got] == [("NO_MATCH", "gsi")] * 2


def test_stream_gives_the_same(spark, tmp_path):
    from chomeflow.streaming.normalize_stream import normalize_stream, write_stream

    spark.createDataFrame([("東京都港区六本木6-10-1",)], "address string").write.parquet(f"{tmp_path}/in")
    write_stream(normalize_stream(spark, f"{tmp_path}/in", "address string"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").first()["normalized"]["canonical"] == "東京都港区六本木6丁目10番1号"
