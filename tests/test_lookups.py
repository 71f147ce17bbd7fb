"""Lookups of whole columns, and percentiles of keys of any size."""

import random

from chomeflow.plans import timings
from chomeflow.sources import registry as R


def test_percentiles_against_sorted_lists(spark):
    r = random.Random(6)
    rows = [("hot", float(r.choice([1, 2, 2, 2, 3, r.random() * 1e6]))) for _ in range(20_001)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 7.5), (None, 8.5), (None, 1.0), ("none", None), ("tied", 3.0)] * 1
    rows += [("tied", 3.0)] * 999
    got = {x["corpus"]: x for x in timings.aggregates(spark.createDataFrame(rows, "corpus string, us double").repartition(5)).collect()}
    assert set(got) == {"hot", "one", "two", None, "tied"}
    for c, x in got.items():
        v = sorted(t for k, t in rows if k == c and t is not None)
        n = len(v)
        assert (x["n"], x["min_us"], x["max_us"]) == (n, v[0], v[-1])
        assert x["p50_us"] == (v[(n - 1) // 2] + v[n // 2]) / 2 and x["p90_us"] == v[int(n * 0.9)] and x["p99_us"] == v[int(n * 0.99)]
        assert abs(x["total_us"] - sum(v)) < 1e-3 and abs(x["per_sec"] - n * 1e6 / sum(v)) < 1e-3


def test_percentiles_have_no_window_by_corpus_over_values(spark):
    plan = timings.aggregates(spark.createDataFrame([("a", 1.0)], "corpus string, us double"))._jdf.queryExecution().optimizedPlan().toString()
    ordered = [x for x in plan.split("\n") if "Window" in x and "_us" in x.split("windowspecdefinition")[-1].split("ASC")[0]]
    assert ordered and all("_part" in x.split("windowspecdefinition")[-1].split("ASC")[0] for x in ordered)


def test_percentiles_of_nothing(spark):
    assert timings.aggregates(spark.createDataFrame([], "corpus string, us double")).count() == 0


def test_lookups_keep_rows(spark):
    reg = R.Registry(spark)
    df = spark.createDataFrame([("26",), ("大阪府",), ("北海",), (None,), ("",), ("26",), ("99",)], "key string")
    assert sorted((r["key"], r["p"] and r["p"]["code"]) for r in reg.join_prefectures(df, "key", "p").collect() if r["key"]) == [("26", "26"), ("26", "26"), ("99", None), ("北海", "01"), ("大阪府", "27")]
    by_code = spark.createDataFrame([("131032",), ("999999",), (None,)], "c string")
    assert {(r["c"], r["m"] and r["m"]["name"]) for r in reg.join_municipality_by_code(by_code, "c", "m").collect()} == {("131032", "港区"), ("999999", None), (None, None)}
    asked = spark.createDataFrame([("泊村", None), ("泊村", "01"), ("中央区", ""), ("中央区", "01"), (None, "01"), ("無い", None)], "name string, pref string")
    got = {(r["name"], r["pref"]): [x["lg_code"] for x in r["found"]] for r in reg.join_municipalities(asked, "name", "pref").collect()}
    assert got["泊村", "01"] == got["泊村", None][-1:] or len(got["泊村", "01"]) == 1
    assert len(got["中央区", ""]) > 5 and got["中央区", ""] == sorted(got["中央区", ""]) and got["中央区", "01"] == [] == got[None, "01"] == got["無い", None]
    for name, pref in (("泊村", None), ("泊村", "01"), ("中央区", None)):
        assert got[name, pref if name == "泊村" else ""] == [r["lg_code"] for r in reg.find_municipalities(name, pref).collect()]
