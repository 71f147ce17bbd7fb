"""Numerals, block states and prefixes on random texts, against plain Python that takes one rule after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chomeflow.functions import text as T
from chomeflow.operators import blocks, prefixes
from chomeflow.plans.normalize import kanji_converted

K = "[〇零一壱二弐三参四五六七八九十拾百千]"
N = rf"(?:\d+|{K}+)"
NOT_NAME = "(?!町|丁|街|館|割|組|場|屋|通|筋)"
DIGIT = dict(zip("〇零一壱二弐三参四五六七八九", map(int, "00112233456789"), strict=True))
POWER = {"十": 10, "拾": 10, "百": 100, "千": 1000}


def value(token):
    if token is None:
        return None
    if re.fullmatch(r"\d+", token):
        return int(token)
    if not any(c in POWER for c in token):
        return int("".join(str(DIGIT[c]) for c in token))
    total = digit = 0
    for c in token:
        if c in POWER:
            total, digit = total + (digit or 1) * POWER[c], 0
        else:
            digit = DIGIT[c]
    return total + digit


def converted(text):
    told = lambda m: "".join(str(value(g)) if i == 1 else g for i, g in enumerate(m.groups()))
    for before, after in (("", "丁目"), ("", "番地"), ("", "番(?:地の|号)"), (r"\d+丁目", "番" + NOT_NAME), (r"番|\d+-", "号"), ("番地の", "")):
        text = re.sub(f"({before})({K}+)({after})", told, text)

    def sequence(m):
        parts = m[0].split("-")
        return "-".join(str(value(p)) if re.fullmatch(K + "+", p) else p for p in parts)

    return re.sub(rf"(?<!第){N}(?:-{N})+(?!ビル|号館|館|マンション|アパート|ハイツ|レジデンス|タワー)", lambda m: sequence(m) if re.search(K, m[0]) else m[0], text)


def stepwise(text, has_chome):
    """town, chome, ban, go, banchi, edaban, regime, tail: the states in order."""
    text = text.strip()
    aza = lambda town: "大字" in town and bool(re.search(r"大字[^\s\d]", town)) or bool(re.search(r"(?<!大)小?字[^\s\d]", town))
    second = rf"(?:(?:の|-)?({N})号?)?"
    lots = lambda a, b: (None, None, value(a), value(b), "chiban")
    if m := re.match(rf"^(.*?)({N})丁目(.*)$", text):
        town, chome, rest = m[1].strip(), value(m[2]), m[3].strip()
        if m := re.match(rf"^({N})(番地の|番地|番){second}(.*)$", rest):
            numbers = lots(m[1], m[3]) if "番地" in m[2] else (value(m[1]), value(m[3]), None, None, "gaiku_hoshiki")
            return (town, chome, *numbers, m[4].strip())
        if m := re.match(rf"^({N})-({N})(.*)$", rest):
            return town, chome, value(m[1]), value(m[2]), None, None, "gaiku_hoshiki", m[3].strip()
        if m := re.match(rf"^({N})号?(.*)$", rest):
            return town, chome, value(m[1]), None, None, None, "gaiku_hoshiki", m[2].strip()
        return town, chome, None, None, None, None, "gaiku_hoshiki", rest
    if m := re.match(r"^(.*?)(\d+)-(\d+)(?:-(\d+))?(.*)$", text):
        town, tail = m[1].strip(), m[5].strip()
        if m[4]:
            return town, value(m[2]), value(m[3]), value(m[4]), None, None, "gaiku_hoshiki", tail
        if aza(town):
            return (town, None, *lots(m[2], m[3]), tail)
        return town, None, value(m[2]), value(m[3]), None, None, "gaiku_hoshiki" if has_chome else "unspecified", tail
    if (m := re.match(rf"^(.*?)({N})(番地の|番地|番{NOT_NAME}){second}(.*)$", text)) and not (m[3] == "番" and not m[4] and re.fullmatch(K + "+", m[2])):
        town, tail = m[1].strip(), m[5].strip()
        if "番地" in m[3] or aza(town):
            return (town, None, *lots(m[2], m[4]), tail)
        return town, None, value(m[2]), value(m[4]), None, None, "gaiku_hoshiki" if m[4] else "unspecified", tail
    if (m := re.match(rf"^(.*?)({N})(番地|番{NOT_NAME}|号)(.*)$", text)) and not (m[3] == "番" and re.fullmatch(K + "+", m[2])):
        town, tail = m[1].strip(), m[4].strip()
        if m[3] == "番地" or aza(town):
            return (town, None, *lots(m[2], None), tail)
        return town, None, value(m[2]), None, None, None, "unspecified", tail
    if m := re.match(r"^(.*?)(\d+)(.*)$", text):
        town, tail = m[1].strip(), m[3].strip()
        return (town, None, *lots(m[2], None), tail) if aza(town) else (town, None, value(m[2]), None, None, None, "unspecified", tail)
    return text, None, None, None, None, None, "unspecified", ""


PIECES = ["一", "十", "二", "〇", "百", "1", "23", "4", "丁目", "番地", "番地の", "番", "番号", "号", "号館", "-", "-", "の", " ", "町", "丁", "館", "第", "ビル", "目", "地", "本町", "大字", "字上", "タワー", "٣"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    return ["", "　", *("".join(r.choice(PIECES) for _ in range(r.randint(1, 9))) for _ in range(6000))]


def test_numerals_beside_marks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for r in kanji_converted(df, "t", "out").collect():
        assert r["out"] == converted(r["t"]), r["t"]


def test_long_positional_numerals(spark):
    df = spark.createDataFrame([("〇〇一丁目",), ("一二三四五六七八九〇" * 3 + "番地",)], "t string")
    assert [r["out"] for r in kanji_converted(df, "t", "out").collect()] == ["1丁目", "1234567890" * 3 + "番地"]


@pytest.mark.parametrize("has_chome", [False, True])
def test_block_states(spark, texts, has_chome):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    names = ("town", "chome", "ban", "go", "banchi", "edaban", "regime", "tail")
    for r in blocks.parse_blocks(df, "t", F.lit(has_chome)).select("t", "_b.*").collect():
        assert tuple(r[n] for n in names) == stepwise(r["t"], has_chome), r["t"]


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("٣",), ("१२",), ("12",), ("十二",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.number("t")).collect()] == [3, 12, 12, 12, None, None, None]


def test_longest_prefixes_from_any_offset(spark):
    r = random.Random(2)
    keys = sorted({"".join(r.choice("abé番") for _ in range(min(r.randint(1, 9), r.randint(1, 40)))) for _ in range(60_000)} | {"番" * 30})
    assert len(keys) > 20_000
    known = set(keys)
    ladder = prefixes.bounded(prefixes.prefix_ladder(spark.createDataFrame([(k,) for k in [*keys, "", None, keys[0]]], "key string")))
    assert ladder.small and len(ladder.levels) <= 4
    rows = [("".join(r.choice("abé番x") for _ in range(r.randint(0, 40))), r.randint(-1, 12)) for _ in range(3000)] + [(None, 0), ("a", None), ("番" * 31, 1)]
    df = spark.createDataFrame(rows, "t string, at int").repartition(4)
    for row in prefixes.longest_prefix_join(df, "t", ladder, "hit", F.col("at")).collect():
        t, at = row["t"], row["at"]
        found = [t[at:e] for e in range(at + 1, len(t) + 1) if t[at:e] in known] if t is not None and at is not None and at >= 0 else []
        assert (row["hit"] and row["hit"]["key"]) == (found[-1] if found else None), (t, at)
        assert not found or row["hit"]["next"] == at + len(found[-1])


def test_prefixes_of_no_keys(spark):
    ladder = prefixes.prefix_ladder(spark.createDataFrame([], "key string"))
    assert prefixes.longest_prefix_join(spark.createDataFrame([("a",)], "t string"), "t", ladder, "hit").collect()[0]["hit"] is None
