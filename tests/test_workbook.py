"""Workbooks: ranges of rows, columns, odd sheets."""

import zipfile

import pytest

from chomeflow.sources.workbook import _NS, scan_workbook, write_workbooks


def _book(path, sheet, strings=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        if strings is not None:
            book.writestr("xl/sharedStrings.xml", strings)
    return str(path)


def test_tables_come_back_by_ranges_and_columns(spark, tmp_path):
    rows = [(i, f'<a&"{i % 7}"> \n区', None if i % 3 else f" {i} ") for i in range(5003)]
    df = spark.createDataFrame(rows, "i int, s string, t string").repartition(3)
    assert write_workbooks(df, f"{tmp_path}/books", rows_per_file=900) == 5003
    got = scan_workbook(spark, f"{tmp_path}/books", [1], "C string, row int, A string, B string, file string, sheet int", rows_per_partition=128)
    assert got.rdd.getNumPartitions() > 35
    back = got.collect()
    assert sorted((int(r["A"]), r["B"], r["C"]) for r in back) == rows and {r["sheet"] for r in back} == {1}
    by_file = {}
    for r in back:
        by_file.setdefault(r["file"], []).append(r["row"])
    assert len(by_file) >= 6 and all(sorted(v) == list(range(len(v))) for v in by_file.values())
    assert sorted(r[0] for r in scan_workbook(spark, f"{tmp_path}/books", [1], "A string").collect()) == sorted(str(i) for i in range(5003))


def test_a_wrong_size_loses_no_row(spark, tmp_path):
    rows = "".join(f'<x:row r="{i}" y:dy="0.2"><x:c r="A{i}"><x:v>{i}</x:v></x:c><x:c r="B{i}"/></x:row>' for i in range(1, 41))
    sheet = f'<x:worksheet xmlns:x="{_NS}" xmlns:y="urn:y">{{}}<x:sheetData>{rows}</x:sheetData><x:rowBreaks count="1"/></x:worksheet>'
    for size in ('<x:dimension ref="A1:B25"/>', '<x:dimension ref="A1:B400"/>', '<x:dimension ref="A1"/>', ""):
        at = _book(tmp_path / "odd.xlsx", sheet.format(size))
        got = scan_workbook(spark, at, [1], "row int, A string, B string", rows_per_partition=10).collect()
        assert sorted(map(tuple, got)) == [(i - 1, str(i), None) for i in range(1, 41)], size


def test_rows_longer_than_a_block(spark, tmp_path):
    from chomeflow.sources import workbook

    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{"7" * 100_000}{i}</v></c></row>' for i in range(1, 31))
    at = _book(tmp_path / "long.xlsx", f'<worksheet xmlns="{_NS}"><dimension ref="A1:A30"/><sheetData>{rows}</sheetData></worksheet>')
    got = scan_workbook(spark, at, [1], "row int, A string", rows_per_partition=4).collect()
    assert workbook.BLOCK > 100_000 and sorted((r["row"], r["A"][100_000:]) for r in got) == [(i - 1, str(i)) for i in range(1, 31)]


def test_empty_and_missing_sheets(spark, tmp_path):
    at = _book(tmp_path / "none.xlsx", f'<worksheet xmlns="{_NS}"><sheetData/></worksheet>')
    assert scan_workbook(spark, at, [1]).count() == 0
    with pytest.raises(Exception, match="sheet2"):
        scan_workbook(spark, at, [2]).count()
    assert write_workbooks(spark.createDataFrame([], "a int"), f"{tmp_path}/nothing") == 0
