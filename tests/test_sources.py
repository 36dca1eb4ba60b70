import os
import zipfile

import pytest
from conftest import rows_of

from kindred.errors import CleaningError, EmptyDataError, InvalidConfigError, UnsupportedFormatError
from kindred.operators.exact import dedup_exact
from kindred.sources.tables import list_sheets, read_csv, read_numbered, read_table, write_result, write_table
from kindred.sources.workbook import workbook_catalog

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i):
    return chr(ord("A") + i)


def cell(i, row, value):
    ref = f'r="{letters(i)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {ref} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):  # a date, as days since the epoch of the format
        return f'<c {ref} s="1"><v>{value[0]}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {ref}><v>{value}</v></c>"
    if value.startswith("shared:"):
        return f'<c {ref} t="s"><v>{value[7:]}</v></c>'
    return f'<c {ref} t="inlineStr"><is><t>{value}</t></is></c>'


def workbook(path, sheets, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        items = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{items}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "book.xlsx"
    workbook(
        path,
        {
            "First": [["name", "n", "share", "ok", "day", "code", "none"],
                      ["shared:0", 1, 0.5, True, (45000,), "007", None],
                      ["NA", None, 2, False, (45001,), "8", None]],
            "Second": [["x"], [99]],
        },
        shared=["Zoe & Co".replace("&", "&amp;")],
    )
    return str(path)


def test_first_sheet_by_default(spark, book):
    df = read_table(spark, book)
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "share": "double", "ok": "boolean",
                               "day": "timestamp", "code": "string", "none": "double"}
    got = df.selectExpr("name", "n", "share", "ok", "date_format(day, 'yyyy-MM-dd')", "code", "none")
    assert [tuple(r) for r in got.collect()] == [
        ("Zoe & Co", 1, 0.5, True, "2023-03-15", "007", None),
        (None, None, 2.0, False, "2023-03-16", "8", None),
    ]


def test_named_sheet_and_catalog(spark, book):
    assert read_table(spark, book, sheet="Second").collect() == [(99,)]
    assert list_sheets(spark, book) == ["First", "Second"]
    assert rows_of(workbook_catalog(spark, book), "sheet_index", "sheet_name") == [(0, "First"), (1, "Second")]
    with pytest.raises(CleaningError, match="not found"):
        read_table(spark, book, sheet="Third")


def test_folder_of_workbooks_is_one_table(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"S": [["k", "v"], ["a", 1]]})
    workbook(tmp_path / "b.xlsx", {"S": [["k", "v"], ["b", 2], [None, None], ["c", 3]]})
    got = read_table(spark, str(tmp_path) + "/*.xlsx")
    assert rows_of(got) == [("a", 1), ("b", 2), ("c", 3)]
    workbook(tmp_path / "c.xlsx", {"S": [["other"], [1]]})
    with pytest.raises(CleaningError, match="header"):
        read_table(spark, str(tmp_path) + "/*.xlsx")


def test_workbook_without_rows(spark, tmp_path):
    workbook(tmp_path / "e.xlsx", {"S": [["k"]]})
    with pytest.raises(EmptyDataError):
        read_table(spark, str(tmp_path / "e.xlsx"))


def csv(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_missing_values(spark, tmp_path):
    text = "name,n,share,ok,code,gone\nZoe,1,1.5,True,1a,NA\n\"a \"\"b\"\", c\",NA,-2e1,False,n/a,\nNULL,+3,.5,true,2b,nan\n"
    df = read_table(spark, csv(tmp_path, text))
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "share": "double", "ok": "boolean",
                               "code": "string", "gone": "double"}
    assert rows_of(df) == sorted([
        ("Zoe", 1, 1.5, True, "1a", None), ('a "b", c', None, -20.0, False, None, None),
        (None, 3, 0.5, True, "2b", None)], key=str)


def test_csv_repeated_and_blank_headers(spark, tmp_path):
    df = read_table(spark, csv(tmp_path, "a,a,,a.1\n1,2,3,4\n"))
    assert len(set(df.columns)) == 4 and df.columns[:2] == ["a", "a.1"]
    assert dedup_exact(df, ["a.1"]).clean.count() == 1


def test_csv_without_rows(spark, tmp_path):
    with pytest.raises(EmptyDataError):
        read_table(spark, csv(tmp_path, "name,email\n"))
    with pytest.raises(EmptyDataError):
        read_table(spark, csv(tmp_path, "", "zero.csv"))


def test_csv_line_breaks_need_multi_line(spark, tmp_path):
    path = csv(tmp_path, 'a,b\n1,"x\ny"\n2,z\n')
    assert rows_of(read_csv(spark, path, multi_line=True)) == [(1, "x\ny"), (2, "z")]


def test_unknown_formats(spark, tmp_path):
    with pytest.raises(UnsupportedFormatError):
        read_table(spark, csv(tmp_path, "x", "in.txt"))
    with pytest.raises(UnsupportedFormatError):
        write_table(spark.range(1), str(tmp_path / "out.txt"))
    assert list_sheets(spark, "in.csv") == []


@pytest.mark.parametrize("ext", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, ext):
    df = spark.createDataFrame([(0, "Zoe", 1), (1, 'q "x" \\', 2)], "_row_id long, name string, n long")
    path = write_table(df, str(tmp_path / f"out.{ext}"), single_file=True)
    back = read_table(spark, path)
    assert back.columns == ["name", "n"]
    assert rows_of(back) == rows_of(df, "name", "n")


def test_result_and_audit_side_by_side(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    out = dedup_exact(df, ["k"])
    clean, audit = write_result(out.clean, out.audit, str(tmp_path / "run"), "csv")
    assert read_table(spark, clean).collect() == [("a",)]
    assert read_table(spark, audit).first().removed_indices == 1


def test_other_columnar_formats(spark, tmp_path):
    spark.range(3).write.orc(str(tmp_path / "t.orc"))
    assert read_table(spark, str(tmp_path / "t.orc")).count() == 3
    spark.range(0).write.parquet(str(tmp_path / "e.parquet"))
    with pytest.raises(EmptyDataError):
        read_table(spark, str(tmp_path / "e.parquet"))


def test_files_with_another_header_order_are_no_other_data(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("name,email\nx,x@e\n")
    (folder / "b.csv").write_text("email,name\ny@e,y\n")
    with pytest.raises(CleaningError, match="different headers"):
        read_csv(spark, str(folder))
    (folder / "b.csv").write_text("name,email\ny,y@e\n")
    assert rows_of(read_csv(spark, str(folder)), "name", "email") == [("x", "x@e"), ("y", "y@e")]


def test_blank_and_repeated_headers_must_be_the_same_in_all_files(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('name,,name\nx,1,y\n')
    for other in (",name,name\n1,x,y\n", "name,,other\nx,1,y\n", "name,,name,more\nx,1,y,z\n", "name,\nx,1\n"):
        (folder / "b.csv").write_text(other)
        with pytest.raises(CleaningError, match="different headers"):
            read_csv(spark, str(folder))
    (folder / "b.csv").write_text('"name",,name\nv,2,w\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(folder)).collect()) == [("v", 2, "w"), ("x", 1, "y")]


def test_numbers_from_file_positions(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = spark.range(5_000).selectExpr("id", "concat('t', id) as _file", "id % 3 as `a.b`")
    rows.repartition(7, "`a.b`").write.option("parquet.block.size", 4096).parquet(path)
    one = read_numbered(spark, path)
    assert one.columns == ["id", "_file", "a.b", "_row_id"]
    first = dict(one.select("_row_id", "id").collect())
    assert sorted(first) == list(range(5_000)) and len(set(first.values())) == 5_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert dict(read_numbered(spark, path).select("_row_id", "id").collect()) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan
    assert plan.count("FileScan") == 1 and plan.count("BroadcastHashJoin") == 1
    taken = str(tmp_path / "i.parquet")
    spark.range(2).selectExpr("id as _row_id").write.parquet(taken)
    with pytest.raises(InvalidConfigError):
        read_numbered(spark, taken)
    empty = str(tmp_path / "none.parquet")
    spark.range(0).write.parquet(empty)
    assert read_numbered(spark, empty).collect() == []


def test_a_failed_result_leaves_nothing_to_read(spark, tmp_path):
    good = spark.range(3).selectExpr("id", "id as v")
    bad = spark.range(3).selectExpr("raise_error('broken') as v")
    base = str(tmp_path / "run")
    for clean, audit in ((good, bad), (bad, good)):
        with pytest.raises(Exception, match="broken"):
            write_result(clean, audit, base)
        assert os.listdir(base) == []
    write_result(good, good, base)
    assert sorted(f for f in os.listdir(base) if not f.startswith(".")) == ["audit.parquet", "clean.parquet"]
    with pytest.raises(CleaningError, match="already"):
        write_result(good, good, base)
    assert read_table(spark, f"{base}/clean.parquet").count() == 3


def test_given_schema_takes_one_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day,v\n7,2024-02-29,NA\n8,,1.5\n")
    out = read_csv(spark, str(tmp_path / "a.csv"), schema="id long, day date, v double")
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "date", "double"]
    assert [(r.id, str(r.day), r.v) for r in out.orderBy("id").collect()] == [(7, "2024-02-29", None), (8, "None", 1.5)]
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "a.csv"), schema="id date, day date, v double").collect()
