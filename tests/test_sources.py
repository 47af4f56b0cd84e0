import zipfile

import pytest
from pyspark.sql import functions as F

from trendloom.operators import labels
from trendloom.plans import catalogue
from trendloom.sources import commits, files, ingest
from trendloom.streaming.snapshots import follow_counts


def test_records_with_line_breaks(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n1,"두 줄\n짜리 ""본문"""\n2,평범\n', encoding="utf-8")
    assert files.count_records(spark, str(p)) == 2 and files.header_of(spark, str(p)) == ["a", "b"]


def test_counts_file(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("period,count\n2019-01,5\n2020,7\n")
    got = files.read_counts(spark, str(p), "s", "q").collect()
    assert [(str(r["period"]), r["count"]) for r in got] == [("2019-01-01", 5), ("2020-01-01", 7)]
    p.write_text("month,n\n2019-01,5\n")
    with pytest.raises(ValueError):
        files.read_counts(spark, str(p), "s", "q")


def test_label_file(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("score,name\n1,a\n")
    with pytest.raises(ValueError):
        files.read_label_sample(spark, str(p))


def test_export_round_trip(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = catalogue.paper_growth(spark, "/root/testdata/sf0.001")
    assert files.export_with_comment(df, path, "growth\nby source") == files.read_export(spark, path).count()
    with pytest.raises(ValueError):
        files.export_with_comment(df.where("false"), path, "x")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>43466</v></c><c r="B2"><v>7.5</v></c></row><row><c r="A3"><v>43497</v></c><c r="B3" t="inlineStr"><is><t>-</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>month</t></si><si><t>beauty</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = labels.unpivoted({"resident": files.read_sheet(spark, path, 0)}).collect()
    assert [(str(r["month"]), r["segment"], r["category"], r["value"]) for r in got] == [("2019-01-01", "resident", "beauty", 7.5)]


def test_ingest_is_all_or_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "product.csv").write_text('k,v\n1,"a\nb"\n2,c\n')
    (source / "FREEZE.txt").write_text("2026-08-22T02:42Z\n")
    with pytest.raises(ValueError):
        ingest.ingest(spark, str(source), target, ["product", "review"])
    assert ingest.ingest(spark, str(source), target, ["product"]) == {"product": 2}
    rows = commits.read_current(spark, target, "product")
    assert rows.count() == 2 and rows.first()["frozen_at"] == "2026-08-22T02:42Z"
    (source / "product.csv").write_text("k,v\n1,a\n")
    ingest.ingest(spark, str(source), target, ["product"])
    assert commits.read_current(spark, target, "product").count() == 1


def test_stream_of_counts(spark, tmp_path):
    drops, table = tmp_path / "drops", str(tmp_path / "table")
    drops.mkdir()
    (drops / "1.csv").write_text("source,query,period,count\ns,q,2020-01-01,1\ns,q,2020-02-01,1\n")
    follow_counts(spark, str(drops), table, str(tmp_path / "cp"), "2020-06-01").awaitTermination()
    (drops / "2.csv").write_text("source,query,period,count\ns,q,2020-02-01,5\ns,q,2020-09-01,5\n")
    follow_counts(spark, str(drops), table, str(tmp_path / "cp"), "2020-06-01").awaitTermination()
    got = spark.read.parquet(f"{table}/1").orderBy("period").select(F.col("count")).collect()
    assert [r["count"] for r in got] == [1, 5]


def workbook(path, *sheets):
    """A workbook of sheets whose cells are text, or numbers where they are not strings."""

    def cell(v):
        return "<c/>" if v is None else f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"

    def at(row, k):
        return row.replace("<c", f'<c r="{"ABCDEF"[k]}1"', 1)

    with zipfile.ZipFile(path, "w") as z:
        for n, rows in enumerate(sheets, 1):
            body = "".join(f"<row>{''.join(at(cell(v), k) for k, v in enumerate(r))}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_category_workbook(spark, tmp_path):
    path = str(tmp_path / "c.xlsx")
    workbook(path, [["day", "beauty", "food"], [43466, 1.5, "-"], [None, 9, 9]], [["day", "beauty"], [43497, 2]], [["note"]])
    got = files.read_category_monthly(spark, path, ["resident", "foreign"]).collect()
    assert sorted((str(r["month"]), r["segment"], r["category"], r["value"]) for r in got) == [("2019-01-01", "resident", "beauty", 1.5), ("2019-02-01", "foreign", "beauty", 2.0)]
    with pytest.raises(ValueError):
        files.read_category_monthly(spark, path, ["a", "b", "c", "d"])


def test_totals_workbook(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    # the visitors stand in another order, and a month lacks them
    workbook(path, [["m", "x", "x"], [43466, 10, 20], ["2019-02-01", 11, None], [43525, 12, 22]], [["m", "x", "x"], [43525, 3, 4], [43466, 1, 2]])
    got = files.read_totals_monthly(spark, path, ["resident", "foreign"]).collect()
    assert sorted((str(r["month"]), r["segment"], r["sales_musd"], r["visitors_k"]) for r in got) == [
        ("2019-01-01", "foreign", 20.0, 2.0), ("2019-01-01", "resident", 10.0, 1.0), ("2019-02-01", "resident", 11.0, None), ("2019-03-01", "foreign", 22.0, 4.0), ("2019-03-01", "resident", 12.0, 3.0)]


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    first = spark.createDataFrame([(43466.0, 1.5, "a<b & 'c'"), (43497.0, None, "  두 칸 ")], "day double, v double, text string")
    wide = spark.createDataFrame([tuple(range(30))], ", ".join(f"c{k} int" for k in range(30)))
    files.write_workbook(spark, path, {"one": first, "wide & more": wide})
    assert sorted(map(tuple, files.read_sheet(spark, path, 0).collect())) == [("43466.0", "1.5", "a<b & 'c'"), ("43497.0", None, "  두 칸 ")]
    assert tuple(files.read_sheet(spark, path, 1).first()) == tuple(map(str, range(30)))
    with pytest.raises(ValueError, match="more than 1 rows"):
        files.write_workbook(spark, path, {"one": first}, most=1)
