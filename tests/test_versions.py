import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from trendloom.operators import forecast, labels
from trendloom.schemas import KEYS, PUBLICATIONS
from trendloom.sources import commits, csv_blocks, files, ingest, periods

TRICKY = 'id,name,"no\nte"\n1,plain,x\n2,"two\nlines",y\n3,"quo""ted\n\n""more""\n",\n\n4,,""\n"5","a,b","\r\nz"\n6,"ends\n",q\n7,"한글\n줄","é"'


@pytest.fixture
def cuts(spark):
    def at(n, rows=10_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

    yield at
    for name in ("files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxRecordsPerBatch"):
        spark.conf.unset(f"spark.sql.{name}")


@pytest.mark.parametrize("text", [TRICKY, TRICKY + "\n", TRICKY.replace("\n", "\r\n"), 'a\n"' + "long\n" * 40 + '"\nz\n', "a,b\n"])
def test_ranges_give_the_records_of_the_whole_file(spark, tmp_path, cuts, text):
    path = str(tmp_path / "x.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    want = sorted(map(tuple, files.read_records(spark, path).collect()), key=str)
    columns = files.header_of(spark, path)
    for n, rows in ((len(text.encode()) // 60 + 1, 10_000), (7, 1), (13, 10_000), (64, 2)):
        cuts(n, rows)
        assert sorted(map(tuple, csv_blocks.read_csv(spark, [path], columns).collect()), key=str) == want, n


def test_several_files_and_open_quotes(spark, tmp_path, cuts):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f'a,b\n{k},"x\ny"\n')
    cuts(5)
    paths = [str(tmp_path / f"{k}.csv") for k in range(3)]
    assert sorted(map(tuple, csv_blocks.read_csv(spark, paths, ["a", "b"]).collect())) == [(str(k), "x\ny") for k in range(3)]
    assert csv_blocks.records(spark, paths).where("first").count() == 3
    (tmp_path / "3.csv").write_text('a\n"open\n')
    with pytest.raises(ValueError, match="inside a quoted field"):
        csv_blocks.read_csv(spark, [str(tmp_path / "3.csv")], ["a"])


def drop(folder, rows):
    folder.mkdir()
    (folder / "product.csv").write_text("k,v\n" + "".join(f'{k},"a\nb"\n' for k in range(rows)))


def test_ingests_at_once_both_end(spark, tmp_path):
    target, failed = str(tmp_path / "out"), []
    for n in (3, 5):
        drop(tmp_path / f"in{n}", n)

    def run(n):
        try:
            assert ingest.ingest(spark, str(tmp_path / f"in{n}"), target, ["product"]) == {"product": n}
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in (3, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and commits.last(spark, target) == 2
    assert {commits.state_of(spark, target, n)["rows"]["product"] for n in (1, 2)} == {3, 5}
    assert commits.read_current(spark, target, "product").count() == commits.current(spark, target)["rows"]["product"]


def test_one_of_many_takes_a_number(spark, tmp_path):
    target, got = str(tmp_path), []
    threads = [threading.Thread(target=lambda k=k: got.append(commits.commit(spark, target, {"version": str(k)}))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 9)) and not [n for n in os.listdir(target) if n.startswith("_pointer")]
    with pytest.raises(commits.Conflict):
        commits.commit(spark, target, {"version": "late"}, expected=7)
    assert commits.commit(spark, target, {"version": "in time"}, expected=8) == 9


def test_a_killed_ingest_leaves_nothing_after_the_clean_up(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    for n in (3, 5):
        drop(tmp_path / f"in{n}", n)
    ingest.ingest(spark, str(tmp_path / "in3"), target, ["product"])

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ingest, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        ingest.ingest(spark, str(tmp_path / "in5"), target, ["product"])
    assert commits.clean_up(spark, target) == [], "what is fresh may be at work"
    assert len(commits.clean_up(spark, target, older_than_s=0)) == 1
    assert sorted(n for n in os.listdir(target) if not n.startswith(".")) == sorted(["current-0000000001.json", commits.current(spark, target)["version"]])
    assert commits.read_current(spark, target, "product").count() == 3


def counts(spark, rows):
    return spark.createDataFrame([("s", q, m, n) for q, m, n in rows], "source string, query string, period string, count int").withColumn("period", F.to_date("period"))


def test_untouched_months_keep_their_files(spark, tmp_path):
    target, keys = str(tmp_path), KEYS["publications"]

    def tree():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")}

    first = counts(spark, [("q", "2020-01-01", 1), ("r", "2020-01-01", 2), ("q", "2020-02-01", 3), ("q", "2020-04-01", 9)])
    assert periods.upsert_periods(spark, target, first, keys, "2020-03-15", PUBLICATIONS) == ["2020-01-01", "2020-02-01"]
    before = tree()
    assert periods.upsert_periods(spark, target, counts(spark, [("q", "2020-02-01", 7), ("q", "2020-03-01", 8)]), keys, "2020-03-15", PUBLICATIONS) == ["2020-02-01", "2020-03-01"]
    assert before.items() <= tree().items()
    held = commits.current(spark, target)["parts"]
    assert held["2020-01-01"] != held["2020-02-01"] == held["2020-03-01"]
    rows = lambda **k: sorted((r["query"], str(r["period"]), r["count"]) for r in periods.read_periods(spark, target, PUBLICATIONS, **k).collect())
    assert rows() == [("q", "2020-01-01", 1), ("q", "2020-02-01", 7), ("q", "2020-03-01", 8), ("r", "2020-01-01", 2)]
    assert rows(first="2020-03-01") == [("q", "2020-03-01", 8)] and rows(last_month="2019-12-01") == []
    assert len(periods.read_periods(spark, target, PUBLICATIONS, first="2020-03-01").inputFiles()) == 1
    # months after that of as_of go, without a file being written
    assert periods.upsert_periods(spark, target, counts(spark, []), keys, "2020-02-20", PUBLICATIONS) == []
    assert [r[1] for r in rows()] == ["2020-01-01", "2020-02-01", "2020-01-01"]
    assert len(commits.clean_up(spark, target, older_than_s=0)) == 0 and len(rows()) == 3


def test_upserts_at_once_lose_nothing(spark, tmp_path):
    target, keys = str(tmp_path), KEYS["publications"]
    batches = [counts(spark, [(q, "2020-01-01", n)]) for n, q in enumerate("abcd")]
    threads = [threading.Thread(target=periods.upsert_periods, args=(spark, target, b, keys, "2020-03-15", PUBLICATIONS)) for b in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r["query"] for r in periods.read_periods(spark, target, PUBLICATIONS).collect()} == set("abcd") and commits.last(spark, target) == 4


def test_sheets_are_found_by_their_tabs(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="x" r:id="b"/><sheet name="y" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
        for n, word in ((1, "second"), (7, "first")):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="inlineStr"><is><t>{word}</t></is></c></row></sheetData></worksheet>')
    assert [files.read_sheet(spark, path, k).columns for k in (0, 1)] == [["first"], ["second"]]
    with pytest.raises(ValueError, match="2 sheets"):
        files.read_sheet(spark, path, 2)


def test_grid_is_that_of_single_fits(spark):
    from tests.test_operators import SMALL
    from trendloom.plans import catalogue
    from trendloom.sources import adapters as a

    sales, visitors = a.category_sales(spark, SMALL), a.visitors(spark, SMALL)
    grid = {(r["horizon"], r["holdout"]): r for r in forecast.window_grid(sales, visitors, catalogue.CATEGORIES).where("model = 'ridge'").collect()}
    monthly = labels.settled(labels.monthly_demand(sales, visitors, catalogue.CATEGORIES))
    for (h, held), row in grid.items():
        split = labels.purged_split(labels.settled(labels.design_matrix(labels.with_target(monthly, h))), h, held)
        one = forecast.scores(split.where("part = 'test'"), {"ridge": forecast.fit(split, labels.FEATURES).predict()}).first()
        assert abs(one["mae"] - row["mae"]) < 1e-9 and one["n"] == row["n"]
    assert len(grid) == 9
    with pytest.raises(forecast.TooFewMonths):
        forecast.window_grid(sales, visitors, catalogue.CATEGORIES, holdouts=(500,))
    # sums of two sets of months add up to those of both
    windows = labels.purged_split(monthly.select("month", F.col("sales").alias("x"), F.col("sales").alias("y")), 3, 12).withColumns({"horizon": F.lit(3), "holdout": F.lit(12)})
    parts = [forecast.grams(windows.where(c), ["x"], "y").first() for c in ("month < '1997-01-01'", "month >= '1997-01-01'", "true")]
    assert abs(parts[0]["x1_2"] + parts[1]["x1_2"] - parts[2]["x1_2"]) < 1e-6 * abs(parts[2]["x1_2"])
