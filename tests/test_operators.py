import math
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions.dates import month_of_serial, period_start
from trendloom.operators import entity, evaluation, forecast, labels, ledger, matching, papers, tools
from trendloom.plans import catalogue
from trendloom.sources import adapters, commits

SMALL = "/root/testdata/sf0.001"
DAYS = "1995-01-01", "1995-12-01"


def test_dates(spark):
    df = spark.createDataFrame([("2019-01", "43466"), ("2026-12", "43496.5"), ("2020", "x")], "p string, s string")
    got = df.select(period_start(F.col("p")).alias("p"), month_of_serial(F.col("s")).alias("s")).collect()
    assert [r["p"] for r in got] == [date(2019, 1, 1), date(2026, 12, 1), date(2020, 1, 1)]
    assert [r["s"] for r in got] == [date(2019, 1, 1), date(2019, 1, 1), None]


def test_growth_variants(spark):
    rows = [("s", "q", date(1995, 1, 1), 3), ("s", "q", date(1995, 2, 1), 4), ("s", "q", date(2000, 7, 1), 9), ("s", "zero", date(1995, 1, 1), 0), ("s", "zero", date(2000, 7, 1), 5), ("s", "late", date(2000, 7, 1), 5)]
    counts = spark.createDataFrame(rows, schemas.PUBLICATIONS)
    plain = {r["query"]: r for r in papers.growth(counts, ["query"], DAYS, ("2000-07-01", "2001-06-01")).collect()}
    assert math.isclose(plain["q"]["growth"], 9 / 3.5) and plain["zero"]["growth"] == 0 and plain["late"]["growth"] is None
    rounded = {r["query"]: r for r in papers.growth(counts, ["query"], DAYS, ("2000-07-01", "2001-06-01"), 1).collect()}
    assert rounded["q"]["growth"] == 2.57 and rounded["zero"]["growth"] is None


def test_ratio_usable(spark):
    df = spark.createDataFrame([(881.4,), (0.2,), (2.2,), (7.9,), (None,)], "b double")
    assert [r[0] for r in df.select(papers.ratio_usable(F.col("b"))).collect()] == [True, False, False, True, False]


def test_upsert_replaces_and_drops_the_future(spark):
    old = spark.createDataFrame([("s", "q", date(2020, 1, 1), 1), ("s", "q", date(2020, 9, 1), 1)], schemas.PUBLICATIONS)
    new = spark.createDataFrame([("s", "q", date(2020, 1, 1), 2), ("s", "q", date(2020, 3, 1), 3), ("s", "q", date(2020, 4, 1), 3)], schemas.PUBLICATIONS)
    got = papers.upsert(old, new, schemas.KEYS["publications"], F.lit("2020-03-20").cast("date")).orderBy("period").collect()
    assert [(r["period"].month, r["count"]) for r in got] == [(1, 2), (3, 3)]
    again = papers.insert_new(old, new, schemas.KEYS["publications"])
    assert again.count() == 4 and again.where("period = '2020-01-01'").first()["count"] == 1


def test_labels_against_numpy(spark):
    got = catalogue.demand_labels(spark, SMALL).orderBy("month").toPandas()
    assert labels.missing_months(catalogue.demand_labels(spark, SMALL)) == 0
    yoy = got["sales"].pct_change(12)
    np.testing.assert_allclose(got["yoy"].astype(float), yoy, rtol=1e-9)
    np.testing.assert_allclose(got["target_yoy_fwd"].astype(float), yoy.shift(-3), rtol=1e-9)
    assert got["target_yoy_fwd"].tail(3).isna().all()


def test_split_is_purged(spark):
    part = {r["month"]: r["part"] for r in catalogue.purged_split(spark, SMALL).collect()}
    test_from = min(m for m, p in part.items() if p == "test")
    reach = max(m for m, p in part.items() if p == "train")
    assert (test_from.year - reach.year) * 12 + test_from.month - reach.month > 3
    assert sum(p == "test" for p in part.values()) == 12 and sum(p == "purged" for p in part.values()) == 3


def test_ridge_against_numpy(spark):
    split = labels.purged_split(catalogue.design_matrix(spark, SMALL), 3, 12)
    model = forecast.fit(split, labels.FEATURES)
    train = split.where("part = 'train'").toPandas()
    x, y = train[labels.FEATURES].to_numpy(float), train["target_yoy_fwd"].to_numpy(float)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    want = np.linalg.solve(z.T @ z + np.diag([0] + [1.0] * x.shape[1]), z.T @ y)
    np.testing.assert_allclose(model.weights, want, rtol=1e-8)
    with pytest.raises(ValueError):
        forecast.evaluate(catalogue.design_matrix(spark, SMALL), 6, 70)


def test_gram_counts(spark):
    df = spark.createDataFrame([("a abcd",)], "norm string")
    got = {r["gram"]: r["tf"] for r in matching.grams(df).collect()}
    assert got == {" a": 2, "a ": 1, " a ": 1, "ab": 1, "bc": 1, "cd": 1, "d ": 1, " ab": 1, "abc": 1, "bcd": 1, "cd ": 1, " abc": 1, "abcd": 1, "bcd ": 1}


def test_candidates_against_all_pairs(spark):
    rows = [("s1", "1", "려 루트젠 샴푸 200ml", "려"), ("s2", "2", "루트젠 샴푸 200ml", "려"), ("s2", "3", "루트젠 토너 100ml", "려"), ("s1", "4", "zzz", "x"), ("s2", "5", "zzz", ""), ("s3", "6", "루트젠 샴푸", "려")]
    products = spark.createDataFrame([(*r, None) for r in rows], "source string, product_key string, name string, brand string, volume string")
    f = matching.features(products, strip_brand=True)
    got = {(r["key_a"], r["key_b"]): r for r in matching.candidates(f).collect()}
    assert got["1", "2"]["score"] == 1.45 and got["1", "6"]["score"] == 1.3 and ("1", "3") not in got
    assert all("4" not in k and "5" not in k for k in got)


def test_agreements(spark):
    v = "named_struct('amount', {}D, 'unit', '{}')".format
    one = lambda a, b: spark.range(1).select(matching.volume_agreement(F.expr(a), F.expr(b))).first()[0]
    none = "cast(null as struct<amount:double,unit:string>)"
    assert [one(v(30, "ml"), v(30, "ml")), one(v(30, "ml"), v(31, "ml")), one(v(30, "ml"), v(30, "g")), one(none, v(1, "g"))] == [1, -1, 0, 0]


def test_evaluation_bands(spark):
    rows = list(zip([1.30, 1.10, 0.95, 0.85, 0.70, 0.65, 0.50, 0.47], ["y", "y", "y", "n", "y", "n", "n", ""], strict=True))
    sample = spark.createDataFrame(rows, "score double, is_same_product string")
    answered = evaluation.labelled(sample)
    assert answered.count() == 7
    bands = {r["low"]: r for r in evaluation.by_band(answered).collect()}
    assert bands[1.2]["n"] == 1 and bands[0.8]["n_correct"] == 1 and bands[0.8]["precision"] == 0.5
    cum = {r["threshold"]: r for r in evaluation.cumulative(answered).collect()}
    assert cum[0.45]["n"] == 7 and cum[1.0]["n_correct"] == 2
    low, high = spark.range(1).select(*evaluation.wilson(F.lit(2), F.lit(2))).first()
    assert 0 < low < 1 and high == 1
    assert spark.range(1).select(*evaluation.wilson(F.lit(0), F.lit(0))).first()[0] is None
    assert evaluation.suggested_threshold(evaluation.cumulative(answered), 0.99).first()["threshold"] == 1.0


def test_entities(spark, tmp_path):
    products = adapters.products(spark, SMALL)
    entity.rebuild_entities(products, str(tmp_path))
    sku, listing, variant = (commits.read_current(spark, str(tmp_path), n) for n in ("sku", "listing", "listing_variant"))
    assert sku.count() + listing.count() == products.count()
    assert schemas.repeated_keys(variant, schemas.KEYS["listing_variant"]).count() == 0
    assert schemas.orphans(variant, listing, {"source": "source", "product_key": "product_key"}).count() == 0
    assert commits.read_current(spark, str(tmp_path), "product_line").count() == 0


def test_tools_say_where_rows_come_from(spark):
    counts, ranks = adapters.publications(spark, SMALL), adapters.rank_snapshots(spark, SMALL)
    for result in (tools.paper_trend(counts, "1-URGENT", "O", 99), tools.top_products(ranks, "O", limit=99), tools.top_products(ranks, "O", "?")):
        assert result.df.count() <= tools.MAX_ROWS and result.table and result.caveat
        assert '"caveat"' in result.envelope()
    assert "mixed" in tools.top_products(ranks, "O").caveat


def test_ledger(tmp_path):
    assert [ledger.cost_of(**{k: 1_000_000}) for k in ledger.PRICES] == [Decimal("3"), Decimal("15"), Decimal("0.3"), Decimal("3.75")]
    book = ledger.Ledger(str(tmp_path / "l.db"), Decimal("0.20"))
    row = book.reserve("x")
    with pytest.raises(ledger.BudgetExceeded):
        book.reserve("y")
    book.settle(row, input=1000)
    assert book.spent() == Decimal("0.003")
    book.reserve("z")


def test_growth_goes_by_calendar_months(spark):
    rows = [(f"2020-{m:02d}-01", 100 + m) for m in range(1, 13) if m != 5] + [(f"2021-{m:02d}-01", 200 + m) for m in range(1, 7)]
    counts = spark.createDataFrame(rows, "month string, count int").selectExpr("cast(month as date) month", "count")
    got = {str(r["month"]): r["papers_yoy"] for r in labels.papers_yoy(counts).collect()}
    assert got["2021-05-01"] is None and abs(got["2021-06-01"] - (206 / 106 - 1)) < 1e-12 and got["2020-12-01"] is None
