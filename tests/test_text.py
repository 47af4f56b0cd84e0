import pytest
from pyspark.sql import functions as F

from trendloom.functions import text


def apply(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_normalised_name(spark):
    names = ["[1+1] 라운드랩 독도 토너 200ml 기획", "토너 (본품+리필) 10매 A-B", None, "  X  ", "【한정】Cream 50mL기획"]
    assert apply(spark, text.normalised_name, names) == ["라운드랩 독도 토너", "토너 a b", "", "x", "cream"]


def test_volume(spark):
    names = ["세럼 30ml", "마스크 10매 5개", "크림 50ml기획", "12.5 G 밤", None, "세럼 ３０ml", "no volume"]
    got = [(v["amount"], v["unit"]) if v else None for v in apply(spark, text.volume, names)]
    assert got == [(30.0, "ml"), (10.0, "매"), None, (12.5, "g"), None, (30.0, "ml"), None]


def test_form(spark):
    assert apply(spark, text.product_form, ["수분 선크림", "히알루론산 세럼", "클렌징 오일", "토너 패드", "Sun stick", None, "x"]) == ["sun", "serum", "cleanser", "toner", "sun", "", ""]


def test_without_brand(spark):
    rows = [("려 루트젠 샴푸", "려", "루트젠 샴푸"), ("온 그리 디언츠 크림", "온그리디언츠", "크림"), ("려", "려", "려"), ("루트젠 려", "려", "루트젠 려"), ("a b", None, "a b"), (None, "x", None), ("ab c", "a", "ab c")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n string, b string, want string")
    for r in df.withColumn("got", text.without_brand(F.col("n"), F.col("b"))).collect():
        assert r["got"] == r["want"], r


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("바이오힐보 콜라겐 선크림 2종 (에센스/톤업)", []),
        ("아비브 스티커 (어성초/수분초/마데카소사이드/콜라겐밀크/비타)", ["어성초", "수분초", "마데카소사이드", "콜라겐밀크", "비타"]),
        ("팩 (블레미쉬(광채), 가지(보습), 티트리(진정)", ["블레미쉬(광채", "가지(보습", "티트리(진정"]),
        ("no brackets", []),
        (None, []),
    ],
)
def test_variants(spark, name, want):
    got = apply(spark, text.variants, [name])[0]
    assert got == want


def test_row_kind(spark):
    names = ["틴트 7종 택1", "립 12 colors", "쿠션 3호", "기획 / 단품 세럼", "패드 (a/b/c)", "토너 200ml", "세럼 (a/b)", None, "크림 기획"]
    assert apply(spark, text.row_kind, names) == ["listing"] * 5 + ["sku"] * 4


def test_label_answer(spark):
    assert apply(spark, text.label_answer, ["y", " YES ", "ㅇ", "n", "X", "ㄴ", "", None, "maybe"]) == [True, True, True, False, False, False, None, None, None]


def test_like_escapes(spark):
    df = spark.createDataFrame([("50% off",), ("50 off",), ("a_b",), ("acb",)], "v string")
    assert df.where(F.col("v").ilike(text.escaped_like("50%"))).count() == 1
    assert df.where(F.col("v").ilike(text.escaped_like("A_b"))).count() == 1
