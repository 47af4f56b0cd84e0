"""What is counted from names against the same from all pairs of rows: with rows and keys that repeat, and arrays of few members."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions.text import row_kind
from trendloom.operators import entity, evaluation, matching
from trendloom.sources.store import computed_once

SCHEMA = "source string, product_key string, name string, brand string, volume string"
PAIR = matching.PAIR


def repeated(spark, seed=3, n=220):
    rng = random.Random(seed)
    words = ["red", "hot", "widget", "bolt", "sun", "serum"]
    rows = []
    for k in range(n):
        name = f"{rng.choice(words)} {rng.choice(words)} {rng.choice(['5ml', '5ml', '7ml', ''])}{rng.choice(['', ' 3 colors', ' (a/b/c)', ''])}"
        rows.append((f"s{rng.randrange(3)}", str(k % (n - 40)), name, rng.choice(["acme", "acme", "other", ""]), rng.choice([None, "5ml"])))
    return spark.createDataFrame(rows + rows[:3], SCHEMA)


@pytest.fixture(scope="module")
def found(spark):
    before, matching.MEMBERS = matching.MEMBERS, 2
    try:
        whole = matching.matches(matching.features(repeated(spark)))
        sure = whole._replace(pairs=whole.pairs.where("score >= 1"))
        yield whole, sure, computed_once(matching.all_pairs(whole))
    finally:
        matching.MEMBERS = before


def same(got, want):
    a, b = (sorted(map(tuple, x.select(*sorted(want.columns)).collect()), key=repr) for x in (got, want))
    assert a == b and a


def test_rows_of_one_name_are_parsed_once_and_spread(spark):
    many = spark.range(0, 5000, 1, 1).select(F.lit("s1").alias("source"), F.col("id").cast("string").alias("product_key"), F.concat(F.lit("red ring "), F.col("id") % 64, F.lit("ml")).alias("name"), F.lit("acme").alias("brand"), F.lit(None).cast("string").alias("volume"))
    got = matching.features(many)
    assert got.count() == 5000 and got.select("norm").distinct().count() == 1
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_odd_names_keep_their_rows(spark):
    rows = [("s1", "1", None, "b", None), ("s1", "2", "red ring 99999999999999999999ml", "b", None), ("s2", "3", "red ring 99999999999999999999ml", "b", None), ("s2", None, "red ring", None, "5ml")]
    f = computed_once(matching.features(spark.createDataFrame(rows, SCHEMA)))
    assert f.count() == 3
    assert [tuple(r) for r in matching.candidates(f).select(*PAIR, "volume_agreement").collect()] == [("s1", "2", "s2", "3", 1.0)]


def test_hub_summary(found):
    _, sure, pairs = found
    same(matching.hub_summary_of(sure), matching.hub_summary(pairs.where("score >= 1")))


def test_label_sample(found):
    whole, _, pairs = found
    want = pairs.withColumn("band", matching.score_band(F.col("score")))
    draw = F.md5(F.concat_ws("|", *PAIR))
    for size in (1, 60, 100_000):
        each = max(1, size // want.select("band").distinct().count())
        # of rows that repeat a key, any may be drawn: only the draws are compared
        best = want.withColumn("draw", draw).withColumn("n", F.row_number().over(Window.partitionBy("band").orderBy("draw"))).where(F.col("n") <= each)
        same(matching.label_sample(whole, size).select("score", draw.alias("draw")), best.select("score", "draw"))


def test_label_sample_draws_again(found, monkeypatch):
    """A limit that leaves too few rows is raised."""
    whole, _, pairs = found
    want = matching.label_sample(whole, 120).select(*PAIR).distinct()
    monkeypatch.setattr(matching, "DRAWN", 1 / 16)
    monkeypatch.setattr(matching, "FEWEST", 1)
    same(matching.label_sample(whole, 120).select(*PAIR).distinct(), want)


def test_listing_contains(found):
    _, sure, pairs = found
    rows = sure.rows.withColumn("kind", row_kind(F.col("name")))
    got = entity.contained(matching.met(sure.pairs, rows, {"key": "product_key", "kind": "kind"}))
    same(got, entity.containment(pairs.where("score >= 1").withColumn("is_same_product", F.lit("y"))))


def test_conflicts(found):
    whole, _, pairs = found
    same(matching.conflicts(whole), pairs.groupBy("source_a", "key_a", "source_b").agg(F.count("*").alias("n")).where("n > 1"))


def test_pair_types(found):
    whole, _, pairs = found
    kinds = lambda a, b: matching.pair_type(a, b).alias("pair_type")
    correct = (F.col("score") >= 1).alias("correct")
    counts = matching.counted(whole, {"kind": row_kind(F.col("name"))}).select(kinds(F.col("kind_a"), F.col("kind_b")), "score", correct, F.col("n").alias("n_pairs"))
    rows = pairs.select(kinds(row_kind(F.col("name_a")), row_kind(F.col("name_b"))), "score", correct)
    same(evaluation.cumulative(counts, ["pair_type"], "n_pairs"), evaluation.cumulative(rows, ["pair_type"]))


def test_source_pairs(found):
    whole, _, pairs = found
    same(matching.source_pairs(whole), pairs.groupBy("source_a", "source_b").agg(F.count("*").alias("n")))


def test_best_pairs(found):
    """Ties at the last place, and budgets beyond all pairs."""
    whole, _, pairs = found
    for score in ("score", "name_score"):
        for budget in (1, 37, 500, 100_000):
            same(matching.best_pairs(whole, score, budget), pairs.orderBy(F.desc(score), *PAIR).limit(budget).select(*PAIR))
    assert matching.best_pairs(whole._replace(pairs=whole.pairs.limit(0)), "score", 5).count() == 0


def test_score_histogram(found):
    whole, _, pairs = found
    got = {r["floor"]: r["n"] for r in matching.score_histogram(whole, (0.9, 0.5, 9.0)).collect()}
    assert got == {f: pairs.where(F.col("score") >= f).count() for f in got} and got[0.5] > got[0.9] > got[9.0] == 0
