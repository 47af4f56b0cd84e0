import random

from pyspark.sql import functions as F

from trendloom.operators import cosine_join, matching
from trendloom.sources.store import computed_once, sized_join

SCHEMA = "source string, product_key string, name string, brand string, volume string"


def products(spark, seed=5, n=160):
    """Names of few words and brands, with volumes (some a hair apart), forms and repeats."""
    rng = random.Random(seed)
    words = ["루트젠", "샴푸", "독도", "토너", "cream", "glow", "sun", "serum", "앰플", "vita", "shine"]
    volumes = ["200ml", "200.0000004ml", "200.0000018ml", "50g", "50ml", "1.2345678g", "1.2345677g", ""]
    rows = []
    for k in range(n):
        name = " ".join(rng.choice(words) + rng.choice(["", "", "x", "y1"]) for _ in range(rng.randint(1, 4)))
        rows.append((f"s{rng.randrange(3)}", str(k), f"{name} {rng.choice(volumes)}", rng.choice(["려", "려", "acme", ""]), None))
    return spark.createDataFrame(rows + [(*rows[0][:1], "again", *rows[0][2:])], SCHEMA)


def all_pairs(rows, weights, least):
    vectors = {}
    for r in weights:
        vectors.setdefault(r["norm"], {})[r["gram"]] = r["weight"]
    out = {}
    for a in rows:
        for b in rows:
            if a["brand_norm"] and a["brand_norm"] == b["brand_norm"] and a["source"] < b["source"]:
                x, y = vectors[a["norm"]], vectors[b["norm"]]
                cos = 1.0 if a["norm"] == b["norm"] else sum(w * y.get(g, 0.0) for g, w in x.items())
                same_unit = a["vol"] and b["vol"] and a["vol"]["unit"] == b["vol"]["unit"]
                vol = (1 if abs(a["vol"]["amount"] - b["vol"]["amount"]) < 1e-6 else -1) if same_unit else 0
                form = 0 if "" in (a["form"], b["form"]) else 1 if a["form"] == b["form"] else -1
                if cos + 0.15 * vol + 0.30 * form >= least:
                    out[a["source"], a["product_key"], b["source"], b["product_key"]] = (round(cos, 4), vol, form)
    return out


def found(pairs):
    return {(r["source_a"], r["key_a"], r["source_b"], r["key_b"]): (r["name_score"], r["volume_agreement"], r["form_agreement"]) for r in pairs.collect()}


def test_prefix_filter_misses_no_pair(spark):
    rows = computed_once(matching.features(products(spark)))
    weights = matching.gram_weights(rows).collect()
    for least in (0.45, 0.8):
        want = all_pairs(rows.collect(), weights, least)
        assert found(matching.candidates(rows, least)) == want and len(want) > 20


def test_crowded_keys_are_sliced(spark):
    """Slices of two names: the same pairs, and no block of more than two slices."""
    rows = computed_once(matching.features(products(spark, seed=6)))
    idf = computed_once(matching.gram_idf(rows))
    grams = cosine_join.vectors(matching.gram_weights(rows, idf), idf)
    names = computed_once(rows.where("brand_norm <> ''").groupBy("brand_norm", "norm", "vol", "form").agg(F.lit(None).cast("string").alias("only")).withColumn("id", F.monotonically_increasing_id()).join(grams, "norm"))
    args = (names, matching.volume_agreement, matching.form_agreement, 0.45, 0.15, 0.30)
    whole, sliced = (sorted(map(tuple, cosine_join.candidate_pairs(*args, slice_size=n).collect())) for n in (1000, 2))
    assert whole == sliced and len(whole) == len(set(whole)) > 50


def test_frequent_grams_bring_no_pairs_together(spark):
    """Grams that all names share come last and have no reach where nothing else agrees, so that they are no keys there."""
    rng = random.Random(2)
    names = [("s1", str(k), "common " + "".join(rng.choice("bdfghjklpqrstvwxz") for _ in range(8)), "brand", None) for k in range(60)]
    rows = computed_once(matching.features(spark.createDataFrame(names, SCHEMA)))
    idf = matching.gram_idf(rows)
    shared = {r["gram"] for r in idf.where("df >= 60").collect()}
    for r in cosine_join.vectors(matching.gram_weights(rows, idf), idf).collect():
        reach = [g["reach"] for g in r["grams"]]
        assert abs(reach[0] - 1) < 1e-9 and reach == sorted(reach, reverse=True)
        assert {g["gram"] for g in r["grams"][-len(shared) :]} == shared and reach[-len(shared)] < 0.45


def test_plan_joins_no_whole_brand_gram_table(spark):
    rows = matching.features(products(spark))
    plan = matching.candidates(rows)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan, "features are computed once, before"


def test_sized_join_is_a_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = sized_join(left, right, "k", "n", 5000)
    assert got.count() == 5000 and got.where("k = 0 and n = 4000").count() == 4000
