import math
import os
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import SMALL
from trendloom.operators import evaluation, matching, tools, vector_index
from trendloom.sources import adapters, commits, gram_index, snapshots, status
from trendloom.sources.store import computed_once
from trendloom.streaming import rank_movement


def test_last_snapshot_reads_one_month(spark, tmp_path):
    target, ranks = str(tmp_path), computed_once(adapters.rank_snapshots(spark, SMALL))
    early = ranks.where("captured_at < '1997-01-01'")
    snapshots.add_snapshots(spark, target, ranks.where("captured_at >= '1997-01-01'"))
    newest = dict(commits.current(spark, target)["latest"])
    # an older batch adds to its own months and moves no last day
    months = snapshots.add_snapshots(spark, target, early)
    assert commits.current(spark, target)["latest"] == newest and max(months) < "1997-01-01"
    assert sorted(map(tuple, snapshots.read_snapshots(spark, target).collect())) == sorted(map(tuple, ranks.collect()))
    last = snapshots.last_snapshot(spark, target, "O")
    assert len({os.path.dirname(f) for f in last.inputFiles()}) == 1
    want = tools.latest_snapshot(ranks, "O")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    assert tools.top_of_snapshot(last).df.count() > 0
    assert snapshots.last_snapshot(spark, target, "none").count() == 0 and snapshots.read_snapshots(spark, target, "2050-01-01").count() == 0
    assert commits.clean_up(spark, target, older_than_s=0) == [] and snapshots.read_snapshots(spark, target).count() == ranks.count()
    assert snapshots.add_snapshots(spark, target, ranks.limit(0)) == []


def test_status_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit("2020-05-05 12:00:00").cast("timestamp").alias("at")).repartition(4).write.parquet(path)
    assert status.stored_status(spark, path, "day") == (1000, date(2020, 1, 1), date(2022, 9, 26))
    assert status.stored_status(spark, path) == (1000, None, None) and status.stored_status(spark, path, "at") == (1000, date(2020, 5, 5), date(2020, 5, 5))
    with status._footers(spark):
        plan = status.footer_aggregate(spark, path, "day")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(day), MAX(day)]" in plan
    assert "BatchScan" not in spark.read.parquet(path)._jdf.queryExecution().executedPlan().toString(), "settings are as before"


def test_sidecar_leaves_files_out(spark, tmp_path):
    table, sidecar = str(tmp_path / "a b"), str(tmp_path / "s")
    words = ["Äpfel und Birnen", "plain words", "100% sure_thing", "리뷰 본문", "", None]
    for k, w in enumerate(words * 2):
        spark.createDataFrame([(k, w), (k, f"filler {k}")], "k int, body string").coalesce(1).write.mode("append").parquet(table)
    gram_index.build(spark, table, "body", sidecar)
    for word, files in (("BIRNEN", 2), ("äPFEL", 2), ("본문", 12), ("뷰 본", 2), ("100%", 2), ("e_t", 2), ("nowhere", 0), ("filler 11", 1), ("", 12)):
        read, skipped = gram_index.files_to_read(spark, table, sidecar, word)
        assert (len(read), skipped) == (files, 12 - files), word
        want = spark.read.parquet(table).where(F.col("body").ilike("%" + word.replace("%", r"\%").replace("_", r"\_") + "%"))
        assert sorted(map(tuple, gram_index.holding(spark, table, sidecar, "body", word).collect())) == sorted(map(tuple, want.collect()))
    # a file that came later is read
    spark.createDataFrame([(99, "late birnen")], "k int, body string").write.mode("append").parquet(table)
    assert gram_index.holding(spark, table, sidecar, "body", "birnen").count() == 3
    # small filters fill up: files are read in vain, none is missed
    gram_index.build(spark, table, "body", sidecar, 64)
    assert gram_index.holding(spark, table, sidecar, "body", "birnen", 64).count() == 3


def vectors(spark, n=600):
    """Rows around a few directions, in three brands, one of which has half of them."""
    rng = np.random.default_rng(3)
    at = rng.normal(size=(20, 16))
    rows = [(k, "b0" if k % 2 else f"b{k % 3}", f"s{k % 4}", str(k), (at[k % 20] + 0.3 * rng.normal(size=16)).tolist()) for k in range(n)]
    return computed_once(spark.createDataFrame([*rows, (n, "b0", "s1", str(n), [0.0] * 16)], "id long, brand string, source string, product_key string, vector array<double>"))


def test_index_finds_most_and_blocks_find_all(spark):
    table = vectors(spark)
    rows = table.collect()
    m = vector_index._matrix(table.toArrow()["vector"])
    want = sorted((-float(m[i] @ m[j]), a["source"], a["product_key"], b["source"], b["product_key"]) for i, a in enumerate(rows) for j, b in enumerate(rows) if a["brand"] == b["brand"] and a["source"] < b["source"])
    got = vector_index.closest_pairs(table, 675).collect()
    assert [tuple(r)[:4] for r in got] == [w[1:] for w in want[:675]]
    r = vector_index.recall(table, 675, lists=16, nearest=2).first()
    assert r["n_exact"] == 675 and r["n_found"] >= 0.9 * 675
    # slices of 40 rows give the same pairs, each once
    for floor in (0.5, -2.0):
        found = sorted(tuple(x)[:4] for x in vector_index.exact_pairs(table, floor, 40).collect())
        assert found == sorted(w[1:] for w in want if -w[0] >= floor) and len(found) == len(set(found))


def test_fewer_pairs_than_the_budget(spark):
    few = vectors(spark, 8)
    assert vector_index.closest_pairs(few, 675).count() == vector_index.exact_pairs(few, -2.0).count() > 0
    assert vector_index.closest_pairs(few.limit(0), 675).count() == 0


def test_recovery_and_hubs(spark):
    pairs = spark.createDataFrame([("s1", "1", "s2", "2"), ("s1", "1", "s2", "3"), ("s1", "4", "s2", "2"), ("s1", "4", "s3", "3")], "source_a string, key_a string, source_b string, key_b string")
    got = {r["scorer"]: tuple(r)[1:] for r in matching.recovery({"x": pairs, "y": pairs.limit(1)}, pairs.where("key_a = '4'")).collect()}
    assert got == {"x": (4, 2, 2, 1), "y": (1, 2, 0, 1)} or got["x"] == (4, 2, 2, 1)
    assert tuple(matching.hub_summary(pairs).first()) == (2, 4, 3, 2)


def test_report_says_what_it_cannot(spark):
    sample = spark.createDataFrame([("y", 1.1), ("n", 0.5), (None, 0.7), ("y", 0.9)], "is_same_product string, score double")
    out = evaluation.report(sample, 0.9)
    rows = out.df.collect()
    assert "Recall" in out.caveat and out.caveat in out.envelope() and all(r["recall"] is None for r in rows)
    assert [r["threshold"] for r in rows if r["suggested"]] == [0.6] and len(rows) == 4


@pytest.mark.parametrize("months", [1, 2])
def test_movement_on_a_stream_is_that_of_the_batch(spark, tmp_path, months):
    ranks = computed_once(adapters.rank_snapshots(spark, SMALL).where("captured_at < '1998-01-01'"))
    late = F.pmod(F.xxhash64("product_key", "captured_at"), F.lit(5)) == 0
    waves = [ranks.where(~late & (F.year("captured_at") <= 1996)), ranks.where(late), ranks.where(~late & (F.year("captured_at") > 1996)), ranks.where("captured_at = '1997-06-01'")]
    out = str(tmp_path / "out")
    for k, wave in enumerate(waves):
        # a query that stops after each wave and goes on from its state
        wave.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ranks.schema).parquet(str(tmp_path / "in"))
        rank_movement.follow_ranks(spark, stream, out, str(tmp_path / "state"), months, "3000 days").awaitTermination()
        assert k or spark.read.parquet(out).count() > 0
    names = ["source", "board", "product_key", "captured_at", "rank", "earlier_rank", "gain"]
    got = spark.read.parquet(out).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tools.rank_momentum(ranks, months).select(*names).collect()))
    assert not math.isnan(got.count())


def test_state_of_passed_months_goes(spark, tmp_path):
    def day(m):
        return date(2020 + m // 12, m % 12 + 1, 1)

    rows = [("s", "b", "p", day(m), m) for m in range(24)]
    schema = "source string, board string, product_key string, captured_at date, rank int"
    removed, total = 0, 0
    for part in (rows[:12], rows[12:], [("s", "b", "q", day(30), 1)], [("s", "b", "q", day(31), 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = rank_movement.follow_ranks(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), 1, "60 days")
        query.awaitTermination()
        for p in query.recentProgress:
            for state in p["stateOperators"]:
                removed, total = removed + state["numRowsRemoved"], state["numRowsTotal"]
    assert spark.read.parquet(str(tmp_path / "out")).where("product_key = 'p'").count() == 23
    assert (removed, total) == (24, 2), "all months of the first product have gone, the last two of the other are held"
