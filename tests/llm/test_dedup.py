import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from trendloom.llm import exact_dedup
from trendloom.llm.common import Scratch, hot_join

from .helpers import SCHEMA, documents, hard_rows


def test_perfect_hash_fills_all_slots():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 1000):
        words = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
        seeds, slots = exact_dedup.perfect_hash(words)
        assert sorted(slots.tolist()) == list(range(n)) and len(seeds) == -(-n // exact_dedup.BUCKET)


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_plain_version(spark):
    rows = hard_rows()
    got = exact_dedup.exact_duplicates(documents(spark)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == plain(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_members_and_nonmembers_across_the_history(spark):
    rows = [(k, f"text {k % 37}", "en", "s", 7) for k in range(400)] + [(k, f"late {k % 11}", "en", "s", 6) for k in range(300, 500)]
    got = exact_dedup.exact_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = documents(spark).withColumns({"digest": F.lit(1), "row": F.lit("r"), "keep_id": F.lit(None).cast("string"), "size": F.lit(2)})
    odd = odd.withColumns({"_keep": F.col("doc_id"), "_digest": F.lit("own"), "id": F.lit(5), "content": F.lit(6)})
    out = exact_dedup.without_copies(odd)
    assert out.columns == odd.columns and out.where("_digest = 'own' and id = 5 and content = 6 and _keep <=> doc_id").count() == out.count()
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in hard_rows()})
    assert exact_dedup.without_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_join_is_a_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    with Scratch(spark) as scratch:
        got = hot_join(scratch.save(left), scratch.save(right), "k", "n", 5000)
        assert got.count() == 5000 and got.where("k = 0 and n = 4000").count() == 4000


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    rows = [(7, "same", "en", f"s{k}", k) for k in range(40)] + [(None, "none", "en", f"s{k}", k) for k in range(40)] + [(7, "same", "en", "s3", 3)] * 5
    out = [sorted(map(tuple, exact_dedup.without_copies(documents(spark, r).repartition(n)).collect()), key=str) for r, n in ((rows, 3), (rows[::-1], 7))]
    assert out[0] == out[1] and len(out[0]) == 2
