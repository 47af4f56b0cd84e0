import re

import corpus_pipeline
from trendloom.llm import queries, toxicity

from .helpers import components, shingle_sets
from .test_scans import plain_spans
from .test_tokens import check_pieces

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0] and counts[-1] == counts[-2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}


def test_all_numbers_have_a_query():
    names = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])


def test_stages_against_plain_versions(spark, tmp_path):
    docs, found = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        found.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    first, clean, single, apart, masked = map(rows_of, found)
    scores = toxicity.toxicity_scores(found[0], spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 0")
    assert [r[0] for r in clean] == sorted(r["doc_id"] for r in scores.collect()) and len(clean) <= len(first)
    least = {}
    for i, text in clean:
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), i)
    assert [r[0] for r in single] == sorted(least.values()) and len(single) < len(clean)
    sets = shingle_sets(single, 5)
    groups = components(sets, 80)
    kept = {r[0] for r in apart}
    for g in set(groups):
        assert sum(single[k][0] in kept for k, own in enumerate(groups) if own == g) == 1
    assert [r[0] for r in masked] == [r[0] for r in apart]
    for (_, before), (_, after) in zip(apart, masked, strict=True):
        spans = plain_spans(before)
        assert (before == after) == (not spans) and all(before[a:b] not in after for a, _, b, _ in spans)
    packed = docs.collect()
    check_pieces(packed, masked, 2048)
    assert sum(len(r["ids"]) for r in packed) == sum(r["length"] for r in packed)
