"""Interaction of five filters: what each removes, repeats or is alone in removing, in every order of application.

Filters (a failing document is removed): A has few words, B repeats its words, C shouts in capitals, D holds marks of markup or
tables, E is a copy of a document with a smaller id. A to D are decided by one pass over the texts. E is decided by partition
refinement: documents are split by their length in code points, then by the hash of one block of their text after another (each
FACTOR times the block before it), and whoever is alone in a class is dropped; what survives all blocks is compared by its full text, and of
equal texts all but those with the least id are marked. Only numbers are moved for the refinement, whole texts for survivors alone:
these are recognised in a second pass by a bit map of their classes, are grouped by class and text in each task first, and so a text copied
without end is moved once from each task.

The five answers of a document are a mask. Documents are counted by part, mask and label, and these few counts (32 masks for each part)
are put through all 120 orders.

Defined results: a null text counts as empty, a null part as the empty string; texts of any length are judged whole; rows that share the least id of equal
texts are no copies of each other, null ids count as larger than any other; a document counts as good or toxic if any label row of its id says so;
rows are counted as often as they occur; an empty table gives an empty table; columns besides doc_id, text, the part and those of labels may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_map, hot_join, in_map

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Code points of the first block of a text, and how many times longer each block is than the one before.
FIRST, FACTOR = 256, 4
BITS = 64


def own_mask(text: str) -> int:
    """The filters A to D that a text fails, as bits."""
    whole = text.encode()
    words = whole.split()
    few = len(words) < LEAST_WORDS
    repeats = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    shouts = 100 * (len(whole) - len(whole.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)
    marked = len(whole) != len(whole.translate(None, MARKS))
    return few | repeats << 1 | shouts << 2 | marked << 3


def block_hashes(text: str, bits: int = BITS) -> list[int]:
    """For each block the hash of all the text up to its end, as signed numbers; fewer bits are for tests."""
    out, at, size, last = [], 0, FIRST, len(text)
    while at < len(text):
        last = xxhash.xxh3_64_intdigest(text[at : at + size].encode(), last) & ((1 << bits) - 1)
        out.append(last - (1 << 64) if last >> 63 else last)
        at, size = at + size, size * FACTOR
    return out or [0]


def judged(docs: DataFrame, part: str, bits: int = BITS) -> DataFrame:
    """doc_id, part, mask of filters A to D, size in code points, blocks (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([own_mask(t) for t in texts], pa.int32()), pa.array([len(t) for t in texts], pa.int64()), pa.array([block_hashes(t, bits) for t in texts], pa.list_(pa.int64()))],
                ["doc_id", "part", "mask", "size", "blocks"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, mask int, size long, blocks array<long>")


def refined(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: doc_id, part, mask, size, blocks. Gives doc_id, part, mask, class of the rows that share length and all blocks with another."""
    now, k, total = rows.withColumn("class", F.col("size")), 0, rows.count()
    while True:
        shared = scratch.save(now.groupBy("class").agg(F.count("*").alias("n"), F.max(F.size("blocks")).alias("most")).where("n > 1"))
        now = scratch.save(hot_join(now, shared.select("class", "n"), "class", "n", total).drop("n"))
        if k >= (shared.agg(F.max("most")).first()[0] or 0):
            return now.select("doc_id", "part", "mask", "class")
        # a text without a further block stays where it is: its class has one length
        now, k = now.withColumn("class", F.coalesce(F.get("blocks", F.lit(k)), "class")), k + 1


def _texts(docs: DataFrame, part: str, classes: DataFrame, bits: int) -> DataFrame:
    """class, doc_id, part, mask, text of the documents of the classes, and of few others (see bit_map)."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([block_hashes(t.as_py(), bits)[-1] for t in batch.column(2)], pa.int64())
            kept = pa.record_batch([keys, *batch.columns], ["class", "doc_id", "part", "text"]).filter(pa.array(in_map(wanted.value, keys.to_numpy())))
            masks = pa.array([own_mask(t.as_py()) for t in kept.column(3)], pa.int32())
            yield pa.record_batch([*kept.columns[:3], masks, kept.column(3)], ["class", "doc_id", "part", "mask", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "class long, doc_id long, part string, mask int, text string")


def copies(docs: DataFrame, part: str, rows: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """doc_id, part, mask of the rows whose whole text is that of a row with a smaller id."""
    alike, total = refined(rows, scratch), rows.count()
    classes = scratch.save(alike.groupBy("class").agg(F.count("*").alias("n")))
    least = F.min("doc_id").alias("first")
    texts = _texts(docs, part, classes.select("class"), bits).groupBy("class", "text").agg(least)
    sized = scratch.save(texts.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first")).join(classes, "class"))
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    one_text = sized.where("texts = 1").select("class", "first", "n")
    out = hot_join(alike, one_text, "class", "n", total).where(later).select("doc_id", "part", "mask")
    mixed = sized.where("texts > 1").select("class")
    if mixed.isEmpty():
        return out
    # texts of one class that differ: their rows find the least id by the text itself
    found = _texts(docs, part, mixed, bits).join(mixed, "class", "left_semi").select(F.struct("class", "text").alias("key"), "doc_id", "part", "mask")
    by_text = found.groupBy("key").agg(least, F.count("*").alias("n"))
    return out.unionByName(hot_join(found, by_text, "key", "n", total).where(later).select("doc_id", "part", "mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", bits: int = BITS) -> DataFrame:
    """part, mask, good, toxic, n: documents by the filters that they fail and by their labels. A written result of few rows."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.save(judged(docs, part, bits))
        marked = copies(docs, part, rows.select("doc_id", "part", "mask", "size", "blocks"), scratch, bits)
        counted = rows.select("doc_id", "part", "mask", F.lit(1).alias("n"))
        for mask, n in ((F.col("mask"), -1), (F.col("mask").bitwiseOR(F.lit(COPY)), 1)):
            counted = counted.unionByName(marked.select("doc_id", "part", mask.cast("int").alias("mask"), F.lit(n).alias("n")))
        known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        by_id = counted.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
        flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
        by_mask = by_id.join(known, "doc_id", "left").select("part", "mask", *flags, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        return scratch.kept(by_mask)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", bits: int = BITS) -> DataFrame:
    """One row for each part, order of the filters and step: see the columns below."""
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = mask_counts(docs, labels, part, bits).select("*", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda k: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {k}, 1)) - 1)")
    own, before = bit("step"), F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (s, k) -> if(k < step, s | shiftleft(1, instr('{FILTERS}', substring(filter_order, k, 1)) - 1), s))")
    steps = steps.withColumns({"own": own, "fails": F.col("mask").bitwiseAND(own) != 0, "gone": F.col("mask").bitwiseAND(before) != 0})
    total = lambda condition, n=F.col("n"): F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")
    here = F.col("fails") & ~F.col("gone")
    # a filter is the first of the k that a document fails in one order of k
    share = F.col("n") * F.lit(len(orders)) / F.bit_count("mask")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~F.col("gone") & ~F.col("fails")).alias("kept"), total(here).alias("removed"), total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
        F.round(F.coalesce(F.sum(F.when(F.col("fails"), share)), F.lit(0.0))).cast("long").alias("shapley"),
    )


ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
words AS (SELECT *, regexp_extract_all(x, '[^ 	-
]+') AS w FROM texts),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
    SELECT id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, unnest(list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
        WHEN 'A' THEN len(w) < 100 WHEN 'B' THEN 100 * len(list_distinct(w)) < 80 * len(w)
        WHEN 'C' THEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x)
        WHEN 'D' THEN regexp_matches(x, '[#$%&*|]') ELSE copy END)) AS f
    FROM (SELECT w.*, good, toxic, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY x), false) AS copy FROM words w LEFT JOIN known k USING (doc_id))),
parts AS (SELECT part, count(*) AS docs FROM texts GROUP BY part),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, (SELECT unnest(range(1, 6)) AS step)),
firsts AS (
    SELECT filter_order, id, part, good, toxic, min(instr(filter_order, f)) AS first, count(*) AS failed FROM fails, orders GROUP BY ALL),
removals AS (SELECT part, filter_order, first AS step, count(*) AS removed, sum(good::INT) AS good_lost, sum(toxic::INT) AS toxic_lost FROM firsts GROUP BY ALL),
per_filter AS (SELECT part, f, count(*) AS failing, sum((failed = 1)::INT) AS alone FROM (SELECT *, count(*) OVER (PARTITION BY id) AS failed FROM fails) GROUP BY ALL),
filled AS (
    SELECT p.part, docs, s.filter_order, s.step, s.f, coalesce(removed, 0) AS removed, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
        coalesce(failing, 0) AS failing, coalesce(alone, 0) AS alone
    FROM parts p CROSS JOIN steps s LEFT JOIN removals r ON r.part = p.part AND r.filter_order = s.filter_order AND r.step = s.step
    LEFT JOIN per_filter q ON q.part = p.part AND q.f = s.f)
SELECT part, filter_order, step::INT AS step, (docs - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed,
    (failing - removed)::BIGINT AS redundant, alone::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM filled"""
