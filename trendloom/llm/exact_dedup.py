"""Exact deduplication through a minimal perfect hash over the digests of earlier documents.

The distinct digests of the historical documents are dealt to shards by their own bits. Each shard gets a
minimal perfect hash: keys fall into small buckets, and every bucket, the fullest first, takes the first
seed that puts its keys on free slots. A slot holds the whole digest and the locator of the document that
stays. A lookup compares all 32 bytes, so that a digest outside the index never passes for a member.
Members take the locator from the slot and are counted there; nonmembers group among themselves.

Defined results: a null text counts as empty, a text of any length is compared whole; of rows with equal text the smallest
doc_id stays, null ids counting as larger than any; of rows that repeat doc_id and text exactly one stays, the one whose
columns together have the smallest hash; an empty table gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, content_hash, hot_join, whole_row

#: Digests of a shard, on average.
SHARD = 4096
#: Keys of a bucket, on average.
BUCKET = 4


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _words(digests: pa.Array) -> np.ndarray:
    """Digests as four 64-bit words each."""
    return np.frombuffer(b"".join(digests.to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)


def _slots(word: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    x = word + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) % np.uint64(n)


def perfect_hash(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the buckets, and the slot of each key; all slots 0..n-1 are taken. Keys must differ."""
    n = len(words)
    m = -(-n // BUCKET)
    bucket = (words[:, 0] % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    begins = np.cumsum(sizes) - sizes
    seeds, taken, slots = np.zeros(m, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[b]:
            break
        keys = order[begins[b] : begins[b] + sizes[b]]
        tries = 1 if sizes[b] == 1 and n == 1 else 64
        seed = 0
        while True:
            at = _slots(words[keys, 1][:, None], np.arange(seed, seed + tries), n).astype(np.int64)
            good = ~taken[at].any(axis=0)
            if len(keys) > 1:
                ordered = np.sort(at, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
            found = np.flatnonzero(good)
            if len(found):
                break
            seed, tries = seed + tries, min(4096, 2 * tries)
        seeds[b] = seed + found[0]
        slots[keys] = at[:, found[0]]
        taken[slots[keys]] = True
    return seeds, slots


INDEX = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("seeds", pa.binary()), ("digests", pa.binary()), ("winners", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _build(table: pa.Table) -> pa.Table:
    words = _words(table["digest"])
    seeds, slots = perfect_hash(words)
    order = np.argsort(slots)
    at = pa.array(order)
    return pa.table({"shard": [table["shard"][0].as_py()], "n": [len(words)], "seeds": [seeds.tobytes()], "digests": [words[order].tobytes()], "winners": [table["winner"].take(at).to_pylist()], "rows": [table["row"].take(at).to_pylist()], "sizes": [table["size"].take(at).to_pylist()]}, schema=INDEX)


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """groups: digest, winner, row, size; one row for each digest. Gives a row for each shard."""
    dealt = groups.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", "winner", "row", "size")
    return dealt.groupBy("shard").applyInArrow(_build, "shard long, n long, seeds binary, digests binary, winners array<long>, rows array<long>, sizes array<long>")


def _lookup(index: pa.Table, probes: pa.Table) -> pa.Table:
    n = len(probes)
    member = np.zeros(n, bool)
    out = probes.select(GROUP.names).cast(GROUP)
    if len(index):
        held = np.frombuffer(index["digests"][0].as_py(), np.uint64).reshape(-1, 4)
        sizes = index["sizes"].combine_chunks().flatten().to_numpy().copy()
        if n:
            words, size = _words(probes["digest"]), index["n"][0].as_py()
            seeds = np.frombuffer(index["seeds"][0].as_py(), np.uint32)
            slot = _slots(words[:, 1], seeds[(words[:, 0] % np.uint64(len(seeds))).astype(np.int64)], size).astype(np.int64)
            member = (held[slot] == words).all(axis=1)
            np.add.at(sizes, slot[member], probes["size"].to_numpy()[member])
        raw = held.astype(">u8").tobytes()
        old = pa.table([pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary()), *(index[c].combine_chunks().flatten() for c in ("winners", "rows")), pa.array(sizes)], schema=GROUP)
        out = pa.concat_tables([old, out.filter(pa.array(~member))])
    return out


GROUP = pa.schema([("digest", pa.binary()), ("winner", pa.int64()), ("row", pa.int64()), ("size", pa.int64())])


def lookup(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """digest, winner, row, size: those of the index, members of it in groups counted there, and the nonmembers in groups."""
    dealt = groups.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", "winner", "row", "size")
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_lookup, "digest binary, winner long, row long, size long")


def _grouped(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("size")).select("digest", F.col("first.doc_id").alias("winner"), F.col("first.row").alias("row"), "size")


def groups_of_copies(rows: DataFrame, scratch: Scratch, total: int, cut: int | None) -> DataFrame:
    """rows: doc_id, digest, row. Gives digest, keep_id, keep_row, group_size for each distinct digest.

    Rows with doc_id up to cut are history, from which the index is built; later ones are looked up in it.
    """
    past = F.col("doc_id") <= F.lit(cut) if cut is not None else F.lit(False)
    old = scratch.save(_grouped(rows.where(past)))
    new = scratch.save(_grouped(rows.where(~F.coalesce(past, F.lit(False)))))
    shards = max(1, -(-max(old.count(), new.count()) // SHARD))
    index = scratch.save(build_index(old, shards))
    return lookup(index, new, shards).select("digest", F.col("winner").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))


def midpoint(rows: DataFrame) -> tuple[int, int | None]:
    """Number of rows, and about the median of the ids: the older half of the rows is history."""
    return tuple(rows.agg(F.count("*"), F.percentile_approx("doc_id", 0.5, 1000)).first())


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.save(docs.select(F.col("doc_id").cast("long"), digest_of().alias("digest"), F.monotonically_increasing_id().alias("row")))
        total, cut = midpoint(rows)
        groups = scratch.save(groups_of_copies(rows, scratch, total, cut))
        out = hot_join(rows, groups, "digest", "group_size", total)
        return scratch.kept(out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    Rows are known by id, digest and a hash of all their columns. Rows that agree in all three are joined into one within
    each task, so that a row repeated without end is moved once from each. Every distinct row is shuffled once, with its text, to meet the winners.
    """
    with Scratch(docs.sparkSession) as scratch:
        key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"), digest_of().alias("digest"), content_hash(docs).alias("content")]
        rows = scratch.save(docs.select(F.col("doc_id").cast("long"), digest_of().alias("digest"), content_hash(docs).alias("row")))
        total, cut = midpoint(rows)
        groups = groups_of_copies(rows, scratch, total, cut)
        winners = scratch.kept(groups.select(F.coalesce("keep_id", F.lit(-1)).alias("id"), F.col("keep_id").isNull().alias("none"), "digest", F.col("keep_row").alias("content")))
        names = ["id", "none", "digest", "content"]
        return docs.select(*key, whole_row(docs)).dropDuplicates(names).join(winners, names, "left_semi").select("row.*")
