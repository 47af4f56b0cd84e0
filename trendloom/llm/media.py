"""Media columns: payloads stored as content-defined chunks and put together again.

A payload is a text's UTF-8 bytes, padded by spaces to a positive multiple of ALIGN; its unit is the 8-bit
sample. The media are a header (magic, unpadded length, number of samples) and the samples. A gear hash rolls over
the payload, and a chunk ends where its high bits are clear, so that equal passages are cut alike wherever they stand.

- The digests of all chunks, without their bytes, are counted by Spark. Those that occur more than once set a bit in a map
  whose size follows their number (common.bit_map, 16 MB at most), which is broadcast.
- Chunks whose bit is not set are unique and are stored in place with their payload. All others are deduplicated by
  digest into a store of shared chunks. (A unique chunk that meets a set bit, one in some dozens, is stored there too.)
- Reading joins the ordered digest list of each payload with the shared chunks, puts the payload together,
  verifies every chunk against its digest, and computes the features from what was read.

Defined results: a null text counts as empty and becomes ALIGN spaces; a text of any length is stored whole; rows that repeat
each have a list of chunks, the chunks are stored once; equal texts have equal values, and a null id stays null. An empty
table gives an empty table. Columns besides doc_id and text are not read and may have any names. A chunk that does not match
its digest raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_map, hot_join, in_map
from .wordcodec import mixed

ALIGN, MAGIC = 192, b"MC01"
#: Least and most bytes of a chunk; after the least, a cut comes within 2**BITS bytes on average.
LEAST, MOST, BITS = 256, 8192, 10
#: The gear: a number for each byte, mixed from it. Bytes more than 32 back have left the hash.
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ALIGN if raw else ALIGN)


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # the sum of gear[i - k] << k over the last 32 bytes, doubling
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marks = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    ends, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        at = min(n, at + MOST, int(marks[k]) if k < len(marks) else n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    begin, out = 0, []
    for end in cuts(payload):
        out.append(payload[begin:end])
        begin = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def number_of(digest_: bytes) -> int:
    """The first eight bytes of a digest, as the map of repeated ones knows it."""
    return int.from_bytes(digest_[:8], "big", signed=True)


def header(n_bytes: int, samples: int) -> bytes:
    return MAGIC + struct.pack("<QQ", n_bytes, samples)


def features(samples: np.ndarray) -> str:
    """Mean and spread of the samples' level, share of crossings of the middle, and entropy in bits."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    std = float(np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(samples)))
    high = samples >= 128
    crossings = np.count_nonzero(high[1:] != high[:-1]) / max(1, len(samples) - 1)
    return f"mean={mean:.3f};std={std:.3f};crossings={crossings:.4f};entropy={-float((share * np.log2(share)).sum()):.4f}"


def _slices(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most n rows, so that copies of the payloads of a few rows only are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def repeated_map(docs: DataFrame) -> np.ndarray:
    """The bit map of digests that occur more than once."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([digest(c) for t in batch.column(1).to_pylist() for c in chunks_of(padded(t))], pa.binary())], ["digest"])

    counted = _texts(docs).mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    with Scratch(docs.sparkSession) as scratch:
        return bit_map(scratch.save(counted.select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("number"))))


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Payloads (row, doc_id, n_bytes, samples, digests, shared: positions, own: bytes) and shared chunks (digest, chunk, uses)."""
    bits = docs.sparkSession.sparkContext.broadcast(repeated_map(docs))

    def split(text: str | None, held: np.ndarray):
        chunks = chunks_of(padded(text))
        digests = [digest(c) for c in chunks]
        numbers = np.fromiter(map(number_of, digests), np.int64, len(digests))
        return chunks, digests, np.flatnonzero(in_map(held, numbers)).tolist()

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows: dict[str, list] = {"n_bytes": [], "samples": [], "digests": [], "shared": [], "own": []}
            for text in batch.column(2).to_pylist():
                chunks, digests, shared = split(text, bits.value)
                elsewhere = set(shared)
                rows["n_bytes"].append(len((text or "").encode()))
                rows["samples"].append(sum(map(len, chunks)))
                rows["digests"].append(digests)
                rows["shared"].append(shared)
                rows["own"].append([c for k, c in enumerate(chunks) if k not in elsewhere])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["samples"], pa.int64()), pa.array(rows["digests"], pa.list_(pa.binary())), pa.array(rows["shared"], pa.list_(pa.int32())), pa.array(rows["own"], pa.list_(pa.binary()))], ["row", "doc_id", "n_bytes", "samples", "digests", "shared", "own"])

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            seen: dict[bytes, list] = {}
            for text in batch.column(1).to_pylist():
                chunks, digests, shared = split(text, bits.value)
                for k in shared:
                    seen.setdefault(digests[k], [chunks[k], 0])[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c for c, _ in seen.values()], pa.binary()), pa.array([n for _, n in seen.values()], pa.int64())], ["digest", "chunk", "uses"])

    payloads = _texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(in_place, "row long, doc_id long, n_bytes long, samples long, digests array<binary>, shared array<int>, own array<binary>")
    payloads = scratch.save(payloads, "zstd")
    shared = _texts(docs).mapInArrow(loose, "digest binary, chunk binary, uses long").groupBy("digest").agg(F.first("chunk").alias("chunk"), F.sum("uses").alias("uses"))
    return payloads, scratch.save(shared, "zstd")


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, samples, digests, shared, own, fetched (position, chunk) to RESULT."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in _slices(batches):
        out: dict[str, list] = {c: [] for c in names}
        for r in batch.to_pylist():
            fetched = {x["position"]: x["chunk"] for x in r["fetched"] or []}
            own = iter(r["own"])
            chunks = [fetched[k] if k in fetched else next(own) for k in range(len(r["digests"]))]
            if [digest(c) for c in chunks] != r["digests"]:
                raise ValueError(f"a chunk of document {r['doc_id']} does not match its digest")
            payload = b"".join(chunks)
            media = header(r["n_bytes"], r["samples"]) + payload
            values = (r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(payload, np.uint8)))
            for c, v in zip(names, values, strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for c in names], names)


def read_back(payloads: DataFrame, shared: DataFrame) -> DataFrame:
    """RESULT for each payload, from the stored bytes."""
    columns = ["doc_id", "n_bytes", "samples", "digests", "shared", "own"]
    kind = "array<struct<position:int,chunk:binary>>"
    whole = payloads.where(F.size("shared") == 0).select(*columns, F.lit(None).cast(kind).alias("fetched"))
    wanted = payloads.where(F.size("shared") > 0).select("row", F.explode("shared").alias("position"), "digests").select("row", "position", F.element_at("digests", F.col("position") + 1).alias("digest"))
    total = shared.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    fetched = hot_join(wanted, shared, "digest", "uses", total).groupBy("row").agg(F.collect_list(F.struct("position", "chunk")).alias("fetched"))
    parts = payloads.where(F.size("shared") > 0).join(fetched, "row").select(*columns, F.col("fetched").cast(kind).alias("fetched"))
    return whole.unionByName(parts).mapInArrow(_restore, RESULT)


def media_columns(docs: DataFrame) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        payloads, shared = store(docs, scratch)
        digests = ("payload_sha256", "media_sha256")
        out = scratch.kept(read_back(payloads, shared).withColumns({c: F.unhex(c) for c in digests}))
        return out.withColumns({c: F.lower(F.hex(c)) for c in digests})
