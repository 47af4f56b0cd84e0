"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of frequent words (pre-tokens) with their token counts, broadcast to all
workers; it has at most FREQUENT words, the most frequent of a sample of about SAMPLE rows. Tier two is a cache in each worker, which
encodes a word that tier one lacks once and remembers it. No word is shuffled, in the sample neither: each
of its few tasks sends its most frequent words to the driver. What is in the table decides
about speed alone, never about a count; words are known by two hashes, 128 bits together.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; rows are independent of
each other, so that repeated rows and ids give repeated results, and a null id stays null; an empty table gives an
empty table; columns besides doc_id and text are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import loaded
from .wordcodec import HashTable, words_of

FREQUENT, SAMPLE, TASKS, LIMIT = 1 << 15, 1 << 13, 4, 1024
WORD = pa.schema([("word", pa.int64()), ("second", pa.int64()), ("n", pa.int64()), ("tokens", pa.int32())])


def _summed(table: pa.Table) -> pa.Table:
    """The FREQUENT most frequent words of a table of counts. Of two words with one first hash, only one is kept."""
    both = table.group_by("word").aggregate([("second", "min"), ("n", "sum"), ("tokens", "min")]).rename_columns(WORD.names)
    return both.sort_by([("n", "descending"), ("word", "ascending")]).slice(0, FREQUENT).cast(WORD)


def frequent_words(docs: DataFrame, tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and the token counts of words that are frequent in a sample of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, best = loaded(tokenizer), WORD.empty_table()
        for batch in batches:
            for words in words_of(bpe._parts([t or "" for t in batch.column(0).to_pylist()])[0]):
                _, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
                often = np.argsort(-counts, kind="stable")[:FREQUENT]
                picked = words.only(first[often])
                rows = bpe.cache.rows(picked)  # may make the cache's arrays anew
                sizes = bpe.cache.length[rows]
                own = pa.table([pa.array(picked.hashes.view(np.int64)), pa.array(picked.second.view(np.int64)), pa.array(counts[often]), pa.array(sizes)], schema=WORD)
                best = _summed(pa.concat_tables([best, own]))
        yield from best.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], WORD)]

    one_in = max(1, docs.count() // SAMPLE)
    sample = docs.select("text", F.monotonically_increasing_id().alias("row")).where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select("text")
    # dealt out after the filter, so that the scan keeps its own tasks
    found = sample.repartition(TASKS).mapInArrow(run, "word long, second long, n long, tokens int").toArrow()
    top = _summed(found.cast(WORD))
    return tuple(top[c].to_numpy().view(kind) for c, kind in (("word", np.uint64), ("second", np.uint64), ("tokens", np.int32)))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and known: the share of words that tier one had."""
    keys, second, sizes = frequent_words(docs, tokenizer)
    table = HashTable(max(4, int(4 * len(keys)).bit_length()))
    table.add(keys)
    shared = docs.sparkSession.sparkContext.broadcast((table, np.append(second, np.uint64(0)), np.append(sizes, np.int32(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        known, second, lengths = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = [t or "" for t in batch.column(1).slice(at, 1024).to_pylist()]
                parts, owners, after = bpe._parts(texts)
                own = np.asarray(owners, np.int64)
                counts, hits, all_words = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
                for words in words_of(parts):
                    rows = known.find(words.hashes)
                    rows[second[rows] != words.second] = -1
                    n = lengths[rows]
                    missed = np.flatnonzero(rows < 0)
                    if len(missed):
                        rest = bpe.cache.rows(words.only(missed))  # may make the cache's arrays anew
                        n[missed] = bpe.cache.length[rest]
                    doc = own[words.owner]
                    counts += np.bincount(doc, n, len(texts))
                    hits += np.bincount(doc, rows >= 0, len(texts))
                    all_words += np.bincount(doc, minlength=len(texts))
                for k, i in after:
                    counts[k] += i >= 0
                n = counts.astype(np.int64)
                bytes_ = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                share = np.divide(hits, all_words, out=np.ones(len(texts)), where=all_words > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), pa.array(bytes_), pa.array(n), pa.array(n > limit), pa.array(share)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "known"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, known double")
