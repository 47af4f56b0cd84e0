"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

1. Words are counted in each task first, then over all. A run of letters of some documents is written with one letter less, by a
   hash of document and run (see ``word_counts``).
2. Two words are near if one edit (a code point inserted, deleted or replaced) makes one the other. The edit lies
   in the second half, so that both share their first half, or in the first, so that they share their last. A word
   is therefore entered in a forward dictionary under its first half and in a reversed one under its last half, once for each
   length that the longer word of a pair may have.
3. Blocks with more than BLOCK words are subdivided: what is left between the shared ends is halved again, and each word goes
   under both. A block whose ends leave one code point open is never divided; it has one word for each letter at most, and one more.
   Sizes come from counts that are aggregated before a shuffle, so that no crowded block is ever moved to one task.
4. The dictionaries are sorted by ranges of blocks. A task scans its range, and verifies the pairs within each block by their code points.
   A pair is given in the one block whose open part holds its edit.
5. The form of a word is its most frequent near word, if that has at least TIMES as many occurrences; roots are found by pointer doubling,
   whose rounds follow from the largest count, as counts grow TIMES times with each form.

Defined results: null and empty texts have no words; texts of any length are read whole; a null doc_id is written as the empty text in the hash;
repeated rows count as often as they occur; of equally frequent near words the first in code-point order is the form; an empty
table gives an empty table; columns besides doc_id and text are not read and may have any names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join

LETTERS = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words of a block that are compared with each other. Fuller blocks are subdivided.
BLOCK = 64
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17
SHORTEST, FEWEST, TIMES, ONE_IN = 6, 5, 5, 199
NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _with_slips(prefix: int, runs: list[str], counts: Counter) -> None:
    """Adds the runs of one document to counts; prefix is the crc32 of its id and a colon."""
    counts.update(runs)
    for run in [r for r in set(runs) if not zlib.crc32(r.encode(), prefix) % ONE_IN]:
        at, n = zlib.crc32(run.encode(), prefix) % len(run), runs.count(run)
        counts[run] -= n
        counts[run[:at] + run[at + 1 :]] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents, of runs of letters in which A-Z are lower-cased.

    Where ONE_IN divides the crc32 of '<doc_id>:<run>', the run lacks the code point at this number modulo its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            held = [(w, n) for w, n in counts.items() if n and w]
            counts.clear()
            return pa.record_batch([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = LETTERS.findall((text.as_py() or "").encode().translate(LOWER).decode())
                _with_slips(zlib.crc32(f"{'' if doc is None else doc}:".encode()), runs, counts)
                if len(counts) > HELD:
                    yield handed_on()
        yield handed_on()

    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _halved(rows: DataFrame) -> DataFrame:
    """rows: word, n, long, low, high; the edit lies at low..high-1 of a longer word of ``long`` code points. Both halves, as blocks."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    sides = F.explode(F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high"))))
    cut = rows.select("word", "n", "long", sides.alias("s")).select("word", "n", "long", "s.low", "s.high")
    head = F.substring(F.col("word"), F.lit(1), F.col("low"))
    tail = F.when(F.col("long") == F.col("high"), F.lit("")).otherwise(F.substring(F.col("word"), F.char_length("word") - F.col("long") + F.col("high") + 1, F.col("long") - F.col("high")))
    return cut.select("word", "n", F.struct("long", "low", "high", head.alias("head"), tail.alias("tail")).alias("block"))


def blocks(words: DataFrame, scratch: Scratch, most: int = BLOCK) -> DataFrame:
    """words: word, n. Gives word, n, block for blocks of two words and more, and of ``most`` at most where more than one code point is open."""
    size = F.char_length("word").cast("int")
    longer = F.explode(F.array(size, size + 1))
    now, done = _halved(words.select("word", "n", longer.alias("long")).withColumns({"low": F.lit(0), "high": F.col("long")})), None
    while True:
        now = scratch.save(now)
        sizes = scratch.save(now.groupBy("block").agg(F.count("*").alias("size")).where("size > 1"))
        full = (F.col("size") > most) & (F.col("block.high") - F.col("block.low") > 1)
        sized = hot_join(now, sizes, "block", "size", now.count())
        fit = sized.where(~full).select("word", "n", "block")
        done = fit if done is None else done.unionByName(fit)
        if sizes.where(full).isEmpty():
            return done
        now = _halved(sized.where(full).select("word", "n", "block.long", "block.low", "block.high"))


def _edit_at(a: np.ndarray, b: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Place of the one edit that makes a (a row of code points, a place less where short) the row of b, or -1."""
    width = a.shape[1]
    same = a == b
    out = np.where(same.sum(axis=1) == width - 1, same.argmin(axis=1), -1)
    if short.any():
        s, t = a[short], b[short]
        ahead = np.logical_and.accumulate(s[:, :-1] == t[:, :-1], axis=1).sum(axis=1)
        behind = np.logical_and.accumulate((s[:, :-1] == t[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        out[short] = np.where(ahead + behind >= width - 1, ahead, -1)
    return out


def _near_pairs(words: list[str], block: np.ndarray, long: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each near pair; block numbers the blocks, which stand together."""
    points = np.array(words, f"<U{long}").view(np.uint32).reshape(len(words), long)
    short = points[:, -1] == 0
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    most = max(1, (1 << 21) // long)
    for apart in range(1, len(words)):
        first = np.flatnonzero(block[apart:] == block[:-apart])
        if not len(first):
            break
        first = first[~(short[first] & short[first + apart])]
        for k in range(0, len(first), most):
            i, j = first[k : k + most], first[k : k + most] + apart
            i, j = np.where(short[j], j, i), np.where(short[j], i, j)  # the shorter one first
            at = _edit_at(points[i], points[j], short[i])
            good = (at >= low[i]) & (at < high[i])
            found_a.append(i[good])
            found_b.append(j[good])
    return np.concatenate(found_a), np.concatenate(found_b)


def near_words(entries: DataFrame) -> DataFrame:
    """entries: word, n, block. Gives word, near, near_n for both words of each near pair, once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_end(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = pa.concat_tables([rest, table]) if table is not None else rest
            if table is None or not table.num_rows:
                continue
            keys = list(zip(*(table[c].to_pylist() for c in ("long", "low", "high", "head", "tail")), strict=True))
            begins = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            if batch is not None:  # the last block may go on in the next batch
                rest = table.slice(begins[-2])
                begins = begins[:-1]
            ids, k = np.repeat(np.arange(len(begins) - 1), np.diff(begins)), 0
            words, counts = table["word"].to_pylist(), table["n"].to_numpy()
            while k < len(begins) - 1:
                long, last = keys[begins[k]][0], k + 1
                while last < len(begins) - 1 and keys[begins[last]][0] == long and (begins[last + 1] - begins[k]) * long <= 1 << 22:
                    last += 1
                low, high = begins[k], begins[last]
                bounds = np.array([x[1:3] for x in keys[low:high]])
                a, b = _near_pairs(words[low:high], ids[low:high], long, bounds[:, 0], bounds[:, 1])
                if len(a):
                    one, other = np.concatenate([a, b]) + low, np.concatenate([b, a]) + low
                    yield pa.record_batch([pa.array([words[x] for x in one], pa.string()), pa.array([words[x] for x in other], pa.string()), pa.array(counts[other])], schema=NEAR)
                k = last

    keys = [F.col("block")[c].alias(c) for c in ("long", "low", "high", "head", "tail")]
    ranges = entries.select("word", "n", *keys).repartitionByRange("long", "low", "high", "head", "tail").sortWithinPartitions("long", "low", "high", "head", "tail")
    return ranges.mapInArrow(scan, "word string, near string, near_n long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _roots(forms: DataFrame, steps: int, scratch: Scratch) -> DataFrame:
    """forms: word, form. Gives word, root, after at most ``steps`` forms in a row."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.save(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least ``shortest`` code points and ``fewest`` occurrences."""
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.save(word_counts(docs).where((F.char_length("word") >= shortest) & (F.col("n") >= fewest)))
        best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
        near = near_words(blocks(words, scratch, block)).groupBy("word").agg(F.count("*").alias("n_near"), best)
        found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
        often = F.col("near_n") >= times * F.col("n")
        found = scratch.save(found.select("word", "n", "n_near", F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")))
        most = found.agg(F.max("n")).first()[0] or 1
        roots = _roots(found.where("form is not null").select("word", "form"), 1 + int(math.log(max(1.0, most / fewest), times)), scratch)
        out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.kept(out)


#: Words, then pairs by what is left once a code point is taken out: equal for words of one length at one place, or equal to the shorter word.
ORACLE_SQL = r"""
WITH RECURSIVE digits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM digits),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
    SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS b FROM per_doc),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) AS h FROM bytes, crc_table),
slips AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, (h % length(run)) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slips GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS k)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest
    UNION SELECT b.word, a.word, a.n FROM words a JOIN cuts b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
found AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS step FROM found UNION ALL SELECT c.word, f.form FROM chain c JOIN found f ON f.word = c.step WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.step AS root FROM chain c JOIN found f ON f.word = c.step WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)"""
