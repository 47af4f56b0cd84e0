"""Quality rules, line first: lines are judged and removed before the document is.

A line (with a word) is removed by the first of these rules that it fails:

- navigation: two separators (a word of |, >, », ·, • or / alone) or more, and one for each five words at least;
- punctuation: more SYMBOLS than one for each ten words, or doubled marks (!!, ??) at the end of more than a fifth of its words, or fewer
  than HEADING words without a mark that ends a sentence;
- boilerplate: it is an earlier line of the document, or holds one of the PHRASES (A-Z in either case).

A document is rejected if it fails one of two rules of its own (too few words, too many words in repeated windows of
three), or if the lines removed held more than MOST_LOST percent of the code points of its words.

Defined results: null and empty texts have no words and are rejected as too short; texts of any length are read whole; rows are judged
one by one, so that repeated rows and ids, null ones too, give repeated results; an empty table gives an empty table; columns besides those
read may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row

LEAST_WORDS, MOST_REPEATED, MOST_LOST, HEADING = 50, 50, 30, 10
SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset(x.encode() for x in "| > » · • /".split())
DOUBLED = (b"!!", b"??")
ENDINGS = tuple(x.encode() for x in ". ! ? … : ; \" ' ” ’ » ) 。 ！ ？".split())
PHRASES = ["cookie", "javascript", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "click here", "sign up", "log in", "all rights reserved"]
_PHRASE = re.compile("|".join(PHRASES).encode())
RULES = ("navigation", "punctuation", "boilerplate")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_lost", *(f"{r}_chars" for r in RULES)]
FAILED = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"
LOST = f"100 * ({' + '.join(f'{r}_chars' for r in RULES)}) > {MOST_LOST} * word_chars"


def failing_rule(line: bytes, words: list[bytes], earlier: bool) -> str | None:
    """The first rule that a line with words fails."""
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and 5 * separators >= len(words):
        return "navigation"
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if 10 * symbols > len(words) or 5 * sum(w.endswith(DOUBLED) for w in words) > len(words) or (len(words) < HEADING and not words[-1].endswith(ENDINGS)):
        return "punctuation"
    return "boilerplate" if earlier or _PHRASE.search(line.lower()) else None


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three which the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1].astype(np.int64) * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    held = np.zeros(len(words), bool)
    for k in range(3):
        held[k : k + len(twice)] |= twice
    return int(held.sum())


def _letters(words: list[bytes]) -> int:
    return len(b"".join(words).decode())


def judged(text: str | None) -> tuple[dict[str, int], str]:
    """COUNTS of a text, and its lines without those removed."""
    words: list[bytes] = []
    seen: set[bytes] = set()
    kept, lost, lines_lost, copies = [], dict.fromkeys(RULES, 0), 0, 0
    whole = (text or "").encode()
    for line in whole.split(b"\n"):
        own = line.split()
        if own:
            earlier = line in seen
            seen.add(line)
            copies += earlier
            words += own
            if rule := failing_rule(line, own, earlier):
                lost[rule] += _letters(own)
                lines_lost += 1
                continue
        kept.append(line)
    counts = [len(words), _letters(words), len(whole) - len(whole.translate(None, SYMBOLS)), copies, repeated_words(words), lines_lost, *lost.values()]
    return dict(zip(COUNTS, counts, strict=True)), b"\n".join(kept).decode()


def _run(docs: DataFrame, extra: list, with_text: bool) -> DataFrame:
    """The columns of extra, COUNTS, base_failed, kept, and the cleaned text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(t.as_py()) for t in batch.column(0)]
            columns = [*batch.columns[1:], *(pa.array([c[name] for c, _ in found], pa.int64()) for name in COUNTS)]
            yield pa.record_batch(columns + ([pa.array([t for _, t in found], pa.string())] if with_text else []), names)

    rows = docs.select("text", *extra)
    names = [*rows.columns[1:], *COUNTS, *(["cleaned"] if with_text else [])]
    types = [*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]), *(f"{c} long" for c in COUNTS), *(["cleaned string"] if with_text else [])]
    out = rows.mapInArrow(run, ", ".join(types))
    return out.withColumns({"base_failed": F.expr(FAILED), "kept": ~F.expr(FAILED) & ~F.expr(LOST)})


def quality_rules(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, COUNTS, base_failed and kept; with_text gives the cleaned text too."""
    return _run(docs, [F.col("doc_id").cast("long").alias("doc_id")], with_text)


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns; text has the lines that passed."""
    found = _run(docs, [whole_row(docs)], with_text=True).where("kept")
    return found.select(*[F.col("cleaned").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


ORACLE_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS x FROM documents),
lines AS (SELECT id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT id, string_split(x, chr(10)) AS l FROM texts)),
split AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines),
numbered AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY id, line ORDER BY pos) > 1 AS earlier FROM split WHERE len(w) > 0),
measured AS (
    SELECT *, length(array_to_string(w, '')) AS chars, length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
        len(list_filter(w, lambda x: x IN ('|', '>', '»', '·', '•', '/'))) AS separators, len(list_filter(w, lambda x: right(x, 2) IN ('!!', '??'))) AS doubled,
        right(w[-1], 1) IN ('.', '!', '?', '…', ':', ';', '"', '''', '”', '’', '»', ')', '。', '！', '？') AS ended,
        regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PHRASES)}') AS phrase FROM numbered),
ruled AS (
    SELECT *, CASE WHEN separators >= 2 AND 5 * separators >= n THEN 'navigation'
        WHEN 10 * symbols > n OR 5 * doubled > n OR (n < {HEADING} AND NOT ended) THEN 'punctuation'
        WHEN earlier OR phrase THEN 'boilerplate' END AS rule FROM measured),
per_text AS (
    SELECT id, sum(n) AS n_words, sum(chars) AS word_chars, sum(symbols) AS n_symbols, sum(earlier::INT) AS n_dup_lines, count(rule) AS n_lines_lost,
        {", ".join(f"sum(CASE WHEN rule = '{r}' THEN chars ELSE 0 END) AS {r}_chars" for r in RULES)} FROM ruled GROUP BY id),
words AS (SELECT id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM texts)),
windows AS (SELECT id, pos, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY id ORDER BY pos)),
twice AS (SELECT id, pos, third IS NOT NULL AND count(*) OVER (PARTITION BY id, word, second, third) > 1 AS t FROM windows),
held AS (SELECT id, t OR coalesce(lag(t) OVER o, false) OR coalesce(lag(t, 2) OVER o, false) AS h FROM twice WINDOW o AS (PARTITION BY id ORDER BY pos)),
repeated AS (SELECT id, sum(h::INT) AS n_repeat_words FROM held GROUP BY id),
counts AS (SELECT doc_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in COUNTS)} FROM texts LEFT JOIN per_text USING (id) LEFT JOIN repeated USING (id))
SELECT *, {FAILED} AS base_failed, NOT ({FAILED}) AND NOT ({LOST}) AS kept FROM counts"""
