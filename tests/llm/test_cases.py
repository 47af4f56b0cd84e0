"""Cases that all operators must stand: many distinct words, repeated and null ids, columns with clashing names, one line repeated without end."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendloom.llm import licenses, media, packing, sentence_pieces, token_counts, toxicity, url_filter

from .helpers import SCHEMA, documents, hard_rows

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def many_words():
    """Two texts of more than 65,536 distinct words each, and short ones between."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(90_000)]
    return [(1, " ".join(words), "en", "s", 0), (2, "short", "en", "s", 0), (3, " ".join(w + "x" for w in words), "en", "s", 0), (4, " ".join(words[:100]), "en", "s", 0)]


def test_more_words_than_a_cache_has_rows(spark, many_words):
    library, pieces = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = documents(spark, many_words).coalesce(1)
    want = {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in many_words}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, JSON).collect()} == {k: len(v) for k, v in want.items()}
    found = defaultdict(dict)
    for r in packing.pack(docs, JSON, with_ids=True).collect():
        found[r["doc_id"]][r["start"]] = r["ids"]
    assert {k: [x for _, part in sorted(v.items()) for x in part] for k, v in found.items()} == {k: [*v, 1] for k, v in want.items()}
    assert {r["doc_id"]: r["ids"] for r in sentence_pieces.encode(docs, MODEL).collect()} == {r[0]: pieces.encode(r[1]) for r in many_words}


CLASH = ["row", "ids", "start", "length", "n_bytes", "tokens", "word", "offset", "digest", "payload", "chunk", "license", "matched", "host", "key", "n", "size", "score", "_id", "_doc", "_key"]


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in CLASH if c not in df.columns})


@pytest.mark.parametrize(
    "operator",
    [lambda d: packing.pack(d.coalesce(1), JSON), lambda d: sentence_pieces.round_trip(d, MODEL), lambda d: token_counts.token_counts(d, JSON), media.media_columns, licenses.license_matches],
    ids=["packing", "sentence_pieces", "token_counts", "media", "licenses"],
)
def test_clashing_columns_and_empty_tables(spark, operator):
    plain, odd = operator(documents(spark)), operator(clashing(documents(spark)))
    names = [c for c in plain.columns if c != "sequence_id"]
    assert plain.columns == odd.columns and Counter(map(str, plain.select(*names).collect())) == Counter(map(str, odd.select(*names).collect()))
    assert operator(clashing(spark.createDataFrame([], SCHEMA))).count() == 0


def test_pieces_of_null_and_repeated_ids(spark):
    rows = [(None, "no id", "en", "s", 5), (7, "seven", "en", "s", 5), (7, "seven", "en", "s", 5), (7, "other seven", "en", "s", 5), (None, None, "en", "s", 0)]
    got = sentence_pieces.round_trip(documents(spark, rows), MODEL).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "7", "None", "None"] and all(r["same"] for r in got)
    assert len({(r["n_pieces"], r["ids_crc32"]) for r in got if r["doc_id"] == 7}) == 2


def test_urls_that_repeat_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "http://a.com/1"), (1, "http://a.com/1"), (None, "http://a.com/2"), (None, None), (2, "http://example.net/de/8/x")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = url_filter.url_verdicts(pages, url_filter.outcomes_of(pages, labels)).collect()
    assert Counter(str(r["page_id"]) for r in got) == {"1": 2, "None": 2, "2": 1}
    assert {r["verdict"] for r in got if r["page_id"] == 2} == {"block"} and {r["host"] for r in got} == {"a.com", "", "example.net"}


def test_licenses_in_long_empty_and_repeated_texts(spark):
    name, text = next(iter(licenses.TEMPLATES.items()))
    filler = " ".join(f"w{k}" for k in range(50_000))
    rows = [(1, f"{filler} {text} {filler}", "en", "s", 0), (2, text, "en", "s", 0), (2, text, "en", "s", 0), (None, text, "en", "s", 0), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    got = [r for r in licenses.license_matches(documents(spark, rows)).collect() if r["license"] == name]
    assert Counter(str(r["doc_id"]) for r in got) == {"1": 1, "2": 2, "None": 1}
    (long,) = [r for r in got if r["doc_id"] == 1]
    assert long["coverage"] == 1.0 and len(filler) < long["start"] < long["end"] <= len(filler) + 1 + len(text)


def test_one_notice_repeated_takes_linear_time():
    index, memo = licenses.Index(licenses.TEMPLATES, licenses.COVERAGE), licenses._Hashes()

    def seconds(n):
        words = np.fromiter(map(memo.__getitem__, licenses._word.findall("All rights reserved. " * n)), np.uint64)
        began = time.process_time()
        hits = [h for name, run in index.candidates(words) for h in licenses.occurrences(index.words[name], words, run, index.need[name])]
        assert len(hits) == n
        return time.process_time() - began

    assert seconds(8000) < 8 * seconds(2000) + 0.5


def test_repeated_labelled_ids_are_bounded(spark):
    own = next(k for k in range(5, 50) if zlib.crc32(str(k).encode()) % 4 != 2)  # not held out
    rows = [(own, "you idiot", "en", "s", 0)] * 3000 + [(own, f"variant {k}", "en", "s", 0) for k in range(400)] + [(k, f"good day {k}", "en", "s", 0) for k in range(100, 200)]
    labels = spark.createDataFrame([(own, 0, 1), *((k, 1, 0) for k in range(100, 200))], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(documents(spark, rows), labels, 200).collect()
    assert 0 < len(got) <= 200
    again = toxicity.training_rows(documents(spark, rows[::-1]), labels, 200).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    # below the bound every row counts, repeated ones too
    assert toxicity.training_rows(documents(spark, rows[:50]), labels, 200).count() == 50
    assert toxicity.toxicity_scores(documents(spark, [*hard_rows(), *rows[:20]]), labels).count() == len(hard_rows()) + 20


def test_templates_that_no_fingerprint_names_cost_little():
    """Hundreds of templates whose words no document has: the index does not look at them."""
    rng = random.Random(4)
    more = {f"other-{k}": " ".join(f"z{rng.randrange(10**9)}q" for _ in range(60)) for k in range(488)}
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) + (" All rights reserved. " if k % 10 == 0 else "") for k in range(400)]

    def run(templates):
        index, memo = licenses.Index(templates, licenses.COVERAGE), licenses._Hashes()
        words = [np.fromiter(map(memo.__getitem__, licenses._word.findall(t)), np.uint64) for t in texts]
        began = time.process_time()
        hits = [(name, h) for w in words for name, at in index.candidates(w) for h in licenses.occurrences(index.words[name], w, at, index.need[name])]
        return time.process_time() - began, hits

    few, many = run(licenses.TEMPLATES), run(licenses.TEMPLATES | more)
    assert few[1] == many[1] and len(few[1]) >= 40 and many[0] < 2 * few[0] + 0.1
