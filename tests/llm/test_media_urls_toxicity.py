import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import media, toxicity, url_filter
from trendloom.llm.common import Scratch

from .helpers import SCHEMA, documents, hard_rows


def test_cuts_cover_and_follow_content():
    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(100_000))
    chunks = media.chunks_of(body)
    assert b"".join(chunks) == body and all(media.LEAST <= len(c) <= media.MOST for c in chunks[:-1])
    moved = media.chunks_of(b"prefix that moves all bytes" * 3 + body)
    assert len(set(map(media.digest, chunks)) & set(map(media.digest, moved))) > 0.9 * len(chunks)
    # the hash of a place depends on the last 32 bytes only
    h = 0
    for b in body[-32:]:
        h = (h << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
    full = 0
    for b in body:
        full = (full << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
    assert h == full


def test_media_columns(spark):
    rows = [*hard_rows(), *[(300 + k, "shared passage " * 300 + str(k), "en", "s", 1) for k in range(20)]]
    got = {}
    for r in media.media_columns(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc, text, *_ in rows:
        payload = media.padded(text)
        assert len(payload) % media.ALIGN == 0 and payload
        want = (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload) + 20, hashlib.sha256(media.header(len((text or "").encode()), len(payload)) + payload).hexdigest(), media.features(np.frombuffer(payload, np.uint8)))
        assert want in [tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) for r in got[doc]]
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_are_stored_once_and_verified(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(3000))
    rows = [(k, passage + str(k), "en", "s", 1) for k in range(20)]
    with Scratch(spark) as scratch:
        payloads, shared = media.store(documents(spark, rows), scratch)
        assert shared.count() == shared.select("digest").distinct().count() > 0
        own = payloads.select(F.explode("own").alias("c")).agg(F.sum(F.length("c"))).first()[0] or 0
        held = shared.agg(F.sum(F.length("chunk"))).first()[0]
        assert own + held < 0.2 * sum(len(r[1]) for r in rows)
        broken = shared.withColumn("chunk", F.lit(b"x"))
        with pytest.raises(Exception, match="does not match"):
            media.read_back(payloads, broken).collect()


URLS = [
    ("HTTP://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("http://b.com/en/1#t", "b.com", "/en/1", "com/en/", "block"), ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("http://x.net/de/", "x.net", "/de/", "net/de/", "block"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://h.org?p=/es/", "h.org", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
    ("http://x/://y/z", "x", "/://y/z", None, None), ("ftp://", "", "", None, None),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "<html>", "extra") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(pages, none).collect()}
    assert len(got) == len(URLS)
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == verdict or verdict is None and got[k]["verdict"] in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0), none).count() == 0


#: Each rule of the contract where it decides alone, where a longer one takes over, and where it does not fit; None: left to the method.
CONTRACT = [
    ("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/8", "com/en/", "block"), ("http://example.com/en/70", "example.com/en/7", "allow"), ("http://s.example.com/en/7", "example.com/en/7", "allow"),
    ("http://a.net/de/1", "net/de/", "allow"), ("http://net/de/8", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"), ("http://example.net/de/8", "example.net/de/8", "block"),
    ("http://s.example.net/de/80", "example.net/de/8", "block"), ("http://notexample.net/de/8", "net/de/", "allow"), ("http://a.org/es/1", "org/es/", "block"), ("http://a.net/en/1", None, None), ("http://a.net/de", None, None),
]


def test_rules_follow_the_contract(spark):
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(CONTRACT)], "page_id long, url string")
    # all outcomes bad and then all good, so that a rule's word holds against the method's verdict
    for good, method in ((0, "block"), (1, "allow")):
        outcomes = spark.createDataFrame([(k, good) for k in range(len(CONTRACT))], "page_id long, good int")
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, outcomes).collect()}
        assert got == {k: (rule, verdict or method) for k, (_, rule, verdict) in enumerate(CONTRACT)}


def test_reputation_shrinks(spark):
    rows = [(k, f"http://bad.site.org/{k}", 0) for k in range(40)] + [(100 + k, f"http://good.site.org/{k}", 1) for k in range(40)] + [(200 + k, f"http://h{k}.other.org/{k}", 1) for k in range(40)] + [(300, "http://new.site.org/", None), (301, "http://bad.site.org/x", None), (302, "http://one.more.org/", 0)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    outcomes = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, good int")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(pages, outcomes).collect()}
    assert got[301]["verdict"] == "block" and got[100]["verdict"] == "allow"
    assert got[301]["host_bound"] < got[302]["host_bound"] < got[100]["host_bound"]  # one bad page weighs less than forty
    assert got[301]["host_bound"] < got[300]["host_bound"] < got[100]["host_bound"]


def toxic_corpus(n=1200, seed=2):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "stupid", "zorgwat" + rng.choice("aeiou"), "kvempt"]))
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs, marks = documents(spark, [*rows, *[(10_000 + k, r[1], None, None, None) for k, r in enumerate(hard_rows())]]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    assert len(got) == len(rows) + len(hard_rows())
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    right = sum(p == t for p, t in held)
    assert len(held) > 200 and right / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[10_000]["predicted"] == 0 and got[10_000]["score"] == got[10_001]["score"]


def test_held_out_labels_do_not_matter(spark):
    rows, labels = toxic_corpus(300)
    docs = documents(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one, two = (toxicity.toxicity_scores(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert {r["doc_id"]: r["score"] for r in one.collect()} == {r["doc_id"]: r["score"] for r in two.collect()}


def test_toxicity_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(documents(spark, [(1, "you idiot", "en", "s", 1), (2, "good day", "en", "s", 1)]), none).collect()}
    assert got == {1: 1, 2: 0}
    odd = documents(spark).withColumns({"score": F.lit("own"), "predicted": F.lit(7)})
    kept = toxicity.without_toxic(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(hard_rows()) and kept.where("score = 'own'").count() == kept.count()
    assert toxicity.toxicity_scores(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_texts_that_share_a_word_count_each(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(400)]
    least = min(words, key=lambda w: toxicity.xxhash.xxh3_64_intdigest(w))
    assert toxicity.xxhash.xxh3_64_intdigest(least) < min(map(toxicity.xxhash.xxh3_64_intdigest, ("kvempt", "bzwolk")))
    rows, labels = [], []
    for k in range(200):
        toxic = k % 10 == 0
        # kvempt marks toxic texts only; bzwolk is in as many clean ones
        text = [least, *rng.sample(words, 12), *["kvempt"] * toxic, *["bzwolk"] * (toxic or k % 10 == 1)]
        rows += [(k, " ".join(text), "en", "s", 1), (1000 + k, " ".join(reversed(text)), "en", "s", 1)]
        labels += [(k, 1, int(toxic)), (1000 + k, 1, int(toxic))]
    stems = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).stems
    assert any("kvempt$".startswith(s) for s in stems) and not any("bzwolk$".startswith(s) for s in stems)


def test_capitals_and_patterns_without_stems_vote():
    model = toxicity.Model({"idiot$": 3})
    votes = lambda text: toxicity.votes_of(model.features(text, {})[None])[0].tolist()
    assert len(votes("")) == toxicity.VOTERS + toxicity.PATTERNS and 1 not in votes("good day") + votes("")
    assert votes("an idiot")[-4:] == [0, 0, 0, 0] and votes("an IDIOT")[-4:] == [1, 0, 0, 0]
    assert votes("WHAT WAS THAT")[-4:] == [0, 1, 0, 0] and votes("what??")[-4:] == [0, 0, 1, 0] and votes("You are such fun")[-4:] == [0, 0, 0, 1]


def test_label_model_knows_good_voters():
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.2
    vote = lambda a: np.where(rng.random(3000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)).astype(np.int8)
    first = vote(0.9)
    votes = np.column_stack([first, first, vote(0.85), vote(0.8), vote(0.6)])
    post, accuracy, weight = toxicity.label_model(votes, 0.2)
    assert ((post > 0.5) == truth).mean() > 0.93
    assert accuracy[2] > accuracy[4] and weight[0] < weight[2]  # a voter that repeats another counts for less
