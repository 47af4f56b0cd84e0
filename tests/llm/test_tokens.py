import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trendloom.llm import packing, sentence_pieces, token_counts, wordcodec
from trendloom.llm.bytebpe import ByteBpe, loaded
from trendloom.llm.wordcodec import HashTable

from .helpers import SCHEMA, documents, hard_rows

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
library = Tokenizer.from_file(JSON)
pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SIGNS = [*"ab 's't're  \n\n\t'lld'm'vé1２½!?ß中 　\x1c\x00\x85 ", "<|endoftext|>", "'re", "'ll", "  ", " \n", "the", "ing", "▁", "<s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=30).map("".join))
def test_ids_like_the_library(text):
    assert loaded(JSON).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert loaded(JSON).counts([text])[0] == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=30).map("".join))
def test_pieces_like_the_library(text):
    model = sentence_pieces.loaded(MODEL)
    ids = model.encode([text])[0].tolist()
    assert ids == pieces.encode(text)
    assert model.decode(ids) == pieces.decode(ids)


def test_long_texts_are_cut_without_effect():
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "be  ta", "ga'm", "d\n"]) for _ in range(400_000))
    assert loaded(JSON).encode([text, "x"])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sentence_pieces.loaded(MODEL).encode([text])[0].tolist() == pieces.encode(text)


def test_hash_table():
    rng = np.random.default_rng(3)
    table, keys = HashTable(4), np.unique(rng.integers(1, 1 << 63, 5000, dtype=np.uint64))
    table.add(keys[:100])
    table.add(keys[100:3000])
    assert table.find(keys[:3000]).tolist() == list(range(3000)) and (table.find(keys[3000:]) == -1).all()


def test_token_counts(spark):
    got = token_counts.token_counts(documents(spark), JSON, limit=20).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 20) for r in hard_rows() for n in [len(library.encode(r[1] or "", add_special_tokens=False).ids)]]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), JSON).count() == 0


def check_pieces(got, rows, window):
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        if len(ids[doc]) > 1:
            continue  # a repeated id: its pieces can't be told apart
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            part = np.asarray(ids[doc][0][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[doc][0]), zlib.crc32(part.tobytes())) and r["length"] > 0
            at += r["length"]
        assert at == len(ids[doc][0])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    return by_sequence


def test_packing(spark):
    rows = hard_rows()
    got = packing.pack(documents(spark).coalesce(1), JSON, with_ids=True).collect()
    sequences = check_pieces(got, rows, 2048)
    assert sum(sum(r["length"] for r in p) < 2048 for p in sequences.values()) <= 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), JSON).count() == 0


def test_choice_minimises_the_sum_of_squares():
    rng = random.Random(5)
    for _ in range(200):
        packer = packing.Packer(16, lambda *a: None, iter(range(10**9)))
        packer.levels[1:16] = [rng.randint(0, 4) for _ in range(15)]
        size = rng.randint(1, 15)

        def after(fill, counts, size=size):
            new = counts.copy()
            new[fill] -= fill > 0
            new[fill + size] += fill + size < 16
            return int((new[1:16] ** 2).sum())

        options = {h: after(h, packer.levels) for h in range(17 - size) if h == 0 or packer.levels[h]}
        assert options[packer.choose(size)] == min(options.values())


def test_windows_are_filled():
    rng = random.Random(6)
    got = []
    packer = packing.Packer(64, lambda s, d, start, ids, total, o: got.append((s, d, start, len(ids), o)), iter(range(10**9)))
    sizes = [rng.randint(1, 150) for _ in range(500)]
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n))
    packer.close()
    fill = defaultdict(int)
    for s, _, _, n, _ in got:
        fill[s] += n
    assert sum(fill.values()) == sum(sizes) and sum(v < 64 for v in fill.values()) <= 1


def test_sentence_pieces(spark):
    got = {r["doc_id"]: r for r in sentence_pieces.round_trip(documents(spark), MODEL).where("doc_id < 30").collect()}
    for doc, text, *_ in hard_rows():
        if doc is not None and doc < 30:
            ids = pieces.encode(text or "")
            assert (got[doc]["n_pieces"], got[doc]["ids_crc32"]) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
            assert got[doc]["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
    encoded = sentence_pieces.encode(documents(spark), MODEL)
    assert sentence_pieces.decode(encoded, MODEL).where("doc_id = 10").first()["text"] == hard_rows()[10][1]
    assert sentence_pieces.round_trip(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError)):
        loaded(public_tokenizers.path("word_bpe_49k.json"))


def packed(n, most_open=packing.OPEN):
    """A packer that has had n documents, its most open windows, and all tokens."""
    rng = random.Random(7)
    packer, most, tokens = packing.Packer(2048, lambda *a: None, iter(range(10**9)), most_open), 0, 0
    for k in range(n):
        size = int(min(20_000, rng.lognormvariate(6.5, 0.9))) + 1
        packer.add(k, np.zeros(size, np.int32))
        most, tokens = max(most, int(packer.levels.sum())), tokens + size
    assert most == max(most, sum(map(len, packer.open)))
    packer.close()
    return packer, most, tokens


def test_the_rule_fills_most_windows():
    """By the rule alone; what it leaves to the end grows far slower than the documents."""
    small, large = packed(5_000), packed(20_000)
    for packer, most, tokens in (small, large):
        assert packer.by_force == 0 and most < 1000 and packer.by_rule + packer.by_close == tokens
    assert large[0].by_rule >= 0.9 * large[2] and large[1] < 1.5 * small[1]


def test_memory_bounds_open_windows():
    packer, most, tokens = packed(2_000, 16)
    assert most <= 17 and packer.by_force > 0 and packer.by_rule + packer.by_force + packer.by_close == tokens


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    """Words that exchange two letters by the Thue-Morse rule, side by side in one text, against the libraries."""
    texts = []
    for x, y in ("ab", "zo", "et"):
        a = x
        while len(a) < 1024:
            a += a.translate(str.maketrans(x + y, y + x))
        texts.append(a + "\n" + a.translate(str.maketrans(x + y, y + x)))
    library = Tokenizer.from_file(JSON)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ByteBpe(JSON).encode(texts)] == want
    docs = documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, JSON).collect()} == dict(enumerate(map(len, want)))
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"]: r["ids"] for r in sentence_pieces.encode(docs, MODEL).collect()} == dict(enumerate(pieces.encode(texts)))


def test_words_that_share_the_first_hash_are_told_apart(monkeypatch):
    real = wordcodec.word_hashes
    monkeypatch.setattr(wordcodec, "word_hashes", lambda *a: ((real(*a)[0] & np.uint64(15)) + np.uint64(1), real(*a)[1]))
    texts = [t or "" for _, t, *_ in hard_rows()]
    library = Tokenizer.from_file(JSON)
    assert [x.tolist() for x in ByteBpe(JSON).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
