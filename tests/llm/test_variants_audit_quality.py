import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from trendloom.llm import filter_audit, quality_rules, spelling

from .helpers import LOWER, SCHEMA, WORD, documents, hard_rows

# ---- spelling variants


def plain_words(rows, shortest, fewest):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words, times=5):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def got_variants(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def crowd(seed=1):
    """Documents of short words over few letters, so that many are one edit apart; some are far more frequent."""
    rng, out = random.Random(seed), []
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(3, 8))) for _ in range(120)]
    for k in range(300):
        words = [rng.choice(stems[: 1 + int(119 * rng.random() ** 4)]) for _ in range(30)]
        words[rng.randrange(30)] += rng.choice("abÉZ")
        out.append((k, " ".join(words), "en", "s", 0))
    return out


@pytest.mark.parametrize("block", [2, 64])
def test_variants_against_all_pairs(spark, block):
    rows = [*hard_rows(), *crowd()]
    words = plain_words(rows, 3, 1)
    assert got_variants(spelling.spelling_variants(documents(spark, rows), 3, 1, block=block)) == plain_variants(words)
    assert any(form for _, form, *_ in plain_variants(words))


def test_production_parameters_and_chains(spark):
    # longer and longer words, each five times as frequent as the one before; repeated rows and ids count
    chain = ["abcdef" + "g" * k for k in range(4)]
    rows = [(1, " ".join([w] * (5 * 5**k)), "en", "s", 0) for k, w in enumerate(chain)] + [(None, "abcdef" * 3, "en", "s", 0)] * 6
    want = plain_variants(plain_words(rows, 6, 5))
    got = got_variants(spelling.spelling_variants(documents(spark, rows)))
    assert got == want and {r[2] for r in got if r[0] in chain} == {chain[-1]}


def test_very_long_words_and_empty_tables(spark):
    long = "x" * 5000 + "y" * 5000
    rows = [(k, f"{long} {long[1:]} {long[:-1]}z {long + 'q'}", "en", "s", 0) for k in range(6)]
    assert got_variants(spelling.spelling_variants(documents(spark, rows))) == plain_variants(plain_words(rows, 6, 5))
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = documents(spark, rows).withColumns({c: F.lit("own") for c in ("word", "n", "block", "size", "near")})
    assert spelling.spelling_variants(odd).count() == len(plain_words(rows, 6, 5))


def test_crowded_blocks_are_subdivided(spark):
    """Words of one first half: blocks stay small, but those with one open place."""
    rng = random.Random(3)
    words = sorted({"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    rows = [(k, " ".join(words), "en", "s", 0) for k in range(5)]
    from trendloom.llm.common import Scratch

    with Scratch(spark) as scratch:
        counted = scratch.save(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
        sizes = spelling.blocks(counted, scratch, 16).groupBy("block").agg(F.count("*").alias("k")).select("block.*", "k").collect()
    assert all(r["k"] <= 16 or r["high"] - r["low"] == 1 for r in sizes) and max(r["k"] for r in sizes) <= 91
    assert {r["n_near"] > 0 for r in spelling.spelling_variants(documents(spark, rows)).collect()} == {True, False}


# ---- filter audit


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    docs = []
    for doc, text, lang, *_ in rows:
        t, w = text or "", WORD.findall(text or "")
        first = least.get(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), first is not None and (doc is None or doc > first)), strict=True) if bad}
        docs.append((lang or "", fails, doc in good, doc in toxic))
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    rng = random.Random(8)
    rows = hard_rows()
    base = [f"w{k}" for k in range(150)]
    for k in range(150):
        words = rng.sample(base, rng.randint(80, 150)) + ["again"] * rng.choice([0, 0, 40])
        text = " ".join(words)
        text = text.upper() if rng.random() < 0.2 else text + rng.choice(["", " $", " |"])
        rows += [(rng.choice([200 + k, 200, None]), text, rng.choice(["en", "de", None]), "s", 0)] * rng.choice([1, 1, 2])
        rows.append((500 + k, rng.choice(rows)[1], "de", "s", 0))
    return rows


@pytest.mark.parametrize("bits", [64, 2])
def test_audit_against_plain_version(spark, bits):
    rows = audit_rows()
    labels = [(k, k % 3 % 2, k % 5 % 2) for k in range(0, 700, 2)] + [(200, 1, 0), (200, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(documents(spark, rows), table, bits=bits)
    assert {tuple(r) for r in got.select(*AUDIT).collect()} == plain_audit(rows, labels)


def test_refinement_drops_what_differs_in_a_late_block(spark):
    long = "a" * 100_000
    assert len(filter_audit.block_hashes(long)) == 6 and filter_audit.block_hashes("") == [0]
    rows = [(k, long + c, "en", "s", 0) for k, c in enumerate("bcdd")]
    from trendloom.llm.common import Scratch

    with Scratch(spark) as scratch:
        judged = scratch.save(filter_audit.judged(documents(spark, rows), "lang"))
        assert {r["doc_id"] for r in filter_audit.refined(judged, scratch).collect()} == {2, 3}
        assert [r["doc_id"] for r in filter_audit.copies(documents(spark, rows), "lang", judged, scratch).collect()] == [3]


def test_audit_of_empty_tables_and_clashing_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    odd = documents(spark).withColumns({c: F.lit("own") for c in ("part", "mask", "class", "n", "step", "good", "toxic", "size", "blocks")})
    got = filter_audit.filter_audit(odd, labels.withColumn("part", F.lit("own")))
    assert {tuple(r) for r in got.select(*AUDIT).collect()} == plain_audit(hard_rows(), [])


# ---- quality rules


def plain_quality(text):
    t, words = text or "", WORD.findall(text or "")
    lines, seen, copies = [x for x in t.split("\n") if WORD.search(x)], [], 0
    lost = 0
    for line in lines:
        w = WORD.findall(line)
        bars = sum(x in ("|", ">", "»", "·", "•", "/") for x in w)
        menu = bars >= 2 and 5 * bars >= len(w)
        odd = 10 * len(re.findall(r"[#*$%&|<>]", line)) > len(w) or 5 * sum(x[-2:] in ("!!", "??") for x in w) > len(w) or (len(w) < 10 and w[-1][-1] not in ".!?…:;\"'”’»)。！？")
        if menu or odd or line in seen or re.search("|".join(quality_rules.PHRASES), line.translate(LOWER)):
            lost += sum(map(len, w))
        copies += line in seen
        seen.append(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    held = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", t)), copies, len(held), failed, not failed and 100 * lost <= 30 * chars)


def quality_texts():
    clean = "\n".join(" ".join(f"word{k * 12 + j}" for j in range(12)) + "." for k in range(8))
    return [
        clean, clean + "\nHome | About | Contact | Help", " | ".join(f"menu{k}" for k in range(80)), " ".join(f"w{k}###" for k in range(90)), " ".join(f"W{k}!!" for k in range(90)),
        clean.replace(".", ""), "\n".join(f"short line {k}" for k in range(40)), clean + "\n" + clean, "again and again " * 40, clean + "\n\n\r\n \nWe use Cookies to make this site better for all of you, who come here.",
        "é " * 60, "\n" * 50, "a b " * 60, clean + "\n«été» x", " ".join(["/"] * 60), clean + "\nwhat a day!!\nAll Rights Reserved.",
    ]


def test_quality_against_plain_version(spark):
    rows = [*hard_rows(), *((1000 + k, t, "en", "s", 0) for k, t in enumerate(quality_texts()))]
    got = quality_rules.quality_rules(documents(spark, rows))
    found = sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for r in got.collect())
    assert found == sorted((str(r[0]), *plain_quality(r[1])) for r in rows)
    kept = {r["doc_id"] for r in got.collect() if r["kept"]}
    assert {1000, 1001, 1009, 1015} <= kept and not {1002, 1003, 1004, 1006, 1008} & kept


def test_cleaned_texts_and_clashing_columns(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(quality_texts())]
    odd = documents(spark, rows).withColumns({c: F.col("doc_id") for c in ("row", "cleaned", "n_words", "kept")})
    out = quality_rules.cleaned(odd)
    assert out.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in out.where("kept = doc_id and cleaned = doc_id and n_words = doc_id").collect()}
    assert texts[0] == rows[0][1] and texts[1] == rows[0][1] and "Cookies" not in texts[9] and texts[9].endswith("\n\n\r\n ")
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_of_three(spark):
    assert quality_rules.repeated_words([b"a"] * 3) == 0 and quality_rules.repeated_words([b"a"] * 4) == 4
    assert quality_rules.repeated_words(b"a b c x a b c".split()) == 6 and quality_rules.repeated_words(b"a b c b a".split()) == 0
