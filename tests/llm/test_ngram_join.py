import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.llm import ngram_join
from trendloom.llm.common import Scratch
from trendloom.llm.components import components as closed

from .helpers import SCHEMA, components, documents, hard_rows, shingle_sets


def plain(rows, n, p):
    sets = shingle_sets(rows, n)
    own = components(sets, p)
    least = {}
    for k, c in enumerate(own):
        least[c] = min([i for i in (least.get(c), rows[k][0]) if i is not None], default=None)
    return sorted(((r[0], len(s), least[c] if s else r[0]) for r, s, c in zip(rows, sets, own, strict=True)), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near_groups(seed):
    """Groups of edited copies at many distances, and chains in which only neighbours are linked."""
    rng = random.Random(seed)
    rows, k = [], 0
    for size in (3, 12, 25, 60, 150, 400):
        base = [f"{rng.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                copy[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
            rows.append((k, " ".join(copy), "en", "s", 1))
            k += 1
        chain = list(base)
        for _ in range(6):
            at = rng.randrange(max(1, size - 3))
            chain = chain[:at] + [f"c{rng.randint(0, 10**6)}"] + chain[at + 1 :]
            rows.append((k, " ".join(chain), "en", "s", 1))
            k += 1
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    for rows, n, p in ((hard_rows(), 3, 90), (near_groups(1), 3, 90), (near_groups(2), 5, 80)):
        assert found(ngram_join.similar_documents(documents(spark, rows), n, p)) == plain(rows, n, p)


def test_dense_group_of_many_components(spark):
    """Copies that share most groups of a block but are no links of each other."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(120), 4):
            copy[at] = f"x{k}-{at}"
        rows.append((k, " ".join(copy), "en", "s", 1))
    assert found(ngram_join.similar_documents(documents(spark, rows))) == plain(rows, 3, 90)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.similar_documents(empty).count() == 0 and ngram_join.without_near_copies(empty).count() == 0
    odd = documents(spark).withColumns({"row": F.lit(1), "id": F.lit(3), "_keep": F.lit("x"), "content": F.lit(None).cast("int"), "text_hash": F.lit(2), "n": F.lit(2), "keys": F.lit("k"), "sig": F.lit(0), "cls": F.lit(1)})
    kept = ngram_join.without_near_copies(odd)
    assert kept.columns == odd.columns
    rows = hard_rows()
    least = {(c if n else ("none", i)) for i, n, c in plain(rows, 5, 80)}
    assert {r["doc_id"] for r in kept.select("doc_id").distinct().collect()} == {x[1] if isinstance(x, tuple) else x for x in least}


def test_near_copies_with_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(100)]
    near = [" ".join([*words[:k], "edit", *words[k + 1 :]]) for k in (3, 96)]
    texts = [(None, " ".join(words)), (None, near[0]), (None, near[1]), (None, None), (None, ""), (5, "some other words that stand alone here"), (5, near[0]), (5, "some other words that stand alone here"), (6, ""), (6, "")]
    got = ngram_join.without_near_copies(documents(spark, [(i, t, "en", "s", 1) for i, t in texts])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, None), (None, ""), (5, "some other words that stand alone here"), (5, near[0]), (6, ""), (6, "")], key=str)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(5, 300))
def test_linked_sets_share_a_prefix(seed, size):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    most = int(len(a) / 4)
    b = np.unique(np.concatenate([a[rng.integers(0, most + 1) :], rng.integers(0, 1 << 63, rng.integers(0, most + 1), dtype=np.uint64)]))
    order = ngram_join.Order(a[rng.random(len(a)) < 0.3])
    shared = len(np.intersect1d(a, b))
    for p in (80, 90):
        if 100 * shared >= p * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
            x, y = (order.prefix(s, ngram_join.prefix_length(len(s), p)) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_points_bound_the_overlap_at_any_fold():
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(rng.choice(universe, n)) for n in (20, 90, 300, 800, 2500)]
    sizes = np.array([len(s) for s in sets])
    points = ngram_join.unpacked([ngram_join.point(s).tobytes() for s in sets], sizes)
    assert points.sum(axis=1).tolist() == sizes.tolist() and points.shape[1] == ngram_join.groups_of(int(sizes.min()))
    for a in range(5):
        for b in range(5):
            assert len(np.intersect1d(sets[a], sets[b])) <= np.minimum(points[a], points[b]).sum()


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in rng.integers(60, 80, 300)]
    sizes, own = np.array([len(s) for s in sets]), rng.integers(0, 40, 300)
    points = ngram_join.unpacked([ngram_join.point(s).tobytes() for s in sets], sizes)[:, :8]
    tree = ngram_join.CountTree(points, sizes, own)
    for q in range(0, 300, 7):
        bound = np.minimum(points, points[q]).sum(axis=1)
        fits = ngram_join.may_link(bound, sizes + sizes[q], 70) & (100 * sizes >= 70 * sizes[q]) & (70 * sizes <= 100 * sizes[q])
        for component in (-1, int(own[q])):
            got = set(tree.search(points[q], int(sizes[q]), component, 70)[0].tolist())
            assert set(np.flatnonzero(fits & (own != component)).tolist()) <= got
            assert all(ngram_join.may_link(bound[k], sizes[k] + sizes[q], 70) and own[k] != component for k in got)


def test_large_blocks_are_dealt_in_tiles(spark):
    """Groups of a hundred copies of which neighbours alone are linked, in tiles of 40: trees, pivots and both later searches."""
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"g{g}-{k}" for k in range(90)]
        for k in range(100):
            copy = list(base)
            for at in rng.sample(range(90), rng.randint(0, 3)):
                copy[at] = f"x{g}-{k % (9 + g)}-{at}"
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    rng.shuffle(rows)
    docs, want = documents(spark, rows), plain(rows, 3, 90)
    assert len({c for _, _, c in want}) > 6
    assert found(ngram_join.similar_documents(docs, tile=40)) == want == found(ngram_join.similar_documents(docs))


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    """Two words of 1024 letters that exchange two letters by the Thue-Morse rule: a polynomial hash modulo 2**64 is the same for both."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(10))
    rows = [(1, f"{a} {rest}", "en", "s", 1), (2, f"{b} {rest}", "en", "s", 1), (3, f"{b}  {rest}", "en", "s", 1)]
    assert [c for _, _, c in found(ngram_join.similar_documents(documents(spark, rows)))] == [1, 2, 2]


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 80)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    with Scratch(spark) as scratch:
        got = {r["node"]: r["component"] for r in closed(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
