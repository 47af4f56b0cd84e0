"""Jaccard join of word n-gram sets over count vectors in R-trees.

A document is the set of its distinct word shingles, as 64-bit hashes. Equal sets are one class, and from here on
a class stands for its documents.

- Two sets of similarity p % share one of the first a - ceil(p a / 100) + 1 shingles of each, in any order that is the same for all
  sets. The order here puts shingles last that are common in a sample of documents (SAMPLE). Classes that
  share such a shingle form a block, and blocks with the same members are one: pairs meet nowhere else, and
  no link is missed, whatever the sample holds.
- The tokens (shingles) of a set are hashed into groups, so many that unrelated sets stand out. The numbers of tokens in each
  group are its point, and the sum of the smaller coordinates of two points bounds the overlap of their sets from above.
- The points of every block are packed into an R-tree (tiles of about TILE points where a block is larger), and each
  point searches it. Subtrees whose largest coordinates bound the overlap below the threshold are skipped. Of the
  pairs that survive, each class is held against the one with the highest bound among the classes before it, so that a group
  of copies gives as many pairs as it has members.
- Pairs are verified on the whole texts; links are closed to components by large and small stars.
- Blocks whose surviving pairs are still in several components are searched again: now
  points outside the block's main component ask for points of other components, whose subtrees are skipped if they
  hold the asker's own component only. These points have FINER times as many groups, which leaves few pairs just below
  the threshold. First the FEW highest bounds for each other component are verified, at last all.

Hot blocks are dealt in tiles and hot keys in joins by hot_join; pairs within a class or a component are not made.

Defined results: a null or empty text, or one of white space, has an empty set, no links and its own id as
component; with fewer words than n the sequence of all words is the one shingle; texts of any length are taken whole; rows that
repeat are members of one class; a null doc_id is larger than any other; an empty table gives an empty table; columns besides
doc_id and text may have any names. Two different shingles share a hash by chance only, 2**-64 a pair; sets
count as equal if 128 bits of them are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_map, content_hash, hot_join, in_map, maybe_broadcast, whole_row
from .components import components
from .wordcodec import BLOCK, mixed, word_hashes

#: Points of a tile, of a leaf and children of a node; pivots of a block of several tiles; pairs for a component in the second search.
TILE, LEAF, FANOUT, PIVOTS, FEW = 2048, 32, 16, 16, 4
#: Pairs that are verified together, and partners for each copy of a text.
TOGETHER, PARTNERS = 64, 64
#: Groups of a point in the later searches, for each group in the first.
FINER = 8
#: Documents of the sample: one in SAMPLE[0], SAMPLE[1] at least and SAMPLE[2] at most; how many of them have a shingle that
#: counts as common, and how many of those are known at most.
SAMPLE, COMMON, MOST_COMMON = (16, 1 << 12, 1 << 17), 6, 1 << 18
#: Blocks whose keys may be joined by broadcast: the largest ones.
HOT_BLOCKS = 1 << 12
#: Sets that a task remembers so as not to list the shingles of copies again.
MEMO = 1 << 17


def _word_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text's words end."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(space, prepend=True, append=True)
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts])
    return word_hashes(points, starts, ends)[0], np.searchsorted(starts, limits)


def shingles(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < BLOCK):
            part.append(texts[at] or "")
            size += len(part[-1])
            at += 1
        words, ends = _word_arrays(part)
        words = mixed(words)
        whole = words[: max(0, len(words) - n + 1)]
        for k in range(1, n):
            whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
        begin = 0
        for end in ends.tolist():
            if end - begin >= n:
                yield np.unique(whole[begin : end - n + 1])
            elif end > begin:
                x = words[begin : begin + 1] + np.uint64(end - begin)
                for k in range(begin + 1, end):
                    x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + words[k : k + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)
            begin = end


def prefix_length(n: int, p: int) -> int:
    """How many shingles of a set of n, from the first on, hold one of any set linked with it; 0 if only equal sets link."""
    need = -(-p * n // 100)
    return 0 if need == n and 100 * n // p == n else n - need + 1


class Order:
    """The order of shingles: rare ones by a mix of their hash, then the common ones."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.common & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def prefix(self, found: np.ndarray, length: int) -> np.ndarray:
        """The first ``length`` of a set's shingles, mixed."""
        if not length:
            return found[:0]
        late = self.maybe[(found & np.uint64(len(self.maybe) - 1)).astype(np.int64)]
        at = np.flatnonzero(late)
        if len(at):
            near = np.minimum(np.searchsorted(self.common, found[at]), len(self.common) - 1)
            late[at] = self.common[near] == found[at]
        early = np.sort(mixed(found[~late]))[:length]
        return early if len(early) == length else np.concatenate([early, np.sort(mixed(found[late]))[: length - len(early)]])


def groups_of(n: int) -> int:
    """As many groups as put the bound of unrelated sets of n shingles some four deviations below 80 %, rounded up to a power of two."""
    return 1 << max(5, (int((3 + 0.2 * math.sqrt(n)) ** 2) - 1).bit_length())


def point(found: np.ndarray, finer: int = 1) -> np.ndarray:
    """Numbers of shingles by the low bits of their hashes, in as few bytes as they fit."""
    groups = finer * groups_of(len(found))
    counts = np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.min_scalar_type(counts.max(initial=0)))


def unpacked(points: list[bytes], sizes: np.ndarray, finer: int = 1) -> np.ndarray:
    """Points as the rows of a matrix, folded to the fewest groups that one of them has."""
    groups = finer * min(map(groups_of, sizes.tolist()))
    out = np.empty((len(points), groups), np.uint32)
    shapes = np.array([len(x) * (1 << 24) + finer * groups_of(n) for x, n in zip(points, sizes.tolist(), strict=True)])
    for shape in np.unique(shapes):
        at, own = np.flatnonzero(shapes == shape), int(shape) % (1 << 24)
        flat = np.frombuffer(b"".join([points[k] for k in at.tolist()]), f"<u{int(shape) // (1 << 24) // own}")
        out[at] = flat.reshape(len(at), own // groups, groups).sum(axis=1, dtype=np.uint32)
    return out


def may_link(shared: np.ndarray | int, sizes: np.ndarray | int, p: int):
    """Whether sets of together ``sizes`` shingles that share ``shared`` reach p %."""
    return (100 + p) * shared >= p * sizes


class CountTree:
    """R-tree over points, packed by sorting: leaves of LEAF points, nodes of FANOUT children.

    Points are sorted by component, size and the side of the median on which their first coordinates lie, so that copies
    come together. Every node keeps the largest coordinates, the range of set sizes and the one component below it, if there is one only.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        some = points[:, :16]
        sides = (some > np.median(some, axis=0)) @ (1 << np.arange(some.shape[1]))
        order = np.lexsort((sides, sizes // np.maximum(1, sizes.max() // 16), component))
        self.order, self.points, self.sizes, self.component = order, points[order], sizes[order], component[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        tops, low, high, own, step = self.points, self.sizes, self.sizes, self.component, LEAF
        while True:
            at = np.arange(0, len(tops), step)
            same = np.minimum.reduceat(own, at) == np.maximum.reduceat(own, at)
            tops, low, high, own = np.maximum.reduceat(tops, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(same, own[at], -1)
            self.levels.append((tops, low, high, own))
            if len(tops) == 1:
                break
            step = FANOUT

    def search(self, q: np.ndarray, size: int, component: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the points of other components whose overlap bound allows a link with q, and that bound as a share of both sizes.

        A component of -1 is none of theirs."""
        going = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            tops, low, high, own = (x[going] for x in self.levels[level])
            fits = ((own != component) | (component < 0)) & (100 * high >= p * size) & (p * low <= 100 * size)
            going, tops, low = going[fits], tops[fits], low[fits]
            bound = np.minimum(tops, q).sum(axis=1, dtype=np.int64)
            going = going[may_link(bound, size + np.maximum(low, -(-p * size // 100)), p)]
            fan, limit = (FANOUT, len(self.levels[level - 1][0])) if level else (LEAF, len(self.points))
            going = (going[:, None] * fan + np.arange(fan)).ravel()
            going = going[going < limit]
            if not len(going):
                return going, np.zeros(0)
        going = going[(self.component[going] != component) | (component < 0)]
        bound, both = np.minimum(self.points[going], q).sum(axis=1, dtype=np.int64), size + self.sizes[going]
        good = may_link(bound, both, p)
        return self.order[going[good]], bound[good] / both[good]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), content_hash(docs).alias("content"), F.col("text"))


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles of COMMON documents or more of a sample, MOST_COMMON of them at most; they decide about speed only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0, np.uint64), *shingles(batch.column(0).to_pylist(), n)])
            keys, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32))], ["shingle", "n"])

    total = docs.count()
    one_in = max(1, total // min(max(total // SAMPLE[0], SAMPLE[1]), SAMPLE[2]))
    sample = docs.select("text", F.monotonically_increasing_id().alias("row")).where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select("text")
    counted = sample.mapInArrow(run, "shingle long, n int").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    return counted.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64)


def _sets(docs: DataFrame, n: int, p: int) -> DataFrame:
    """row, doc_id, text_hash, content, n, s1, s2, point, fine, keys for each row; a task lists the point and keys of a repeated set once."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, n))
    names = ["row", "doc_id", "text_hash", "content", "n", "s1", "s2", "point", "fine", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(common.value), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, digests, points, fine, keys = [], [], [], [], []
                for found in shingles(part.column(4).to_pylist(), n):
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    length = 0 if digest in seen else prefix_length(len(found), p)
                    if len(seen) >= MEMO:
                        seen.clear()
                    seen.add(digest)
                    sizes.append(len(found))
                    digests.append(digest)
                    keys.append(order.prefix(found, length))
                    points.append(point(found).tobytes() if length else None)
                    fine.append(point(found, FINER).tobytes() if length else None)
                halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), flat], names)

    rows = _texts(docs).select(F.monotonically_increasing_id().alias("row"), "*")
    return rows.mapInArrow(run, "row long, doc_id long, text_hash long, content long, n long, s1 long, s2 long, point binary, fine binary, keys array<long>")


def _verify(n: int, p: int):
    """Rows bucket, a, b, part, text: the text of a class a, or of b where a is null. Gives the pairs (a, b) that reach p %."""

    def run(table: pa.Table) -> pa.Table:
        a, b, part = (table[c].to_pylist() for c in ("a", "b", "part"))
        rows = {(x, y, z): k for k, (x, y, z) in enumerate(zip(a, b, part, strict=True))}  # of repeated rows one
        kept = sorted(rows.items(), key=lambda x: (x[0][1], x[0][2], x[0][0] is not None))
        out, last, other = [], None, None
        for at in range(0, len(kept), 32):
            some = kept[at : at + 32]
            for ((x, y, z), _), own in zip(some, shingles(table["text"].take([k for _, k in some]).to_pylist(), n), strict=True):
                if x is None:
                    last, other = (y, z), own
                elif last == (y, z) and may_link(len(np.intersect1d(own, other, assume_unique=True)), len(own) + len(other), p):
                    out.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, unique: bool, n: int, p: int, scratch: Scratch) -> DataFrame:
    """Those of pairs (a, b) whose sets reach p %. Each text moves once for each pair as a, and once for PARTNERS pairs as b."""
    total = pairs.count()
    parts = scratch.save(pairs.groupBy("b").agg(F.count("*").alias("partners")).withColumn("parts", F.ceil(F.col("partners") / PARTNERS).cast("int")))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")
    as_a = hot_join(pairs, parts, "b", "partners", total).select(F.col("a").alias("cls"), "a", "b", part)
    as_b = parts.select(F.col("b").alias("cls"), F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    roles = as_a.unionByName(as_b).join(classes.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_text")), "cls")
    roles = maybe_broadcast(scratch.save(roles))
    buckets = max(1, total // TOGETHER)
    bucket = F.pmod(F.xxhash64("b", "part"), F.lit(buckets)).alias("bucket")
    texts = _texts(docs).join(roles, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_text"))).select(bucket, "a", "b", "part", "text")
    texts = texts if unique else texts.dropDuplicates(["bucket", "a", "b", "part"])
    return scratch.save(texts.groupBy("bucket").applyInArrow(_verify(n, p), "a long, b long").distinct())


def _listed(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """cls, key of the classes' keys that are in blocks, and of few others."""
    held = table.sparkSession.sparkContext.broadcast(bit_map(blocks.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            kept = in_map(held.value, keys)
            yield pa.RecordBatch.from_arrays([pa.array(rows[kept]), pa.array(keys[kept])], ["cls", "key"])

    return table.select("cls", "keys").mapInArrow(run, "cls long, key long")


def _tiles(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Key and row numbers of each tile of a bucket, in the order of classes."""
    key, tile, cls = (table[c].to_numpy() for c in ("key", "tile", "cls"))
    order = np.lexsort((cls, tile, key))
    cuts = np.flatnonzero((key[order][1:] != key[order][:-1]) | (tile[order][1:] != tile[order][:-1])) + 1
    for part in np.split(order, cuts):
        yield int(key[part[0]]), part


def _first_search(p: int):
    """Searches of all tiles of a bucket: rows bucket, key, tile, cls, n, point. Gives pairs (a, b, share): for each class a the one
    of the highest bound before it in its tile; and the members (key, a) of blocks that have a partner there at all."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, n, raw = table["cls"].to_numpy(), table["n"].to_numpy(), table["point"].to_pylist()
        none = np.zeros(0, np.int64)
        a_out, b_out, share_out, key_out, member_out = [none], [none], [np.zeros(0)], [none], [none]
        for key, part in _tiles(table):
            if len(part) < 2:
                continue
            points, sizes = unpacked([raw[k] for k in part.tolist()], n[part]), n[part]
            partnered = np.zeros(len(part), bool)
            if len(part) <= LEAF:  # one leaf
                bound = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64)
                both = sizes[:, None] + sizes[None]
                good = np.tril(may_link(bound, both, p), -1)
                later = np.flatnonzero(good.any(axis=1))
                if len(later):
                    share = np.where(good, bound / both, -1)[later]
                    best = share.argmax(axis=1)
                    partnered = good.any(axis=1) | good.any(axis=0)
                    a_out.append(cls[part[later]])
                    b_out.append(cls[part[best]])
                    share_out.append(share.max(axis=1))
            else:
                tree = CountTree(points, sizes, np.zeros(len(part), np.int64))
                for q in range(1, len(part)):
                    hits, share = tree.search(points[q], int(sizes[q]), -1, p)
                    before = hits < q
                    if before.any():
                        hits, share = hits[before], share[before]
                        partnered[q] = partnered[hits] = True
                        best = share.argmax()
                        a_out.append(cls[part[[q]]])
                        b_out.append(cls[part[hits[[best]]]])
                        share_out.append(share[[best]])
            if partnered.any():
                member_out.append(cls[part[partnered]])
                key_out.append(np.full(partnered.sum(), key))
        a, b, share, key, member = map(np.concatenate, (a_out, b_out, share_out, key_out, member_out))
        empty = lambda k, kind: pa.nulls(k, kind)
        columns = [[pa.array(a), pa.array(member)], [pa.array(b), empty(len(key), pa.int64())], [pa.array(share), empty(len(key), pa.float64())], [empty(len(a), pa.int64()), pa.array(key)]]
        return pa.table([pa.chunked_array(x) for x in columns], ["a", "b", "share", "key"])

    return run


def _next_search(p: int, most: int | None):
    """Searches of all tiles of a bucket: rows bucket, key, tile, asks, cls, n, component, point. Gives, for each asking point and
    component other than its own, the ``most`` pairs of the highest bound, or all."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, cls, n, component, raw = (table[c].to_numpy(zero_copy_only=False) for c in ("asks", "cls", "n", "component", "point"))
        a_out, b_out = [], []
        for _, part in _tiles(table):
            own = asks[part].astype(bool)
            if own.all() or not own.any():
                continue
            points = unpacked([raw[k] for k in part.tolist()], n[part], FINER)
            held, asking = np.flatnonzero(~own), np.flatnonzero(own)
            tree = CountTree(points[held], n[part[held]], component[part[held]])
            for q in asking.tolist():
                hits, share = tree.search(points[q], int(n[part[q]]), int(component[part[q]]), p)
                hits = part[held[hits]]
                if most and len(hits):
                    order = np.lexsort((-share, component[hits]))
                    of = component[hits[order]]
                    rank = np.arange(len(of)) - np.searchsorted(of, of)
                    hits = hits[order[rank < most]]
                a_out.append(np.full(len(hits), cls[part[q]]))
                b_out.append(cls[hits])
        none = np.zeros(0, np.int64)
        a, b = np.concatenate([none, *a_out]), np.concatenate([none, *b_out])
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.table({"a": both[0], "b": both[1]})

    return run


def _bucketed(tiles: DataFrame, points: DataFrame, rows: int, *columns: str) -> DataFrame:
    """tiles with n and point of each class, grouped by buckets of some tiles."""
    buckets = max(1, -(-rows // TILE))
    return tiles.join(points, "cls").select(F.pmod(F.xxhash64("key", "tile"), F.lit(buckets)).alias("bucket"), "key", "tile", *columns, "cls", "n", "point").groupBy("bucket")


def links(docs: DataFrame, n: int, p: int, scratch: Scratch, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, text_hash, content, n, sig), classes (sig, cls, rep, members) and the components of linked classes (node, component)."""
    table = scratch.save(_sets(docs, n, p)).withColumn("sig", F.struct("s1", "s2"))
    listed = F.col("point").isNotNull()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content", "text_hash")).alias("rep")
    # cls is a row that lists the set's keys, if only equal sets link it is any row
    of_sig = table.where("n > 0").groupBy("sig").agg(first, F.count("*").alias("members"), F.coalesce(F.min(F.when(listed, F.col("row"))), F.min("row")).alias("cls"), F.count(F.when(listed, 1)).alias("lists"))
    classes = scratch.save(of_sig)
    again = table.where(listed).join(classes.where("lists > 1").select("sig", "cls"), "sig").where("row <> cls").select("row")
    keyed = table.where(listed).select("row", "n", "point", "fine", "keys").join(maybe_broadcast(scratch.save(again)), "row", "left_anti").withColumnRenamed("row", "cls")

    # blocks of at least two, those with the same members once
    keys = keyed.select("cls", F.explode("keys").alias("key"))
    blocks = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("all")).where("size > 1")
    blocks = scratch.save(blocks.groupBy("size", "all").agg(F.min("key").alias("key")).select("key", "size"))
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    members = scratch.save(hot_join(_listed(keyed, blocks), blocks, "key", "size", total, HOT_BLOCKS))
    points, fine = keyed.select("cls", "n", "point"), keyed.select("cls", "n", F.col("fine").alias("point"))

    # every point searches the tree of its tile; in blocks of several tiles some pivots are in all of them
    chunks = F.ceil(F.col("size") / tile).cast("int")
    own = F.array(F.pmod(F.xxhash64("cls"), chunks).cast("int"))
    pivot = (F.col("size") > tile) & (F.pmod(F.xxhash64("cls", F.lit(5)), F.col("size")) < PIVOTS)
    tiles = members.select("key", "cls", F.explode(F.when(pivot, F.sequence(F.lit(0), chunks - 1)).otherwise(own)).alias("tile"))
    found = scratch.save(_bucketed(tiles, points, total).applyInArrow(_first_search(p), "a long, b long, share double, key long"))
    best = found.where("key is null").groupBy("a").agg(F.max(F.struct("share", "b")).alias("best"))
    pairs = scratch.save(best.select("a", F.col("best.b").alias("b")))
    unique = table.select("doc_id", "text_hash").distinct().count() == table.count()
    joined = components(_verified(pairs, docs, classes, unique, n, p, scratch), scratch)

    # what may still be linked: members with partners in their tile, and those of blocks of several tiles
    rest = scratch.save(found.where("key is not null").select("key", F.col("a").alias("cls")).union(members.where(F.col("size") > tile).select("key", "cls")).distinct())
    for most in (FEW, None):
        placed = rest.join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        placed = scratch.save(placed)
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("own"))
        mixed_ = parts.groupBy("key").agg(F.max(F.struct("own", "component")).alias("top"), F.count("*").alias("parts"), F.sum("own").alias("size")).where("parts > 1")
        mixed_ = scratch.save(mixed_.select("key", "size", F.col("top.component").alias("main"), (F.col("size") - F.col("top.own")).alias("askers"), F.ceil(F.col("size") / tile).cast("int").alias("held_chunks"), F.ceil((F.col("size") - F.col("top.own")) / tile).cast("int").alias("ask_chunks")))
        total = mixed_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if not total:
            break
        rest = scratch.save(hot_join(placed, mixed_, "key", "size", total))
        n_rows = mixed_.agg(F.sum(F.col("size") * F.col("ask_chunks") + F.col("askers") * F.col("held_chunks"))).first()[0]
        chunk = lambda salt, of: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(of)).cast("int")  # noqa: E731, B023
        held = rest.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("ask_chunks") - 1), lambda k: chunk(2, "held_chunks") + F.col("held_chunks") * k)).alias("tile"), F.lit(False).alias("asks"), "cls", "component")
        ask = rest.where(F.col("component") != F.col("main")).select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("held_chunks") - 1), lambda k: chunk(3, "ask_chunks") * F.col("held_chunks") + k)).alias("tile"), F.lit(True).alias("asks"), "cls", "component")
        more = _bucketed(held.unionByName(ask), fine, n_rows, "asks", "component").applyInArrow(_next_search(p, most), "a long, b long")
        more = scratch.save(more.distinct().join(pairs, ["a", "b"], "left_anti"))
        rest = rest.select("key", "cls")
        if more.isEmpty():
            continue
        pairs = scratch.save(pairs.unionByName(more))
        # the stars found so far stand for their links, so that few rounds are left
        joined = components(joined.toDF("a", "b").unionByName(_verified(more, docs, classes, unique, n, p, scratch)), scratch)
    return table.select("row", "doc_id", "text_hash", "content", "n", "sig"), classes, joined


def _heads(classes: DataFrame, joined: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """sig, members, component of each class, and component, head (doc_id, content and text_hash of its first row), classes."""
    placed = classes.join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").select("sig", "members", F.coalesce("component", "cls").alias("component"), "rep")
    placed = scratch.save(placed)
    return placed.drop("rep"), scratch.save(placed.groupBy("component").agg(F.min("rep").alias("head"), F.count("*").alias("classes")))


def similar_documents(docs: DataFrame, n: int = 3, p: int = 90, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        rows, classes, joined = links(docs.select("doc_id", "text"), n, p, scratch, tile)
        placed, heads = _heads(classes, joined, scratch)
        named = hot_join(placed, heads.select("component", "classes", F.col("head.doc_id").alias("component_id")), "component", "classes", classes.count())
        some = hot_join(rows.where("n > 0"), scratch.save(named.select("sig", "members", "component_id")), "sig", "members", rows.count())
        columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
        return scratch.kept(some.select(*columns).unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*columns)))


def without_near_copies(docs: DataFrame, n: int = 5, p: int = 80) -> DataFrame:
    """One row of each component of docs, the one with the smallest doc_id, and all rows without words; the columns of docs.

    A row is known by its doc_id, a hash of its text and one of all its columns; of rows with words that agree in all three one stays."""
    with Scratch(docs.sparkSession) as scratch:
        rows, classes, joined = links(docs, n, p, scratch)
        heads = _heads(classes, joined, scratch)[1]
        id_, none = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none")
        kept = scratch.kept(heads.select("head.*").select(id_, none, "text_hash", "content"))
        names = ["id", "none", "text_hash", "content"]
        words = F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
        keyed = docs.where(words).select(id_, none, F.xxhash64("text").alias("text_hash"), content_hash(docs).alias("content"), whole_row(docs))
        return keyed.dropDuplicates(names).join(kept, names, "left_semi").select("row.*").unionByName(docs.where(~words))


#: Of the query's parameters (three words, 90 %): all pairs of classes that share a shingle, and what they reach.
ORACLE_SQL = r"""
    WITH RECURSIVE t AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                            ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM t),
    classes AS MATERIALIZED (
        SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, len(any_value(s)) AS n, any_value(s) AS s, min(doc_id) AS cls, list(doc_id) AS members FROM sets WHERE len(s) > 0 GROUP BY k),
    x AS MATERIALIZED (SELECT cls, n, unnest(s) AS g FROM classes),
    links AS MATERIALIZED (
        SELECT a, b FROM (SELECT p.cls AS a, q.cls AS b, any_value(p.n) AS m, any_value(q.n) AS n, count(*) AS i FROM x p JOIN x q ON p.g = q.g AND p.cls <> q.cls AND 100 * p.n >= 90 * q.n AND 100 * q.n >= 90 * p.n GROUP BY ALL)
        WHERE 100 * i >= 90 * (m + n - i)),
    reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a AS cls, min(b) AS component_id FROM reach GROUP BY a),
    placed AS (SELECT unnest(members) AS doc_id, component_id FROM classes JOIN least USING (cls))
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN placed USING (doc_id)"""
