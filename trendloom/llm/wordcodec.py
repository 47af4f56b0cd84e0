"""Vectorised cutting of texts into words and encoding of words through a cache, with NumPy inside tasks.

A batch of texts becomes one array of code points. Word starts are found by array comparisons, every
word gets two 64-bit hashes, and an open-addressing table maps the first to ids, which hold if the second agrees too.
Only words that the table lacks are encoded, once for each worker and generation of the cache.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

#: Characters that are cut and hashed at once; longer texts are cut where a space follows a letter.
BLOCK = 1 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points with Unicode's property White_Space (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_tables: dict[str, np.ndarray] = {}


def kinds() -> np.ndarray:
    """For every code point: letter, number, white space or other."""
    if "kinds" not in _tables:
        main = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((main.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        _tables["kinds"] = table
    return _tables["kinds"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes, the first never 0, of points[start:end]; equal words have equal hashes wherever they stand.

    Each hash is a sum of mixed (code point, place in the word) pairs, so that no rule of letters makes two words
    agree: words meet in one hash by chance alone (2**-64 a pair), and what must be exact compares both.
    Words neither overlap nor are empty; what is between them is not looked at.
    """
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    points, begin = points[starts[0] : ends[-1]], starts[0]
    place = np.arange(len(points), dtype=np.uint64) - np.repeat((starts - begin).astype(np.uint64), np.diff(np.append(starts, ends[-1])))
    x = points.astype(np.uint64) + (place << np.uint64(21))
    first, second = mixed(x + np.uint64(0x9E3779B97F4A7C15)), mixed(x ^ np.uint64(0xD1B54A32D192ED03))
    gaps = np.flatnonzero(ends[:-1] != starts[1:])
    if len(gaps):
        inside = np.zeros(len(points) + 1, np.int8)
        inside[starts - begin] += 1
        np.subtract.at(inside, ends - begin, 1)
        outside = np.cumsum(inside[:-1]) == 0
        first[outside] = second[outside] = 0
    first, second = np.add.reduceat(first, starts - begin), np.add.reduceat(second, starts - begin)
    first, second = mixed(first), mixed(second)
    return np.where(first == 0, np.uint64(1), first), second


def byte_level_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start under the byte-level pattern of public_tokenizers.PATTERN.

    first marks the first code point of each text. Contractions, a single leading space, runs of
    letters, numbers and other signs, and white space whose last sign goes to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = kinds()[points]
    space = kind == SPACE
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first
    start = change.copy()
    # the last sign of a run of white space before something else
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last
    # a plain space belongs to what follows it
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (points[:-1] == 32)
    start &= ~joined
    # contractions: an apostrophe that starts a word, then s t m d or re ve ll
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 1 < n]
    if len(at):
        a = points[at + 1]
        inside = ~first[at + 1]
        one = inside & np.isin(a, [ord(c) for c in "stmd"])
        b = points[np.minimum(at + 2, n - 1)]
        two = inside & (at + 2 < n) & ~first[np.minimum(at + 2, n - 1)] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for found, size in ((at[one], 2), (at[two], 3)):
            start[found + 1] = False
            ends = found + size
            start[ends[ends < n]] = True
    return start


_cut = re.compile("(?<=[A-Za-z]) ")
_mark_cut = re.compile("(?<=[A-Za-z])▁")


def _blocks(texts: list[str], cut: re.Pattern) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts with the numbers of their texts, about BLOCK signs at a time."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            end = len(text)
            if end - at > BLOCK:
                found = cut.search(text, at + BLOCK - 1)
                end = found.start() if found else end
            if parts and size + end - at > BLOCK:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(k)
            parts.append(text[at:end])
            size += end - at
            at = end
            if not text:
                break
    if parts:
        yield owners, parts


class Words:
    """The words of one block: their hashes, the text each is from, and the words themselves on demand."""

    def __init__(self, owners: list[int], parts: list[str], find: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.text = "".join(parts)
        points = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(lengths) - lengths
        first = np.zeros(len(points), bool)
        first[begins[lengths > 0]] = True
        self.starts = np.flatnonzero(find(points, first))
        self.ends = np.append(self.starts[1:], len(points)) if len(self.starts) else self.starts
        self.hashes, self.second = word_hashes(points, self.starts, self.ends)
        filled = np.flatnonzero(lengths > 0)
        own = np.asarray(owners, np.int64)[filled]
        self.owner = own[np.searchsorted(begins[filled], self.starts, "right") - 1] if len(filled) else np.zeros(0, np.int64)

    def word(self, k: int) -> str:
        return self.text[self.starts[k] : self.ends[k]]

    def only(self, which: np.ndarray) -> Words:
        """The same block with some of its words."""
        out = object.__new__(Words)
        out.text = self.text
        out.starts, out.ends, out.hashes, out.second, out.owner = self.starts[which], self.ends[which], self.hashes[which], self.second[which], self.owner[which]
        return out


def words_of(texts: list[str], find=byte_level_starts, cut: re.Pattern = _cut) -> Iterator[Words]:
    for owners, parts in _blocks(texts, cut):
        yield Words(owners, parts, find)


class HashTable:
    """Open addressing over NumPy arrays: 64-bit keys to rows 0, 1, 2, ... in order of insertion."""

    def __init__(self, bits: int = 17):
        self.keys, self.rows, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        held = self.keys[slot]
        out = np.where(held == keys, self.rows[slot], -1)
        going = np.flatnonzero((held != keys) & (held != 0))
        while len(going):
            slot_going = (slot[going] + np.uint64(1)) & mask
            slot[going] = slot_going
            held = self.keys[slot_going]
            same = held == keys[going]
            out[going[same]] = self.rows[slot_going[same]]
            going = going[~same & (held != 0)]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Rows for new distinct keys."""
        rows = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        if 2 * (self.n + len(keys)) > len(self.keys):
            used = self.keys != 0
            old_keys, old_rows = self.keys[used], self.rows[used]
            bits = int(4 * (self.n + len(keys))).bit_length()
            self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._put(old_keys, old_rows)
        self._put(keys, rows)
        self.n += len(keys)
        return rows

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.rows[slot[placed]] = rows[placed]
            left = ~placed
            keys, rows, slot = keys[left], rows[left], (slot[left] + np.uint64(1)) & mask


class WordCache:
    """Ids of words by hash. encode(words) gives the ids of words not seen yet, end to end, and how many each has;
    past ``most`` words the cache starts anew.

    A word that shares the first hash of another but not the second gets a row that the table does not lead to.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1 << 20):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.table, self.pool, self.filled, self.n = HashTable(), np.zeros(1 << 18, np.int32), 0, 0
        self.begin, self.length, self.second = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint64)
        self.row = np.zeros(1 << 16, np.int64)

    def _put(self, words: Words, which: np.ndarray) -> np.ndarray:
        """New rows for words[which]."""
        found, sizes = self.encode([words.word(k) for k in which.tolist()])
        rows = np.arange(self.n, self.n + len(which))
        self.n += len(which)
        while len(self.begin) < self.n:
            self.begin, self.length, self.second = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.second))
        while len(self.pool) < self.filled + sizes.sum():
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        ends = np.cumsum(sizes, dtype=np.int64)
        self.begin[rows], self.length[rows], self.second[rows] = self.filled + ends - sizes, sizes, words.second[which]
        self.pool[self.filled : self.filled + len(found)] = found
        self.filled += len(found)
        return rows

    def rows(self, words: Words) -> np.ndarray:
        """The row in this cache of each word; rows hold until the next call."""
        if self.n > self.most:
            self._clear()
        at = self.table.find(words.hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, back = np.unique(words.hashes[missing], return_index=True, return_inverse=True)
            rows = self._put(words, missing[first])
            added = self.table.add(new)
            while len(self.row) < self.table.n:
                self.row = np.concatenate([self.row, np.zeros_like(self.row)])
            self.row[added] = rows
            at[missing] = added[back]
        out = self.row[at]
        odd = np.flatnonzero(self.second[out] != words.second)
        if len(odd):
            out[odd] = self._put(words, odd)
        return out

    def ids(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.length[rows]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32)
        return self.pool[np.repeat(self.begin[rows] - ends + sizes, sizes) + np.arange(ends[-1])]
