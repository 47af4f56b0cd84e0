"""SentencePiece encoding and decoding over a trie of marked words.

Texts are cut into marked words, which begin with marks U+2581 (for spaces, and one put before the text); a word also ends
between two signs that no piece has side by side, as no merge crosses there.
A worker sorts the distinct words that its cache lacks, which is a depth-first walk over their trie: consecutive
words share a prefix, and the forward table of that prefix is kept, so that each node of the trie is worked out once.

The public file is a BPE model, not a unigram one, and a highest-score path does not give BPE's pieces. The
forward table therefore holds, for each prefix, the last piece of its BPE encoding instead of a best score. BPE encodings
have optimal substructure of their own: a cut of an encoding is the encoding of the cut text, and a sequence of
pieces is an encoding if each two neighbours are. So the last piece of a prefix is the one that
ends there and follows the last piece of what is before it.

Defined results: a null or empty text has no pieces; texts of any length are encoded whole; signs without a piece become byte
pieces; repeated rows are encoded each, and a null id stays null; an empty table gives an empty table; columns besides doc_id
and text are not read and may have any names. Marks inside a text decode as spaces, like in the library.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcodec import WordCache, _mark_cut, words_of

MARK = "▁"
UNKNOWN = 1 << 24
#: Words that a worker remembers, and pairs of pieces.
WORDS, PAIRS = 1 << 21, 1 << 20
_loaded: dict[str, Pieces] = {}


class Pieces:
    """The model's pieces by number. Signs without a piece get numbers of their own from UNKNOWN on."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [i for i in range(len(self.names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        self.raw = [b"" if model.is_control(i) else bytes([int(self.names[i][3:5], 16)]) if model.is_byte(i) else self.names[i].encode() for i in range(len(self.names))]
        order = {score: k for k, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = {i: order[model.get_score(i)] for i in plain}
        #: Rank of the union of two neighbours, and the last merge that makes a piece out of single signs.
        self.union = {(self.ids[p[:k]], self.ids[p[k:]]): self.rank[i] for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.halves: dict[int, tuple[int, int]] = {}
        #: Trie of the pieces that BPE reaches; "" leads to the piece's number.
        self.trie: dict = {}
        for p, i in self.ids.items():
            if len(p) == 1 or self._reached(p, i):
                node = self.trie
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = i
        # neighbours inside some piece: no merge crosses a border between any others
        signs = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.sign = np.zeros(0x110000, np.int32)
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.inside = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.inside[self.sign[ord(a)], self.sign[ord(b)]] = True
        self.known: dict[tuple[int, int], bool] = {}
        self.cache = WordCache(self.encode_words, WORDS)

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start: at the start of each text and between neighbours that no piece has inside, as before a mark."""
        start = first.copy()
        sign = self.sign[points]
        start[1:] |= ~self.inside[sign[:-1], sign[1:]]
        return start

    def _reached(self, piece: str, number: int) -> bool:
        """Whether BPE joins the signs of a piece to that piece; keeps its last merge."""
        parts = [self.ids.get(c) for c in piece]
        halves = (0, 0)
        while len(parts) > 1:
            ranks = [self.union.get((a, b), math.inf) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == math.inf:
                return False
            halves = (parts[k], parts[k + 1])
            parts[k : k + 2] = [self.ids[self.names[halves[0]] + self.names[halves[1]]]]
        self.halves[number] = halves
        return True

    def follows(self, right: int, left: int) -> bool:
        """Whether two pieces may be neighbours: no merge across their border comes before those that make them.

        Undoes the merges next to the border from the latest on. Each pair of pieces met on the way stood there until the
        merge undone last; a union of theirs of a lower rank would have come first.
        """
        union, halves, rank = self.union, self.halves, self.rank
        until = math.inf
        while left < UNKNOWN:
            found = union.get((left, right))
            if found is not None and found < until:
                return False
            made_left = rank[left] if left in halves else -1
            made_right = rank[right] if right in halves else -1
            if made_left > made_right:
                until, left = made_left, halves[left][1]
            elif made_right >= 0:  # of equal unions the left one comes first
                until, right = made_right + 1, halves[right][0]
            else:
                break
        return True

    def walk(self, words: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """For each word, in sorted order, the forward table: where the last piece of each prefix begins, and that piece."""
        begins, pieces = [0], [-1]
        going: list[list[tuple[int, dict]]] = [[]]  # pieces begun and not ended: where, and how far in their trie
        trie, known = self.trie, self.known
        if len(known) >= PAIRS:
            known.clear()
        last = ""
        for word in words:
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del begins[shared + 1 :], pieces[shared + 1 :], going[shared + 1 :]
            for at in range(shared, len(word)):
                c, found, further = word[at], -1, []
                for begin, node in (*going[at], (at, trie)):
                    node = node.get(c)
                    if node is not None:
                        further.append((begin, node))
                        if found < 0 and (piece := node.get("")) is not None:
                            fits = begin == 0 or known.get(pair := (piece, pieces[begin]))
                            if fits is None:
                                fits = known[pair] = self.follows(*pair)
                            if fits:
                                found, where = piece, begin
                if found < 0:
                    found, where = UNKNOWN + ord(c), at
                begins.append(where)
                pieces.append(found)
                going.append(further)
            last = word
            yield begins, pieces

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list[list[int]] = [[]] * len(words)
        for k, (begins, pieces) in zip(order, self.walk([words[k] for k in order]), strict=True):
            at, own = len(begins) - 1, []
            while at:
                if pieces[at] < UNKNOWN:
                    own.append(pieces[at])
                else:
                    own += [self.bytes[b] for b in reversed(chr(pieces[at] - UNKNOWN).encode())]
                at = begins[at]
            own.reverse()
            found[k] = own
        return np.fromiter(itertools.chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int32, len(found))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for words in words_of(marked, self.starts, _mark_cut):
            rows = self.cache.rows(words)
            ids, ends = self.cache.ids(rows), np.cumsum(self.cache.length[rows], dtype=np.int64)
            if not len(ends):
                continue
            last = np.append(np.flatnonzero(words.owner[1:] != words.owner[:-1]), len(words.owner) - 1)
            begin = 0
            for owner, end in zip(words.owner[last].tolist(), ends[last].tolist(), strict=True):
                out[owner].append(ids[begin:end])
                begin = end
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = pieces.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(x) if x is not None else None for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, same (whether the text comes back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = pieces.encode(texts)
                back = [pieces.decode(x.tolist()) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean")
