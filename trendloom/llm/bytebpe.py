"""Ids and token counts of texts under a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json

import numpy as np

from .wordcodec import WordCache, words_of

_loaded: dict[str, ByteBpe] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBpe:
    """Encodes like the library. Words are merged by tiktoken's core with the file's own vocabulary as ranks,
    which is the same rule as long as every merge makes the next id; that is checked on loading."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in piece): k for piece, k in file["model"]["vocab"].items() if all(c in letters for c in piece)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        vocab = {piece: k for piece, k in vocab.items() if k not in self.special.values()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        ids = [file["model"]["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids) or file["normalizer"] or file["pre_tokenizer"].get("type") != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE with merges in the order of ids")
        #: One word from each run between NULs.
        self.core = tiktoken.Encoding("words", pat_str=r"\x00|[^\x00]+", mergeable_ranks=vocab, special_tokens={})
        self.vocab, self.whole = vocab, None
        self.nul = vocab[b"\0"]
        self.cache = WordCache(self.encode_words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has."""
        if any("\0" in w for w in words):
            if self.whole is None:
                import tiktoken

                self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=self.vocab, special_tokens={})
            each = [self.whole.encode_ordinary(w) if "\0" in w else self.core.encode_ordinary(w) for w in words]
            return np.asarray([i for x in each for i in x], np.int32), np.fromiter(map(len, each), np.int32, len(each))
        ids = np.asarray(self.core.encode_ordinary("\0".join(words)), np.int32)
        cuts = np.flatnonzero(ids == self.nul)
        sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return np.delete(ids, cuts), sizes.astype(np.int32)

    def _parts(self, texts: list[str]) -> tuple[list[str], list[int], list[tuple[int, int]]]:
        """Texts between special strings, their owners, and (owner, id) of a special string after a part."""
        parts: list[str] = []
        owners: list[int] = []
        after: list[tuple[int, int]] = []
        for k, text in enumerate(texts):
            pieces = [(text, -1)]
            for s, i in self.special.items():
                if s in text:
                    pieces = [(x, i if n < len(cut) - 1 else end) for piece, end in pieces for cut in [piece.split(s)] for n, x in enumerate(cut)]
            for piece, end in pieces:
                parts.append(piece)
                owners.append(k)
                after.append((k, end))
        return parts, owners, after

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owners, after = self._parts(texts)
        out = np.zeros(len(texts), np.int64)
        own = np.asarray(owners, np.int64)
        for words in words_of(parts):
            rows = self.cache.rows(words)
            out += np.bincount(own[words.owner], self.cache.length[rows], len(texts)).astype(np.int64)
        for k, i in after:
            out[k] += i >= 0
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts, owners, after = self._parts(texts)
        found: list[list[np.ndarray]] = [[] for _ in parts]
        for words in words_of(parts):
            rows = self.cache.rows(words)
            ids = self.cache.ids(rows)
            ends = np.cumsum(self.cache.length[rows], dtype=np.int64)
            if not len(ends):
                continue
            last = np.append(np.flatnonzero(words.owner[1:] != words.owner[:-1]), len(words.owner) - 1)
            begin = 0
            for owner, end in zip(words.owner[last].tolist(), ends[last].tolist(), strict=True):
                found[owner].append(ids[begin:end])
                begin = end
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, (owner, i) in enumerate(after):
            out[owner] += found[k]
            if i >= 0:
                out[owner].append(np.asarray([i], np.int32))
        none = np.zeros(0, np.int32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]


def loaded(path: str) -> ByteBpe:
    """One encoder, with its cache, for each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
