"""Packing of documents into windows by the sum-of-squares rule.

Documents come one at a time. The level array counts the partially filled windows of each fill. A document
goes where it makes the sum of the squared counts smallest: into a window of some level, or into a new
one. Documents of a window or more are first cut into full
windows, and only their rest is placed. When a task has no documents left, the windows still open are filled up
from each other by cuts, so that one of them at most is left unfilled in each task.

OPEN bounds the memory of a task, and nothing else: only when so many windows are open (128 MB of ids) is a document for which the rule would
open another cut instead, so that its first part fills a window of the level that has most. The windows that the rule leaves open
grow with the root of the number of documents, so that a partition has to be very large for that.

The rule wants many windows for each level, so that partitions with little text are put together (without a shuffle)
until each task has TASK_CHARS of it. Nothing is shuffled, and a task holds the ids of its open windows only, OPEN at most,
whatever the length of a text or the number of documents.

Defined results: a null text counts as empty and is the end id alone; a long text has pieces in as many windows as it
needs; repeated rows and ids are packed again each time, and a null id stays null; an empty table gives an
empty table; columns besides doc_id and text are not read and may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .bytebpe import loaded

WINDOW, END = 2048, 1
#: Open windows that a task may hold, characters of text for each task at least, and ids in memory before rows are handed on.
OPEN, TASK_CHARS, FLUSH = 1 << 14, 8_000_000, 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """emit(sequence, doc, start, ids, doc_tokens, offset) is called for each piece of a window that is full or closed."""

    def __init__(self, window: int, emit: Callable[..., None], sequences: Iterator[int], most_open: int = OPEN):
        self.window, self.emit, self.sequences, self.most_open = window, emit, sequences, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        #: Tokens of windows that the rule filled alone, of those that a cut for want of memory filled, and of those that close() did.
        self.by_rule = self.by_force = self.by_close = 0

    def _write(self, pieces: list) -> None:
        sequence, offset = next(self.sequences), 0
        for doc, start, ids, total in pieces:
            self.emit(sequence, doc, start, ids, total, offset)
            offset += len(ids)

    def choose(self, size: int) -> int:
        """The fill, 0 for a new window, whose choice makes the sum of squares smallest; of equal ones the fullest."""
        counts, window = self.levels, self.window
        # half the change of the sum, less a constant: one window leaves level h, one comes to h + size
        change = 2 * (counts[size:window] - counts[: window - size]) + 2
        if size == window:
            return 0
        change[0] = 2 * counts[size] + 1
        change[1:][counts[1 : window - size] == 0] = np.iinfo(np.int64).max
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        full = counts[window - size] and 1 - 2 * counts[window - size] <= change[at]
        return window - size if full else at

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self._write([(doc, at, ids[at : at + self.window], total)])
            self.by_rule += self.window
            at += self.window
        while at < total:
            size = total - at
            level, forced = self.choose(size), False
            if not level and self.levels.sum() >= self.most_open:
                level = self._to_cut_for(size)
                forced = level > 0
            pieces = self.open[level].pop() if level else []
            self.levels[level] -= level > 0
            part = ids[at : at + self.window - level]
            pieces.append((doc, at, part.copy(), total))
            at += len(part)
            if level + len(part) == self.window:
                self._write(pieces)
                if forced:
                    self.by_force += self.window
                else:
                    self.by_rule += self.window
            else:
                self.open[level + len(part)].append(pieces)
                self.levels[level + len(part)] += 1

    def _to_cut_for(self, size: int) -> int:
        """Of the fills that leave no room for size tokens, the one with the most windows, of equal ones the fullest; 0 without any."""
        tight = self.levels[max(1, self.window - size + 1) :]
        return self.window - int(np.argmax(tight[::-1])) if tight.any() else 0

    def close(self) -> None:
        """Fills the open windows, the fullest first, with cuts of the emptiest ones."""
        windows = [(fill, pieces) for fill in range(self.window, 0, -1) for pieces in self.open[fill]]
        self.by_close += sum(fill for fill, _ in windows)
        low, high, spare = 0, len(windows) - 1, []
        while low <= high:
            fill, pieces = windows[low]
            low += 1
            while fill < self.window and (spare or high >= low):
                if not spare:
                    spare = windows[high][1]
                    high -= 1
                doc, start, ids, total = spare.pop()
                take = min(len(ids), self.window - fill)
                pieces.append((doc, start, ids[:take], total))
                fill += take
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:], total))
            self._write(pieces)
        while spare:
            pieces, fill = [], 0
            while spare and fill < self.window:
                doc, start, ids, total = spare.pop()
                take = min(len(ids), self.window - fill)
                pieces.append((doc, start, ids[:take], total))
                fill += take
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:], total))
            self._write(pieces)
        self.open = [[] for _ in range(self.window + 1)]
        self.levels[:] = 0


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece: PIECES, and the ids themselves where asked for."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        out: dict[str, list] = {c: [] for c in names}
        end = np.asarray([END], np.int32)
        base = TaskContext.get().partitionId() << 33
        held = 0

        def emit(sequence, doc, start, ids, total, offset):
            nonlocal held
            row = (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8)), total, sequence, offset, *([ids.astype(np.int32)] if with_ids else []))
            for c, v in zip(names, row, strict=True):
                out[c].append(v)
            held += len(ids) if with_ids else 16

        def flush() -> pa.RecordBatch:
            nonlocal held
            arrays = [pa.array(out[c], pa.int64()) for c in names if c != "ids"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(out["length"], dtype=np.int64)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *out["ids"]]))))
            for c in names:
                out[c].clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names)

        packer = Packer(window, emit, iter(range(base, base + (1 << 33))))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 64):
                part = [t or "" for t in texts.slice(at, 64).to_pylist()]
                for doc, found in zip(ids[at : at + 64], bpe.encode(part), strict=True):
                    packer.add(doc, np.concatenate([found, end]))
                    if held >= FLUSH:
                        yield flush()
        packer.close()
        yield flush()

    return _enough(docs).mapInArrow(run, schema)


def _enough(docs: DataFrame) -> DataFrame:
    """doc_id and text, in partitions that have TASK_CHARS of text on average, or as they are if they have more."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return docs.coalesce(max(1, chars // TASK_CHARS))
