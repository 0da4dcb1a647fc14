"""Packing of token ids into windows of a fixed size by the sum-of-squares rule for online bin packing.

Every partition packs the documents it reads, with no shuffle. A document's full windows leave at once; its rest, of s < size
ids, goes into the partially filled window whose fill level h (0: a new window) makes the sum over levels of squared counts
least, where the level array holds the number of windows at each level. Windows that reach the size leave.
What is left at a partition's end is closed: the fullest open windows keep what the rule has placed in them and are filled up from
the emptiest ones, whose pieces are cut for it; the ids after the last full window become windows of powers of two, which need no
padding. Open windows that hold more than `most_open` ids are closed likewise down to half of that, so memory stays bounded.

Defined results: null and empty texts are documents of the end id alone; repeated rows are documents of their own; an empty
table gives no pieces; a document of any length is cut into as many pieces as it needs. sequence_id is unique over all
partitions (partition number in the high bits) and says nothing else.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens

VOCABULARY = "word_bpe_49k.json"
SIZE = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class SumOfSquares:
    """Level array and open windows of one partition. Pieces are (document, start, ids)."""

    def __init__(self, size: int = SIZE, most_open: int = 8 << 20):
        self.size, self.most_open = size, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.held = 0
        self.done: list[list] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        full = len(ids) // self.size * self.size
        for a in range(0, full, self.size):
            self.done.append([(doc, a, ids[a : a + self.size])])
        if full < len(ids):
            self.place((doc, full, ids[full:]))
        if self.held > self.most_open:
            self.flush(self.most_open // 2)

    def place(self, piece) -> None:
        s, size = len(piece[2]), self.size
        # moving a window from level h to h + s changes the sum of squares by 1 - 2 count[h] (h > 0) and 1 + 2 count[h + s] (h + s < size)
        levels = self.count[: size - s + 1]
        change = 2 * self.count[s : size + 1] + 1
        change[size - s] = 0
        change[1:] += 1 - 2 * levels[1:]
        change[1:][levels[1:] == 0] = np.iinfo(np.int64).max
        h = int(np.argmin(change))
        window = []
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            self.held -= h
        window.append(piece)
        if h + s == size:
            self.done.append(window)
        else:
            self.open.setdefault(h + s, []).append(window)
            self.count[h + s] += 1
            self.held += h + s

    def flush(self, keep: int = 0) -> None:
        """Closes windows, fullest first, with ids from the emptiest, until at most keep ids are open."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        first, last = 0, len(windows) - 1
        while first < last and self.held > keep:
            window, room = windows[first], self.size - sum(len(p[2]) for p in windows[first])
            while room and first < last:
                doc, start, ids = windows[last].pop()
                taken = ids[len(ids) - room :] if len(ids) > room else ids
                window.append((doc, start + len(ids) - len(taken), taken))
                if len(taken) < len(ids):
                    windows[last].append((doc, start, ids[: len(ids) - len(taken)]))
                room -= len(taken)
                last -= not windows[last]
            if not room:
                self.done.append(window)
                self.held -= self.size
                first += 1
        rest = windows[first : last + 1]
        if not keep:
            rest, pieces = [], [p for w in rest for p in w]
            left, window, room = sum(len(p[2]) for p in pieces), [], 0
            for doc, start, ids in pieces:
                while len(ids):
                    if not room:
                        room = 1 << (left.bit_length() - 1)
                        left -= room
                    take = min(room, len(ids))
                    window.append((doc, start, ids[:take]))
                    start, ids, room = start + take, ids[take:], room - take
                    if not room:
                        self.done.append(window)
                        window = []
        self.open, self.held = {}, 0
        self.count[:] = 0
        for w in rest:
            h = sum(len(p[2]) for p in w)
            self.open.setdefault(h, []).append(w)
            self.count[h] += 1
            self.held += h


def _pack(path: str, size: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        base, enc, packer = TaskContext.get().partitionId() << 40, tokens.encoder(path), SumOfSquares(size)
        end = np.array([end_id], enc.dtype).tobytes()
        sequences = 0

        def leave():
            nonlocal sequences
            rows = []
            for window in packer.done:
                offset, length = 0, sum(len(p[2]) for p in window)
                for (doc, total), start, ids in window:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").data), total, base + sequences, offset, length))
                    offset += len(ids)
                sequences += 1
            packer.done = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_NAMES)

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in tokens.text_runs(texts):
                for doc, raw in zip(docs[first:last], enc.encode(texts[first:last])):
                    ids = np.frombuffer(raw + end, enc.dtype)
                    packer.add((doc, len(ids)), ids)
                yield from leave()
        packer.flush()
        yield from leave()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece; see SCHEMA. sequence_length is the number of ids in the piece's sequence, before padding."""
    path = vocabulary or tokens.public_path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(path, size, end_id), SCHEMA)
