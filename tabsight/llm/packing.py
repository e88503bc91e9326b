"""Sum-of-squares online packing of token sequences into fixed windows.

Each task packs the documents of its partition, one after the other, so the
operator needs no shuffle.  Whole windows of a long document are cut off
first.  Its rest goes to the fill level for which the sum over levels of
(number of open windows at that level) squared becomes smallest; the level
array holds these numbers.  The rule holds at any number of open windows as
long as the ids in them fit into ``open_bytes`` (64 MB are 8,192 windows of
2,048 ids); only when they would not, the fullest open window is filled with
the beginning of the rest and what remains is placed again, so a task's memory
is bounded and no id is lost.  At the end of a partition the emptiest open
windows are moved into the fullest, and the one window left is cut at powers
of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import byte_stretches, release_memory
from tabsight.llm.wordbpe import encoder, read_json

NEVER = 1 << 62
OUT_BYTES = 4 << 20  # of ids in a batch of finished pieces
RUN_BYTES = 2 << 20  # of text whose ids are at hand at a time
FIELDS = ("start", "length", "doc_tokens", "sequence_id", "offset")


class LevelPacker:
    """Places (document, ids) pieces; finished pieces are appended to ``out``
    as (document, start, length, document's tokens, sequence, offset, ids)."""

    def __init__(self, capacity: int, open_bytes: int, first_sequence: int):
        self.capacity, self.open_ids, self.held = capacity, open_bytes // 4, 0
        self.next_sequence = first_sequence
        self.level = np.zeros(capacity + 1, np.int64)  # open windows at each fill level
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.n_open = 0
        self.out: list[tuple] = []

    # a piece is (document, start, ids, document's tokens), ids as bytes of 4 each
    def add(self, doc, ids: bytes) -> None:
        total, size, at = len(ids) // 4, self.capacity, 0
        while total - at >= size:
            self._close([(doc, at, ids[4 * at:4 * (at + size)], total)])
            at += size
        while at < total:
            rest = total - at
            h = self._best(rest)
            if h == 0 and self.n_open and self.held + rest > self.open_ids:
                h = self._fullest()
                rest = min(rest, size - h)
            window = self._take(h) if h else []
            window.append((doc, at, ids[4 * at:4 * (at + rest)], total))
            self._put(h + rest, window)
            at += rest

    def _best(self, s: int) -> int:
        """Level to place ``s`` tokens at (0: a new window): least growth of
        the sum of squares, the fuller level among equals."""
        level, size = self.level, self.capacity
        fits = size - s  # highest level with room for s tokens
        new = 2 * level[s] + 1 if s < size else 0
        if fits < 1:
            return 0
        # growth at level h: (h loses a window) + (h + s gains one, unless the window is then full)
        growth = 1 - 2 * level[1:fits + 1]
        gain = 2 * level[1 + s:size + 1] + 1
        gain[-1] = 0
        growth = np.where(level[1:fits + 1] > 0, growth + gain, NEVER)
        h = fits - int(growth[::-1].argmin())  # the fullest level among equals
        return h if growth[h - 1] <= new and growth[h - 1] < NEVER else 0

    def _fullest(self) -> int:
        return int(self.level.nonzero()[0][-1])

    def _take(self, h: int) -> list:
        windows = self.open[h]
        window = windows.pop()
        if not windows:
            del self.open[h]
        self.level[h] -= 1
        self.held -= h
        self.n_open -= 1
        return window

    def _put(self, h: int, window: list) -> None:
        if h == self.capacity:
            self._close(window)
        else:
            self.open.setdefault(h, []).append(window)
            self.level[h] += 1
            self.held += h
            self.n_open += 1

    def _close(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.out.append((doc, start, n, total, self.next_sequence, offset, ids))
            offset += n
        self.next_sequence += 1

    def finish(self) -> None:
        while self.n_open > 1:
            emptiest = self._take(int(self.level.nonzero()[0][0]))
            for piece in emptiest:
                while piece:
                    if not self.n_open:  # every other window is full by now
                        self._put(len(piece[2]) // 4, [piece])
                        break
                    h = self._fullest()
                    window = self._take(h)
                    head, piece = _cut(piece, self.capacity - h)
                    window.append(head)
                    self._put(h + len(head[2]) // 4, window)
        if self.n_open:
            (fill,) = self.open
            pieces, window = self._take(fill), []
            while pieces:
                size = 1 << (fill.bit_length() - 1)
                room = size
                while room:
                    head, rest = _cut(pieces.pop(0), room)
                    window.append(head)
                    room -= len(head[2]) // 4
                    if rest:
                        pieces.insert(0, rest)
                self._close(window)
                window, fill = [], fill - size


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
    doc, start, ids, total = piece
    if len(ids) <= 4 * n:
        return piece, None
    return (doc, start, ids[:4 * n], total), (doc, start + n, ids[4 * n:], total)


def _worker(tokenizer_json: str, capacity: int, open_bytes: int, end_id: int, stretch_bytes: int, id_type: pa.DataType):
    types = [id_type] + [pa.int64()] * len(FIELDS) + [pa.binary()]

    def table(rows):
        cols = list(zip(*rows)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", *FIELDS, "ids"])

    full = max(1, OUT_BYTES // (4 * capacity))

    def tables(packer: LevelPacker, least: int) -> Iterator[pa.RecordBatch]:
        """The finished pieces, if there are ``least``, in batches of ``full``
        rows at most; the packer lets go of them before they are handed on."""
        if len(packer.out) >= least:
            packer.out.reverse()
            while packer.out:
                part = packer.out[:-full - 1:-1]
                del packer.out[-full:]
                made = table(part)
                del part
                yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json)
        end_bytes = end_id.to_bytes(4, "little")
        packer = LevelPacker(capacity, open_bytes, TaskContext.get().partitionId() << 36)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for at, to in byte_stretches(texts, stretch_bytes):
                for a, b, ids, end in encode.runs(texts.slice(at, to - at), RUN_BYTES):
                    ids, start = ids.astype("<u4", copy=False), 0
                    for doc, stop in zip(docs.slice(at + a, b - a).to_pylist(), end.tolist()):
                        packer.add(doc, ids[start:stop].tobytes() + end_bytes)
                        start = stop
                        yield from tables(packer, full)
                    ids = end = None  # else they stay while the next ones are made
                release_memory()
            batch = docs = texts = None  # else they stay while the next batch is read
        packer.finish()
        yield from tables(packer, 1)
        packer = None
        release_memory()
    return run


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, open_bytes: int = 64 << 20,
                   end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                   stretch_bytes: int = 16 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (binary, little-endian unsigned 32-bit).

    Null and empty texts are the end id alone; null and repeated ids are
    packed like any other row; an empty table gives no piece; other columns
    are not read.  A sequence belongs to one partition (its number holds the
    partition's), so a lost task packs the same rows again.  State per task:
    ``open_bytes`` of open windows, one Arrow batch of texts, one of pieces with
    ``OUT_BYTES`` of ids at most, the distinct words of ``stretch_bytes`` of text,
    and the ids of ``RUN_BYTES`` of it; or those of one longer document."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = df.schema[id_col].dataType
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _worker(read_json(tokenizer_path), capacity, open_bytes, end_id, stretch_bytes, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, " + ", ".join(f"`{c}` long" for c in FIELDS) + ", ids binary")


def with_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in the place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")
