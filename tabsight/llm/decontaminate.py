"""Benchmark decontamination with an FM-index for each training shard.

A shard is a stretch of a partition's documents of about ``shard_bytes``.
Its words become codes (a word that no phrase holds cuts the text; a stretch
of such words is one separator code), the codes an FM-index, and all phrases
are searched backwards in it at once.  Occurrences are located by sampled
suffix places and merged into spans of words to remove.  No shuffle; the
phrases travel with the task, in slices of a bounded number of words, one
pass over the documents for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import byte_stretches
from tabsight.llm.fm_index import FMIndex

#: Bytes of words: digits, letters (A-Z become a-z) and all of non-ASCII text.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))
_END = b"\x01"  # between documents; no word, as all of its kind are blanked
SPANS = "array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


@dataclass
class Phrases:
    """Windows of benchmark items: ``codes`` of the words, the distinct
    windows right-aligned in a matrix, and the items that hold each window
    (``items[first[w]:first[w + 1]]``)."""

    codes: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(items: list[tuple[str, list[bytes]]], size: int) -> Phrases:
    codes = {_END: 0}  # 1: a word of no phrase
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    rows, owner = [], []
    for name, words in items:
        coded = [codes.setdefault(w, len(codes) + 1) for w in words]
        for k in range(max(1, len(coded) - size + 1)):
            window = coded[k:k + size]
            rows.append([0] * (size - len(window)) + window)
            owner.append(number[name])
    if not rows:
        return Phrases(codes, np.zeros((0, size), np.int64), *[np.zeros(n, np.int64) for n in (0, 1, 0)], names)
    windows, of = np.unique(np.array(rows, np.int64), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([of.ravel(), np.array(owner, np.int64)], 1), axis=0)
    return Phrases(codes, windows, (windows > 0).sum(1), np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)),
                   pairs[:, 1], names)


def phrase_slices(benchmark: DataFrame, size: int, id_col: str, text_col: str, slice_words: int) -> Iterator[Phrases]:
    """The benchmark's phrases, read one partition at a time and handed out in
    slices of about ``slice_words`` words."""
    some, n = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    for name, text in rows.toLocalIterator():
        if words := words_of(text):
            some.append((name, words))
            n += len(words)
        if n >= slice_words:
            yield phrases(some, size)
            some, n = [], 0
    if some:
        yield phrases(some, size)


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, … (count[k] numbers) for each k, in a row."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def occurrences(texts: list[str | None], given: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, place among all the shard's words, length, window)
    of every occurrence of a window."""
    joined = (b" " + _END + b" ").join((t or "").encode("utf-8", "replace").translate(_WORD_BYTES) for t in texts)
    words = joined.split()
    code = np.fromiter(map(given.codes.get, words, repeat(1)), np.int64, len(words))
    ends = np.append(np.flatnonzero(code == 0), len(code))
    n_words = np.diff(ends, prepend=-1) - 1
    code[code == 0] = 1
    kept = np.flatnonzero((code > 1) | np.append(True, code[:-1] > 1))
    index = FMIndex(code[kept], len(given.codes))
    low, high = index.search(given.windows, given.lengths)
    found = np.flatnonzero(low < high)
    count = (high - low)[found]
    at = kept[index.locate(_expanded(low[found], count))] if len(found) else np.zeros(0, np.int64)
    return n_words, at, np.repeat(given.lengths[found], count), np.repeat(found, count)


def _shard(texts: list[str | None], given: Phrases):
    """For each text its words, and for the shard the merged spans and items
    as (text, start, end) and distinct (text, item)."""
    n_words, at, length, window = occurrences(texts, given)
    first = np.cumsum(n_words + 1) - n_words - 1  # place of each text's first word
    change = np.zeros(len(texts) + int(n_words.sum()) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    hit = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(hit > 0), np.flatnonzero(hit < 0)  # an occurrence never crosses a text's end
    doc = np.searchsorted(first, start, "right") - 1
    owner = np.searchsorted(first, at, "right") - 1
    per = given.first[window + 1] - given.first[window]
    pairs = np.stack([np.repeat(owner, per), given.items[_expanded(given.first[window], per)]], 1)
    return n_words, (doc, start - first[doc], end - first[doc]), np.unique(pairs, axis=0)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _worker(shared, shard_bytes: int, keep_text: bool):
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        for batch in batches:
            for a, b in byte_stretches(batch.column(1), shard_bytes):
                part = batch.slice(a, b - a)
                n_words, (doc, start, end), pairs = _shard(part.column(1).to_pylist(), given)
                spans = [[(s["start"], s["end"]) for s in row] for row in part.column(2).to_pylist()]
                items = part.column(3).to_pylist()
                for k, x, y in zip(doc.tolist(), start.tolist(), end.tolist()):
                    spans[k].append((x, y))
                for k, item in pairs.tolist():
                    items[k].append(given.names[item])
                for k in set(doc.tolist()):
                    spans[k] = _merged(spans[k])
                    items[k] = sorted(set(items[k]))
                columns = [part.column(0)] + [part.column(1)] * keep_text + [
                    pa.array(spans, span_type), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64())]
                names = ["doc_id"] + ["text"] * keep_text + ["spans", "items", "n_words"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       shard_bytes: int = 6_000_000, slice_words: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (word numbers
    [start, end) to remove, merged, ascending) and items (distinct item ids as
    text, sorted).

    Texts are read as words of digits, letters and non-ASCII characters, with
    A-Z lower-cased.  A window is ``size`` consecutive words of an item, or
    the whole item if it has fewer, but some.  Null and empty texts have no
    word; a null item id reads as the empty text, items that share an id are
    one item; repeated ids and rows pass through; empty tables give no row or
    no span; other columns are not read.  A task holds one Arrow batch, one
    index (``shard_bytes`` of text, or one longer document) and one slice of
    phrases."""
    from tabsight.session import ship_package
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    # one slice at a time is in the driver's memory; a broadcast keeps its value in a file
    send = docs.sparkSession.sparkContext.broadcast
    slices = [send(given) for given in phrase_slices(benchmark, size, item_col, item_text_col, slice_words)]
    for k, given in enumerate(slices or [send(phrases([], size))]):
        more = k < len(slices) - 1
        out = out.mapInArrow(_worker(given, shard_bytes, more),
                             f"doc_id {kind.simpleString()}, " + "text string, " * more
                             + f"spans {SPANS}, items array<string>, n_words long")
    return out.select("doc_id", "n_words", "spans", "items")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = contaminated_spans(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
