"""BPE encoding and decoding of whole texts by a distinct-word table.

1. Texts are split into words in blocks of bounded size; a block keeps each
   distinct word once and each text as the list of its words' numbers.
2. The blocks' distinct words are dealt to buckets by a hash of the word.  A
   bucket is one part of the distinct-word table: its rows stream through a
   task, which encodes a word when it first meets it and answers every block
   with the ids of the words it sent, in the order sent.
3. Each block gets its answers back; a text's ids are its words' ids joined
   by position, and its decoded text joins the ids with the vocabulary's
   id-to-piece table (whose size is that of the vocabulary).

Only packed word lists and numbers are shuffled, never a row per occurrence;
every word occurs at most once per block, so no word is hot.  The texts'
numbers are shuffled once, to their block: the split is run a second time
for them, which is cheaper than a second shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabsight.llm.common import shuffle_partitions, small_batches
from tabsight.llm.wordbpe import encoder, joined, load, read_json, split_texts

# rows: a block's texts (bucket null: ids, word counts and word numbers of its texts) or the
# words a block sends to a bucket (their numbers, and the words or the ids they have)
ROW = "block long, bucket int, docs array<{id}>, sizes binary, numbers binary, data binary"
NAMES = ["block", "bucket", "docs", "sizes", "numbers", "data"]


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*rows)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=NAMES)


def _pack(values) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of the same weight, compressed:
    the higher bytes are nearly all alike."""
    v = np.ascontiguousarray(values, "<u4")
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _split(block_bytes: int, buckets: int, id_type: pa.DataType, texts: bool):
    """Rows of the texts of each block, or of its distinct words by bucket; the
    numbers depend on a partition's rows and their order only, so both kinds
    agree, also when a task is run again.  Blocks number their distinct words
    by falling frequency, then bucket and first letters: frequent words get
    small numbers, and the words sent to a bucket are nearly sorted, so both
    compress well."""
    def close(block: int, docs: list, distinct: pa.Array, first: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        sizes = np.diff(ends, prepend=0)
        words = distinct.cast(pa.binary()).to_pylist()
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.lexsort((np.array([w[:16] for w in words], "S16"), bucket, -np.bincount(first, minlength=len(words)))) \
            if words else np.zeros(0, np.int64)
        final = np.empty(len(words), np.int64)
        final[order] = np.arange(len(words))
        if texts:
            yield block, None, docs, _pack(sizes), _pack(final[first]), None
            return
        by_bucket = order[np.argsort(bucket[order], kind="stable")]
        ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
        press, start = zstandard.ZstdCompressor(level=3), 0
        for k, end in enumerate(ends):
            if end > start:
                own = by_bucket[start:end]
                yield (block, k, None, None, _pack(np.diff(final[own], prepend=0)),
                       press.compress(b" ".join([words[i] for i in own.tolist()])))
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block = (part << 20) + part
        for batch in small_batches(batches, 1, block_bytes):
            yield _batch(list(close(block, batch.column(0).to_pylist(), *split_texts(batch.column(1)))), id_type)
            block += 1
    return run


def _encode(tokenizer_json: str, max_known: int, id_type: pa.DataType):
    """Rows of a bucket are neighbours; the table of known words is bounded, so
    a word is encoded again only if its bucket has more than ``max_known``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_new = encoder(tokenizer_json)
        known: dict[bytes, bytes] = {}
        current, rows = None, []
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for block, bucket, docs, _, numbers, data in zip(*cols):
                if bucket != current or len(known) > max_known:
                    known.clear()
                    current = bucket
                words = unzip.decompress(data).split(b" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, encode_new(new)))
                ids = [known[w] for w in words]
                sizes = _pack(np.fromiter((len(i) // 4 for i in ids), "<u4", len(ids)))
                data = _pack(np.frombuffer(b"".join(ids), "<u4"))
                rows.append((block, bucket, docs, sizes, numbers, data))
                if len(rows) >= 500:
                    yield _batch(rows, id_type)
                    rows = []
        yield _batch(rows, id_type)
    return run


def _join(tokenizer_json: str, id_type: pa.DataType):
    names = ["doc_id", "ids", "decoded"]
    types = [id_type, pa.list_(pa.int32()), pa.string()]

    def run(table: pa.Table) -> pa.Table:
        pieces = id_to_piece(tokenizer_json)
        docs, ends, code, parts = [], np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for bucket, own, sizes, numbers, data in zip(*(table.column(c).to_pylist() for c in (
                "bucket", "docs", "sizes", "numbers", "data"))):
            if bucket is None:
                docs, ends, code = own, np.cumsum(_unpack(sizes), dtype=np.int64), _unpack(numbers).astype(np.int64)
            else:
                parts.append((np.cumsum(_unpack(numbers).view("<i4"), dtype=np.int64), _unpack(sizes).astype(np.int64), _unpack(data)))
        words = 1 + max((int(k.max()) for k, _, _ in parts if len(k)), default=-1)
        first, size, start = np.zeros(words, np.int64), np.zeros(words, np.int64), 0
        for k, n, ids in parts:
            first[k], size[k] = start + np.cumsum(n) - n, n
            start += len(ids)
        ids, word_end = joined(code, np.concatenate([i for _, _, i in parts]) if parts else np.zeros(0, np.uint32), first, size)
        offsets = pa.array(np.append(0, np.append(0, word_end)[ends]).astype(np.int32))
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(pa.array(ids.astype(np.int32)))), " ")
        return pa.Table.from_arrays([pa.array(docs, types[0]), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), text],
                                    names=names)
    return run


_PIECES: dict[int, pa.Array] = {}


def id_to_piece(tokenizer_json: str) -> pa.Array:
    """The vocabulary as a table from id to piece, kept by the worker."""
    key = hash(tokenizer_json)
    if key not in _PIECES:
        tok = load(tokenizer_json)
        if tok.decoder is not None:
            raise ValueError("only tokenizers without a decoder join pieces by a space")
        _PIECES.clear()
        _PIECES[key] = pa.array([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))])
    return _PIECES[key]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  buckets: int | None = None, block_bytes: int = 8 << 20,
                  max_known: int = 400_000) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row, without begin,
    end or added special tokens.

    Null and empty texts have no ids and decode to the empty string; null and
    repeated ids pass through, one output row for each input row; other
    columns are not read.  A task holds one block (``block_bytes`` of text
    or one longer text) or ``max_known`` words."""
    n = buckets or 4 * shuffle_partitions(df.sparkSession)
    parts = shuffle_partitions(df.sparkSession)
    kind = df.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    tok = read_json(tokenizer_path)
    rows = ROW.format(id=kind.simpleString())
    own = (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
           .sortWithinPartitions("doc_id", F.xxhash64("text")))

    def split(texts: bool) -> DataFrame:
        return own.mapInArrow(_split(block_bytes, n, arrow, texts), rows)
    answered = (split(False).repartition(parts, "bucket").sortWithinPartitions("bucket")
                .mapInArrow(_encode(tok, max_known, arrow), rows))
    return split(True).unionByName(answered).groupBy("block").applyInArrow(
        _join(tok, arrow), f"doc_id {kind.simpleString()}, ids array<int>, decoded string")
