"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.session import cut_lineage

#: ASCII white space as a regular expression that Java and RE2 read alike.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in
    ``spark.checkpoint.dir`` (see ``tabsight.session.checkpoint_dir``)."""
    return cut_lineage(df)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for ids whose crc32 (of the id as text) leaves remainder 0; a null
    id counts as empty text (crc32 0), so it is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == 0


def byte_stretches(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` bytes together, or one
    longer text each."""
    kind, width = (np.int32, 4) if texts.type in (pa.string(), pa.binary()) else (np.int64, 8)
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * width).astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def release_memory() -> None:
    """Give memory that a task no longer uses back to the system: Spark keeps
    the Python worker for tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of ``column`` have about ``most``
    bytes: what a task makes of a batch is bounded by bytes, not by rows."""
    for batch in batches:
        for a, b in byte_stretches(batch.column(column), most):
            yield batch.slice(a, b - a)
    release_memory()


def text_udf(returns: str, result: pa.DataType, make: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    """Arrow-batched column function of a text column.  ``make`` is called
    once a task and gives a function from a list of texts to a list of
    results; it gets stretches of a bounded number of bytes."""
    @F.arrow_udf(returns)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in texts:
            if isinstance(batch, pa.ChunkedArray):
                batch = batch.combine_chunks()
            parts = [pa.array(each(batch.slice(a, b - a).to_pylist()), result) for a, b in byte_stretches(batch, 4 << 20)]
            yield pa.concat_arrays(parts) if parts else pa.array([], result)
        release_memory()
    return run
