"""Session helpers.

The library never creates global state: every operator receives its
DataFrames (and through them the session).  ``get_spark`` exists for scripts,
tests and the benchmark only.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tabsight", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder for lineage cuts: the one set on the context,
    else the cluster's ``spark.checkpoint.dir``.  Where neither is set, a
    local session (tests; one machine) gets a folder of its own, and on a
    cluster this is an error, because executors could not read it."""
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tabsight-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never localCheckpoint.
    Spark deletes its files when the DataFrame is no longer referenced, with
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _packed(batches):
    """Arrow batches → compressed Arrow streams, one row a batch."""
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _unpacked(batches):
    import pyarrow as pa
    for batch in batches:
        for blob in batch.column(0):
            with pa.ipc.open_stream(blob.as_buffer()) as rows:
                yield from rows


def cut_lineage_packed(df):
    """``cut_lineage`` of a large table: the checkpoint holds its rows column by
    column and compressed, a fraction of the size of Spark's own.  Rows keep
    their partitions and their order."""
    ship_package(df.sparkSession)
    return cut_lineage(df.mapInArrow(_packed, "block binary")).mapInArrow(_unpacked, df.schema)


def settled(df):
    """A table of one row (fitted statistics), worked out now: a lazy one is
    worked out again by every pass over the rows it is joined to."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (``addPyFile``), once per application:
    Python tasks import its functions by name."""
    sc = spark.sparkContext
    if getattr(sc, "_tabsight_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        target = os.path.join(tempfile.mkdtemp(prefix="tabsight-pkg-"), "tabsight_package.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.join("tabsight", os.path.relpath(path, top)))
        sc.addPyFile(target)
    sc._tabsight_shipped = True


def spread(df, min_partitions: int | None = None):
    """Give CPU-heavy work (tokenising, NumPy scoring) at least one input
    partition per core.  Only the number of partitions decides: a table that
    arrives in fewer is dealt out evenly, any other is left as it is."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def dealt(df, rows_per_task: int = 250_000):
    """``df`` with at most about ``rows_per_task`` rows in a partition, so that
    what a task reads and holds does not grow with the table; one that has
    enough partitions is left as it is."""
    wanted = -(-df.count() // rows_per_task)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
