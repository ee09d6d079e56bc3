"""What the operators of this subpackage share: shared tables, batches, worker caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Bytes of one Arrow batch sent to a Python worker, and rows in it.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048

_written: dict[str, SparkSession] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    It is set only where it is unset, as in tests on one machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What a write inside shuffles is deleted when it ends, and not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks it ran. The
    table is deleted by :func:`discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._quern_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stash` that no frame reads any more; other frames are left alone."""
    for path in [p for t in tables if (p := getattr(t, "_quern_path", None)) in _written]:
        spark = _written.pop(path)
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as why:  # noqa: BLE001 - a table that stays, or a session that is gone, stops nothing
            print(f"quern: {path} was not deleted: {type(why).__name__}", file=sys.stderr)


def release() -> None:
    """Delete all tables that :func:`stash` wrote; frames that read them end with that."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is None:
            del _written[path]  # the session is gone
            continue
        table = type("Table", (), {"_quern_path": path})()
        discard(table)


#: Rows of a narrow table that is broadcast.
BROADCAST_ROWS = 500_000


def kept(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table of a few numbers a row, written and counted: marked for broadcast if it
    has up to ``rows`` rows. Larger ones are joined by a shuffle, where Spark splits skewed keys."""
    table = stash(df, name)
    if table.count() > rows:
        return table
    path, table = table._quern_path, broadcast(table)
    table._quern_path = path
    return table


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have, whatever their case."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, by bytes and rows, whatever the texts' length.

    Frames are lazy, so the two options stay set in the session; they steer batches only.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def worker_cache(name: str) -> dict:
    """A dictionary that this Python worker keeps from task to task of the operator ``name``."""
    return sys.__dict__.setdefault("_quern_cache", {}).setdefault(name, {})


def begin_task(name: str) -> None:
    """Workers are used again: what other operators remember in this one goes."""
    cache = sys.__dict__.setdefault("_quern_cache", {})
    if others := [k for k in cache if k != name]:
        for k in others:
            del cache[k]
        end_task()


def end_task() -> None:
    """Gives memory that nothing uses back to the system, which the worker would keep between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, name: str) -> DataFrame:
    """``df.mapInArrow(run)`` whose tasks leave no memory behind, besides the cache of ``name``."""

    def task(batches):
        begin_task(name)
        try:
            yield from run(batches)
        finally:
            end_task()

    return df.mapInArrow(task, schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [columns[f.name]]], schema=schema)


def texts(column) -> list[str]:
    """The strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
