"""What the operators share: where to put tables, and how rows reach Python."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of a batch between the JVM and Python, where the session has Spark's own default: batches of whole texts stay a few MB.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed on them (local mode, shared code folder), in small batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a temporary one on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='treeq-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001, S112  the session has ended before
            continue
    _written.clear()


atexit.register(_sweep)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/treeq-llm/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder, in folders by a column, and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_name(name: str) -> str:
    """A column name that no caller's column has."""
    return f"{name}_{uuid.uuid4().hex}"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def by_batch(df: DataFrame, f: Callable[..., dict], schema: str, *, slice_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow with f: RecordBatch -> columns by name. Batches are cut so that f sees about slice_bytes at once, one row at least."""
    names = [x.name for x in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, slice_bytes):
                out = f(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) else pa.array(x) for n in names], names=names)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Workers live on after a task; what Arrow keeps for later goes back to the machine."""
    pa.default_memory_pool().release_unused()


def cut(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    at, n = 0, batch.num_rows
    if n and batch.nbytes > slice_bytes:
        step = max(1, n * slice_bytes // batch.nbytes)
        while at < n:
            yield batch.slice(at, step)
            at += step
    elif n:
        yield batch
