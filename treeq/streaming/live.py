"""Conditions, projections and windowed groups over streams: an extension, for tables that grow.

A stream has the columns of a model under their logical names; the same compiled conditions filter it. Windowed groups take a
watermark, after which late rows are dropped and their state with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeq.errors import ShapeError
from treeq.functions.predicate import Scope, compile_condition
from treeq.operators.group import accumulator, read_group
from treeq.schema import Model
from treeq.sources.registry import Sources


def stream(spark: SparkSession, sources: Sources, model: Model, path: str, kind: str = "parquet") -> DataFrame:
    """New files of a folder as rows of a model."""
    return sources.logical(model, spark.readStream.schema(sources.stored_schema(model)).format(kind).load(path))


def matching(rows: DataFrame, condition: object) -> DataFrame:
    found = compile_condition(condition, Scope(rows.schema))
    return rows if found is None else rows.where(found)


def windowed(rows: DataFrame, model: Model, time: str, width: str, spec: dict, *, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(start, end, keys, aggregates) of tumbling windows, or sliding ones. late: how long a window waits."""
    by, agg = read_group(model, spec)
    if "." in "".join(by):
        raise ShapeError("keys of a window are fields")
    stamped = rows.withColumn("__time", F.col(f"`{time}`").cast("timestamp")).withWatermark("__time", late)
    window = F.window("__time", width, slide) if slide else F.window("__time", width)
    made = stamped.groupBy(window.alias("__w"), *(F.col(f"`{b}`") for b in by)).agg(*(accumulator(model, a, s).alias(a) for a, s in agg.items()))
    return made.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *by, *agg)


def first_of_each(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """One row for each key within the watermark."""
    return rows.withColumn("__time", F.col(f"`{time}`").cast("timestamp")).withWatermark("__time", late).dropDuplicatesWithinWatermark([key]).drop("__time")


def append(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there now and stops; the checkpoint lets the next call go on where this one ended."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
