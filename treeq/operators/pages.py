"""Pages of all rows in an order. Rows are skipped by what lies after a key, so that no task takes all of them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns to order by, and 1 for upwards or -1 for downwards; null is the least value.
Order = list[tuple[Column, int]]
#: Up to this many rows, Spark's top lists are used: each task holds no more.
FIRST = 10_000
#: monotonically_increasing_id has the place in the partition below these bits.
PLACE_BITS = 33


def directed(order: Order) -> list[Column]:
    return [c.desc_nulls_last() if d < 0 else c.asc_nulls_first() for c, d in order]


def page(df: DataFrame, order: Order, skip: int, limit: int | None, *, once: bool = False, shared: bool = False) -> DataFrame:
    """df in this order without its first skip rows, limit rows at most.

    Steps read df again, so its rows and keys have to be the same each time. With once, for keys that hang on the order of additions and
    for rows of a limit without an order, df is read once, and rows that are skipped without a small limit go through one task.
    shared: many rows may have the same key, which is then counted before keys are sorted.
    """
    by = directed(order)
    if skip and not once and (limit is None or skip + limit > FIRST):
        df = _after(df, order, skip, shared).orderBy(*by)
    else:
        df = df.orderBy(*by).offset(skip) if skip else df.orderBy(*by)
    return df if limit is None else df.limit(limit)


def _after(df: DataFrame, order: Order, n: int, shared: bool) -> DataFrame:
    """df without its first n rows, unordered: the rows behind the n-th, and of those with its very key as many as the first n leave."""
    names = [f"__key{i}" for i in range(len(order))]
    keys = df.select(*(c.alias(k) for k, (c, _) in zip(names, order, strict=True)))
    keys = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("__rows")) if shared else keys.withColumn("__rows", F.lit(1).cast("long"))
    nth = _nth(keys, names, [(F.col(k), d) for k, (_, d) in zip(names, order, strict=True)], n)
    nth = nth.select(*(F.col(k).alias(f"__nth{i}") for i, k in enumerate(names)), "__gone", "__tied")
    own, edge, columns = [c for c, _ in order], [F.col(f"__nth{i}") for i in range(len(order))], [F.col(f"`{c}`") for c in df.columns]
    behind = df.join(F.broadcast(nth), _behind(own, edge, order))  # one row
    # No row if none is tied: the join is then left out when the query runs. One partition numbers its rows as they come, without keeping or sorting them.
    tied = df.join(F.broadcast(nth.where("__tied")), _same(own, edge)).repartition(1)
    tied = tied.withColumn("__n", F.monotonically_increasing_id()).where(F.col("__n") >= F.col("__gone"))
    return behind.select(*columns).union(tied.select(*columns))


def _nth(keys: DataFrame, names: list[str], order: Order, n: int) -> DataFrame:
    """The key of the n-th row, if there is one, with the number of rows up to it that have its key (__gone) and whether later ones do (__tied). keys: names and __rows that have them."""
    rows = keys.orderBy(*directed(order)).limit(n + 1).withColumn("__place", F.lit(n)) if n <= FIRST else _part(keys, names, order, n)
    of = Window.orderBy(*directed(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.groupBy(*names, "__place").agg(F.sum("__rows").alias("__rows")).withColumn("__upto", F.sum("__rows").over(of))
    before, upto, place = F.col("__upto") - F.col("__rows"), F.col("__upto"), F.col("__place")
    return summed.where((before < place) & (upto >= place)).select(*names, (place - before).alias("__gone"), (upto > place).alias("__tied"))


def _part(keys: DataFrame, names: list[str], order: Order, n: int) -> DataFrame:
    """The keys of that part of the order that holds the n-th row, and its place there. Equal keys are in one part, and there are as many parts as a shuffle has."""
    parts, by = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), directed(order)
    sorted_ = keys.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = sorted_.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1).alias("__at"))
    first = F.collect_list(F.when(F.col("__at") == 0, F.struct(*names)))[0]
    of = Window.orderBy("__part")
    counted = at.groupBy("__part").agg(F.sum("__rows").alias("__rows"), first.alias("__first"))
    counted = counted.select("__first", F.lead("__first").over(of).alias("__next"), (F.sum("__rows").over(of) - F.col("__rows")).alias("__before"), F.col("__rows").alias("__of"))
    one = counted.where((F.col("__before") < n) & (F.col("__before") + F.col("__of") >= n)).select("__first", "__next", (n - F.col("__before")).alias("__place"))
    own, start, end = [F.col(k) for k in names], [F.col("__first")[k] for k in names], [F.col("__next")[k] for k in names]
    inside = (_behind(own, start, order) | _same(own, start)) & (F.col("__next").isNull() | _behind(end, own, order))
    return keys.join(F.broadcast(one), inside).select(*names, "__rows", "__place")  # one row


def _behind(a: list[Column], b: list[Column], order: Order) -> Column:
    """Whether a comes after b, by the first column in which they differ."""
    found = F.lit(False)
    for x, y, (_, d) in reversed(list(zip(a, b, order, strict=True))):
        more = (x < y) | (x.isNull() & y.isNotNull()) if d < 0 else (x > y) | (x.isNotNull() & y.isNull())
        found = F.coalesce(more, F.lit(False)) | (x.eqNullSafe(y) & found)
    return found


def _same(a: list[Column], b: list[Column]) -> Column:
    return functools.reduce(operator.and_, (x.eqNullSafe(y) for x, y in zip(a, b, strict=True)))
