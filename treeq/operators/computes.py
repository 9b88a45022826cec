"""Computed columns: aggregates of relations, of inline arrays, and callbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import NotFound, ShapeError
from treeq.functions.expr import array_sum
from treeq.operators.group import aggregate
from treeq.operators.relations import is_array
from treeq.schema import SPARK, ZEROS, Compute, Model


def over_relation(parent: DataFrame, model: Model, computes: list[Compute], child_of: Callable[[str], DataFrame]) -> DataFrame:
    """Aggregates over relations: one grouped child and one left join for each relation, however many computes share it."""
    by_relation: dict[str, list[Compute]] = {}
    for c in computes:
        by_relation.setdefault(c.agg[1].partition(".")[0], []).append(c)
    for name, own in by_relation.items():
        r = model.relations[name]
        child = child_of(name)
        value = lambda c: aggregate(c.agg[0], F.col(f"`{c.agg[1].partition('.')[2]}`") if "." in c.agg[1] else F.lit(1))
        if is_array(parent, r.local):
            keys = parent.select(F.col("_id").alias("__key"), F.explode(F.array_distinct(f"`{r.local}`")).alias("__pkey"))
            rows, local = keys.join(child, F.col("__pkey") == F.col(f"`{r.foreign}`")), "_id"
        else:
            rows, local = child.withColumn("__key", F.col(f"`{r.foreign}`")), r.local
        made = rows.groupBy("__key").agg(*(value(c).alias(f"__c_{c.name}") for c in own))
        parent = parent.join(made, parent[f"`{local}`"] == made["__key"], "left").drop("__key")
        for c in own:
            got = F.col(f"__c_{c.name}")
            parent = parent.withColumn(c.name, F.coalesce(got, F.lit(0)) if c.agg[0] == "$count" else got).drop(f"__c_{c.name}")
    return parent


def inline(df: DataFrame, c: Compute) -> Column:
    """An aggregate of an array field of the row itself."""
    op, path = c.agg
    head, _, rest = path.partition(".")
    col, kind = F.col(f"`{head}`"), df.schema[head].dataType
    if not isinstance(kind, T.ArrayType):
        raise ShapeError(f"{c.name}: {head} is not an array")
    if op == "$size":
        return F.coalesce(F.when(col.isNotNull(), F.size(col)), F.lit(0))
    kind = kind.elementType
    for part in filter(None, rest.split(".")):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise ShapeError(f"{c.name}: unknown field {path}")
        kind = kind[part].dataType
        col = _part(col, part)
    values = F.array_compact(col)
    if op == "$countDistinct":
        return F.coalesce(F.when(values.isNotNull(), F.size(F.array_distinct(values))), F.lit(0))
    if op == "$sum":
        return array_sum(values, kind)
    if op == "$avg":
        return F.when(F.size(values) > 0, array_sum(values, T.DoubleType()) / F.size(values))
    return F.array_min(values) if op == "$min" else F.array_max(values)


def _part(col: Column, name: str) -> Column:
    return F.transform(col, lambda x: x[name])


class Callbacks:
    """Host functions by name.

    fn: either columns -> Column, marked with column=True, which stays in the JVM; or a function of a dict of the columns it depends on.
    batch: a function of a pandas DataFrame of those columns that returns a Series; it gets Arrow batches, never single rows.
    """

    def __init__(self) -> None:
        self.fns: dict[str, tuple[Callable, bool]] = {}
        self.batches: dict[str, Callable[[pd.DataFrame], pd.Series]] = {}

    def set_fn(self, name: str, f: Callable, *, column: bool = False) -> None:
        self.fns[name] = (f, column)

    def set_batch(self, name: str, f: Callable[[pd.DataFrame], pd.Series]) -> None:
        self.batches[name] = f

    def fn(self, df: DataFrame, c: Compute) -> Column:
        if c.fn not in self.fns:
            raise NotFound(f"{c.name}: callback {c.fn} is not set")
        f, is_column = self.fns[c.fn]
        depends = list(c.depends)
        if is_column:
            made = f(*(F.col(f"`{d}`") for d in depends))
        else:
            kind = SPARK[c.type]

            def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
                for part in rows:
                    yield pd.Series([f(dict(zip(depends, r, strict=True))) for r in part.itertuples(index=False, name=None)], dtype=object)

            made = F.pandas_udf(run, kind)(F.struct(*(F.col(f"`{d}`") for d in depends)))
        zero = ZEROS.get(c.type)
        return made if zero in (None, {}, []) else F.coalesce(made, F.lit(zero))

    def batch(self, df: DataFrame, c: Compute) -> DataFrame:
        if c.batch not in self.batches:
            raise NotFound(f"{c.name}: callback {c.batch} is not set")
        f, name = self.batches[c.batch], c.name
        df = df.drop(name)
        depends = list(c.depends)

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in rows:
                part.columns = depends
                yield pd.Series(f(part))

        return df.withColumn(name, F.pandas_udf(run, SPARK[c.type])(F.struct(*(F.col(f"`{d}`") for d in depends))))
