"""Related rows as nested columns: joins on one key pair, children filtered, ordered and paged before they are nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import ShapeError
from treeq.schema import Relation

KEY, DOC, ORDER, ID = "__key", "__doc", "__order", "__id"


def is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def key_type(df: DataFrame, local: str) -> T.DataType:
    kind = df.schema[local].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def page(child: DataFrame, by: list[Column], skip: int, limit: int | None) -> DataFrame:
    """Rows skip < n <= skip + limit of each KEY, in this order; the place is ORDER."""
    numbered = child.withColumn(ORDER, F.row_number().over(Window.partitionBy(KEY).orderBy(*by)))
    if limit is not None:
        return numbered.where((F.col(ORDER) > skip) & (F.col(ORDER) <= skip + limit))
    return numbered.where(F.col(ORDER) > skip) if skip else numbered


def grouped(child: DataFrame, alias: str) -> DataFrame:
    """(KEY, alias: array of DOC in ORDER) from (KEY, DOC, ORDER)."""
    listed = F.array_sort(F.collect_list(F.struct(ORDER, DOC)))
    return child.groupBy(KEY).agg(F.transform(listed, lambda x: x[DOC]).alias(alias))


def first(child: DataFrame, alias: str) -> DataFrame:
    """(KEY, alias: the DOC of the least ORDER)."""
    return child.groupBy(KEY).agg(F.min_by(DOC, ORDER).alias(alias))


def nest(parent: DataFrame, relation: Relation, child: DataFrame, *, ordered: list[Column] | None, skip: int, limit: int | None, parent_id: str = "_id") -> DataFrame:
    """parent with a column relation.name of its children. child: (KEY, DOC, ID and columns to order by).

    Without clauses children are in the order of their ids. A one relation never multiplies its parent: the first child counts. Null keys meet nothing.
    """
    name = relation.name
    alias = f"__rel_{name}"
    if is_array(parent, relation.local):
        return _nest_by_array(parent, relation, child, ordered, skip, limit, parent_id)
    if ordered is not None or skip or limit is not None:
        child = page(child, [*(ordered or []), F.col(ID).asc()], skip, limit)
    else:
        child = child.withColumn(ORDER, F.col(ID))
    if relation.many:
        side = grouped(child, alias)
    elif relation.foreign == "_id":
        side = child.select(KEY, F.col(DOC).alias(alias))  # a key: there is one child at most
    else:
        side = first(child, alias)
    joined = parent.join(side, parent[f"`{relation.local}`"] == side[KEY], "left").drop(KEY)
    kind = joined.schema[alias].dataType
    value = F.coalesce(F.col(alias), F.array().cast(kind)) if relation.many else F.col(alias)
    return joined.withColumn(name, value).drop(alias)


def _nest_by_array(parent: DataFrame, relation: Relation, child: DataFrame, ordered: list[Column] | None, skip: int, limit: int | None, parent_id: str) -> DataFrame:
    """The parent's key is an array: its different elements are exploded, joined and gathered for each parent."""
    keys = parent.select(F.col(f"`{parent_id}`").alias("__pid"), F.explode(F.array_distinct(f"`{relation.local}`")).alias("__pkey"))
    met = keys.join(child, F.col("__pkey") == F.col(KEY)).drop(KEY, "__pkey").withColumnRenamed("__pid", KEY)
    if ordered is not None or skip or limit is not None:
        met = page(met, [*(ordered or []), F.col(ID).asc()], skip, limit)
    else:
        met = met.withColumn(ORDER, F.col(ID))
    alias = f"__rel_{relation.name}"
    side = (grouped if relation.many else first)(met, alias)
    joined = parent.join(side, parent[f"`{parent_id}`"] == side[KEY], "left").drop(KEY)
    kind = joined.schema[alias].dataType
    value = F.coalesce(F.col(alias), F.array().cast(kind)) if relation.many else F.col(alias)
    return joined.withColumn(relation.name, value).drop(alias)


def sort_value(parent: DataFrame, relation: Relation, child: DataFrame, field: Column, down: bool, alias: str) -> DataFrame:
    """parent with alias: the child's field for a one relation; of many children the least if it sorts up, the greatest if down. child has KEY."""
    if is_array(parent, relation.local):
        raise ShapeError(f"{relation.name} joins on an array, and nothing sorts by it")
    value = F.max(field) if down else F.min(field)
    if not relation.many:
        value = F.min_by(field, F.col(ID))
    side = child.groupBy(KEY).agg(value.alias(alias))
    return parent.join(side, parent[f"`{relation.local}`"] == side[KEY], "left").drop(KEY)
