"""Relation predicates: parents by what their children are, as semi and anti joins without fan-out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeq.errors import ShapeError
from treeq.functions.predicate import COMPARE
from treeq.operators.group import accumulator
from treeq.operators.relations import is_array
from treeq.schema import Model, Relation

COMPARISONS = (*COMPARE, "$eq", "$ne")
SIMPLE = ("$exists", "$count", "$sum", "$avg", "$min", "$max")


@dataclass
class Predicate:
    relation: Relation
    condition: dict | None
    aggregates: dict[str, dict]  # alias -> {operator: field}
    having: dict | None
    negated: bool = False


def _comparison(what: str, spec: object) -> tuple[str | None, dict]:
    """The field after $of, and one comparison."""
    if not isinstance(spec, dict):
        raise ShapeError(f"{what} takes a comparison")
    of = spec.get("$of")
    rest = {k: v for k, v in spec.items() if k != "$of"}
    if len(rest) != 1 or next(iter(rest)) not in COMPARISONS:
        raise ShapeError(f"{what} takes one of {', '.join(COMPARISONS)}")
    return of, rest


def read(relation: Relation, spec: object) -> Predicate:
    """Short forms, the form {filter, agg, having}, or fields of the child as they are."""
    name = relation.name
    if not isinstance(spec, dict) or not spec:
        raise ShapeError(f"{name} is filtered by an object")
    if {"agg", "having", "filter"} & spec.keys():
        if unknown := spec.keys() - {"filter", "agg", "having"}:
            raise ShapeError(f"{name}: unknown keys {sorted(unknown)}")
        if not isinstance(spec.get("agg"), dict) or not spec["agg"] or not isinstance(spec.get("having"), dict) or not spec["having"]:
            raise ShapeError(f"{name}: agg and having belong together")
        return Predicate(relation, spec.get("filter"), spec["agg"], spec["having"])
    marked = [k for k in spec if k.startswith("$") and k not in ("$and", "$or", "$nor")]
    if not marked:
        return Predicate(relation, spec, {}, None)
    if len(marked) < len(spec):
        raise ShapeError(f"{name}: predicates and fields are mixed")
    kinds = [k for k in spec if k != "$filter"]
    if len(kinds) != 1 or kinds[0] not in SIMPLE:
        raise ShapeError(f"{name}: one of {', '.join(SIMPLE)} is expected")
    kind, inner = kinds[0], spec.get("$filter")
    if kind == "$exists":
        if not isinstance(spec[kind], bool):
            raise ShapeError(f"{name}: $exists is true or false")
        return Predicate(relation, inner, {}, None, negated=not spec[kind])
    of, test = _comparison(f"{name}.{kind}", spec[kind])
    if kind != "$count" and not isinstance(of, str):
        raise ShapeError(f"{name}.{kind} says of which field: $of")
    return Predicate(relation, inner, {"value": {kind: of or "*"}}, {"value": test})


def keys(predicate: Predicate, model: Model, child: DataFrame, having: Callable[[DataFrame, dict], Column]) -> DataFrame:
    """(__key): the foreign keys of children, already filtered, that satisfy the predicate; different ones."""
    rows = child.where(F.col(f"`{predicate.relation.foreign}`").isNotNull())
    key = F.col(f"`{predicate.relation.foreign}`").alias("__key")
    if not predicate.aggregates:
        return rows.select(key)
    made = rows.groupBy(key).agg(*(accumulator(model, alias, spec).alias(alias) for alias, spec in predicate.aggregates.items()))
    return made.where(having(made, predicate.having)).select("__key")


def keep(parent: DataFrame, relation: Relation, found: DataFrame, negated: bool) -> DataFrame:
    """Parents with a key among found, or without one."""
    if is_array(parent, relation.local):
        ids = parent.select(F.col("_id").alias("__pid"), F.explode(f"`{relation.local}`").alias("__pkey"))
        hits = ids.join(found, F.col("__pkey") == F.col("__key"), "left_semi").select("__pid")
        return parent.join(hits, parent["_id"] == hits["__pid"], "left_anti" if negated else "left_semi")
    return parent.join(found, parent[f"`{relation.local}`"] == found["__key"], "left_anti" if negated else "left_semi")


def flag(parent: DataFrame, relation: Relation, found: DataFrame, name: str) -> DataFrame:
    """parent with a boolean column, for a predicate that stands among others: a left join with the different keys."""
    if is_array(parent, relation.local):
        ids = parent.select(F.col("_id").alias("__pid"), F.explode(f"`{relation.local}`").alias("__pkey"))
        found = ids.join(found, F.col("__pkey") == F.col("__key"), "left_semi").select(F.col("__pid").alias("__key"))
        local = "_id"
    else:
        local = relation.local
    hits = found.distinct().select("__key", F.lit(True).alias(name))
    return parent.join(hits, parent[f"`{local}`"] == hits["__key"], "left").drop("__key").withColumn(name, F.col(name).isNotNull())
