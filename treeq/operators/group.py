"""$group and $having, and the five aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeq.errors import ShapeError
from treeq.schema import AGGREGATES, NUMBERS, Model


def accumulator(model: Model, alias: str, spec: object) -> Column:
    """{operator: field}. Nulls don't count; of no values $count is 0 and the others are null."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ShapeError(f"{alias} is one operator with a field")
    op, name = next(iter(spec.items()))
    if op not in AGGREGATES:
        raise ShapeError(f"unknown aggregate {op}")
    if name == "*":
        if op != "$count":
            raise ShapeError(f"{op} takes a field")
        return F.count(F.lit(1))
    f = model.field_at(name) if isinstance(name, str) and "." not in name else None
    if f is None or f.type in ("array", "object", "vector"):
        raise ShapeError(f"{alias}: {name} is not a scalar field of {model.name}")
    if op in ("$sum", "$avg") and f.type not in NUMBERS:
        raise ShapeError(f"{alias}: {op} takes numbers, and {name} is {f.type}")
    col = F.col(f"`{name}`")
    return aggregate(op, col)


def aggregate(op: str, col: Column) -> Column:
    return {"$count": F.count, "$sum": F.sum, "$avg": lambda c: F.avg(c.cast("double")), "$min": F.min, "$max": F.max}[op](col)


def read_group(model: Model, spec: object) -> tuple[list[str], dict[str, dict]]:
    """Keys and aggregates of {by, agg}."""
    if not isinstance(spec, dict) or set(spec) - {"by", "agg"}:
        raise ShapeError("$group takes by and agg")
    by, agg = spec.get("by", []), spec.get("agg", {})
    by = [by] if isinstance(by, str) else by
    if not isinstance(by, list) or not all(isinstance(b, str) for b in by) or len(set(by)) < len(by):
        raise ShapeError("by is a list of different fields")
    if not isinstance(agg, dict) or any("." in a or a.startswith("$") or not a for a in agg):
        raise ShapeError("agg is an object of aliases")
    if not by and not agg:
        raise ShapeError("$group has a key or an aggregate")
    if both := set(by) & set(agg):
        raise ShapeError(f"{sorted(both)} are keys and aliases")
    return by, agg


def check_key(model: Model, path: str) -> str | None:
    """None for a field of the model, else the one relation that the path begins with."""
    head, _, rest = path.partition(".")
    if head in model.relations:
        if not rest or "." in rest:
            raise ShapeError(f"{path}: a group key in a relation is one of its fields")
        if model.relations[head].many:
            raise ShapeError(f"{path}: {head} has many rows, and can't be a group key")
        return head
    f = model.field_at(path)
    if f is None:
        raise ShapeError(f"{path} is not a field of {model.name}")
    if f.type in ("array", "vector") or (f.type == "object"):
        raise ShapeError(f"{path} is not scalar, and can't be a group key")
    return None


def check_having(spec: object, names: set[str]) -> None:
    if not isinstance(spec, dict) or not spec:
        raise ShapeError("$having is an object")
    for k, v in spec.items():
        if k in ("$and", "$or", "$nor"):
            if not isinstance(v, list) or not v:
                raise ShapeError(f"{k} takes a list that isn't empty")
            for x in v:
                check_having(x, names)
        elif k not in names:
            raise ShapeError(f"$having names {k}, which is no key or alias")
