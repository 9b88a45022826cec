"""Exact vector scores and the $near clause."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeq.errors import ShapeError
from treeq.schema import METRICS, Field, Model

#: The longest vector that an index of another engine takes, by what it is; Spark itself ranks exactly up to MAX_DIM.
MAX_DIM, INDEX_DIM = 16_000, {"postgresql": 2000}


def capability(kind: str, options: dict[str, str] | None = None) -> dict:
    """What a source can do for $near. Frames, files and tables are ranked by Spark; so are the rows of a database, which are then read whole."""
    backend = (options or {}).get("url", "").removeprefix("jdbc:").partition(":")[0] if kind == "jdbc" else kind
    if kind not in ("parquet", "json", "csv", "orc", "table", "memory", "jdbc") or (kind == "jdbc" and not backend):
        return {"supported": False, "native": False, "backend": "unknown", "metrics": (), "maxDim": 0}
    return {"supported": True, "native": False, "backend": backend, "metrics": METRICS, "maxDim": min(MAX_DIM, INDEX_DIM.get(backend, MAX_DIM))}


AFTER = ("$or", "$nor", "$not", "$regex", "$expr")


@dataclass(frozen=True)
class Near:
    field: Field
    vector: tuple[float, ...]
    limit: int
    min_score: float | None


def extract(model: Model, condition: object) -> tuple[Near | None, object, object]:
    """(near, what filters before the ranking, what filters after it). $near stands at the top or in $and, once."""
    found: list[Near] = []

    def strip(c: object, top: bool) -> object:
        if not isinstance(c, dict):
            return c
        out = {}
        for k, v in c.items():
            if isinstance(v, dict) and "$near" in v:
                if not top or len(v) != 1:
                    raise ShapeError("$near stands alone, at the top of a condition or in $and")
                found.append(_near(model, k, v["$near"]))
            elif k == "$and" and isinstance(v, list):
                if rest := [x for x in (strip(x, top) for x in v) if x]:
                    out[k] = rest
            else:
                _no_near(v)
                out[k] = v
        return out

    rest = strip(condition, True)
    if len(found) > 1:
        raise ShapeError("$near is given twice")
    if not found:
        return None, condition, None
    parts = []
    for k, v in rest.items():
        parts += v if k == "$and" else [{k: v}]
    late = [p for p in parts if _late(p)]
    early = [p for p in parts if not _late(p)]
    return found[0], {"$and": early} if early else None, {"$and": late} if late else None


def _no_near(v: object) -> None:
    if isinstance(v, dict):
        if "$near" in v:
            raise ShapeError("$near stands at the top of a condition or in $and")
        for x in v.values():
            _no_near(x)
    elif isinstance(v, list):
        for x in v:
            _no_near(x)


def _late(p: object) -> bool:
    return isinstance(p, dict) and any(k in AFTER or (isinstance(v, dict) and any(o in AFTER for o in v)) for k, v in p.items())


def _near(model: Model, name: str, spec: object) -> Near:
    f = model.fields.get(name)
    if f is None or f.type != "vector":
        raise ShapeError(f"{name} is not a vector")
    if not isinstance(spec, dict) or not {"$vector", "$limit"} <= set(spec) <= {"$vector", "$limit", "$minScore"}:
        raise ShapeError("$near takes $vector, $limit and $minScore")
    v, n, least = spec["$vector"], spec["$limit"], spec.get("$minScore")
    if not isinstance(v, list) or len(v) != f.dim or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in v):
        raise ShapeError(f"{name} is compared with {f.dim} finite numbers")
    if f.metric == "cosine" and not any(v):
        raise ShapeError("a cosine needs a vector that isn't zero")
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= 5000:
        raise ShapeError("$limit of $near is from 1 to 5000")
    if least is not None and (not isinstance(least, (int, float)) or (f.metric != "ip" and not 0 <= least <= 1)):
        raise ShapeError("$minScore is from 0 to 1")
    return Near(f, tuple(map(float, v)), n, least)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def score(vector: Column, near: Near) -> Column:
    """cosine, 1 / (1 + distance) or inner product, in doubles; a vector of another length is an error."""
    q = F.array(*map(F.lit, near.vector))
    v = vector.cast("array<double>")
    dot = _total(F.zip_with(v, q, lambda a, b: a * b))
    norm = F.sqrt(_total(F.transform(v, lambda a: a * a)))
    if near.field.metric == "cosine":
        s = dot / (norm * F.lit(math.sqrt(sum(x * x for x in near.vector))))
    elif near.field.metric == "l2":
        s = 1 / (1 + F.sqrt(_total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))))
    else:
        s = dot
    wrong = F.raise_error(F.concat(F.lit(f"{near.field.name} has not {near.field.dim} components but "), F.size(v).cast("string")))
    return F.when(v.isNull() | (F.size(v) != near.field.dim), wrong.cast("double")).when(norm == 0, None).otherwise(s)
