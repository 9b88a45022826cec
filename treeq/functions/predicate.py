"""Conditions as columns.

Two-valued: a leaf is true or false, also on nulls. Leaves that are conjuncts at the top stay bare comparisons, so that they reach
the scan; a filter drops nulls as it drops false. Everywhere else leaves are wrapped.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import ShapeError
from treeq.functions.literals import NUMERIC, literal, plain

COMPARE = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
OPERATORS = {*COMPARE, "$eq", "$ne", "$in", "$nin", "$exists", "$not", "$regex", "$options"}
FORBIDDEN = {"$where", "$function", "$accumulator"}
SEGMENT = re.compile(r"[A-Za-z0-9_\-一-鿿]+")
PRESENT = "__present"


def checked_path(path: str) -> list[str]:
    parts = path.split(".")
    for p in parts:
        if not SEGMENT.fullmatch(p):
            raise ShapeError(f"{path}: {p!r} can't be a part of a path")
        if p.isdigit():
            raise ShapeError(f"{path}: places in arrays can't be named")
    return parts


def check(condition: object) -> None:
    """Shapes that no one may use, anywhere in a condition."""
    if isinstance(condition, dict):
        for k, v in condition.items():
            if k in FORBIDDEN:
                raise ShapeError(f"{k} is not allowed")
            if k in ("$and", "$or", "$nor") and (not isinstance(v, list) or not v):
                raise ShapeError(f"{k} takes a list that isn't empty")
            check(v)
    elif isinstance(condition, list):
        for x in condition:
            check(x)


class Scope:
    """The columns that a condition may name."""

    def __init__(self, struct: T.StructType, hidden: tuple[str, ...] = ()) -> None:
        self.struct, self.present = struct, PRESENT in struct.names
        self.names = set(struct.names) - set(hidden) - {PRESENT}

    def resolve(self, path: str) -> tuple[Column, T.DataType, list[str]]:
        """The column, its type and the parts of the path below the first array of structs."""
        head, *rest = checked_path(path)
        if head not in self.names:
            raise ShapeError(f"unknown field {path}")
        col, kind = F.col(f"`{head}`"), self.struct[head].dataType
        while rest:
            if isinstance(kind, T.ArrayType):
                return col, kind, rest
            if not isinstance(kind, T.StructType) or rest[0] not in kind.names:
                raise ShapeError(f"unknown field {path}")
            col, kind = col[rest[0]], kind[rest[0]].dataType
            rest = rest[1:]
        return col, kind, []

    def there(self, path: str) -> Column | None:
        """Whether a value, null or not, is there; None: always. A part is there only in an object; PRESENT may name parts, and tells all of an object's that are there if it names one."""
        head, *rest = path.split(".")
        col, found = F.col(f"`{head}`"), []
        if self.present:
            names = F.col(PRESENT)
            whole = F.array_contains(names, head)
            found.append(F.array_contains(names, path) | (whole & ~F.exists(names, lambda x: x.startswith(f"{head}."))) if rest else whole)
        for part in rest:
            found.append(col.isNotNull())
            col = col[part]
        return functools.reduce(operator.and_, found) if found else None


def compile_condition(condition: object, scope: Scope, special: Callable[[str, object], Column | None] = lambda k, v: None, expression: Callable[[object], Column] | None = None) -> Column | None:
    """None if everything matches. special may take a key over, as relations do; expression compiles $expr."""
    if condition is None or condition == {}:
        return None
    if not isinstance(condition, dict):
        raise ShapeError("a condition is an object")
    check(condition)
    return _and(condition, scope, special, expression, bare=True)


def _and(condition: dict, scope: Scope, special: Callable, expression: Callable | None, *, bare: bool) -> Column:
    if not isinstance(condition, dict):
        raise ShapeError("a condition is an object")
    parts: list[Column] = []
    inner = functools.partial(_and, scope=scope, special=special, expression=expression)
    for k, v in condition.items():
        if (own := special(k, v)) is not None:
            parts.append(own)
        elif k == "$and":
            parts += [inner(c, bare=bare) for c in v]
        elif k == "$or":
            parts.append(functools.reduce(operator.or_, [inner(c, bare=False) for c in v]))
        elif k == "$nor":
            parts.append(~functools.reduce(operator.or_, [inner(c, bare=False) for c in v]))
        elif k == "$expr":
            if expression is None:
                raise ShapeError("$expr is not allowed here")
            parts.append(F.coalesce(expression(v), F.lit(False)))
        elif k.startswith("$"):
            raise ShapeError(f"unknown operator {k}")
        else:
            parts.append(_leaf(k, v, scope, bare))
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def _is_operators(v: object) -> bool:
    v = plain(v)
    if not isinstance(v, dict) or not v:
        return False
    marked = [k.startswith("$") for k in v]
    if any(marked) and not all(marked):
        raise ShapeError("operators and fields are mixed")
    return all(marked)


def _leaf(path: str, v: object, scope: Scope, bare: bool) -> Column:
    col, kind, rest = scope.resolve(path)
    return _on(col, kind, rest, v, path, None if rest else scope.there(path), bare)


def _on(col: Column, kind: T.DataType, rest: list[str], v: object, path: str, present: Column | None, bare: bool) -> Column:
    """The condition v on a column, below an array on any of its elements."""
    if not rest:
        return _test(col, kind, v, path, present, bare)
    element = kind.elementType
    if not isinstance(element, T.StructType) or rest[0] not in element.names:
        raise ShapeError(f"unknown field {path}")
    negative = {"$ne": "$eq", "$nin": "$in"}
    if _is_operators(v):
        parts = []
        for op, x in v.items():
            if op == "$options":
                continue
            if op in negative:
                parts.append(~_on(col, kind, rest, {negative[op]: x}, path, None, False))
            elif op == "$not":
                parts.append(~_on(col, kind, rest, x, path, None, False))
            else:
                one = {op: x} | ({"$options": v["$options"]} if op == "$regex" and "$options" in v else {})
                parts.append(_any_below(col, element, rest, one, path))
        return functools.reduce(operator.and_, parts)
    return _any_below(col, element, rest, v, path)


def _any_below(col: Column, element: T.StructType, rest: list[str], v: object, path: str) -> Column:
    return F.coalesce(F.exists(col, lambda e: _on(e[rest[0]], element[rest[0]].dataType, rest[1:], v, path, None, False)), F.lit(False))


def _any_element(col: Column, compare: Callable, value: Column) -> Column:
    return F.exists(col, lambda e: compare(e, value))


def _test(col: Column, kind: T.DataType, v: object, path: str, present: Column | None, bare: bool) -> Column:
    if not _is_operators(v):
        return _equal(col, kind, v, path, present, bare)
    if not v.keys() <= OPERATORS:
        raise ShapeError(f"unknown operator {sorted(v.keys() - OPERATORS)[0]}")
    if "$options" in v and "$regex" not in v:
        raise ShapeError("$options goes with $regex")
    safe = (lambda c: c) if bare else (lambda c: F.coalesce(c, F.lit(False)))
    parts = []
    for op, x in v.items():
        if op == "$options":
            continue
        if op == "$eq":
            parts.append(_equal(col, kind, x, path, present, bare))
        elif op == "$ne":
            parts.append(col.isNotNull() if x is None and present is None else ~_equal(col, kind, x, path, present, False))
        elif op in COMPARE:
            if isinstance(kind, T.ArrayType) and not isinstance(plain(x), list):
                value = literal(x, kind.elementType, path)
                parts.append(safe(_any_element(col, COMPARE[op], value)))
            else:
                if x is None:
                    raise ShapeError(f"{path}: {op} takes a value")
                parts.append(safe(COMPARE[op](col, literal(x, kind, path))))
        elif op in ("$in", "$nin"):
            inside = _inside(col, kind, x, path, present)
            parts.append(~F.coalesce(inside, F.lit(False)) if op == "$nin" else safe(inside))
        elif op == "$exists":
            there = present if present is not None else F.lit(True)
            parts.append(there if x else ~there)
        elif op == "$not":
            parts.append(~_test(col, kind, x, path, present, False))
        else:
            parts.append(safe(_matches(col, kind, x, v.get("$options", ""), path)))
    return functools.reduce(operator.and_, parts)


def _equal(col: Column, kind: T.DataType, v: object, path: str, present: Column | None, bare: bool) -> Column:
    v = plain(v)
    if v is None:
        return col.isNull() if present is None else col.isNull() & present
    if isinstance(kind, T.ArrayType) and not isinstance(v, list):
        return F.coalesce(F.array_contains(col, literal(v, kind.elementType, path)), F.lit(False))
    value = literal(v, kind, path)
    return col == value if bare else F.coalesce(col == value, F.lit(False))


def _inside(col: Column, kind: T.DataType, values: object, path: str, present: Column | None) -> Column:
    if not isinstance(values, list):
        raise ShapeError(f"{path}: $in takes a list")
    whole = [x for x in values if x is not None]
    if isinstance(kind, T.ArrayType):
        if not whole:
            return F.lit(False)
        return F.arrays_overlap(col, F.array(*(literal(x, kind.elementType, path) for x in whole)).cast(T.ArrayType(kind.elementType)))
    if isinstance(kind, NUMERIC) or not whole:
        found = col.isin([plain(x) for x in whole]) if whole and all(literal(x, kind, path) is not None for x in whole) else F.lit(False)
    else:
        found = col.isin([literal(x, kind, path) for x in whole])
    null = col.isNull() if present is None else col.isNull() & present
    return F.coalesce(found, F.lit(False)) | null if len(whole) < len(values) else found


def _matches(col: Column, kind: T.DataType, pattern: object, flags: str, path: str) -> Column:
    if not isinstance(pattern, str) or set(flags) - set("ims"):
        raise ShapeError(f"{path}: $regex takes a string, and the options i, m, s")
    if re.search(r"\(\?<?[=!]", pattern):
        raise ShapeError(f"{path}: look-around is not part of the pattern language")
    pattern = f"(?{flags})" * bool(flags) + pattern
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.exists(col, lambda e: e.rlike(pattern))
    return col.rlike(pattern) if isinstance(kind, T.StringType) else F.lit(False)
