"""Aggregation expressions as columns; what isn't listed is an error."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import ShapeError
from treeq.functions.literals import NUMERIC, plain
from treeq.functions.predicate import Scope, checked_path

#: A lambda's variable, with its type.
Variables = dict[str, tuple[Column, T.DataType]]


class Compiler:
    """Compiles against a scope; (column, type) pairs let arrays and truth values be told apart at planning time."""

    def __init__(self, scope: Scope, variables: Variables | None = None) -> None:
        self.scope, self.variables = scope, variables or {}

    def column(self, e: object) -> Column:
        return self.typed(e)[0]

    def typed(self, e: object) -> tuple[Column, T.DataType]:
        v = plain(e)
        if isinstance(v, str) and v.startswith("$$"):
            name, _, rest = v[2:].partition(".")
            if name not in self.variables:
                raise ShapeError(f"unknown variable $${name}")
            return self._below(*self.variables[name], rest.split(".") if rest else [], v)
        if isinstance(v, str) and v.startswith("$"):
            head, *rest = checked_path(v[1:])
            if head not in self.scope.names:
                raise ShapeError(f"unknown field {v}")
            return self._below(F.col(f"`{head}`"), self.scope.struct[head].dataType, rest, v)
        if isinstance(v, dict) and any(k.startswith("$") for k in v):
            if len(v) != 1:
                raise ShapeError("an expression is one operator")
            op, arg = next(iter(v.items()))
            made = getattr(self, f"op_{op[1:]}", None)
            if made is None:
                raise ShapeError(f"unknown expression {op}")
            return made(arg)
        if isinstance(v, dict):
            parts = {k: self.typed(x) for k, x in v.items()}
            return F.struct(*(c.alias(k) for k, (c, _) in parts.items())), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
        if isinstance(v, list):
            parts = [self.typed(x) for x in v]
            return F.array(*(c for c, _ in parts)), T.ArrayType(parts[0][1] if parts else T.NullType())
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        return F.lit(v), kinds.get(type(v), T.NullType() if v is None else T.TimestampNTZType())

    def _below(self, col: Column, kind: T.DataType, rest: list[str], what: str) -> tuple[Column, T.DataType]:
        if not rest:
            return col, kind
        if isinstance(kind, T.ArrayType):  # the path goes on in every element
            element = kind.elementType
            probe = self._below(F.lit(None), element, rest, what)[1]
            return F.transform(col, lambda x: self._below(x, element, rest, what)[0]), T.ArrayType(probe)
        if not isinstance(kind, T.StructType) or rest[0] not in kind.names:
            raise ShapeError(f"unknown field {what}")
        return self._below(col[rest[0]], kind[rest[0]].dataType, rest[1:], what)

    def truth(self, e: object) -> Column:
        col, kind = self.typed(e)
        if isinstance(kind, T.BooleanType):
            return F.coalesce(col, F.lit(False))
        if isinstance(kind, NUMERIC):
            return F.coalesce(col != 0, F.lit(False))
        return F.lit(False) if isinstance(kind, T.NullType) else col.isNotNull()

    def _args(self, arg: object, n: int, op: str) -> list[object]:
        if not isinstance(arg, list) or len(arg) != n:
            raise ShapeError(f"{op} takes {n} arguments")
        return arg

    def op_literal(self, arg: object) -> tuple[Column, T.DataType]:
        return F.lit(arg), Compiler(self.scope).typed(arg)[1] if not isinstance(arg, str) else T.StringType()

    def op_eq(self, arg: object) -> tuple[Column, T.DataType]:
        a, b = self._args(arg, 2, "$eq")
        return self.column(a).eqNullSafe(self.column(b)), T.BooleanType()

    def op_ne(self, arg: object) -> tuple[Column, T.DataType]:
        return ~self.op_eq(arg)[0], T.BooleanType()

    def op_and(self, arg: object) -> tuple[Column, T.DataType]:
        return functools.reduce(operator.and_, map(self.truth, arg), F.lit(True)), T.BooleanType()

    def op_or(self, arg: object) -> tuple[Column, T.DataType]:
        return functools.reduce(operator.or_, map(self.truth, arg), F.lit(False)), T.BooleanType()

    def op_ifNull(self, arg: object) -> tuple[Column, T.DataType]:  # noqa: N802
        (a, ta), (b, tb) = map(self.typed, self._args(arg, 2, "$ifNull"))
        return F.coalesce(a, b), tb if isinstance(ta, T.NullType) else ta

    def op_cond(self, arg: object) -> tuple[Column, T.DataType]:
        test, yes, no = [arg["if"], arg["then"], arg["else"]] if isinstance(arg, dict) and set(arg) == {"if", "then", "else"} else self._args(arg, 3, "$cond")
        (a, ta), (b, tb) = self.typed(yes), self.typed(no)
        return F.when(self.truth(test), a).otherwise(b), tb if isinstance(ta, T.NullType) else ta

    def op_isArray(self, arg: object) -> tuple[Column, T.DataType]:  # noqa: N802
        arg = arg[0] if isinstance(arg, list) and len(arg) == 1 else arg
        return F.lit(isinstance(self.typed(arg)[1], T.ArrayType)), T.BooleanType()

    def op_in(self, arg: object) -> tuple[Column, T.DataType]:
        (x, tx), (a, ta) = map(self.typed, self._args(arg, 2, "$in"))
        if not isinstance(ta, T.ArrayType):
            raise ShapeError("$in looks into an array")
        found = F.arrays_overlap(x, a) if isinstance(tx, T.ArrayType) else F.array_contains(a, x)
        return F.coalesce(found, F.lit(False)), T.BooleanType()

    def op_arrayElemAt(self, arg: object) -> tuple[Column, T.DataType]:  # noqa: N802
        a, i = self._args(arg, 2, "$arrayElemAt")
        col, kind = self.typed(a)
        if not isinstance(kind, T.ArrayType):
            raise ShapeError("$arrayElemAt takes an array")
        at = F.lit(i + 1 if i >= 0 else i) if isinstance(i, int) else F.when(self.column(i) >= 0, self.column(i) + 1).otherwise(self.column(i)).cast("int")
        return F.try_element_at(col, at), kind.elementType

    def op_filter(self, arg: object) -> tuple[Column, T.DataType]:
        if not isinstance(arg, dict) or not {"input", "cond"} <= set(arg) <= {"input", "cond", "as"}:
            raise ShapeError("$filter takes input, cond and as")
        col, kind = self.typed(arg["input"])
        if not isinstance(kind, T.ArrayType):
            raise ShapeError("$filter takes an array")
        name = arg.get("as", "this")
        return F.filter(col, lambda x: Compiler(self.scope, self.variables | {name: (x, kind.elementType)}).truth(arg["cond"])), kind

    def op_setUnion(self, arg: object) -> tuple[Column, T.DataType]:  # noqa: N802
        parts = [self.typed(x) for x in arg]
        if not parts or not all(isinstance(t, T.ArrayType) for _, t in parts):
            raise ShapeError("$setUnion takes arrays")
        return F.array_distinct(functools.reduce(F.array_union, [c for c, _ in parts])), parts[0][1]

    def op_size(self, arg: object) -> tuple[Column, T.DataType]:
        col, kind = self.typed(arg[0] if isinstance(arg, list) and len(arg) == 1 else arg)
        if not isinstance(kind, T.ArrayType):
            raise ShapeError("$size takes an array")
        return F.size(col), T.IntegerType()

    def op_meta(self, arg: object) -> tuple[Column, T.DataType]:
        if arg != "vectorSearchScore":
            raise ShapeError(f"unknown $meta {arg}")
        return F.col("_score"), T.DoubleType()

    def _numbers(self, arg: object, op: str) -> tuple[Column, T.DataType]:
        col, kind = self.typed(arg)
        col, kind = (col, kind) if isinstance(kind, T.ArrayType) else (F.array(col), T.ArrayType(kind))
        if not isinstance(kind.elementType, NUMERIC) and op in ("$sum", "$avg"):
            raise ShapeError(f"{op} takes numbers")
        return F.array_compact(col), kind.elementType

    def op_sum(self, arg: object) -> tuple[Column, T.DataType]:
        col, kind = self._numbers(arg, "$sum")
        return array_sum(col, kind), T.LongType() if _whole(kind) else T.DoubleType()

    def op_avg(self, arg: object) -> tuple[Column, T.DataType]:
        col, _ = self._numbers(arg, "$avg")
        return F.when(F.size(col) > 0, array_sum(col, T.DoubleType()) / F.size(col)), T.DoubleType()

    def op_min(self, arg: object) -> tuple[Column, T.DataType]:
        col, kind = self._numbers(arg, "$min")
        return F.array_min(col), kind

    def op_max(self, arg: object) -> tuple[Column, T.DataType]:
        col, kind = self._numbers(arg, "$max")
        return F.array_max(col), kind


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def array_sum(col: Column, kind: T.DataType) -> Column:
    """The sum of an array without nulls; 0 if it is empty or null."""
    to = "long" if _whole(kind) else "double"
    return F.coalesce(F.aggregate(col, F.lit(0).cast(to), lambda a, x: a + x.cast(to)), F.lit(0).cast(to))
