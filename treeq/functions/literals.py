"""Values of parameters as columns of a declared type, extended JSON included."""

from __future__ import annotations

import base64
import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import ShapeError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def plain(v: object) -> object:
    """Extended JSON to Python; other values as they are."""
    if isinstance(v, dict) and len(v) == 1:
        key, x = next(iter(v.items()))
        if key == "$oid":
            return str(x)
        if key == "$numberLong":
            return int(x)
        if key == "$numberDecimal":
            return Decimal(str(x))
        if key == "$binary":
            return base64.b64decode(x["base64"] if isinstance(x, dict) else x)
        if key == "$date":
            if isinstance(x, dict):
                x = plain(x)
            if isinstance(x, (int, float)):
                return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=x)
            return dt.datetime.fromisoformat(str(x).replace("Z", "+00:00")).replace(tzinfo=None)
    return v


def literal(v: object, kind: T.DataType, what: str) -> Column:
    """v as a column that compares with one of this kind; another kind of value is an error, not a silent cast."""
    v = plain(v)
    if v is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.BooleanType):
        ok = isinstance(v, bool)
    elif isinstance(kind, NUMERIC):
        ok = isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
    elif isinstance(kind, T.StringType):
        ok = isinstance(v, str)
    elif isinstance(kind, TIMES):
        if isinstance(v, str):
            v = dt.datetime.fromisoformat(v)
        ok = isinstance(v, (dt.datetime, dt.date))
        if ok:
            return F.lit(v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()).cast(kind)
    elif isinstance(kind, T.BinaryType):
        ok = isinstance(v, bytes)
    elif isinstance(kind, T.ArrayType):
        if not isinstance(v, list):
            raise ShapeError(f"{what} is compared with {type(v).__name__}")
        return F.array(*(literal(x, kind.elementType, what) for x in v)).cast(kind)
    elif isinstance(kind, T.StructType):
        if not isinstance(v, dict) or set(v) != set(kind.names):
            raise ShapeError(f"{what} is compared with an object of other keys")
        return F.struct(*(literal(v[f.name], f.dataType, f"{what}.{f.name}").alias(f.name) for f in kind.fields)).cast(kind)
    else:
        raise ShapeError(f"{what} has a type that can't be compared")
    if not ok:
        raise ShapeError(f"{what} ({kind.simpleString()}) is compared with {type(v).__name__}")
    return F.lit(v)
