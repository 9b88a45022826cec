"""Pipelines of stages and commands, folded over DataFrames: each stage is lazy, and an unknown one is an error."""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import ShapeError
from treeq.functions.expr import Compiler
from treeq.functions.predicate import Scope, compile_condition
from treeq.operators import pages
from treeq.operators.group import aggregate
from treeq.schema import AGGREGATES

FORBIDDEN = ("$out", "$merge")
#: Stages whose rows are made of one row each, and so are the same when they are made again.
SINGLE = ("$match", "$project", "$addFields", "$set", "$replaceRoot", "$unwind", "$sort")
#: Rows of one branch of $facet, and of a $lookup list that all documents share.
LIST_ROWS = 100_000
#: In the stages of a $lookup: columns with the values of the outer documents that a row belongs to, and its place among their rows.
OUTER, PLACE = "__outer", "__place"
Tables = Callable[[str], DataFrame]


def run(df: DataFrame, stages: list[dict], tables: Tables, variables: dict[str, tuple[str, T.DataType]] | None = None, *, once: bool = False) -> DataFrame:
    """once: df may have other rows when it is read again."""
    rest = list(stages)
    while rest:
        names = [next(iter(s)) if isinstance(s, dict) and len(s) == 1 else None for s in rest[:3]]
        if names[:2] == ["$sort", "$skip"] and not outer(df):
            taken = 3 if names[2:] == ["$limit"] else 2
            most = _count(rest[2]["$limit"], "$limit") if taken == 3 else None
            df = pages.page(df, _order(df, rest[0]["$sort"]), _count(rest[1]["$skip"], "$skip"), most, once=once, shared="_id" not in df.columns)
        else:
            taken, df = 1, apply(df, rest[0], tables, variables or {})
        once = once or not set(names[:taken]) <= set(SINGLE)
        rest = rest[taken:]
    return df


def apply(df: DataFrame, stage: dict, tables: Tables, variables: dict) -> DataFrame:
    if not isinstance(stage, dict) or len(stage) != 1:
        raise ShapeError("a stage is an object of one key")
    name, spec = next(iter(stage.items()))
    if name in FORBIDDEN:
        raise ShapeError(f"{name} is not allowed")
    made = STAGES.get(name)
    if made is None:
        raise ShapeError(f"unknown stage {name}")
    return made(df, spec, tables, variables)


def compiler(df: DataFrame, variables: dict) -> Compiler:
    return Compiler(Scope(df.schema), {k: (F.col(c), kind) for k, (c, kind) in variables.items()})


def outer(df: DataFrame) -> list[str]:
    """The columns that tell which outer documents a row is for; [] outside of $lookup. With them, order and pages are by outer document."""
    return [c for c in df.columns if c.startswith(OUTER)]


def _carried(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(OUTER) or c == PLACE]


def _placed(df: DataFrame) -> DataFrame:
    if PLACE in df.columns:
        return df
    if "_id" not in df.columns:
        raise ShapeError("$skip and $limit in a $lookup follow $sort, or rows with an _id")
    return df.withColumn(PLACE, F.row_number().over(Window.partitionBy(*outer(df)).orderBy("_id")))


def match(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    found = compile_condition(spec, Scope(df.schema), expression=compiler(df, variables).truth)
    return df if found is None else df.where(found)


def _order(df: DataFrame, spec: object) -> pages.Order:
    pairs = list(spec.items()) if isinstance(spec, dict) else spec
    if not pairs or not isinstance(pairs, list):
        raise ShapeError("$sort names a field")
    order: pages.Order = []
    for path, d in pairs:
        col, kind, below = Scope(df.schema).resolve(path)
        if below:
            raise ShapeError(f"nothing sorts by {path}")
        col = F.array_min(col) if isinstance(kind, T.ArrayType) else col
        order.append((col, d))
    if "_id" in df.columns and all(p != "_id" for p, _ in pairs) and not isinstance(df.schema["_id"].dataType, (T.MapType, T.VariantType)):
        order.append((F.col("_id"), 1))
    return order


def sort(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    by = pages.directed(_order(df, spec))
    if of := outer(df):
        return df.withColumn(PLACE, F.row_number().over(Window.partitionBy(*of).orderBy(*by)))
    return df.orderBy(*by)


def _count(spec: object, name: str) -> int:
    if not isinstance(spec, int) or isinstance(spec, bool) or spec < 0:
        raise ShapeError(f"{name} is a whole number from 0")
    return spec


def skip(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    n = _count(spec, "$skip")
    if outer(df):
        return _placed(df).where(F.col(PLACE) > n).withColumn(PLACE, F.col(PLACE) - n)
    return df.offset(n)


def limit(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    n = _count(spec, "$limit")
    return _placed(df).where(F.col(PLACE) <= n) if outer(df) else df.limit(n)


def project(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    """Fields in, fields out, or expressions; _id stays unless it is put out."""
    if not isinstance(spec, dict) or not spec:
        raise ShapeError("$project names a field")
    flags = {k: bool(v) for k, v in spec.items() if isinstance(v, bool) or v in (0, 1)}
    rest = {k: v for k, v in spec.items() if k not in flags}
    for k, v in rest.items():
        if isinstance(v, (int, float)) or v is None:
            raise ShapeError(f"$project {k} is 0, 1 or an expression")
    shown = {k for k, on in flags.items() if on}
    hidden = {k for k, on in flags.items() if not on and k != "_id"}
    if hidden and (shown - {"_id"} or rest):
        raise ShapeError("fields that are put in and out are mixed")
    if hidden or (not shown and not rest):
        for path in [k for k, on in flags.items() if not on]:
            df = _without(df, path)
        return df
    c = compiler(df, variables)
    out = [F.col("_id")] if flags.get("_id", True) and "_id" in df.columns and "_id" not in rest else []
    tree: dict[str, list[str]] = {}
    for k in spec:
        if k in shown and k != "_id":
            head, _, below = k.partition(".")
            tree.setdefault(head, [])
            if below:
                tree[head].append(below)
        elif k in rest:
            tree.setdefault(k, [])
    for head, paths in tree.items():
        if head in rest:
            out.append(c.column(rest[head]).alias(head))
        else:
            Scope(df.schema).resolve(head)
            out.append((_only(F.col(f"`{head}`"), df.schema[head].dataType, paths) if paths and head not in shown else F.col(f"`{head}`")).alias(head))
    return df.select(*out, *_carried(df))


def _only(col: Column, kind: T.DataType, paths: list[str]) -> Column:
    """A struct, or each struct of an array, with only these parts."""
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _only(x, kind.elementType, paths))
    if not isinstance(kind, T.StructType):
        raise ShapeError(f"no parts {paths}")
    parts: dict[str, list[str]] = {}
    for p in paths:
        head, _, below = p.partition(".")
        parts.setdefault(head, [])
        if below:
            parts[head].append(below)
    if missing := set(parts) - set(kind.names):
        raise ShapeError(f"no parts {sorted(missing)}")
    made = F.struct(*((_only(col[h], kind[h].dataType, b) if b else col[h]).alias(h) for h, b in parts.items()))
    return F.when(col.isNotNull(), made)


def _without(df: DataFrame, path: str) -> DataFrame:
    head, _, below = path.partition(".")
    if head not in df.columns:
        raise ShapeError(f"unknown field {path}")
    if not below:
        return df.drop(head)

    def drop(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: drop(x, kind.elementType))
        return col.dropFields(below)

    return df.withColumn(head, drop(F.col(f"`{head}`"), df.schema[head].dataType))


def add_fields(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    if not isinstance(spec, dict) or not spec:
        raise ShapeError("$addFields names a field")
    c = compiler(df, variables)
    made = {path: c.column(e) for path, e in spec.items()}
    for path, col in made.items():
        head, *rest = path.split(".")
        if not rest:
            df = df.withColumn(head, col)
        else:
            for name in reversed(rest[1:]):
                col = F.struct(col.alias(name))
            there = head in df.columns and isinstance(df.schema[head].dataType, T.StructType)
            whole = F.struct(col.alias(rest[0]))
            df = df.withColumn(head, F.coalesce(F.col(f"`{head}`").withField(rest[0], col), F.struct(*(F.lit(None).cast(x.dataType).alias(x.name) for x in df.schema[head].dataType.fields)).withField(rest[0], col)) if there else whole)
    return df


def replace_root(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    if not isinstance(spec, dict) or set(spec) != {"newRoot"}:
        raise ShapeError("$replaceRoot takes newRoot")
    col, kind = compiler(df, variables).typed(spec["newRoot"])
    if not isinstance(kind, T.StructType):
        raise ShapeError("newRoot is a document")
    return df.select(F.when(col.isNull(), F.raise_error(F.lit("newRoot is not a document")).cast(kind)).otherwise(col).alias("__root"), *_carried(df)).select("__root.*", *_carried(df))


def unwind(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    spec = {"path": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or set(spec) - {"path", "preserveNullAndEmptyArrays"} or not str(spec.get("path", "")).startswith("$"):
        raise ShapeError("$unwind takes a path that begins with $")
    name, keep = spec["path"][1:], bool(spec.get("preserveNullAndEmptyArrays"))
    col, kind, below = Scope(df.schema).resolve(name)
    if below:
        raise ShapeError(f"{name}: $unwind goes through one array at a time")
    if not isinstance(kind, T.ArrayType):
        return df if keep else df.where(col.isNotNull())
    explode = F.explode_outer if keep else F.explode
    head, _, rest = name.partition(".")
    if not rest:
        return df.select(*(explode(col).alias(c) if c == name else F.col(f"`{c}`") for c in df.columns))
    made = df.select("*", explode(col).alias("__one"))
    return made.withColumn(head, F.col(f"`{head}`").withField(rest, F.col("__one"))).drop("__one")


def group(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise ShapeError("$group has an _id")
    c = compiler(df, variables)
    aggs = []
    for alias, a in spec.items():
        if alias == "_id":
            continue
        if not isinstance(a, dict) or len(a) != 1 or next(iter(a)) not in AGGREGATES:
            raise ShapeError(f"{alias}: unknown aggregate")
        op, e = next(iter(a.items()))
        value = F.lit(1) if op == "$count" or (op == "$sum" and e == 1) else c.column(e)
        aggs.append(aggregate(op, value).alias(alias))
    aggs = aggs or [F.count(F.lit(1)).alias("__n")]
    if spec["_id"] is None and not outer(df):
        return df.agg(*aggs).withColumn("_id", F.lit(None).cast("string")).select("_id", *(a for a in spec if a != "_id"))
    key = F.lit(None).cast("string") if spec["_id"] is None else c.column(spec["_id"])
    return df.groupBy(key.alias("_id"), *outer(df)).agg(*aggs).select("_id", *(a for a in spec if a != "_id"), *outer(df))


def _listed(df: DataFrame, name: str) -> DataFrame:
    """One row: all rows as one array, in their order; an error beyond LIST_ROWS."""
    made = df.limit(LIST_ROWS + 1).agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(name))
    many = F.raise_error(F.lit(f"{name} has more than {LIST_ROWS} rows")).cast(made.schema[name].dataType)
    return made.select(F.when(F.size(name) > LIST_ROWS, many).otherwise(F.col(f"`{name}`")).alias(name))


def facet(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    """One row, an array of rows for each branch: meant for branches that end in few rows, as all of a branch is one value."""
    if not isinstance(spec, dict) or not spec:
        raise ShapeError("$facet names a branch")
    if outer(df):
        raise ShapeError("$facet doesn't stand in a $lookup")
    out = None
    for name, stages in spec.items():
        if any("$facet" in s for s in stages):
            raise ShapeError("$facet doesn't nest")
        one = _listed(run(df, stages, tables, variables, once=True), name)
        out = one if out is None else out.join(F.broadcast(one), how="cross")  # one row each
    return out


def lookup(df: DataFrame, spec: object, tables: Tables, variables: dict) -> DataFrame:
    """For each document the documents of another table, as an array.

    Short form: those of which a key is a key of the document; arrays are exploded, and null meets null and missing. Long form: let names
    values of the document, and the first stage, a $match, holds an equality of a field with each way to tell documents apart.
    The stages run for each document by itself: rows are joined with the different values first, then sorted, paged and grouped by them.
    """
    if not isinstance(spec, dict) or not {"from", "as"} <= set(spec) <= {"from", "as", "localField", "foreignField", "let", "pipeline"}:
        raise ShapeError("$lookup takes from and as, localField and foreignField, or let and pipeline")
    stages = spec.get("pipeline", [])
    if "localField" in spec and "let" in spec or "localField" not in spec and "pipeline" not in spec:
        raise ShapeError("$lookup takes either localField or let and pipeline")
    if "localField" in spec:
        return _by_field(df, spec, stages, tables, variables)
    let, name = spec.get("let", {}), spec["as"]
    own = {n: (f"{OUTER}{len(outer(df)) + i}", *compiler(df, variables).typed(e)) for i, (n, e) in enumerate(let.items())}
    pairs, rest = _equalities(stages[0]["$match"], set(let)) if stages and set(stages[0]) == {"$match"} else ([], None)
    if not pairs:
        if any(f"$${n}" in json.dumps(stages, default=str) for n in own) or outer(df):
            raise ShapeError("$lookup compares a field with each variable that it uses: {$expr: {$eq: ['$field', '$$name']}}")
        return df.join(F.broadcast(_listed(run(tables(spec["from"]), stages, tables, variables), name)), how="cross")  # one row
    parents = df.withColumns({c: col for c, col, _ in own.values()})
    keys = outer(parents)
    other = tables(spec["from"])
    fields = compiler(other, {})
    # One row for each field and combination of values.
    met = other.join(parents.select(*keys).distinct(), functools.reduce(operator.and_, [fields.column(path).eqNullSafe(F.col(own[n][0])) for path, n in pairs]))
    inner = variables | {n: (c, kind) for n, (c, _, kind) in own.items()}
    met = run(met, [{"$match": rest}, *stages[1:]], tables, inner)
    return _attached(parents, met, [(k, k) for k in keys], name).drop(*(c for c, _, _ in own.values()))


def _equalities(spec: object, names: set[str]) -> tuple[list[tuple[str, str]], dict]:
    """The equalities of a field with a variable that a $match asks for, and what it asks for besides."""
    pairs: list[tuple[str, str]] = []
    if not isinstance(spec, dict):
        raise ShapeError("a condition is an object")
    rest: list[dict] = []
    for k, v in spec.items():
        if k == "$and" and isinstance(v, list):
            for c in v:
                found, left = _equalities(c, names)
                pairs += found
                rest += [left] if left else []
            continue
        parts = v["$and"] if k == "$expr" and isinstance(v, dict) and set(v) == {"$and"} else [v]
        for e in parts if k == "$expr" else []:
            sides = e["$eq"] if isinstance(e, dict) and set(e) == {"$eq"} and isinstance(e["$eq"], list) and len(e["$eq"]) == 2 else []
            variable = [x for x in sides if isinstance(x, str) and x.startswith("$$") and x[2:] in names]
            path = [x for x in sides if isinstance(x, str) and x.startswith("$") and not x.startswith("$$")]
            if variable and path:
                pairs.append((path[0], variable[0][2:]))
            else:
                rest.append({"$expr": e})
        if k != "$expr":
            rest.append({k: v})
    return pairs, {"$and": rest} if rest else {}


def _by_field(df: DataFrame, spec: dict, stages: list, tables: Tables, variables: dict) -> DataFrame:
    other, key = tables(spec["from"]), f"{OUTER}{len(outer(df))}"
    local, kind, below = Scope(df.schema).resolve(spec["localField"])
    foreign, fkind, fbelow = Scope(other.schema).resolve(spec.get("foreignField", spec["localField"]))
    if below or fbelow:
        raise ShapeError("$lookup joins on fields that are not in arrays of objects")
    # An empty array of the document's looks for null, one of the other table's is found by nothing.
    each = lambda col: F.explode(F.when(col.isNull(), F.array(col[0])).otherwise(F.array_distinct(col)))
    other = other.select("*", (each(foreign) if isinstance(fkind, T.ArrayType) else foreign).alias("__key"))
    if isinstance(kind, T.ArrayType):
        if outer(df):
            raise ShapeError("a $lookup in a $lookup joins on a field that is no array")
        keys = df.select(F.col("_id").alias(key), each(F.when(F.size(local) > 0, local)).alias("__local"))
        met = other.join(keys, F.col("__key").eqNullSafe(F.col("__local"))).drop("__key", "__local")
        met = met.dropDuplicates([key, "_id"]) if isinstance(fkind, T.ArrayType) else met
        return _attached(df, run(met, stages, tables, variables), [("_id", key)], spec["as"])
    wanted = df.select(local.alias("__local"))
    met = other.join(wanted, F.col("__key").eqNullSafe(F.col("__local")), "left_semi").withColumnRenamed("__key", key)
    name = f"__own{len(outer(df))}"
    return _attached(df.withColumn(name, local), run(met, stages, tables, variables), [(name, key)], spec["as"]).drop(name)


def _attached(df: DataFrame, rows: DataFrame, on: list[tuple[str, str]], name: str) -> DataFrame:
    """df with the array of its rows: those whose columns are null-safe equal to its own."""
    doc = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in _carried(rows)))
    place = F.col(PLACE) if PLACE in rows.columns else F.col("_id") if "_id" in rows.columns else F.monotonically_increasing_id()
    listed = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), doc.alias("d")))), lambda x: x["d"])
    made = rows.groupBy(*(F.col(k).alias(f"__on{i}") for i, (_, k) in enumerate(on))).agg(listed.alias("__list"))
    joined = df.join(made, functools.reduce(operator.and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"__on{i}")) for i, (c, _) in enumerate(on)]), "left")
    return joined.withColumn(name, F.coalesce("__list", F.array().cast(made.schema["__list"].dataType))).drop("__list", *(f"__on{i}" for i in range(len(on))))


STAGES = {"$match": match, "$sort": sort, "$skip": skip, "$limit": limit, "$project": project, "$addFields": add_fields, "$set": add_fields, "$replaceRoot": replace_root, "$unwind": unwind, "$group": group, "$facet": facet, "$lookup": lookup}


def run_command(command: dict, tables: Tables) -> DataFrame:
    """Reading commands as they are: find, findOne, aggregate and countDocuments; the last gives one row (n)."""
    kind = command.get("kind")
    df = tables(command["collection"])
    if kind in ("find", "findOne"):
        df = match(df, command.get("filter"), tables, {})
        df = project(df, command["projection"], tables, {}) if command.get("projection") else df
        return df.limit(1) if kind == "findOne" else df
    if kind == "aggregate":
        return run(df, command["pipeline"], tables)
    if kind == "countDocuments":
        return match(df, command.get("filter"), tables, {}).agg(F.count(F.lit(1)).alias("n"))
    raise ShapeError(f"unknown command {kind}")
