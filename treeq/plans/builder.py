"""From a parsed query to one lazy DataFrame.

The order is fixed: rows that may be seen, $condition, then either $group, $having, $sort, $skip and $limit, or $sort, $skip and
$limit of the parents, and only then their relations and computed columns. Nothing is joined that wasn't asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import NotFound, PermissionDenied, ProfileBlocked, ShapeError
from treeq.functions import vector
from treeq.functions.expr import Compiler
from treeq.functions.predicate import Scope, check, compile_condition
from treeq.operators import computes as C
from treeq.operators import group as G
from treeq.operators import pages as P
from treeq.operators import relations as R
from treeq.operators import semijoin as S
from treeq.operators.relations import DOC, ID, KEY
from treeq.plans.gql import Node, flatten_objects
from treeq.policy import Context, Policy
from treeq.schema import MISSING, ZEROS, Compute, Field, Model, Registry, Relation

MAX_DEPTH, MAX_PAGED_DEPTH = 10, 4
TEXT_ROWS, TEXT_DEPTH = 1000, 3
#: Pages up to this size look up their children instead of grouping all.
FEW = 5000
PROFILES = ("standard", "text2query")


@dataclass
class Plan:
    """What one query runs with."""

    registry: Registry
    policy: Policy
    scan: Callable[[Model], DataFrame]
    callbacks: C.Callbacks
    params: dict = field(default_factory=dict)
    ctx: Context | None = None
    profile: str = "standard"
    sum_empty: str = "null"
    ranked: Callable[[DataFrame, Model], DataFrame] = lambda df, _: df
    counter: itertools.count = field(default_factory=itertools.count)

    # rows

    def rows(self, model: Model) -> DataFrame:
        """The rows of a model that the context may see; every read of a model goes through here."""
        self.policy.check_read(model, self.ctx)
        return self.policy.rows(self.scan(model), model, self.ctx)

    def relation(self, model: Model, name: str) -> tuple[Relation, Model]:
        if name not in model.relations:
            raise NotFound(f"{model.name} has no relation {name}")
        r = model.relations[name]
        if not self.policy.readable(model, name, r.read, self.ctx):
            raise PermissionDenied(f"{model.name}.{name} can't be read")
        return r, self.registry[r.model]

    # conditions

    def where(self, df: DataFrame, model: Model, condition: object, depth: int = 0) -> DataFrame:
        """df filtered. Relation predicates among conjuncts become semi and anti joins, elsewhere flags."""
        if condition in (None, {}):
            return df
        check(condition)
        if not isinstance(condition, dict):
            raise ShapeError("a condition is an object")
        if self.profile == "text2query":
            self._check_text_shapes(model, condition)
        plain: dict = {}
        for k, v in self._conjuncts(condition):
            if (p := self._predicate(model, k, v, depth)) is not None:
                df = S.keep(df, p.relation, self._keys(p, depth), p.negated)
            else:
                plain.setdefault("$and", []).append({k: v})
        flags: list[str] = []

        def special(k: str, v: object) -> Column | None:
            nonlocal df
            p = self._predicate(model, k, v, depth)
            if p is None:
                return None
            name = f"__flag{next(self.counter)}"
            flags.append(name)
            df = S.flag(df, p.relation, self._keys(p, depth), name)
            return ~F.col(name) if p.negated else F.col(name)

        scope = Scope(df.schema)
        found = compile_condition(plain, scope, special, Compiler(scope).truth)
        return df if found is None else df.where(found).drop(*flags)

    def check_where(self, model: Model, condition: object, depth: int = 0) -> None:
        """What where refuses by the context, the profile and the condition's shape; it reads nothing, not even a table's columns."""
        if condition in (None, {}):
            return
        check(condition)
        if not isinstance(condition, dict):
            raise ShapeError("a condition is an object")
        if self.profile == "text2query":
            self._check_text_shapes(model, condition)
        for k, v in self._conjuncts(condition):
            if k in ("$or", "$nor"):
                for c in v:
                    self.check_where(model, c, depth)
            elif (p := self._predicate(model, k, v, depth)) is not None:
                child = self.registry[p.relation.model]
                self.policy.check_read(child, self.ctx)
                self.policy.row_filter(child, self.ctx, child.struct())
                self.check_where(child, p.condition, depth + 1)

    def _conjuncts(self, condition: dict) -> list[tuple[str, object]]:
        out = []
        for k, v in condition.items():
            if k == "$and":
                for c in v:
                    if not isinstance(c, dict):
                        raise ShapeError("a condition is an object")
                    out += self._conjuncts(c)
            else:
                out.append((k, v))
        return out

    def _predicate(self, model: Model, k: str, v: object, depth: int) -> S.Predicate | None:
        if k == "$not":
            if not isinstance(v, dict) or len(v) != 1 or next(iter(v)) not in model.relations:
                raise ShapeError("$not at this place takes one relation predicate")
            p = self._predicate(model, *next(iter(v.items())), depth)
            p.negated = not p.negated
            return p
        head, _, rest = k.partition(".")
        if head not in model.relations:
            return None
        if rest:
            if depth == 0 or "." in rest:
                raise ShapeError(f"{k}: a relation's fields go into its own object")
            v = {rest: v}
        if depth > 1:
            raise ShapeError(f"{k}: relation predicates nest once")
        r, _ = self.relation(model, head)
        return S.read(r, v)

    def _keys(self, p: S.Predicate, depth: int) -> DataFrame:
        child = self.registry[p.relation.model]
        rows = self.where(self.rows(child), child, p.condition, depth + 1)

        def having(made: DataFrame, spec: dict) -> Column:
            G.check_having(spec, set(p.aggregates))
            return compile_condition(spec, Scope(made.schema, ("__key",)))

        return S.keys(p, child, rows, having)

    def _check_text_shapes(self, model: Model, condition: dict) -> None:
        for k, v in self._conjuncts(condition):
            f = model.field_at(k) if not k.startswith("$") else None
            if f is not None and (f.type in ("array", "object") or "." in k):
                raise ProfileBlocked(f"{k}: conditions on arrays and objects are not for this profile")
            if k in ("$or", "$nor"):
                for c in v:
                    self._check_text_shapes(model, c)

    # the query

    def query(self, node: Node) -> DataFrame:
        model = self.registry[node.name]
        self._check_depth(node)
        self._flatten(node, model)
        condition = node.value("$condition", self.params)
        near, condition, late = vector.extract(model, condition)
        group = node.value("$group", self.params)
        having, sort = node.value("$having", self.params), node.value("$sort", self.params)
        skip, limit = self._count(node, "$skip"), self._count(node, "$limit")
        if self.profile == "text2query":
            limit = min(TEXT_ROWS, limit) if limit is not None else TEXT_ROWS
        if having is not None and group is None:
            raise ShapeError("$having goes with $group")
        if group is not None and any(k.partition(".")[0] in model.relations or k == "$not" for k in names(condition)):
            raise ShapeError("$group doesn't go with relation predicates")
        if near is not None and (skip or limit is not None or sort is not None or group is not None or any(k.partition(".")[0] in model.relations for k in names(condition))):
            if self.profile == "standard" or skip or sort is not None or group is not None:  # that profile sets a limit of its own
                raise ShapeError("$near has its own order and limit, and no group or relation predicate beside it")
        if near is None and "_score" in node.fields:
            raise ShapeError("_score goes with $near")
        df = self.where(self.rows(model), model, condition)
        if group is not None:
            return self._group(df, model, node, group, having, sort, skip, limit)
        order = self._order(sort)
        if near is not None:
            df = self.ranked(df, model)
            df = df.withColumn("_score", vector.score(F.col(f"`{near.field.name}`"), near)).where(F.col("_score").isNotNull())
            df = df.orderBy(F.desc("_score"), F.asc("_id")).limit(near.limit)
            df = self.where(df, model, late)
            if near.min_score is not None:
                df = df.where(F.col("_score") >= near.min_score)
            order = [("_score", -1)]
        by: list[Column] = []
        if order:
            df, by = self._sort_columns(df, model, order)
        paged = skip or limit is not None
        if paged and near is None:
            by = by or [F.asc("_id")]
            places = [(F.col(f"__sort{i}"), d) for i, (_, d) in enumerate(order)]
            df = P.page(df, places if len(by) == len(places) else [*places, (F.col("_id"), 1)], skip, limit, once=adds(condition))
        bound = near.limit if near is not None else limit
        out = self.shape(df, model, node, few=bound is not None and bound <= FEW, some=bool(names(condition)))
        return self._final(out, model, node, by)

    def _check_depth(self, node: Node) -> None:
        most = TEXT_DEPTH if self.profile == "text2query" else MAX_DEPTH
        for depth, n in node.walk():
            if depth >= most:
                raise ShapeError(f"relations are nested {depth} deep")
            if depth >= MAX_PAGED_DEPTH and {"$skip", "$limit"} & n.clauses.keys():
                raise ShapeError(f"relations with pages are nested {depth} deep")

    def _flatten(self, node: Node, model: Model) -> None:
        flatten_objects(node, {f.name for f in model.fields.values() if f.type == "object"})
        for r in node.relations:
            if r.name not in model.relations:
                raise NotFound(f"{model.name} has no relation {r.name}")
            self._flatten(r, self.registry[model.relations[r.name].model])

    def _count(self, node: Node, clause: str) -> int | None:
        n = node.value(clause, self.params)
        if n is None:
            return 0 if clause == "$skip" else None
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise ShapeError(f"{clause} is a whole number from 0")
        return n

    @staticmethod
    def _order(sort: object) -> list[tuple[str, int]]:
        pairs = list(sort.items()) if isinstance(sort, dict) else sort
        if pairs is None:
            return []
        if not isinstance(pairs, list) or not all(isinstance(p, (list, tuple)) and len(p) == 2 and isinstance(p[0], str) and isinstance(p[1], (int, float)) and not isinstance(p[1], bool) for p in pairs):
            raise ShapeError("$sort is an object or a list of pairs")
        return [(k, -1 if d < 0 else 1) for k, d in pairs]

    def check_order(self, model: Model, order: list[tuple[str, int]]) -> None:
        """The relations of an order that the context may not read; it reads nothing."""
        for head in (path.partition(".")[0] for path, _ in order):
            if head in model.relations and head not in model.fields:
                _, child = self.relation(model, head)
                self.policy.check_read(child, self.ctx)
                self.policy.row_filter(child, self.ctx, child.struct())

    @staticmethod
    def _direction(col: Column, d: int) -> Column:
        return col.desc_nulls_last() if d < 0 else col.asc_nulls_first()

    def _sort_columns(self, df: DataFrame, model: Model, order: list[tuple[str, int]], *, tie: bool = True) -> tuple[DataFrame, list[Column]]:
        """df with a column for each key, and the columns to order by; with tie, the id is the last."""
        by: list[Column] = []
        for path, d in order:
            name = f"__sort{len(by)}"
            head, _, rest = path.partition(".")
            if head in model.relations and head not in model.fields:
                r, child = self.relation(model, head)
                if not rest or child.field_at(rest) is None:
                    raise ShapeError(f"nothing sorts by {path}")
                rows = self.rows(child).withColumn(KEY, F.col(f"`{r.foreign}`")).withColumn(ID, F.col("_id"))
                df = R.sort_value(df, r, rows, Scope(rows.schema).resolve(rest)[0], d < 0, name)
            else:
                if head in model.computes and head not in model.fields:
                    raise ShapeError(f"{path} is computed after sorting")
                if rest and self.profile == "text2query":
                    raise ProfileBlocked(f"{path}: sorting by parts of objects is not for this profile")
                col, kind, below = Scope(df.schema).resolve(path)
                if below or isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
                    raise ShapeError(f"nothing sorts by {path}")
                df = df.withColumn(name, F.array_min(col) if isinstance(kind, T.ArrayType) else col)
            by.append(self._direction(F.col(name), d))
        return df, by if not tie or any(p == "_id" for p, _ in order) else [*by, F.asc("_id")]

    # shapes

    def shape(self, df: DataFrame, model: Model, node: Node, *, few: bool = False, some: bool = False) -> DataFrame:
        """df with the relations and computed columns of node. few: df is a page of FEW rows at most, or what hangs on one; some: it was filtered, so that not all children are needed."""
        page = df
        for r in node.relations:
            df = self._nest(df, model, r, page if few or some else None, few=few)
        wanted = [c for c in map(model.computes.get, node.fields) if c is not None and self.policy.readable(model, c.name, c.read, self.ctx)]
        over = [c for c in wanted if c.agg and c.agg[1].partition(".")[0] in model.relations]
        if over:

            def child_of(name: str) -> DataFrame:
                r, child = self.relation(model, name)
                rows = self.rows(child)
                return self._of_page(rows, r, page) if few else rows

            df = C.over_relation(df, model, over, child_of)
        for c in wanted:
            if c.agg and c not in over:
                df = df.withColumn(c.name, C.inline(df, c))
        for c in (c for c in wanted if not c.agg):
            for d in c.depends:
                Scope(df.schema).resolve(d)
            df = df.withColumn(c.name, self.callbacks.fn(df, c)) if c.fn else self.callbacks.batch(df, c)
        return df

    @staticmethod
    def _of_page(rows: DataFrame, r: Relation, page: DataFrame) -> DataFrame:
        """Only the children of a page's parents: else all children would be grouped for a few parents."""
        keys = page.select((F.explode(f"`{r.local}`") if R.is_array(page, r.local) else F.col(f"`{r.local}`")).alias("__parent"))
        return rows.join(keys, F.col(f"`{r.foreign}`") == F.col("__parent"), "left_semi")

    def _nest(self, df: DataFrame, model: Model, node: Node, page: DataFrame | None = None, *, few: bool = False) -> DataFrame:
        """page: the parents, if they are few or filtered."""
        r, child = self.relation(model, node.name)
        rows = self.where(self.rows(child), child, node.value("$condition", self.params))
        if page is not None:
            rows = self._of_page(rows, r, page)
        rows = self.shape(rows, child, node, few=few, some=page is not None)
        order = self._order(node.value("$sort", self.params))
        by = None
        if order:
            rows, by = self._sort_columns(rows, child, order, tie=False)
        skip, limit = self._count(node, "$skip"), self._count(node, "$limit")
        if self.profile == "text2query" and limit is not None:
            limit = min(limit, TEXT_ROWS)
        doc = F.struct(*self._columns(rows, child, node))
        kept = rows.select(F.col(f"`{r.foreign}`").alias(KEY), F.col("_id").alias(ID), doc.alias(DOC), *(c for c in rows.columns if c.startswith("__sort"))).where(F.col(KEY).isNotNull())
        return R.nest(df, r, kept, ordered=by, skip=skip, limit=limit)

    def _columns(self, df: DataFrame, model: Model, node: Node) -> list[Column]:
        """_id, the requested fields in their order with objects built up again, and the relations."""
        out: list[Column] = [F.col("_id")]
        whole = [f for f in dict.fromkeys(node.fields) if f != "_id"]
        objects: dict[str, list[str]] = {}
        for name in whole:
            head, _, rest = name.partition(".")
            if rest and head not in whole:
                objects.setdefault(head, []).append(rest)
        done = set()
        for name in whole:
            head, _, rest = name.partition(".")
            if head in done or (rest and head in whole):
                continue
            done.add(head)
            if head == "_score" or head in model.computes:
                c: Compute | None = model.computes.get(head)
                if c is None or self.policy.readable(model, head, c.read, self.ctx):
                    out.append(F.col(f"`{head}`"))
                continue
            f = model.fields.get(head)
            if f is None:
                raise ShapeError(f"{model.name} has no field {name}")
            if not self.policy.readable(model, head, f.read, self.ctx):
                continue
            col = self._sub(F.col(f"`{head}`"), f, objects[head], name) if head in objects else self._with_default(df, f)
            out.append(self.policy.owned_field(model, f.read, self.ctx, col).alias(head))
        return [*out, *(F.col(f"`{r.name}`") for r in node.relations)]

    def _with_default(self, df: DataFrame, f: Field) -> Column:
        """A missing value is replaced by the declared default; a stored null stays. Tables tell the two apart by __present, and what no table column holds is missing."""
        col, kind = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        if f.default is None:
            return col
        if df.schema[f.name].metadata.get(MISSING):
            return F.lit(f.default).cast(kind)
        return F.when(F.array_contains("__present", f.name), col).otherwise(F.lit(f.default).cast(kind)) if "__present" in df.columns else col

    def _sub(self, col: Column, f: Field, paths: list[str], what: str) -> Column:
        """An object of only these parts; parts that are missing get their type's zero."""
        parts: dict[str, list[str]] = {}
        for p in paths:
            head, _, rest = p.partition(".")
            parts.setdefault(head, [])
            if rest:
                parts[head].append(rest)
        made = []
        for head, rest in parts.items():
            inner = next((x for x in f.fields if x.name == head), None)
            if inner is None:
                raise ShapeError(f"no field {what}")
            zero = ZEROS.get(inner.type)
            one = self._sub(col[head], inner, rest, what) if rest else col[head]
            made.append((one if zero in (None, {}, []) or rest else F.coalesce(one, F.lit(zero))).alias(head))
        return F.struct(*made)

    def _final(self, df: DataFrame, model: Model, node: Node, by: list[Column]) -> DataFrame:
        columns = self._columns(df, model, node)
        sorts = [c for c in df.columns if c.startswith("__sort")]
        out = df.select(*columns, *sorts)
        return out.orderBy(*by).drop(*sorts) if by else out

    # groups

    def _group(self, df: DataFrame, model: Model, node: Node, spec: object, having: object, sort: object, skip: int, limit: int | None) -> DataFrame:
        by, agg = G.read_group(model, spec)
        if node.relations or not node.fields:
            raise ShapeError("a group has fields, and no relations")
        if unknown := set(node.fields) - set(by) - set(agg) - {"_id"}:
            raise ShapeError(f"{sorted(unknown)} are no keys or aliases")
        for path in by:
            name = G.check_key(model, path)
            if name is not None:
                r, child = self.relation(model, name)
                rest = path.partition(".")[2]
                f = child.field_at(rest)
                if f is None or f.type in ("array", "object", "vector"):
                    raise ShapeError(f"{path} can't be a group key")
                if not self.policy.readable(child, rest, f.read, self.ctx):
                    raise PermissionDenied(f"{path} can't be read")
                if R.is_array(df, r.local):
                    raise ShapeError(f"{path}: {name} joins on an array")
                side = self.rows(child).select(F.col(f"`{r.foreign}`").alias(KEY), F.col("_id").alias(ID), Scope(child.struct()).resolve(rest)[0].alias("__v"))
                if r.foreign != "_id":
                    side = side.groupBy(KEY).agg(F.min_by("__v", ID).alias("__v"))
                side = side.select(KEY, F.col("__v").alias(f"__g{by.index(path)}"))
                df = df.join(side, df[f"`{r.local}`"] == side[KEY], "left").drop(KEY)
            else:
                f = model.field_at(path)
                if not self.policy.readable(model, path, f.read, self.ctx):
                    raise PermissionDenied(f"{path} can't be read")
                df = df.withColumn(f"__g{by.index(path)}", Scope(df.schema).resolve(path)[0])
        for alias, a in agg.items():
            G.accumulator(model, alias, a)
            name = next(iter(a.values()))
            if name != "*" and not self.policy.readable(model, name, model.field_at(name).read, self.ctx):
                raise PermissionDenied(f"{name} can't be read")
        known = set(by) | set(agg)
        if having is not None:
            G.check_having(having, known)
        order = self._order(sort)
        if unknown := [k for k, _ in order if k not in known]:
            raise ShapeError(f"$sort names {unknown[0]}, which is no key or alias")
        # Keys with dots are columns without them while the group is made.
        flat = {n: f"k{i}" for i, n in enumerate(by)} | {a: f"a{i}" for i, a in enumerate(agg)}
        made = df.groupBy(*(F.col(f"__g{i}").alias(flat[n]) for i, n in enumerate(by))).agg(*([self._accumulate(model, a, s).alias(flat[a]) for a, s in agg.items()] or [F.count(F.lit(1)).alias("__n")]))
        if having is not None:
            made = made.where(compile_condition(_renamed(having, flat), Scope(made.schema)))
        places = [(F.col(flat[k]), d) for k, d in order]
        places += [(F.col(flat[n]), 1) for n in by if n not in {k for k, _ in order}]
        if order or skip or limit is not None:
            added = {a for a, s in agg.items() if {"$sum", "$avg"} & s.keys() and isinstance(made.schema[flat[a]].dataType, (T.DoubleType, T.FloatType))}
            made = P.page(made, places, skip, limit, once=bool(added & {k for k, _ in order} or added & set(names(having))))
        return made.select(*_rebuilt([f for f in dict.fromkeys(node.fields) if f in known], flat))

    def _accumulate(self, model: Model, alias: str, spec: dict) -> Column:
        col = G.accumulator(model, alias, spec)
        return F.coalesce(col, F.lit(0)) if self.sum_empty == "zero" and "$sum" in spec else col


def names(condition: object) -> list[str]:
    """The keys of a condition, those in logical groups included."""
    if isinstance(condition, dict):
        return [*condition, *(n for k, v in condition.items() if k in ("$and", "$or", "$nor") for n in names(v))]
    return [n for c in condition for n in names(c)] if isinstance(condition, list) else []


def adds(condition: object) -> bool:
    """Whether a condition holds sums or means: doubles differ in their last bits with the order of additions, and so may the rows."""
    if isinstance(condition, dict):
        return bool({"$sum", "$avg"} & condition.keys()) or any(map(adds, condition.values()))
    return isinstance(condition, list) and any(map(adds, condition))


def _renamed(spec: dict, flat: dict[str, str]) -> dict:
    return {flat.get(k, k): [_renamed(x, flat) for x in v] if k in ("$and", "$or", "$nor") else v for k, v in spec.items()}


def _rebuilt(names: list[str], flat: dict[str, str]) -> list[Column]:
    """Keys with dots become objects again."""
    out: list[Column] = []
    for n in names:
        head = n.partition(".")[0]
        if head == n:
            out.append(F.col(flat[n]).alias(n))
            continue
        own = [x for x in names if x.startswith(head + ".")]
        if n == own[0]:
            out.append(F.struct(*_rebuilt([x.partition(".")[2] for x in own], {x.partition(".")[2]: flat[x] for x in own})).alias(head))
    return out
