"""Writes as functions from a table to a table; the new table replaces the stored one.

Parquet folders are no transactional tables: a write goes to a new folder and the folders are swapped. Each write, from its first read on,
holds a lock file beside the folder, which file systems make for one program at a time; so do claim and compare_and_set, which thus are safe
over processes. What is refused without a read is refused before the lock: it makes no file and waits for no one. A program that dies in a write
leaves the lock file, and the next write says so.
"""

from __future__ import annotations

import functools
import operator
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.engine import Engine
from treeq.errors import Conflict, NotFound, PermissionDenied, ProfileBlocked, ShapeError
from treeq.functions.literals import literal, plain
from treeq.functions.predicate import PRESENT
from treeq.operators import triggers as TR
from treeq.plans.builder import names
from treeq.policy import Context
from treeq.schema import NUMBERS, Model

OPERATORS = ("$set", "$inc", "$unset", "$setOnInsert")
#: Writes of a table in memory between two cuts of its plan; rows that a removal gives back at most.
CUT, DOCS = 8, 1000
#: Seconds that a write waits for another program's.
WAIT = 30.0
STEP = re.compile(r"\{\{step\.(\d+)\._id\}\}")


@dataclass
class Written:
    """What a write did. docs: the rows after it (remove: before it); before: of one updated row."""

    matched: int = 0
    modified: int = 0
    inserted: int = 0
    deleted: int = 0
    docs: list[dict] = field(default_factory=list)
    before: dict | None = None
    steps: list[str] = field(default_factory=list)


def _blank(condition: object) -> bool:
    return not condition or (isinstance(condition, dict) and all(k in ("$and", "$or", "$nor") and not v for k, v in condition.items()))


class Writer:
    """now: milliseconds; new_id: an id for a model. Both can be set, so that writes can be repeated exactly."""

    def __init__(self, engine: Engine, *, now: Callable[[], int] | None = None, new_id: Callable[[Model], str] | None = None, links: str = "primary") -> None:
        if links not in ("primary", "all"):
            raise ShapeError("links is primary or all")
        self.engine, self.links = engine, links
        self.nested: dict[str, int] = {}
        self.now = now or (lambda: int(time.time() * 1000))
        self.new_id = new_id or (lambda m: f"{m.id_prefix or ''}{uuid.uuid4().hex}")
        self.lock, self.own = threading.RLock(), set()

    # tables

    @contextmanager
    def _table(self, name: str) -> Iterator[None]:
        """Keeps other writers of a parquet model out: those of this process wait, those of others end in Conflict after WAIT seconds."""
        with self.lock:
            model = self.engine.registry[name]
            where = self.engine.sources.links(model)[0]
            s = self.engine.sources.source(where.source)
            if s.kind != "parquet" or name in self.own:
                yield
                return
            base = f"{self.engine.sources.place(model, s, where)}.lock"
            jvm, conf = self.engine.spark.sparkContext._jvm, self.engine.spark.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(base)
            fs, until = path.getFileSystem(conf), time.monotonic() + WAIT
            while not fs.createNewFile(path):
                if time.monotonic() > until:
                    raise Conflict(f"{name} is being written by another program; if none runs, remove {base}")
                time.sleep(0.05)
            self.own.add(name)
            try:
                yield
            finally:
                self.own.discard(name)
                fs.delete(path, False)

    def _model(self, name: str, ctx: Context | None, action: str) -> Model:
        model = self.engine.registry[name]
        self.engine.policy.check_write(model, ctx, action)
        if len({w.source for w in model.locations if w.role in (None, "primary")}) > 1:
            raise ShapeError(f"{name} is stored in several sources, and can't be written as one")
        if self.links == "all" and any(w.role == "replica" for w in model.locations):
            raise ShapeError(f"{name} has replicas, and writes go to the primary only; ask for links='primary'")
        return model

    def _store(self, model: Model, df: DataFrame) -> None:
        where = self.engine.sources.links(model)[0]
        s = self.engine.sources.source(where.source)
        if any(p.startswith("=") for p in model.physical.values()):
            raise ShapeError(f"{model.name} has columns that are expressions, and can't be written")
        out = df.select(*(F.col(f"`{c}`").alias(model.physical.get(c, c)) for c in df.columns))
        if s.kind == "memory":
            self.nested[model.collection] = n = self.nested.get(model.collection, 0) + 1
            s.frames[model.collection] = self._once(out) if n % CUT == 0 else out
            return
        if s.kind != "parquet":
            raise ShapeError(f"sources of kind {s.kind} can't be written")
        base = self.engine.sources.place(model, s, where)
        spark = self.engine.spark
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(base).getFileSystem(conf)
        target = next((p for p in (f"{base}.parquet", base) if fs.exists(path(p))), base)
        new, old = f"{base}-{uuid.uuid4().hex}.new", f"{base}-{uuid.uuid4().hex}.old"
        out.write.parquet(new)
        there = fs.exists(path(target))
        if there and not fs.rename(path(target), path(old)):
            fs.delete(path(new), True)
            raise Conflict(f"{target} can't be replaced; it is as it was")
        if not fs.rename(path(new), path(target)):
            back = not there or fs.rename(path(old), path(target))
            raise Conflict(f"{new} can't be moved to {target}; " + ("that is as it was" if back else f"the rows before are in {old}"))
        if there:
            fs.delete(path(old), True)

    def _once(self, df: DataFrame) -> DataFrame:
        """df, computed once and cut from its plan, in the folder of checkpoints; without one, on a cluster, df as it is."""
        sc = self.engine.spark.sparkContext
        if not sc.getCheckpointDir():
            found = self.engine.spark.conf.get("spark.checkpoint.dir", None)
            if not found and sc.master != "local" and not sc.master.startswith("local["):
                return df
            sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="treeq-"))
        return df.checkpoint()

    def _present(self, df: DataFrame) -> bool:
        return PRESENT in df.columns

    # values

    def _data(self, model: Model, ctx: Context | None, data: dict) -> dict[str, dict]:
        """Operators with their fields, checked; plain fields are set, and those that are null are left out."""
        if not isinstance(data, dict) or not data:
            raise ShapeError("a write has data")
        marked = [k for k in data if k.startswith("$")]
        if marked and len(marked) < len(data):
            raise ShapeError("operators and fields are mixed")
        spec = {k: dict(v) for k, v in data.items()} if marked else {"$set": {k: v for k, v in data.items() if v is not None}}
        if unknown := set(spec) - set(OPERATORS):
            raise ShapeError(f"unknown operator {sorted(unknown)[0]}")
        for op, fields in spec.items():
            for path, v in list(fields.items()):
                f = model.field_at(path)
                if f is None or path == "_id":
                    raise ShapeError(f"{model.name} has no field {path} that can be written")
                if not self.engine.policy.writable(model, path, ctx):
                    if op == "$set":
                        del fields[path]
                        continue
                    raise PermissionDenied(f"{model.name}.{path} can't be written")
                if path == model.owner_key and ctx is not None and not ctx.internal and v != ctx.user_id:
                    raise PermissionDenied(f"{model.name}.{path} stays as it is")
                if op == "$inc" and (f.type not in NUMBERS or not isinstance(plain(v), (int, float))):
                    raise ShapeError(f"$inc {path} takes a number")
                if op != "$unset" and f.type == "object" and v is not None and not isinstance(v, dict):
                    raise ShapeError(f"{path} is an object")
        self.engine.policy.check_values(model, ctx, spec.get("$set", {}))
        return spec

    def _document(self, model: Model, ctx: Context | None, data: dict, now: int) -> dict:
        """A whole new document: no nulls, defaults for what is missing, owner, times and an id."""
        if unknown := {k for k in data if k != "_id" and k not in model.fields}:
            raise ShapeError(f"{model.name} has no fields {sorted(unknown)}")
        doc = {k: plain(v) for k, v in data.items() if v is not None and (k == "_id" or self.engine.policy.writable(model, k, ctx))}
        for f in model.fields.values():
            if f.name not in data and f.default is not None:
                doc[f.name] = f.default
            if f.type == "object" and f.name in doc and not isinstance(doc[f.name], dict):
                raise ShapeError(f"{f.name} is an object")
        if ctx is not None and ctx.user_id and model.owner_key in model.fields:
            doc.setdefault(model.owner_key, ctx.user_id)
        if model.timestamps:
            stamp = now if model.timestamps == "ms" else now // 1000
            doc.setdefault("createdAt", stamp)
            doc.setdefault("updatedAt", stamp)
        doc.setdefault("_id", self.new_id(model))
        if missing := [f.name for f in model.fields.values() if f.required and f.name not in doc]:
            raise ShapeError(f"{model.name} needs {missing}")
        self.engine.policy.check_values(model, ctx, doc)
        return doc

    def _frame(self, model: Model, docs: list[dict], like: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in like.schema.fields}
        rows = [tuple(_fitted(d.get(f.name), f.dataType) for f in like.schema.fields if f.name != PRESENT) + (([k for k in d if k in kinds],) if PRESENT in kinds else ()) for d in docs]
        return self.engine.spark.createDataFrame(rows, T.StructType([f for f in like.schema.fields if f.name != PRESENT] + ([like.schema[PRESENT]] if PRESENT in kinds else [])))

    # inserts

    def insert(self, name: str, data: dict, ctx: Context | dict | None = None) -> Written:
        return self.insert_many(name, [data], ctx)

    def insert_many(self, name: str, data: list[dict], ctx: Context | dict | None = None, *, upsert_by_id: bool = False) -> Written:
        ctx = Context.of(ctx)
        model, now = self._model(name, ctx, "insert"), self.now()
        docs = [self._document(model, ctx, d, now) for d in data]
        ids = [d["_id"] for d in docs]
        if len(set(ids)) < len(ids):
            raise Conflict("two documents have one id")
        with self._table(name):
            table = self.engine.table(name)
            new = self._frame(model, docs, table)
            if upsert_by_id:
                kept = table.join(F.broadcast(new.select("_id")), "_id", "left_anti")
            else:
                if not table.join(F.broadcast(new.select("_id")), "_id", "left_semi").isEmpty():
                    raise Conflict(f"{name} has a document of this id")
                self._check_unique(model, table, docs)
                kept = table
            self._store(model, kept.unionByName(new))
            out = Written(inserted=len(docs), docs=docs)
            for d in docs:
                self._fire(model, "insert", d, {}, set(d), now, out)
            return out

    def _check_unique(self, model: Model, table: DataFrame, docs: list[dict]) -> None:
        for keys in model.unique:
            given = [d for d in docs if all(k in d for k in keys)]
            if given and not table.join(F.broadcast(self._frame(model, given, table).select(*keys)), list(keys), "left_semi").isEmpty():
                raise Conflict(f"{model.name} has a document of these {list(keys)}")

    def insert_rows(self, name: str, rows: DataFrame, ctx: Context | dict | None = None) -> Written:
        """Bulk insert of a DataFrame with ids, as one distributed job: no conflict with stored ids, none among its own."""
        model = self._model(name, Context.of(ctx), "insert")
        table = self.engine.table(name)
        if unknown := set(rows.columns) - set(table.columns):
            raise ShapeError(f"{name} has no fields {sorted(unknown)}")
        if not table.select("_id").join(rows.select("_id"), "_id", "left_semi").isEmpty() or not rows.groupBy("_id").count().where("count > 1").isEmpty():
            raise Conflict(f"an id of these rows is there twice in {name}")
        self._store(model, table.unionByName(rows, allowMissingColumns=True))
        return Written(inserted=rows.count())

    # updates

    def updated(self, df: DataFrame, model: Model, match: Column, spec: dict[str, dict], now: int) -> DataFrame:
        """df with the rows of match changed."""
        new: dict[str, Column] = {}
        of = lambda head: new.get(head, F.col(f"`{head}`"))

        def put(path: str, value: Callable[[Column, T.DataType], Column]) -> None:
            head, *rest = path.split(".")
            kind = df.schema[head].dataType
            new[head] = _put(of(head), kind, rest, value)

        for path, v in spec.get("$set", {}).items():
            put(path, lambda old, kind, v=v, path=path: literal(v, kind, path).cast(kind))
        for path, v in spec.get("$inc", {}).items():
            put(path, lambda old, kind, v=v: (F.coalesce(old, F.lit(0)) + F.lit(plain(v))).cast(kind))
        for path in spec.get("$unset", {}):
            put(path, lambda old, kind: F.lit(None).cast(kind))
        if model.timestamps and "updatedAt" not in spec.get("$set", {}):
            put("updatedAt", lambda old, kind: F.lit(now if model.timestamps == "ms" else now // 1000).cast(kind))
        out = [F.when(match, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns if c != PRESENT]
        if self._present(df):
            there = [p.split(".")[0] for op in ("$set", "$inc") for p in spec.get(op, {})]
            gone = [p for p in spec.get("$unset", {}) if "." not in p]
            strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
            out.append(F.when(match, F.array_except(F.array_union(PRESENT, strings(there)), strings(gone))).otherwise(F.col(PRESENT)).alias(PRESENT))
        return df.select(*out)

    def _check_matching(self, model: Model, condition: object, ctx: Context | None, action: str) -> None:
        """What _matching refuses whatever the rows are; it reads nothing, so it comes before the lock."""
        plan = self.engine._plan({}, ctx, None)
        self.engine.policy.row_filter(model, ctx, model.struct(), action)
        plan.check_where(model, condition)

    def _matching(self, model: Model, condition: object, ctx: Context | None, action: str) -> DataFrame:
        """The rows of a condition that may be changed. Relation predicates are allowed: the rows come out as ids."""
        plan = self.engine._plan({}, ctx, None)
        table = self.engine.policy.rows(self.engine.table(model.name), model, ctx, action)
        return plan.where(table, model, condition)

    def _mark(self, model: Model, rows: DataFrame, condition: object) -> tuple[DataFrame, Column]:
        """The whole table with a column that says which rows are meant, by their ids."""
        table = self.engine.table(model.name)
        hit = self._once(rows.select(F.col("_id").alias("__hit")).distinct())  # judged once, so that what is counted is what is stored
        return table.join(hit, table["_id"] == hit["__hit"], "left"), F.col("__hit").isNotNull()

    def update_many(self, name: str, condition: object, data: dict, ctx: Context | dict | None = None) -> Written:
        ctx = Context.of(ctx)
        if _blank(condition):
            raise ShapeError("a write of many rows has a condition")
        model = self._model(name, ctx, "update")
        spec = self._data(model, ctx, data)
        self._check_matching(model, condition, ctx, "update")
        with self._table(name):
            now = self.now()
            marked, match = self._mark(model, self._matching(model, condition, ctx, "update"), condition)
            fields = {p.split(".")[0] for op in spec for p in spec[op]}
            unstamped = self.updated(marked.withColumns({f"__old_{f}": F.col(f"`{f}`") for f in fields}), model, match, spec, now)
            changed = functools.reduce(operator.or_, [~F.col(f"`{f}`").eqNullSafe(F.col(f"`__old_{f}`")) for f in fields], F.lit(False))
            counts = unstamped.where(F.col("__hit").isNotNull()).agg(F.count(F.lit(1)), F.count_if(changed)).first()
            self._store(model, self.updated(marked, model, match, spec, now).drop("__hit"))
            return Written(matched=counts[0], modified=counts[1])

    def update(self, name: str, condition: object, data: dict, ctx: Context | dict | None = None) -> Written:
        """The first match by id; before and after are returned."""
        ctx = Context.of(ctx)
        if _blank(condition):
            raise ShapeError("an update has a condition")
        model = self._model(name, ctx, "update")
        spec = self._data(model, ctx, data)
        self._check_matching(model, condition, ctx, "update")
        with self._table(name):
            return self._update_first(model, condition, spec, ctx, self.now())

    def _update_first(self, model: Model, condition: object, spec: dict, ctx: Context | None, now: int) -> Written:
        first = self._matching(model, condition, ctx, "update").orderBy("_id").limit(1).collect()
        if not first:
            return Written()
        table = self.engine.table(model.name)
        before = first[0].asDict(recursive=True)
        key = F.col("_id") == F.lit(before["_id"])
        new = self.updated(table, model, key, spec, now)
        after = new.where(key).first().asDict(recursive=True)
        self._store(model, new)
        changed = {k for k in after if after[k] != before.get(k)}
        out = Written(1, int(bool(changed - {"updatedAt"})), docs=[after], before=before)
        self._fire(model, "update", after, before, changed, now, out)
        return out

    def upsert(self, name: str, condition: dict, data: dict, ctx: Context | dict | None = None) -> Written:
        """Updates the first match; without one, inserts a document of the condition's equal values, the data and the defaults."""
        ctx = Context.of(ctx)
        if _blank(condition):
            raise ShapeError("an upsert has a condition")
        model = self._model(name, ctx, "update")
        spec = self._data(model, ctx, {k: v for k, v in data.items() if k != "_id"})
        self._check_matching(model, condition, ctx, "update")
        with self._table(name):
            found = self._update_first(model, condition, {k: v for k, v in spec.items() if k != "$setOnInsert"}, ctx, self.now())
            if found.matched:
                return found
            seed = {k: v for k, v in _equalities(condition).items() if k == "_id" or k in model.fields}
            if "_id" in data:
                seed["_id"] = data["_id"]
            doc = seed | spec.get("$setOnInsert", {}) | spec.get("$inc", {}) | spec.get("$set", {})
            return self.insert(name, {k: v for k, v in doc.items() if k not in spec.get("$unset", {})}, ctx)

    def upsert_key(self, model: Model, data: dict) -> dict | None:
        """The condition that finds a document again: its id, or any unique key that it has whole."""
        if "_id" in data:
            return {"_id": data["_id"]}
        keys = [{k: data[k] for k in u} for u in model.unique if all(data.get(k) is not None for k in u)]
        return None if not keys else keys[0] if len(keys) == 1 else {"$or": keys}

    # removals

    def remove(self, name: str, condition: object, ctx: Context | dict | None = None) -> Written:
        """Matching rows go to the archive, if the model has one, and then away. Done twice, it does nothing the second time."""
        ctx = Context.of(ctx)
        if _blank(condition):
            raise ShapeError("a removal has a condition")
        model = self._model(name, ctx, "remove")
        self._check_matching(model, condition, ctx, "remove")
        with self._table(name):
            now = self.now()
            marked, match = self._mark(model, self._matching(model, condition, ctx, "remove"), condition)
            gone = marked.where(match).drop("__hit")
            listed = model.triggers.get("remove")
            gone = self._once(gone) if listed else gone  # triggers see the rows after the table has gone
            n = gone.count()
            if n and model.archive and f"{name}Deleted" in self.engine.registry:
                shadow = self.engine.registry[f"{name}Deleted"]
                old = self.engine.table(shadow.name)
                fresh = gone.join(old.select("_id"), "_id", "left_anti").withColumn("deletedAt", F.lit(now).cast("double"))
                self._store(shadow, old.unionByName(fresh, allowMissingColumns=True))
            self._store(model, marked.where(~match).drop("__hit"))
            out = Written(matched=n, deleted=n)
            for r in gone.toLocalIterator() if listed else ():
                d = r.asDict(recursive=True)
                if len(out.docs) < DOCS:
                    out.docs.append(d)
                self._fire(model, "remove", {}, d, set(), now, out)
            return out

    def delete_many(self, name: str, condition: object, ctx: Context | dict | None = None) -> Written:
        """Matching rows go away, without an archive."""
        ctx = Context.of(ctx)
        if _blank(condition):
            raise ShapeError("a removal has a condition")
        model = self._model(name, ctx, "remove")
        self._check_matching(model, condition, ctx, "remove")
        with self._table(name):
            marked, match = self._mark(model, self._matching(model, condition, ctx, "remove"), condition)
            n = marked.where(match).count()
            self._store(model, marked.where(~match).drop("__hit"))
            return Written(matched=n, deleted=n)

    # several steps

    def mutation(self, name: str, data: dict, ctx: Context | dict | None = None) -> Written:
        """A document with its relations: the parent first, then a child of a one relation as an upsert and each child of a many relation by itself.

        A value {{step.N._id}} is the id of the document that step N made, counted from 0 in this order; later steps are not there yet.
        """
        return self._steps(name, data, ctx, [])

    def _filled(self, value: object, ids: list) -> object:
        if isinstance(value, dict):
            return {k: self._filled(v, ids) for k, v in value.items()}
        if isinstance(value, list):
            return [self._filled(v, ids) for v in value]
        if isinstance(value, str) and (m := STEP.fullmatch(value)):
            if int(m[1]) >= len(ids):
                raise ShapeError(f"{value} names a step that is not done yet")
            return ids[int(m[1])]
        return value

    def _steps(self, name: str, data: dict, ctx: Context | dict | None, ids: list) -> Written:
        model = self.engine.registry[name]
        own = self._filled({k: v for k, v in data.items() if k not in model.relations}, ids)
        key = self.upsert_key(model, own)
        out = self.upsert(name, key, own, ctx) if key else self.insert(name, own, ctx)
        root = out.docs[0]
        ids.append(root["_id"])
        out.steps.append(f"{name}:{'update' if out.matched else 'insert'}")
        for rel, given in data.items():
            if rel not in model.relations or given is None:
                continue
            r = model.relations[rel]
            if r.many != isinstance(given, list):
                raise ShapeError(f"{rel} takes {'a list' if r.many else 'one document'}")
            for child in given if r.many else [given]:
                linked = {**child, r.foreign: root[r.local]}
                if not r.many and "_id" not in child and r.foreign != "_id":
                    plain_child = self._filled({k: v for k, v in linked.items() if k not in self.engine.registry[r.model].relations}, ids)
                    made = self.upsert(r.model, {r.foreign: root[r.local]}, plain_child, ctx)
                    ids.append(made.docs[0]["_id"])
                    out.steps.append(f"{r.model}:{'update' if made.matched else 'insert'}")
                else:
                    out.steps += self._steps(r.model, linked, ctx, ids).steps
        return out

    def claim(self, name: str, condition: object, data: dict, ctx: Context | dict | None = None, *, sort: object = None, limit: int = 1) -> Written:
        """Takes the first rows of an order and marks them. One process at a time."""
        if self.engine.profile == "text2query":
            raise ProfileBlocked("claim is not for this profile")
        if not isinstance(limit, int) or limit < 1:
            raise ShapeError("a claim takes one row at least")
        ctx = Context.of(ctx)
        model = self._model(name, ctx, "update")
        spec = self._data(model, ctx, data)
        self._check_matching(model, condition, ctx, "update")
        plan = self.engine._plan({}, ctx, None)
        order = plan._order(sort) or [("_id", 1)]
        plan.check_order(model, order)
        with self._table(name):
            now = self.now()
            rows = self._matching(model, condition, ctx, "update")
            rows, by = plan._sort_columns(rows, model, order)
            ids = [r["_id"] for r in rows.orderBy(*by).limit(limit).select("_id").collect()]
            if not ids:
                return Written()
            table, key = self.engine.table(name), F.col("_id").isin(ids)
            new = self.updated(table, model, key, spec, now)
            docs = {d["_id"]: d.asDict(recursive=True) for d in new.where(key).collect()}
            self._store(model, new)
            return Written(len(ids), len(ids), docs=[docs[i] for i in ids])

    def compare_and_set(self, name: str, condition: object, expected: dict, data: dict, ctx: Context | dict | None = None) -> Written:
        """Updates the rows of a condition only if their fields are still as expected."""
        if self.engine.profile == "text2query":
            raise ProfileBlocked("compare_and_set is not for this profile")
        if not expected or names(expected) != list(expected) or any(k.startswith("$") for k in expected):
            raise ShapeError("expected is an object of equal values")
        return self.update_many(name, {"$and": [condition, expected]}, data, ctx)

    def command(self, command: dict) -> Written:
        """Writing commands as they are, over collections by name; their rows are given whole, without defaults and triggers."""
        kind, name = command.get("kind"), command["collection"]
        model = next((m for m in self.engine.registry.models.values() if m.collection == name), None) or self.engine.registry[name]
        quiet = Writer(self.engine, now=self.now, new_id=self.new_id)
        quiet._fire = lambda *_: None  # type: ignore[method-assign]
        quiet._document = lambda _m, _c, d, _n: {"_id": self.new_id(model), **d}  # type: ignore[method-assign]
        if kind == "insertOne":
            return quiet.insert(model.name, command["document"])
        if kind == "insertMany":
            return quiet.insert_many(model.name, command["documents"], upsert_by_id=bool(command.get("upsertById")))
        if kind == "findOneAndUpdate":
            return (quiet.upsert if command.get("upsert") else quiet.update)(model.name, command["filter"], command["update"])
        if kind == "updateMany":
            return quiet.update_many(model.name, command["filter"], command["update"])
        if kind == "deleteMany":
            return quiet.delete_many(model.name, command["filter"])
        if kind == "claim":
            return quiet.claim(model.name, command["filter"], command["update"], sort=command.get("sort"), limit=command.get("limit", 1))
        if kind == "compareAndSet":
            return quiet.compare_and_set(model.name, command["filter"], command["expected"], command["update"])
        raise ShapeError(f"unknown command {kind}")

    # triggers

    def _fire(self, model: Model, event: str, root: dict, before: dict, changed: set[str], now: int, out: Written) -> None:
        for t in model.triggers.get(event, ()):
            if TR.applies(t, root, before, changed, now):
                self._run(t, root, before, now, out)

    def _run(self, t: dict, root: dict, before: dict, now: int, out: Written) -> None:
        """One level: what a trigger writes fires no triggers."""
        label = t.get("name", t.get("fnRef", t.get("into")))
        if "fnRef" in t:
            if t["fnRef"] not in self.engine.callbacks.fns:
                raise NotFound(f"callback {t['fnRef']} is not set")
            self.engine.callbacks.fns[t["fnRef"]][0](TR.filled(t.get("args", {}), root, before, now))
            out.steps.append(f"callback:{label}")
            return
        quiet = Writer(self.engine, now=lambda: now, new_id=self.new_id)
        quiet._fire = lambda *_: None  # type: ignore[method-assign]
        condition, data = (TR.filled(t.get(k), root, before, now) for k in ("condition", "data"))
        {"insert": lambda: quiet.insert(t["into"], data), "update": lambda: quiet.update_many(t["into"], condition, data), "remove": lambda: quiet.remove(t["into"], condition)}[t["op"]]()
        out.steps.append(f"{t['into']}:{t['op']}:{label}")

    def run_schedule(self, at: object) -> Written:
        """The triggers of all models that are due at this minute. Who calls it every minute is up to the host."""
        out = Written()
        now = int(at.timestamp() * 1000)
        for model in self.engine.registry.models.values():
            for t in model.triggers.get("schedule", ()):
                if TR.due(t["cron"], at):
                    self._run(t, {}, {}, now, out)
        return out


def _equalities(condition: dict) -> dict:
    out = {}
    for k, v in condition.items():
        if k == "$and":
            for c in v:
                out |= _equalities(c)
        elif not k.startswith("$") and "." not in k and not (isinstance(plain(v), dict) and any(x.startswith("$") for x in plain(v))):
            out[k] = v
        elif isinstance(v, dict) and set(v) == {"$eq"}:
            out[k] = v["$eq"]
    return out


def _put(old: Column, kind: T.DataType, rest: list[str], value: Callable[[Column, T.DataType], Column]) -> Column:
    if not rest:
        return value(old, kind)
    if not isinstance(kind, T.StructType) or rest[0] not in kind.names:
        raise ShapeError(f"no field {'.'.join(rest)}")
    parts = [_put(old[f.name], f.dataType, rest[1:], value).alias(f.name) if f.name == rest[0] else old[f.name].alias(f.name) for f in kind.fields]
    return F.struct(*parts)


def _fitted(v: object, kind: T.DataType) -> object:
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fitted(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_fitted(x, kind.elementType) for x in v]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    return v
