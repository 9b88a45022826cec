"""Models: their fields, relations and computed columns, checked strictly when they are registered."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from treeq import naming
from treeq.errors import Conflict, NotFound, ShapeError

#: Values that stand for nothing, by declared type: for a null that a computed column returns and a sub-field that is missing.
ZEROS = {"string": "", "int": 0, "long": 0, "float": 0.0, "double": 0.0, "boolean": False, "bool": False, "object": {}, "array": []}
NUMBERS = {"int", "long", "float", "double", "number"}
SPARK = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.TimestampNTZType(), "vector": T.ArrayType(T.DoubleType()), "any": T.VariantType()}
METRICS = ("cosine", "l2", "ip")
MODEL_KEYS = {"name", "collection", "idPrefix", "idType", "fields", "relations", "computes", "triggers", "read", "write", "indexes", "ownerKey", "accessKeys", "location", "denyRead", "system", "timestamps", "archive", "physical"}
FIELD_KEYS = {"type", "required", "default", "read", "write", "fields", "items", "strategy", "dim", "metric"}
RELATION_KEYS = {"model", "type", "localField", "foreignField", "read"}
COMPUTE_KEYS = {"fn", "asyncFn", "agg", "depends", "read", "type"}
#: Marks, in a column's metadata, that no table holds it.
MISSING = "treeq.missing"
AGGREGATES = ("$count", "$sum", "$avg", "$min", "$max")
INLINE = ("$size", "$countDistinct", "$sum", "$avg", "$min", "$max")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    default: object = None
    read: tuple[str, ...] | None = None
    write: tuple[str, ...] | None = None
    fields: tuple[Field, ...] = ()
    items: str | None = None
    dim: int | None = None
    metric: str = "cosine"

    def spark(self) -> T.DataType:
        if self.type == "object":
            return T.StructType([T.StructField(f.name, f.spark()) for f in self.fields]) if self.fields else T.VariantType()
        if self.type == "array":
            if self.fields:
                return T.ArrayType(T.StructType([T.StructField(f.name, f.spark()) for f in self.fields]))
            return T.ArrayType(SPARK.get(self.items or "string", T.StringType()))
        return SPARK.get(self.type, T.VariantType())


@dataclass(frozen=True)
class Relation:
    name: str
    model: str
    many: bool
    local: str
    foreign: str
    read: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Compute:
    name: str
    fn: str | None = None
    batch: str | None = None
    agg: tuple[str, str] | None = None  # operator, path
    depends: tuple[str, ...] = ()
    read: tuple[str, ...] | None = None
    type: str = "double"


@dataclass(frozen=True)
class Location:
    source: str = "default"
    database: str | None = None
    schema: str | None = None
    role: str | None = None
    priority: int = 0


@dataclass(frozen=True)
class AccessKey:
    field: str
    list_key: str
    bypass: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    name: str
    collection: str
    fields: dict[str, Field]
    relations: dict[str, Relation] = field(default_factory=dict)
    computes: dict[str, Compute] = field(default_factory=dict)
    read: tuple[str, ...] | None = None
    write: tuple[str, ...] | None = None
    owner_key: str = "createdBy"
    access_keys: tuple[AccessKey, ...] = ()
    deny_read: bool = False
    system: bool = False
    timestamps: str | None = "ms"
    archive: bool = True
    id_prefix: str | None = None
    id_type: str = "string"
    unique: tuple[tuple[str, ...], ...] = ()
    locations: tuple[Location, ...] = (Location(),)
    physical: dict[str, str] = field(default_factory=dict)  # logical -> column, or "= SQL expression"
    triggers: dict = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("_id", SPARK.get(self.id_type, T.StringType())), *(T.StructField(f.name, f.spark()) for f in self.fields.values())])

    def field_at(self, path: str) -> Field | None:
        head, *rest = path.split(".")
        found = Field("_id", self.id_type) if head == "_id" else self.fields.get(head)
        for part in rest:
            if found is None:
                return None
            found = next((f for f in found.fields if f.name == part), None)
        return found


def _strict(what: str, given: dict, known: set[str]) -> None:
    if unknown := set(given) - known:
        raise ShapeError(f"{what}: unknown keys {sorted(unknown)}")


def _roles(what: str, given: object) -> tuple[str, ...] | None:
    if given is None:
        return None
    if not isinstance(given, list) or not all(isinstance(r, str) for r in given):
        raise ShapeError(f"{what} is a list of roles")
    return tuple(given)


def field_of(name: str, spec: object) -> Field:
    spec = {"type": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict):
        raise ShapeError(f"field {name} is a type or an object")
    _strict(f"field {name}", spec, FIELD_KEYS)
    if not isinstance(spec.get("type"), str):
        raise ShapeError(f"field {name} has no type")
    if spec["type"] == "vector":
        dim = spec.get("dim")
        if not isinstance(dim, int) or not 1 <= dim <= 16_000:
            raise ShapeError(f"vector {name} has a dim from 1 to 16000")
        if spec.get("metric", "cosine") not in METRICS:
            raise ShapeError(f"vector {name}: the metric is one of {METRICS}")
    elif "dim" in spec or "metric" in spec:
        raise ShapeError(f"field {name} isn't a vector, and has no dim or metric")
    inner = tuple(field_of(k, v) for k, v in spec.get("fields", {}).items())
    return Field(name, spec["type"], bool(spec.get("required")), spec.get("default"), _roles(f"{name}.read", spec.get("read")), _roles(f"{name}.write", spec.get("write")), inner, spec.get("items"), spec.get("dim"), spec.get("metric", "cosine"))


def _compute(name: str, spec: dict, fields: dict[str, Field], relations: dict[str, Relation]) -> Compute:
    _strict(f"compute {name}", spec, COMPUTE_KEYS)
    kinds = [k for k in ("fn", "asyncFn", "agg") if spec.get(k) is not None]
    if len(kinds) != 1:
        raise ShapeError(f"compute {name} has one of fn, asyncFn and agg")
    agg = None
    if kinds == ["agg"]:
        if not isinstance(spec["agg"], dict) or len(spec["agg"]) != 1:
            raise ShapeError(f"compute {name}: agg is one operator with a path")
        op, path = next(iter(spec["agg"].items()))
        head, _, rest = str(path).partition(".")
        if head in relations:
            if op not in AGGREGATES or (op == "$count") == bool(rest) or "." in rest:
                raise ShapeError(f"compute {name}: {op} over {path} is not known")
        elif not (head in fields and fields[head].type == "array" and op in INLINE) or (op == "$size" and rest):
            raise ShapeError(f"compute {name}: {op} over {path} is not known")
        agg = (op, str(path))
    return Compute(name, spec.get("fn"), spec.get("asyncFn"), agg, tuple(spec.get("depends", ())), _roles(f"{name}.read", spec.get("read")), spec.get("type", "double"))


def model_of(spec: dict) -> Model:
    _strict("model", spec, MODEL_KEYS)
    name = spec.get("name")
    if not isinstance(name, str) or not name:
        raise ShapeError("a model has a name")
    fields = {k: field_of(k, v) for k, v in spec.get("fields", {}).items()}
    if "_id" in fields or "_score" in fields:
        raise ShapeError(f"{name}: _id and _score are reserved")
    stamps = spec.get("timestamps", True)
    if not (isinstance(stamps, bool) or stamps in ("ms", "s")):
        raise ShapeError(f"{name}: timestamps is true, false, ms or s")
    relations = {}
    for k, r in spec.get("relations", {}).items():
        _strict(f"relation {k}", r, RELATION_KEYS)
        if r.get("type") not in ("one", "many") or not isinstance(r.get("model"), str):
            raise ShapeError(f"relation {k} has a model and the type one or many")
        relations[k] = Relation(k, r["model"], r["type"] == "many", r.get("localField", "_id"), r.get("foreignField", k), _roles(f"{k}.read", r.get("read")))
    both = set(fields) & set(relations)
    if both:
        raise ShapeError(f"{name}: {sorted(both)} are fields and relations")
    read, write = _roles("read", spec.get("read")), _roles("write", spec.get("write"))
    owner = spec.get("ownerKey", "createdBy")
    if owner == "_id":
        raise ShapeError(f"{name}: the owner key isn't _id")
    lists = [read, write, *(f.read for f in fields.values()), *(f.write for f in fields.values())]
    if any("creator" in (x or ()) for x in lists) and owner not in fields:
        fields[owner] = Field(owner, "string")
    if stamps:
        for k in ("createdAt", "updatedAt"):
            fields.setdefault(k, Field(k, "number"))
    computes = {k: _compute(k, c, fields, relations) for k, c in spec.get("computes", {}).items()}
    if pairs := naming.clashes([*fields, *relations, *(c for c in computes if c not in fields)]):
        raise ShapeError(f"{name}: {pairs[0][0]} and {pairs[0][1]} are one name in storage")
    keys = []
    for f, k in (spec.get("accessKeys") or {}).items():
        k = {"list": k} if isinstance(k, str) else k
        _strict(f"accessKeys.{f}", k, {"list", "bypassRoles"})
        if f != "_id" and f not in fields:
            raise ShapeError(f"{name}: accessKeys.{f} is not a field")
        keys.append(AccessKey(f, k.get("list", f), tuple(k.get("bypassRoles", ()))))
    unique = []
    for ix in spec.get("indexes", []):
        if ix.get("unique"):
            on = ix.get("fields") or ix.get("keys") or []
            unique.append(tuple(on))
    where = spec.get("location") or {}
    where = where if isinstance(where, list) else [where]
    for x in where:
        _strict("location", x, {"source", "database", "schema", "role", "priority"})
    from treeq.operators.triggers import checked  # late: it reads models

    return Model(name, spec.get("collection", naming.snake(name)), fields, relations, computes, read, write, owner, tuple(keys), bool(spec.get("denyRead")), bool(spec.get("system")), {True: "ms", False: None}.get(stamps, stamps), bool(spec.get("archive", True)), spec.get("idPrefix"), spec.get("idType", "string"), tuple(unique), tuple(Location(**x) for x in where), dict(spec.get("physical", {})), checked(name, spec.get("triggers", {})))


class Registry:
    """Models by name. A batch is registered as a whole or not at all."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}
        self.version = 0

    def register(self, spec: dict) -> Model:
        return self.register_batch([spec])[0]

    def register_batch(self, specs: list[dict]) -> list[Model]:
        made = [model_of(s) for s in specs]
        names = [m.name for m in made]
        if len(set(names)) != len(names):
            raise Conflict("a model is defined twice in one batch")
        new = dict(self.models)
        for m in made:
            if m.archive and not m.system and not m.name.endswith("Deleted"):
                shadow = replace(m, name=f"{m.name}Deleted", collection=f"{m.collection}_deleted", fields=m.fields | {"deletedAt": Field("deletedAt", "number")}, relations={}, computes={}, archive=False, triggers={}, unique=())
                new.setdefault(shadow.name, shadow)
            new[m.name] = m
        places: dict[tuple, str] = {}
        for m in new.values():
            where = m.locations[0]
            key = (where.source, where.database, where.schema, m.collection)
            if key in places and places[key] != m.name:
                raise Conflict(f"{m.name} and {places[key]} are stored in one place")
            places[key] = m.name
        self.models, self.version = new, self.version + 1
        return made

    def unregister(self, name: str) -> None:
        if name in self.models:
            self.models = {k: m for k, m in self.models.items() if k not in (name, f"{name}Deleted")}
            self.version += 1

    def __getitem__(self, name: str) -> Model:
        if name not in self.models:
            raise NotFound(f"model {name} is not registered")
        return self.models[name]

    def __contains__(self, name: str) -> bool:
        return name in self.models

    def list(self) -> list[str]:
        return sorted(self.models)


def schema_of(name: str, struct: T.StructType, id_column: str | None = None, style: str = "camel") -> dict:
    """A model's definition from a DataFrame's schema; relations are declared by hand."""

    def kind(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "fields": {f.name: kind(f.dataType) for f in t.fields}}
        if isinstance(t, T.ArrayType):
            inner = kind(t.elementType)
            return {"type": "array", "fields": inner["fields"]} if "fields" in inner else {"type": "array", "items": inner["type"]}
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return {"type": "date"}
        names = {T.StringType: "string", T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.DecimalType: "number"}
        return {"type": names.get(type(t), "any")}

    fields, physical = {}, {}
    for f in struct.fields:
        logical = "_id" if f.name == id_column else naming.written(f.name, style)
        physical[logical] = f.name
        if logical != "_id":
            fields[logical] = kind(f.dataType)
    out = {"name": name, "fields": fields, "physical": physical, "timestamps": False, "archive": False}
    if id_column:
        out["idType"] = kind(struct[id_column].dataType)["type"]
    return out


def merged(base: list[dict], overlay: list[dict]) -> list[dict]:
    """Definitions by name: structure from base; the overlay wins for read, write and what else it gives."""
    out = {d["name"]: dict(d) for d in base}
    for d in overlay:
        mine = out.setdefault(d["name"], {"name": d["name"]})
        for k, v in d.items():
            mine[k] = {**mine[k], **v} if isinstance(v, dict) and isinstance(mine.get(k), dict) and k in ("fields", "relations", "computes", "physical") else v
    return list(out.values())
