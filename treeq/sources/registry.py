"""Where models are stored: named sources of files, tables and frames in memory."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import NotFound, ShapeError
from treeq.schema import MISSING, Location, Model

FILES = ("parquet", "json", "csv", "orc")
KINDS = (*FILES, "jdbc", "table", "memory")
ROLES = {"primary": 0, None: 0, "replica": 1, "backup": 2}


@dataclass
class Source:
    """kind: one of KINDS. path holds collections as path/[database/][schema/]collection, with the file kind's ending or as folders."""

    kind: str
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    reachable: bool = True

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ShapeError(f"unknown kind of source {self.kind}")


@dataclass
class Degraded:
    """A link that couldn't be read, and was passed over."""

    code: str
    message: str


class Sources:
    def __init__(self, spark: SparkSession, sources: dict[str, Source], limit_rows: int | None = None) -> None:
        self.spark, self.sources, self.limit_rows = spark, sources, limit_rows
        self.degraded: list[Degraded] = []

    def source(self, name: str) -> Source:
        if name not in self.sources:
            raise NotFound(f"source {name} is not registered")
        return self.sources[name]

    def links(self, model: Model, route: dict | None = None) -> list[Location]:
        """The model's places in the order in which they are tried; route replaces parts of the first."""
        if route:
            if unknown := set(route) - {"source", "database", "schema"}:
                raise ShapeError(f"route: unknown keys {sorted(unknown)}")
            return [replace(model.locations[0], **route)]
        return sorted(model.locations, key=lambda x: (ROLES.get(x.role, 3), x.priority))

    def scan(self, model: Model, route: dict | None = None) -> DataFrame:
        """All rows under their logical names. A collection that isn't there is empty; a source that isn't reachable is passed over."""
        for where in self.links(model, route):
            s = self.source(where.source)
            if not s.reachable:
                self.degraded.append(Degraded("link_unreachable", f"{model.name}: {where.source} was passed over"))
                continue
            return self.logical(model, self.read(model, s, where))
        raise NotFound(f"no link of {model.name} can be read")

    def place(self, model: Model, s: Source, where: Location) -> str:
        parts = [s.path.rstrip("/"), where.database, where.schema, model.collection]
        return "/".join(p for p in parts if p)

    def read(self, model: Model, s: Source, where: Location) -> DataFrame | None:
        if s.kind == "memory":
            return s.frames.get(model.collection)
        if s.kind == "table":
            name = ".".join(p for p in (where.database, where.schema, model.collection) if p)
            return self.spark.table(name) if self.spark.catalog.tableExists(name) else None
        if s.kind == "jdbc":
            name = ".".join(p for p in (where.schema or where.database, model.collection) if p)
            return self.spark.read.format("jdbc").options(**s.options).option("dbtable", name).load()
        base = self.place(model, s, where)
        for path in (f"{base}.{s.kind}", base, *self.left_over(base)):
            if self.exists(path):
                reader = self.spark.read.format(s.kind).options(**s.options)
                return (reader if s.kind in ("parquet", "orc", "avro") else reader.schema(self.stored_schema(model))).load(path)
        return None

    def left_over(self, base: str) -> list[str]:
        """The rows before a write that was cut off between its two renames."""
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{base}-*.old")
        fs = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(x.getPath()) for x in fs.globStatus(found) or []][:1]

    def exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def stored_schema(self, model: Model) -> T.StructType:
        return T.StructType([T.StructField(self.physical(model, f.name), f.dataType) for f in model.struct().fields])

    @staticmethod
    def physical(model: Model, name: str) -> str:
        return model.physical.get(name, name)

    def logical(self, model: Model, df: DataFrame | None) -> DataFrame:
        """Declared columns under their logical names; columns that aren't stored are null, and an expression stands after '='."""
        struct = model.struct()
        if df is None:
            return self.spark.createDataFrame([], struct)
        out = []
        for f in struct.fields:
            stored = self.physical(model, f.name)
            if stored.startswith("="):
                out.append(F.expr(stored[1:]).alias(f.name))
            elif stored in df.columns:
                out.append(F.col(f"`{stored}`").alias(f.name))
            elif f.name == "_id":
                raise ShapeError(f"{model.name} has no column for _id")
            else:
                out.append(F.lit(None).cast(f.dataType).alias(f.name, metadata={MISSING: True}))
        if "__present" in df.columns:
            out.append(F.col("__present"))
        found = df.select(*out)
        return found if self.limit_rows is None else self.capped(found, model, self.limit_rows)

    @staticmethod
    def capped(df: DataFrame, model: Model, most: int) -> DataFrame:
        """df, of which a row beyond most is an error when the query runs; nothing is counted before."""
        first = df.limit(most + 1)
        size = first.select(F.count(F.lit(1)).over(Window.partitionBy()).alias("__rows"), "*")
        many = F.raise_error(F.lit(f"{model.name} has more than {most} rows")).cast("boolean")
        return size.where(F.when(F.col("__rows") > most, many).otherwise(F.lit(True))).drop("__rows")


def load_directory(files: dict[str, dict], sources: dict[str, dict]) -> list[dict]:
    """Definitions with their locations from files {path: definition} and sources {name: {kind, databases}}.

    The first folder is the database, and belongs to exactly one source; sources of kind table take the next folder as the
    schema. Each name has exactly one definition that isn't a replica. Sorted by name, the primary first.
    """
    found: list[tuple[str, int, dict]] = []
    for path, spec in sorted(files.items()):
        folders = path.strip("/").split("/")[:-1]
        if not folders:
            raise ShapeError(f"{path} is in no database folder")
        owners = [n for n, s in sources.items() if folders[0] in s.get("databases", [])]
        if len(owners) != 1:
            raise ShapeError(f"database {folders[0]} belongs to {len(owners)} sources")
        given = spec.get("location") or {}
        where = {"source": owners[0], "database": folders[0], **({"schema": folders[1]} if sources[owners[0]]["kind"] == "table" and len(folders) > 1 else {})}
        for k in ("source", "database", "schema"):
            if given.get(k) not in (None, where.get(k)):
                raise ShapeError(f"{path}: its location says another {k}")
        found.append((spec["name"], ROLES.get(given.get("role"), 3), {**spec, "location": {**given, **where}}))
    names: dict[str, list] = {}
    for name, rank, spec in sorted(found, key=lambda x: x[:2]):
        names.setdefault(name, []).append((rank, spec))
    for name, defs in names.items():
        if sum(rank == 0 for rank, _ in defs) != 1:
            raise ShapeError(f"{name} has {sum(rank == 0 for rank, _ in defs)} primary definitions")
    places: dict[tuple, str] = {}
    out = []
    for name, defs in names.items():
        first = defs[0][1]
        for _, spec in defs:
            where = spec["location"]
            key = (where["source"], where["database"], where.get("schema"), spec.get("collection", name))
            if places.setdefault(key, name) != name:
                raise ShapeError(f"{name} and {places[key]} are stored in one place")
        out.append({**first, "location": [spec["location"] for _, spec in defs]})
    return out
