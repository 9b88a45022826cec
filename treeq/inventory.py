"""Named queries over the test tables for operators that the workload's don't reach, with their SQL.

Rules that reject, choose or compute on the driver are rows of what they did, against the rows that they should do.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.engine import Engine, statement
from treeq.errors import EngineError, public_code
from treeq.functions import vector
from treeq.operators.triggers import due
from treeq.operators.writes import Writer
from treeq.plans import stages
from treeq.policy import Context, Policy
from treeq.resources import content_path, resource_url
from treeq.schema import merged, schema_of
from treeq.sources.registry import Source, load_directory
from treeq.workload import MODELS, PROBE, Query, _memory, _model, ask, engine

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def outcomes(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """(what, outcome): the error's class, or ok."""
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "ok"))
        except EngineError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "what string, outcome string")


def values(columns: str, *rows: tuple) -> str:
    """SQL of fixed rows."""
    quoted = lambda v: "NULL" if v is None else f"{v}::BIGINT" if isinstance(v, int) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({columns})"


#: Columns with nulls, objects that may be null, and arrays of objects, made of what the tables have.
MADE = [
    _model("NullOrder", "orders", {"_id": "o_orderkey", "status": "= nullif(o_orderstatus, 'F')", "meta": "= if(o_orderstatus = 'F', null, named_struct('k', nullif(o_orderpriority, '5-LOW')))", "orderDate": "o_orderdate"}, {"status": "string", "meta": {"type": "object", "fields": {"k": "string"}}, "orderDate": "date"}, location={"database": "./././././."}),
    _model("Boxed", "part", {"_id": "p_partkey", "box": "= named_struct('sizes', array(p_size, p_size % 7))", "items": "= array(named_struct('a', p_size, 'b', p_brand), named_struct('a', p_size % 7, 'b', 'x'))", "sizes": "= array(p_size, p_size, p_size % 7)", "group": "= nullif(p_size % 3, 0)"}, {"box": {"type": "object", "fields": {"sizes": {"type": "array", "items": "int"}}}, "items": {"type": "array", "fields": {"a": "int", "b": "string"}}, "sizes": {"type": "array", "items": "int"}, "group": "int", "grade": {"type": "string", "default": "none"}, "note": "string"}, location={"database": "././././././."}),
]


def made(spark: SparkSession, sf: str, **options: object) -> Engine:
    e = engine(spark, sf, **options)
    e.register(*MADE)
    return e


def _count(e: Engine, model: str, c: dict) -> DataFrame:
    return e.query(f"{model}($condition:@c,$group:@g){{ n }}", {"c": c, "g": {"agg": {"n": {"$count": "*"}}}})


def _counts(e: Engine, model: str, cases: dict[str, dict]) -> DataFrame:
    out = None
    for name, c in cases.items():
        one = _count(e, model, c).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# conditions


@query("SELECT r_regionkey AS _id, r_name AS name FROM region")
def filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Region($condition:@c){ name }", c={})


@query("SELECT 'null' AS what, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'eq', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'ne', count(*) FILTER (o_orderstatus <> 'F') FROM orders UNION ALL SELECT 'in', count(*) FILTER (o_orderstatus IN ('F', 'P')) FROM orders UNION ALL SELECT 'nin', count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) FROM orders")
def filter_null_forms(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(made(spark, sf), "NullOrder", {"null": {"status": None}, "eq": {"status": {"$eq": None}}, "ne": {"status": {"$ne": None}}, "in": {"status": {"$in": [None, "P"]}}, "nin": {"status": {"$nin": [None, "P"]}}})


@query("SELECT 'there' AS what, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders UNION ALL SELECT 'away', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'null', count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority = '5-LOW') FROM orders UNION ALL SELECT 'ne', count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority <> '5-LOW') FROM orders")
def filter_nested_presence(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(made(spark, sf), "NullOrder", {"there": {"meta.k": {"$exists": True}}, "away": {"meta.k": {"$exists": False}}, "null": {"meta.k": None}, "ne": {"meta.k": {"$ne": None}}})


@query("SELECT 'plain' AS what, count(*) FILTER (regexp_matches(p_name, '^small .*g$')) AS n FROM part UNION ALL SELECT 'upper', count(*) FILTER (regexp_matches(p_name, '^SMALL')) FROM part UNION ALL SELECT 'flags', count(*) FILTER (regexp_matches(p_name, '^SMALL', 'i')) FROM part UNION ALL SELECT 'not', count(*) FILTER (NOT regexp_matches(p_name, 'r.ng')) FROM part")
def filter_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(engine(spark, sf), "Part", {"plain": {"name": {"$regex": "^small .*g$"}}, "upper": {"name": {"$regex": "^SMALL"}}, "flags": {"name": {"$regex": "^SMALL", "$options": "i"}}, "not": {"name": {"$not": {"$regex": "r.ng"}}}})


@query("SELECT 'any' AS what, count(*) FILTER (p_size > 45 OR p_size % 7 > 45) AS n FROM part UNION ALL SELECT 'eq', count(*) FILTER (p_size = 5 OR p_size % 7 = 5) FROM part UNION ALL SELECT 'nin', count(*) FILTER (p_size NOT IN (5, 6) AND p_size % 7 NOT IN (5, 6)) FROM part UNION ALL SELECT 'both', count(*) FILTER (p_size < 9) FROM part")
def filter_dotted_array(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(made(spark, sf), "Boxed", {"any": {"items.a": {"$gt": 45}}, "eq": {"items.a": 5}, "nin": {"items.a": {"$nin": [5, 6]}}, "both": {"items.b": "x", "$and": [{"sizes": {"$exists": True}}], "box.sizes": {"$lt": 9}, "$nor": [{"box.sizes": {"$gte": 9}}]}})


@query("SELECT 'whole' AS what, count(*) FILTER (p_size = 3) AS n FROM part UNION ALL SELECT 'part', count(*) FILTER (p_size = 5 OR p_size % 7 = 5) FROM part UNION ALL SELECT 'order', 0 UNION ALL SELECT 'overlap', count(*) FILTER (p_size IN (5, 20) OR p_size % 7 IN (5, 20)) FROM part UNION ALL SELECT 'none', count(*) FILTER (p_size <> 5 AND p_size % 7 <> 5) FROM part")
def filter_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(made(spark, sf), "Boxed", {"whole": {"sizes": [3, 3, 3]}, "part": {"sizes": 5}, "order": {"sizes": [1, 8, 8]}, "overlap": {"sizes": {"$in": [5, 20]}}, "none": {"sizes": {"$ne": 5}}})


@query("SELECT event_id AS _id, event_type AS eventType FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 12")
def filter_object_equal(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Event($condition:@c){ eventType }", c={"props": {"$eq": {"k": 12}}})


@query("SELECT o_orderkey AS _id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderkey < 5000")
def filter_typed_literals(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($condition:@c){ _id }", c={"orderDate": {"$gte": {"$date": "1998-01-01T00:00:00Z"}}, "_id": {"$lt": {"$numberLong": "5000"}}})


# projections


@query("SELECT event_id AS _id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 1::BIGINT AS parts FROM events")
def project_parent_wins(spark: SparkSession, sf: str) -> DataFrame:
    df = ask(spark, sf, "Event{ props, props.k }")
    return df.select("_id", F.col("props.k").alias("k"), F.lit(sum(c.startswith("props") for c in df.columns)).cast("long").alias("parts"))


@query("SELECT c_name AS name, c_acctbal AS acctBal FROM customer")
def project_without_id(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).command({"kind": "find", "collection": "customer", "projection": {"_id": 0, "name": 1, "acctBal": 1}})


@query("SELECT p_partkey AS _id, concat_ws(',', p_size, p_size % 7) AS a, 'a' AS parts FROM part")
def project_in_arrays(spark: SparkSession, sf: str) -> DataFrame:
    df = made(spark, sf).command({"kind": "aggregate", "collection": "Boxed", "pipeline": [{"$project": {"items.a": 1}}]})
    return df.select("_id", F.array_join(F.transform("items.a", lambda x: x.cast("string")), ",").alias("a"), F.lit(",".join(df.schema["items"].dataType.elementType.names)).alias("parts"))


@query("SELECT p_partkey AS _id, 'none' AS grade, NULL::VARCHAR AS note FROM part")
def default_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A field that the table doesn't hold is missing: its default, or null."""
    return made(spark, sf).query("Boxed{ grade, note }")


@query("SELECT o_orderkey AS _id, coalesce(nullif(o_orderstatus, 'F'), 'new') AS status FROM orders")
def default_fill_present(spark: SparkSession, sf: str) -> DataFrame:
    """Where __present tells, a missing value is the default and a stored null stays: here all nulls of status are missing."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("_id"), F.expr("nullif(o_orderstatus, 'F')").alias("status"), F.expr("if(o_orderstatus = 'F', array('_id'), array('_id', 'status'))").alias("__present"))
    e = Engine(spark, Source("memory", frames={"orders": rows}))
    e.register(_model("Order", "orders", {}, {"status": {"type": "string", "default": "new"}}))
    return e.query("Order{ status }")


# relations and order


@query("SELECT r_regionkey AS _id, row_number() OVER (PARTITION BY r_regionkey ORDER BY most DESC NULLS LAST, n_nationkey) - 1 AS pos, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS most FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def sort_by_nested_relation(spark: SparkSession, sf: str) -> DataFrame:
    df = ask(spark, sf, "Region{ nations($sort:@s){ name } }", s={"customers.acctBal": -1})
    return df.select("_id", F.posexplode("nations").alias("pos", "n")).select("_id", F.col("pos").cast("long").alias("pos"), "n.name")


@query("SELECT o_orderkey AS _id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)) - 1 AS pos, l_extendedprice AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' QUALIFY pos < 2")
def lookup_topn(spark: SparkSession, sf: str) -> DataFrame:
    p = [{"$match": {"status": "P"}}, {"$lookup": {"from": "lineitem", "localField": "_id", "foreignField": "orderId", "as": "top", "pipeline": [{"$sort": {"extendedPrice": -1}}, {"$limit": 2}, {"$project": {"extendedPrice": 1}}]}}, {"$project": {"top": 1}}]
    df = engine(spark, sf).command({"kind": "aggregate", "collection": "orders", "pipeline": p})
    return df.select("_id", F.posexplode("top").alias("pos", "x")).select("_id", F.col("pos").cast("long").alias("pos"), F.col("x.extendedPrice").alias("price"))


@query("SELECT c_custkey AS _id, count(o_orderkey) AS n, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100 * c_acctbal / 2 AND o_orderstatus = 'F' WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def lookup_let(spark: SparkSession, sf: str) -> DataFrame:
    inner = [{"$match": {"$expr": {"$and": [{"$eq": ["$custId", "$$who"]}, {"$eq": [{"$in": [True, ["$$rich"]]}, "$$rich"]}]}, "status": "F"}}, {"$addFields": {"bal": "$$bal"}}]
    p = [{"$match": {"mktSegment": "BUILDING"}}, {"$lookup": {"from": "orders", "let": {"who": "$_id", "bal": "$acctBal", "rich": {"$eq": ["$mktSegment", "BUILDING"]}}, "pipeline": inner, "as": "orders"}}, {"$project": {"orders": 1}}]
    df = engine(spark, sf).command({"kind": "aggregate", "collection": "customer", "pipeline": p})
    big = F.filter("orders", lambda o: o["totalPrice"] > 100 * o["bal"] / 2)
    return df.select("_id", F.size(big).cast("long").alias("n"), F.array_max(F.transform(big, lambda o: o["totalPrice"])).alias("most"))


@query("SELECT p_partkey AS _id, (SELECT count(*) FROM part q WHERE nullif(q.p_size % 3, 0) IS NOT DISTINCT FROM nullif(p.p_size % 3, 0) AND q.p_partkey < 20) AS n FROM part p WHERE p_partkey < 40")
def lookup_null_key(spark: SparkSession, sf: str) -> DataFrame:
    p = [{"$match": {"_id": {"$lt": 40}}}, {"$lookup": {"from": "Boxed", "localField": "group", "foreignField": "group", "as": "same", "pipeline": [{"$match": {"_id": {"$lt": 20}}}]}}, {"$project": {"n": {"$size": "$same"}}}]
    return made(spark, sf).command({"kind": "aggregate", "collection": "Boxed", "pipeline": p}).withColumn("n", F.col("n").cast("long"))


@query("SELECT c_custkey AS _id, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1, 2")
def lookup_group(spark: SparkSession, sf: str) -> DataFrame:
    inner = [{"$match": {"$expr": {"$eq": ["$custId", "$$who"]}}}, {"$group": {"_id": "$status", "n": {"$sum": 1}}}]
    p = [{"$match": {"nationId": 3}}, {"$lookup": {"from": "orders", "let": {"who": "$_id"}, "pipeline": inner, "as": "by"}}, {"$project": {"by": 1}}]
    df = engine(spark, sf).command({"kind": "aggregate", "collection": "customer", "pipeline": p})
    return df.select("_id", F.explode("by").alias("b")).select("_id", F.col("b._id").alias("status"), "b.n")


@query("SELECT t.p_partkey AS _id, count(q.p_partkey) AS n FROM part t LEFT JOIN part q ON q.p_partkey IN (t.p_partkey + 1, t.p_partkey + 2) WHERE t.p_partkey < 500 GROUP BY 1")
def lookup_array_key(spark: SparkSession, sf: str) -> DataFrame:
    p = [{"$match": {"_id": {"$lt": 500}}}, {"$lookup": {"from": "Part", "localField": "others", "foreignField": "_id", "as": "next"}}, {"$project": {"n": {"$size": "$next"}}}]
    return engine(spark, sf).command({"kind": "aggregate", "collection": "Tagged", "pipeline": p}).withColumn("n", F.col("n").cast("long"))


@query("SELECT p_partkey AS _id, s AS size FROM part, unnest([p_size, p_size % 7]) AS u(s)")
def unwind_dotted(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf).command({"kind": "aggregate", "collection": "Boxed", "pipeline": [{"$unwind": "$box.sizes"}, {"$project": {"size": "$box.sizes"}}]})


@query("SELECT o_orderkey AS _id FROM orders ORDER BY o_orderkey OFFSET 100")
def offset_alone(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($skip:@k){ _id }", k=100)


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < -900) AS yes, EXISTS (SELECT 1 FROM customer WHERE c_acctbal < -90000) AS no, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n")
def exists_and_count(spark: SparkSession, sf: str) -> DataFrame:
    e, below = engine(spark, sf), lambda x: {"acctBal": {"$lt": x}}
    return spark.createDataFrame([(e.exists("Customer", below(-900)), e.exists("Customer", below(-90000)), e.count("Customer", below(0)))], "yes boolean, no boolean, n long")


@query("SELECT p AS page, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total, p * 50 < (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS has_more, greatest(0, least(50, (SELECT count(*) FROM customer WHERE c_acctbal > 0) - (p - 1) * 50)) AS n FROM (VALUES (1::BIGINT), (2), (100000)) AS t(p)")
def page_has_more(spark: SparkSession, sf: str) -> DataFrame:
    e, rows = engine(spark, sf), []
    for page in (1, 2, 100_000):
        got = e.query_with_count("Customer($condition:@c){ name }", {"c": {"acctBal": {"$gt": 0}}, "page": page, "pageSize": 50})
        rows.append((page, got.total, got.has_more, got.items.count()))
    return spark.createDataFrame(rows, "page long, total long, has_more boolean, n long")


# expressions


@query("SELECT p_partkey AS _id, (p_size > 10 AND p_size < 30) OR p_size = 50 AS both, coalesce(nullif(p_size % 3, 0), -1)::BIGINT AS grp, true AS is_array, false AS is_size, (SELECT count(*) FROM unnest([p_size, p_size, p_size % 7]) AS u(x) WHERE x <> 5) AS kept, CASE WHEN p_size % 3 = 0 THEN 'three' ELSE 'other' END AS kind FROM part")
def expressions(spark: SparkSession, sf: str) -> DataFrame:
    among = lambda xs: {"$in": [{"$arrayElemAt": ["$sizes", 0]}, xs]}
    p = [{"$project": {"both": {"$or": [{"$and": [among(list(range(11, 100))), {"$ne": [among(list(range(30, 100))), True]}]}, among([50])]}, "grp": {"$ifNull": ["$group", -1]}, "is_array": {"$isArray": "$sizes"}, "is_size": {"$isArray": ["$group"]}, "kept": {"$size": {"$filter": {"input": "$sizes", "as": "s", "cond": {"$ne": ["$$s", 5]}}}}, "kind": {"$cond": {"if": {"$eq": [{"$ifNull": ["$group", 0]}, 0]}, "then": "three", "else": "other"}}}}]
    df = made(spark, sf).command({"kind": "aggregate", "collection": "Boxed", "pipeline": p})
    return df.withColumns({"kept": F.col("kept").cast("long"), "grp": F.col("grp").cast("long")})


@query(f"SELECT vec_id AS _id, round(list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, PROBE))}]::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, PROBE))}]::DOUBLE[]) DESC, vec_id LIMIT 7")
def meta_score(spark: SparkSession, sf: str) -> DataFrame:
    found = ask(spark, sf, "Embedding($condition:@c){ _score }", c={"embedding": {"$near": {"$vector": PROBE, "$limit": 7}}})
    made_ = stages.run(found, [{"$addFields": {"score": {"$meta": "vectorSearchScore"}}}, {"$project": {"score": 1}}], lambda name: found)
    return made_.withColumn("score", F.round("score", 6))


# vectors


@query(values("what, outcome", ("short", "error"), ("whole", "ok"), ("cap", "error"), ("below cap", "ok")))
def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A vector of another length, and more rows than may be ranked, are errors when the query runs."""
    short = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.expr("if(vec_id = 7, slice(embedding, 1, 10), embedding)").alias("embedding"), "label")
    out = []
    for name, e in (("short", Engine(spark, Source("memory", frames={"embeddings": short}))), ("whole", Engine(spark, Source("parquet", sf))), ("cap", Engine(spark, Source("parquet", sf), vector_rows=10)), ("below cap", Engine(spark, Source("parquet", sf), vector_rows=10_000_000))):
        e.register(_model("Embedding", "embeddings", {"_id": "vec_id"}, {"embedding": {"type": "vector", "dim": 64}, "label": "int"}))
        try:
            e.query("Embedding($condition:@c){ _score }", {"c": {"embedding": {"$near": {"$vector": PROBE, "$limit": 5}}}}).collect()
            out.append((name, "ok"))
        except Exception as err:  # noqa: BLE001  the session's own class
            out.append((name, "error" if "64" in str(err) or "more than" in str(err) or "dimension" in str(err) else type(err).__name__))
    return spark.createDataFrame(out, "what string, outcome string")


@query(values("kind, backend, supported, dim", ("parquet", "parquet", True, 16000), ("memory", "memory", True, 16000), ("jdbc", "postgresql", True, 2000), ("jdbc", "sqlite", True, 16000), ("queue", "unknown", False, 0)))
def vector_capability(spark: SparkSession, sf: str) -> DataFrame:
    cases = [("parquet", None), ("memory", None), ("jdbc", {"url": "jdbc:postgresql://h/d"}), ("jdbc", {"url": "jdbc:sqlite:f"}), ("queue", None)]
    return spark.createDataFrame([(k, (c := vector.capability(k, o))["backend"], c["supported"], c["maxDim"]) for k, o in cases], "kind string, backend string, supported boolean, dim long")


# sources


def _folder(spark: SparkSession) -> str:
    """A fresh folder that all executors see; a temporary one on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir")
        base = f"file://{tempfile.mkdtemp(prefix='treeq-')}"
    return f"{base.rstrip('/')}/treeq-rows-{uuid.uuid4().hex}"


@query("SELECT 0::BIGINT AS n")
def missing_collection(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark, Source("parquet", sf))
    e.register(_model("Ghost", "not_there", {}, {"name": "string"}))
    return _count(e, "Ghost", {})


@query("SELECT n_nationkey AS _id, n_name AS name FROM nation WHERE n_regionkey = 1")
def table_source(spark: SparkSession, sf: str) -> DataFrame:
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("treeq_nation")
    e = Engine(spark, Source("table"))
    e.register(_model("Nation", "treeq_nation", {"_id": "n_nationkey", "name": "n_name", "regionId": "n_regionkey"}, {"name": "string", "regionId": "int"}, "int"))
    return e.query("Nation($condition:@c){ name }", {"c": {"regionId": 1}})


@query("SELECT k AS kind, n_nationkey AS _id, n_name AS name, n_regionkey AS regionId FROM nation, (VALUES ('parquet'), ('json'), ('csv'), ('orc')) AS t(k)")
def source_kinds(spark: SparkSession, sf: str) -> DataFrame:
    rows, folder, out = spark.read.parquet(f"{sf}/nation.parquet"), _folder(spark), None
    for kind in ("parquet", "json", "csv", "orc"):
        rows.write.format(kind).save(f"{folder}/nation.{kind}")
        e = Engine(spark, Source(kind, folder))
        e.register(_model("Nation", "nation", {"_id": "n_nationkey", "name": "n_name", "regionId": "n_regionkey"}, {"name": "string", "regionId": "int"}, "int"))
        one = e.query("Nation{ name, regionId }").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'replica' AS read_from, r_regionkey AS _id, r_name AS name, 1::BIGINT AS passed_over FROM region UNION ALL SELECT 'route', r_regionkey, upper(r_name || '!'), 0 FROM region")
def read_links(spark: SparkSession, sf: str) -> DataFrame:
    """An unreachable primary is passed over; a route names another source."""
    rows = spark.read.parquet(f"{sf}/region.parquet")
    loud = rows.withColumn("r_name", F.upper(F.concat("r_name", F.lit("!"))))
    e = Engine(spark, {"a": Source("memory", reachable=False), "b": Source("memory", frames={"region": rows}), "c": Source("memory", frames={"region": loud})})
    e.register(_model("Region", "region", {"_id": "r_regionkey", "name": "r_name"}, {"name": "string"}, "int", location=[{"source": "a", "role": "primary"}, {"source": "b", "role": "replica", "priority": 1}]))
    first = e.query("Region{ name }").select(F.lit("replica").alias("read_from"), "_id", "name", F.lit(len(e.sources.degraded)).cast("long").alias("passed_over"))
    return first.unionByName(e.query("Region{ name }", route={"source": "c"}).select(F.lit("route").alias("read_from"), "_id", "name", F.lit(0).cast("long").alias("passed_over")))


@query(values("what, outcome", ("rows", "error"), ("rows below", "ok"), ("federated", "error"), ("text profile", "ok")))
def row_caps(spark: SparkSession, sf: str) -> DataFrame:
    out, ctx = [], {"userId": "u"}
    for name, options in (("rows", {"limit_rows": 10}), ("rows below", {"limit_rows": 10_000_000}), ("federated", {"federated_rows": 10}), ("text profile", {"profile": "text2query"})):
        e = Engine(spark, Source("parquet", sf), **options)
        e.register(MODELS[0], MODELS[1], MODELS[2])
        try:
            (e.query if name.startswith("rows") else e.federated)("Nation{ name }", {}, ctx).collect()
            out.append((name, "ok"))
        except Exception as err:  # noqa: BLE001  the session's own class
            out.append((name, "error" if "more than 10 rows" in str(err) else type(err).__name__))
    return spark.createDataFrame(out, "what string, outcome string")


@query(values("field, type", ("cCustkey", "long"), ("cName", "string"), ("cNationkey", "int"), ("cAcctbal", "double"), ("cMktsegment", "string")))
def inferred_schema(spark: SparkSession, sf: str) -> DataFrame:
    spec = schema_of("Customer", spark.read.parquet(f"{sf}/customer.parquet").schema)
    return spark.createDataFrame([(k, v if isinstance(v, str) else v["type"]) for k, v in spec["fields"].items()], "field string, type string")


@query("SELECT r_regionkey AS _id, r_name AS name, 1::BIGINT AS overlays FROM region")
def directory_and_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of a folder, with an overlay that wins."""
    spec = {"name": "Region", "collection": "region", "idType": "int", "timestamps": False, "archive": False, "physical": {"_id": "r_regionkey", "name": "r_name"}, "fields": {}}
    found = load_directory({"shop/region.json": spec}, {"files": {"kind": "parquet", "databases": ["shop"]}})
    specs = merged(found, [{"name": "Region", "fields": {"name": "string"}, "read": ["clerk"]}])
    where = {**specs[0], "location": [{**x, "database": "."} for x in specs[0]["location"]]}
    e = Engine(spark, {"files": Source("parquet", sf)})
    e.register(where)
    return e.query("Region{ name }", {}, {"roles": ["clerk"]}).withColumn("overlays", F.lit(len(specs)).cast("long"))


@query("SELECT true AS only_needed")
def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The scan of a group reads the columns that it names, and no other."""
    text = engine(spark, sf).explain("Order($condition:@c,$group:@g){ status, n }", {"c": {"totalPrice": {"$gt": 1}}, "g": {"by": ["status"], "agg": {"n": {"$count": "*"}}}})
    read = [x for x in text.splitlines() if x.startswith("ReadSchema")]
    return spark.createDataFrame([(len(read) == 1 and "o_orderstatus" in read[0] and "o_totalprice" in read[0] and "o_custkey" not in read[0] and "PushedFilters" in text,)], "only_needed boolean")


# writes


def _store(spark: SparkSession, sf: str, *collections: str) -> tuple[Engine, Writer]:
    """Copies of tables as parquet folders, under their models' names."""
    folder = _folder(spark)
    for c in collections:
        spark.read.parquet(f"{sf}/{c}.parquet").write.parquet(f"{folder}/{c}.parquet")
    e = Engine(spark, Source("parquet", folder))
    e.register(*(m for m in MODELS if m["collection"] in collections and m["name"] not in ("Tagged", "LineItem", "EmbeddingL2", "EmbeddingIp")))
    return e, Writer(e, now=lambda: 1_700_000_000_000)


@query("SELECT c_custkey AS _id, CASE WHEN c_nationkey = 3 THEN c_acctbal + 5 ELSE c_acctbal END AS acctBal, c_mktsegment AS mktSegment FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT 999999999, 1.5, 'NEW'")
def parquet_store(spark: SparkSession, sf: str) -> DataFrame:
    """Three writes to a parquet folder, each of which replaces it."""
    e, w = _store(spark, sf, "customer")
    w.update_many("Customer", {"nationId": 3}, {"$inc": {"acctBal": 5}})
    w.delete_many("Customer", {"nationId": 4})
    w.insert("Customer", {"_id": 999_999_999, "name": "n", "nationId": 1, "acctBal": 1.5, "mktSegment": "NEW"})
    return e.table("Customer").select("_id", "acctBal", "mktSegment")


@query("SELECT c_custkey AS _id, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS mktSegment FROM customer")
def update_unset(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "customer")
    w.update_many("Customer", {"nationId": 3}, {"$unset": {"mktSegment": ""}})
    return e.table("Customer").select("_id", "mktSegment")


@query("SELECT n_nationkey AS _id, CASE WHEN n_nationkey = 2 THEN 'SET' ELSE n_name END AS name, n_regionkey AS regionId FROM nation UNION ALL SELECT 500, 'SET', 9")
def upsert_set_on_insert(spark: SparkSession, sf: str) -> DataFrame:
    """The region is set only where a row is inserted."""
    e, w = _memory(spark, sf, "nation")
    for key in (2, 500):
        w.upsert("Nation", {"_id": key}, {"$set": {"name": "SET"}, "$setOnInsert": {"regionId": 9}})
    return e.table("Nation")


@query("SELECT c_custkey AS _id, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'FIRST' ELSE c_mktsegment END AS mktSegment, (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING') AS before_id, 'BUILDING' AS before_segment FROM customer")
def update_first(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "customer")
    done = w.update("Customer", {"mktSegment": "BUILDING"}, {"mktSegment": "FIRST"})
    return e.table("Customer").select("_id", "mktSegment", F.lit(done.before["_id"]).cast("long").alias("before_id"), F.lit(done.before["mktSegment"]).alias("before_segment"))


@query("SELECT n_nationkey AS _id, n_name AS name, CASE WHEN n_name = 'NATION_3' THEN 77 ELSE n_regionkey END AS regionId FROM nation")
def upsert_by_unique(spark: SparkSession, sf: str) -> DataFrame:
    """A mutation without an id finds its row by a unique field."""
    e = Engine(spark, Source("memory", frames={"nation": spark.read.parquet(f"{sf}/nation.parquet")}))
    e.register({**MODELS[1], "relations": {}, "indexes": [{"fields": ["name"], "unique": True}]})
    Writer(e, now=lambda: 1).mutation("Nation", {"name": "NATION_3", "regionId": 77})
    return e.table("Nation")


@query("SELECT n_nationkey AS _id, n_name AS name, n_regionkey AS regionId FROM nation UNION ALL SELECT 300, 'ONE', 50 UNION ALL SELECT 301, 'TWO', 300")
def mutation_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """A value of a later step is the id that an earlier one got."""
    e = Engine(spark, Source("memory", frames={c: spark.read.parquet(f"{sf}/{c}.parquet") for c in ("region", "nation")}))
    child = {**MODELS[1], "relations": {"twins": {"model": "Nation", "type": "many", "localField": "_id", "foreignField": "regionId"}}}
    e.register({**MODELS[0]}, child)
    Writer(e, now=lambda: 1).mutation("Region", {"_id": 50, "name": "NEW", "nations": [{"_id": 300, "name": "ONE", "twins": [{"_id": 301, "name": "TWO", "regionId": "{{step.1._id}}"}]}]})
    return e.table("Nation")


@query("SELECT 1::BIGINT AS _id, 'a' AS title, 'draft' AS status, 'u1' AS createdBy, 1700::BIGINT AS createdAt UNION ALL SELECT 2, 'b', 'done', 'u1', 1700")
def insert_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults, owner and times of new documents."""
    e = Engine(spark, Source("memory"))
    e.register({"name": "Post", "collection": "posts", "idType": "long", "archive": False, "write": ["creator"], "fields": {"title": "string", "status": {"type": "string", "default": "draft"}}})
    w = Writer(e, now=lambda: 1700)
    w.insert_many("Post", [{"_id": 1, "title": "a"}, {"_id": 2, "title": "b", "status": "done"}], {"userId": "u1"})
    return e.table("Post").select("_id", "title", "status", "createdBy", F.col("createdAt").cast("long"))


@query("SELECT 'insert' AS event, r_regionkey::BIGINT AS about, NULL::VARCHAR AS was FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'update', 0, 'AFRICA'")
def triggers(spark: SparkSession, sf: str) -> DataFrame:
    """What triggers of a model wrote into another one."""
    e = Engine(spark, Source("memory"))
    note = {"into": "Note", "op": "insert"}
    e.register({"name": "Area", "collection": "areas", "idType": "long", "timestamps": False, "archive": False, "fields": {"name": "string"}, "triggers": {"insert": [{"name": "i", **note, "data": {"event": "insert", "about": "{{root._id}}"}}], "update": [{"name": "u", **note, "onFields": ["name"], "data": {"event": "update", "about": "{{root._id}}", "was": "{{before.name}}"}}]}}, {"name": "Note", "collection": "notes", "timestamps": False, "archive": False, "fields": {"event": "string", "about": "long", "was": "string"}})
    ids = iter(range(100))
    w = Writer(e, now=lambda: 1, new_id=lambda m: f"n{next(ids)}")
    for r in spark.read.parquet(f"{sf}/region.parquet").where("r_regionkey < 2").orderBy("r_regionkey").collect():
        w.insert("Area", {"_id": r.r_regionkey, "name": r.r_name})
    w.update("Area", {"_id": 0}, {"name": "NEW"})
    w.update("Area", {"_id": 1}, {"name": spark.read.parquet(f"{sf}/region.parquet").where("r_regionkey = 1").first().r_name})
    return e.table("Note").select("event", "about", "was")


@query("SELECT strftime(t, '%Y-%m-%d %H:%M') AS at, minute(t) % 20 = 0 AS every_20, hour(t) = 2 AND minute(t) = 0 AS at_two, isodow(t) <= 5 AND hour(t) BETWEEN 9 AND 18 AND minute(t) = 0 AS office FROM generate_series(TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-08', INTERVAL 20 MINUTE) AS g(t)")
def cron(spark: SparkSession, sf: str) -> DataFrame:
    start, rows = dt.datetime(2026, 1, 1), []
    for k in range(7 * 72 + 1):
        t = start + dt.timedelta(minutes=20 * k)
        rows.append((t.strftime("%Y-%m-%d %H:%M"), due("*/20 * * * *", t), due("0 2 * * *", t), due("0 9-18 * * 1-5", t)))
    return spark.createDataFrame(rows, "at string, every_20 boolean, at_two boolean, office boolean")


@query(values("what, outcome", ("several primaries", "ShapeError"), ("primary only", "ok"), ("all links", "ShapeError"), ("blank condition", "ShapeError"), ("no object", "ShapeError"), ("unknown operator", "ShapeError"), ("id", "ShapeError"), ("mixed", "ShapeError"), ("double id", "Conflict"), ("later step", "ShapeError")))
def write_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/region.parquet")
    e = Engine(spark, {n: Source("memory", frames={"region": rows}) for n in ("default", "b")})
    spec = {**MODELS[0], "relations": {}, "fields": {"name": "string", "meta": {"type": "object", "fields": {"k": "int"}}}}
    at = lambda name, other: {**spec, "name": name, "collection": "region", "location": [{"source": "default", "role": "primary", "database": name}, {"source": "b", "role": other, "database": name}]}
    e.register(spec, at("Two", "primary"), at("Copied", "replica"))
    w, every = Writer(e, now=lambda: 1), Writer(e, links="all")
    return outcomes(spark, {
        "several primaries": lambda: w.insert("Two", {"_id": 90, "name": "x"}),
        "primary only": lambda: w.insert("Copied", {"_id": 90, "name": "x"}),
        "all links": lambda: every.insert("Copied", {"_id": 91, "name": "x"}),
        "blank condition": lambda: w.update_many("Region", {"$and": []}, {"name": "x"}),
        "no object": lambda: w.update_many("Region", {"_id": 1}, {"meta": 5}),
        "unknown operator": lambda: w.update_many("Region", {"_id": 1}, {"$push": {"name": "x"}}),
        "id": lambda: w.update_many("Region", {"_id": 1}, {"_id": 7}),
        "mixed": lambda: w.update_many("Region", {"_id": 1}, {"$set": {"name": "x"}, "name": "y"}),
        "double id": lambda: w.insert_many("Region", [{"_id": 95, "name": "x"}, {"_id": 95, "name": "y"}]),
        "later step": lambda: w.mutation("Region", {"_id": 96, "name": "{{step.4._id}}"}),
    })


# policies


@query(values("who, reads, owned", ("clerk", True, False), ("boss", True, False), ("guest", False, False), ("maker", True, True), ("internal", True, False)))
def policy_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Who reads models for clerks, for creators and for none; bosses are exempt."""
    e = engine(spark, sf, Policy(exempt_roles=("boss",), closed=True))
    e.register({**MODELS[0], "name": "Clerks", "relations": {}, "read": ["clerk"], "location": {"database": "./."}}, {**MODELS[0], "name": "Makers", "relations": {}, "read": ["creator", "clerk"], "ownerKey": "name", "location": {"database": "././."}})
    who = {"clerk": {"roles": ["clerk"]}, "boss": {"roles": ["boss"]}, "guest": {"roles": ["guest"]}, "maker": {"userId": "u", "roles": ["maker"]}, "internal": {"internal": True}}
    rows = []
    for name, given in who.items():
        ctx = Context.of(given)
        model = e.registry["Makers" if name == "maker" else "Clerks"]
        rows.append((name, e.policy.can_read(model, ctx), e.policy.owner_only(model, ctx)))
    return spark.createDataFrame(rows, "who string, reads boolean, owned boolean")


@query("SELECT o_orderkey AS _id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS totalPrice FROM orders")
def policy_owner_field(spark: SparkSession, sf: str) -> DataFrame:
    """A field that only its creator may read, row by row."""
    e = Engine(spark, Source("parquet", sf))
    e.register({**MODELS[5], "computes": {}, "relations": {}, "ownerKey": "status", "fields": {**MODELS[5]["fields"], "totalPrice": {"type": "double", "read": ["creator"]}}})
    return e.query("Order{ status, totalPrice }", {}, {"userId": "P", "roles": ["clerk"]})


@query(values("what, outcome", ("no context", "NoContext"), ("deny read", "PermissionDenied"), ("wrong role", "PermissionDenied"), ("right role", "ok"), ("deny write role", "PermissionDenied"), ("write role", "PermissionDenied"), ("define", "PermissionDenied"), ("define as admin", "ok"), ("hidden relation", "PermissionDenied"), ("hidden group key", "PermissionDenied"), ("no list", "PermissionDenied"), ("raw sql", "ProfileBlocked")))
def policy_gates(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark, Source("parquet", sf), Policy(require_context=True, deny_write_roles=("guest",), define_roles=("admin",)))
    admin, ctx = {"roles": ["admin"]}, {"userId": "u", "roles": ["clerk"]}
    region = {**MODELS[0], "relations": {}}
    place = iter("./" * k + "." for k in range(1, 9))
    other = lambda name, **more: {**region, "name": name, "location": {"database": next(place)}, **more}
    e.register(region, other("Denied", denyRead=True), other("Bosses", read=["boss"], write=["boss"]), other("Clerks", read=["clerk"]), other("Listed", accessKeys={"name": {"list": "names"}}), other("Keyed", fields={"name": {"type": "string", "read": ["boss"]}}), {**MODELS[1], "relations": {"region": {**MODELS[1]["relations"]["region"], "read": ["boss"]}}}, ctx=admin)
    w = Writer(e, now=lambda: 1)
    return outcomes(spark, {
        "no context": lambda: e.query("Region{ name }"),
        "deny read": lambda: e.query("Denied{ name }", {}, ctx),
        "wrong role": lambda: e.query("Bosses{ name }", {}, ctx),
        "right role": lambda: e.query("Clerks{ name }", {}, ctx),
        "deny write role": lambda: w.insert("Region", {"_id": 9}, {"roles": ["guest"]}),
        "write role": lambda: w.insert("Bosses", {"_id": 9}, ctx),
        "define": lambda: e.register(other("Late"), ctx=ctx),
        "define as admin": lambda: e.register(other("Late"), ctx=admin),
        "hidden relation": lambda: e.query("Nation{ region{ name } }", {}, ctx),
        "hidden group key": lambda: e.query("Keyed($group:@g){ name }", {"g": {"by": ["name"]}}, ctx),
        "no list": lambda: e.query("Listed{ name }", {}, ctx),
        "raw sql": lambda: e.sql("SELECT 1", {}, ctx),
    })


# what is rejected


@query(values("what, outcome", ("pipeline clause", "ParseError"), ("nested pipeline", "ParseError"), ("unknown clause", "ParseError"), ("trailing text", "ParseError"), ("open brace", "ParseError"), ("unknown relation", "NotFound"), ("unknown model", "NotFound"), ("unknown field", "ShapeError"), ("deep", "ShapeError"), ("deep page", "ShapeError"), ("where", "ShapeError"), ("function", "ShapeError"), ("empty or", "ShapeError"), ("unknown operator", "ShapeError"), ("mixed operators", "ShapeError"), ("bad segment", "ShapeError"), ("array place", "ShapeError"), ("look-around", "ShapeError"), ("group and relation", "ShapeError"), ("having alone", "ShapeError"), ("unknown accumulator", "ShapeError"), ("group selection", "ShapeError"), ("relation predicate depth", "ShapeError"), ("unmappable sort", "ShapeError"), ("negative limit", "ShapeError"), ("near and sort", "ShapeError"), ("near below or", "ShapeError"), ("near twice", "ShapeError"), ("near length", "ShapeError"), ("score alone", "ShapeError"), ("out stage", "ShapeError"), ("merge stage", "ShapeError"), ("unknown stage", "ShapeError"), ("two keys", "ShapeError"), ("facet in facet", "ShapeError"), ("unknown expression", "ShapeError"), ("unknown variable", "ShapeError"), ("sql write", "ShapeError"), ("sql unused", "ShapeError"), ("good query", "ok")))
def rejections(spark: SparkSession, sf: str) -> DataFrame:
    e = made(spark, sf)
    ask_ = lambda gql, **p: lambda: e.query(gql, p)
    when = lambda c, m="Order": ask_(f"{m}($condition:@c){{ _id }}", c=c)
    agg = lambda *p: lambda: e.command({"kind": "aggregate", "collection": "orders", "pipeline": list(p)})
    near = {"embedding": {"$near": {"$vector": PROBE, "$limit": 3}}}
    deep = "Order{ customer{ orders{ customer{ orders{ customer{ orders{ customer{ orders{ customer{ orders{ status } } } } } } } } } } }"
    return outcomes(spark, {
        "pipeline clause": ask_("Order($pipeline:@p){ _id }", p=[]), "nested pipeline": ask_("Order{ items($pipeline:@p){ _id } }", p=[]), "unknown clause": ask_("Order($top:@p){ _id }", p=1), "trailing text": ask_("Order{ _id } x"), "open brace": ask_("Order{ _id"),
        "unknown relation": ask_("Order{ nope{ a } }"), "unknown model": ask_("Nope{ a }"), "unknown field": ask_("Order{ nope }"),
        "deep": ask_(deep), "deep page": ask_("Customer{ orders{ customer{ orders{ customer($limit:@l){ name } } } } }", l=1),
        "where": when({"$where": "1"}), "function": when({"$expr": {"$function": {}}}), "empty or": when({"$or": []}), "unknown operator": when({"status": {"$like": "x"}}), "mixed operators": when({"status": {"$eq": "x", "y": 1}}), "bad segment": when({"sta tus": 1}), "array place": when({"items.0": 1}, "Boxed"), "look-around": when({"status": {"$regex": "(?=x)"}}),
        "group and relation": ask_("Order($condition:@c,$group:@g){ status }", c={"items": {"$exists": True}}, g={"by": ["status"]}), "having alone": ask_("Order($having:@h){ status }", h={"n": 1}), "unknown accumulator": ask_("Order($group:@g){ n }", g={"agg": {"n": {"$push": "status"}}}), "group selection": ask_("Order($group:@g){ totalPrice }", g={"by": ["status"]}),
        "relation predicate depth": when({"orders": {"items": {"part": {"size": 1}}}}, "Customer"), "unmappable sort": ask_("Order($sort:@s){ _id }", s={"nope": 1}), "negative limit": ask_("Order($limit:@l){ _id }", l=-1),
        "near and sort": ask_("Embedding($condition:@c,$sort:@s){ _id }", c=near, s={"label": 1}), "near below or": when({"$or": [near]}, "Embedding"), "near twice": when({"$and": [near, near]}, "Embedding"), "near length": when({"embedding": {"$near": {"$vector": [1.0], "$limit": 3}}}, "Embedding"), "score alone": ask_("Embedding{ _score }"),
        "out stage": agg({"$out": "x"}), "merge stage": agg({"$merge": "x"}), "unknown stage": agg({"$bucket": {}}), "two keys": agg({"$match": {}, "$limit": 1}), "facet in facet": agg({"$facet": {"a": [{"$facet": {}}]}}), "unknown expression": agg({"$project": {"x": {"$pow": [1, 2]}}}), "unknown variable": agg({"$project": {"x": "$$nope"}}),
        "sql write": lambda: e.sql("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"), "sql unused": lambda: e.sql("SELECT 1", {"a": 1}), "good query": ask_("Order{ status }"),
    })


@query(values("what, outcome", ("no context", "NoContext"), ("route", "ProfileBlocked"), ("array condition", "ProfileBlocked"), ("nested condition", "ProfileBlocked"), ("condition below or", "ProfileBlocked"), ("condition of a relation", "ProfileBlocked"), ("object sort", "ProfileBlocked"), ("relation sort", "ok"), ("deep", "ShapeError"), ("claim", "ProfileBlocked"), ("triggers", "ProfileBlocked"), ("raw sql", "ProfileBlocked"), ("plain", "ok")))
def text_profile(spark: SparkSession, sf: str) -> DataFrame:
    e, ctx = engine(spark, sf, profile="text2query"), {"internal": True}
    w = Writer(e, now=lambda: 1)
    return outcomes(spark, {
        "no context": lambda: e.query("Order{ status }"),
        "route": lambda: e.query("Order{ status }", {}, ctx, route={"database": "x"}),
        "array condition": lambda: e.query("Tagged($condition:@c){ _id }", {"c": {"words": "x"}}, ctx),
        "nested condition": lambda: e.query("Event($condition:@c){ _id }", {"c": {"props.k": 1}}, ctx),
        "condition below or": lambda: e.query("Event($condition:@c){ _id }", {"c": {"$or": [{"value": 1}, {"props.k": 1}]}}, ctx),
        "condition of a relation": lambda: e.query("Customer{ events($condition:@c){ value } }", {"c": {"props": {"k": 1}}}, ctx),
        "object sort": lambda: e.query("Event($sort:@s){ _id }", {"s": {"props.k": 1}}, ctx),
        "relation sort": lambda: e.query("Order($sort:@s){ _id }", {"s": {"customer.name": 1}}, ctx),
        "deep": lambda: e.query("Region{ nations{ customers{ orders{ items{ quantity } } } } }", {}, ctx),
        "claim": lambda: w.claim("Region", {"_id": 1}, {"name": "x"}, ctx),
        "triggers": lambda: e.register({"name": "T", "fields": {"a": "string"}, "triggers": {"insert": [{"fnRef": "f"}]}}),
        "raw sql": lambda: e.sql("SELECT 1", {}, ctx),
        "plain": lambda: e.query("Order{ status }", {}, ctx),
    })


@query("SELECT o_orderkey AS _id, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 1000")
def text_profile_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The text profile's own limit."""
    return engine(spark, sf, profile="text2query").query("Order{ status }", {}, {"userId": "u"})


@query(values("error, code", ("PermissionDenied", "permission_denied"), ("NoContext", "no_context"), ("ProfileBlocked", "profile_blocked"), ("NotFound", "not_found"), ("ShapeError", "other"), ("ParseError", "other"), ("Conflict", "other")))
def error_codes(spark: SparkSession, sf: str) -> DataFrame:
    from treeq import errors

    kinds = [errors.PermissionDenied, errors.NoContext, errors.ProfileBlocked, errors.NotFound, errors.ShapeError, errors.ParseError, errors.Conflict]
    return spark.createDataFrame([(k.__name__, public_code(k("x"))) for k in kinds], "error string, code string")


@query(values("text, kind", ("select 1", "read"), ("with a as (select 1) select 1", "read"), ("with a as (select 1) delete from t", "write"), ("insert into t values (1)", "write"), ("/* select */ drop table t", "write"), ("(select 1) union (select 2)", "read"), ("explain select 1", "read")))
def sql_kinds(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["select 1", "with a as (select 1) select 1", "with a as (select 1) delete from t", "insert into t values (1)", "/* select */ drop table t", "(select 1) union (select 2)", "explain select 1"]
    return spark.createDataFrame([(t, statement(t)) for t in texts], "text string, kind string")


# federation and addresses


@query(values("query, source, models", ("orders", "a", "User,Order"), ("lines", "b", "Order,Line"), ("all", "a", "User"), ("all", "b", "Order,Line")))
def federated_links(spark: SparkSession, sf: str) -> DataFrame:
    """Which sources a query's models are read from: few sources first, then relations within one."""
    e = Engine(spark, {"a": Source("memory"), "b": Source("memory")})
    user = _model("User", "users", {}, {"name": "string"}, relations={"orders": {"model": "Order", "type": "many", "foreignField": "userId"}}, location={"source": "a"})
    order = _model("Order", "orders", {}, {"userId": "long"}, relations={"lines": {"model": "Line", "type": "many", "foreignField": "orderId"}}, location=[{"source": "b", "role": "primary"}, {"source": "a", "role": "replica"}])
    e.register(user, order, _model("Line", "lines", {}, {"orderId": "long"}, location={"source": "b"}))
    asked = {"orders": "User{ orders{ userId } }", "lines": "Order{ lines{ orderId } }", "all": "User{ orders{ lines{ orderId } } }"}
    return spark.createDataFrame([(n, s, ",".join(m)) for n, q in asked.items() for s, m in e.federated_plan(q).units.items()], "query string, source string, models string")


@query("SELECT r_name AS name, substr(md5(r_name), 1, 2) || '/' || substr(md5(r_name), 3, 2) || '/' || md5(r_name) || '.png' AS path, 'http://files/a/' || substr(md5(r_name), 1, 2) || '/' || substr(md5(r_name), 3, 2) || '/' || md5(r_name) || '.png' AS url FROM region")
def resource_paths(spark: SparkSession, sf: str) -> DataFrame:
    names = [r.r_name for r in spark.read.parquet(f"{sf}/region.parquet").collect()]
    paths = {n: content_path(hashlib.md5(n.encode()).hexdigest(), "png") for n in names}  # noqa: S324
    return spark.createDataFrame([(n, p, resource_url("http://files/a/", f"/{p}")) for n, p in paths.items()], "name string, path string, url string")
