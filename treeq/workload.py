"""Models over the test tables, and the named queries that __spark_entry__ registers.

Results are flat: nested documents are exploded or aggregated, so that they can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.engine import Engine
from treeq.operators.writes import Writer
from treeq.policy import Policy
from treeq.sources.registry import Source

Query = Callable[[SparkSession, str], DataFrame]


def _model(name: str, collection: str, physical: dict, fields: dict, id_type: str = "long", **rest: object) -> dict:
    return {"name": name, "collection": collection, "idType": id_type, "fields": fields, "physical": physical, "timestamps": False, "archive": False, **rest}


MODELS = [
    _model("Region", "region", {"_id": "r_regionkey", "name": "r_name"}, {"name": "string"}, "int", relations={"nations": {"model": "Nation", "type": "many", "foreignField": "regionId"}}),
    _model("Nation", "nation", {"_id": "n_nationkey", "name": "n_name", "regionId": "n_regionkey"}, {"name": "string", "regionId": "int"}, "int", relations={"region": {"model": "Region", "type": "one", "localField": "regionId", "foreignField": "_id"}, "customers": {"model": "Customer", "type": "many", "foreignField": "nationId"}}),
    _model(
        "Customer",
        "customer",
        {"_id": "c_custkey", "name": "c_name", "nationId": "c_nationkey", "acctBal": "c_acctbal", "mktSegment": "c_mktsegment"},
        {"name": "string", "nationId": "int", "acctBal": "double", "mktSegment": "string"},
        relations={"nation": {"model": "Nation", "type": "one", "localField": "nationId", "foreignField": "_id"}, "orders": {"model": "Order", "type": "many", "foreignField": "custId"}, "events": {"model": "Event", "type": "many", "foreignField": "userId"}},
        computes={"orderCount": {"agg": {"$count": "orders"}}, "maxOrder": {"agg": {"$max": "orders.totalPrice"}}, "orderTotal": {"agg": {"$sum": "orders.totalPrice"}}, "rich": {"fn": "rich", "depends": ["acctBal"], "type": "boolean"}},
    ),
    _model("Supplier", "supplier", {"_id": "s_suppkey", "name": "s_name", "nationId": "s_nationkey", "acctBal": "s_acctbal"}, {"name": "string", "nationId": "int", "acctBal": "double"}, relations={"nation": {"model": "Nation", "type": "one", "localField": "nationId", "foreignField": "_id"}}),
    _model("Part", "part", {"_id": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailPrice": "p_retailprice"}, {"name": "string", "brand": "string", "type": "string", "size": "int", "retailPrice": "double"}, relations={"items": {"model": "LineItem", "type": "many", "foreignField": "partId"}}),
    _model(
        "Order",
        "orders",
        {"_id": "o_orderkey", "custId": "o_custkey", "status": "o_orderstatus", "totalPrice": "o_totalprice", "orderDate": "o_orderdate", "priority": "o_orderpriority"},
        {"custId": "long", "status": "string", "totalPrice": "double", "orderDate": "date", "priority": "string"},
        relations={"customer": {"model": "Customer", "type": "one", "localField": "custId", "foreignField": "_id"}, "items": {"model": "LineItem", "type": "many", "foreignField": "orderId"}},
        computes={"itemCount": {"agg": {"$count": "items"}}, "avgQuantity": {"agg": {"$avg": "items.quantity"}}},
    ),
    _model(
        "LineItem",
        "lineitem",
        {"_id": "= concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)", "orderId": "l_orderkey", "partId": "l_partkey", "suppId": "l_suppkey", "lineNumber": "l_linenumber", "quantity": "l_quantity", "extendedPrice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnFlag": "l_returnflag", "lineStatus": "l_linestatus", "shipDate": "l_shipdate"},
        {"orderId": "long", "partId": "long", "suppId": "long", "lineNumber": "int", "quantity": "double", "extendedPrice": "double", "discount": "double", "tax": "double", "returnFlag": "string", "lineStatus": "string", "shipDate": "date"},
        "string",
        relations={"order": {"model": "Order", "type": "one", "localField": "orderId", "foreignField": "_id"}, "part": {"model": "Part", "type": "one", "localField": "partId", "foreignField": "_id"}, "supplier": {"model": "Supplier", "type": "one", "localField": "suppId", "foreignField": "_id"}},
        computes={"netPrice": {"fn": "netPrice", "depends": ["extendedPrice", "discount"]}, "taxed": {"asyncFn": "taxed", "depends": ["extendedPrice", "tax"]}},
    ),
    _model("Event", "events", {"_id": "event_id", "eventType": "event_type", "userId": "user_id", "props": "= from_json(props, 'k INT')"}, {"ts": "date", "userId": "long", "eventType": "string", "value": "double", "props": {"type": "object", "fields": {"k": "int"}}}, relations={"user": {"model": "Customer", "type": "one", "localField": "userId", "foreignField": "_id"}}),
    _model("Embedding", "embeddings", {"_id": "vec_id"}, {"embedding": {"type": "vector", "dim": 64}, "label": "int"}, computes={"size": {"fn": "size", "depends": ["embedding"], "type": "int"}}),
    _model("EmbeddingL2", "embeddings", {"_id": "vec_id"}, {"embedding": {"type": "vector", "dim": 64, "metric": "l2"}, "label": "int"}, location={"database": "."}),
    _model("EmbeddingIp", "embeddings", {"_id": "vec_id"}, {"embedding": {"type": "vector", "dim": 64, "metric": "ip"}, "label": "int"}, location={"database": "./."}),
    # Arrays made of what the tables have, for what needs an array field.
    _model("Tagged", "part", {"_id": "p_partkey", "words": "= split(p_type, ' ')", "others": "= array(p_partkey + 1, p_partkey + 2, p_partkey + 1)", "sizes": "= array(p_size, p_size, p_size % 7)", "none": "= filter(array(p_size), x -> x > 40)"}, {"words": {"type": "array", "items": "string"}, "others": {"type": "array", "items": "long"}, "sizes": {"type": "array", "items": "int"}, "none": {"type": "array", "items": "int"}}, relations={"parts": {"model": "Part", "type": "many", "localField": "others", "foreignField": "_id"}}, computes={"wordCount": {"agg": {"$size": "words"}}, "sizeSum": {"agg": {"$sum": "sizes"}}, "sizeKinds": {"agg": {"$countDistinct": "sizes"}}, "sizeMax": {"agg": {"$max": "sizes"}}, "noneAvg": {"agg": {"$avg": "none"}}}, location={"database": "././."}),
    _model("Document", "documents", {"_id": "doc_id", "nChars": "n_chars"}, {"text": "string", "lang": "string", "source": "string", "nChars": "long"}, relations={"label": {"model": "Label", "type": "one", "foreignField": "_id"}}),
    _model("Label", "labels", {"_id": "doc_id"}, {"quality": "int", "toxic": "int"}),
]
OWNED = {**MODELS[5], "name": "OwnOrder", "read": ["manager", "creator"], "ownerKey": "status", "computes": {}, "relations": {}, "location": {"database": "././././."}}


def engine(spark: SparkSession, sf_dir: str, policy: Policy | None = None, **options: object) -> Engine:
    e = Engine(spark, Source("parquet", sf_dir), policy, **options)
    e.register(*MODELS, OWNED)
    e.set_fn("netPrice", lambda price, discount: price * (1 - discount), column=True)
    e.set_fn("rich", lambda doc: doc["acctBal"] > 5000)
    e.set_fn("size", F.size, column=True)
    e.set_async_fn("taxed", lambda rows: rows["extendedPrice"] * (1 + rows["tax"]))
    return e


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def ask(spark: SparkSession, sf_dir: str, gql: str, **params: object) -> DataFrame:
    return engine(spark, sf_dir).query(gql, params)


# conditions


@query("SELECT o_orderkey AS _id, o_totalprice AS totalPrice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice < 300000")
def filter_eq_range(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($condition:@c){ totalPrice }", c={"status": "F", "totalPrice": {"$gte": 100000, "$lt": 300000}})


@query("SELECT o_orderkey AS _id, o_orderstatus AS status FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH') AND NOT (o_totalprice < 1000)")
def filter_or_nor_not(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($condition:@c){ status }", c={"$or": [{"status": "F"}, {"totalPrice": {"$gt": 400000}}], "$nor": [{"priority": "1-URGENT"}, {"priority": "2-HIGH"}], "totalPrice": {"$not": {"$lt": 1000}}})


@query("SELECT c_custkey AS _id, c_mktsegment AS mktSegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in_nin(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($condition:@c){ mktSegment }", c={"mktSegment": {"$in": ["BUILDING", "MACHINERY"]}, "nationId": {"$nin": [1, 2, 3]}})


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_custkey IS NOT NULL")
def filter_ne_null_exists(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($condition:@c,$group:@g){ n }", c={"status": {"$ne": "F"}, "custId": {"$ne": None, "$exists": True}}, g={"agg": {"n": {"$count": "*"}}})


@query("SELECT p_partkey AS _id, p_name AS name FROM part WHERE regexp_matches(p_name, '^SMALL .*(G|T)$', 'i')")
def filter_regex_flags(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Part($condition:@c){ name }", c={"name": {"$regex": "^SMALL .*(G|T)$", "$options": "i"}})


@query("SELECT vec_id AS _id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35)) > 0")
def filter_array_any(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Embedding($condition:@c){ _id }", c={"embedding": {"$gt": 0.35}})


@query("SELECT p_partkey AS _id FROM part WHERE list_contains(string_split(p_type, ' '), 'ECONOMY') AND list_has_any([p_size, p_size % 7], [3, 5])")
def filter_array_in(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Tagged($condition:@c){ _id }", c={"words": "ECONOMY", "sizes": {"$in": [3, 5]}})


@query("SELECT event_id AS _id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 10 AND 20")
def filter_object_path(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Event($condition:@c){ props{k} }", c={"props.k": {"$gte": 10, "$lte": 20}}).select("_id", F.col("props.k").alias("k"))


@query("SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F') = (o_orderpriority = '5-LOW')")
def filter_expr(spark: SparkSession, sf: str) -> DataFrame:
    c = {"$expr": {"$eq": [{"$eq": ["$status", "F"]}, {"$eq": ["$priority", "5-LOW"]}]}}
    return ask(spark, sf, "Order($condition:@c,$group:@g){ n }", c=c, g={"agg": {"n": {"$count": "*"}}})


# projections, sorting, paging


@query("SELECT event_id AS _id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type = 'click' THEN 'c' ELSE 'o' END AS short FROM events")
def project_rename_nested(spark: SparkSession, sf: str) -> DataFrame:
    command = {"kind": "aggregate", "collection": "events", "pipeline": [{"$addFields": {"short": {"$cond": [{"$eq": ["$eventType", "click"]}, "c", "o"]}}}, {"$project": {"kind": "$eventType", "k": "$props.k", "short": 1}}]}
    return engine(spark, sf).command(command)


@query("SELECT c_custkey AS _id, c_acctbal AS acctBal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def sort_skip_limit(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($sort:@s,$skip:@k,$limit:@l){ acctBal }", s={"nationId": 1, "acctBal": -1}, k=50, l=25)


@query("SELECT c_custkey AS _id, c_name AS name, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 20 OFFSET 20")
def page_with_count(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).query_with_count("Customer($condition:@c,$sort:@s){ name }", {"c": {"acctBal": {"$gt": 0}}, "s": {"name": 1}, "page": 2, "pageSize": 20}).with_total()


@query("SELECT o_orderkey AS _id, o_status AS status FROM (SELECT o_orderkey, o_orderstatus AS o_status FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 1)")
def query_one(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).query_one("Order($condition:@c){ status }", {"c": {"totalPrice": {"$gt": 1000}}})


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def count_documents(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).command({"kind": "countDocuments", "collection": "customer", "filter": {"mktSegment": "BUILDING"}})


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < -900) AS yes, EXISTS (SELECT 1 FROM customer WHERE c_acctbal < -90000) AS no")
def exists(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    some = lambda least: e.exists("Customer", {"acctBal": {"$lt": least}})
    return spark.createDataFrame([(some(-900), some(-90000))], "yes boolean, no boolean")


@query("SELECT event_id AS _id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events ORDER BY 2 DESC NULLS LAST, event_id LIMIT 30")
def sort_object_path(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Event($sort:@s,$limit:@l){ props{ k } }", s=[["props.k", -1]], l=30).select("_id", F.col("props.k").alias("k"))


@query("SELECT p_partkey AS _id, p_name AS name, p_size AS size FROM part")
def project_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).command({"kind": "find", "collection": "Part", "projection": {"brand": 0, "type": 0, "retailPrice": 0}})


@query("SELECT p_partkey AS _id, array_to_string([p_size, p_size % 7], ',') AS parts, array_to_string(list_sort(list_distinct([p_size, p_size % 7, 1])), ',') AS united, (p_size + p_size % 7)::BIGINT AS total, p_size % 7 AS last, CASE WHEN p_size > 40 THEN p_size::VARCHAR ELSE '' END AS big FROM part")
def array_expressions(spark: SparkSession, sf: str) -> DataFrame:
    both = {"$setUnion": [["$size"], ["$rest"], [1]]}
    p = [{"$addFields": {"rest": {"$arrayElemAt": ["$sizes", -1]}, "size": {"$arrayElemAt": ["$sizes", 0]}}}, {"$project": {"parts": ["$size", "$rest"], "united": both, "total": {"$sum": ["$size", "$rest"]}, "last": "$rest", "big": "$none"}}]
    df = engine(spark, sf).command({"kind": "aggregate", "collection": "Tagged", "pipeline": p})
    return df.withColumns({c: F.array_join(F.sort_array(c) if c == "united" else F.col(c), ",") for c in ("parts", "united", "big")})


# groups


@query("SELECT l_returnflag AS returnFlag, l_linestatus AS lineStatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY ALL")
def group_multi_agg(spark: SparkSession, sf: str) -> DataFrame:
    g = {"by": ["returnFlag", "lineStatus"], "agg": {"n": {"$count": "*"}, "quantity": {"$sum": "quantity"}, "price": {"$avg": "extendedPrice"}, "least": {"$min": "discount"}, "most": {"$max": "tax"}}}
    return ask(spark, sf, "LineItem($group:@g){ returnFlag, lineStatus, n, quantity, price, least, most }", g=g).withColumns({"quantity": F.round("quantity", 4), "price": F.round("price", 4)})


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1 HAVING count(*) > 10 AND (max(o_totalprice) > 1 OR count(*) < 0) ORDER BY n DESC, priority LIMIT 3")
def group_having_sort(spark: SparkSession, sf: str) -> DataFrame:
    g, h = {"by": ["priority"], "agg": {"n": {"$count": "*"}, "most": {"$max": "totalPrice"}}}, {"n": {"$gt": 10}, "$or": [{"most": {"$gt": 1}}, {"n": {"$lt": 0}}]}
    return ask(spark, sf, "Order($group:@g,$having:@h,$sort:@s,$limit:@l){ priority, n, most }", g=g, h=h, s={"n": -1}, l=3).withColumn("most", F.round("most", 2))


@query("SELECT count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem")
def group_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "LineItem($group:@g){ n, total }", g={"agg": {"n": {"$count": "*"}, "total": {"$sum": "quantity"}}}).withColumn("total", F.round("total", 4))


@query("SELECT count(*) AS n, sum(l_quantity) AS total, count(l_tax) AS taxes FROM lineitem WHERE l_quantity < 0")
def group_all_rows_empty(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "LineItem($condition:@c,$group:@g){ n, total, taxes }", c={"quantity": {"$lt": 0}}, g={"agg": {"n": {"$count": "*"}, "total": {"$sum": "quantity"}, "taxes": {"$count": "tax"}}})


@query("SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def group_by_one_relation(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($group:@g){ customer.mktSegment, status, n }", g={"by": ["customer.mktSegment", "status"], "agg": {"n": {"$count": "*"}}}).select(F.col("customer.mktSegment").alias("segment"), "status", "n")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def group_by_object_path(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Event($group:@g){ props.k, n, total }", g={"by": ["props.k"], "agg": {"n": {"$count": "*"}, "total": {"$sum": "value"}}}).select(F.col("props.k").alias("k"), "n", F.round("total", 4).alias("total"))


# relations


@query("SELECT o_orderkey AS _id, o_orderstatus AS status, l_linenumber AS lineNumber, l_quantity AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 200000")
def rel_many_flat(spark: SparkSession, sf: str) -> DataFrame:
    df = ask(spark, sf, "Order($condition:@c){ status, items{ lineNumber, quantity } }", c={"totalPrice": {"$gt": 200000}})
    return df.select("_id", "status", F.explode_outer("items").alias("i")).select("_id", "status", "i.lineNumber", "i.quantity")


@query("SELECT n_nationkey AS _id, n_name AS name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def rel_one(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Nation{ name, region{ name } }").select("_id", "name", F.col("region.name").alias("region"))


@query("SELECT r_regionkey AS _id, n_name AS nation, count(c_custkey) AS customers, max(c_name) AS last FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def rel_nested(spark: SparkSession, sf: str) -> DataFrame:
    df = ask(spark, sf, "Region{ name, nations{ name, customers{ name } } }").select("_id", F.explode_outer("nations").alias("n"))
    return df.select("_id", F.col("n.name").alias("nation"), F.size("n.customers").cast("long").alias("customers"), F.array_max(F.transform("n.customers", lambda c: c["name"])).alias("last"))


@query("SELECT o_orderkey AS _id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_discount DESC, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)) - 1 AS pos, l_discount AS discount FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.05 WHERE o_orderstatus = 'P'")
def rel_condition_sort(spark: SparkSession, sf: str) -> DataFrame:
    df = ask(spark, sf, "Order($condition:@c){ items($condition:@d,$sort:@s){ discount } }", c={"status": "P"}, d={"discount": {"$gt": 0.05}}, s={"discount": -1})
    return df.select("_id", F.posexplode("items").alias("pos", "i")).select("_id", F.col("pos").cast("long").alias("pos"), "i.discount")


@query("SELECT o_custkey AS _id, o_orderkey AS order_id, o_totalprice AS totalPrice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) BETWEEN 2 AND 3")
def rel_topn_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    df = ask(spark, sf, "Customer{ orders($sort:@s,$skip:@k,$limit:@l){ totalPrice } }", s={"totalPrice": -1}, k=1, l=2)
    return df.select("_id", F.explode("orders").alias("o")).select("_id", F.col("o._id").alias("order_id"), "o.totalPrice")


@query("SELECT t.p_partkey AS _id, p.p_partkey AS other, p.p_name AS name FROM part t JOIN part p ON p.p_partkey IN (t.p_partkey + 1, t.p_partkey + 2)")
def rel_array_local_key(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Tagged{ parts{ name } }").select("_id", F.explode("parts").alias("p")).select("_id", F.col("p._id").alias("other"), "p.name")


@query("SELECT o_orderkey AS _id, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS most FROM orders ORDER BY most DESC NULLS LAST, o_orderkey LIMIT 40")
def root_sort_by_relation(spark: SparkSession, sf: str) -> DataFrame:
    df = ask(spark, sf, "Order($sort:@s,$limit:@l){ items{ quantity } }", s={"items.quantity": -1}, l=40)
    return df.select("_id", F.array_max(F.transform("items", lambda i: i["quantity"])).alias("most"))


@query("SELECT p_partkey AS _id, w FROM part, unnest(string_split(p_type, ' ')) AS u(w)")
def unwind_drop(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).command({"kind": "aggregate", "collection": "Tagged", "pipeline": [{"$unwind": "$words"}, {"$project": {"w": "$words"}}]})


@query("SELECT p_partkey AS _id, CASE WHEN p_size > 40 THEN p_size END AS none FROM part")
def unwind_preserve(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).command({"kind": "aggregate", "collection": "Tagged", "pipeline": [{"$unwind": {"path": "$none", "preserveNullAndEmptyArrays": True}}, {"$project": {"none": 1}}]})


@query("SELECT o_orderkey AS _id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40 WHERE o_orderstatus = 'P' GROUP BY 1")
def lookup_stage(spark: SparkSession, sf: str) -> DataFrame:
    p = [{"$match": {"status": "P"}}, {"$lookup": {"from": "lineitem", "localField": "_id", "foreignField": "orderId", "as": "big", "pipeline": [{"$match": {"quantity": {"$gt": 40}}}]}}, {"$project": {"n": {"$size": "$big"}}}]
    return engine(spark, sf).command({"kind": "aggregate", "collection": "orders", "pipeline": p}).withColumn("n", F.col("n").cast("long"))


# relation predicates


@query("SELECT c_custkey AS _id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey GROUP BY o_custkey HAVING count(*) > 10)")
def semi_count(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($condition:@c){ _id }", c={"orders": {"$count": {"$gt": 10}}})


@query("SELECT o_orderkey AS _id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND o_orderstatus = 'F'")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($condition:@c){ _id }", c={"items": {"$exists": True}, "status": "F"})


@query("SELECT c_custkey AS _id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY o_custkey HAVING sum(o_totalprice) >= 1000000)")
def semi_sum_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($condition:@c){ _id }", c={"orders": {"$filter": {"status": "F"}, "$sum": {"$of": "totalPrice", "$gte": 1000000}}})


@query("SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) > 3 AND max(o_totalprice) >= 200000)")
def semi_main_form(spark: SparkSession, sf: str) -> DataFrame:
    main = {"filter": {"status": {"$ne": "P"}}, "agg": {"n": {"$count": "*"}, "most": {"$max": "totalPrice"}}, "having": {"n": {"$gt": 3}, "most": {"$gte": 200000}}}
    return ask(spark, sf, "Customer($condition:@c){ name }", c={"$and": [{"mktSegment": "BUILDING"}, {"orders": main}]})


@query("SELECT o_orderkey AS _id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_exists(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Order($condition:@c){ _id }", c={"items": {"$exists": False}})


@query("SELECT c_custkey AS _id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey GROUP BY o_custkey HAVING count(*) > 10)")
def anti_not_count(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($condition:@c){ _id }", c={"$not": {"orders": {"$count": {"$gt": 10}}}})


@query("SELECT c_custkey AS _id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def semi_plain_object(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($condition:@c){ _id }", c={"orders": {"priority": "1-URGENT", "totalPrice": {"$gt": 300000}}})


@query("SELECT c_custkey AS _id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50) GROUP BY o_custkey HAVING count(*) >= 2)")
def semi_nested(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($condition:@c){ _id }", c={"orders": {"$filter": {"items.quantity": {"$gte": 50}}, "$count": {"$gte": 2}}})


@query("SELECT c_custkey AS _id FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_or_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer($condition:@c){ _id }", c={"$or": [{"acctBal": {"$lt": 0}}, {"orders": {"totalPrice": {"$gt": 450000}}}]})


# computed columns


@query("SELECT c_custkey AS _id, count(o_orderkey) AS orderCount, max(o_totalprice) AS maxOrder FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def agg_compute_relation(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer{ orderCount, maxOrder }")


@query("SELECT p_partkey AS _id, len(string_split(p_type, ' ')) AS wordCount, (2 * p_size + p_size % 7)::BIGINT AS sizeSum, greatest(p_size, p_size % 7) AS sizeMax, CASE WHEN p_size > 40 THEN p_size::DOUBLE END AS noneAvg FROM part")
def agg_compute_inline(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Tagged{ wordCount, sizeSum, sizeMax, noneAvg }").withColumn("wordCount", F.col("wordCount").cast("long"))


@query("SELECT p_partkey AS _id, CASE WHEN p_size = p_size % 7 THEN 1 ELSE 2 END AS sizeKinds FROM part")
def count_distinct_inline(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Tagged{ sizeKinds }")


@query("SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS _id, round(l_extendedprice * (1 - l_discount), 4) AS netPrice FROM lineitem WHERE l_quantity > 45")
def compute_fn(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "LineItem($condition:@c){ netPrice }", c={"quantity": {"$gt": 45}}).withColumn("netPrice", F.round("netPrice", 4))


@query("SELECT c_custkey AS _id, c_acctbal > 5000 AS rich FROM customer")
def compute_fn_udf(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Customer{ rich }")


@query("SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS _id, round(l_extendedprice * (1 + l_tax), 4) AS taxed FROM lineitem WHERE l_quantity > 45")
def compute_batch(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "LineItem($condition:@c){ taxed }", c={"quantity": {"$gt": 45}}).withColumn("taxed", F.round("taxed", 4))


# vectors

PROBE = [((i * 37) % 64 - 32) / 64 for i in range(64)]
_Q = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


@query(f"SELECT vec_id AS _id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def vector_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "Embedding($condition:@c){ _score }", c={"embedding": {"$near": {"$vector": PROBE, "$limit": 10}}}).select("_id", F.round("_score", 6).alias("score"))


@query(f"SELECT vec_id AS _id, round(1 / (1 + list_distance(embedding::DOUBLE[], {_Q})), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def vector_l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "EmbeddingL2($condition:@c){ _score }", c={"embedding": {"$near": {"$vector": PROBE, "$limit": 10}}}).select("_id", F.round("_score", 6).alias("score"))


@query(f"SELECT vec_id AS _id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def vector_ip_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ask(spark, sf, "EmbeddingIp($condition:@c){ _score }", c={"embedding": {"$near": {"$vector": PROBE, "$limit": 10}}}).select("_id", F.round("_score", 6).alias("score"))


@query(f"SELECT _id, score FROM (SELECT vec_id AS _id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE label IN (0, 1, 2, 3) ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 30) WHERE score >= 0.1 AND NOT (label = 2)")
def vector_prefilter_minscore(spark: SparkSession, sf: str) -> DataFrame:
    c = {"$and": [{"embedding": {"$near": {"$vector": PROBE, "$limit": 30, "$minScore": 0.1}}}, {"label": {"$in": [0, 1, 2, 3]}}, {"label": {"$not": {"$eq": 2}}}]}
    return ask(spark, sf, "Embedding($condition:@c){ _score }", c=c).select("_id", F.round("_score", 6).alias("score"))


# other stages


@query("SELECT 'status' AS branch, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def facet_two_branches(spark: SparkSession, sf: str) -> DataFrame:
    branch = lambda f: [{"$group": {"_id": f"${f}", "n": {"$count": {}}}}]
    df = engine(spark, sf).command({"kind": "aggregate", "collection": "orders", "pipeline": [{"$facet": {"status": branch("status"), "priority": branch("priority")}}]})
    part = lambda b: df.select(F.lit(b).alias("branch"), F.explode(b).alias("x")).select("branch", F.col("x._id").alias("key"), "x.n")
    return part("status").unionByName(part("priority"))


@query("SELECT o_orderkey AS _id, CASE WHEN o_orderstatus = 'F' THEN 'big' ELSE 'small' END AS size, o_orderstatus IN ('F', 'P') AS closed, (o_orderstatus = 'F')::BIGINT AS n, coalesce(nullif(o_orderpriority, ''), 'none') AS priority FROM orders")
def add_fields_cond(spark: SparkSession, sf: str) -> DataFrame:
    closed = {"$filter": {"input": ["$status", "x"], "as": "s", "cond": {"$in": ["$$s", ["F"]]}}}
    p = [{"$addFields": {"closed": {"$in": ["$status", ["F", "P"]]}, "found": closed}}, {"$addFields": {"n": {"$size": "$found"}}}, {"$project": {"size": {"$cond": [{"$eq": ["$n", 1]}, "big", "small"]}, "closed": 1, "n": 1, "priority": {"$ifNull": ["$priority", "none"]}}}]
    return engine(spark, sf).command({"kind": "aggregate", "collection": "orders", "pipeline": p}).withColumn("n", F.col("n").cast("long"))


@query("SELECT event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE value > 50")
def replace_root(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).command({"kind": "aggregate", "collection": "events", "pipeline": [{"$match": {"value": {"$gt": 50}}}, {"$replaceRoot": {"newRoot": {"kind": "$eventType", "k": "$props.k"}}}]})


# policies


@query("SELECT o_orderkey AS _id, o_totalprice AS totalPrice FROM orders WHERE o_orderstatus = 'P'")
def policy_owner_rows(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).query("OwnOrder{ totalPrice }", {}, {"userId": "P", "roles": ["clerk"]})


@query("SELECT c_custkey AS _id, c_mktsegment AS mktSegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def policy_rbac_or(spark: SparkSession, sf: str) -> DataFrame:
    grant = lambda **c: {"role": "sales", "model": "Customer", "actions": ["read"], "readFields": ["mktSegment"], "condition": c}
    policy = Policy(rbac={"mode": "enforce", "managedRoles": ["sales"], "grants": [grant(mktSegment="BUILDING"), grant(nationId=3)]})
    return engine(spark, sf, policy).query("Customer{ mktSegment, acctBal }", {}, {"userId": "u", "roles": ["sales"]})


@query("SELECT n_nationkey AS _id, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1")
def policy_access_keys(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.register({**MODELS[2], "accessKeys": {"mktSegment": {"list": "segments"}}})
    return e.query("Nation{ customers{ _id } }", {}, {"userId": "u", "segments": ["BUILDING", "FURNITURE"]}).select("_id", F.size("customers").cast("long").alias("n"))


# writes, on copies in memory


def _memory(spark: SparkSession, sf: str, *collections: str) -> tuple[Engine, Writer]:
    frames = {c: spark.read.parquet(f"{sf}/{c}.parquet") for c in collections}
    e = Engine(spark, Source("memory", frames=frames))
    e.register(*({**m, "archive": m["name"] == "Order"} for m in MODELS if m["collection"] in collections and m["name"] not in ("Tagged", "LineItem", "EmbeddingL2", "EmbeddingIp")))
    return e, Writer(e, now=lambda: 1_700_000_000_000)


@query("SELECT c_custkey AS _id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS mktSegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS acctBal FROM customer")
def update_set_inc(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "customer")
    w.update_many("Customer", {"mktSegment": "BUILDING"}, {"$set": {"mktSegment": "HOUSES"}, "$inc": {"acctBal": 100}})
    return e.table("Customer").select("_id", "mktSegment", "acctBal")


@query("SELECT r_regionkey AS _id, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END AS name FROM region UNION ALL SELECT 77, 'ADDED'")
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "region")
    w.upsert("Region", {"_id": 1}, {"name": "NEW"})
    w.upsert("Region", {"_id": 77}, {"name": "ADDED"})
    return e.table("Region")


@query("SELECT o_orderkey AS _id, 'kept' AS place FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'archive' FROM orders WHERE o_orderstatus = 'P'")
def delete_archive(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "orders")
    w.remove("Order", {"status": "P"})
    return e.table("Order").select("_id", F.lit("kept").alias("place")).unionByName(e.table("OrderDeleted").select("_id", F.lit("archive").alias("place")))


@query("SELECT r_regionkey AS _id, r_name AS name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 2, 'REPLACED' UNION ALL SELECT 90, 'X'")
def insert_many_replace(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "region")
    w.insert_many("Region", [{"_id": 2, "name": "REPLACED"}, {"_id": 90, "name": "X"}], upsert_by_id=True)
    return e.table("Region")


@query("SELECT r_regionkey AS _id, CASE WHEN r_regionkey IN (SELECT r_regionkey FROM region ORDER BY r_name DESC LIMIT 2) THEN 'TAKEN' ELSE r_name END AS name FROM region")
def claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "region")
    w.claim("Region", {"_id": {"$gte": 0}}, {"name": "TAKEN"}, sort={"name": -1}, limit=2)
    return e.table("Region")


@query("SELECT n_nationkey AS _id, CASE WHEN n_regionkey = 1 AND n_nationkey < 10 THEN 'SET' ELSE n_name END AS name, n_regionkey AS regionId FROM nation")
def compare_and_set(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "nation")
    w.compare_and_set("Nation", {"_id": {"$lt": 10}}, {"regionId": 1}, {"name": "SET"})
    return e.table("Nation")


@query("SELECT n_nationkey AS _id, n_name AS name, n_regionkey AS regionId FROM nation UNION ALL SELECT 100, 'N1', 50 UNION ALL SELECT 101, 'N2', 50")
def mutation_nested(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "region", "nation")
    w.mutation("Region", {"_id": 50, "name": "NEW", "nations": [{"_id": 100, "name": "N1"}, {"_id": 101, "name": "N2"}]})
    return e.table("Nation")


@query("SELECT c_custkey AS _id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def delete_by_relation(spark: SparkSession, sf: str) -> DataFrame:
    e, w = _memory(spark, sf, "customer", "orders")
    w.delete_many("Customer", {"orders": {"totalPrice": {"$gt": 450000}}})
    return e.table("Customer").select("_id", "name")


# SQL and federation


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def raw_sql_named(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).sql("SELECT status, count(*) AS n FROM Order WHERE totalPrice > :least GROUP BY status", {"least": 150000})


@query("SELECT o_orderkey AS _id, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def federated_join(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark, {"default": Source("parquet", sf), "crm": Source("memory", frames={"customer": spark.read.parquet(f"{sf}/customer.parquet")})})
    e.register(*({**m, "location": {"source": "crm"}} if m["name"] == "Customer" else m for m in MODELS if m["name"] in ("Customer", "Order")))
    return e.federated("Order($condition:@c){ customer{ name } }", {"c": {"status": "P"}}).select("_id", F.col("customer.name").alias("customer"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Finished orders of a least price, the dearest first, with their items."""
    return ask(spark, sf, "Order($condition:@c,$sort:@s,$limit:@l){ status, totalPrice, items{ lineNumber, quantity } }", c={"status": "F", "totalPrice": {"$gte": 1000}}, s={"totalPrice": -1, "_id": 1}, l=20)
