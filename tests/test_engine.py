from __future__ import annotations

import pytest

from treeq.engine import Engine
from treeq.errors import EngineError, NoContext, NotFound, PermissionDenied, ProfileBlocked, ShapeError
from treeq.policy import Policy
from treeq.schema import Location, schema_of
from treeq.sources.registry import Source

USER = {"name": "User", "collection": "users", "idType": "int", "timestamps": False, "archive": False, "fields": {"name": "string", "age": "int", "tags": {"type": "array", "items": "string"}, "meta": {"type": "object", "fields": {"x": "int", "y": "string"}}, "friendIds": {"type": "array", "items": "int"}, "secret": {"type": "string", "read": ["admin"]}}, "relations": {"orders": {"model": "Order", "type": "many", "foreignField": "userId"}, "friends": {"model": "User", "type": "many", "localField": "friendIds", "foreignField": "_id"}, "hidden": {"model": "Order", "type": "many", "foreignField": "userId", "read": ["admin"]}}, "computes": {"n": {"agg": {"$count": "orders"}}, "spent": {"agg": {"$sum": "orders.amount"}}, "tagCount": {"agg": {"$size": "tags"}}, "double": {"fn": "double", "depends": ["age"], "type": "int"}, "upper": {"asyncFn": "upper", "depends": ["name"], "type": "string"}}}
ORDER = {"name": "Order", "collection": "orders", "idType": "int", "timestamps": False, "archive": False, "fields": {"userId": "int", "amount": "double", "status": "string"}, "relations": {"user": {"model": "User", "type": "one", "localField": "userId", "foreignField": "_id"}, "lines": {"model": "Line", "type": "many", "foreignField": "orderId"}}}
LINE = {"name": "Line", "collection": "lines", "idType": "int", "timestamps": False, "archive": False, "fields": {"orderId": "int", "qty": "int"}}


@pytest.fixture(scope="module")
def frames(spark):  # noqa: ANN001, ANN201
    users = [(1, "ann", 36, ["a", "b"], (1, "p"), [2, 3, 2], "s1"), (2, "bob", 20, [], (2, None), [], "s2"), (3, "cyd", 28, None, None, None, "s3"), (4, "dan", None, ["a"], (1, "q"), [9], "s4")]
    orders = [(10, 1, 5.0, "paid"), (11, 1, 7.0, "open"), (12, 2, 2.0, "paid"), (13, 1, None, "paid"), (14, None, 9.0, "open"), (15, 77, 1.0, "open")]
    return {
        "users": spark.createDataFrame(users, "_id int, name string, age int, tags array<string>, meta struct<x int, y string>, friendIds array<int>, secret string"),
        "orders": spark.createDataFrame(orders, "_id int, userId int, amount double, status string"),
        "lines": spark.createDataFrame([(100, 10, 1), (101, 10, 5), (102, 12, 3)], "_id int, orderId int, qty int"),
    }


def make(spark, frames, policy=None, user=USER, order=ORDER, **options):  # noqa: ANN001, ANN003, ANN201
    e = Engine(spark, Source("memory", frames=dict(frames)), policy, **options)
    e.register(user, order, LINE)
    e.set_fn("double", lambda d: None if d["age"] is None else d["age"] * 2)
    e.set_async_fn("upper", lambda rows: rows["name"].str.upper())
    return e


def docs(df) -> list[dict]:  # noqa: ANN001
    return [r.asDict(recursive=True) for r in df.collect()]


def test_relations(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames)
    got = docs(e.query("User($sort:@s){ name, orders($condition:@c){ amount, lines($sort:@d){ qty } }, friends{ name } }", {"s": {"_id": 1}, "c": {"status": "paid"}, "d": {"qty": -1}}))
    assert [d["name"] for d in got] == ["ann", "bob", "cyd", "dan"]
    assert got[0]["orders"] == [{"_id": 10, "amount": 5.0, "lines": [{"_id": 101, "qty": 5}, {"_id": 100, "qty": 1}]}, {"_id": 13, "amount": None, "lines": []}]
    assert [f["name"] for f in got[0]["friends"]] == ["bob", "cyd"] and got[2]["orders"] == [] and got[3]["friends"] == []
    one = docs(e.query("Order($sort:@s){ user{ name } }", {"s": [["_id", 1]]}))
    assert [d["user"] and d["user"]["name"] for d in one] == ["ann", "ann", "bob", "ann", None, None]


def test_shapes_and_computes(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames)
    got = docs(e.query("User($sort:@s,$limit:@l){ meta{ x }, n, spent, tagCount, double, upper }", {"s": {"age": 1}, "l": 3}))
    assert [d["_id"] for d in got] == [4, 2, 3]
    assert got[0] == {"_id": 4, "meta": {"x": 1}, "n": 0, "spent": None, "tagCount": 1, "double": 0, "upper": "DAN"}
    assert got[1]["spent"] == 2.0 and got[2]["tagCount"] == 0 and got[1]["double"] == 40
    assert docs(e.query("User($condition:@c){ _id }", {"c": {"name": "ann"}})) == [{"_id": 1}]
    assert docs(e.query("User($condition:@c){ meta, meta.x }", {"c": {"_id": 1}})) == [{"_id": 1, "meta": {"x": 1, "y": "p"}}]


def test_sort_by_relation_and_pages(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames)
    ids = lambda s: [d["_id"] for d in docs(e.query("User($sort:@s){ _id }", {"s": s}))]
    assert ids({"orders.amount": 1}) == [3, 4, 2, 1] and ids({"orders.amount": -1}) == [1, 2, 3, 4]
    page = e.query_with_count("User($sort:@s){ name }", {"s": {"_id": 1}, "page": 2, "pageSize": 3})
    assert (page.total, page.has_more, [d["_id"] for d in docs(page.items)]) == (4, False, [4])
    assert e.count("User", {"age": {"$gt": 25}}) == 2 and e.exists("User", {"name": "bob"}) and not e.exists("User", {"name": "zed"})
    assert docs(e.query_one("User($sort:@s){ name }", {"s": {"_id": -1}})) == [{"_id": 4, "name": "dan"}]
    assert [d["_id"] for d in docs(e.query("Order($skip:@k,$sort:@s){ _id }", {"k": 4, "s": {"_id": 1}}))] == [14, 15]
    top = docs(e.query("User($condition:@c){ orders($sort:@s,$skip:@k,$limit:@l){ amount } }", {"c": {"_id": 1}, "s": {"amount": -1}, "k": 1, "l": 1}))
    assert top[0]["orders"] == [{"_id": 10, "amount": 5.0}]


@pytest.mark.parametrize(
    ("c", "want"),
    [({"orders": {"$exists": True}}, [1, 2]), ({"orders": {"$exists": False}}, [3, 4]), ({"orders": {"$count": {"$gte": 2}}}, [1]), ({"orders": {"$count": {"$of": "amount", "$eq": 2}}}, [1]), ({"$not": {"orders": {"$count": {"$gt": 2}}}}, [2, 3, 4]), ({"orders": {"$filter": {"status": "paid"}, "$sum": {"$of": "amount", "$lt": 3}}}, [2]), ({"orders": {"status": "open"}}, [1]), ({"orders": {"agg": {"n": {"$count": "*"}, "m": {"$max": "amount"}}, "having": {"n": {"$gt": 0}, "$or": [{"m": {"$gt": 6}}, {"m": {"$lt": 1}}]}}}, [1]), ({"orders": {"$filter": {"lines.qty": {"$gt": 4}}, "$exists": True}}, [1]), ({"$or": [{"orders": {"status": "open"}}, {"age": 20}]}, [1, 2]), ({"$nor": [{"orders": {"$exists": True}}]}, [3, 4]), ({"friends": {"name": "bob"}}, [1]), ({"friends": {"$exists": False}}, [2, 3, 4]), ({"orders": {"$count": {"$eq": 0}}}, [])],
)
def test_relation_predicates(spark, frames, c, want) -> None:  # noqa: ANN001
    assert [d["_id"] for d in docs(make(spark, frames).query("User($condition:@c,$sort:@s){ _id }", {"c": c, "s": {"_id": 1}}))] == want


def test_groups(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames)
    g = {"by": ["status"], "agg": {"n": {"$count": "*"}, "total": {"$sum": "amount"}, "avg": {"$avg": "amount"}, "some": {"$count": "amount"}}}
    assert docs(e.query("Order($group:@g,$sort:@s){ status, n, total, avg, some }", {"g": g, "s": {"n": -1, "status": 1}})) == [{"status": "open", "n": 3, "total": 17.0, "avg": 17 / 3, "some": 3}, {"status": "paid", "n": 3, "total": 7.0, "avg": 3.5, "some": 2}]
    deep = docs(e.query("User($group:@g,$sort:@s){ meta.x, n }", {"g": {"by": ["meta.x"], "agg": {"n": {"$count": "*"}}}, "s": {"meta.x": 1}}))
    assert deep == [{"meta": {"x": None}, "n": 1}, {"meta": {"x": 1}, "n": 2}, {"meta": {"x": 2}, "n": 1}]
    assert docs(e.query("Order($condition:@c,$group:@g){ n, t }", {"c": {"amount": {"$gt": 99}}, "g": {"agg": {"n": {"$count": "*"}, "t": {"$sum": "amount"}}}})) == [{"n": 0, "t": None}]
    assert docs(make(spark, frames, sum_empty="zero").query("Order($condition:@c,$group:@g){ t }", {"c": {"amount": {"$gt": 99}}, "g": {"agg": {"t": {"$sum": "amount"}}}})) == [{"t": 0.0}]


@pytest.mark.parametrize(
    ("gql", "params"),
    [
        ("User{ nope }", {}), ("User{ nope{ a } }", {}), ("Nope{ a }", {}), ("User($limit:@l){ name }", {"l": -1}), ("User($skip:@l){ name }", {"l": "x"}), ("User($sort:@s){ name }", {"s": {"nope": 1}}), ("User($sort:@s){ name }", {"s": {"n": 1}}), ("User($sort:@s){ name }", {"s": {"orders": 1}}), ("User($sort:@s){ name }", {"s": 5}),
        ("User($having:@h){ name }", {"h": {"name": 1}}), ("User($group:@g){ name }", {"g": {"by": ["orders"]}}), ("User($group:@g){ name }", {"g": {"by": ["tags"]}}), ("User($group:@g){ name }", {"g": {"by": ["name", "name"]}}), ("User($group:@g){ n }", {"g": {"agg": {"n": {"$sum": "name"}}}}), ("User($group:@g){ n }", {"g": {"agg": {"n": {"$push": "age"}}}}), ("User($group:@g){ other }", {"g": {"by": ["name"]}}), ("User($group:@g){ name, orders{ amount } }", {"g": {"by": ["name"]}}), ("User($group:@g,$having:@h){ name }", {"g": {"by": ["name"]}, "h": {"age": 1}}), ("User($group:@g,$sort:@s){ name }", {"g": {"by": ["name"]}, "s": {"age": 1}}), ("User($condition:@c,$group:@g){ name }", {"c": {"orders": {"$exists": True}}, "g": {"by": ["name"]}}),
        ("User($condition:@c){ name }", {"c": {"orders": {"having": {"n": 1}}}}), ("User($condition:@c){ name }", {"c": {"orders.lines": {"$exists": True}}}), ("User($condition:@c){ name }", {"c": {"orders": {"$count": {"$gt": 1}, "$exists": True}}}), ("User($condition:@c){ name }", {"c": {"orders": {"agg": {"n": {"$count": "*"}}, "having": {"m": {"$gt": 1}}}}}), ("User($condition:@c){ name }", {"c": {"orders": {"$filter": {"nope": 1}, "$exists": True}}}), ("User($condition:@c){ name }", {"c": {"orders": {"$sum": {"$gt": 1}}}}), ("User{ _score }", {}),
        ("User{ orders{ user{ orders{ user{ orders{ user{ orders{ user{ orders{ user{ name } } } } } } } } } } }", {}), ("User{ orders{ user{ orders{ user($limit:@l){ name } } } } }", {"l": 1}),
    ],
)
def test_rejected(spark, frames, gql, params) -> None:  # noqa: ANN001
    with pytest.raises(EngineError):
        make(spark, frames).query(gql, params)


def test_policies(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames)
    assert "secret" not in docs(e.query("User{ name, secret }", {}, {"roles": ["x"]}))[0] and "secret" in docs(e.query("User{ secret }"))[0]
    with pytest.raises(PermissionDenied):
        e.query("User{ hidden{ amount } }", {}, {"roles": ["x"]})
    with pytest.raises(PermissionDenied):
        e.query("User($group:@g){ secret }", {"g": {"by": ["secret"]}}, {"roles": ["x"]})
    with pytest.raises(NoContext):
        make(spark, frames, Policy(require_context=True)).query("User{ name }")
    owned = {**ORDER, "read": ["creator"], "ownerKey": "status"}
    mine = make(spark, frames, order=owned)
    assert {d["_id"] for d in docs(mine.query("Order{ amount }", {}, {"userId": "paid"}))} == {10, 12, 13}
    assert docs(mine.query("User($condition:@c){ orders{ status } }", {"c": {"_id": 1}}, {"userId": "open"}))[0]["orders"] == [{"_id": 11, "status": "open"}]
    assert docs(mine.query("User($condition:@c){ n }", {"c": {"_id": 1}}, {"userId": "open"}))[0]["n"] == 1
    assert mine.query("Order{ amount }", {}, {"userId": "x", "internal": True}).count() == 6
    for bad in ({**ORDER, "denyRead": True}, {**ORDER, "read": ["boss"]}):
        with pytest.raises(PermissionDenied):
            make(spark, frames, order=bad).query("Order{ amount }", {}, {"roles": ["x"]})
    listed = make(spark, frames, order={**ORDER, "accessKeys": {"userId": {"list": "users", "bypassRoles": ["root"]}}})
    assert {d["_id"] for d in docs(listed.query("Order{ amount }", {}, {"users": [2]}))} == {12} and listed.query("Order{ amount }", {}, {"users": []}).count() == 0
    assert listed.query("Order{ amount }", {}, {"roles": ["root"]}).count() == 6
    with pytest.raises(PermissionDenied):
        listed.query("Order{ amount }", {}, {"userId": "u"})
    rbac = {"mode": "enforce", "managedRoles": ["r"], "grants": [{"role": "r", "model": "Order", "actions": ["read"], "readFields": ["amount"], "condition": {"status": "open"}}]}
    granted = make(spark, frames, Policy(rbac=rbac))
    assert docs(granted.query("Order($sort:@s,$limit:@l){ amount, status }", {"s": {"_id": 1}, "l": 1}, {"roles": ["r"]})) == [{"_id": 11, "amount": 7.0}]
    with pytest.raises(PermissionDenied):
        granted.query("User{ name }", {}, {"roles": ["r"]})


def test_profile(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames, profile="text2query")
    with pytest.raises(NoContext):
        e.query("User{ name }")
    with pytest.raises(ProfileBlocked):
        e.query("User($condition:@c){ name }", {"c": {"tags": "a"}}, {"roles": ["x"]})
    with pytest.raises(ProfileBlocked):
        e.query("User{ name }", {}, {"roles": ["x"]}, route={"database": "d"})
    assert "GlobalLimit" in e.explain("User{ name }", {}, {"roles": ["x"]}, "extended")


def test_raw_sql_and_sources(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames)
    assert e.sql("SELECT name FROM User WHERE age > :a AND name <> ':b' -- :c", {"a": 30}).first().name == "ann"
    assert e.sql("SELECT count(*) AS n FROM User WHERE age > ?", [25]).first().n == 2
    for text, params in (("SELECT :a", {}), ("SELECT 1", {"a": 1})):
        with pytest.raises(ShapeError):
            e.sql(text, params)
    empty = Engine(spark, Source("memory"))
    empty.register(LINE)
    assert empty.query("Line{ qty }").count() == 0
    with pytest.raises(NotFound):
        lost = Engine(spark, {"a": Source("memory")})
        lost.register(LINE)
        lost.query("Line{ qty }")
    with pytest.raises(Exception, match="users has more than 3 rows|User has more than 3 rows"):
        make(spark, frames, limit_rows=3).query("User{ name }").collect()
    replicas = Engine(spark, {"a": Source("memory", reachable=False), "b": Source("memory", frames=frames)})
    replicas.register({**LINE, "location": [{"source": "a", "role": "primary"}, {"source": "b", "role": "replica"}]})
    assert replicas.query("Line{ qty }").count() == 3 and replicas.sources.degraded[0].code == "link_unreachable"
    spec = schema_of("X", frames["users"].schema, "_id")
    assert spec["fields"]["friendIds"] == {"type": "array", "items": "int"} and spec["idType"] == "int"


def test_federation(spark, frames) -> None:  # noqa: ANN001
    e = Engine(spark, {"a": Source("memory", frames=frames), "b": Source("memory", frames=frames)})
    e.register({**USER, "location": {"source": "a"}}, {**ORDER, "location": [{"source": "b", "role": "primary"}, {"source": "a", "role": "replica"}]}, {**LINE, "location": {"source": "b"}})
    p = e.federated_plan("User{ orders{ amount } }")
    assert p.links["Order"] == Location("a", role="replica") and p.units == {"a": ("User", "Order")} and p.exact
    assert e.federated_plan("Order{ lines{ qty } }").units == {"b": ("Order", "Line")}
    got = docs(e.federated("User($condition:@c){ orders{ lines{ qty } } }", {"c": {"_id": 2}}))
    assert got[0]["orders"][0]["lines"] == [{"_id": 102, "qty": 3}]


def test_stages(spark, frames) -> None:  # noqa: ANN001
    e = make(spark, frames)
    agg = lambda *stages: docs(e.command({"kind": "aggregate", "collection": "users", "pipeline": list(stages)}))
    assert [d["tags"] for d in agg({"$unwind": "$tags"}, {"$sort": {"_id": 1, "tags": 1}})] == ["a", "b", "a"]
    assert len(agg({"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}})) == 5
    assert agg({"$match": {"_id": 1}}, {"$project": {"meta.x": 1, "_id": 0}}) == [{"meta": {"x": 1}}]
    assert "secret" not in agg({"$project": {"secret": 0, "meta.y": 0}})[0]
    assert agg({"$match": {"_id": 3}}, {"$set": {"meta.x": 5}}, {"$project": {"meta": 1}}) == [{"_id": 3, "meta": {"x": 5, "y": None}}]
    assert agg({"$group": {"_id": None, "total": {"$sum": "$age"}}}) == [{"_id": None, "total": 84}]
    assert agg({"$sort": {"age": 1}}, {"$skip": 1}, {"$limit": 1}, {"$project": {"age": 1}}) == [{"_id": 2, "age": 20}]
    assert agg({"$facet": {"a": [{"$match": {"age": 20}}, {"$project": {"age": 1}}], "b": [{"$match": {"age": 0}}, {"$project": {"age": 1}}]}}) == [{"a": [{"_id": 2, "age": 20}], "b": []}]
    assert agg({"$match": {"_id": 1}}, {"$lookup": {"from": "users", "localField": "friendIds", "foreignField": "_id", "as": "f"}}, {"$project": {"k": {"$size": "$f"}}}) == [{"_id": 1, "k": 2}]
    for bad in ({"$out": "x"}, {"$bucket": {}}, {"$match": {}, "$limit": 1}, {"$project": {"name": 1, "age": 0}}, {"$replaceRoot": {"newRoot": "$name"}}, {"$limit": -1}, {"$unwind": "tags"}, {"$group": {"n": {"$sum": 1}}}):
        with pytest.raises(ShapeError):
            agg(bad)
    assert docs(e.command({"kind": "findOne", "collection": "users", "filter": {"name": "bob"}, "projection": {"name": 1}})) == [{"_id": 2, "name": "bob"}]


def test_vectors(spark) -> None:  # noqa: ANN001
    rows = [(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], "b"), (3, [0.0, 0.0], "a"), (4, [2.0, 0.0], "b"), (5, [-1.0, 0.0], "a")]
    e = Engine(spark, Source("memory", frames={"v": spark.createDataFrame(rows, "_id int, e array<double>, t string")}))
    e.register({"name": "V", "collection": "v", "idType": "int", "timestamps": False, "archive": False, "fields": {"e": {"type": "vector", "dim": 2}, "t": "string"}})
    near = lambda **k: {"e": {"$near": {"$vector": [1, 0], "$limit": 3, **k}}}
    ask = lambda c: [(d["_id"], round(d["_score"], 3)) for d in docs(e.query("V($condition:@c){ _score }", {"c": c}))]
    assert ask(near()) == [(1, 1.0), (4, 1.0), (2, 0.6)] and ask(near(**{"$minScore": 0.7})) == [(1, 1.0), (4, 1.0)]
    assert ask({**near(), "t": "a"}) == [(1, 1.0), (5, -1.0)] and ask({**near(), "t": {"$not": {"$eq": "b"}}}) == [(1, 1.0)]
    for bad in (near(**{"$vector": [1]}), near(**{"$vector": [0, 0]}), near(**{"$limit": 0}), near(**{"$minScore": 2}), {"$or": [near()]}, {"t": {"$near": {}}}):
        with pytest.raises(ShapeError):
            ask(bad)
    with pytest.raises(ShapeError):
        e.query("V($condition:@c,$limit:@l){ _id }", {"c": near(), "l": 1})
