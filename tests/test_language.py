from __future__ import annotations

import datetime as dt

import pytest

from treeq import naming
from treeq.errors import Conflict, EngineError, NotFound, ParseError, ShapeError
from treeq.operators.triggers import due, filled, parse_cron
from treeq.plans.gql import parse
from treeq.resources import content_path, resource_url
from treeq.schema import Registry, merged, model_of
from treeq.sources.registry import load_directory


def test_parse_tree() -> None:
    node = parse("Order($condition:@c, $sort:@s){ _id, status, meta.x, items($limit:@n){ qty, part{ name } } }")
    assert (node.name, node.clauses, node.fields) == ("Order", {"$condition": "c", "$sort": "s"}, ["_id", "status", "meta.x"])
    assert [r.name for r in node.relations] == ["items"] and node.relations[0].clauses == {"$limit": "n"}
    assert node.relations[0].relations[0].fields == ["name"]
    assert node.value("$condition", {}) is None


@pytest.mark.parametrize("text", ["", "M{$condition:", "M($pipeline:@p){a}", "M($foo:@x){a}", "M{a} b", "M(#){a}", "M{a", "M($sort:5){a}", "M{r($group:@g){a}}", "M($sort:@a,$sort:@b){a}"])
def test_parse_errors(text: str) -> None:
    with pytest.raises(ParseError):
        parse(text)


def test_names() -> None:
    assert naming.snake("createdAtUTC") == "created_at_utc" and naming.snake("_id") == "_id"
    assert naming.camel("o_order_date") == "oOrderDate" and naming.pascal("user_name") == "UserName" and naming.kebab("userName") == "user-name"
    assert naming.clashes(["userName", "user_name", "x"]) == [("userName", "user_name")]


@pytest.mark.parametrize(
    "spec",
    [
        {"fields": {}},
        {"name": "A", "fields": {}, "bogus": 1},
        {"name": "A", "fields": {"a": {"type": "string", "bogus": 1}}},
        {"name": "A", "fields": {"_score": "double"}},
        {"name": "A", "fields": {"userName": "string", "user_name": "string"}},
        {"name": "A", "fields": {"v": {"type": "vector"}}},
        {"name": "A", "fields": {"v": {"type": "vector", "dim": 20_000}}},
        {"name": "A", "fields": {"a": {"type": "string", "dim": 3}}},
        {"name": "A", "fields": {"a": "string"}, "timestamps": "hours"},
        {"name": "A", "fields": {"a": "string"}, "ownerKey": "_id"},
        {"name": "A", "fields": {"a": "string"}, "relations": {"r": {"model": "B", "type": "some"}}},
        {"name": "A", "fields": {"a": "string"}, "computes": {"c": {"fn": "f", "agg": {"$count": "r"}}}},
        {"name": "A", "fields": {"a": "string"}, "computes": {"c": {"agg": {"$median": "a"}}}},
        {"name": "A", "fields": {"a": "string"}, "accessKeys": {"b": "list"}},
        {"name": "A", "fields": {"a": "string"}, "triggers": {"schedule": [{"fnRef": "f"}]}},
        {"name": "A", "fields": {"a": "string"}, "triggers": {"schedule": [{"fnRef": "f", "cron": "* * * *"}]}},
        {"name": "A", "fields": {"a": "string"}, "triggers": {"schedule": [{"fnRef": "f", "cron": "* * * * *", "args": {"x": "{{root.a}}"}}]}},
    ],
)
def test_rejected_models(spec: dict) -> None:
    with pytest.raises(EngineError):
        model_of(spec)


def test_registry() -> None:
    r = Registry()
    r.register({"name": "Post", "collection": "posts", "fields": {"title": "string"}, "write": ["creator"]})
    assert r.list() == ["Post", "PostDeleted"] and "createdBy" in r["Post"].fields and "deletedAt" in r["PostDeleted"].fields
    with pytest.raises(Conflict):
        r.register_batch([{"name": "Good", "fields": {}}, {"name": "Other", "collection": "posts", "fields": {}}])
    assert "Good" not in r
    r.unregister("Post")
    r.unregister("Post")
    with pytest.raises(NotFound):
        r["PostDeleted"]


def test_overlay_and_directory() -> None:
    out = merged([{"name": "A", "fields": {"x": "int"}, "read": ["a"]}], [{"name": "A", "read": ["b"], "fields": {"y": "int"}}])
    assert out == [{"name": "A", "fields": {"x": "int", "y": "int"}, "read": ["b"]}]
    sources = {"s": {"kind": "parquet", "databases": ["shop"]}, "t": {"kind": "table", "databases": ["crm"]}}
    files = {"shop/user.json": {"name": "User"}, "crm/public/user.json": {"name": "User", "collection": "u", "location": {"role": "replica"}}}
    assert [x["source"] for x in load_directory(files, sources)[0]["location"]] == ["s", "t"]
    files["crm/public/user.json"]["location"] = {}
    with pytest.raises(ShapeError, match="primary"):
        load_directory(files, sources)
    with pytest.raises(ShapeError, match="belongs to 0"):
        load_directory({"other/a.json": {"name": "A"}}, sources)


@pytest.mark.parametrize(
    ("cron", "at", "expect"),
    [("* * * * *", (1, 1, 12, 34), True), ("0 2 * * *", (1, 1, 2, 0), True), ("0 2 * * *", (1, 1, 2, 1), False), ("*/15 * * * *", (1, 1, 0, 30), True), ("*/15 * * * *", (1, 1, 0, 20), False), ("1-30/10 * * * *", (1, 1, 8, 11), True), ("1-30/10 * * * *", (1, 1, 8, 12), False), ("0 9-18 * * 1-5", (1, 1, 9, 0), True), ("0 9-18 * * 1-5", (1, 3, 9, 0), False), ("0 0 * * 7", (1, 4, 0, 0), True)],
)
def test_cron(cron: str, at: tuple, expect: bool) -> None:
    month, day, hour, minute = at
    assert due(cron, dt.datetime(2026, month, day, hour, minute)) == expect


@pytest.mark.parametrize("cron", ["99 * * * *", "a * * * *", "* * *", "5-1 * * * *", "*/0 * * * *"])
def test_cron_errors(cron: str) -> None:
    with pytest.raises(ShapeError):
        parse_cron(cron)


def test_slots_and_resources() -> None:
    assert filled({"a": "{{root.x}}", "b": "id {{before._id}} at {{now}}"}, {"x": 5}, {"_id": "q"}, 7) == {"a": 5, "b": "id q at 7"}
    assert content_path("abcdef0123", "png") == "ab/cd/abcdef0123.png"
    assert resource_url("http://x/", "/a/b") == "http://x/a/b" and resource_url("http://x", "https://y/z") == "https://y/z"
    with pytest.raises(ShapeError):
        content_path("../x")
