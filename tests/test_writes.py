from __future__ import annotations

import datetime as dt
import shutil

import pytest

from treeq import inventory
from treeq.engine import Engine
from treeq.errors import Conflict, EngineError, NoContext, PermissionDenied, ProfileBlocked, ShapeError
from treeq.operators import writes
from treeq.operators.writes import Writer
from treeq.policy import Context, Policy
from treeq.sources.registry import Source

POST = {"name": "Post", "collection": "posts", "idPrefix": "P", "fields": {"title": {"type": "string", "required": True}, "status": {"type": "string", "default": "draft"}, "views": "int", "code": "string", "meta": {"type": "object", "fields": {"x": "int", "y": "string"}}}, "indexes": [{"fields": ["code"], "unique": True}], "relations": {"notes": {"model": "Note", "type": "many", "foreignField": "postId"}, "cover": {"model": "Cover", "type": "one", "foreignField": "postId"}}}
NOTE = {"name": "Note", "collection": "notes", "timestamps": False, "archive": False, "fields": {"postId": "string", "body": "string"}}
COVER = {"name": "Cover", "collection": "covers", "timestamps": False, "archive": False, "fields": {"postId": "string", "url": "string"}}


def make(spark, policy=None, post=POST, source=None):  # noqa: ANN001, ANN201
    e = Engine(spark, source or Source("memory"), policy)
    e.register(post, NOTE, COVER)
    ids = iter(range(1, 100))
    return e, Writer(e, now=lambda: 1700, new_id=lambda m: f"{m.id_prefix or 'n'}{next(ids)}")


def rows(e, model, *columns) -> list[tuple]:  # noqa: ANN001, ANN002
    return sorted(tuple(r) for r in e.table(model).select(*(columns or ("*",))).collect())


def test_insert(spark) -> None:  # noqa: ANN001
    e, w = make(spark)
    out = w.insert("Post", {"title": "a", "views": None, "meta": {"x": 1, "y": "q"}})
    assert out.docs == [{"_id": "P1", "title": "a", "status": "draft", "meta": {"x": 1, "y": "q"}, "createdAt": 1700, "updatedAt": 1700}]
    w.insert_many("Post", [{"title": "b", "code": "k"}, {"_id": "X", "title": "c", "status": "done"}])
    assert rows(e, "Post", "_id", "status", "code") == [("P1", "draft", None), ("P2", "draft", "k"), ("X", "done", None)]
    for bad, error in (({"_id": "X", "title": "d"}, Conflict), ({"title": "d", "code": "k"}, Conflict), ({"views": 1}, ShapeError), ({"title": "d", "nope": 1}, ShapeError), ({"title": "d", "meta": 5}, ShapeError)):
        with pytest.raises(error):
            w.insert("Post", bad)
    with pytest.raises(Conflict):
        w.insert_many("Post", [{"_id": "Y", "title": "a"}, {"_id": "Y", "title": "b"}])
    w.insert_many("Post", [{"_id": "X", "title": "new"}], upsert_by_id=True)
    assert ("X", "new") in rows(e, "Post", "_id", "title")
    bulk = spark.createDataFrame([("B1", "t"), ("B2", "t")], "_id string, title string")
    assert w.insert_rows("Post", bulk).inserted == 2
    with pytest.raises(Conflict):
        w.insert_rows("Post", bulk)


def test_update(spark) -> None:  # noqa: ANN001
    e, w = make(spark)
    w.insert_many("Post", [{"_id": str(i), "title": "t", "views": i} for i in range(1, 5)])
    out = w.update_many("Post", {"views": {"$gte": 2}}, {"$set": {"title": "u", "meta.x": 3}, "$inc": {"views": 10}})
    assert (out.matched, out.modified) == (3, 3)
    assert rows(e, "Post", "_id", "title", "views", "meta.x") == [("1", "t", 1, None), ("2", "u", 12, 3), ("3", "u", 13, 3), ("4", "u", 14, 3)]
    assert w.update_many("Post", {"title": "u"}, {"title": "u"}).modified == 0
    one = w.update("Post", {"title": "u"}, {"$unset": {"title": ""}})
    assert (one.before["_id"], one.before["title"], one.docs[0]["title"]) == ("2", "u", None)
    assert w.update("Post", {"title": "nope"}, {"views": 1}).matched == 0
    for bad in ({}, None, {"$and": []}):
        with pytest.raises(ShapeError):
            w.update_many("Post", bad, {"views": 1})
        with pytest.raises(ShapeError):
            w.remove("Post", bad)
    for bad in ({}, {"$push": {"views": 1}}, {"nope": 1}, {"_id": "z"}, {"$inc": {"title": 1}}, {"$set": {"views": 1}, "x": 1}, {"meta": 4}):
        with pytest.raises(EngineError):
            w.update_many("Post", {"_id": "1"}, bad)


def test_upsert_remove_and_archive(spark) -> None:  # noqa: ANN001
    e, w = make(spark)
    first = w.upsert("Post", {"code": "k"}, {"$set": {"title": "a"}, "$setOnInsert": {"status": "new"}, "$inc": {"views": 2}})
    assert first.inserted == 1 and rows(e, "Post", "code", "status", "views") == [("k", "new", 2)]
    again = w.upsert("Post", {"code": "k"}, {"$set": {"title": "b"}, "$setOnInsert": {"status": "x"}, "$inc": {"views": 2}})
    assert again.matched == 1 and rows(e, "Post", "title", "status", "views") == [("b", "new", 4)]
    w.insert("Post", {"_id": "Z", "title": "z"})
    assert w.remove("Post", {"title": "b"}).deleted == 1 and w.remove("Post", {"title": "b"}).deleted == 0
    assert rows(e, "PostDeleted", "title", "deletedAt") == [("b", 1700.0)] and rows(e, "Post", "_id") == [("Z",)]
    assert w.delete_many("Post", {"_id": "Z"}).deleted == 1 and len(rows(e, "PostDeleted")) == 1


def test_mutation_claim_and_compare(spark) -> None:  # noqa: ANN001
    e, w = make(spark)
    out = w.mutation("Post", {"title": "a", "code": "k", "notes": [{"body": "1"}, {"body": "2"}], "cover": {"url": "u"}})
    root = out.docs[0]["_id"]
    assert out.steps == ["Post:insert", "Note:insert", "Note:insert", "Cover:insert"] and {r[0] for r in rows(e, "Note", "postId")} == {root}
    assert w.mutation("Post", {"title": "b", "code": "k", "cover": {"url": "v"}}).steps == ["Post:update", "Cover:update"] and rows(e, "Cover", "url") == [("v",)]
    with pytest.raises(ShapeError):
        w.mutation("Post", {"title": "b", "notes": {"body": "x"}})
    w.insert_many("Post", [{"_id": str(i), "title": "job", "views": 9 - i} for i in range(4)])
    got = w.claim("Post", {"title": "job"}, {"status": "taken"}, sort={"views": 1}, limit=2)
    assert [d["_id"] for d in got.docs] == ["3", "2"] and w.claim("Post", {"title": "none"}, {"status": "x"}).matched == 0
    assert w.compare_and_set("Post", {"_id": "3"}, {"status": "taken"}, {"status": "done"}).matched == 1
    assert w.compare_and_set("Post", {"_id": "3"}, {"status": "taken"}, {"status": "done"}).matched == 0
    with pytest.raises(ShapeError):
        w.claim("Post", {}, {"status": "x"}, limit=0)


def test_policies(spark) -> None:  # noqa: ANN001
    post = {**POST, "write": ["editor", "creator"], "fields": {**POST["fields"], "status": {"type": "string", "write": ["boss"]}}}
    e, w = make(spark, post=post)
    w.insert("Post", {"_id": "1", "title": "a"}, {"userId": "u1"})
    w.insert("Post", {"_id": "2", "title": "a"}, {"userId": "u2"})
    assert w.update_many("Post", {"title": "a"}, {"title": "b", "status": "no"}, {"userId": "u1"}).matched == 1
    assert rows(e, "Post", "_id", "title", "createdBy", "status") == [("1", "b", "u1", None), ("2", "a", "u2", None)]
    assert w.update_many("Post", {"_id": {"$in": ["1", "2"]}}, {"title": "c"}, {"userId": "x", "roles": ["editor"]}).matched == 2
    with pytest.raises(PermissionDenied):
        w.update_many("Post", {"_id": "1"}, {"createdBy": "u9"}, {"userId": "u1"})
    with pytest.raises(PermissionDenied):
        w.update_many("Post", {"_id": "1"}, {"$unset": {"status": ""}}, {"userId": "u1"})
    with pytest.raises(PermissionDenied):
        w.insert("Post", {"title": "a"}, {"roles": ["guest"]})
    grants = Policy(rbac={"mode": "enforce", "managedRoles": ["r"], "grants": [{"role": "r", "model": "Post", "actions": ["update"], "condition": {"title": "c"}}]})
    g = Writer(e.with_policy(grants), now=lambda: 1)
    assert g.update_many("Post", {"_id": "1"}, {"views": 1}, {"userId": "u", "roles": ["r", "editor"]}).matched == 1
    with pytest.raises(PermissionDenied):
        g.remove("Post", {"_id": "1"}, {"userId": "u", "roles": ["r", "editor"]})


def test_gates_and_helpers(spark) -> None:  # noqa: ANN001
    e, _ = make(spark)
    e = e.with_policy(Policy(deny_write_roles=("guest",), define_roles=("admin",)))
    with pytest.raises(PermissionDenied):
        Writer(e).insert("Post", {"title": "a"}, {"roles": ["guest"]})
    with pytest.raises(PermissionDenied):
        e.register({"name": "Z", "fields": {}}, ctx={"roles": ["x"]})
    assert e.register({"name": "Z", "fields": {}}, ctx={"roles": ["admin"]})[0].name == "Z"
    ctx = Context.of({"userId": "u", "roles": ["guest"]})
    post = e.registry["Post"]
    assert e.policy.can_read(post, ctx) and not e.policy.can_write(post, ctx) and not e.policy.owner_only(post, ctx)
    assert "title" in e.policy.readable_fields(post, ctx) and e.policy.readable_relations(post, ctx) == ["notes", "cover"]
    assert e.policy.writable_data(post, ctx, {"_id": 1, "title": 2}) == {"_id": 1, "title": 2} and "title" in e.policy.writable_fields(post, ctx)


def test_commands(spark) -> None:  # noqa: ANN001
    e, w = make(spark)
    run = lambda kind, **c: w.command({"kind": kind, "collection": "posts", **c})
    run("insertOne", document={"_id": "1", "title": "a"})
    run("insertMany", documents=[{"_id": "2", "title": "b", "views": 1}, {"_id": "3", "title": "b"}])
    assert run("updateMany", filter={"title": "b"}, update={"$inc": {"views": 1}}).matched == 2
    assert run("findOneAndUpdate", filter={"_id": "9"}, update={"$set": {"title": "n"}}, upsert=True).inserted == 1
    assert run("claim", filter={"title": "b"}, update={"$set": {"status": "x"}}, limit=1).docs[0]["_id"] == "2"
    assert run("compareAndSet", filter={"_id": "2"}, expected={"status": "x"}, update={"$set": {"status": "y"}}).matched == 1
    assert run("deleteMany", filter={"_id": "1"}).deleted == 1
    assert rows(e, "Post", "_id", "views", "status") == [("2", 2, "y"), ("3", 1, None), ("9", None, None)]
    with pytest.raises(ShapeError):
        run("drop")


def test_triggers(spark) -> None:  # noqa: ANN001
    post = {**POST, "triggers": {"insert": [{"name": "log", "into": "Note", "op": "insert", "data": {"postId": "{{root._id}}", "body": "at {{now}}"}}], "update": [{"name": "paid", "onFields": ["status"], "when": {"eq": ["{{root.status}}", "paid"]}, "fnRef": "hook", "args": {"id": "{{root._id}}", "was": "{{before.status}}"}}], "remove": [{"into": "Note", "op": "remove", "condition": {"postId": "{{before._id}}"}}], "schedule": [{"cron": "0 2 * * *", "fnRef": "hook", "args": {"at": "{{now}}"}}]}}
    e, w = make(spark, post=post)
    seen: list[object] = []
    e.set_fn("hook", seen.append)
    w.insert("Post", {"_id": "1", "title": "a"})
    assert rows(e, "Note", "postId", "body") == [("1", "at 1700")]
    w.update("Post", {"_id": "1"}, {"title": "b"})
    w.update("Post", {"_id": "1"}, {"status": "paid"})
    assert seen == [{"id": "1", "was": "draft"}]
    w.remove("Post", {"_id": "1"})
    assert rows(e, "Note") == []
    at = dt.datetime(2026, 1, 1, 2, 0, tzinfo=dt.UTC)
    w.run_schedule(at)
    assert seen[-1] == {"at": int(at.timestamp() * 1000)} and len(seen) == 2


def test_parquet_store(spark, tmp_path) -> None:  # noqa: ANN001
    e, w = make(spark, source=Source("parquet", str(tmp_path)))
    w.insert("Post", {"_id": "1", "title": "a"})
    w.insert("Post", {"_id": "2", "title": "b"})
    w.remove("Post", {"_id": "1"})
    assert rows(e, "Post", "_id") == [("2",)] and rows(e, "PostDeleted", "_id") == [("1",)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["posts", "posts_deleted"]


def test_refused_before_the_lock(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    """The lock is another program's, so a write that came to it would end in Conflict."""
    monkeypatch.setattr(writes, "WAIT", 0.0)
    (tmp_path / "posts.lock").touch()
    note, post = {**NOTE, "read": ["boss"]}, {**POST, "accessKeys": {"code": {"list": "codes"}}}
    e = Engine(spark, Source("parquet", str(tmp_path)), Policy(deny_write_roles=("guest",)))
    e.register(post, note, COVER)
    w, guest, listless = Writer(e), {"roles": ["guest"]}, {"userId": "u"}
    clerk = {"userId": "u", "codes": ["k"]}
    for ctx in (guest, listless):
        for refused in (
            lambda: w.insert("Post", {"title": "a", "code": "k"}, ctx),
            lambda: w.update("Post", {"_id": "1"}, {"title": "b"}, ctx),
            lambda: w.update_many("Post", {"_id": "1"}, {"title": "b"}, ctx),
            lambda: w.upsert("Post", {"_id": "1"}, {"title": "b"}, ctx),
            lambda: w.remove("Post", {"_id": "1"}, ctx),
            lambda: w.delete_many("Post", {"_id": "1"}, ctx),
        ):
            with pytest.raises(PermissionDenied):
                refused()
    for hidden in ({"notes": {"body": "x"}}, {"$or": [{"title": "a"}, {"notes": {"$exists": True}}]}):
        with pytest.raises(PermissionDenied):
            w.delete_many("Post", hidden, clerk)
    for bad in (lambda: w.insert("Post", {"nope": 1}), lambda: w.update_many("Post", {"_id": "1"}, {"nope": 1}), lambda: w.remove("Post", {}), lambda: w.update("Post", {"$or": []}, {"title": "b"})):
        with pytest.raises(ShapeError):
            bad()
    with pytest.raises(Conflict):
        w.insert("Post", {"title": "a", "code": "k"}, clerk)
    with pytest.raises(Conflict):
        w.delete_many("Post", {"cover": {"$exists": True}}, clerk)
    assert [p.name for p in tmp_path.iterdir()] == ["posts.lock"]


def test_policy_gates_need_no_lock(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(writes, "WAIT", 0.0)
    for t in ("region", "nation"):
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    (tmp_path / "region.lock").touch()
    found = dict(tuple(r) for r in inventory.QUERIES["policy_gates"](spark, str(tmp_path)).collect())
    assert (found["deny write role"], found["write role"]) == ("PermissionDenied", "PermissionDenied")


def test_claims_refused_before_the_lock(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(writes, "WAIT", 0.0)
    (tmp_path / "posts.lock").touch()
    source, note = Source("parquet", str(tmp_path)), {**NOTE, "read": ["boss"]}
    text, e = Engine(spark, source, profile="text2query"), Engine(spark, source, Policy(deny_write_roles=("guest",)))
    for x in (text, e):
        x.register(POST, note, COVER)
    t, w, clerk, guest = Writer(text), Writer(e), {"userId": "u"}, {"roles": ["guest"]}
    for error, refused in (
        (ProfileBlocked, lambda: t.claim("Post", {"_id": "1"}, {"title": "b"}, clerk)),
        (ProfileBlocked, lambda: t.compare_and_set("Post", {"_id": "1"}, {"title": "a"}, {"title": "b"}, clerk)),
        (ProfileBlocked, lambda: t.update("Post", {"meta.x": 1}, {"title": "b"}, clerk)),
        (NoContext, lambda: t.update("Post", {"_id": "1"}, {"title": "b"})),
        (PermissionDenied, lambda: w.claim("Post", {"_id": "1"}, {"title": "b"}, guest)),
        (PermissionDenied, lambda: w.compare_and_set("Post", {"_id": "1"}, {"title": "a"}, {"title": "b"}, guest)),
        (PermissionDenied, lambda: w.claim("Post", {"notes": {"body": "x"}}, {"title": "b"}, clerk)),
        (PermissionDenied, lambda: w.claim("Post", {}, {"title": "b"}, clerk, sort={"notes.body": 1})),
        (ShapeError, lambda: w.claim("Post", {}, {"title": "b"}, clerk, limit=0)),
        (ShapeError, lambda: w.claim("Post", {}, {"title": "b"}, clerk, sort=5)),
        (ShapeError, lambda: w.compare_and_set("Post", {"_id": "1"}, {}, {"title": "b"}, clerk)),
        (Conflict, lambda: w.claim("Post", {}, {"title": "b"}, clerk, sort={"cover.url": 1})),
        (Conflict, lambda: w.compare_and_set("Post", {"_id": "1"}, {"title": "a"}, {"title": "b"}, clerk)),
    ):
        with pytest.raises(error):
            refused()
    assert [p.name for p in tmp_path.iterdir()] == ["posts.lock"]


def test_text_profile_needs_no_lock(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(writes, "WAIT", 0.0)
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    (tmp_path / "region.lock").touch()
    assert dict(tuple(r) for r in inventory.QUERIES["text_profile"](spark, str(tmp_path)).collect())["claim"] == "ProfileBlocked"
