"""Conditions on small frames, against a plain interpreter of the same conditions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from treeq.errors import ShapeError
from treeq.functions.expr import Compiler
from treeq.functions.predicate import Scope, compile_condition

ROWS = [(i, [None, 1, 2, 3, 5, 8][i % 6], [None, "a", "b", "ab", "Abc"][i % 5], [None, [], [1], [1, 2], [5, None]][i % 5], (None if i % 4 == 0 else (i % 3, [None, "x", "y"][i % 3]))) for i in range(60)]
SCHEMA = "_id int, n int, s string, a array<int>, o struct<k int, t string>"


@pytest.fixture(scope="module")
def frame(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df, condition) -> list[int]:  # noqa: ANN001
    scope = Scope(df.schema)
    found = compile_condition(condition, scope, expression=Compiler(scope).truth)
    return sorted(r[0] for r in (df if found is None else df.where(found)).collect())


MISSING = object()  # a part of an object that is null: neither null nor anything else


def value(row: tuple, path: str) -> object:
    d = dict(zip(("_id", "n", "s", "a", "o"), row, strict=True))
    head, _, rest = path.partition(".")
    v = d[head]
    if rest and v is None:
        return MISSING
    return v if not rest else dict(zip(("k", "t"), v, strict=True))[rest]


def leaf(v: object, spec: object) -> bool:
    if not isinstance(spec, dict):
        return leaf(v, {"$eq": spec})
    out = True
    for op, x in spec.items():
        each = [] if v is MISSING else [e for e in v if e is not None] if isinstance(v, list) and not isinstance(x, list) else [v]
        if op == "$eq":
            r = v is None if x is None else any(e is not None and e == x for e in each)
        elif op == "$ne":
            r = not leaf(v, {"$eq": x})
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            r = any(e is not None and {"$gt": e > x, "$gte": e >= x, "$lt": e < x, "$lte": e <= x}[op] for e in each)
        elif op == "$in":
            vs = v if isinstance(v, list) else [v]
            r = any(e is not None and e in x for e in vs) or (None in x and v is None)
        elif op == "$nin":
            r = not leaf(v, {"$in": x})
        elif op == "$exists":
            r = (v is not MISSING) == x
        elif op == "$not":
            r = not leaf(v, x)
        elif op == "$regex":
            r = isinstance(v, str) and re.search(x, v, re.IGNORECASE if spec.get("$options") else 0) is not None
        elif op == "$options":
            r = True
        else:
            raise AssertionError(op)
        out = out and r
    return out


def plain(row: tuple, c: dict) -> bool:
    out = True
    for k, v in c.items():
        if k == "$and":
            r = all(plain(row, x) for x in v)
        elif k == "$or":
            r = any(plain(row, x) for x in v)
        elif k == "$nor":
            r = not any(plain(row, x) for x in v)
        else:
            r = leaf(value(row, k), v)
        out = out and r
    return out


def test_random_conditions(frame) -> None:  # noqa: ANN001
    rng = random.Random(5)

    def one(depth: int) -> dict:
        kind = rng.random()
        if depth and kind < 0.4:
            return {rng.choice(["$and", "$or", "$nor"]): [one(depth - 1) for _ in range(rng.randint(1, 3))]}
        path = rng.choice(["n", "s", "a", "o.k", "o.t"])
        v = rng.choice(["a", "b", "ab"]) if path in ("s", "o.t") else rng.choice([1, 2, 3, 5])
        ops = [v, {"$ne": v}, {"$in": [v, 8 if isinstance(v, int) else "x"]}, {"$nin": [v]}, {rng.choice(["$gt", "$gte", "$lt", "$lte"]): v}, {"$not": {"$eq": v}}, {"$not": {"$lt": v}}, {"$exists": True}, {"$not": {"$exists": True}}]
        if path != "a":
            ops += [None, {"$ne": None}, {"$in": [v, None]}]
        if path == "s":
            ops += [{"$regex": "^a"}, {"$regex": "^A", "$options": "i"}]
        return {path: rng.choice(ops)}

    for _ in range(60):
        c = one(2)
        assert ids(frame, c) == [r[0] for r in ROWS if plain(r, c)], c


def test_leaves(frame) -> None:  # noqa: ANN001
    assert ids(frame, None) == ids(frame, {}) == list(range(60))
    assert ids(frame, {"n": {"$in": []}}) == [] and len(ids(frame, {"n": {"$nin": []}})) == 60
    assert ids(frame, {"a": [1, 2]}) == [i for i in range(60) if i % 5 == 3]
    assert ids(frame, {"o": {"k": 1, "t": "x"}}) == [r[0] for r in ROWS if r[4] == (1, "x")]
    assert ids(frame, {"$expr": {"$eq": ["$n", "$o.k"]}}) == [r[0] for r in ROWS if r[1] == (r[4][0] if r[4] else None)]


def test_present(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, None, ["_id", "x"]), (2, None, ["_id"]), (3, 5, ["_id", "x"])], "_id int, x int, __present array<string>")
    assert ids(df, {"x": None}) == [1] and ids(df, {"x": {"$exists": True}}) == [1, 3] and ids(df, {"x": {"$exists": False}}) == [2]
    assert ids(df, {"x": {"$ne": 5}}) == [1, 2] and ids(df, {"x": {"$ne": None}}) == [2, 3]


def test_arrays_of_structs(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, [(1, "a"), (9, "b")]), (2, [(3, "b")]), (3, []), (4, None)], "_id int, x array<struct<k int, t string>>")
    assert ids(df, {"x.k": {"$gt": 5}}) == [1] and ids(df, {"x.t": "b"}) == [1, 2] and ids(df, {"x.t": {"$ne": "a"}}) == [2, 3, 4]


@pytest.mark.parametrize(
    "c",
    [{"n": {"$foo": 1}}, {"nope": 1}, {"n": "x"}, {"s": 5}, {"$and": []}, {"$or": {}}, {"$where": "x"}, {"a": {"$or": [{"$function": 1}]}}, {"n": {"$in": 5}}, {"s": {"$regex": "a", "$options": "x"}}, {"s": {"$options": "i"}}, {"s": {"$regex": "(?=a)"}}, {"a.0": 1}, {"o.z": 1}, {"o": {"k": 1}}, {"n": {"$gt": None}}, {"n": {"$gt": 1, "x": 2}}, [], "x", {"$elemMatch": 1}, {"s;x": 1}],
)
def test_rejected(frame, c) -> None:  # noqa: ANN001
    with pytest.raises(ShapeError):
        ids(frame, c if c != [] else [1])


def test_expressions(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, [1, 2, None, 2], "a", None, 0.5)], "_id int, a array<int>, s string, z int, d double")
    c = Compiler(Scope(df.schema))
    cases = [
        ({"$eq": ["$z", None]}, True), ({"$ne": ["$s", "a"]}, False), ({"$and": ["$s", 1]}, True), ({"$or": ["$z", 0]}, False), ({"$ifNull": ["$z", 7]}, 7),
        ({"$cond": [{"$eq": ["$s", "a"]}, "yes", "no"]}, "yes"), ({"$cond": {"if": False, "then": 1, "else": 2}}, 2), ({"$isArray": "$a"}, True), ({"$in": [2, "$a"]}, True),
        ({"$in": [[7, 1], "$a"]}, True), ({"$arrayElemAt": ["$a", -1]}, 2), ({"$arrayElemAt": ["$a", 9]}, None), ({"$filter": {"input": "$a", "as": "x", "cond": {"$eq": ["$$x", 2]}}}, [2, 2]),
        ({"$setUnion": ["$a", [5]]}, [1, 2, None, 5]), ({"$size": "$a"}, 4), ({"$sum": "$a"}, 5), ({"$avg": "$a"}, 5 / 3), ({"$min": "$a"}, 1), ({"$max": "$a"}, 2), ({"$sum": "$z"}, 0), ({"$avg": "$z"}, None), ({"$literal": "$s"}, "$s"),
    ]
    got = df.select(*(c.column(e).alias(f"c{i}") for i, (e, _) in enumerate(cases))).first()
    for i, (e, want) in enumerate(cases):
        assert got[i] == want, e
    assert df.select(c.column({"x": "$s", "y": ["$d", 1.0]}).alias("o")).first().o.asDict() == {"x": "a", "y": [0.5, 1.0]}
    for bad in ({"$concat": ["a"]}, {"$size": "$s"}, "$nope", "$$v", {"$eq": [1]}, {"$filter": {"input": "$a"}}, {"$sum": "$s"}):
        with pytest.raises(ShapeError):
            df.select(c.column(bad) if c.column(bad) is not None else F.lit(1))
