"""Rows that are skipped, against plain lists; no task may take all rows for it."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeq import workload
from treeq.engine import Engine
from treeq.operators import pages
from treeq.plans import stages
from treeq.sources.registry import Source

SF = "/root/testdata/sf0.001"
NAN = float("nan")
VALUES = {"s": [None, "", "a", "b", "ab"], "x": [None, -0.0, 0.0, 1.5, NAN, -2.0], "b": [None, True, False]}


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    r = random.Random(7)
    return [(i, *(r.choice(v) for v in VALUES.values())) for i in range(300)] + [(None, None, None, None)] * 3 + [(7, "a", NAN, True)] * 4


@pytest.fixture(scope="module")
def frame(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "_id long, s string, x double, b boolean").repartition(5).cache()


def place(v: object) -> tuple:
    """Null, then values, NaN last; zeros are equal."""
    return (0,) if v is None else (2,) if v != v else (1, v + 0.0 if isinstance(v, float) else v)  # noqa: PLR0124


def ordered(rows: list[tuple], keys: list[tuple[int, int]]) -> list[tuple]:
    for i, d in reversed(keys):
        rows = sorted(rows, key=lambda r: place(r[i]), reverse=d < 0)
    return rows


def in_one_task(df) -> bool:  # noqa: ANN001
    """Whether one task takes what is left of all rows: an offset without a limit."""
    return re.search(r"GlobalLimit -1|CollectLimit -1", df._jdf.queryExecution().executedPlan().toString()) is not None


@pytest.mark.parametrize("first", [0, 10_000])
@pytest.mark.parametrize("keys", [[(0, 1)], [(0, -1)], [(1, -1), (0, 1)], [(2, 1), (1, -1), (0, -1)], [(2, -1)], [(3, 1)], [(3, -1), (2, 1)]])
def test_after(frame, rows, monkeypatch, first, keys) -> None:  # noqa: ANN001
    """Both ways to find the n-th row, with nulls, NaN, zeros and keys that many rows share: as many rows as in a list, with the same keys."""
    monkeypatch.setattr(pages, "FIRST", first)
    order, want = [(F.col(frame.columns[i]), d) for i, d in keys], ordered(rows, keys)
    key = lambda found: [tuple(place(r[i]) for i, _ in keys) for r in found]
    for n in (1, 2, 150, 306, 307, 400):
        df = pages.page(frame, order, n, None, shared=keys[0][0] > 1)
        assert not in_one_task(df)
        got = df.collect()
        assert key(got) == key(want[n:]), n
        assert Counter(str(tuple(r)) for r in got) <= Counter(map(str, rows))
    assert key(pages.page(frame, order, 100, 20).collect()) == key(want[100:120])


@pytest.mark.parametrize("first", [0, 10_000])
def test_queries(spark, monkeypatch, first) -> None:  # noqa: ANN001
    """Roots, relations in the order, groups and stages, against what Spark's own offset gives."""
    monkeypatch.setattr(pages, "FIRST", first)
    e = workload.engine(spark, SF)
    n, ids = 400, lambda df: [r[0] for r in df.collect()]
    every = e.query("Order($sort:@s){ _id }", {"s": {"totalPrice": -1}})
    q = e.query("Order($sort:@s,$skip:@k){ _id }", {"s": {"totalPrice": -1}, "k": n})
    assert not in_one_task(q) and ids(q) == ids(every)[n:]
    deep = e.query("Order($sort:@s,$skip:@k,$limit:@l){ _id }", {"s": {"totalPrice": -1}, "k": n, "l": 30})
    assert ids(deep) == ids(every)[n : n + 30]
    sort = {"orders.totalPrice": -1}
    parents = e.query("Customer($sort:@s,$skip:@k){ _id }", {"s": sort, "k": 70})
    assert not in_one_task(parents) and ids(parents) == ids(e.query("Customer($sort:@s){ _id }", {"s": sort}))[70:]
    group = {"by": ["custId"], "agg": {"n": {"$count": "*"}, "t": {"$sum": "totalPrice"}}}
    text, params = "Order($group:@g,$sort:@s,$skip:@k){ custId, n }", {"g": group, "s": {"n": -1}, "k": 9}
    made = e.query(text, params)
    assert not in_one_task(made)
    assert made.collect() == e.query(text, params | {"k": 0}).collect()[9:]
    by_sum = e.query(text, params | {"s": {"t": 1}})  # a sum of doubles may differ when it is made again
    assert in_one_task(by_sum) and by_sum.count() == made.count()
    command = lambda *p: e.command({"kind": "aggregate", "collection": "orders", "pipeline": [*p, {"$project": {"status": 1}}]})
    sorted_ = {"$sort": {"totalPrice": -1}}
    skipped = command(sorted_, {"$skip": n})
    assert not in_one_task(skipped) and ids(skipped) == ids(every)[n:]
    assert ids(command(sorted_, {"$skip": n}, {"$limit": 5})) == ids(every)[n : n + 5]
    assert in_one_task(command({"$limit": 900}, sorted_, {"$skip": n})) and command({"$limit": 900}, sorted_, {"$skip": n}).count() == 500


def test_offset_alone(spark) -> None:  # noqa: ANN001
    assert not in_one_task(workload.ask(spark, SF, "Order($skip:@k){ _id }", k=100))


def test_defaults_after_skip(spark) -> None:  # noqa: ANN001
    """Fields that no column holds keep their default, and stored nulls stay."""
    e = Engine(spark, Source("memory", frames={"things": spark.createDataFrame([(i, None) for i in range(6)], "_id int, a int")}))
    e.register({"name": "Thing", "collection": "things", "idType": "int", "timestamps": False, "archive": False, "fields": {"a": {"type": "int", "default": 4}, "b": {"type": "int", "default": 5}}})
    got = [tuple(r) for r in e.query("Thing($skip:@k){ a, b }", {"k": 4}).collect()]
    assert got == [(4, None, 5), (5, None, 5)]


def test_ties_are_not_sorted(spark) -> None:  # noqa: ANN001
    """Where many rows share a key, it is counted before it is sorted, and rows that have it aren't sorted to number them."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = stages.run(df, [{"$sort": {"k": 1}}, {"$skip": 400}], lambda name: df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Aggregate [__key0" in plan and "Repartition 1, true" in plan
    assert [tuple(r) for r in got.groupBy("k").count().orderBy("k").collect()] == [(1, 267), (2, 333)]


def test_stage_lists(spark) -> None:  # noqa: ANN001
    df = spark.range(50).select(F.col("id").alias("_id"), (F.col("id") % 7).alias("k"))
    for skip, limit in itertools.product((0, 3, 49, 60), (None, 4)):
        got = stages.run(df, [{"$sort": {"k": -1}}, {"$skip": skip}, *([] if limit is None else [{"$limit": limit}])], lambda name: df)
        want = sorted(range(50), key=lambda i: (-(i % 7), i))[skip:][:limit]
        assert [r[0] for r in got.collect()] == want
