"""The registered queries against their SQL, the driver's entry, and streams."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treeq import inventory, workload
from treeq.errors import ShapeError
from treeq.schema import model_of
from treeq.sources.registry import Source, Sources
from treeq.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():  # noqa: ANN201
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def comparable(rows: list[tuple]) -> list[str]:
    one = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([one(v) for v in r]) for r in rows)


ALL = workload.QUERIES | inventory.QUERIES
ORACLE = workload.ORACLE | inventory.ORACLE


@pytest.mark.parametrize("name", list(ALL))
def test_against_sql(spark, db, name) -> None:  # noqa: ANN001
    df = ALL[name](spark, SF)
    found = db.execute(ORACLE[name])
    order = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert comparable([tuple(r) for r in df.collect()]) == comparable([tuple(r[i] for i in order) for r in found.fetchall()])


def test_entry(spark) -> None:  # noqa: ANN001
    df = entry.entry(spark)
    assert df.columns == ["_id", "status", "totalPrice", "items"] and 0 < df.count() <= 20
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(workload.QUERIES) <= set(entry.queries())


def test_plans(spark) -> None:  # noqa: ANN001
    """Filters and columns reach the scan; top-N is limited before it is shuffled; relation predicates are semi joins."""
    e = workload.engine(spark, SF)
    plan = e.explain("Order($condition:@c){ status }", {"c": {"status": "F", "totalPrice": {"$gt": 5}}})
    assert "GreaterThan(o_totalprice,5.0)" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_orderpriority" not in plan and "Exchange" not in plan
    top = e.explain("Customer{ orders($sort:@s,$limit:@l){ totalPrice } }", {"s": {"totalPrice": -1}, "l": 2})
    assert "WindowGroupLimit" in top
    assert "LeftSemi" in e.explain("Customer($condition:@c){ _id }", {"c": {"orders": {"$exists": True}}})
    assert "orders" not in e.explain("Customer{ name }") and "Python" not in e.explain("LineItem{ netPrice }")
    assert "TakeOrderedAndProject" in e.explain("Order($sort:@s,$limit:@l){ status }", {"s": {"totalPrice": -1}, "l": 5})


EVENT = model_of({"name": "E", "collection": "e", "idType": "long", "timestamps": False, "archive": False, "fields": {"at": "date", "kind": "string", "v": "double"}})


def test_streams(spark, tmp_path) -> None:  # noqa: ANN001
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = F.to_timestamp_ntz(F.concat(F.lit("2024-01-01 00:"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(":00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    spark.range(60).select(F.col("id").alias("_id"), day.alias("at"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), F.col("id").cast("double").alias("v")).write.parquet(source)
    rows = live.stream(spark, Sources(spark, {"default": Source("parquet")}), EVENT, source)
    kept = live.matching(rows, {"v": {"$lt": 40}})
    made = live.windowed(kept, EVENT, "at", "10 minutes", {"by": ["kind"], "agg": {"n": {"$count": "*"}, "t": {"$sum": "v"}}})
    live.append(made, out, str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(out)
    assert got.agg(F.sum("n")).first()[0] == 30  # the last window waits for later rows
    first = live.first_of_each(rows, "kind", "at", "2 hours")
    live.append(first, str(tmp_path / "out2"), str(tmp_path / "ck2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 2
    with pytest.raises(ShapeError):
        live.windowed(rows, EVENT, "at", "10 minutes", {"by": ["a.b"]})
