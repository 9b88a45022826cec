from __future__ import annotations

import pytest

from treeq.engine import Engine
from treeq.errors import NotFound, ShapeError
from treeq.sources.registry import Source

ITEM = {"name": "Item", "collection": "items", "idType": "int", "timestamps": False, "archive": False, "fields": {"unitPrice": "double", "name": "string", "missing": "string"}, "physical": {"_id": "item_id", "unitPrice": "unit_price"}}


@pytest.fixture(scope="module")
def items(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(1, 2.5, "a"), (2, 7.0, None)], "item_id int, unit_price double, name string")


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
@pytest.mark.parametrize("database", [None, "shop"])
def test_files(spark, items, tmp_path, kind, database) -> None:  # noqa: ANN001
    folder = f"{tmp_path}/{database}" if database else str(tmp_path)
    frame = items.select("*", items.name.alias("missing")) if kind == "csv" else items  # csv has its columns by place
    options = {"nullValue": "-"} if kind == "csv" else {}
    order = frame.select("item_id", "unit_price", "name", *(["missing"] if kind == "csv" else []))
    order.write.format(kind).options(**options).save(f"{folder}/items.{kind}")
    e = Engine(spark, Source(kind, str(tmp_path), options))
    e.register({**ITEM, "location": {"database": database} if database else {}})
    got = sorted(tuple(r) for r in e.query("Item($condition:@c){ unitPrice, name }", {"c": {"unitPrice": {"$gt": 1}}}).collect())
    assert got == [(1, 2.5, "a"), (2, 7.0, None)]


def test_tables_and_routes(spark, items) -> None:  # noqa: ANN001
    items.createOrReplaceTempView("items")
    e = Engine(spark, {"default": Source("table"), "other": Source("memory", frames={"items": items.limit(0)})})
    e.register(ITEM)
    assert e.count("Item") == 2 and e.count("Item", route={"source": "other"}) == 0
    assert e.query("Item{ missing }").first().missing is None
    with pytest.raises(ShapeError):
        e.count("Item", route={"table": "x"})
    with pytest.raises(NotFound):
        e.count("Item", route={"source": "none"})
    with pytest.raises(ShapeError):
        Source("mongo")
