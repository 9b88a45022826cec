"""Exact top-k by tiles: blocks of queries times shards of candidates, a selection for each tile, and a tree merge of the lists.

Vectors are packed into shards of SHARD rows and, of those, queries into blocks of BLOCK rows; both are written to the shared
folder. A tile is a block and a shard that a join on the cells of a grid brings together: one matrix product, from which each query's k best are
selected. Lists of a query are merged by rounds, FAN at a time, so no task gets all lists of a query and nothing is broadcast. Each tile needs memory for one
block, one shard and a slice of their product. A query set that is a share of the rows makes rows times queries products, which is
what an exact search asks for; the shuffle copies blocks to the grid's columns and shards to its rows, which for T tasks is about sqrt(T) copies.

Components become floor(256 * x), x as double. Products are exact: in doubles where no sum can reach 2^53, in Python's integers
beyond; a returned score outside a long is an error. Vectors that are null or hold null or non-finite components take no part; vectors of
different lengths are never compared. A row is told from others by its place in its shard, so rows with one id or one vector are
candidates of each other; ties go to the smaller id. Null ids take part as candidates after all others, and never as queries. An
input without rows or queries gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.base import stored, table

SHARD, BLOCK, FAN, SCALE, NULL_ID = 8192, 1024, 16, 256, np.iinfo(np.int64).max
PACKED = "shard long, dim int, n int, ids binary, vectors binary"


def scaled(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and their vectors as doubles of floor(SCALE * x)."""
    flat = vectors.flatten()
    bad = np.array(flat.is_null()) | ~np.isfinite(np.array(flat.to_numpy(zero_copy_only=False), float)) if len(flat) else np.zeros(0, bool)
    values = np.floor(SCALE * np.nan_to_num(np.array(flat.to_numpy(zero_copy_only=False), np.float64)))
    lens = np.array(vectors.value_lengths().fill_null(0))
    ends = np.cumsum(lens)
    none = np.concatenate([[0], np.cumsum(bad)])
    ok = ~np.array(vectors.is_null()) & (none[ends] == none[ends - lens])
    rows = np.flatnonzero(ok)
    return rows, [values[ends[i] - lens[i] : ends[i]] for i in rows]


def shards(df: DataFrame, id_col: str, vector_col: str, size: int = SHARD) -> DataFrame:
    """PACKED rows: vectors of one length; little-endian int64 ids and float64 components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        first, made = TaskContext.get().partitionId() << 32, 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = held.pop(dim)
            made += 1
            row = (first + made, dim, len(ids), np.array(ids, "<i8").tobytes(), np.array(vectors, "<f8").tobytes())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            ids = np.array(batch.column(0).fill_null(NULL_ID))
            rows, vectors = scaled(batch.column(1))
            for i, v in zip(ids[rows], vectors, strict=True):
                own = held.setdefault(len(v), ([], []))
                own[0].append(i)
                own[1].append(v)
                if len(own[0]) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    double = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), double.alias("vector")).mapInArrow(run, PACKED)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= low)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products [len(q), len(c)] of whole doubles, as int64, or as Python's integers where some don't fit."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return whole.astype(np.int64) if all(-(2**63) <= x < 2**63 for x in whole.flat) else whole


LISTS = "q_shard long, q_place int, query_id long, lot long, ids array<long>, scores array<long>"


def _tiles(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                qi, qp, ci = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_places"], "<i4"), np.frombuffer(r["ids"], "<i8")
                q, c = np.frombuffer(r["q_vectors"], "<f8").reshape(len(qi), dim), np.frombuffer(r["vectors"], "<f8").reshape(len(ci), dim)
                out = []
                for at in range(0, len(q), 128):
                    for j, s in enumerate(products(q[at : at + 128], c), at):
                        ids, own = ci, r["q_shard"] == r["shard"]
                        if own:
                            ids, s = np.delete(ci, qp[j]), np.delete(s, qp[j])
                        top = best(s, ids, k)
                        if s.dtype == object and any(not -(2**63) <= x < 2**63 for x in s[top]):
                            raise OverflowError("a score doesn't fit a long")
                        out.append((r["q_shard"], int(qp[j]), int(qi[j]), r["lot"], ids[top], s[top]))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LISTS.split(", ")])

    return run


def top_k(df: DataFrame, query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the rows for which query, an expression over the long column id, holds."""
    spark = df.sparkSession
    packed = stored(shards(df, id_col, vector_col, shard), "shards")

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, vectors = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(r["n"], r["dim"])
                places = np.array(sorted(r["chosen"]), np.int64)
                for at in range(0, len(places), block):
                    p = places[at : at + block]
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"]]), pa.array([r["dim"]], pa.int32()), pa.array([ids[p].tobytes()], pa.binary()), pa.array([p.astype("<i4").tobytes()], pa.binary()), pa.array([vectors[p].tobytes()], pa.binary())], names=["q_shard", "dim", "q_ids", "q_places", "q_vectors"])

    rows = packed.mapInArrow(_places, "shard long, id long, place int").where("id <> %d" % NULL_ID)
    chosen = rows.where(query).groupBy("shard").agg(F.collect_list("place").alias("chosen"))
    asked = stored(packed.join(chosen, "shard").mapInArrow(queries, "q_shard long, dim int, q_ids binary, q_places binary, q_vectors binary"), "queries")
    # A grid of tasks: a block goes to one row and every column of it, a shard to one column and every row, so that tiles are dealt out
    # evenly. The number of columns is what copies the least.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = packed.agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows")).first()
    total, sought = size["shards"], asked.agg(F.sum(F.length("q_places") / 4)).first()[0] or 1
    columns = int(min(tasks, max(1, round((tasks * (size["rows"] or 1) / sought) ** 0.5))))
    rows_of_grid = -(-tasks // columns)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = asked.withColumn("row", F.pmod(F.xxhash64("q_shard", "q_places"), F.lit(rows_of_grid)).cast("int")).withColumn("column", every(columns))
    dealt = packed.select("shard", "dim", "ids", "vectors", F.pmod(F.xxhash64("shard"), F.lit(columns)).cast("int").alias("column"), F.pmod(F.xxhash64("shard", F.lit(1)), F.lit(max(total, 1))).alias("lot")).withColumn("row", every(rows_of_grid))
    grid = ["dim", "row", "column"]
    tiles = blocks.repartition(tasks, *grid).join(dealt.repartition(tasks, *grid), grid)
    lists = stored(tiles.mapInArrow(_tiles(k), LISTS), "lists")
    order = lambda a, b: F.when((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["id"] < b["id"])), -1).when((a["score"] == b["score"]) & (a["id"] == b["id"]), 0).otherwise(1)
    most = max(total - 1, 0)
    while True:
        both = F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id"))
        lists = lists.select("q_shard", "q_place", "query_id", F.floor(F.col("lot") / fan).alias("lot"), both.alias("list"))
        lists = lists.groupBy("q_shard", "q_place", "query_id", "lot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("list")), order), 1, k).alias("list"))
        lists = lists.select("q_shard", "q_place", "query_id", "lot", F.col("list.id").alias("ids"), F.col("list.score").alias("scores"))
        most //= fan
        if not most:
            break
    found = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "x"))
    vec_id = F.when(F.col("x.ids") != NULL_ID, F.col("x.ids"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), vec_id.alias("vec_id"), F.col("x.scores").alias("score"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["shard"])), pa.array(ids), pa.array(np.arange(len(ids), dtype=np.int32))], names=["shard", "id", "place"])


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.expr("id % 50 = 0"), 5)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
QUERIES = {"op4_topk": op4_topk}
ORACLE = {"op4_topk": SQL}
