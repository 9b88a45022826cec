"""Line dedup over levelled sorted runs of line hashes.

A store holds runs in the shared folder: tables (h, n_docs, last_id, fresh), sorted by h within hash buckets, one row for each line
key. A batch of documents is reduced to one row for each key and merge-anti-joined with the runs: keys that no run has are fresh, and
exactly one run has each key as fresh. Its own run has the fresh keys and the counts for known ones, at level 0. As soon as a level has
FANOUT runs they are merged into one run of the next level, so that each key is rewritten once a level and a lookup reads few runs.

Keys are 128-bit MD5 of the normalised line. Only DataFrame functions are used. Null and empty texts have one empty line. Ids
may repeat: rows of one id count as one document, and lines of every row are judged by themselves. Null ids count as one
document below all others. Lines of any length and number are allowed. An input without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.base import new_path, remove, shared_dir, stored, table, text_or_empty, with_value

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS, FANOUT, BATCHES = 40, 5, 4, 6
RUN = "h binary, n_docs long, last_id long, fresh boolean"


def line_key(line: Column) -> Column:
    """All ASCII white space stripped at both ends, A-Z lower-cased. lower() is the same on ASCII and quicker than translate()."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


class LineStore:
    """Levelled runs under one path."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        shared_dir(spark)

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def keys(self) -> DataFrame:
        """RUN, one row for each key and run."""
        read = self.spark.read.schema(RUN)
        return read.parquet(*runs) if (runs := self.runs()) else self.spark.createDataFrame([], RUN)

    def merged(self) -> DataFrame:
        """RUN, one row for each key."""
        return _merge(self.keys())

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of batch (h, ...) whose key no run has: one merge anti-join with the fresh keys of all runs."""
        return batch.join(self.keys().where("fresh").select("h").hint("merge"), "h", "left_anti") if self.runs() else batch

    def add(self, batch: DataFrame) -> None:
        """batch (h, n_docs, last_id) with one row for each key becomes a run; full levels are compacted."""
        fresh = self.unseen(batch).withColumn("fresh", F.lit(True))
        if self.runs():
            known = batch.join(self.keys().where("fresh").select("h").hint("merge"), "h", "left_semi").withColumn("fresh", F.lit(False))
            fresh = fresh.unionByName(known)
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(_merge(self.spark.read.schema(RUN).parquet(*full)), level + 1)
            for p in full:
                remove(self.spark, p)
            level += 1

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = new_path(self.spark, f"run{level}")
        rows.select("h", "n_docs", "last_id", "fresh").repartition("h").sortWithinPartitions("h").write.parquet(path)
        self.levels[level].append(path)


def _merge(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"), F.bool_or("fresh").alias("fresh"))


def without(lines: Column, places: Column) -> Column:
    """The lines whose place isn't among the different places, joined: what stands between neighbours of the sorted places, in linear time."""
    cuts = F.concat(F.array(F.lit(-1)), F.array_sort(places), F.array(F.size(lines)))
    between = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.slice(lines, F.get(c, k - 1) + 2, F.get(c, k) - F.get(c, k - 1) - 1))
    return F.array_join(F.flatten(with_value(cuts, between)), "\n")


def long_lines(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, at, h): the lines whose key is long enough to be judged; at: their places in the text.

    A line shorter than that before stripping has a shorter key, so most short lines are never normalised.
    """
    text = text_or_empty(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keyed = lines.where(F.char_length("line") >= least_chars).withColumn("key", line_key(F.col("line")))
    return keyed.where(F.char_length("key") >= least_chars).select("doc_id", "text_hash", "at", key_hash(F.col("key")).alias("h"))


def dedup_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", with_rest: bool = False) -> DataFrame:
    """docs (doc_id, text: null as empty) with n_lines, n_dropped and kept, the text without its dropped lines; with_rest: and rest, a struct of all other columns of docs.

    Texts are shuffled once, to meet their dropped places, and are split only then; before that, only hashes are. Documents go to batches by
    their id, so a key's document count is the sum of its batches' counts. Dropping takes time linear in a text's lines.
    """
    spark = docs.sparkSession
    lines = stored(long_lines(docs, least_chars, id_col, text_col), "lines")
    of_doc = lines.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "h", "doc_id").distinct()
    counted = stored(of_doc.groupBy("batch", "h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id")), "batches", by="batch")
    store = LineStore(spark)
    for k in range(batches):
        store.add(counted.where(F.col("batch") == k).select("h", "n_docs", "last_id"))
    common = stored(store.merged().where(F.col("n_docs") >= least_docs).select("h", "last_id"), "common")
    out = lines.join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("last_id"))).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("out"))
    out = out.select(F.col("doc_id").alias("out_id"), F.col("text_hash").alias("out_hash"), "out")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = [(F.struct(*others) if others else F.lit(None).cast("int")).alias("rest")] if with_rest else []
    whole = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *rest)
    met = whole.join(out, F.col("doc_id").eqNullSafe(F.col("out_id")) & (F.xxhash64("text") == F.col("out_hash")), "left")
    kept = F.when(F.col("out").isNull(), F.col("text")).otherwise(with_value(F.split("text", "\n", -1), lambda x: without(x, F.col("out"))))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    return met.select("doc_id", "text", *(["rest"] if with_rest else []), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> last_id AS dropped FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
QUERIES = {"op9_lines": op9_lines}
ORACLE = {"op9_lines": SQL}
