"""SimHash near-duplicates by anchor points of covering codes.

A fingerprint has 64 bits: 23 + 23 + 18. The binary Golay code covers 23 bits with radius 3, and every 23-bit word lies within 3 of
exactly one codeword, its home. If two words differ in e bits, the home of the one lies within 3 + e of the other, so a fingerprint
that is copied to every anchor within the covering radius plus the threshold meets, at the other's home, all that it may link to.
Two products of codes share the threshold of 2 bits out among the parts:

* the 18 bits are equal: anchors are (18 bits as they are, codeword of part 1); copies go to codewords within 3 + 2;
* else at most one bit is left for the other parts: anchors are (codeword of part 1, codeword of part 2); copies go to
  codewords within 3 + 1 and 3 + 0, or 3 + 0 and 3 + 1.

That makes 2 home rows and 31 copies of 16 bytes for each different fingerprint, whatever the data. Equal fingerprints are one
before that, so exact copies cost nothing here. An anchor with many homes is split into blocks of homes, and the copies go to each
block; a block compares its copies in a stream and keeps, of the links it finds, a spanning forest, never all pairs.

Null and empty texts have fingerprint zero and link like any other. A text of fewer words than a shingle is one shingle. Rows may
repeat and ids may repeat or be null: a component's id is its least non-null id. An input without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.base import by_batch, release, stored, table, text_or_empty
from treeq.llm.components import components

SEED, BITS, CODE, CHECK, RADIUS, THRESHOLD = 42, 64, 23, 11, 3, 2
#: The generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101
BLOCK, SMALL, PAIRS = 2048, 64, 1 << 20
BANDS, SAMPLE = 14, 3
#: Links between texts, by text_node().
LINKS = "a binary, b binary"
#: Texts and different shingles of one block of a bucket; a tile compares two blocks.
TEXTS, SHINGLES, COLUMNS = 256, 1 << 20, 4096


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of so many words, lower-cased in A-Z and split at ASCII white space; repeats included."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in runs), np.uint64, max(1, len(w) - words + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": pa.array([_signed(fingerprint(shingle_hashes(t, words))) for t in batch.column(1).to_pylist()], pa.int64())}

    return by_batch(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: where its error patterns start; the patterns by weight up to RADIUS + THRESHOLD; how many have weight up to RADIUS + 1. And the syndrome of each half word.

    The first pattern of a syndrome is the only one of weight RADIUS or less, as the code is perfect.
    """

    def syndrome(x: int) -> int:
        for i in range(CODE - 1, CHECK - 1, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - CHECK)
        return x

    one = [syndrome(1 << i) for i in range(CODE)]
    found: list[tuple[int, int, int]] = []
    for weight in range(RADIUS + THRESHOLD + 1):
        for at in combinations(range(CODE), weight):
            s = e = 0
            for i in at:
                s, e = s ^ one[i], e | 1 << i
            found.append((s, weight, e))
    found.sort()
    s, weight, e = np.array(found, np.int64).T
    starts = np.searchsorted(s, np.arange((1 << CHECK) + 1))
    near = np.searchsorted(s * 8 + weight, np.arange(1 << CHECK) * 8 + RADIUS + 1, side="right") - starts[:-1]
    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    return starts, e, near, np.concatenate([low, high])


def _syndromes(x: np.ndarray) -> np.ndarray:
    t = golay()[3]
    return t[x & 0xFFF] ^ t[4096 + (x >> 12)]


def _homes(x: np.ndarray) -> np.ndarray:
    starts, e, _, _ = golay()
    return x ^ e[starts[_syndromes(x)]]


def _within(x: np.ndarray, excess: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each word the codewords within RADIUS + excess of it, without the first skip (1: its home): row numbers and codewords."""
    starts, e, near, _ = golay()
    s = _syndromes(x)
    n = (near[s] if excess == 1 else starts[s + 1] - starts[s]) - skip
    rows = np.repeat(np.arange(len(x)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s] + skip, n)
    return rows, x[rows] ^ e[k]


def _parts(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = fp.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << CODE) - 1)
    return (u & mask).astype(np.int64), (u >> np.uint64(CODE) & mask).astype(np.int64), (u >> np.uint64(2 * CODE)).astype(np.int64)


def anchors(fp: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the anchors that are home to each fingerprint, or that it is copied to: row numbers and keys."""
    p1, p2, p3 = _parts(fp)
    first = lambda a3, a1: a3 << CODE | a1
    second = lambda a1, a2: 1 << 62 | a1 << CODE | a2
    every, h1, h2 = np.arange(len(fp)), _homes(p1), _homes(p2)
    if home:
        return np.concatenate([every, every]), np.concatenate([first(p3, h1), second(h1, h2)])
    r, c = _within(p1, 2)
    r1, c1 = _within(p1, 1)
    r2, c2 = _within(p2, 1, skip=1)
    return np.concatenate([r, r1, r2]), np.concatenate([first(p3[r], c), second(c1, h2[r1]), second(h1[r2], c2)])


def _anchored(fps: DataFrame, home: bool) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy()
        rows, keys = anchors(fp, home)
        return {"key": pa.array(keys), "fp": pa.array(fp[rows])}

    return by_batch(fps.select("fp"), run, "key long, fp long", slice_bytes=1 << 18)


def _forest(homes: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between one anchor's homes and copies that join all that its links join; len(homes) + len(copies) at most."""
    label, out = np.arange(len(homes)), []
    for at in range(0, len(copies), 512):
        part = copies[at : at + 512]
        c, h = np.nonzero((np.bitwise_count(part[:, None] ^ homes[None, :]) <= THRESHOLD) & (part[:, None] < homes[None, :]))
        if not len(c):
            continue
        first = np.concatenate([[True], c[1:] != c[:-1]])
        out.append((part[c[first]], homes[h[first]]))
        lead = h[first][np.cumsum(first) - 1]
        while len(apart := np.flatnonzero(label[lead] != label[h])):
            k = apart[0]
            out.append((part[c[k : k + 1]], homes[h[k : k + 1]]))
            label[label == label[h[k]]] = label[lead[k]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (copies[:0], copies[:0])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sub, copy): links between homes and copies of an anchor. Holds a batch and the homes of one block."""
    kept: tuple[tuple[int, int] | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        key, sub, copy, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        fp = fp.astype(np.int64).view(np.uint64)
        if kept[0] == (key[0], sub[0]):
            n = len(kept[1])
            key, sub, copy, fp = np.concatenate([np.full(n, key[0]), key]), np.concatenate([np.full(n, sub[0]), sub]), np.concatenate([np.zeros(n, copy.dtype), copy]), np.concatenate([kept[1], fp])
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]))
        ends = np.append(starts[1:], len(key))
        done = np.concatenate([[0], np.cumsum(copy == 0)])
        n_homes = done[ends] - done[starts]
        n_copies = ends - starts - n_homes
        kept = (key[-1], sub[-1]), fp[starts[-1] : starts[-1] + n_homes[-1]]
        found = []
        small = np.flatnonzero((n_homes > 0) & (n_homes <= SMALL) & (n_copies > 0))
        pairs = np.cumsum(n_homes[small] * n_copies[small])
        for lot in np.split(small, np.searchsorted(pairs, np.arange(PAIRS, pairs[-1] if len(pairs) else 0, PAIRS))):
            if not len(lot):
                continue
            rows = np.repeat(starts[lot] + n_homes[lot] - np.concatenate([[0], np.cumsum(n_copies[lot])[:-1]]), n_copies[lot]) + np.arange(n_copies[lot].sum())
            per = np.repeat(n_homes[lot], n_copies[lot])
            first = np.repeat(starts[lot], n_copies[lot])
            h = np.repeat(first - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
            x, y = fp[np.repeat(rows, per)], fp[h]
            ok = (x < y) & (np.bitwise_count(x ^ y) <= THRESHOLD)
            found.append((x[ok], y[ok]))
        for g in np.flatnonzero((n_homes > SMALL) & (n_copies > 0)):
            mid = starts[g] + n_homes[g]
            found.append(_forest(fp[starts[g] : mid], fp[mid : ends[g]]))
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """fps (fp: long, all different) -> (a, b): links of THRESHOLD bits or fewer, as many as keep all of them connected."""
    homes, copies = _anchored(fps, home=True), _anchored(fps, home=False)
    crowded = stored(homes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")
    if crowded.isEmpty():
        homes, copies = (x.select("key", F.lit(0).alias("sub"), "fp") for x in (homes, copies))
    else:
        homes = homes.join(crowded, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0)).alias("sub"), "fp")
        copies = copies.join(crowded, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("sub"), "fp")
    rows = homes.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1))).select("key", "sub", "copy", "fp")
    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub", "copy").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of every row: the least id that links of THRESHOLD bits or fewer lead to."""
    prints = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = stored(least, "distinct")
    roots = components(links(least)).withColumnRenamed("node", "fp")
    rooted = stored(least.join(roots, "fp"), "rooted")
    joined = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    by_print = stored(least.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def text_node(text_col: str = "text") -> Column:
    """A text's identity: its MD5, 16 bytes; a null text is an empty one."""
    return F.unhex(F.md5(text_or_empty(text_col)))


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, fp, size, bands array<long>): node is text_node(), size the number of its different shingles; each band is the SimHash of the SAMPLE different shingles that are least under its own order."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(h: np.ndarray) -> list[int]:
        out = []
        for m in odd:
            mixed = h * m
            mixed ^= mixed >> np.uint64(29)
            mixed *= m
            least = h[np.argpartition(mixed, SAMPLE - 1)[:SAMPLE]] if len(h) > SAMPLE else h
            out.append(_signed(fingerprint(least)))
        return out

    def run(batch: pa.RecordBatch) -> dict:
        hashes = [shingle_hashes(t, words) for t in batch.column(2).to_pylist()]
        different = [np.unique(h) for h in hashes]
        return {"doc_id": batch.column(0), "node": batch.column(1), "fp": pa.array([_signed(fingerprint(h)) for h in hashes], pa.int64()), "size": pa.array(map(len, different), pa.int64()), "bands": pa.array(map(bands, different), pa.list_(pa.int64()))}

    return by_batch(docs.select(F.col(id_col).alias("doc_id"), text_node(text_col).alias("node"), text_or_empty(text_col).alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, node binary, fp long, size long, bands array<long>")


def jaccard(a: str, b: str, words: int) -> float:
    x, y = (set(shingle_hashes(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common: [n, n]. Elements of one set are different."""
    n = len(sets)
    values, owners = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    places = np.cumsum(shared) - 1
    owners, column = owners[shared[column]], places[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owners, column, out = owners[order], column[order], np.zeros((n, n))
    cuts = np.searchsorted(column, np.arange(0, shared.sum() + COLUMNS, COLUMNS))
    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((n, COLUMNS if shared.sum() > COLUMNS else max(1, shared.sum())), np.float32)
        held[owners[x:y], column[x:y] - k * COLUMNS] = 1
        out += held @ held.T
    return out


def tile_links(sets: list[np.ndarray], groups: np.ndarray, blocks: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Places of links that join all groups which pairs of at least this Jaccard share join. Pairs of one group are not looked at, nor, if there are two blocks, pairs of one block."""
    size = np.array([len(x) for x in sets])
    met = shared_counts(sets)
    union = size[:, None] + size[None, :] - met
    ok = np.where(union > 0, met / np.maximum(union, 1), 1.0) >= least
    if blocks.min() < blocks.max():
        ok &= blocks[:, None] != blocks[None, :]
    label, out = np.unique(groups, return_inverse=True)[1], []
    ok &= label[:, None] != label[None, :]
    for i in np.flatnonzero(ok.any(axis=1)):
        for j in np.flatnonzero(ok[i]):
            if label[i] != label[j]:
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return out


def _rest(members: DataFrame, groups: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): links within buckets of which some pairs are neither of one group nor checked, in tiles of two blocks of a bucket.

    members (band, value, node, size); groups (node, root); texts (node, text) of all of them. Buckets of the same members are one.
    """
    spark = members.sparkSession
    placed = stored(members.join(groups.toDF("node", "root"), "node", "left").select("band", "value", "node", F.coalesce("root", "node").alias("root"), "size"), "placed")
    made = placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"))
    open_ = made.where("n > 2 and r1 <> r2").groupBy("n", "weight", "x1", "x2").agg(F.min(F.struct("band", "value")).alias("at"))
    blocks = F.greatest(F.ceil(F.col("n") / TEXTS), F.ceil(F.col("weight") / SHINGLES)).cast("int")
    open_ = stored(open_.select("at.band", "at.value", blocks.alias("blocks")), "open")
    if open_.isEmpty():
        return spark.createDataFrame([], LINKS)
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    inside = placed.join(open_, ["band", "value"]).select("band", "value", "node", "root", "blocks", block.alias("block"))
    tiled = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block")
    tiled = stored(tiled, "tiled")
    rows = tiled.join(texts, "node").select("band", "value", "i", "j", "node", "root", "block", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links_of() -> pa.RecordBatch:
            labels: dict[bytes, int] = {}
            roots = np.array([labels.setdefault(r, len(labels)) for _, r, _, _ in held])
            found = tile_links([h for _, _, _, h in held], roots, np.array([k for _, _, k, _ in held]), least) if len(labels) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[p[side]][0] for p in found], pa.binary()) for side in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for own, node, root, at, text in zip(keys, *(batch.column(i).to_pylist() for i in (4, 5, 6)), batch.column(7), strict=True):
                if own != key:
                    if held:
                        yield links_of()
                    key, held = own, []
                held.append((node, root, at, np.unique(shingle_hashes(text.as_py(), words))))
        if held:
            yield links_of()
        release()

    return rows.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j").mapInArrow(run, LINKS)


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, component_id, first boolean) of every row: components of links whose texts have at least this share of their different shingles in common.

    Texts that alike differ in far more than THRESHOLD bits of their SimHash (3 to 14 were measured), so candidates are texts whose
    fingerprints links of THRESHOLD bits join and, besides, texts of which one band is equal: with BANDS bands of SAMPLE shingles a
    pair of 0.8 is missed once in 10,000 times. Each such bucket is first compared with its least member, which makes one group of a
    bucket of near copies. In buckets that then still hold several groups, all pairs of different groups are compared, in tiles: every
    pair of a bucket is in one group or checked on whole texts. That is quadratic only in texts which share a bucket but are not alike.
    Rows of one text are one node, told by 128 bits. Only texts that are in candidates are shuffled. first: the row's id and text are the
    component's first, ids in order, nulls last, texts of one id by node. Rows that repeat an id and a text share it.
    """
    made = stored(sketches(docs, words, id_col, text_col), "sketches")
    nodes = stored(made.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")), "nodes")
    linked = components(links(nodes.select("fp").distinct())).toDF("fp", "print")
    banded = nodes.join(linked, "fp", "left").select("node", "size", F.posexplode(F.concat("bands", F.array(F.coalesce("print", "fp")))).alias("band", "value"))
    banded = stored(banded, "bands")
    buckets = stored(banded.groupBy("band", "value").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stored(banded.join(buckets, ["band", "value"]), "members")
    pairs = stored(members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    text = text_or_empty(text_col)
    mine = docs.select(text_node(text_col).alias("node"), text.alias("text"))
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    texts = stored(mine.join(wanted, "node").groupBy("node").agg(F.any_value("text").alias("text")), "texts")
    met = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batch: pa.RecordBatch) -> dict:
        keep = [jaccard(x, y, words) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return {k: batch.column(i).filter(pa.array(keep, pa.bool_())) for i, k in enumerate("ab")}

    alike = stored(by_batch(met.select("a", "b", "ta", "tb"), run, LINKS), "alike")
    roots = components(alike)
    more = stored(_rest(members.where("n > 2").select("band", "value", "node", "size"), roots, texts, words, least), "more")
    if not more.isEmpty():
        roots = components(alike.unionByName(more))
    roots = roots.withColumnRenamed("node", "n")
    rooted = made.select("doc_id", "node").join(roots, F.col("node") == F.col("n"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least")
    least_rows = stored(rooted.groupBy("root").agg(least_row), "components")  # stored: a large component's rows can be split in the join
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node"))
    return rooted.join(least_rows, "root").select("doc_id", "node", F.col("least.doc_id").alias("component_id"), first.alias("first"))


def first_documents(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar_documents(), with all its columns.

    Rows stay or go by id and text, so rows that share an id, or have none, are judged apart. Of rows with the first id and text, the
    least in its other columns stays.
    """
    groups = stored(similar_documents(docs, words, least, id_col, text_col), "groups")
    gone = groups.where(~F.col("first")).select("doc_id", "node").distinct()
    repeated = stored(groups.where("first").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "node"), "repeated")
    same = lambda keys: docs[f"`{id_col}`"].eqNullSafe(keys["doc_id"]) & (F.unhex(F.md5(F.coalesce(docs[f"`{text_col}`"], F.lit("")))) == keys["node"])
    left = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = left.join(repeated, same(repeated), "left_semi").select(F.col(f"`{id_col}`").alias("i"), text_node(f"`{text_col}`").alias("t"), row.alias("row"))
    one = one.groupBy("i", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(repeated, same(repeated), "left_anti").unionByName(one.select("row.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
