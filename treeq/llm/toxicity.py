"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic text and one on ordinary text.

A window is a word in a fixed carrier, which spares its compressed length the fixed costs of a frame. A window of toxic text is
shorter under the toxic dictionary than under the ordinary one. An unbroken run of more than CLIP letters, as in scripts without
spaces, is no one word: it gives windows of PART letters, each STEP letters on, so that no letter goes unread. What their lengths say is
calibrated apart from words, on such runs of the training texts and on the different words of RUN_DOCS texts of each class run together. Three fifths of the training texts make the dictionaries, the rest
calibrates: the log-odds that a word with such two lengths comes from a toxic text. A text's score is a logistic function, fitted
on that rest, of its highest log-odds, its next ones and their share of its words, moved so that THRESHOLD is where F1 is highest.

The toxic dictionary's samples are words with pieces (PIECE characters) that toxic texts have far more often than ordinary texts;
the ordinary dictionary's samples are words of ordinary texts, and among them all that hold such a piece.

Training reads at most SAMPLE_DOCS labelled documents of each class, the ones with the least hash of their id among the rows that
may be learned from, and all words of these. Scoring is a map over whole texts without shuffle; a worker
holds one slice of a batch and a cache of words with a fixed bound.

Null and empty texts, and texts without letters, are scored like a text of no words. Without labels of both classes every score is
the share of label 1 among the training rows, 0 if there are none. Null ids and labels are not learned from. Rows may repeat; of the texts
of one id the one with the least words counts.

Windows of several words don't tell: with dictionaries trained on whole texts, windows of 4 or 8 words found 3 to 11 of 100 held-out toxic
texts of sf0.1 at 0.5 to 2 % of clean ones, as a toxic word saves fewer bytes than other words of a window differ by chance.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.base import by_batch, table, text_or_empty

SAMPLE_DOCS, CACHE = 3000, 200_000
CARRIER, PIECE, LIFT, ORDINARY_BYTES, TOXIC_BYTES = " the of and to ", 5, 3.0, 64 << 10, 16 << 10
WORD = re.compile(r"[^\W\d_]+")
LONGEST, CLIP, PART, STEP, RUN_DOCS = 24, 40, 12, 3, 300
#: Stands before a part of a long run.
MARK = "+"
THRESHOLD = 0.7


def parts_of(run: str) -> list[str]:
    """Overlapping parts of a run that cover it."""
    return [MARK + run[i : i + PART] for i in [*range(0, len(run) - PART, STEP), max(len(run) - PART, 0)]]


def words_of(text: str) -> list[str]:
    """The runs of letters; those longer than CLIP as their parts."""
    runs = WORD.findall(text.lower())
    if not runs or len(max(runs, key=len)) <= CLIP:
        return runs
    return [p for w in runs for p in (parts_of(w) if len(w) > CLIP else [w])]


def pieces(word: str) -> list[str]:
    x = f" {word.removeprefix(MARK)} "
    return [x[i : i + PIECE] for i in range(len(x) - PIECE + 1)]


def window(word: str) -> bytes:
    return f"{CARRIER}{word.removeprefix(MARK)} ".encode()


class Lengths:
    """Compressed lengths of a window under both dictionaries, as one number."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.of = [self._compressor(d) for d in (ordinary, toxic)]
        self.base = [len(c.compress(CARRIER.encode())) for c in self.of]

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(dictionary)
        p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=13, chain_log=13, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def cell(self, word: str) -> int:
        """The word's size, its ordinary length and how much shorter its toxic length is, each in a bounded range."""
        w = window(word)
        a, b = (len(c.compress(w)) - base for c, base in zip(self.of, self.base, strict=True))
        size = LONGEST if word.startswith(MARK) else min(len(word.encode()), LONGEST - 1)
        return (size * 32 + min(max(a, 0), 31)) * 16 + min(max(a - b + 4, 0), 15)


CELLS, WORD_CELLS = (LONGEST + 1) * 32 * 16, LONGEST * 32 * 16  # the last are of parts of long runs


class Model(NamedTuple):
    prior: float
    ordinary: bytes = b""
    toxic: bytes = b""
    odds: np.ndarray = np.zeros(0, np.float32)  # by cell
    weights: np.ndarray = np.zeros(0)


def _dictionary(samples: list[bytes], most: int) -> bytes:
    total = sum(map(len, samples))
    for size in (min(most, total // 4), min(most, total // 10), 1024, 512):
        try:
            return zstandard.train_dictionary(max(size, 256), samples).as_bytes()
        except zstandard.ZstdError:  # too few samples for this size
            continue
    return b"".join(dict.fromkeys(samples))[-most:] or b" "


def _mixed(docs: list[Iterable[str]]) -> list[str]:
    """The words of all documents in a fixed order without alphabet, as the trainer keeps its last samples for a test."""
    words = [w for ws in docs for w in sorted(ws)]
    keys = np.fromiter((zlib.crc32(f"{i} {w}".encode()) for i, ws in enumerate(docs) for w in sorted(ws)), np.uint32, len(words))
    return [words[k] for k in np.argsort(keys, kind="stable")]


def dictionaries(toxic: list[Iterable[str]], ordinary: list[Iterable[str]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic), from the different words of texts."""
    in_toxic, in_ordinary = (Counter(g for ws in docs for g in {g for w in ws for g in pieces(w)}) for docs in (toxic, ordinary))
    nt, no = len(toxic) + 1, len(ordinary) + 1
    telling = {g for g, n in in_toxic.items() if n >= 2 and math.log(n / nt / ((in_ordinary[g] + 0.5) / no)) > LIFT}
    tells = lambda w: any(g in telling for g in pieces(w))
    every, cold = _mixed(toxic), _mixed(ordinary)
    hot = [w for w in every if tells(w)] or every
    near = [w for w in cold if tells(w)]
    return _dictionary([window(w) for w in near * 3 + cold], ORDINARY_BYTES), _dictionary([window(w) for w in hot], TOXIC_BYTES)


def text_features(odds: np.ndarray) -> np.ndarray:
    """odds: of a text's words, repeats included."""
    if not len(odds):
        return np.array([0.0, 0.0, 0.0, 0.0, 1.0])
    top = np.sort(odds)[-4:][::-1]
    hits = np.maximum(odds, 0)
    return np.array([top[0], top[1:].sum() / 3, math.log1p(200 * hits.sum() / len(odds)), math.log1p(len(odds)) / 4, 1.0])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    return w


def fit(texts: list[tuple[dict[str, int], int]]) -> Model:
    """texts: (words with their numbers, label). The same texts in the same order give the same model."""
    y = np.array([x for _, x in texts])
    if len(set(y.tolist())) < 2 or min(y.sum(), (1 - y).sum()) < 2:
        return Model(float(y.mean()) if len(y) else 0.0)
    half = np.zeros(len(y), int)  # 0: for the dictionaries, 1: for the calibration
    for label in (0, 1):
        mine = np.flatnonzero(y == label)
        half[mine] = np.arange(len(mine)) % 5 >= 3
    made = dictionaries(*([w.keys() for (w, l), f in zip(texts, half, strict=True) if l == label and not f] for label in (1, 0)))
    own, seen, cells = Lengths(*made), {}, []
    for i in np.flatnonzero(half):
        for w in texts[i][0]:
            if w not in seen:
                seen[w] = own.cell(w)
        cells.append((np.array([seen[w] for w in texts[i][0]], int), np.array([*texts[i][0].values()], int)))
    share, docs = [np.zeros(CELLS), np.zeros(CELLS)], np.ones((2, CELLS))  # texts with a cell, and texts that could have it
    for (c, _), label in zip(cells, y[half == 1], strict=True):
        np.add.at(share[label], np.unique(c), 1)
        docs[label, :WORD_CELLS] += 1
        docs[label, WORD_CELLS:] += bool((c >= WORD_CELLS).any())
    for i in np.concatenate([np.flatnonzero((half == 1) & (y == label))[:RUN_DOCS] for label in (0, 1)]):
        joined = "".join(w for w in texts[i][0] if not w.startswith(MARK))
        if len(joined) > CLIP:
            np.add.at(share[y[i]], np.unique([own.cell(p) for p in set(parts_of(joined))]), 1)
            docs[y[i], WORD_CELLS:] += 1
    odds = np.log((share[1] + 0.1) / docs[1] / ((share[0] + 0.1 * docs[0] / docs[1] + 0.5) / docs[0])).astype(np.float32)
    for cells_of in (slice(0, WORD_CELLS), slice(WORD_CELLS, CELLS)):
        t, o = share[1][cells_of], share[0][cells_of]
        odds[cells_of][(t + o) == 0] = _unseen([o, t], docs[:, cells_of.start])
    x, of = np.stack([text_features(np.repeat(odds[c], n)) for c, n in cells]), y[half == 1]
    weights = _fit(x, of.astype(float))
    weights[-1] += math.log(THRESHOLD / (1 - THRESHOLD)) - _cut(x @ weights, of)
    return Model(float(y.mean()), *made, odds, weights)


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in z where calling all above it toxic has the highest F1."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # no gap
    k = int(f1.argmax())
    return float(z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2


def _unseen(share: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """For cells without training words: the odds of all cells that save as much."""
    saved = np.arange(len(share[0])) % 16
    t, o = (np.bincount(saved, s, 16) for s in share)
    odds = np.log((t + 0.1) / words[1] / ((o + 0.1 * words[0] / words[1] + 0.5) / words[0]))
    return np.minimum(odds, 1.0)[saved][(share[0] + share[1]) == 0]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}
        self.lengths = Lengths(model.ordinary, model.toxic) if len(model.weights) else None

    def __call__(self, text: str) -> float:
        if self.lengths is None:
            return self.model.prior
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, cell = self.cache, self.lengths.cell
        ws = words_of(text)
        for w in set(ws):
            if w not in cache:
                cache[w] = cell(w)
        x = text_features(self.model.odds[np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))])
        return float(1 / (1 + math.exp(-min(max(float(x @ self.model.weights), -30), 30))))


@lru_cache(maxsize=1)
def _scorer(prior: float, ordinary: bytes, toxic: bytes, odds: bytes, weights: bytes) -> Scorer:
    return Scorer(Model(prior, ordinary, toxic, np.frombuffer(odds, np.float32), np.frombuffer(weights)))


def learnable(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels (id, label 0/1); only rows with learnable() ids are used. At most 2 * SAMPLE_DOCS ids are broadcast, and their words collected."""
    may = labels.where(learnable(id_col) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    picked = [may.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = docs.where(learnable(id_col)).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(ids), "_id")

    def words(batch: pa.RecordBatch) -> dict:
        rows = [Counter(words_of(t)) for t in batch.column(1).to_pylist()]  # in the order of the text
        return {"_id": batch.column(0), "_y": batch.column(2), "_words": [" ".join(c) for c in rows], "_n": pa.array([list(c.values()) for c in rows], pa.list_(pa.int32()))}

    one = by_batch(texts.select("_id", "_text", "_y"), words, f"_id {dict(docs.dtypes)[id_col]}, _y int, _words string, _n array<int>")
    got = one.groupBy("_id", "_y").agg(F.min(F.struct("_words", "_n")).alias("_least")).select("_id", "_y", "_least.*").collect()
    key = lambda r: (zlib.crc32(str(r["_id"]).encode()), str(r["_id"]), r["_y"])
    return fit([({sys.intern(w): n for w, n in zip(r["_words"].split(" "), r["_n"], strict=True)} if r["_words"] else {}, r["_y"]) for r in sorted(got, key=key)])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col double, between 0 and 1; a column that has this name already is replaced."""
    docs = docs.drop(score_col)
    names = docs.columns
    flat = (model.prior, model.ordinary, model.toxic, model.odds.astype(np.float32).tobytes(), np.asarray(model.weights, float).tobytes())

    def run(batch: pa.RecordBatch) -> dict:
        own = _scorer(*flat)
        return dict(zip(names, batch.columns, strict=True)) | {score_col: pa.array([own(t or "") for t in batch.column(names.index(text_col)).to_pylist()], pa.float64())}

    return by_batch(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{score_col}` double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~F.coalesce(learnable(), F.lit(True))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
