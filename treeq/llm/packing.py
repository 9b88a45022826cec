"""Packing documents into sequences by bounded-space online best fit.

Each partition keeps at most WINDOWS open sequences. Whole sequences are cut off a long document first. What is left of it goes to
the open window that it fits best; where none has room, a new one is opened, or, if all are open, the fullest is topped up with the
document's start and emitted, and the rest opens a new one. So every sequence a partition emits is full. Its open windows are
merged at the end, GROUP partitions at a time and level by level, by the same rule, until one group is left; in the whole result
at most WINDOWS sequences are not full, and fewer than that after the last fill.

A task holds one slice of a batch, its open windows and a cache of words with a fixed bound. Texts are never shuffled; of their
ids, only those of open windows are. Null and empty texts are documents of the end id alone. Rows and ids may repeat: pieces
carry their document's id, and each row is packed by itself. An input without rows gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeq.llm.base import cut, release, stored, table, text_or_empty

LENGTH, WINDOWS, GROUP, CACHE, STEMS, END_ID = 4096, 8, 32, 400_000, 200_000, 2
#: ASCII punctuation at a word's end, after a letter or digit that normalising leaves one: the pattern of the vocabulary always cuts there.
TAIL = re.compile(r"(?<=[a-zA-Z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff])[!-/:-@\[-`{-~]+\Z")
PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordTokenizer:
    """Ids of texts by a tokenizers file whose matches never span white space, one lookup a word.

    Words are cut at ASCII white space and looked up; unknown ones are encoded by the library, plain lower-case letters by its
    model alone. The cache is emptied when it is full, which changes no result.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        kinds = json.loads(Path(path).read_text())
        parts = kinds["pre_tokenizer"]["pretokenizers"]
        if not ("\\s" in parts[0]["pattern"]["Regex"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and parts[1]["type"] == "ByteLevel"):
            raise ValueError("this tokenizer doesn't drop white space between its matches")
        if [x["type"] for x in kinds["normalizer"].get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer doesn't compose, join white space and lower-case, in this order")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        #: The printable character that stands for each byte in byte-level vocabularies.
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.stems: dict[str, bytes] = {}  # ids as uint32
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 1
        self.starts, self.lens = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64)
        self.flat[0], self.lens[0], self.n = self.end_id, 1, 1  # entry 0 is the end id

    def _stem(self, s: str) -> bytes:
        if (got := self.stems.get(s)) is None:
            if s.isalpha() and max(s) < "̀":
                ids = [t.id for t in self.model.tokenize(s.encode().decode("latin1").translate(self.shown))]
            else:
                ids = self.whole.encode(s, add_special_tokens=False).ids
            if len(self.stems) >= STEMS:
                self.stems.clear()
            got = self.stems[s] = array("I", ids).tobytes()
        return got

    def word(self, w: str) -> bytes:
        """The ids of a word, as uint32."""
        if not w:
            return b""
        if w.isascii() or max(w) < "̀":  # neither composes with what follows when it is lower-cased first
            w = w.lower()
        if "a" <= w[-1] <= "z":
            return self._stem(w)
        tail = TAIL.search(w)
        return self._stem(w[: tail.start()]) + self._stem(tail.group()) if tail else self._stem(w)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and where each text's ids end."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        entries = coded.dictionary.to_pylist()
        if self.n + len(entries) >= CACHE:
            self._clear()
        if self.n + len(entries) >= len(self.starts):
            grow = self.n + len(entries) + 1
            self.starts, self.lens = np.resize(self.starts, grow), np.resize(self.lens, grow)
        get = self.index.get
        known = np.fromiter((get(w, -1) for w in entries), np.int64, len(entries))
        if len(new := np.flatnonzero(known < 0)):
            unknown = [entries[i] for i in new]
            made = [self.word(w) for w in unknown]
            lens = np.fromiter(map(len, made), np.int64, len(made)) // 4
            flat = np.frombuffer(b"".join(made), np.uint32)
            if self.used + len(flat) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat) + len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            known[new] = places = np.arange(self.n, self.n + len(new))
            self.starts[places], self.lens[places] = self.used + np.cumsum(lens) - lens, lens
            self.index.update(zip(unknown, places.tolist(), strict=True))
            self.used, self.n = self.used + len(flat), self.n + len(new)
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        g = np.insert(known[coded.indices.to_numpy()], ends, 0)
        n = self.lens[g]
        total = np.cumsum(n)
        at = np.repeat(self.starts[g] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        return self.flat[at], total[ends + np.arange(len(ends))]


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int) -> WordTokenizer:
    return WordTokenizer(path, end_id)


class Packer:
    """One partition's open windows. add() and finish() yield pieces (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, windows: int) -> None:
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list]] = []
        self.sequences = 0

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for key, start, ids, n in pieces:
            yield key, start, ids, n, self.sequences, at
            at += len(ids)
        self.sequences += 1

    def _put(self, k: int | None, piece: tuple) -> Iterator[tuple]:
        fill, pieces = self.open.pop(k) if k is not None else (0, [])
        fill, pieces = fill + len(piece[2]), [*pieces, piece]
        if fill == self.length:
            yield from self._emit(pieces)
        else:
            self.open.append((fill, pieces))

    def add(self, key: object, ids: np.ndarray, start: int, n: int) -> Iterator[tuple]:
        """ids: of the document's ids, n in all, those from start on that are still to be placed."""
        while len(ids) >= self.length:
            yield from self._emit([(key, start, ids[: self.length], n)])
            ids, start = ids[self.length :], start + self.length
        if not len(ids):
            return
        room = [(self.length - fill, k) for k, (fill, _) in enumerate(self.open)]
        fits = [x for x in room if x[0] >= len(ids)]
        if fits:
            yield from self._put(min(fits)[1], (key, start, ids, n))
            return
        if len(self.open) >= self.windows:
            gap, k = min(room)
            yield from self._put(k, (key, start, ids[:gap], n))
            ids, start = ids[gap:], start + gap
        yield from self._put(None, (key, start, ids, n))

    def finish(self, last: bool) -> Iterator[tuple]:
        """The open windows, fullest first. last: they are filled from each other, so that only one isn't full."""
        left, self.open = sorted(self.open, key=lambda x: -x[0]), []
        if not last:
            for _, pieces in left:
                yield from self._emit(pieces)
            return
        line, fill = [], 0
        for key, start, ids, n in (p for _, pieces in left for p in pieces):
            while len(ids):
                take = min(len(ids), self.length - fill)
                line.append((key, start, ids[:take], n))
                ids, start, fill = ids[take:], start + take, fill + take
                if fill == self.length:
                    yield from self._emit(line)
                    line, fill = [], 0
        if line:
            yield from self._emit(line)


def _rows(kind: pa.DataType, made: list[tuple], first: int, carry: bool, keep_ids: bool) -> dict[str, pa.Array]:
    raw = [np.ascontiguousarray(x[2], "<u4").tobytes() for x in made]
    return {
        "doc_id": pa.array([x[0] for x in made], kind),
        "start": pa.array([x[1] for x in made], pa.int64()),
        "length": pa.array([len(x[2]) for x in made], pa.int64()),
        "ids_crc32": pa.array(map(zlib.crc32, raw), pa.int64()),
        "doc_tokens": pa.array([x[3] for x in made], pa.int64()),
        "sequence_id": pa.array([first + x[4] for x in made], pa.int64()),
        "offset": pa.array([x[5] for x in made], pa.int64()),
        "ids": pa.array([r if carry or keep_ids else None for r in raw], pa.binary()),
        "part": pa.array([(first >> 28) % (1 << 30) if carry else None] * len(made), pa.int64()),
    }


def pack(docs: DataFrame, path: str, *, length: int = LENGTH, windows: int = WINDOWS, group: int = GROUP, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32; null without keep_ids).

    sequence_id is level, partition or group, and count. path: the tokenizers file, on every machine.
    """
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} long" for c in PIECES) + ", ids binary, part long"
    names = [x.split()[0] for x in schema.split(", ")]
    as_batch = lambda made, kind, first, carry: pa.RecordBatch.from_arrays([(r := _rows(kind, made, first, carry, keep_ids))[n] for n in names], names=names) if made else None

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, kind = tokenizer(path, end_id), Packer(length, windows), pa.int64()
        first = TaskContext.get().partitionId() << 28
        for batch in batches:
            kind = batch.column(0).type
            for part in cut(batch, 4 << 20):
                flat, ends = own(part.column(1))
                made, at = [], 0
                for key, end in zip(part.column(0).to_pylist(), ends, strict=True):
                    made += packer.add(key, flat[at:end], 0, int(end - at))
                    at = end
                if made:
                    yield as_batch(made, kind, first, False)
        if made := list(packer.finish(False)):
            yield as_batch(made, kind, first, True)
        release()

    def later_level(level: int, last: bool):  # noqa: ANN202
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            packer, made = Packer(length, windows), []
            first = level << 58 | (t["part"][0].as_py() // group) << 28
            for key, ids, start, n in zip(t["doc_id"].to_pylist(), t["ids"], t["start"].to_pylist(), t["doc_tokens"].to_pylist(), strict=True):
                made += packer.add(key, np.frombuffer(ids.as_buffer(), "<u4"), start, n)
            out = [as_batch(made, t.schema.field("doc_id").type, first, False), as_batch(list(packer.finish(last)), t.schema.field("doc_id").type, first, not last)]
            return pa.Table.from_batches([b for b in out if b is not None])

        return run

    level = stored(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(first_level, schema), "pieces")
    out, k = level.where("part is null"), 0
    while (most := level.agg(F.max("part")).first()[0]) is not None:
        k += 1
        last = most < group
        opened = level.where("part is not null")
        level = stored(opened.groupBy(F.floor(F.col("part") / group)).applyInArrow(later_level(k, last), schema), "pieces")
        out = out.unionByName(level.where("part is null"))
    return out.drop("part")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict[str, str] = {}
