"""Byte-level BPE encoding and decoding by tree reduction.

A text is halved until the parts are leaves, leaves are encoded by themselves, and neighbours are joined by encoding a window
around their seam again. The window grows until the tokens outside it provably stay:

* Between matches of the pattern: seam finds places that always end a match, whatever the rest of the text is. For the patterns of public
  byte-level vocabularies that is SEAM, a place with a non-space before it and an ASCII space or line break after it, as they never look
  behind. The window reaches to the nearest such place on either side. Without one, or without seam, it grows to the end of the part.
* Within one match: a sequence of BPE tokens is the encoding of its bytes if every two neighbours are the encoding of theirs.
  So the window over tokens grows until its outermost tokens are stable next to the tokens outside it.

Decoding concatenates bytes up the same kind of tree. Null and empty texts give no ids. Long texts without any space are joined
inside the match and never encoded as a whole. Repeated rows give repeated results; an input without rows gives none.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from treeq.llm.base import by_batch, table, text_or_empty

LEAF_CHARS, LEAF_BYTES, WINDOW = 2048, 512, 64
SEAM = r"(?<=[^\s\x00-\x20])(?=[ \n])"


class TreeEncoder:
    """encode() gives what Encoding.encode_ordinary of the tiktoken library gives for these ranks and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, window: int = WINDOW, seam: regex.Pattern | None = None) -> None:
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.leaf_chars, self.leaf_bytes, self.window = regex.compile(pattern), leaf_chars, leaf_bytes, window
        self.seam = seam
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self._plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._span(text, lo, mid), self._span(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a = self._last_seam(text, lo, mid)
        b = self._first_seam(text, mid, hi)
        keep = len(left) - len(self._plain(text[a:mid])) if a > lo else 0
        skip = len(self._plain(text[mid:b])) if b < hi else len(right)
        return left[:keep] + self._plain(text[a:b]) + right[skip:]

    def _last_seam(self, text: str, lo: int, mid: int) -> int:
        reach = self.window if self.seam else mid - lo
        while reach < mid - lo:
            for m in self.seam.finditer(text, mid - reach, mid):
                if m.start() > lo:
                    return m.start()
            reach *= 2
        return lo

    def _first_seam(self, text: str, mid: int, hi: int) -> int:
        reach = self.window if self.seam else hi - mid
        while reach < hi - mid:
            for m in self.seam.finditer(text, mid + 1, mid + reach):
                return m.start()
            reach *= 2
        return hi

    def _plain(self, text: str) -> list[int]:
        """A leaf or a window. One with a very long match goes match by match, and that match by its bytes."""
        if len(text) <= 2 * self.leaf_chars and (len(text) <= self.leaf_bytes // 4 or self.seam and self.seam.search(text)):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            piece = m.group().encode("utf-8", "surrogatepass")
            out += self.piece(piece)
        return out

    def piece(self, b: bytes) -> list[int]:
        """The tokens of one match, by halves of its bytes."""
        if len(b) <= self.leaf_bytes:
            return self.core._encode_single_piece(b)  # noqa: SLF001  the library's own encoding of one match
        mid = len(b) // 2
        return self._join_tokens(self.piece(b[:mid]), self.piece(b[mid:]))

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 4
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            new = self.core._encode_single_piece(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))  # noqa: SLF001
            if (ok_left := i == len(left) or self._stable(left[len(left) - i - 1], new[0])) & (ok_right := j == len(right) or self._stable(new[-1], right[j])):
                return left[: len(left) - i] + new + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def _stable(self, x: int, y: int) -> bool:
        return self.core._encode_single_piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]  # noqa: SLF001

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, seam: str | None = None) -> TreeEncoder:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return TreeEncoder(ranks, pattern, seam=regex.compile(seam) if seam else None)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, seam: str | None = None, digest: bool = False) -> DataFrame:
    """id, ids array<int> and decoded binary of every row, or their digests; seam must fit the pattern. A map without shuffle; ranks_path exists on every machine."""
    kind = dict(df.dtypes)[id_col]
    schema = f"{id_col} {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary")

    def run(batch: pa.RecordBatch) -> dict:
        own = encoder(ranks_path, pattern, seam)
        rows = [own.encode(t) for t in batch.column(1).to_pylist()]
        out = {id_col: batch.column(0)}
        if not digest:
            return out | {"ids": pa.array(rows, pa.list_(pa.int32())), "decoded": pa.array([own.decode(r) for r in rows], pa.binary())}
        return out | {
            "n_tokens": pa.array(map(len, rows), pa.int64()),
            "ids_sha256": [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows],
            "decoded_sha256": [hashlib.sha256(own.decode(r)).hexdigest() for r in rows],
        }

    return by_batch(df.select(id_col, text_or_empty(text_col).alias("text")), run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, seam=SEAM, digest=True)


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
