"""Media columns: bytes as 8-bit audio, and log-mel features of it.

A payload is stored as a WAV file of 8-bit mono samples, which is lossless. The features read the stored bytes back, resample
the signal with a polyphase filter, take overlapped log-mel filterbanks and mark active spans by energy with hysteresis.

Null and empty texts give the payload of one block of padding. Equal texts give equal values; rows may repeat. An input without
rows gives none. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeq.llm.base import by_batch, table, text_or_empty

BLOCK = 576
RATE = 16_000
UP, DOWN, TAPS = 1, 2, 16
FRAME, HOP, MELS = 256, 128, 16
PATCH = 16
OPEN_DB, CLOSE_DB = 3.0, 1.0


class Features(NamedTuple):
    patches: np.ndarray  # float32 [n, PATCH, MELS]
    start_ms: np.ndarray  # int64 [n]
    end_ms: np.ndarray
    active: list[tuple[int, int]]  # spans in ms
    bands: np.ndarray  # float64 [MELS], means


def padded(text: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of BLOCK."""
    return text + b"\xff" * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def store(payload: bytes) -> bytes:
    """A RIFF/WAVE file: PCM, mono, 8-bit, RATE samples a second. A pad byte keeps the chunk even."""
    odd = len(payload) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * odd


def load(media: bytes) -> bytes:
    """The samples of a file that store() made, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    f, at = io.BytesIO(media), 12
    while at + 8 <= len(media):
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"data":
            return f.read(size)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def _low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc for each of the up phases: [up, taps]."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * cut * np.hamming(up * taps)
    return np.ascontiguousarray((h / h.sum() * up).reshape(taps, up).T)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase: output k uses phase (k * down) % up at input (k * down) // up; no sample that is thrown away is computed."""
    h = _low_pass(up, down, taps)
    padded_x = np.concatenate([np.zeros(taps - 1, x.dtype), x])
    n = -(-len(x) * up // down)
    k = np.arange(n) * down
    out = np.empty(n, x.dtype)
    windows = np.lib.stride_tricks.sliding_window_view(padded_x, taps)
    for phase in range(up):
        mine = np.flatnonzero(k % up == phase) if up > 1 else slice(None)
        rows = windows[:: down // up] if up == 1 else windows[k[mine] // up]
        out[mine] = rows[:n] @ h[phase][::-1].astype(x.dtype)
    return out


@lru_cache(maxsize=4)
def _mel(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangular filters, [frame // 2 + 1, mels]."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1) * frame / rate
    bins = np.arange(frame // 2 + 1)[:, None]
    up, down = (bins - edges[:-2]) / np.maximum(np.diff(edges)[:-1], 1e-9), (edges[2:] - bins) / np.maximum(np.diff(edges)[1:], 1e-9)
    return np.maximum(0, np.minimum(up, down)).astype(np.float32) + np.float32(1e-9)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Overlapped frames of x to log energies, float32 [frames, MELS]; a short signal is one zero-padded frame. Works in bounded blocks."""
    frames = max(1, 1 + -(-max(0, len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), x.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank, out = np.hanning(FRAME).astype(np.float32), _mel(rate, FRAME, MELS), np.empty((frames, MELS), np.float32)
    for at in range(0, frames, 4096):
        out[at : at + 4096] = np.log((np.abs(np.fft.rfft(view[at : at + 4096] * window, axis=1)) ** 2).astype(np.float32) @ bank + np.float32(1e-6))
    return out


def hysteresis(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Maximal runs above low that rise above high somewhere: [(start, end), ...]."""
    on = np.concatenate([[False], energy > low, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    peaks = np.concatenate([[0], np.cumsum(energy > high)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if peaks[b] > peaks[a]]


def features(payload: bytes) -> Features:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    rate = RATE * UP // DOWN
    mel = log_mel(resample(x), rate)
    db = mel.mean(axis=1) * np.float32(10 / np.log(10))
    floor = float(np.median(db))
    ms = lambda k: int(k) * HOP * 1000 // rate
    active = [(ms(a), ms(b)) for a, b in hysteresis(db, floor + CLOSE_DB, floor + OPEN_DB)]
    n = -(-len(mel) // PATCH)
    patches = np.concatenate([mel, np.zeros((n * PATCH - len(mel), MELS), np.float32)]).reshape(n, PATCH, MELS)
    starts = np.arange(n) * PATCH * HOP * 1000 // rate
    return Features(patches, starts, starts + PATCH * HOP * 1000 // rate, active, mel.mean(axis=0, dtype=np.float64))


def tensor_ipc(f: Features) -> bytes:
    """An Arrow stream: patch fixed_shape_tensor<float32>[PATCH, MELS], start_ms, end_ms."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(f.patches.reshape(-1)), PATCH * MELS)
    tensor = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS)), flat)
    batch = pa.RecordBatch.from_arrays([tensor, pa.array(f.start_ms), pa.array(f.end_ms)], names=["patch", "start_ms", "end_ms"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def tensors(ipc: bytes) -> pa.Table:
    return pa.ipc.open_stream(ipc).read_all()


def audio_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False) -> DataFrame:
    """id, n_bytes, media and tensor (see tensor_ipc) and active spans of every row; digest=True returns their digests instead of the bytes.

    A map without shuffle: a task holds one slice of a batch, and one text's signal at a time.
    """
    kind = dict(df.dtypes)[id_col]
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor_sha256 string, n_patches long" if digest else "media binary, tensor binary, active array<struct<start_ms:long,end_ms:long>>"
    schema = f"{id_col} {kind}, n_bytes long, {made}"

    def one(text: str) -> tuple:
        raw = text.encode()
        media = store(padded(raw))
        payload = load(media)
        f = features(payload)
        tensor = tensor_ipc(f)
        if not digest:
            return len(raw), media, tensor, [{"start_ms": a, "end_ms": b} for a, b in f.active]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        bands = ",".join(str(int(v)) for v in np.rint(f.bands * 16))
        spoken = sum(b - a for a, b in f.active)
        n_patches = tensors(tensor).num_rows
        feature = f"mel16={bands};active={len(f.active)}:{spoken}ms;patches={n_patches}"
        return len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media), feature, sha(tensor), n_patches

    def run(batch: pa.RecordBatch) -> dict:
        names = [x.split()[0] for x in schema.replace("array<struct<start_ms:long,end_ms:long>>", "x").split(", ")]
        rows = [one(t) for t in batch.column(1).to_pylist()]
        columns = dict(zip(names[1:], map(list, zip(*rows, strict=True)), strict=True))
        if not digest:
            columns["active"] = pa.array(columns["active"], pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])))
        return {names[0]: batch.column(0)} | columns

    return by_batch(df.select(id_col, text_or_empty(text_col).alias("text")), run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_columns(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op2_media": op2_media}
#: What of it SQL can express is held against the query in the tests; features and media it can't.
ORACLE: dict[str, str] = {}
__all__ = ["QUERIES", "audio_columns", "features", "load", "store", "tensors"]
