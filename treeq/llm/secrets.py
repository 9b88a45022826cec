"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Spans are kind:start:end in code points, end exclusive. The base kinds are found leftmost and without overlaps, each kind by
itself; matches that fail their length are dropped. Kind "markov" adds runs of token characters that a first-order Markov model
of random strings explains better than one of ordinary identifiers. Base spans are cut out of a run and the rest is judged; of a run
that isn't random as a whole, the segments of its parts between / . = - are that are. The models alone decide, with digits or without.

The models are trained on labelled samples: values that the base patterns found (random) and other words of the same documents
(ordinary), from about SAMPLE_ROWS different texts, and PRIOR random strings of fixed seed, which alone serve where a table has no
secret. Only their counts, at most 2 x 67 x 67, reach the driver.

Null and empty texts have no spans. A span may be as long as its text. Repeated rows give repeated results; an input without rows
gives none, and then the models rest on the prior alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.base import by_batch, table, text_or_empty

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A greedy run that is too short holds no longer one, so the least lengths can stand in the pattern.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

SAMPLE_ROWS, SAMPLE_PARTS, PRIOR, LEAST, MARGIN, SMOOTH = 4000, 16, 2000, 20, 0.6, 0.5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
#: What a run is cut into: names and values, and what stands between them.
PART = re.compile(r"[/.=-]+|[^/.=-]+")
WORD = re.compile(r"[A-Za-z0-9+/_=.-]{4,}")
_INDEX = np.full(256, len(ALPHABET), np.int64)
_INDEX[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1  # the last state is the start


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    out = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _bigrams(words: Counter) -> np.ndarray:
    """Counts [SIZE, SIZE] of transitions, from the start state on."""
    out = np.zeros((SIZE, SIZE))
    for w, n in words.items():
        x = _INDEX[np.frombuffer(w.encode(), np.uint8)]
        np.add.at(out, (np.concatenate([[SIZE - 1], x[:-1]]), x), n)
    return out


def _prior() -> Counter:
    rng, kinds = random.Random(7), ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64])
    return Counter("".join(rng.choices(kinds[i % 3], k=20 + i % 45)) for i in range(PRIOR))


def _ordinary_prior() -> Counter:
    """Where a table has no words: identifiers as programs have them."""
    stems = "user name file path index value result list item count config default request response handler session total order line price table column".split()
    return Counter(f"{a}{j}{b}" for a in stems for b in stems for j in ("_", "-", ".", ""))


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The log-likelihood ratio of each transition, random over ordinary: float64 [SIZE, SIZE].

    The sample is the different texts that xxhash64 puts below SAMPLE_ROWS in expectation; each counts once, so the order and number of
    partitions and copies change nothing. They are dealt to SAMPLE_PARTS tasks.
    """
    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    text = text_or_empty(text_col)
    picked = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(text.alias("text")).distinct().repartition(SAMPLE_PARTS, "text")

    def count(batch: pa.RecordBatch) -> dict:
        secret, other = Counter(), Counter()
        for t in batch.column(0).to_pylist():
            spans = base_spans(t)
            secret.update({t[s.start : s.end] if s.kind else ASSIGN.match(t, s.start)[2] for s in spans})
            other.update({m.group() for m in WORD.finditer(t) if not any(s.start < m.end() and m.start() < s.end for s in spans)})
        made = [np.argwhere(c := _bigrams(w)).tolist() and [(k, int(a), int(b), float(c[a, b])) for a, b in np.argwhere(c)] for k, w in enumerate((secret, other))]
        flat = [x for m in made for x in m]
        return dict(zip(("kind", "a", "b", "n"), [pa.array([x[i] for x in flat], pa.float64() if i == 3 else pa.int64()) for i in range(4)], strict=True))

    got = by_batch(picked, count, "kind long, a long, b long, n double").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts = np.stack([_bigrams(_prior()), _bigrams(_ordinary_prior())])
    for r in got:
        counts[r.kind, r.a, r.b] += r.n
    p = (counts[:, :, :-1] + SMOOTH) / (counts[:, :, :-1] + SMOOTH).sum(axis=2, keepdims=True)
    return np.log(p[0] / p[1])


def ratio(word: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio per character."""
    x = _INDEX[np.frombuffer(word.encode(), np.uint8)]
    return float(model[np.concatenate([[SIZE - 1], x[:-1]]), x].mean())


def _segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa), start and end."""
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start = i
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j -= 1
            if j < 0 or out[j][3] >= total:
                break
            start, before = out[j][0], out[j][2]
            del out[j:]
        out.append((start, i + 1, before, total))
    return [x[:2] for x in out]


def random_parts(run: str, model: np.ndarray) -> list[tuple[int, int]]:
    """The run if its mean ratio is MARGIN or more, else all segments of its parts of which that holds; LEAST characters at least."""
    if len(run) < LEAST:
        return []
    x = _INDEX[np.frombuffer(run.encode(), np.uint8)]
    each = model[np.concatenate([[SIZE - 1], x[:-1]]), x]
    if float(each.mean()) >= MARGIN:
        return [(0, len(run))]
    cuts = [m.start() for m in PART.finditer(run)]
    if len(cuts) < 2:
        return []
    ends = [*cuts[1:], len(run)]
    each[cuts] = model[SIZE - 1, x[cuts]]  # a part is scored as a run of its own, and what stands between parts tells nothing
    each[np.isin(x, [ALPHABET.index(c) for c in "/.=-"])] = 0
    found = _segments(np.add.reduceat(each - MARGIN, cuts).tolist())
    return [(cuts[i], ends[j - 1]) for i, j in found if ends[j - 1] - cuts[i] >= LEAST]


def all_spans(text: str, model: np.ndarray) -> list[Span]:
    base = base_spans(text)
    found, at = list(base), 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at].end <= m.start():
            at += 1
        left, k = m.start(), at
        while left < m.end():
            right = min(m.end(), base[k].start) if k < len(base) else m.end()
            if right > left:
                found += [Span(left + i, 3, left + j) for i, j in random_parts(text[left:right], model)]
            if k == len(base) or right == m.end():
                break
            left, k = max(left, base[k].end), k + 1
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, model: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every row: a map without shuffle. model: of train()."""
    model = train(docs, text_col) if model is None else model
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for t in batch.column(1).to_pylist():
            spans = all_spans(t, model)
            base = [s for s in spans if s.kind < 3]
            rows.append((*(sum(s.kind == k for s in spans) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return dict(zip(("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"), map(list, zip(*rows, strict=True)), strict=True)) | {id_col: batch.column(0)}

    return by_batch(docs.select(id_col, text_or_empty(text_col).alias("text")), run, schema)


def redact(docs: DataFrame, model: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """docs with every secret of text_col replaced; overlapping spans become one. Null texts stay null, other columns as they are."""
    model = train(docs, text_col) if model is None else model
    names = docs.columns

    def clean(text: str | None) -> str | None:
        if text is None or not (spans := all_spans(text, model)):
            return text
        out, at = [], 0
        for s in spans:
            if s.end <= at:
                continue
            if s.start >= at:
                out += [text[at : s.start], by]
            at = s.end
        return "".join([*out, text[at:]])

    def run(batch: pa.RecordBatch) -> dict:
        out = dict(zip(names, batch.columns, strict=True))
        return out | {text_col: pa.array(map(clean, out[text_col].to_pylist()), pa.string())}

    return by_batch(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secrets": op1_secrets}
ORACLE: dict[str, str] = {}
