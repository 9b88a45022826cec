"""Each stage of the pipeline on its own small input, and the registered queries on the smallest tables."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treeq.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts: dict) -> object:  # noqa: ANN001
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOCS)


def result(df) -> dict:  # noqa: ANN001
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = df.collect()
    assert all(r.n_chars == len(r.text or "") for r in rows)
    return {r.doc_id: r.text for r in rows}


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_near_copies(spark) -> None:  # noqa: ANN001
    rng = random.Random(1)
    texts: dict = {}
    for base in range(0, 200, 10):
        ws = words(rng, rng.choice([30, 120, 400]))
        texts[base] = " ".join(ws)
        for k in range(1, rng.choice([2, 6])):
            other = list(ws)
            for _ in range(rng.choice([0, 1, 2, 8])):
                other[rng.randrange(len(other))] = "changed"
            texts[base + k] = " ".join(other)
    texts |= {900: None, 901: "", 902: "  ", 903: "one two", 904: "One Two", 905: "lonely words here"}
    shingles = {i: set(simhash.shingle_hashes(t or "", 5).tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i: int) -> int:
        return i if parent[i] == i else find(parent[i])

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            x, y = shingles[a], shingles[b]
            if a < b and (len(x & y) / len(x | y) if x | y else 1) >= 0.8:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    groups = defaultdict(set)
    for i in ids:
        groups[find(i)].add(i)
    kept = result(corpus_pipeline.drop_near_copies(spark, frame(spark, texts), ""))
    assert set(kept) == set(groups) and all(kept[i] == texts[i] for i in kept)


def test_near_copies_by_row(spark) -> None:  # noqa: ANN001
    """Ids that repeat or are null: rows go by id and text, one row of each group stays."""
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    rows = [(3, a), (5, f"{a} tail"), (5, b), (9, c), (9, c), (None, d), (None, f"{d} tail"), (None, e), (7, f"{e} tail")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    texts = sorted(r.text for r in kept)
    assert len(texts) == 5 and {(r.doc_id, r.text) for r in kept} >= {(3, a), (5, b), (9, c), (7, f"{e} tail")}
    assert sum(t.startswith(d) for t in texts) == 1 and next(r.source for r in kept if r.doc_id == 9) == "s3"


def test_lines_and_secrets(spark) -> None:  # noqa: ANN001
    rng = random.Random(2)
    shared = "this line is shared by very many of the documents"
    texts = {i: f"{' '.join(words(rng, 12))}\n{shared}\nend {i}" for i in range(8)} | {20: None, 21: ""}
    kept = result(corpus_pipeline.drop_repeated_lines(spark, frame(spark, texts), ""))
    assert set(kept) == set(texts) and all((shared in kept[i]) == (i == 7) and f"end {i}" in kept[i] for i in range(8))
    clean = result(corpus_pipeline.redact_secrets(spark, frame(spark, {1: "password: hunter22 ok", 2: "plain words", 3: None}), ""))
    assert clean == {1: "[SECRET] ok", 2: "plain words", 3: None}


def test_clashing_columns(spark) -> None:  # noqa: ANN001
    rng = random.Random(3)
    names = ["score", "kept", "n_dropped", "n_lines", "lines", "rest", "out", "gone", "node", "component_id", "h", "_id", "label"]
    docs = frame(spark, {i: " ".join(words(rng, 30)) + "\nsecret=abcdefgh1" for i in range(6)} | {7: None})
    docs = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) >= 6 and all(r[n] == f"own {n}" for r in rows for n in names), name
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 7
    empty = docs.where("false")
    assert all(stage(spark, empty, "/root/testdata/sf0.001").count() == 0 for _, stage in corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def small() -> str:
    return "/root/testdata/sf0.001"


def test_run(spark, small) -> None:  # noqa: ANN001
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "secrets", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scored = corpus_pipeline.reject_toxic(spark, docs, small)
    assert scored.columns == docs.columns and 0 < scored.count() <= docs.count()
    rows = corpus_pipeline.run(spark, small).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert 0 < len(by) < docs.count()
    for pieces in by.values():
        assert sum(n for _, n, _ in pieces) == pieces[0][2]


def test_registered(spark, small) -> None:  # noqa: ANN001
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    for n in names:
        df = entry.queries()[n](spark, small)
        rows = df.count()
        assert rows > 0
        if n.split("_")[0] in ("op1", "op2", "op3", "op5", "op7", "op9", "op10"):
            assert rows == docs
    held = {r.doc_id for r in entry.queries()["op5_toxicity"](spark, small).where("held_out").collect()}
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)
