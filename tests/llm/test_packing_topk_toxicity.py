from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from treeq.llm import packing, topk, toxicity

# packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["'", "s", "re", " ", "  ", "\n", "\t", "1", "23", "é", "ñ", "the", "Ing", "ab", "!", "..", "　", "\x1c", "́", "H̱", "漢", "ΑΣ", "Σ", "😀", "'ll", "\r\n", "İ", "ſ", "K", "_", "«", "\x85", "ß", "ẞ", "ᄀ", "ᅡ", "e", "̸", "=", "Å", "½", "²"]


def library() -> Tokenizer:
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_word_tokenizer_is_the_library_s(monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", "the" * 20_000]
    whole = library()
    monkeypatch.setattr(packing, "CACHE", 3000)
    own = packing.WordTokenizer(PATH)
    for at in range(0, len(texts), 500):
        flat, ends = own(pa.array(texts[at : at + 500]))
        start = 0
        for t, end in zip(texts[at : at + 500], ends, strict=True):
            assert flat[start:end].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2], repr(t)
            start = end


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces(spark, parts) -> None:  # noqa: ANN001
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "a", "fox.", "jumps!"]) for _ in range(rng.choice([0, 3, 40, 90, 300]))) for _ in range(120)] + [None, "", "word " * 2000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(parts)
    df = df.unionByName(spark.createDataFrame([(None, "the a", 1), (5, "again five", 1)], df.schema))
    rows = packing.pack(df, PATH, length=64, windows=3, group=2).collect()
    whole = library()
    want = {(i, t): [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in [*enumerate(texts), (None, "the a"), (5, "again five")]}
    got: dict = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and 0 < r.length <= 64
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for i in {k for k, _ in want}:
        ids = sorted(x for (k, _), v in want.items() if k == i for x in v)
        assert sorted(x for _, v, _ in got[i] for x in v) == ids
        if i != 5:
            at = 0
            for start, v, n in sorted(got[i]):
                assert start == at and n == len(ids)
                at += len(v)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    full = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
        full += at == 64
    assert full >= len(sequences) - 1
    assert packing.pack(df.where("false"), PATH).count() == 0


def placed_by_hand(sizes: list[int], length: int, windows: int) -> tuple[list[list], list[list]]:
    """Full sequences in the order they are emitted, and what is open at the end, as lists of (document, start, size)."""
    out: list[list] = []
    open_: list[dict] = []  # pieces, and when the window last changed
    for doc, size in enumerate(sizes):
        start = 0
        while size - start >= length:
            out.append([(doc, start, length)])
            start += length
        rest = size - start
        if not rest:
            continue
        room = lambda w: length - sum(n for _, _, n in w["pieces"])
        best = min((w for w in open_ if room(w) >= rest), key=lambda w: (room(w), w["at"]), default=None)
        if best is None and len(open_) == windows:
            full = min(open_, key=lambda w: (room(w), w["at"]))
            gap = room(full)
            out.append([*full["pieces"], (doc, start, gap)])
            open_.remove(full)
            start, rest = start + gap, rest - gap
        if best is None:
            best = {"pieces": []}
            open_.append(best)
        best["pieces"].append((doc, start, rest))
        best["at"] = doc
        if room(best) == 0:
            out.append(best["pieces"])
            open_.remove(best)
    return out, [w["pieces"] for w in sorted(open_, key=lambda w: (room(w), w["at"]))] if open_ else []


def test_placement_by_hand() -> None:
    rng = random.Random(12)
    for length, windows in ((64, 1), (64, 3), (100, 8)):
        sizes = [rng.choice([1, 3, 20, 40, 63, 64, 65, 99, 250]) if rng.random() < 0.5 else rng.randint(1, 130) for _ in range(600)]
        packer, made = packing.Packer(length, windows), []
        for doc, n in enumerate(sizes):
            made += packer.add(doc, np.arange(n), 0, n)
        full = packer.sequences
        made += packer.finish(False)
        got: list[list] = [[] for _ in range(packer.sequences)]
        for key, start, ids, n, sequence, offset in made:
            assert n == sizes[key] and offset == sum(x[2] for x in got[sequence]) and ids.tolist() == list(range(start, start + len(ids)))
            got[sequence].append((key, start, len(ids)))
        want, left = placed_by_hand(sizes, length, windows)
        assert got[:full] == want and got[full:] == left


# top-k


def topk_by_hand(rows: list[tuple], k: int) -> list[tuple]:
    ok = [(j, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for j, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for j, i, q in ok:
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), float("inf") if n is None else n) for m, n, c in ok if m != j and len(c) == len(q))
        out += [(i, r + 1, None if n == float("inf") else n, -s) for r, (s, n) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(8192, 1024, 16), (16, 3, 2)])
def test_topk(spark, sizes) -> None:  # noqa: ANN001
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 1e-3]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan"), 0.0, 0.0, 0.0]), (450, [float("inf")] * 4), (None, [9.0] * 4), (50, [0.5, 0.5, 0.5, 0.5]), (50, [0.5, 0.5, 0.5, 0.5]), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (550, []), (600, [1e9, -1e9, 1e9, 1e9]), (650, [7.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.IntegerType())])).repartition(3)
    shard, block, fan = sizes
    got = [tuple(r) for r in topk.top_k(df, F.expr("id % 50 = 0"), 5, shard=shard, block=block, fan=fan).collect()]
    assert sorted(got, key=str) == topk_by_hand(rows, 5)
    assert topk.top_k(df.where("false"), F.expr("id % 50 = 0"), 5).count() == 0


def test_products_are_exact() -> None:
    big = np.array([[2.0**40, 3.0]])
    assert topk.products(big, np.array([[2.0**20, 5.0]]))[0, 0] == 2**60 + 15
    huge = topk.products(big, big * 2.0**20)
    assert huge.dtype == object and huge[0, 0] == 2**100 + 9 * 2**20
    assert topk.best(np.array([5, 2**100, 7, 7], object), np.array([1, 2, 9, 3]), 3).tolist() == [1, 3, 2]


# toxicity

BAD = ["scoundrel", "villainous", "knavery", "blackguard"]


def corpus(n: int, seed: int) -> list[tuple[int, str, int]]:
    rng = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "re", "st", "en", "al", "or", "in", "es", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        ws = [word() for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(max(2, len(ws) // 30)):
                ws[rng.randrange(len(ws))] = rng.choice(BAD)
        out.append((i, " ".join(ws), toxic))
    return out


def test_held_out_accuracy(spark) -> None:  # noqa: ANN001
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, 9.9) for i, t, _ in rows] + [(None, "knavery", 0.0), (5000, None, 0.0), (5001, "", 0.0), (5002, "12 !", 0.0), (5003, "anti " * 40_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.toxic) and model.toxic != model.ordinary
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200
    assert sum(s >= 0.7 for s, y in held if y) / sum(y for _, y in held) > 0.9
    assert sum(s >= 0.7 for s, y in held if not y) / sum(1 - y for _, y in held) < 0.03
    assert got[5000] == got[5001] == got[5002] < 0.7 and got[5003] < 0.7 and all(0 <= s <= 1 for s in got.values())
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int")
    again = toxicity.train(docs, other)
    assert again.toxic == model.toxic and (again.weights == model.weights).all()  # held-out labels change nothing


def test_scores_against_fresh_compressors(spark) -> None:  # noqa: ANN001
    """Each word compressed by itself with dictionaries that are loaded anew, no cache, and the formula written out."""
    rows = corpus(300, 3)
    model = toxicity.fit([(Counter(toxicity.words_of(t)), y) for _, t, y in rows[:200]])
    made = [zstandard.ZstdCompressionDict(d) for d in (model.ordinary, model.toxic)]
    options = zstandard.ZstdCompressionParameters(window_log=17, hash_log=13, chain_log=13, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def length(text: str, k: int) -> int:
        return len(zstandard.ZstdCompressor(dict_data=made[k], compression_params=options).compress(text.encode()))

    def by_hand(text: str) -> float:
        odds = []
        for w in re.findall(r"[a-z]+", text.lower()):
            a, b = (length(f"{toxicity.CARRIER}{w} ", k) - length(toxicity.CARRIER, k) for k in (0, 1))
            odds.append(model.odds[(min(len(w), toxicity.LONGEST - 1) * 32 + min(max(a, 0), 31)) * 16 + min(max(a - b + 4, 0), 15)])
        top = [*sorted(odds, reverse=True)[:4], 0, 0, 0, 0]
        x = [top[0], sum(top[1:4]) / 3, math.log1p(200 * sum(max(o, 0) for o in odds) / max(len(odds), 1)), math.log1p(len(odds)) / 4, 1]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[200:215]], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[i] - by_hand(t)) < 1e-5 for i, t, _ in rows[200:215])


def test_texts_of_repeated_ids(spark) -> None:  # noqa: ANN001
    """The same text of an id counts, however the rows are dealt."""
    rows = [(i % 300, t, y) for i, t, y in corpus(400, 5)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    models = [toxicity.train(docs.repartition(n), labels) for n in (1, 5)]
    assert models[0].toxic == models[1].toxic and (models[0].weights == models[1].weights).all()


def test_without_labels(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (4, "e")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (2, 1), (4, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, ones)).collect()} == {1.0}
    assert toxicity.score(docs.where("false"), toxicity.train(docs.where("false"), none)).count() == 0


def test_long_runs_are_read_whole() -> None:
    run = "".join(chr(0x4E00 + i) for i in range(203))
    parts = toxicity.words_of(f"Short {run} end")
    assert parts[0] == "short" and parts[-1] == "end"
    at = [run.index(p.removeprefix("+")) for p in parts[1:-1]]
    assert at[0] == 0 and at[-1] + len(parts[-2]) - 1 == 203 and all(0 < b - a <= 3 for a, b in zip(at, at[1:], strict=False))
    rows = corpus(900, 1)
    score = toxicity.Scorer(toxicity.fit([(Counter(toxicity.words_of(t)), y) for _, t, y in rows]))
    clean = ["".join(t.split())[:160] for _, t, y in corpus(60, 2) if not y]
    found = [score(x + BAD[k % 4] + x[:15]) >= 0.7 for k, x in enumerate(clean)]
    assert np.mean(found) > 0.9 and np.mean([score(x) >= 0.7 for x in clean]) < 0.1
