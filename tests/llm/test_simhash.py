from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from treeq.llm import simhash

DOCS = "doc_id long, text string"


def brute(prints: list[int], threshold: int = 2) -> list[int]:
    parent = list(range(len(prints)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def flipped(x: int, n: int, rng: random.Random) -> int:
    for i in rng.sample(range(64), n):
        x ^= 1 << i
    return x


def test_golay_covers() -> None:
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 500)
    homes = simhash._homes(x)
    assert (np.bitwise_count(x ^ homes) <= 3).all()
    assert (simhash._syndromes(homes) == 0).all()
    rows, near = simhash._within(x, 2)
    assert (simhash._syndromes(near) == 0).all() and (np.bitwise_count(x[rows] ^ near) <= 5).all()
    every = np.unique(simhash._homes(np.arange(1 << 23)))
    assert len(every) == 4096
    assert all((rows == i).sum() == (np.bitwise_count(every ^ v) <= 5).sum() for i, v in enumerate(x[:50]))


def test_every_near_pair_meets() -> None:
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = flipped(x, rng.choice([1, 2]), rng)
        home = set(simhash.anchors(np.array([x], np.uint64).view(np.int64), True)[1].tolist())
        copies = set(simhash.anchors(np.array([y], np.uint64).view(np.int64), False)[1].tolist())
        assert home & copies


@pytest.mark.parametrize("block", [2048, 16])
def test_components_of_prints(spark, monkeypatch, block) -> None:
    """Scattered prints, chains, and a ball with many homes at one anchor; with a small block its anchors are split."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(100)]
    prints += [flipped(rng.choice(prints), rng.choice([1, 2, 3]), rng) for _ in range(150)]
    center = rng.getrandbits(64)
    prints += [flipped(center, rng.choice([1, 2]), rng) for _ in range(150)]
    chain = [rng.getrandbits(64)]
    for _ in range(40):
        chain.append(flipped(chain[-1], 2, rng))
    prints = list(dict.fromkeys(prints + chain))
    want = brute(prints)
    fps = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps)).collect()}
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    pairs = set(zip(want, got, strict=True))
    assert len(pairs) == len(set(want)) == len(set(got))


def test_texts_and_edge_cases(spark) -> None:
    words = "the quick brown fox jumps over the lazy dog and runs away from a very angry bear in the deep green wood".split()
    long = " ".join(words * 30)
    rows = [(5, long), (3, long), (9, long.upper()), (1, None), (2, ""), (4, " \t\n"), (7, "one two"), (None, "one\vtwo"), (7, "one two"), (8, "x" * 200_000)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(*r, "extra") for r in rows], DOCS + ", fp string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (4, 1), (7, 7), (None, 7), (8, 8)}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    one = simhash.fingerprint(simhash.shingle_hashes("One two", 3))
    assert one == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(simhash.shingle_hashes(" ", 3)) == 0


@pytest.mark.parametrize("block", [256, 8])
def test_pairs_beside_the_first_of_a_bucket(spark, monkeypatch, block) -> None:
    """Near copies among texts that share a passage, which are no near copies but share buckets; a chain by its middle text."""
    monkeypatch.setattr(simhash, "TEXTS", block)
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passage, texts = fresh(160), []
    for _ in range(30):
        own = fresh(40)
        texts += [" ".join(passage + own), " ".join(passage + own[:22] + fresh(18))]
    texts += [" ".join(fresh(60)) for _ in range(10)]
    chain = fresh(200)
    texts += [" ".join(chain), " ".join(chain[12:] + fresh(12)), " ".join(chain[24:] + fresh(24)), " ".join(chain[36:] + fresh(36))]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) / len(x | sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert len(set(root)) < len(texts) - 25


def test_whole_texts_by_hand(spark) -> None:  # noqa: ANN001
    """From texts of many shingles to components, bit by bit and pair by pair."""
    rng = random.Random(8)
    rows: list[tuple] = []
    for base in range(40):
        ws = [rng.choice(["Alpha", "beta", "GAMMA", "délta", "epsilon", "zeta"]) + str(rng.randint(0, 30)) for _ in range(rng.choice([2, 5, 40, 300]))]
        for k in range(4):
            other = list(ws)
            if k > 1:
                other[rng.randrange(len(other))] = "changed"
            rows.append((base * 10 + k, rng.choice([" ", "  ", "\n", "\t "]).join(other).upper() if k == 1 else " ".join(other)))
    rows += [(900, None), (901, " \n"), (None, rows[0][1])]

    def by_hand(text: str) -> int:
        words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [by_hand(t) for _, t in rows]
    near = [[k for k, y in enumerate(prints) if (x ^ y).bit_count() <= 2] for x in prints]
    want = []
    for start, (i, _) in enumerate(rows):
        seen, todo = {start}, [start]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        want.append((i, f"{prints[start]:016x}", min(rows[k][0] for k in seen if rows[k][0] is not None)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
