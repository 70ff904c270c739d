import random
import re

import numpy as np
import pytest

from lexigrid.llm import minhash_dedup as M

from .helpers import clashing, documents, edge_rows


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    own = [(i, sets(t, width)) for i, t in rows]
    root = {i: i for i, _ in own if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(own):
        for j, b in own[x + 1 :]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted(((i, len(s), i if i is None else find(i)) for i, s in own), key=repr)


def held(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def variants(seed, n_base=12, copies=10):
    rng, rows = random.Random(seed), []
    shared = [f"s{i}" for i in range(40)]
    for b in range(n_base):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 7, 12, 30, 80, 200)))] + (shared if b % 3 == 0 else [])
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            rows.append(" ".join(words).upper() if rng.random() < 0.2 else "  ".join(words))
            base = words if rng.random() < 0.5 else base  # chains
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width,percent,seed,best,block", [(3, 85, 1, 8, 1024), (3, 85, 2, 1, 4), (5, 80, 3, 8, 1024), (5, 80, 4, 1, 4)])
def test_against_all_pairs(spark, width, percent, seed, best, block):
    rows = variants(seed)
    assert held(M.near_duplicates(documents(spark, rows), width=width, percent=percent, best=best, block=block)) == brute(rows, width, percent)


@pytest.mark.parametrize("block", [1024, 32])
def test_one_group_around_the_threshold(spark, block):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(rng.choice((2, 3, 4, 5, 6))):
            words[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    want = brute(rows, 5, 80)
    assert len({c for _, _, c in want}) > 20
    assert held(M.near_duplicates(documents(spark, rows), best=1, block=block)) == want


def test_edges(spark):
    rows = edge_rows() + [(100 + i, "one hot text that many have") for i in range(50)]
    df = clashing(documents(spark, rows))
    assert held(M.near_duplicates(df, width=3, percent=85)) == brute(rows, 3, 85)
    assert M.near_duplicates(df.limit(0)).count() == 0
    assert M.near_dedup(df).columns == df.columns and M.near_dedup(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = variants(5)
    want = brute(rows, 5, 80)
    assert sorted(r["doc_id"] for r in M.near_dedup(documents(spark, rows)).collect()) == sorted({c for _, _, c in want})


def test_signature():
    rng = np.random.default_rng(3)
    for n in (1, 2, 6, 40, 500, 5000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype="u8"))
        s = M.signature(h, 480)
        assert set(s.tolist()) <= set(h.tolist())
        for b in range(480):  # a bin with hashes of its own holds the least of them
            inside = [x for x in h.tolist() if (x >> 32) * 480 >> 32 == b]
            assert not inside or s[b] == min(inside)
    a = np.unique(rng.integers(0, 1 << 64, 20_000, dtype="u8"))
    same = [(M.signature(np.sort(a[:n]), 480) == M.signature(np.sort(a[int(n * 0.1) :][:n]), 480)).mean() for n in (300, 1000, 10_000)]
    assert all(abs(x - 0.9 / 1.1) < 0.1 for x in same)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = M.op3_minhash_dedup(spark, sf)
    assert held(out) == brute(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())
