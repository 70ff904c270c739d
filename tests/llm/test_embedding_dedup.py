import numpy as np
import pytest

from lexigrid.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    good = []
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, "f8")
            good.append((i, x / np.abs(x).max()))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    groups = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            groups.setdefault(find(i), []).append(k)
    return sorted(((k, links[i], None if k is None else min(groups[find(i)])) for i, (k, _) in enumerate(rows)), key=repr)


def held(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=repr)


def groups(seed, n=60, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.choice([1, 1, 2, 3, 12]))):
            rows.append((base + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.2, 0.3])).astype("f4").tolist())
    rng.shuffle(rows)
    return [(i, list(map(float, r))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 16, 3])
def test_against_all_pairs(spark, block):
    rows = groups(1)
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    assert held(D.near_duplicate_vectors(df, block=block)) == brute(rows)


def test_edges(spark):
    one = [1.0, 2.0, 0.0, -1.0]
    rows = [(1, one), (2, [2.0, 4.0, -0.0, -2.0]), (3, None), (4, [0.0] * 4), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0]), (8, []), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (None, one), (11, one), (11, one), (12, [1e-30] * 4), (13, [1e30] * 4)]
    df = spark.createDataFrame([(*r, 0, "x", 5) for r in rows], SCHEMA + ", kept string, n_links int")
    assert held(D.near_duplicate_vectors(df)) == brute(rows)
    assert held(D.near_duplicate_vectors(df.withColumn("embedding", df["embedding"].cast("array<double>")))) == brute(rows)
    assert D.near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, z = unit(rng.standard_normal((4000, 64))), rng.standard_normal((4000, 64))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
    for n in (256, 2048):
        a, b = D.describe(x, n, 10), D.describe(y, n, 10)
        assert np.mean(D._in_order(a, b, 7) >= 2) > 0.999


def test_descriptions_are_ordered_with_ties_by_pivot():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 16))
    near = x @ D.pivots(16, 64).T
    assert D.describe(x, 64, 10).tolist() == [sorted(range(64), key=lambda j: (-r[j], j))[:10] for r in near]
    assert D.describe(np.zeros((2, 16)), 64, 10).tolist() == [list(range(10))] * 2  # all tie


def test_places_count():
    p, q = np.array([[1, 2, 3, 4]]), np.array([[4, 2, 9, 1]])
    assert [int(D._in_order(p, q, d)[0]) for d in (0, 2, 3)] == [1, 1, 3]


def test_order_decides_candidates(spark):
    """With no shift at all only pivots at equal places count, so fewer links are found; none is added."""
    rows = groups(5)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    exact = {k: n for k, n, _ in brute(rows)}
    few = {k: n for k, n, _ in held(D.near_duplicate_vectors(df, shift=0, shared=6))}
    assert all(few[k] <= exact[k] for k in exact) and sum(few.values()) < sum(exact.values())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert held(D.op8_embedding_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize("pivots,dim", [(2_048, 64), (16_384, 64), (65_536, 64), (16_384, 384)])
def test_recall_at_the_threshold_with_many_pivots(pivots, dim):
    """Random pairs at a cosine of exactly 0.95: the share that has two pivots in common."""
    rng = np.random.default_rng(pivots + dim)
    x = rng.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((300, dim))
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * u
    a, b = D.describe(x, pivots, 10), D.describe(y, pivots, 10)
    assert np.mean(D._in_order(a, b, 7) >= 2) >= 0.98
