import zlib

import numpy as np
from pyspark.sql import functions as F

from lexigrid.llm import quality_classifier as Q

from .helpers import clashing, documents, edge_rows


def table(spark, n=600):
    rng = np.random.default_rng(5)
    vocab = ["the", "of", "river", "stone", "carries", "water", "down", "slowly", "field", "and", "summer"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocab, 60))
        good = int(i % 3 > 0)
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * 60
        rows.append((i, " ".join(words) + "."))
        labels.append((i, good, 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_learns(spark):
    docs, labels = table(spark)
    out = Q.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert auc([(r["score"], r["quality"]) for r in held]) > 0.99
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.98
    again = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs, labels).collect()}
    assert max(abs(again[r["doc_id"]] - r["score"]) for r in out) < 1e-6


def test_held_out_labels_are_not_used(spark):
    docs, labels = table(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in Q.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_normal_equations(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((200, len(Q.NAMES))), rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, y double").repartition(5)
    f = Q.Fourier(x.mean(0), x.std(0), width=16)
    z = f(x)
    a = z.T @ z
    want = np.linalg.solve(a + 1e-3 * np.trace(a) / len(a) * np.eye(len(a)), z.T @ y)
    assert np.allclose(Q.fit_ridge(rows, f), want)


def test_kernel_is_approximated():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, len(Q.NAMES))) * 0.5
    f = Q.Fourier(np.zeros(len(Q.NAMES)), np.ones(len(Q.NAMES)), width=20_000)
    z = f(x)[:, :20_000]
    want = np.exp(-Q.GAMMA * ((x[:, None] - x[None]) ** 2).sum(2))
    assert abs(z @ z.T - want).max() < 0.05


def test_isotonic():
    s, p = Q.isotonic([(0, 10, 1), (1, 10, 5), (2, 10, 3), (3, 10, 9)])
    assert s == [0, 1.5, 3] and p == sorted(p) and abs(p[1] - 8.5 / 21) < 1e-12


def test_edges(spark):
    docs, labels = table(spark, 120)
    odd = clashing(documents(spark, edge_rows()))
    more = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0), (10**9, 1, 0)], labels.schema))
    out = Q.quality_scores(docs.union(documents(spark, edge_rows())), more).collect()
    assert len(out) == 120 + len(edge_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    for known, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0)):
        assert all(r["score"] == want for r in Q.quality_scores(docs, known).collect())
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert Q.keep_good(odd, labels).columns == odd.columns


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert auc([(r["score"], r["quality"]) for r in out]) > 0.97


def test_keep_good_writes_no_texts(spark, sf):
    """The pipeline's disk: neither texts nor statistics are left beside the rows that stay."""
    from lexigrid.llm._shared import hadoop_path, shared_dir

    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    p, fs = hadoop_path(spark, f"{shared_dir(spark)}/lexigrid")
    there = lambda: {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
    before = there()
    out = Q.keep_good(docs, labels)
    kept = {r["doc_id"] for r in out.collect()}
    assert {n.split("-")[0] for n in there() - before} <= {"learn"}
    assert 0 < len(kept) < docs.count()
    scores = Q.quality_scores(docs, labels, hold_out=False)
    assert kept == {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
