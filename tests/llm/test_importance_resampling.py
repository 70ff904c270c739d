import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import _words
from lexigrid.llm import importance_resampling as X

from .helpers import clashing, documents, edge_rows
from .test_decontamination import words


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def expected(docs, bench, percent=5):
    s, t = (Counter(bucket(f) for _, text in rows for f in features(text)) for rows in (docs, bench))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0))))
    out = []
    for i, text in docs:
        own = features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def held(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_edges(spark):
    rows = edge_rows() + [(100 + i, " ".join(f"w{j * i % 23}" for j in range(15 + i))) for i in range(40)] + [(150, "same text " * 15)] * 9 + [(None, "same text " * 15)] * 3
    bench = [("x", "w1 w2 w3 w4"), ("y", None), ("z", "fox jumps")]
    target = spark.createDataFrame(bench, "item_id string, text string")
    for df, percent in ((documents(spark, rows), 5), (clashing(documents(spark, rows)), 50), (documents(spark, rows), 100), (documents(spark, rows), 0)):
        out = X.resample(df, target, percent=percent)
        assert held(out) == expected([r[:2] for r in rows], bench, percent)
        assert out.select("row.*").columns == df.columns
    assert held(X.resample(df, target.limit(0))) == expected([r[:2] for r in rows], [])
    assert X.resample(df.limit(0), target).count() == 0


@pytest.mark.parametrize("size", [1, 20, 300, 1 << 20])
def test_crcs_of_runs_in_pieces(size):
    draw = random.Random(size)
    texts = [None, "", "x", "A" * 200 + " b " + "z" * 70 + " Q"] + ["".join(draw.choice("aB c,é漢1 \n") for _ in range(draw.randint(0, 400))) for _ in range(60)]
    got = [Counter() for _ in texts]
    for c, runs in ((c, _words.run_crcs(c)) for c in _words.chunks(pa.array(texts), 2, size)):
        place, piece = c.inside()
        for n, crcs in enumerate(runs):
            for k in range(len(place)):
                if place[k] >= n and place[k] - n < c.own[piece[k]]:
                    got[c.rows[piece[k]]][int(crcs[k])] += 1
    assert got == [Counter(zlib.crc32(f.encode()) for f in features(t)) for t in texts]


def test_radix_selection_finds_every_rank(spark):
    draw = random.Random(3)
    keys = [(draw.choice([-(2**63), 2**63 - 1, 0, -1, 5, draw.randint(-(2**40), 2**40)]), draw.choice([None, -(2**63), 2**63 - 1, draw.randint(-9, 9)])) for _ in range(300)]
    rows = spark.createDataFrame(keys, "score long, doc_id long").cache()
    order = sorted(keys, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for k in (1, 2, 17, 150, 299, 300):
        digits = X._digits(F.col("score"), F.col("doc_id"))
        got = rows.filter(X._at_least(digits, X.kth_key(rows, k))).collect()
        assert Counter(map(tuple, got)) == Counter(r for r in keys if order.index(r) <= order.index(order[k - 1]))
        ranks = sorted((r["rank"], r["score"], r["doc_id"]) for r in X.drawn(rows.repartition(3), k, F.lit(True)).filter("rank is not null").collect())
        assert [r[1:] for r in ranks] == order[:k] and [r[0] for r in ranks] == list(range(1, k + 1))


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = expected(docs, bench)
    assert held(X.op13_importance_resampling(spark, sf)) == want and any(r[4] for r in want)
