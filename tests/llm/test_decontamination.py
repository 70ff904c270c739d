import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import _words, decontamination as X

from .helpers import clashing, documents, edge_rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def expected(docs, bench, width=10):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(len(w) - width, 0) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                found = windows.get(tuple(w[i : i + m]))
                if found:
                    hit.update(range(i, i + m))
                    items |= found
        out.append((doc, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=repr)


def held(out, id="row.doc_id"):
    rows = out.select(F.col(id).alias("doc_id"), "n_words", "spans", "items").collect()
    for r in rows:
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), tuple(r["items"])) for r in rows), key=repr)


def bench_table(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string").repartition(2)


def test_edges(spark):
    rows = edge_rows() + [(100 + i, "so The quick brown fox jumps over the lazy dog; it ran") for i in range(40)]
    bench = [("a", "quick brown fox"), ("b", "ONE"), ("c", None), ("d", "!!"), (None, "lazy dog it"), ("a", "the lazy dog"), ("a", "the lazy dog"), ("long", edge_rows()[5][1][:400]), ("e", "漢字"), ("f", "w996x9 w997x10")]
    want = expected([r[:2] for r in rows], bench)
    for df in (documents(spark, rows), clashing(documents(spark, rows))):
        out = X.contamination(df, bench_table(spark, bench))
        assert held(out) == want
        left = X.without_contaminated(df, bench_table(spark, bench))
        assert left.columns == df.columns and left.count() == sum(not w[2] for w in want)
    assert X.contamination(df.limit(0), bench_table(spark, bench)).count() == 0
    assert held(X.contamination(df, bench_table(spark, bench).limit(0))) == expected([r[:2] for r in rows], [])


@pytest.mark.parametrize("seed, width, block", [(1, 10, 10**6), (3, 10, 40), (4, 2, 25)])
def test_random_texts_in_blocks(spark, seed, width, block):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice(["a", "b", "C", "é", "d1"]) + draw.choice([" ", ", ", "\n"]) for _ in range(draw.randint(0, n)))
    docs = [(i, text(150)) for i in range(60)] + [(3, "a b"), (None, None)]
    bench = [(str(i % 15), text(14)) for i in range(20)] + [("q", docs[7][1])]
    out = X.contamination(documents(spark, docs), bench_table(spark, bench), width=width, block=block)
    assert held(out) == expected(docs, bench, width)


def test_pieces_of_long_texts_join():
    import pyarrow as pa

    draw = random.Random(9)
    text = "".join(draw.choice(["aa", "B", "ccc", "é"]) + draw.choice([" ", "--", ""]) for _ in range(4000))
    bench = [("x", " ".join(words(text)[i : i + 12])) for i in range(0, 2000, 97)] + [("y", "aa b")]
    for size in (30, 200, 1 << 20):
        pairs = set()
        for b in bench:
            (r,) = X._item_windows([pa.record_batch({"item": pa.array([b[0]]), "text": pa.array([b[1]])})], 10)
            pairs |= set(zip(r["item"].to_pylist(), r["window"].to_pylist()))
        index = X.Index(sorted(pairs))
        ok = {n: {k: 1 for k in range(len(h))} for n, h in index.shingles.items()}
        index.rarest(ok)
        spans, items, n = [], set(), 0
        for c in _words.chunks(pa.array([text]), 9, size):
            n += int(c.own.sum())
            for p, a, z, w in X._occurrences(c, index):
                spans.append((int(c.base[p]) + a, int(c.base[p]) + z))
                items.update(index.items[w])
        merged = X._merged(spans)
        assert [(1, n, sum(s["stop"] - s["start"] for s in merged), tuple(sorted(items)))] == expected([(1, text)], bench)


def test_rarest_shingle_leads(spark):
    docs = [(i, "common words here " * 30) for i in range(50)] + [(99, "zebra common words here and more of it come now then")]
    bench = [("z", "zebra common words here and more of it come now then")]
    assert held(X.contamination(documents(spark, docs), bench_table(spark, bench))) == expected(docs, bench)
    index = X.Index([("z", "common words here and more of it come now")])
    counts = {3: {k: (9 if k else 1) for k in range(len(index.shingles[3]))}}
    assert len(index.rarest(counts).shingles[3]) == 1


def test_query_and_sql(spark, sf):
    out = sorted(tuple(r) for r in X.op12_decontamination(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in expected(docs, bench))
    assert out == want and any(w[5] for w in want)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({X.OP12_SQL})").fetchall()) == want
