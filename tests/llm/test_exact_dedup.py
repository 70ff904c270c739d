from collections import defaultdict

from pyspark.sql import functions as F

from lexigrid.llm import exact_dedup as X

from .helpers import clashing, documents, edge_rows


def expected(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in by.items()}
    return sorted(((i, best[t or ""], len(by[t or ""])) for i, t in rows), key=repr)


def held(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in df.collect()), key=repr)


def test_edges(spark):
    rows = edge_rows() + [(100 + i, "hot") for i in range(40)]
    for df in (documents(spark, rows), clashing(documents(spark, rows))):
        out = X.dedup_decisions(df).cache()
        assert held(out) == expected(rows)
        assert out.filter("kept").count() == len({t or "" for _, t in rows})
    assert X.dedup_decisions(df.limit(0)).count() == 0


def test_state_over_several_batches(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    out = X.dedup_decisions(documents(spark, rows, 6), files_per_batch=1)
    assert held(out) == expected(rows)


def test_colliding_digests_are_found_by_their_bytes(spark):
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz"), (5, "cd"), (6, "ef")]
    out = X.dedup_decisions(documents(spark, rows), digest=lambda t: F.length(t).cast("string"))
    assert held(out) == expected(rows)


def test_rows_that_stay(spark):
    rows = edge_rows()
    df = clashing(documents(spark, rows))
    out = X.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(r["text"] or "" for r in out.collect()) == sorted({t or "" for _, t in rows})
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert held(X.op4_exact_dedup(spark, sf)) == expected(rows)
