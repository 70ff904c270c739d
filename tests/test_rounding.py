import random

from pyspark.sql import functions as F

from lexigrid.functions import rounding as R
from lexigrid.sources import io


def test_as_python_rounds(spark):
    rng = random.Random(5)
    values = [n / 20000 for n in range(-400, 4000)] + [n / 32 for n in range(200)] + [n / 128 for n in range(-99, 99)] + [rng.random() for _ in range(3000)] + [rng.uniform(-9e4, 9e4) for _ in range(1000)] + [2.675, 0.0, 5e-324, 1e-7, 0.9999995, 2.0**30 + 0.3]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", R.round_exact(F.col("x"), 4).alias("a"), R.round_exact(F.col("x"), 6).alias("b"))
    for r in df.collect():
        assert (r["a"], r["b"]) == (round(r["x"], 4), round(r["x"], 6)), r


def test_what_has_no_places(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1e300,)], "x double").select(R.round_exact(F.col("x"), 4).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [float("inf"), 1e300]


def test_a_full_trace_round_trips(spark, tmp_path):
    schema = "id long, echo_ratio double, other double, audit struct<rows: array<struct<best_overlap: double, rank: int>>, passed: boolean>, stage_seconds map<string,double>, coverage double"
    x = 0.123456789
    rows = [(1, x, x, ([(x, 1), (None, 2), None], True), {"bm25": x, "none": None}, x), (2, None, None, None, None, None), (3, x, x, (None, None), {}, 1.0)]
    df = spark.createDataFrame(rows, schema)
    s = io.TraceSink(f"{tmp_path}/p/full", f"{tmp_path}/public", texts=(), root=str(tmp_path), private=("p",))
    s.write(df)
    for path in (f"{tmp_path}/p/full", f"{tmp_path}/public"):
        back = {r["id"]: r.asDict(recursive=True) for r in io.read_traces(spark, path, df.schema).collect()}
        assert back[1]["echo_ratio"] == 0.1235 and back[1]["other"] == x and back[1]["coverage"] == 0.123457
        assert [o and o["best_overlap"] for o in back[1]["audit"]["rows"]] == [0.1235, None, None] and back[1]["audit"]["passed"] is True
        assert back[1]["stage_seconds"]["bm25"] == 0.123457
        assert back[2]["audit"] is None and back[2]["echo_ratio"] is None and back[3]["coverage"] == 1.0


def test_nothing_else_changes(spark):
    df = spark.createDataFrame([(1, "a.b", 0.123456789)], ["id", "dotted.name", "score"])
    assert R.rounded(df).collect() == df.collect() and R.rounded(df).schema == df.schema
