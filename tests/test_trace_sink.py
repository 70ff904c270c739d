import os

import pytest
from pyspark.sql import functions as F

from lexigrid.sources import io


def sink(tmp_path):
    return io.TraceSink(f"{tmp_path}/private/full", f"{tmp_path}/out/public", texts=("text",), root=str(tmp_path), private=("private",))


def rows(spark, path, *columns):
    return sorted(tuple(r) for r in spark.read.json(str(path)).select(*columns).collect())


def left(tmp_path):
    """What lies beside the two views."""
    return sorted(n for folder in ("private", "out") if (tmp_path / folder).exists() for n in os.listdir(tmp_path / folder) if not n.startswith("."))


def test_both_views_are_replaced_together(spark, tmp_path):
    s, df = sink(tmp_path), spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    assert s.write(df) == {"full": 2, "public": 2}
    assert s.write(df.filter("id = 1").withColumn("text", F.lit("c"))) == {"full": 3, "public": 3}
    assert rows(spark, tmp_path / "private/full", "id", "text") == [(1, "c")]
    assert "text" not in spark.read.json(f"{tmp_path}/out/public").columns
    assert rows(spark, tmp_path / "out/public", "id") == [(1,)] and left(tmp_path) == ["full", "public"]


def test_a_failed_second_write_leaves_both_as_they_were(spark, tmp_path, monkeypatch):
    s, df = sink(tmp_path), spark.createDataFrame([(1, "a")], "id long, text string")
    s.write(df)
    write = io.write_jsonl

    def killed(view, path):
        if "public" in path:
            write(view.withColumn("id", F.raise_error(F.lit("killed")).cast("long")), path)
        write(view, path)

    monkeypatch.setattr(io, "write_jsonl", killed)
    with pytest.raises(Exception, match="killed"):
        s.write(df.withColumn("text", F.lit("new")))
    assert rows(spark, tmp_path / "private/full", "id", "text") == [(1, "a")]
    assert rows(spark, tmp_path / "out/public", "id") == [(1,)] and left(tmp_path) == ["full", "public"]
    assert s.counts == {"full": 1, "public": 1}


def test_a_decided_commit_is_carried_through(spark, tmp_path, monkeypatch):
    s, df = sink(tmp_path), spark.createDataFrame([(1, "a")], "id long, text string")
    s.write(df)
    move, calls = io._move, []

    def lost(spark, old, new):
        calls.append(new)
        if len(calls) == 2:
            raise KeyboardInterrupt
        move(spark, old, new)

    monkeypatch.setattr(io, "_move", lost)
    with pytest.raises(KeyboardInterrupt):
        s.write(df.withColumn("id", F.lit(7)))
    assert rows(spark, tmp_path / "out/public", "id") == [(1,)]
    monkeypatch.setattr(io, "_move", move)
    again = sink(tmp_path)
    assert again.recover(spark) and not again.recover(spark)
    assert rows(spark, tmp_path / "private/full", "id") == [(7,)] == rows(spark, tmp_path / "out/public", "id")
    assert left(tmp_path) == ["full", "public"]


def test_one_view_alone(spark, tmp_path):
    s = io.TraceSink(None, f"{tmp_path}/out/public", texts=("text",))
    df = spark.createDataFrame([(1, None)], "id long, text string")
    assert s.write(df.limit(0)) == {"full": 0, "public": 0}
    assert s.write(df) == {"full": 0, "public": 1} and left(tmp_path) == ["public"]
