"""JSON-lines sources and sinks, policy files, traces in a full and a public view."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.rounding import rounded


class PublicationBoundaryError(ValueError):
    """A full view was about to leave the private folders."""


class MissingLicensedData(FileNotFoundError):
    """A private file that a run needs isn't there."""


def private_file(path: str) -> str:
    """path, if it is there; else raises."""
    if not os.path.exists(path):
        raise MissingLicensedData(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines don't count, no rows raise, and a row without a required field raises when it is read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    for name in required:
        rows = rows.withColumn(name, F.coalesce(name, F.raise_error(F.lit(f"missing {name}")).cast(rows.schema[name].dataType)))
    return rows


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def assert_unique(df: DataFrame, *keys: str) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate keys: {twice}")


def read_policy(path: str, allowed: tuple[str, ...]) -> dict:
    """Settings from a JSON file; names that begin with _ are comments, unknown ones raise."""
    with open(path, encoding="utf-8") as f:
        told = {k: v for k, v in json.load(f).items() if not k.startswith("_")}
    if unknown := sorted(set(told) - set(allowed)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return told


def public_view(traces: DataFrame, *texts: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Digests in place of the named texts."""
    return traces.withColumns({f"{t}_digest": T.text_digest(F.col(t)) for t in texts}).drop(*texts, *drop)


def assert_private_destination(path: str, root: str, private: tuple[str, ...]) -> str:
    """The resolved path, if it is in one of root's private folders; else raises."""
    real = os.path.realpath(path)
    for folder in private:
        if os.path.commonpath([real, home := os.path.realpath(os.path.join(root, folder))]) == home:
            return real
    raise PublicationBoundaryError(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _move(spark: SparkSession, old: str, new: str) -> None:
    """old in the place of new, whose former files go. Where old is no longer there it has been moved before."""
    source, fs = _fs(spark, old)
    if not fs.exists(source):
        return
    target, _ = _fs(spark, new)
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"could not move {old} to {new}")


class TraceSink:
    """Writes traces in full to a private folder, as a public view anywhere, or both; write() replaces what was there and gives the counts of all its calls.

    Where both are written, traces are computed once, into a table beside the full view's folder, and both views are made from it in
    staging folders. Only when both are complete and hold equally many rows is a commit file written; that decides it, and the views are then moved to their
    places. A failure before leaves both destinations as they were; a driver lost after it leaves the commit file, which recover() or
    the next write carries through. Fields are rounded by name (functions.rounding). Nothing private is staged outside the private folder."""

    def __init__(self, full_path: str | None = None, public_path: str | None = None, *, texts: tuple[str, ...] = (), drop: tuple[str, ...] = (), root: str = ".", private: tuple[str, ...] = ()):
        if full_path is None and public_path is None:
            raise ValueError("a trace sink needs a destination")
        self.full_path = None if full_path is None else assert_private_destination(full_path, root, private)
        self.public_path, self.texts, self.drop = public_path, texts, drop
        self.counts = {"full": 0, "public": 0}

    def _targets(self) -> dict[str, str]:
        both = {"full": self.full_path, "public": self.public_path}
        return {name: path.rstrip("/") for name, path in both.items() if path is not None}

    def _commit_file(self) -> str:
        return f"{next(iter(self._targets().values()))}._commit"

    def recover(self, spark: SparkSession) -> bool:
        """Carries a decided commit through; whether there was one."""
        at, fs = _fs(spark, self._commit_file())
        if not fs.exists(at):
            return False
        staged = json.loads(spark.read.text(self._commit_file(), wholetext=True).first()[0])
        for name, path in self._targets().items():
            _move(spark, staged[name], path)
        fs.delete(at, False)
        return True

    def write(self, traces: DataFrame) -> dict[str, int]:
        spark, targets, run = traces.sparkSession, self._targets(), uuid.uuid4().hex
        self.recover(spark)
        staged = {name: f"{path}._staging-{run}" for name, path in targets.items()}
        rows, counts = f"{self.full_path}._rows-{run}", {}
        traces = rounded(traces)
        try:
            if len(targets) > 1:
                traces.write.parquet(rows)
                traces = spark.read.schema(traces.schema).parquet(rows)
            for name in targets:
                view, seen = traces if name == "full" else public_view(traces, *self.texts, drop=self.drop), Observation()
                write_jsonl(view.observe(seen, F.count(F.lit(1)).alias("n")), staged[name])
                counts[name] = seen.get["n"]
            if len(set(counts.values())) > 1:
                raise ValueError(f"the views differ: {counts}")
        except BaseException:
            for path in staged.values():
                _delete(spark, path)
            raise
        finally:
            if len(targets) > 1:
                _delete(spark, rows)
        at, fs = _fs(spark, f"{self._commit_file()}-{run}")
        out = fs.create(at)
        out.write(bytearray(json.dumps(staged), "utf-8"))
        out.close()
        if not fs.rename(at, _fs(spark, self._commit_file())[0]):  # whole or not at all
            raise OSError("could not commit")
        self.recover(spark)
        for name, n in counts.items():
            self.counts[name] += n
        return dict(self.counts)


def write_traces(traces: DataFrame, full_path: str, public_path: str, *texts: str, root: str, private: tuple[str, ...]) -> dict[str, int]:
    return TraceSink(full_path, public_path, texts=texts, root=root, private=private).write(traces)


def assert_no_text(public: DataFrame, snippets: DataFrame, *, snippet: str = "text") -> None:
    """Raises if a string of a public row, or the row as JSON, holds one of the snippets; blank ones don't count."""
    from lexigrid.operators.retrieval import contains_join

    strings = [F.col(f.name) for f in public.schema.fields if f.dataType.simpleString() == "string"]
    rows = public.select(F.explode(F.array(F.to_json(F.struct(*public.columns)), *strings)).alias("row"))
    needles = snippets.select(F.trim(snippet).alias("needle")).filter("needle <> ''").distinct()
    if not contains_join(rows, needles, text="row", needle="needle").isEmpty():
        raise PublicationBoundaryError("a public row holds corpus text")


def provenance(spark: SparkSession, **told) -> DataFrame:
    """One row: where a run's numbers come from, as name and JSON value, with the versions of Python and Spark."""
    import platform

    rows = sorted((told | {"python": platform.python_version(), "spark": spark.version}).items())
    return spark.createDataFrame([({k: json.dumps(v) for k, v in rows},)], "provenance map<string,string>")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file over several lines (ids, addresses, digests, licences) as a table; members of a top-level list `sources` become rows."""
    told = spark.read.option("multiLine", True).json(path)
    return told.select(F.explode("sources").alias("s")).select("s.*") if "sources" in told.columns else told


def catalog(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """standard_id, filename."""
    return spark.createDataFrame(pairs, "standard_id string, filename string")


def read_traces(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def write_index(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text") -> None:
    """The inverted index as Parquet tables under path: postings sorted by term in range partitions, so that a query's terms prune row groups, stats and idf."""
    from lexigrid.operators import retrieval

    assert_unique(docs, id)
    retrieval.postings(docs, id=id, text=text).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    retrieval.doc_stats(docs, id=id, text=text).write.mode("overwrite").parquet(f"{path}/stats")
    spark = docs.sparkSession
    n = spark.read.parquet(f"{path}/stats").count()
    retrieval.term_idf(spark.read.parquet(f"{path}/postings"), n).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/idf")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, stats, idf: read once for all queries."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("postings", "stats", "idf"))


def vector_metadata(*fields: str):
    """A map of the named fields as strings; null ones are left out."""
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def write_vectors(vectors: DataFrame, path: str, *, id: str = "vec_id", embedding: str = "embedding", metadata: tuple[str, ...] = ()) -> int:
    """Vectors of length one as Parquet with a map of their metadata; an older table goes. A zero vector raises; returns the count, counted while writing and verified on the written table."""
    assert_unique(vectors, id)
    v = F.col(embedding)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.raise_error(F.lit("vector without length")))
    extra = [vector_metadata(*metadata).alias("metadata")] if metadata else []
    seen = Observation()
    vectors.select(id, unit.alias(embedding), *extra).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n = vectors.sparkSession.read.parquet(path).count()
    if n != seen.get["n"]:
        raise ValueError(f"{n} vectors written, {seen.get['n']} given")
    return n


def read_vectors(spark: SparkSession, path: str, expected: int) -> DataFrame:
    out = spark.read.parquet(path)
    if (n := out.count()) != expected:
        raise ValueError(f"{n} vectors stored, {expected} expected")
    return out


def write_probes(probes: DataFrame, path: str) -> None:
    assert_unique(probes, "probe_id")
    write_jsonl(probes, path)


def read_probes(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_jsonl(spark, path, schema, ("probe_id", "basis", "question_text"))
