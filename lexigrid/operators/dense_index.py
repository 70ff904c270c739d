"""Approximate dense search: a stored index of inverted lists around trained centroids.

Vectors of length one are dealt to the list of their nearest centroid, with a code of four bits a component beside them. A query looks into
the `probes` lists whose centroids are nearest to it, ranks what is there by the codes, and compares the `depth` best of them by cosine in
double precision. Similarities are therefore exact; what may be missed are neighbours in other lists or beyond the `depth` best codes. The
centroids are fitted to a bounded sample (`sample` vectors, those with the least hashes of their ids), and every vector is in a list,
whatever the sample. Codes take an eighth of the bytes of single-precision vectors, and only their column is read to rank a list; tests measure
recall and how many vectors are compared in full.

Lists are stored as partitions, so those that no query asks for aren't read. A list is cut into cells of about `cell` vectors and the queries
of a list into blocks of about `block`, so a list that holds a third of all vectors is spread over many tasks. A cell returns the `depth` best for
each query of a block.

Defined results: vectors and queries that are null, zero, or hold null or non-finite components are left out, as is a query of another
dimension; a vector of another dimension than the sample's most frequent one raises. Ties go by id. An empty table makes an empty index; an id that repeats raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.operators.retrieval import unit
from lexigrid.sources.io import assert_unique
from lexigrid.sources.scratch import ship


def _usable(df: DataFrame, id: str, embedding: str) -> DataFrame:
    """id and the vector `_u` of length one, where it has one."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & finite).select(F.col(id), unit(v).alias("_u")).filter("_u is not null")


def train_centroids(units: DataFrame, lists: int, sample: int, *, id: str, seed: int = 11):
    """Centroids of length one by k-means over the cosine, of the `sample` rows with the least hashes; None without rows."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    least = units.orderBy(F.xxhash64(id), id).limit(sample)
    dims = least.groupBy(F.size("_u").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return None
    points = least.filter(F.size("_u") == dims["dim"]).select(array_to_vector("_u").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(points) if dims["count"] > 1 and lists > 1 else None
    centers = np.array(model.clusterCenters() if model else [points.first()["features"].toArray()])
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def _near_partition(batches, centers, p: int):
    """The batches with `_near`: the p nearest centroids of each vector, nearest first, ties by number; none for another dimension."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        u, near = batch.column("_u"), [[]] * batch.num_rows
        fits = np.flatnonzero(u.value_lengths().to_numpy(zero_copy_only=False) == centers.shape[1])
        for at in range(0, len(fits), 4096):
            part = fits[at : at + 4096]
            dots = u.take(pa.array(part)).flatten().to_numpy().reshape(len(part), -1) @ centers.T
            for i, row in zip(part, np.argsort(-dots, axis=1, kind="stable")[:, :p].astype("i4")):
                near[i] = row
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "_near"])


def encode(u):
    """Four bits a component, two in a byte, and the scale of each row; an odd last byte has an empty half."""
    import numpy as np

    scale = np.abs(u).max(1, keepdims=True) / 7
    q = (np.clip(np.round(u / scale), -7, 7) + 8).astype("u1")
    if q.shape[1] % 2:
        q = np.hstack([q, np.full((len(q), 1), 8, "u1")])
    return q[:, ::2] << 4 | q[:, 1::2], scale[:, 0]


def decode(codes, scale, dim: int):
    """The vectors that codes stand for."""
    import numpy as np

    out = np.empty((len(codes), codes.shape[1] * 2), "f4")
    out[:, ::2], out[:, 1::2] = codes >> 4, codes & 15
    return (out[:, :dim] - 8) * scale[:, None].astype("f4")


def _code_partition(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        u = batch.column("_u")
        codes, scales = [], np.empty(batch.num_rows)
        for at in range(0, batch.num_rows, 4096):
            part = u.slice(at, 4096)
            code, scales[at : at + 4096] = encode(part.flatten().to_numpy().reshape(len(part), -1))
            codes += [c.tobytes() for c in code]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(scales)], names=[*batch.schema.names, "_code", "_scale"])


def _near(units: DataFrame, centers, p: int) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in units.dtypes) + ", _near array<int>"
    return units.mapInArrow(lambda b: _near_partition(b, centers, p), schema)


def write_dense_index(vectors: DataFrame, path: str, *, id: str = "vec_id", embedding: str = "embedding", lists: int = 64, sample: int = 16_384, cell: int = 8192) -> None:
    """The index under path: `lists` (id, _u, _code, _scale, _at; partitioned by _list) and `centroids` (_list, centroid, size, cells). An older one goes."""
    spark = vectors.sparkSession
    ship(spark)
    assert_unique(vectors, id)
    units = _usable(vectors, id, embedding)
    centers = train_centroids(units, lists, sample, id=id)
    if centers is None:
        dealt = units.selectExpr(f"`{id}`", "_u", "0 AS _list", "0 AS _at", "X'' AS _code", "0D AS _scale")
    else:
        other = F.raise_error(F.lit(f"a vector of another dimension than {centers.shape[1]}")).cast("int")
        dealt = _near(units, centers, 1).select(id, "_u", F.when(F.size("_near") > 0, F.col("_near")[0]).otherwise(other).alias("_list"))
        dealt = dealt.withColumn("_at", F.pmod(F.xxhash64(id), F.lit(1 << 20)).cast("int"))
        dealt = dealt.mapInArrow(_code_partition, ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", _code binary, _scale double")
    slices = F.col("_at") % 8  # a list that holds a third of the rows is written by several tasks
    dealt.repartition("_list", slices).sortWithinPartitions("_list").write.mode("overwrite").partitionBy("_list").parquet(f"{path}/lists")
    sizes = {}
    if centers is not None:
        stored = spark.read.parquet(f"{path}/lists")
        sizes = {r["_list"]: r["n"] for r in stored.groupBy("_list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a list
    rows = [(i, c.tolist(), sizes.get(i, 0), max(1, -(-sizes.get(i, 0) // cell))) for i, c in enumerate(centers if centers is not None else [])]
    spark.createDataFrame(rows, "_list int, centroid array<double>, size long, cells int").write.mode("overwrite").parquet(f"{path}/centroids")


def _best(found, asked, depth: int, id: str, query_id: str, schema):
    """The `depth` best of a cell by their codes, for each query of a block."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not found.num_rows or not asked.num_rows:
        return schema.empty_table()
    found = found.take(pc.sort_indices(found.column(id)))  # ties by id
    u = asked.column("_u").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, -1)
    codes = np.frombuffer(b"".join(found.column("_code").to_pylist()), "u1").reshape(found.num_rows, -1)
    near = u.astype("f4") @ decode(codes, found.column("_scale").to_numpy(), u.shape[1]).T
    top = np.argsort(-near, axis=1, kind="stable")[:, :depth]
    each = np.repeat(np.arange(asked.num_rows), top.shape[1])
    cols = [asked.column(query_id).take(pa.array(each)), found.column(id).take(pa.array(top.reshape(-1))), found.column("_list").take(pa.array(top.reshape(-1))), pa.array(near[each, top.reshape(-1)].astype("f8"))]
    return pa.table(cols, schema=schema)


def candidates(spark: SparkSession, path: str, queries: DataFrame, *, probes: int, depth: int, block: int, id: str, embedding: str, query_id: str) -> tuple[DataFrame, DataFrame] | None:
    """(query_id, id, _list, near, place): the `depth` best of each query by code, and the lists that queries ask for; None for an empty index."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(spark)
    told = spark.read.parquet(f"{path}/centroids").orderBy("_list").collect()  # one row a list
    if not told:
        return None
    lists = spark.read.parquet(f"{path}/lists")
    out = StructType().add(query_id, queries.schema[query_id].dataType).add(id, lists.schema[id].dataType).add("_list", "integer").add("near", "double")
    centers, cells = np.array([r["centroid"] for r in told]), {r["_list"]: r["cells"] for r in told}
    asked = _near(_usable(queries, query_id, embedding), centers, probes).select(query_id, "_u", F.explode("_near").alias("_list"))
    count = asked.groupBy("_list").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a list at most
    shape = spark.createDataFrame([(r["_list"], cells[r["_list"]], -(-r["n"] // block)) for r in count], "_list int, _cells int, _blocks int")
    lists = lists.filter(F.col("_list").isin([r["_list"] for r in count]))
    own = lists.join(F.broadcast(shape), "_list")
    own = own.withColumn("_cell", F.col("_at") % F.col("_cells")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    asked = asked.join(F.broadcast(shape), "_list").withColumn("_block", F.pmod(F.xxhash64(query_id), F.col("_blocks")).cast("int"))
    asked = asked.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    key, arrow = ["_list", "_cell", "_block"], to_arrow_schema(out)
    met = own.select(*key, id, "_code", "_scale").groupBy(*key).cogroup(asked.select(*key, query_id, "_u").groupBy(*key))
    found = met.applyInArrow(lambda a, b: _best(a, b, depth, id, query_id, arrow), out)
    order = Window.partitionBy(query_id).orderBy(F.desc("near"), id)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= depth), lists


def dense_index_topk(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, *, probes: int = 40, depth: int = 50, block: int = 1024, id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """query_id, id, similarity, rank: the k best among the `depth` candidates of each query, whose similarities are exact."""
    both = candidates(spark, path, queries, probes=probes, depth=max(depth, k), block=block, id=id, embedding=embedding, query_id=query_id)
    if both is None:
        return queries.select(query_id, F.col(query_id).alias(id), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).filter("false")
    found, lists = both
    full = found.select(query_id, id, "_list").join(lists.select(id, "_list", "_u"), [id, "_list"]).join(_usable(queries, query_id, embedding).withColumnRenamed("_u", "_q"), query_id)
    dot = F.aggregate(F.zip_with("_u", "_q", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    order = Window.partitionBy(query_id).orderBy(F.round("similarity", 9).desc(), id)
    return full.select(query_id, id, dot.alias("similarity")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class DenseIndexRetriever:
    """The index as a retriever: `similarity` stands as the score."""

    def __init__(self, spark: SparkSession, path: str, **columns):
        self.spark, self.path, self.columns = spark, path, columns

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return dense_index_topk(self.spark, self.path, queries, k, **self.columns).withColumnRenamed("similarity", "score")
