r"""Target-distribution importance resampling: hashed run-of-words features weigh documents by how much likelier the target is to hold them.

Two passes over the texts, each a map over arrays: the first counts features in buckets (as many rows as buckets leave a task), the second
adds up the buckets' gains, an array of fixed size, for each document. Gumbel noise from a hash of the id turns the weights into a draw without
replacement of the highest scores. The k-th key is found exactly by radix selection over the digits of score and doc_id: each round counts
one 16-bit digit of the keys that share the digits found so far, at most 65,536 rows, and follows the digit that holds the k-th.
Only rows down to that key are sorted, by ranges, and ranked by prefix sums.

Defined results
* a null text has no words, no features and weight 0; a null doc_id is the empty text in the noise's hash and loses every tie.
* rows with equal score and doc_id are ranked by features, weight and row number, and exactly k rows are drawn whatever ties.
* without documents there are no rows; without a target every bucket's t is 0.
* very long texts are worked on in pieces that overlap by two words. Other columns pass through in a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.llm._shared import forget, numbered, ship, table, tidy, written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42


def _features(texts, buckets: int):
    """Chunks with, for each run length, the bucket of the run that ends at each word and whether it counts."""
    from lexigrid.llm._words import chunks, run_crcs

    for c in chunks(texts, LONGEST - 1):
        place, piece = c.inside()
        own = c.own[piece]
        yield c, [(crcs % buckets, (place >= n) & (place - n < own)) for n, crcs in enumerate(run_crcs(c, LONGEST))]


def _counted(batches, buckets: int):
    import numpy as np
    import pyarrow as pa

    counts = np.zeros(buckets, "i8")
    for batch in batches:
        for _, runs in _features(batch.column(0), buckets):
            for at, ok in runs:
                counts += np.bincount(at[ok], minlength=buckets)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(counts[at])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all documents by bucket."""
    ship(docs.sparkSession)
    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lambda b: _counted(tidy(b), buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, floor of 1000 times the natural logarithm of the smoothed ratio; one number a bucket, so it may stay on the driver."""
    s, t = (bucket_counts(x, buckets=buckets).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    rows = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    rows = written(rows, "buckets")
    total = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    real = lambda c, more: (c + F.lit(more)).cast("double")
    ratio = real(F.col("t"), 1) * real(F.lit(total["s"]), buckets) / (real(F.col("s"), 1) * real(F.lit(total["t"]), buckets))
    out = [r[0] for r in rows.orderBy("bucket").select(F.floor(F.lit(1000.0) * F.log(ratio))).collect()]
    forget(rows)
    return out


def _weighed(batches, gains):
    import numpy as np
    import pyarrow as pa

    gains = np.array(gains.value, "i8")
    for batch in batches:
        n_words, n_features, weight = (np.zeros(batch.num_rows, "i8") for _ in range(3))
        for c, runs in _features(batch.column(1), len(gains)):
            np.add.at(n_words, c.rows, c.own)
            for at, ok in runs:
                for out, values in ((n_features, ok), (weight, np.where(ok, gains[at], 0))):
                    sums = np.zeros(len(ok) + 1, "i8")
                    np.cumsum(values, out=sums[1:])
                    np.add.at(out, c.rows, sums[c.first[1:]] - sums[c.first[:-1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["row", "n_words", "n_features", "weight"])


def weighed(docs: DataFrame, gains: list[int], *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """row (a struct of the columns to keep, all if None), n_words, n_features and weight, the sum of the gains of a document's features."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(gains)
    rows = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"), docs[text].cast("string").alias("text"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("n_words long, n_features long, weight long")])
    return rows.mapInArrow(lambda b: _weighed(tidy(b), shared), schema)


def noisy(weight, doc_id, seed: int = SEED):
    """weight with Gumbel noise: floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _digits(score, doc_id) -> list:
    """The key's digits, the highest first, larger is better: score as an unsigned number, whether there is an id, and the id from the smallest."""
    least = F.lit(-(2**63))
    sixteen = lambda c: [F.shiftrightunsigned(c.bitwiseXOR(least), 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(4)]
    return [*sixteen(score), doc_id.isNotNull().cast("int"), *sixteen(F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")))]


def kth_key(rows: DataFrame, k: int, score: str = "score", doc_id: str = "doc_id") -> list[int]:
    """The leading digits of the k-th highest key: rows whose digits are at least these are the k highest and those that tie with the k-th in all digits.

    One counting job a round, over a table that is best written; it ends as soon as the rows that share the digits are all wanted."""
    digits = _digits(F.col(score), F.col(doc_id))
    found: list[int] = []
    for d in digits:
        same = rows
        for e, v in zip(digits, found):
            same = same.filter(e == v)
        left = k
        for r in sorted(same.groupBy(d.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["digit"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        found.append(r["digit"])
        k = left
        if r["n"] == k:
            break
    return found


def _at_least(digits: list, found: list[int]):
    """Whether the digits are at least those found, compared from the first on."""
    out = F.lit(True)
    for d, v in reversed(list(zip(digits, found))):
        out = (d > v) | ((d == v) & out)
    return out


def drawn(rows: DataFrame, k: int, eligible, *, score: str = "score", doc_id: str = "doc_id", ties: tuple = ()) -> DataFrame:
    """All rows (a written table) with rank: 1 .. k of the eligible ones with the highest scores, equal ones by smaller doc_id and then by `ties`; null for the rest."""
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if k <= 0:
        return none
    wanted = F.coalesce(eligible & _at_least(_digits(F.col(score), F.col(doc_id)), kth_key(rows.filter(eligible), k, score, doc_id)), F.lit(False))
    top = numbered(rows.filter(wanted), [F.col(score).desc(), F.col(doc_id).asc_nulls_last(), *ties], "drawn", name="rank")
    top = top.withColumn("rank", F.when(F.col("rank") < k, F.col("rank") + 1))
    return none.filter(~wanted).unionByName(top)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns to keep), doc_id, n_words, n_features, weight, score and rank of every document; floor(percent N / 100) of the N documents of least_words or more are drawn."""
    gains = bucket_gains(docs, target)
    keep = docs.columns if keep is None else keep
    out = weighed(docs, gains, keep=list(dict.fromkeys([*keep, doc_id])))
    out = out.withColumn("doc_id", F.col("row").getField(doc_id).cast("long"))
    out = written(out.withColumns({"score": noisy(F.col("weight"), F.col("doc_id"), seed), "no": F.monotonically_increasing_id()}), "weighed")
    eligible = F.col("n_words") >= least_words
    n = out.filter(eligible).count()
    return drawn(out, percent * n // 100, eligible, ties=("n_features", "weight", "no")).drop("no")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")
