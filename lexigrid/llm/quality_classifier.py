r"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

One pass over the texts makes a row of statistics for each document, written as a table; all later
steps read that table. Random Fourier features approximate a Gaussian kernel over the standardised
statistics. Each partition sums its part of the normal equations; partial sums are added in groups
before the driver adds the rest (matrices of a fixed size). The ridge scores of a fold that the fit
did not see are calibrated: label sums in `CELLS` cells of the score, pooled to a monotone function
and interpolated between the pools' means.

All labelled rows that may be learnt from are used; nothing is sampled. doc_id decides on folds only.
The statistics are of the text alone.

Defined results
* null and empty texts: statistics of nothing (zeros), scored as any other.
* a label that is null, or a doc_id that is null, isn't learnt from. Labels that repeat for one
  doc_id: their mean. Without any label of either kind every score is the share of label 1 (0.5
  if there are no labels).
* doc_ids that repeat: one output row for each input row.
* very long texts: statistics of the whole text, in a bounded number of copies of it.
* ties: equal texts have equal scores; of equal raw scores in the calibrating fold the sums count.
* an empty table gives an empty result; other columns are ignored by quality_scores and returned
  unchanged by keep_good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import crc_mod, forget, ship, spread, table, tidy, written

WIDTH = 256
GAMMA = 0.03
RIDGE = 1e-3
CELLS = 4096
CLIP = 4.0
NAMES = (
    "log_chars", "log_words", "upper", "lower", "digit", "symbol", "sentence", "space", "newline", "high", "bang", "pipe",
    "mean_word", "long_word", "distinct", "repeat", "top_share", "ends", "caps_words", "symbol_words", "line_words", "repeat_lines", "marks_a_word", "letters_a_word",
)
STATS = "doc_id long, x array<double>"


def statistics(text: bytes):
    """NAMES' values for a UTF-8 text."""
    import numpy as np

    if not text.strip():
        return np.zeros(len(NAMES))
    c = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    n = len(text)
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), "i8", k)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeat = sum(a == b for a, b in zip(words, words[1:]))
    last = np.frombuffer(b"".join([w[-1:] for w in words]), "u1")
    first = np.frombuffer(b"".join([w[:1] for w in words]), "u1")
    mark_end = int(((last < 128) & ~((last >= 48) & (last <= 57)) & ~((last >= 65) & (last <= 90)) & ~((last >= 97) & (last <= 122)) & ~np.isin(last, list(b".,;:?\"')"))).sum())
    capital = (first >= 65) & (first <= 90)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    space = c[32] + c[9:14].sum()
    sentence = c[[44, 46]].sum()
    high = c[128:].sum()
    symbol = n - upper - lower - digit - space - sentence - high
    return np.array([
        np.log1p(n), np.log1p(k), upper / n, lower / n, digit / n, symbol / n, sentence / k, space / n, len(lines) / k, high / n, c[33] / k, c[124] / k,
        sizes.mean(), (sizes > 12).mean(), len(counts) / k, repeat / k, max(counts.values()) / k, (np.isin(last, list(b".?!"))).mean(), capital.mean(), mark_end / k, k / len(lines), 1 - len(set(lines)) / len(lines), symbol / k, (upper + lower + high) / k,
    ])


def _stats_partition(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0)
        for at in range(0, max(1, len(ids)), 2048):
            part = batch.column(1).slice(at, 2048)
            x = [statistics(t.as_py() or b"") for t in part]
            values = np.concatenate(x) if x else np.empty(0)
            offsets = pa.array(np.arange(len(x) + 1, dtype="i4") * len(NAMES))
            yield pa.RecordBatch.from_arrays([ids.slice(at, 2048), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["doc_id", "x"])


class Fourier:
    """cos(W z + b) of the standardised, clipped statistics, with the statistics themselves and a constant."""

    def __init__(self, mean, scale, width: int = WIDTH, gamma: float = GAMMA):
        import numpy as np

        rng = np.random.default_rng(71)
        self.mean, self.scale = np.asarray(mean, "f8"), np.asarray(scale, "f8")
        self.w = rng.standard_normal((len(self.mean), width)) * np.sqrt(2 * gamma)
        self.b = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x):
        import numpy as np

        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / CLIP, np.ones((len(z), 1))])


def _matrix(column):
    import numpy as np

    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, len(NAMES)))


def _normal_partition(batches, features: Fourier):
    """One row: the partition's part of Z'Z and Z'y."""
    import numpy as np
    import pyarrow as pa

    a = b = None
    for batch in batches:
        if len(batch):
            z, y = features(_matrix(batch.column(0))), batch.column(1).to_numpy()
            a, b = (z.T @ z, z.T @ y) if a is None else (a + z.T @ z, b + z.T @ y)
    if a is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b]).tobytes()])], names=["a"])


def _add_parts(batches):
    """The sum of a partition's parts, added as they come: one sum is held."""
    import numpy as np
    import pyarrow as pa

    total = None
    for batch in batches:
        for v in batch.column(0):
            part = np.frombuffer(v.as_buffer(), "f8")
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["a"])


def fit_ridge(rows: DataFrame, features: Fourier, ridge: float = RIDGE):
    """Weights out of rows (x, y). Partial sums are added in at most 64 groups, in the order of partitions, one of which reaches the driver at a time."""
    import numpy as np

    parts = rows.select("x", "y").mapInArrow(lambda b: _normal_partition(b, features), "a binary").withColumn("p", F.spark_partition_id())
    parts = parts.withColumn("g", F.pmod(F.col("p"), F.lit(64))).repartition(64, "g").sortWithinPartitions("p").select("a").mapInArrow(_add_parts, "a binary")
    total = 0
    for r in parts.toLocalIterator():
        total = total + np.frombuffer(r["a"], "f8")
    n = int(round((np.sqrt(4 * len(total) + 1) - 1) / 2))  # n * n + n numbers
    a, b = total[: n * n], total[n * n :]
    a = a.reshape(n, n)
    return np.linalg.solve(a + ridge * np.trace(a) / n * np.eye(n), b)


def isotonic(sums: list[tuple[float, float, float]]):
    """(score, calibrated) knots out of (score, count, label sum) cells in the order of score: adjacent violators are pooled, each pool counts one half of a label of each kind more."""
    pools: list[list[float]] = []
    for s, n, y in sums:
        pools.append([s * n, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return [p[0] / p[1] for p in pools], [(p[2] + 0.5) / (p[1] + 1) for p in pools]


class Model:
    """Scores rows of statistics. knots at the ends let the order of scores outside the fold's range show."""

    def __init__(self, features=None, weights=None, knots=None, constant: float = 0.5):
        self.features, self.weights, self.knots, self.constant = features, weights, knots, constant

    def raw(self, x):
        return self.features(x) @ self.weights

    def score(self, x):
        import numpy as np

        if self.features is None:
            return np.full(len(x), self.constant)
        raw = self.raw(x)
        s, p = self.knots
        s, p = [min(s[0], 0.0) - 1.0, *s, max(s[-1], 1.0) + 1.0], [p[0] / 2, *p, (1 + p[-1]) / 2]
        return np.clip(np.interp(raw, s, np.maximum.accumulate(p)), 0.0, 1.0)


def _raw_partition(batches, model: Model):
    import pyarrow as pa

    for batch in batches:
        if len(batch):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], names=["raw", "y"])


def _score_partition(batches, model: Model):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])


def text_statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, NAMES' values, for each row; a written table."""
    ship(docs.sparkSession)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")))
    return written(rows.mapInArrow(lambda b: tidy(_stats_partition(b)), STATS), "stats")


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, y in 0..1, only rows to learn from. A fifth by a hash of doc_id calibrates, the others fit the ridge."""
    labels = labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    rows = written(stats.join(labels, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("last")), "learn")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.count_if(F.col("last")).alias("last"), F.count_if(~F.col("last")).alias("first")).collect()[0]
    if not told["n"] or told["y"] in (0, told["n"]) or not told["last"] or not told["first"]:
        return Model(constant=0.5 if not told["n"] else float(told["y"] / told["n"]))
    moments = [f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    m = rows.filter("not last").agg(*moments).collect()[0]
    features = Fourier([m[f"m{i}"] for i in range(len(NAMES))], [max(m[f"s{i}"], 1e-6) for i in range(len(NAMES))])
    model = Model(features, fit_ridge(rows.filter("not last"), features))
    raw = rows.filter("last").select("x", "y").mapInArrow(lambda b: _raw_partition(b, model), "raw double, y double")
    cell = F.floor((F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) + 1) / 3 * CELLS)
    cells = raw.groupBy(cell.alias("cell")).agg(F.avg("raw").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("cell").collect()  # CELLS rows and one at most
    model.knots = isotonic([(r["s"], r["n"], r["y"]) for r in cells])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id", hold_out: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns from labels, with hold_out only from those whose crc32(doc_id as text) mod 3 is not 1."""
    stats = text_statistics(docs, doc_id=doc_id, text=text)
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label).alias("y"))
    held_out = crc_mod("doc_id", 3) == 1
    model = fit(stats, known.filter(~held_out) if hold_out else known)
    out = stats.mapInArrow(lambda b: tidy(_score_partition(b, model)), "doc_id long, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the classifier, fitted to all labels, doesn't reject. Each row is decided by its own text, whose statistics are computed a second time where it is read: no text is shuffled or written, and the statistics to learn from go once the model is there."""
    stats = text_statistics(docs, doc_id=doc_id, text=text)
    model = fit(stats, labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label).alias("y")))
    forget(stats)

    @F.arrow_udf("double")
    def score(texts):
        import numpy as np
        import pyarrow as pa

        x = [statistics(t.as_py() or b"") for t in texts]
        return pa.array(model.score(np.stack(x)) if x else [], pa.float64())

    return spread(docs).filter(score(F.col(text).cast("string").cast("binary")) >= 0.5).select(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
