r"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a fixed shuffled order (md5 of seed and doc_id), `passes` times
over. An item's virtual finish time is the cumulative size of its source up to and with it,
divided by the source's target. All items in the order of virtual finish time, cut where their
sizes pass the total budget, are the mix. All in DataFrame operations.

Cumulative sizes come from two levels: sums for each source and slice of the shuffled order,
then a running sum within a slice, so a source with a third of all rows is spread over `slices`
tasks, whose number follows the number of rows. The cut is found by sums over slices of the virtual time, of which only the one where
the budget ends is looked at row by row. Texts are read once, for their size, and not shuffled.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share `share` of all
sizes; a target stops at `passes` times its source's size and the excess goes to the others by
weight until none is above. Nothing puts all sources in one task.

Defined results
* null text, or text without words: size 0, taken 0. Null source: a source of its own, last.
* repeated rows: each counts; equal rows are interchangeable and ordered arbitrarily.
* an empty table gives an empty result; if all sizes are 0 so are all targets.
* only doc_id, text and source are read; mix_documents returns docs' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm._shared import WORD, table, written

WEIGHTS = (5, 2, 1)


def shuffle_key(doc_id: str, seed: str):
    """A 60-bit number from the md5 of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, passes: int = 2) -> DataFrame:
    """source, source_size, target, budget; one row for each source.

    Places come from a range sort: within each range by a window, over the ranges by their numbers of sources. The level that
    sources share by weight is found in rounds: those that stop below it leave their excess to the others, until none does."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    by = written(by.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = by.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("first"))  # one row a range
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    by = by.join(F.broadcast(first), "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * passes).alias("most"))
    budget = float(by.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).collect()[0]["s"]) * share
    level = 0.0
    while True:
        open_ = F.col("most") > F.lit(level) * F.col("weight")
        told = by.agg(F.coalesce(F.sum(F.when(~open_, F.col("most"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0)).alias("left")).collect()[0]
        after = (budget - told["full"]) / told["left"] if told["left"] else None
        if after is None or after <= level:
            break
        level = after
    target = F.col("most").cast("double") if after is None else F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double"))
    return by.select("source", "source_size", target.alias("target"), F.lit(budget).alias("budget"))


def mix_decisions(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, passes: int = 2, seed: str = "mix", slices: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) for each row of docs."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), shuffle_key(doc_id, seed).alias("key"))
    rows = written(rows, "sizes")
    slices = slices or max(256, rows.count() // 200_000)  # no slice of a source grows with the data
    rows = rows.withColumn("slice", F.floor(F.col("key") / float(1 << 60) * slices).cast("int"))
    aims = written(targets(rows, weights=weights, share=share, passes=passes), "targets")
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("own")).withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0)))
    sums = sums.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("slice").alias("k"), "base", "source_size", "target", "budget")
    inside = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", inside).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    finish = [F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("base") + F.col("inside") + F.col("source_size") * p) / F.col("target")) for p in range(passes)]
    rows = written(rows.select("doc_id", "source", "size", "source_size", "target", "budget", F.array(*finish).alias("finish")), "finish")
    cut = _cut(rows.select("size", "budget", F.explode("finish").alias("finish")).filter("finish is not null"))
    taken = F.col("size") * F.size(F.filter("finish", lambda f: f <= F.lit(cut)))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _cut(items: DataFrame, ways: int = 256, levels: int = 3) -> float:
    """The last virtual finish time up to which all items fit the budget. Each level sums the sizes in `ways` slices of the range that the level before has left; only the items of the last, narrow range are put in order."""
    most = items.agg(F.max("finish").alias("most"), F.max("budget").alias("budget")).collect()[0]
    if most["most"] is None:
        return -1.0
    lo, hi, low = 0.0, float(most["most"]), 0
    for _ in range(levels):
        step = (hi - lo) / ways
        if step <= 0:
            break
        bounds = [lo + step * k for k in range(ways)] + [hi]
        inside = items.filter((F.col("finish") > lo) & (F.col("finish") <= hi))
        place = F.least(F.greatest(F.ceil((F.col("finish") - lo) / step), F.lit(1)), F.lit(ways)) - 1
        sums = {r["p"]: r["s"] for r in inside.groupBy(place.alias("p")).agg(F.sum("size").alias("s")).collect()}  # `ways` rows at most
        run, k = low, 0
        while k < ways - 1 and run + sums.get(k, 0) <= most["budget"]:
            run, k = run + sums.get(k, 0), k + 1
        lo, hi = bounds[max(k - 1, 0)], bounds[min(k + 2, ways)]  # a slice more on either side, for rounding at the bounds
        low = items.filter(F.col("finish") <= lo).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).collect()[0]["s"]
    run = F.sum("size").over(Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)) + low
    last = items.filter((F.col("finish") > lo) & (F.col("finish") <= hi)).groupBy("finish").agg(F.sum("size").alias("size")).withColumn("run", run)
    cut = last.filter(F.col("run") <= F.lit(most["budget"])).agg(F.max("finish").alias("f")).collect()[0]["f"]
    return lo if cut is None else float(cut)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows that the mix takes, with their own columns, each as often as the mix takes it. Rows that share a doc_id are taken as often as the one among them that is taken most."""
    name = options.get("doc_id", "doc_id")
    taken = mix_decisions(docs, **options).filter("taken > 0").groupBy(F.col("doc_id").alias("_taken_id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    out = docs.join(taken, F.col(name).eqNullSafe(F.col("_taken_id")))
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[docs[c] for c in docs.columns])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_decisions(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             source_size * 2 AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
v AS (SELECT first(level ORDER BY most / weight, source NULLS LAST) AS level FROM l WHERE most > level * weight),
t AS (SELECT source, source_size, least(v.level * weight, most::DOUBLE) AS target FROM w LEFT JOIN v ON true),
f AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT size, upto::DOUBLE / target AS vft FROM f WHERE size > 0 AND target > 0
      UNION ALL SELECT size, (upto + source_size)::DOUBLE / target FROM f WHERE size > 0 AND target > 0),
r AS (SELECT vft, sum(size) OVER (ORDER BY vft RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM i),
c AS (SELECT coalesce(max(vft), -1) AS cut FROM r WHERE run <= (SELECT sum(source_size) * 1.5 FROM s))
SELECT doc_id, source, size, source_size, target,
       CASE WHEN size > 0 AND target > 0 THEN size * ((upto::DOUBLE / target <= cut)::INT + ((upto + source_size)::DOUBLE / target <= cut)::INT) ELSE 0 END::BIGINT AS taken
FROM f CROSS JOIN c
"""
