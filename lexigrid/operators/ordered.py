"""Running values over long orders as a parallel scan: inside blocks by windows, over blocks by their summaries.

A window over a whole group is one task, however long the group. Here rows lie in blocks of their order; each block's rows run by themselves,
each block leaves one row, and what comes before a block is composed from those, over blocks of blocks where there are many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192

#: kind of running value: within a frame, over a group, and of what came before with the block's own
_FRAME = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
_JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}


def _total(kind: str, value: Column, order: str) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order))) if kind == "last" else _FRAME[kind](value)


def carried(totals: DataFrame, by: list[str], kinds: dict[str, str], *, block: str, blocks: int, fan: int = BLOCK) -> DataFrame:
    """totals (by, block, a column a kind, one row a block) with `<column>_before`: the value over all blocks of the group before this one, null where there is none."""
    before = {c: f"{c}_before" for c in kinds}
    if blocks <= fan:
        w = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumns({before[c]: _FRAME[k](F.col(c)).over(w) for c, k in kinds.items()})
    up = f"{block}_up"
    rows = totals.withColumn(up, F.floor(F.col(block) / fan))
    above = rows.groupBy(*by, up).agg(*[_total(k, F.col(c), block).alias(c) for c, k in kinds.items()])
    above = carried(above, by, kinds, block=up, blocks=-(-blocks // fan), fan=fan).select(*by, up, *[F.col(b).alias(f"{b}_above") for b in before.values()])
    w = Window.partitionBy(*by, up).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({before[c]: _FRAME[k](F.col(c)).over(w) for c, k in kinds.items()}).join(above, [*by, up])
    pick = lambda c, k: F.when(F.col(before[c]).isNull() & F.col(f"{before[c]}_above").isNull(), None).otherwise(_JOIN[k](F.col(f"{before[c]}_above"), F.col(before[c])))
    return rows.withColumns({before[c]: pick(c, k) for c, k in kinds.items()}).drop(up, *[f"{b}_above" for b in before.values()])


def running(rows: DataFrame, by: list[str], values: dict[str, tuple[str, Column]], *, order: str, block: str, blocks: int, fan: int = BLOCK) -> DataFrame:
    """rows with each name of values as its running sum, min, max or last value that isn't null, in the order of `order` within a group, the row itself included.

    rows hold `block`, which never falls along the order and cuts it into short pieces; blocks: how many there are at most. Rows are
    shuffled by group and block, and one summary a block by group."""
    w = Window.partitionBy(*by, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_own_{n}": c for n, (_, c) in values.items()})
    kinds = {f"_own_{n}": k for n, (k, _) in values.items()}
    totals = own.groupBy(*by, block).agg(*[_total(k, F.col(c), order).alias(c) for c, k in kinds.items()])
    before = carried(totals, by, kinds, block=block, blocks=blocks, fan=fan).drop(*kinds)
    out = own.withColumns({f"_run_{n}": _FRAME[k](F.col(f"_own_{n}")).over(w) for n, (k, _) in values.items()}).join(before, [*by, block])
    return out.withColumns({n: _JOIN[k](F.col(f"_own_{n}_before"), F.col(f"_run_{n}")) for n, (k, _) in values.items()}).drop(*[x for n in values for x in (f"_own_{n}", f"_own_{n}_before", f"_run_{n}")])


def running_low(rows: DataFrame, by: list[str], delta: Column, name: str, *, order: str, block: str, blocks: int, fan: int = BLOCK) -> DataFrame:
    """rows with the sum of delta over the rows before each, above its lowest point so far: a counter that never falls below zero, as it stands before the row."""
    w = Window.partitionBy(*by, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_delta", delta).withColumn("_sum", F.sum("_delta").over(w) - F.col("_delta")).withColumn("_low", F.min("_sum").over(w))
    totals = own.groupBy(*by, block).agg(F.sum("_delta").alias("_s"), F.min("_sum").alias("_l"))
    sums = carried(totals, by, {"_s": "sum"}, block=block, blocks=blocks, fan=fan)
    sums = sums.withColumn("_base", F.coalesce("_s_before", F.lit(0))).withColumn("_l", F.col("_base") + F.col("_l")).select(*by, block, "_base", "_l")
    before = carried(sums, by, {"_l": "min"}, block=block, blocks=blocks, fan=fan).drop("_l")
    out = own.join(before, [*by, block])
    return out.withColumn(name, F.col("_base") + F.col("_sum") - F.least(F.col("_l_before"), F.col("_base") + F.col("_low"))).drop("_delta", "_sum", "_low", "_base", "_l_before")


def before(rows: DataFrame, by: list[str], value: Column, name: str, *, order: str, block: str, blocks: int, fan: int = BLOCK) -> DataFrame:
    """rows with the value of the row before within the group, null for the first; values are never null themselves."""
    own = rows.withColumn("_value", value)
    totals = own.groupBy(*by, block).agg(F.max_by("_value", order).alias("_v"))
    carry = carried(totals, by, {"_v": "last"}, block=block, blocks=blocks, fan=fan).drop("_v")
    w = Window.partitionBy(*by, block).orderBy(order)
    return own.withColumn("_lag", F.lag("_value").over(w)).join(carry, [*by, block]).withColumn(name, F.coalesce("_lag", "_v_before")).drop("_value", "_lag", "_v_before")
