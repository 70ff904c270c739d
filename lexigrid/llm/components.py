"""Connected components of links, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm._shared import forget, written


def components(links: DataFrame, *, rounds: int = 200) -> DataFrame:
    """(v, root) for each end of a link; root is the smallest id that links reach from v. links: columns a, b, one direction is enough.

    Each round takes the least root among the neighbours and then follows the roots one step
    (pointer jumping), so chains shorten geometrically. Sums are combined before the shuffle and
    each round ends in a written table; a node with very many links only makes large partitions of
    a sort-merge join, which adaptive execution splits.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = written(both.distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), "roots")
    for _ in range(rounds):
        near = both.join(roots, both["b"] == roots["v"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["v"] == near["a"]).select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = written(step, "step")
        jump = step.select(F.col("v").alias("r"), F.col("root").alias("further"))
        after = written(step.join(jump, step["root"] == jump["r"], "left").select("v", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "roots")
        same = after.filter("old <> root").isEmpty()
        forget(step)
        forget(roots)
        roots = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    forget(both)
    return roots.select("v", "root")
