"""Recall, routing and selective-risk metrics, exact intervals, AUC."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class InsufficientSampleError(ValueError):
    """Too few items for an interval's approximation."""


#: Blocks that in_blocks cuts an ordered column into, at most.
BLOCKS = 512


def in_blocks(rows: DataFrame, value: str, *, blocks: int = BLOCKS) -> DataFrame:
    """rows with `block`: neighbouring values share one, blocks follow the order of values and hold about as many rows each. Equal values share a block."""
    cuts = rows.agg(F.percentile_approx(F.col(value), [i / blocks for i in range(1, blocks)], 20 * blocks).alias("c")).collect()[0]["c"] or []
    cuts = sorted(set(cuts))
    where = lambda lo, hi: F.lit(lo) if lo == hi else F.when(F.col(value) < F.lit(cuts[(lo + hi) // 2]), where(lo, (lo + hi) // 2)).otherwise(where((lo + hi) // 2 + 1, hi))
    return rows.withColumn("block", where(0, len(cuts)))


def clause_key(standard: Column, clause: Column, occurrence: Column, sub: Column) -> Column:
    """struct standard_id, clause_id, occurrence_index, sub_clause_id: what a clause is known by. A missing standard or clause raises, a missing occurrence is 0, a blank sub-clause is null."""
    there = lambda c, name: F.coalesce(c.cast("string"), F.raise_error(F.lit(f"clause without {name}")).cast("string")).alias(name)
    own = F.regexp_replace(sub.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.struct(there(standard, "standard_id"), there(clause, "clause_id"), F.coalesce(occurrence.cast("int"), F.lit(0)).alias("occurrence_index"), F.when(own != "", own).alias("sub_clause_id"))


def gold_recall(gold: DataFrame, context: DataFrame, keys: list[str], *, id: str = "item_id", by: tuple = ()) -> DataFrame:
    """id, n_gold, n_hits, recall, any_gold, all_gold for each item of gold (and each value of the columns in `by`, which both have); keys meet null-safely, the first rank of a key counts, duplicate gold counts twice."""
    own = (id, *by)
    ranks = context.groupBy(*own, *keys).agg(F.min("rank").alias("rank"))
    on = F.lit(True)
    for k in (*own, *keys):
        on &= F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) if k in keys else F.col(f"g.{k}") == F.col(f"c.{k}")
    met = gold.alias("g").join(ranks.alias("c"), on, "left").select(*[F.col(f"g.{k}").alias(k) for k in own], "rank")
    out = met.groupBy(*own).agg(F.count(F.lit(1)).alias("n_gold"), F.count("rank").alias("n_hits"))
    return out.select(*own, "n_gold", "n_hits", (F.col("n_hits") / F.col("n_gold")).alias("recall"), (F.col("n_hits") > 0).alias("any_gold"), (F.col("n_hits") == F.col("n_gold")).alias("all_gold"))


def ablation_table(gold: DataFrame, ranked: DataFrame, keys: list[str], *, id: str = "item_id") -> DataFrame:
    """recall_summary of each configuration in ranked (config, id, keys, rank)."""
    configs = ranked.select("config").distinct()  # a row a configuration
    return recall_summary(gold_recall(gold.crossJoin(F.broadcast(configs)), ranked, keys, id=id, by=("config",)), "config")


def recall_summary(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_hits").alias("hits"), F.sum("n_gold").alias("gold"), F.avg("recall").alias("macro_recall"), F.try_divide(F.sum("n_hits").cast("double"), F.sum("n_gold")).alias("micro_recall"))


def routing_metrics(routed: DataFrame, *, expected: str = "expected", decision: str = "decision") -> DataFrame:
    """One row: counts of decisions, agreement, over-abstention among those that should be answered."""
    n, d, e = F.count(F.lit(1)), F.col(decision), F.col(expected)
    return routed.agg(n.alias("n"), *[F.count_if(d == x).alias(f"n_{x}") for x in ("answer", "abstain", "escalate")], F.coalesce(F.try_divide(F.count_if(d == e).cast("double"), n), F.lit(0.0)).alias("agreement"), F.count_if((e == "answer") & (d != "answer")).alias("over_abstention"))


def selective_risk(rows: DataFrame, *, expected: str = "expected", decision: str = "decision") -> DataFrame:
    """One row: the nine cells and the ratios, null where a denominator is empty. A label outside the vocabulary raises. Escalation is never pooled with abstention."""
    names = ("answer", "abstain", "escalate")
    known = lambda c: F.when(F.col(c).isin(*names), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c}: "), F.coalesce(F.col(c), F.lit("null")))))
    rows = rows.select(known(expected).alias("e"), known(decision).alias("d"))
    cells = rows.agg(*[F.count_if((F.col("e") == e) & (F.col("d") == d)).alias(f"{e}_{d}") for e in names for d in names])
    total = lambda *cs: sum((F.col(c) for c in cs), F.lit(0))
    ratio = lambda a, *cs: F.try_divide(F.col(a).cast("double"), total(*cs))
    return cells.withColumns({
        "abstention_precision": ratio("abstain_abstain", "answer_abstain", "abstain_abstain"),
        "abstention_recall": ratio("abstain_abstain", "abstain_answer", "abstain_abstain", "abstain_escalate"),
        "unsafe_answer_rate": ratio("abstain_answer", "abstain_answer", "abstain_abstain", "abstain_escalate"),
        "escalation_precision": ratio("escalate_escalate", "answer_escalate", "abstain_escalate", "escalate_escalate"),
        "escalation_recall": ratio("escalate_escalate", "escalate_answer", "escalate_abstain", "escalate_escalate"),
    })


def wilson_columns(hits, n, z: float = 1.959963984540054, least: int = 30):
    """(lo, hi) as Columns; null below `least` items, where the approximation doesn't hold."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return tuple(F.when(n >= least, end / (1 + z * z / n)) for end in (mid - half, mid + half))


def wilson_interval(hits: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    if n < 30:
        raise InsufficientSampleError(f"{n} items; the approximation wants 30")
    p = hits / n
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction, whose steps grow with the square root of a and b at most."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out, m = 1e-300, 1.0, 0.0, 1.0, 0
    while m < 100_000:
        k = m // 2
        step = 1.0 if m == 0 else k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        out *= c * d
        if m and abs(c * d - 1) < 1e-15:
            break
        m += 1
    return front * (out - 1)


def clopper_pearson(hits: int, n: int, alpha: float = 0.05, steps: int = 200) -> tuple[float, float]:
    """The exact interval, by bisection on the binomial tail as an incomplete beta function."""
    if not 0 <= hits <= n or n < 1:
        raise ValueError("0 <= hits <= n and n >= 1")

    def root(falls):
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if falls(mid) else (lo, mid)
        return (lo + hi) / 2

    lower = 0.0 if hits == 0 else root(lambda p: _beta_share(hits, n - hits + 1, p) < alpha / 2)
    upper = 1.0 if hits == n else root(lambda p: 1 - _beta_share(hits + 1, n - hits, p) > alpha / 2)
    return lower, upper


def exact_intervals(counts: DataFrame, *, hits: str = "hits", n: str = "n") -> DataFrame:
    """counts with point, lo, hi, width, informative (width at most 0.2) and interpretation in words. Intervals of distinct (hits, n) are found in Arrow batches."""
    @F.pandas_udf("struct<lo: double, hi: double>")
    def bounds(k: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(k, m)], columns=["lo", "hi"])

    pairs = counts.select(hits, n).distinct().filter(F.col(n) > 0).withColumn("_b", bounds(hits, n))
    out = counts.join(pairs, [hits, n], "left").withColumns({"point": F.try_divide(F.col(hits).cast("double"), F.col(n)), "lo": F.col("_b.lo"), "hi": F.col("_b.hi")}).drop("_b")
    out = out.withColumn("width", F.col("hi") - F.col("lo")).withColumn("informative", F.col("width") <= 0.2)
    share = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    warning = F.when(F.col("informative"), "").otherwise("; too wide to tell rates apart, so not to be quoted as one")
    return out.withColumn("interpretation", F.concat(F.col(hits).cast("string"), F.lit(" of "), F.col(n).cast("string"), F.lit(" fits any rate from "), share("lo"), F.lit(" to "), share("hi"), warning))


def evaluation_labels(items: DataFrame, routed: DataFrame, *, id: str = "item_id", vocabulary: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Items joined with their decision: matches_expected and scholar_validated; a value outside a column's vocabulary raises."""
    allowed = {"expected_behavior": ("answer", "abstain", "escalate")} | (vocabulary or {})
    out = items.join(routed.select(id, "decision"), id, "left")
    for name, values in allowed.items():
        out = out.withColumn(name, F.when(F.col(name).isin(*values), F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(name, F.lit("null"))))))
    return out.withColumns({"matches_expected": F.coalesce(F.col("decision") == F.col("expected_behavior"), F.lit(False)), "scholar_validated": F.coalesce(F.col("verification_basis") == "qualified_scholar_review", F.lit(False))})


def routing_rates(routed: DataFrame, scores: DataFrame | None = None, *, id: str = "item_id", expected: str = "expected", decision: str = "decision") -> DataFrame:
    """routing_metrics with coverage, abstention_rate, escalation_rate (0 without items) and, with scores of gold_recall, macro and micro recall (null where undefined)."""
    out = routing_metrics(routed, expected=expected, decision=decision)
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n")), F.lit(0.0))
    out = out.withColumns({"coverage": rate("n_answer"), "abstention_rate": rate("n_abstain"), "escalation_rate": rate("n_escalate")})
    if scores is None:
        return out
    own = scores.join(routed.select(id), id, "left_semi")
    told = own.agg(F.coalesce(F.sum("n_gold"), F.lit(0)).alias("n_gold"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("n_hits"), F.count_if("any_gold").alias("n_any_gold"), F.count_if("all_gold").alias("n_all_gold"), F.avg("recall").alias("macro_recall"), F.try_divide(F.sum("n_hits").cast("double"), F.sum("n_gold")).alias("micro_recall"))
    return out.crossJoin(told)  # one row each


def gate_histogram(routed: DataFrame, *, gate: str = "triggering_gate") -> DataFrame:
    """triggering_gate (none where nothing triggered), n."""
    return routed.groupBy(F.coalesce(F.col(gate), F.lit("none")).alias("triggering_gate")).agg(F.count(F.lit(1)).alias("n"))


def metrics_from_traces(traces: DataFrame) -> DataFrame:
    """routing_metrics of stored traces (decision, evaluation struct with expected_behavior); a trace without an evaluation raises."""
    told = F.when(F.col("evaluation").isNull() | F.col("evaluation.expected_behavior").isNull(), F.raise_error(F.lit("trace without evaluation"))).otherwise(F.col("evaluation.expected_behavior"))
    return routing_metrics(traces.select(told.alias("expected"), "decision"))


def auc(rows: DataFrame, score: str, label: str, *, by: str | None = None) -> DataFrame:
    """One row (one for each value of `by`): n_pos, n_neg, auc (ties one half; null if a side is empty). Scores are counted first.

    Running sums over distinct scores go in two steps: within blocks of neighbouring scores cut at their quantiles, then the blocks'
    sums, one row a block; no task holds all scores."""
    keys = [by] if by else []
    counts = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*keys, F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = in_blocks(counts, "s")
    sums = counts.groupBy(*keys, "block").agg(F.sum("neg").alias("block_neg"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "block", F.coalesce(F.sum("block_neg").over(before(Window.partitionBy(*keys).orderBy("block"))), F.lit(0)).alias("below_block"))
    inner = F.coalesce(F.sum("neg").over(before(Window.partitionBy(*keys, "block").orderBy("s"))), F.lit(0))
    met = counts.withColumn("inner", inner).join(sums, [*keys, "block"])
    out = met.withColumn("won", F.col("pos") * (F.col("below_block") + F.col("inner") + F.col("neg") / 2)).groupBy(*keys).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.sum("won").alias("won"))
    return out.select(*keys, "n_pos", "n_neg", F.try_divide("won", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))


def scored_results(results: DataFrame, items: DataFrame, *, id: str = "item_id") -> DataFrame:
    """items' expected_behavior with a stored run's decision and gate. results: decision, status (older runs: only abstained counts as such), stages (array of stage, detail); the gate is what stands behind gate= in a route stage's detail, the last of them, None being none."""
    told = F.transform(F.filter("stages", lambda s: (s["stage"] == "route") & s["detail"].contains("gate=")), lambda s: F.regexp_extract(s["detail"], r"gate=(\S*)", 1))
    named = F.filter(told, lambda g: (g != "None") & (g != ""))
    decision = F.coalesce(F.when(F.col("decision") != "", F.col("decision")), F.when(F.col("status") == "abstained", "abstain").otherwise("answer"))
    out = results.select(id, decision.alias("decision"), F.try_element_at(named, F.lit(-1)).alias("gate"))
    return items.select(id, F.col("expected_behavior").alias("expected")).join(out, id)


def mixed_items(hard: DataFrame, probes: DataFrame) -> DataFrame:
    """Both classes in one table: item_id, question_text, expected_behavior, klass, basis, verification_basis. probes: probe_id, question_text, expected_behavior, basis, verification_basis."""
    columns = ("question_text", "expected_behavior")
    or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    a = hard.select(F.col("item_id").cast("string").alias("item_id"), *columns, F.lit("answerable_hard_set").alias("klass"), or_empty("answerability").alias("basis"), or_empty("verification_basis").alias("verification_basis"))
    b = probes.select(F.col("probe_id").cast("string").alias("item_id"), *columns, F.lit("unanswerable_probe").alias("klass"), F.col("basis").cast("string").alias("basis"), or_empty("verification_basis").alias("verification_basis"))
    return a.unionByName(b)


def threshold_rates(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, label, fired, evaluable: how often a score is below each threshold."""
    points = rows.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return rows.crossJoin(F.broadcast(points)).groupBy("threshold", label).agg(F.count_if(F.col(score) < F.col("threshold")).alias("fired"), F.count(score).alias("evaluable"))
