"""Gates in fixed order, routing, and the sensitivity of routing to gates and thresholds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators.evaluation import in_blocks


@dataclass(frozen=True)
class Gate:
    """passed: a boolean Column over a table of signals; where it isn't true the gate is triggered, if enabled."""

    name: str
    stage: str
    decision: str
    passed: Column
    enabled: bool = True
    basis: str = ""


#: On what each gate's existence rests.
BASIS = {
    "retrieval_non_empty": "prompt_contract_untested_at_n7",
    "retrieval_normative": "prompt_contract_untested_at_n7",
    "lexical_anchoring": "rejected_by_probe_calibration",
    "response_present": "prompt_contract_untested_at_n7",
    "model_did_not_abstain": "observed_in_n7_run",
    "no_self_contradiction": "observed_in_n7_run",
    "citation_integrity": "observed_in_n7_run",
    "clause_grounding": "prompt_contract_untested_at_n7",
    "script_integrity": "observed_in_n7_run",
    "no_degenerate_decoding": "prompt_contract_untested_at_n7",
    "substantive_answer": "observed_in_n7_run",
    "reranker_top_1": "rejected_by_n7_analysis",
    "reranker_margin": "unanalysed",
}


@dataclass(frozen=True)
class Policy:
    """Switches and thresholds of the gates, by the names that policy files use. A gate that is on without its threshold passes."""

    max_echo_ratio: float = 0.85
    enable_echo_gate: bool = True
    enable_heading_only_gate: bool = True
    enable_citation_gate: bool = True
    enable_script_gate: bool = True
    enable_degenerate_decoding_gate: bool = True
    enable_clause_grounding_gate: bool = True
    min_reranker_top_1: float | None = None
    enable_reranker_top_1_gate: bool = False
    min_reranker_margin: float | None = None
    enable_reranker_margin_gate: bool = False
    min_anchor_coverage: float | None = None
    enable_anchoring_gate: bool = False
    policy_version: str = "gates_v1"

    @classmethod
    def names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))

    @classmethod
    def from_dict(cls, told: dict) -> "Policy":
        """Names that begin with _ are comments; unknown ones raise."""
        told = {k: v for k, v in told.items() if not k.startswith("_")}
        if unknown := sorted(set(told) - set(cls.names())):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**told)

    @classmethod
    def from_json_file(cls, path: str) -> "Policy":
        from lexigrid.sources.io import read_policy

        return cls(**read_policy(path, cls.names()))

    def as_dict(self) -> dict:
        return asdict(self)

    def with_config(self, **values) -> "Policy":
        return replace(self, **values)

    def gates(self) -> list[Gate]:
        on = {
            "retrieval_normative": self.enable_heading_only_gate, "lexical_anchoring": self.enable_anchoring_gate, "citation_integrity": self.enable_citation_gate,
            "clause_grounding": self.enable_clause_grounding_gate, "script_integrity": self.enable_script_gate, "no_degenerate_decoding": self.enable_degenerate_decoding_gate,
            "substantive_answer": self.enable_echo_gate, "reranker_top_1": self.enable_reranker_top_1_gate, "reranker_margin": self.enable_reranker_margin_gate,
        }
        shipped = default_gates(echo=self.max_echo_ratio, anchoring=self.min_anchor_coverage, top_1=self.min_reranker_top_1, margin=self.min_reranker_margin)
        return [replace(g, enabled=on.get(g.name, True)) for g in shipped]


def describe_gates(spark: SparkSession, gates: list[Gate]) -> DataFrame:
    """position, name, enabled, stage, decision_if_failed, evidentiary_basis."""
    rows = [(i, g.name, g.enabled, g.stage, g.decision, g.basis) for i, g in enumerate(gates)]
    return spark.createDataFrame(rows, "position int, name string, enabled boolean, stage string, decision_if_failed string, evidentiary_basis string")


def default_gates(*, echo: float = 0.85, anchoring: float | None = None, top_1: float | None = None, margin: float | None = None) -> list[Gate]:
    """The 13 gates in their order of precedence, over columns n_records, all_headings, idf_coverage, generated, response_class, audit_passed, grounding_passed, foreign, runs, echo_ratio, top_1, margin. The three with a threshold of None are off."""
    c = F.col
    attempt = c("response_class").isin("answered", "mixed")
    at_least = lambda col, t: F.coalesce(c(col) >= F.lit(t), F.lit(True)) if t is not None else F.lit(True)
    gates = [
        Gate("retrieval_non_empty", "retrieval", "abstain", c("n_records") > 0),
        Gate("retrieval_normative", "retrieval", "abstain", (c("n_records") == 0) | ~c("all_headings")),
        Gate("lexical_anchoring", "retrieval", "abstain", at_least("idf_coverage", anchoring), anchoring is not None),
        Gate("response_present", "response", "abstain", c("generated") & (c("response_class") != "empty")),
        Gate("model_did_not_abstain", "response", "abstain", c("response_class") != "abstained"),
        Gate("no_self_contradiction", "response", "escalate", c("response_class") != "mixed"),
        Gate("citation_integrity", "response", "escalate", ~attempt | F.coalesce(c("audit_passed"), F.lit(True))),
        Gate("clause_grounding", "response", "escalate", ~attempt | F.coalesce(c("grounding_passed"), F.lit(True))),
        Gate("script_integrity", "response", "escalate", F.size(c("foreign")) == 0),
        Gate("no_degenerate_decoding", "response", "escalate", F.size(c("runs")) == 0),
        Gate("substantive_answer", "response", "escalate", ~attempt | (c("echo_ratio") < echo)),
        Gate("reranker_top_1", "retrieval", "escalate", at_least("top_1", top_1), top_1 is not None),
        Gate("reranker_margin", "retrieval", "escalate", at_least("margin", margin), margin is not None),
    ]
    return [replace(g, basis=BASIS[g.name]) for g in gates]


def evaluate_gates(signals: DataFrame, gates: list[Gate], *, stage: str | None = None) -> DataFrame:
    """signals with results (array of gate, triggered), mask (a bit for each gate that fails, enabled or not), decision and triggering_gate. All gates are evaluated; the first triggered names the cause. With stage only that stage's gates decide."""
    failed = [~F.coalesce(g.passed, F.lit(False)) for g in gates]
    counts = [g.enabled and (stage is None or g.stage == stage) for g in gates]
    results = F.array(*[F.struct(F.lit(g.name).alias("gate"), (f & F.lit(on)).alias("triggered")) for g, f, on in zip(gates, failed, counts)])
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    first = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for v, f, on in zip(values, failed, counts) if on])
    return signals.withColumns({"results": results, "mask": mask, "decision": F.coalesce(first([g.decision for g in gates]), F.lit("answer")), "triggering_gate": first([g.name for g in gates])})


def rationale(gates: list[Gate]) -> Column:
    """In words, over evaluate_gates' results: that all enabled gates passed, or which failed first and which also."""
    n = sum(g.enabled for g in gates)
    failed = F.transform(F.filter("results", lambda r: r["triggered"]), lambda r: r["gate"])
    also = F.when(F.size(failed) > 1, F.concat(F.lit("; also failed: "), F.array_join(F.slice(failed, 2, len(gates)), ", "))).otherwise("")
    return F.when(F.size(failed) == 0, f"all {n} enabled gates passed").otherwise(F.concat(F.element_at(failed, 1), F.lit(" failed"), also))


def decide_subset(mask: Column, subset: Column, gates: list[Gate]) -> Column:
    """The decision if only the gates in a bit set are enabled."""
    on = mask.bitwiseAND(subset)
    return F.coalesce(*[F.when(on.bitwiseAND(F.lit(1 << i)) != 0, F.lit(g.decision)) for i, g in enumerate(gates)], F.lit("answer"))


def ablation_lattice(routed: DataFrame, gates: list[Gate], *, id: str = "item_id") -> DataFrame:
    """subset, size, n_answer, n_abstain, n_escalate, same_as_full, routing (equal for subsets that route all items alike) for all subsets of the enabled gates (16 at most). Gates are evaluated once; a subset is integer work on the masks, grouped first, so cost doesn't follow items times subsets."""
    enabled = [i for i, g in enumerate(gates) if g.enabled]
    if len(enabled) > 16:
        raise ValueError("the lattice takes at most 16 enabled gates")
    full = sum(1 << i for i in enabled)
    spark = routed.sparkSession
    place = sum((F.shiftright(F.col("k"), j).bitwiseAND(F.lit(1)) * (1 << i) for j, i in enumerate(enabled)), F.lit(0).cast("long"))
    subsets = spark.range(1 << len(enabled)).withColumnRenamed("id", "k").select(place.cast("int").alias("subset"))
    masks = routed.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    each = subsets.crossJoin(F.broadcast(masks))  # at most 2**13 masks
    now, whole = decide_subset(F.col("mask"), F.col("subset"), gates), decide_subset(F.col("mask"), F.lit(full), gates)
    total = lambda d: F.sum(F.when(F.col("now") == d, F.col("n")).otherwise(0))
    return each.withColumns({"now": now, "whole": whole}).groupBy("subset").agg(F.bit_count(F.first("subset")).cast("int").alias("size"), total("answer").alias("n_answer"), total("abstain").alias("n_abstain"), total("escalate").alias("n_escalate"), F.bool_and(F.col("now") == F.col("whole")).alias("same_as_full"), F.bit_xor(F.xxhash64("mask", "now")).alias("routing"))


def minimal_sufficient(lattice: DataFrame) -> DataFrame:
    return lattice.filter("same_as_full").join(lattice.filter("same_as_full").agg(F.min("size").alias("size")), "size")


def gate_contributions(routed: DataFrame, gates: list[Gate]) -> DataFrame:
    """gate, stage, decision_if_failed, basis, n_triggering, n_changed (decisions that leave-one-out changes), load_bearing for each enabled gate."""
    enabled = [i for i, g in enumerate(gates) if g.enabled]
    full = sum(1 << i for i in enabled)
    masks = routed.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))  # at most 2**13
    mask, whole = F.col("mask"), decide_subset(F.col("mask"), F.lit(full), gates)
    each = F.array(*[F.struct(
        F.lit(gates[i].name).alias("gate"), F.lit(gates[i].stage).alias("stage"), F.lit(gates[i].decision).alias("decision_if_failed"), F.lit(gates[i].basis).alias("basis"),
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0).alias("t"), F.when(decide_subset(mask, F.lit(full ^ (1 << i)), gates) != whole, F.col("n")).otherwise(0).alias("c"),
    ) for i in enabled])
    out = masks.select(F.inline(each)).groupBy("gate", "stage", "decision_if_failed", "basis").agg(F.sum("t").alias("n_triggering"), F.sum("c").alias("n_changed"))
    return out.withColumn("load_bearing", F.col("n_changed") > 0)


def lattice_summary(lattice: DataFrame, contributions: DataFrame, gates: list[Gate]) -> DataFrame:
    """One row: n_subsets, n_distinct_routings, minimal_sufficient_size, minimal_sufficient_subsets, load_bearing_gates, unexercised_gates."""
    told = lattice.agg(F.count(F.lit(1)).alias("n_subsets"), F.count_distinct("routing").alias("n_distinct_routings"))
    names = F.array_compact(F.array(*[F.when(F.col("subset").bitwiseAND(F.lit(1 << i)) != 0, F.lit(g.name)) for i, g in enumerate(gates)]))
    least = minimal_sufficient(lattice).select("size", F.array_join(names, "+").alias("names")).agg(F.min("size").alias("minimal_sufficient_size"), F.array_sort(F.collect_list("names")).alias("minimal_sufficient_subsets"))
    own = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("gate"))))
    by = contributions.agg(own(F.col("load_bearing")).alias("load_bearing_gates"), own(~F.col("load_bearing")).alias("unexercised_gates"))
    return told.crossJoin(F.broadcast(least)).crossJoin(F.broadcast(by))  # one row each


#: The signal that each threshold reads (null: the item's decision can't depend on it), its gate, and whether the gate wants values below it.
THRESHOLDS = {
    "max_echo_ratio": (lambda: F.when(F.col("response_class").isin("answered", "mixed"), F.col("echo_ratio")), "substantive_answer", True),
    "min_reranker_top_1": (lambda: F.col("top_1"), "reranker_top_1", False),
    "min_reranker_margin": (lambda: F.col("margin"), "reranker_margin", False),
    "min_anchor_coverage": (lambda: F.col("idf_coverage"), "lexical_anchoring", False),
}


def _by_threshold(signals: DataFrame, name: str, policy: Policy, id: str):
    """id, value, passed and failed (the decision if the threshold's gate passes, if it fails), and expected if there."""
    value, gate, _ = THRESHOLDS[name]
    gates = policy.gates()
    at = next(i for i, g in enumerate(gates) if g.name == gate)
    on = sum(1 << i for i, g in enumerate(gates) if g.enabled or i == at)
    routed = evaluate_gates(signals.withColumn("_v", value().cast("double")), gates)
    without, with_ = (lambda m: m.bitwiseAND(F.lit(~(1 << at)))), (lambda m: m.bitwiseOR(F.lit(1 << at)))
    decide = lambda change: T.let(F.col("mask"), lambda m: decide_subset(change(m), F.lit(on), gates))
    also = [F.col("expected")] if "expected" in signals.columns else []
    return routed.select(id, F.col("_v").alias("value"), decide(without).alias("passed"), F.when(F.col("_v").isNull(), decide(without)).otherwise(decide(with_)).alias("failed"), *also)


def threshold_points(signals: DataFrame, name: str, policy: Policy, *, id: str = "item_id", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """sweep of a policy's threshold over signals' own values, all other gates as the policy has them."""
    below = THRESHOLDS[name][2]
    rows = _by_threshold(signals, name, policy, id)
    fails = (lambda v, t: v >= t) if below else (lambda v, t: v < t)
    decide = lambda v, t: F.when(v.isNotNull() & fails(v, t), F.col("failed")).otherwise(F.col("passed"))
    shipped = getattr(policy, name)
    return sweep(rows, "value", decide, low if shipped is None else shipped, low=low, high=high, by=("passed", "failed"))


def threshold_flips(signals: DataFrame, name: str, policy: Policy, *, id: str = "item_id") -> DataFrame:
    """id, threshold_below, threshold_at_or_above, decision_below, decision_at_or_above: items whose decision changes as the threshold passes their value; the other side is a hair above it."""
    rows = _by_threshold(signals, name, policy, id).filter("value is not null and passed <> failed")
    first, second = ("failed", "passed") if THRESHOLDS[name][2] else ("passed", "failed")
    return rows.select(id, F.col("value").alias("threshold_below"), (F.col("value") + 1e-9).alias("threshold_at_or_above"), F.col(first).alias("decision_below"), F.col(second).alias("decision_at_or_above"))


def threshold_sensitivity(signals: DataFrame, name: str, policy: Policy, *, id: str = "item_id", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row: shipped_value, n_items, n_items_evaluable, n_distinct_routings, lo, hi, width, decision_relevant. An item changes at most once, so each threshold with changes starts a routing that was not there before."""
    shipped = getattr(policy, name)
    shipped = low if shipped is None else float(shipped)
    points = threshold_points(signals, name, policy, id=id, low=low, high=high)
    told = signals.agg(F.count(F.lit(1)).alias("n_items"), F.count(THRESHOLDS[name][0]()).alias("n_items_evaluable"))
    routings = points.agg((F.count_if(F.col("flips") > 0) + 1).alias("n_distinct_routings"))
    out = told.crossJoin(F.broadcast(routings)).crossJoin(F.broadcast(stable_interval(points, shipped)))  # one row each
    return out.withColumns({"field_name": F.lit(name), "shipped_value": F.lit(shipped), "width": F.col("hi") - F.col("lo"), "decision_relevant": F.col("n_distinct_routings") > 1})


def sweep(items: DataFrame, value: str, decide, shipped: float, *, low: float = 0.0, high: float = 1.0, by: tuple = ()) -> DataFrame:
    """threshold, n_answer, n_abstain, n_escalate, flips (decisions that differ from the threshold before). Candidates: the bounds, the shipped value, each observed value and a hair above it.

    decide(value, threshold) gives the decision, which may depend on a value only by its being below, at or above the threshold, and
    on the columns named in `by`. An item then changes at its own value and at the next candidate, so items are counted by value and
    summed from threshold to threshold: first within blocks of neighbouring thresholds, then over the blocks, one row a block. Blocks
    are cut at quantiles of the thresholds, so no task holds all of them, wherever they crowd."""
    spark = items.sparkSession
    v, t = F.col(value).cast("double"), F.col("threshold")
    held = items.select(v.alias("threshold"), *by).groupBy("threshold", *by).agg(F.count(F.lit(1)).alias("n"))
    below, at, above = decide(t, F.lit(float("-inf"))), decide(t, t), decide(t, F.lit(float("inf")))
    counted = lambda d, name: F.when(d == name, F.col("n")).otherwise(0)
    changed = lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(F.col("n"))
    names = ("answer", "abstain", "escalate")
    own = [c.cast("long").alias(f"{k}_{x}") for x in names for k, c in (("first", counted(below, x)), ("reach", counted(at, x) - counted(below, x)), ("leave", counted(above, x) - counted(at, x)))]
    own += [changed(below, at).cast("long").alias("reach_flips"), changed(at, above).cast("long").alias("leave_flips")]
    sums = [f"{k}_{x}" for x in names for k in ("first", "reach", "leave")] + ["reach_flips", "leave_flips"]
    none = [F.lit(0).cast("long").alias(c) for c in sums]
    at_least = lambda x: F.coalesce(x, F.lit(float(low))).alias("threshold")  # noqa: E731  an item without a value never changes
    seen = held.select(F.inline(F.array(F.struct(at_least(t), *own), F.struct(at_least(t + 1e-9), *none))))
    fixed = spark.createDataFrame([(float(x),) for x in (low, high, shipped)], "threshold double").select("threshold", *none)
    points = seen.unionByName(fixed).groupBy("threshold").agg(*[F.sum(c).alias(c) for c in sums])
    points = in_blocks(points, "threshold")
    blocks = points.groupBy("block").agg(*[F.sum(F.col(f"reach_{x}") + F.col(f"leave_{x}")).alias(f"b_{x}") for x in names], *[F.sum(f"first_{x}").alias(f"s_{x}") for x in names], F.max_by("leave_flips", "threshold").alias("b_last"))
    all_before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = [(F.coalesce(F.sum(f"b_{x}").over(all_before), F.lit(0)) + F.sum(f"s_{x}").over(Window.partitionBy())).alias(f"s_{x}") for x in names]
    blocks = blocks.select("block", *starts, F.lag("b_last").over(Window.orderBy("block")).alias("b_last"))
    w = Window.partitionBy("block").orderBy("threshold")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    inner = {f"i_{x}": F.sum(f"reach_{x}").over(upto) + F.coalesce(F.sum(f"leave_{x}").over(before), F.lit(0)) for x in names}
    out = points.withColumns(inner | {"left": F.lag("leave_flips").over(w)}).join(F.broadcast(blocks), "block")  # BLOCKS rows at most
    passed = F.coalesce("left", "b_last")
    return out.select("threshold", *[(F.col(f"s_{x}") + F.col(f"i_{x}")).alias(f"n_{x}") for x in names], F.when(passed.isNull(), 0).otherwise(passed + F.col("reach_flips")).alias("flips"))


def stable_interval(swept: DataFrame, shipped: float) -> DataFrame:
    """lo, hi: the neighbouring thresholds around the shipped one with the same routing."""
    t, new = F.col("threshold"), F.col("flips") > 0
    ends = swept.agg(F.coalesce(F.max(F.when(new & (t <= F.lit(shipped)), t)), F.min(t)).alias("lo"), F.min(F.when(new & (t > F.lit(shipped)), t)).alias("end"))
    inside = t < F.coalesce("end", F.lit(float("inf")))
    return swept.crossJoin(F.broadcast(ends)).filter((t >= F.col("lo")) & (F.col("end").isNull() | inside)).agg(F.min("lo").alias("lo"), F.max("threshold").alias("hi"))
