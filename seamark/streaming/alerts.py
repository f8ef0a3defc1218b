"""Alert rules over metric series: values, changes, averages, rates, quantiles from buckets, sustained conditions.

Raw samples are first reduced to one value per series and evaluation step (map-side combined), so the windows below
only ever see as many rows as there are steps, however many samples a series has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamark.session import cut_lineage

BLOCK_STEPS = 4096  # steps in a block of a window


@dataclass(frozen=True)
class Signal:
    """A number per step made from a metric, for each series or for the sum of all: ``kind`` is value, delta, average, rate
    or quantile (whose buckets are always summed)."""

    metric: str
    kind: str = "value"
    steps: int = 1  # length of the range in evaluation steps
    labels: dict = field(default_factory=dict)  # label -> regular expression the whole value must match
    quantile: float = 0.95
    summed: bool = False


@dataclass(frozen=True)
class Rule:
    """Fires where every (signal, operator, bound) holds on ``hold`` + 1 steps in a row. With ``divide_by`` the first
    signal is divided by that one (not less than 1e-9)."""

    name: str
    conditions: Sequence[tuple[Signal, str, float]]
    hold: int = 0
    divide_by: Signal | None = None


def steps_of(metrics: DataFrame, step_seconds: int) -> DataFrame:
    """Last value of each series in each step: (name, series, labels, step, value); ``step`` counts from the epoch."""
    step = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step_seconds).alias("step")
    series = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return metrics.select("name", series.alias("series"), "labels", step, "ts", "value").groupBy(
        "name", "series", "step").agg(F.max_by("value", "ts").alias("value"), F.max_by(
            F.map_entries("labels"), "ts").alias("label_entries")).withColumn(
        "labels", F.map_from_entries("label_entries")).drop("label_entries")


def _selected(steps: DataFrame, signal: Signal) -> DataFrame:
    rows = steps.where(F.col("name") == signal.metric)
    for label, pattern in signal.labels.items():
        rows = rows.where(F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit("")).rlike(f"^(?:{pattern})$"))
    return rows


def _increases(rows: DataFrame) -> DataFrame:
    """Growth of each counter since its previous step; a fall is a restart from zero."""
    before = F.lag("value").over(W.partitionBy("name", "series").orderBy("step"))
    grown = F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value"))
    return rows.withColumn("grown", F.coalesce(grown, F.lit(0.0)))


def trailing(rows: DataFrame, keys: Sequence[str], back: int, name: str, value) -> DataFrame:
    """Add ``name`` = ``value(window)`` over the ``back`` steps before each row and the row itself.

    The window runs in blocks of steps; a block also gets the last ``back`` steps of the one before, so a series of any
    length is worked on in parallel.
    """
    width = max(BLOCK_STEPS, 4 * back)
    own, until = F.floor(F.col("step") / width), F.floor((F.col("step") + back) / width)
    spread = rows.withColumn("__block", F.explode(F.when(until > own, F.array(own, own + 1)).otherwise(F.array(own))))
    window = W.partitionBy(*keys, "__block").orderBy("step").rangeBetween(-back, 0)
    return spread.withColumn(name, value(window)).where(own == F.col("__block")).drop("__block")


def signal_values(steps: DataFrame, signal: Signal, step_seconds: int) -> DataFrame:
    """(series, step, value) of a signal; summed signals and quantiles have the one series ''."""
    rows = _selected(steps, signal)
    if signal.kind in ("quantile", "rate"):
        rows = _increases(rows)
    if signal.kind == "quantile":
        found = quantile_from_buckets(rows.withColumn("le", F.try_element_at("labels", F.lit("le"))), signal.quantile, signal.steps)
        return found.select(F.lit("").alias("series"), "step", "value")
    amount = F.col("grown" if signal.kind == "rate" else "value")
    if signal.summed:
        each = rows.groupBy("step").agg(F.sum(amount).alias("v")).select(F.lit("").alias("series"), "step", "v")
    else:
        each = rows.select("series", "step", amount.alias("v"))
    if signal.kind == "rate":
        found = trailing(each, ["series"], signal.steps - 1, "v", lambda w: F.sum("v").over(w) / (signal.steps * step_seconds))
    elif signal.kind == "delta":
        found = trailing(each, ["series"], signal.steps, "v", lambda w: F.col("v") - F.first("v").over(w))
    elif signal.kind == "average":
        found = trailing(each, ["series"], signal.steps - 1, "v", lambda w: F.avg("v").over(w))
    else:
        found = each
    return found.select("series", "step", F.col("v").alias("value"))


def bucket_quantile(pairs: Column, q: float) -> Column:
    """Quantile of cumulative buckets ``array<struct<le double, n double>>`` (sorted by le) by linear interpolation
    inside the bucket; in the last, open bucket it is the highest finite bound."""
    total = F.get(pairs, F.size(pairs) - 1)["n"]
    rank = total * q
    reached = F.filter(pairs, lambda b: b["n"] >= rank)
    below = F.filter(pairs, lambda b: b["n"] < rank)
    upper = F.get(reached, F.lit(0))
    lower_le = F.coalesce(F.get(below, F.size(below) - 1)["le"], F.lit(0.0))
    lower_n = F.coalesce(F.get(below, F.size(below) - 1)["n"], F.lit(0.0))
    inside = lower_le + (upper["le"] - lower_le) * F.try_divide(rank - lower_n, upper["n"] - lower_n)
    return F.when(total > 0, F.when(upper["le"] == float("inf"), lower_le).otherwise(inside))


def quantile_from_buckets(grown: DataFrame, q: float, steps: int) -> DataFrame:
    """(step, value): quantile over the growth of cumulative buckets ``(step, le, grown)`` in the trailing steps."""
    bound = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").cast("double"))
    per = grown.groupBy("step", bound.alias("le")).agg(F.sum("grown").alias("n"))
    trailing = W.partitionBy("le").orderBy("step").rangeBetween(-(steps - 1), 0)
    summed = per.select("step", "le", F.sum("n").over(trailing).alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("le", "n")))
    return summed.groupBy("step").agg(pairs.alias("pairs")).select("step", bucket_quantile(F.col("pairs"), q).alias("value"))


_OPERATORS = {">": lambda c, b: c > b, ">=": lambda c, b: c >= b, "<": lambda c, b: c < b, "<=": lambda c, b: c <= b,
              "==": lambda c, b: c == b}


def rule_states(steps: DataFrame, rule: Rule, step_seconds: int) -> DataFrame:
    """(rule, series, step, value, firing) of one rule at every step of each series of its first signal.

    Further conditions must hold for the same series, that is for equal labels.
    """
    joined = None
    holds = F.lit(True)
    for i, (signal, operator, bound) in enumerate(rule.conditions):
        values = signal_values(steps, signal, step_seconds).withColumnRenamed("value", f"v{i}")
        if i == 0 and rule.divide_by is not None:
            base = signal_values(steps, rule.divide_by, step_seconds).withColumnRenamed("value", "base")
            values = base.join(values, ["series", "step"], "left").select(
                "series", "step", (F.coalesce("v0", F.lit(0.0)) / F.greatest("base", F.lit(1e-9))).alias("v0"))
        joined = values if joined is None else joined.join(values, ["series", "step"])
        holds = holds & F.coalesce(_OPERATORS[operator](F.col(f"v{i}"), F.lit(bound)), F.lit(False))
    held = trailing(joined.withColumn("holds", holds.cast("int")), ["series"], rule.hold, "held", lambda w: F.sum("holds").over(w))
    return held.select(F.lit(rule.name).alias("rule"), "series", "step", F.col("v0").alias("value"),
                       (F.col("held") == rule.hold + 1).alias("firing"))


def evaluate_alerts(metrics: DataFrame, rules: Sequence[Rule], step_seconds: int = 60) -> DataFrame:
    """States of all rules: (rule, series, step, value, firing). The steps of the metrics used are made once and stored."""
    signals = [s for rule in rules for s in (*(c[0] for c in rule.conditions), *([rule.divide_by] if rule.divide_by else []))]
    steps = cut_lineage(steps_of(metrics.where(F.col("name").isin(sorted({s.metric for s in signals}))), step_seconds))
    states = rule_states(steps, rules[0], step_seconds)
    for rule in rules[1:]:
        states = states.unionByName(rule_states(steps, rule, step_seconds))
    return states


# The operating rules of a corpus service, one-minute steps.
OPERATING_RULES = [
    Rule("ApiDown", [(Signal("up", labels={"job": "api"}), "==", 0)], 1),
    Rule("InferenceDown", [(Signal("up", labels={"job": "inference"}), "==", 0)], 1),
    Rule("WorkersDown", [(Signal("workers_alive"), "==", 0)], 1),
    Rule("QueueStalled", [(Signal("queue_tasks", labels={"status": "todo"}, summed=True), ">", 0),
                          (Signal("job_items", "delta", 15, {"state": "succeeded"}, summed=True), "==", 0)], 15),
    Rule("QueueBacklog", [(Signal("queue_tasks", labels={"status": "todo"}, summed=True), ">", 500)], 10),
    Rule("InferenceSaturated", [(Signal("inference_busy", "average", 10), ">", 0.9),
                                (Signal("inference_waiting", "average", 10), ">", 1)], 10),
    Rule("JobItemFailures", [(Signal("job_items", "delta", 15, {"state": "failed"}, summed=True), ">", 10)]),
    Rule("High5xxRate", [(Signal("http_requests_total", "rate", 5, {"status": "5.."}, summed=True), ">", 0.05)], 5,
         Signal("http_requests_total", "rate", 5, summed=True)),
    Rule("SlowSearch", [(Signal("http_request_duration_seconds_bucket", "quantile", 5, {"route": ".*/search"}), ">", 2)], 10),
]
