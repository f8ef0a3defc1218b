"""Alert rules on a stream of metric samples: the states of :func:`evaluate_alerts`, as soon as a step is complete.

A chain of stateful operators, each with the event time of the one before: the last sample of each series in a step; the
growth of each counter since its previous step (state: one value per series); the sums each signal asks for; and per rule
and series the trailing window of its signals with the steps on which it held (state: one window, cleared by a timer when
the series has been silent for longer). A step is evaluated once the watermark has passed it, so samples may come late and
in any order up to the watermark's delay and the rows are those of the batch form.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seamark.streaming.alerts import Rule, Signal

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLES = "name string, series string, labels map<string,string>, at timestamp, step bigint, value double, grown double"
STATES = "rule string, series string, step bigint, value double, firing boolean"
NAMES = {">": float.__gt__, ">=": float.__ge__, "<": float.__lt__, "<=": float.__le__, "==": float.__eq__}


def signals_of(rule: Rule) -> list[Signal]:
    """The signals of the conditions, then the one that divides the first."""
    return [c[0] for c in rule.conditions] + ([rule.divide_by] if rule.divide_by else [])


def reach(rule: Rule) -> int:
    """Steps before one that its state depends on."""
    return max(rule.hold, *(s.steps for s in signals_of(rule)))


class Growth(StatefulProcessor):
    """Adds to each sample of a series what it grew since the sample before; a fall is a restart from zero."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "step bigint, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("step")
        before, grown = self.last.get() if self.last.exists() else None, []
        for step, value in zip(got["step"], got["value"]):
            grown.append(0.0 if before is None else value - before[1] if value >= before[1] else value)
            before = (int(step), float(value))
        self.last.update(before)
        yield got.assign(grown=grown)[["name", "series", "labels", "at", "step", "value", "grown"]]

    def close(self) -> None:
        pass


class RuleStates(StatefulProcessor):
    """The states of one rule for one series, step by step."""

    def __init__(self, rules: Sequence[Rule], step_seconds: int):
        self.rules, self.step_seconds = {r.name: r for r in rules}, step_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "kept binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule = self.rules[key[0]]
        samples, held = pickle.loads(self.window.get()[0]) if self.window.exists() else ({}, [])
        got, out = pd.concat(list(rows)), []
        for step, now in got.groupby("step", sort=True):
            step = int(step)
            for i, le, v in zip(now["signal"], now["le"], now["v"]):
                samples.setdefault(int(i), []).append((step, le, float(v)))
            value, holds = self.evaluate(rule, samples, step)
            if holds is not None:
                held = [(s, h) for s, h in held if s >= step - rule.hold] + [(step, holds)]
                out.append((rule.name, key[1], step, value, sum(h for _, h in held) == rule.hold + 1))
        newest = int(got["step"].max())
        samples = {i: [x for x in xs if x[0] >= newest - reach(rule)] for i, xs in samples.items()}
        self.window.update((pickle.dumps((samples, held)),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + reach(rule) + 2) * self.step_seconds * 1000)
        yield pd.DataFrame(out, columns=["rule", "series", "step", "value", "firing"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()  # whatever it held lies before every window to come
        yield pd.DataFrame([], columns=["rule", "series", "step", "value", "firing"])

    def close(self) -> None:
        pass

    def evaluate(self, rule: Rule, samples: dict, step: int) -> tuple[float | None, bool | None]:
        """(value, whether the conditions hold) at a step; no state where a signal has no sample."""
        n = len(rule.conditions)
        values = [self.signal(s, samples.get(i, []), step) for i, s in enumerate(signals_of(rule))]
        if rule.divide_by is not None:
            if values[n] is MISSING:
                return None, None
            first = 0.0 if values[0] in (MISSING, None) else values[0]
            values[0] = first / max(1e-9 if values[n] is None else values[n], 1e-9)
        if MISSING in values[:n]:
            return None, None
        return values[0], all(v is not None and NAMES[op](float(v), float(bound)) for v, (_, op, bound) in zip(values, rule.conditions))

    def signal(self, signal: Signal, rows: list, step: int):
        now = [x for x in rows if x[0] == step]
        if not now:
            return MISSING
        trailing = lambda back: [x for x in rows if step - back <= x[0] <= step]
        if signal.kind == "quantile":
            pairs = sorted((float("inf") if le == "+Inf" else float(le), sum(v for _, l, v in trailing(signal.steps - 1) if l == le)) for _, le, _ in now)
            return quantile(pairs, signal.quantile)
        if signal.kind == "rate":
            return sum(v for *_, v in trailing(signal.steps - 1)) / (signal.steps * self.step_seconds)
        if signal.kind == "delta":
            return now[0][2] - min(trailing(signal.steps))[2]
        if signal.kind == "average":
            values = [v for *_, v in trailing(signal.steps - 1)]
            return sum(values) / len(values)
        return now[0][2]


MISSING = "missing"


def quantile(pairs: list[tuple[float, float]], q: float) -> float | None:
    """Of cumulative buckets (bound, count) in order, by linear interpolation inside a bucket; none without counts."""
    rank = pairs[-1][1] * q
    if pairs[-1][1] <= 0:
        return None
    low, below = max(((b, n) for b, n in pairs if n < rank), default=(0.0, 0.0))
    high, reached = min((b, n) for b, n in pairs if n >= rank)
    return low if high == float("inf") else low + (high - low) * (rank - below) / (reached - below) if reached != below else None


def _asked(rules: Sequence[Rule], grown: bool) -> F.Column:
    """What each rule's signals take from a sample: array of (rule, signal, key, le, v), null where they do not select it."""
    taken = []
    for rule in rules:
        for i, s in enumerate(signals_of(rule)):
            chosen = F.col("name") == s.metric
            for label, pattern in s.labels.items():
                chosen = chosen & F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit("")).rlike(f"^(?:{pattern})$")
            summed = s.summed or s.kind == "quantile"
            le = F.try_element_at("labels", F.lit("le")) if s.kind == "quantile" else F.lit("")
            amount = F.col("grown" if s.kind in ("rate", "quantile") else "value")
            taken.append(F.when(chosen, F.struct(F.lit(rule.name).alias("rule"), F.lit(i).alias("signal"), (F.lit("") if summed else F.col(
                "series")).alias("series"), F.coalesce(le, F.lit("")).alias("le"), amount.alias("v"))))
    return F.array_compact(F.array(*taken))


def watch_alerts(metrics: DataFrame, rules: Sequence[Rule], step_seconds: int = 60, watermark: str = "2 minutes") -> DataFrame:
    """Stream of (rule, series, step, value, firing) for a stream ``metrics(ts, name, labels, value)``.

    Needs the RocksDB state store (``STATE_STORE`` as spark.sql.streaming.stateStore.providerClass). Samples later than the
    watermark are left out. A series in a signal that is not summed and divided by a summed one has no state.
    """
    used = sorted({s.metric for r in rules for s in signals_of(r)})
    series = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))).alias("series")
    width = f"{step_seconds} seconds"
    raw = metrics.where(F.col("name").isin(used)).select(F.col("ts").cast("timestamp").alias("ts"), "name", series, "labels", "value")
    last = raw.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "name", "series").agg(
        F.max_by("value", "ts").alias("value"), F.max_by(F.map_entries("labels"), "ts").alias("entries"))
    steps = last.select("name", "series", F.map_from_entries("entries").alias("labels"), F.window_time("w").alias("at"),
                        F.floor(F.unix_seconds("w.start") / step_seconds).alias("step"), "value")
    grown = steps.groupBy("name", "series").transformWithStateInPandas(Growth(), SAMPLES, "append", "eventTime", eventTimeColumnName="at")
    taken = grown.select("at", "step", F.inline(_asked(rules, True)))
    summed = taken.groupBy(F.window("at", width).alias("w"), "step", "rule", "signal", "series", "le").agg(F.sum("v").alias("v")).select(
        F.window_time("w").alias("at"), "step", "rule", "signal", "series", "le", "v")
    return summed.groupBy("rule", "series").transformWithStateInPandas(RuleStates(rules, step_seconds), STATES, "append", "eventTime")
