"""Step reports: honest counts for every step, observed in the job that makes the result or computed when asked for."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = "step int, action string, table string, metric string, value double"


@dataclass(frozen=True)
class Fact:
    """A named count: an aggregate over a frame."""

    metric: str
    frame: DataFrame
    measure: Column


@dataclass(frozen=True)
class Observed:
    """Counts that a place of the plan observes."""

    observation: Observation
    metrics: Sequence[str]


@dataclass(frozen=True)
class StepReport:
    step: int
    action: str
    table: str
    facts: Sequence[Fact] = ()
    say: Callable[[Mapping[str, float]], str] = field(default=lambda counts: "")
    examples: DataFrame | None = None  # a few values worth naming, column ``value``
    observed: Sequence[Observed] = ()


Counts = Mapping[tuple[int, str], float | None]


def _run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def observed(reports: Sequence[StepReport], frames: Sequence[DataFrame], run: Callable[[DataFrame], object] = _run) -> Counts:
    """(step, metric) to the count, for what the frames observe while ``run`` makes each.

    A place that a plan holds twice, or that a result does not depend on, is left out, and so is a plan with a full sort, whose
    first look at the rows would be counted as well. Such counts are computed apart.
    """
    plans = []
    for df in frames:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        full_sorts = len(re.findall(r"Sort \[.*\], true", plan)) - plan.count("GlobalLimit")
        plans.append("" if full_sorts > 0 else plan)
        run(df)
    whole = "\n".join(plans)
    counts = {}
    for report in reports:
        for place in report.observed:
            if len(re.findall(rf"CollectMetrics {place.observation._name}\b", whole)) == 1:
                found = place.observation.get
                counts.update({(report.step, metric): found.get(metric) for metric in place.metrics})
    return counts


def report_frame(spark: SparkSession, reports: Sequence[StepReport], counts: Counts | None = None) -> DataFrame:
    """The counts of all steps as rows ``step, action, table, metric, value``.

    Those that are known stand as they are; the others take one aggregate per frame, all in one job.
    """
    counts = counts or {}
    rows = [(r.step, r.action, r.table, f.metric, counts[r.step, f.metric]) for r in reports for f in r.facts if (r.step, f.metric) in counts]
    parts = [spark.createDataFrame(rows, REPORT_SCHEMA)] if rows else []
    for report in reports:
        by_frame: dict[int, list[Fact]] = {}
        for fact in report.facts:
            if (report.step, fact.metric) not in counts:
                by_frame.setdefault(id(fact.frame), []).append(fact)
        for facts in by_frame.values():
            entries = [F.struct(F.lit(f.metric).alias("metric"), f.measure.cast("double").alias("value")) for f in facts]
            parts.append(
                facts[0].frame.agg(F.array(*entries).alias("entries"))
                .select(F.inline("entries"))
                .select(
                    F.lit(report.step).alias("step"), F.lit(report.action).alias("action"),
                    F.lit(report.table).alias("table"), "metric", "value",
                )
            )
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], REPORT_SCHEMA)


def messages(spark: SparkSession, reports: Sequence[StepReport], counts: Counts | None = None) -> list[str]:
    """One plain sentence per step, with its counts. Those that are not known take a job."""
    numbers: dict[int, dict[str, float]] = {}
    for row in report_frame(spark, reports, counts).collect():  # a few rows per step
        numbers.setdefault(row["step"], {})[row["metric"]] = row["value"] or 0
    said = []
    for report in reports:
        known = numbers.get(report.step, {})
        text = report.say(known)
        if report.examples is not None and known.get("rows_removed", known.get("wrong_cells", 0)):
            values = [repr(r["value"]) for r in report.examples.collect()]
            text += f" For example: {', '.join(values)}." if values else ""
        said.append(text)
    return said


def plural(count: float, thing: str) -> str:
    return f"{int(count):,} {thing}{'' if int(count) == 1 else 's'}"
