"""Sliding questions over recorded counters and durations.

The metrics table holds delta rows ``(ts, name, labels, value)``. Every question looks back
five minutes at each 15-second step. Rows are first reduced to steps; only those reduced
rows are handed to the twenty ranges they belong to, so the fan-out never touches raw rows.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.schemas import PIPELINE_METRICS

# Look-back and step of the dashboards.
RANGE_S = 300
STEP_S = 15

# Default upper bounds of recorded histograms; the last bucket is open.
HISTOGRAM_BOUNDS = (
    0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0,
    1000.0, 2500.0, 5000.0, 7500.0, 10000.0,
)


def rate(metrics: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Per-second rate of counters over the look-back, at each step that has data.

    ``by`` names labels to keep apart, for example ``["reason"]`` or ``["outcome"]``. The
    rate is the sum of the deltas over the range length, without edge extrapolation.
    """
    by = by or []
    keys = ["name", *by]
    steps = (
        _selected(metrics, names, by)
        .groupBy(*keys, "step")
        .agg(F.sum("value").alias("total"))
    )
    return (
        _into_ranges(steps)
        .groupBy(*keys, "range_end")
        .agg((F.sum("total") / RANGE_S).alias("rate"))
    )


def histogram_quantile(
    metrics: DataFrame,
    names: list[str],
    quantile: float = 0.95,
    bounds: tuple[float, ...] = HISTOGRAM_BOUNDS,
) -> DataFrame:
    """Quantile over the look-back, interpolated inside fixed histogram buckets.

    Counts per bucket add up over steps, so the state of a range is one number per bucket
    whatever the number of recorded values.
    """
    bucket = F.lit(len(bounds))
    for position in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col("value") <= bounds[position], position).otherwise(bucket)
    counts = [
        F.sum(F.when(F.col("bucket") == i, F.lit(1)).otherwise(F.lit(0))).alias(f"_b{i}")
        for i in range(len(bounds) + 1)
    ]
    steps = (
        _selected(metrics, names, [])
        .withColumn("bucket", bucket)
        .groupBy("name", "step")
        .agg(*counts)
    )
    per_range = (
        _into_ranges(steps)
        .groupBy("name", "range_end")
        .agg(*[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(bounds) + 1)])
    )
    return per_range.select("name", "range_end", _interpolated(quantile, bounds).alias("quantile"))


def sketch_quantile(
    metrics: DataFrame, names: list[str], quantile: float = 0.95, k: int = 4096
) -> DataFrame:
    """Quantile of the recorded values over the look-back, from mergeable sketches.

    One sketch per step, merged per range: the state is bounded, and the rank of the result
    is off by a small share of the values, which ``quantile_ranks`` measures.
    """
    steps = (
        _selected(metrics, names, [])
        .groupBy("name", "step")
        .agg(F.call_function("kll_sketch_agg_double", F.col("value"), F.lit(k)).alias("sketch"))
    )
    merged = (
        _into_ranges(steps)
        .groupBy("name", "range_end")
        .agg(F.call_function("kll_merge_agg_double", F.col("sketch"), F.lit(k)).alias("sketch"))
    )
    value = F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(quantile))
    return merged.select("name", "range_end", value.alias("quantile"))


def quantile_ranks(metrics: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Of each range's ``quantile``: the values, those below it, and those up to it.

    Hands every recorded value to its twenty ranges: a measurement of a sketch's error, not a
    way to answer.
    """
    names = [r["name"] for r in quantiles.select("name").distinct().collect()]
    values = _into_ranges(_selected(metrics, names, []))
    below = F.count_if(F.col("value") < F.col("quantile"))
    return (
        values.join(quantiles, ["name", "range_end"])
        .groupBy("name", "range_end")
        .agg(
            F.count("*").alias("n"),
            below.alias("below"),
            F.count_if(F.col("value") <= F.col("quantile")).alias("up_to"),
        )
    )


def metric_rows(
    spark: SparkSession,
    values: list[tuple[str, dict[str, str], float]],
    at: datetime,
) -> DataFrame:
    """Delta rows for the metrics table."""
    stamp = at.astimezone(timezone.utc)
    return spark.createDataFrame(
        [(stamp, name, labels, float(value)) for name, labels, value in values], PIPELINE_METRICS
    )


def _selected(metrics: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Rows of the named metrics, with the labels asked for and the start of their step."""
    micros = F.unix_micros("ts")
    step = F.timestamp_micros(micros - F.pmod(micros, F.lit(STEP_S * 1_000_000)))
    return metrics.filter(F.col("name").isin(*names)).select(
        "name",
        "value",
        step.alias("step"),
        *[F.col("labels")[label].alias(label) for label in by],
    )


def _into_ranges(steps: DataFrame) -> DataFrame:
    """Hand each step to every range that covers it; ``range_end`` says which."""
    micros = F.unix_micros("step")
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(RANGE_S // STEP_S)),
        lambda i: F.timestamp_micros(micros + i.cast("bigint") * STEP_S * 1_000_000),
    )
    return steps.withColumn("range_end", F.explode(ends))


def _interpolated(quantile: float, bounds: tuple[float, ...]) -> Column:
    counts = [F.col(f"_b{i}") for i in range(len(bounds) + 1)]
    total = sum(counts[1:], counts[0])
    rank = total * F.lit(quantile)
    # Beyond the last finite bound nothing is known but the bound itself.
    result = F.lit(bounds[-1])
    for i in range(len(bounds) - 1, -1, -1):
        below = sum(counts[1:i], counts[0]) if i > 0 else F.lit(0)
        upper = bounds[i]
        if i == 0 and upper <= 0:
            inside = F.lit(upper)
        else:
            lower = bounds[i - 1] if i > 0 else 0.0
            inside = F.lit(lower) + F.lit(upper - lower) * (rank - below) / counts[i]
        result = F.when(below + counts[i] >= rank, inside).otherwise(result)
    return result
