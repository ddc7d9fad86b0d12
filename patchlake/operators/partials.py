"""Partial rollups of metric rows, by the hour, which can be merged up to days, months or any range.

A state has the count, sum, maximum and last value of the points of one metric, type, set of tags and hour, and for histograms a quantile
sketch. All of them merge: a widget over a year reads hours, or days made of them, and no point. Points that come late make a further
state of their hour, which merges with the first. Sums are those of doubles; the sketch is Spark's KLL sketch.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch. Up to about so many points it holds them all, and its percentiles are exact.
SKETCH_SIZE = 400
#: Points of other types have no rule.
TYPED = "metric_type in ('count', 'gauge', 'histogram')"
#: Share of ranks by which a percentile of that size is off at most, in 99 of 100 cases.
RANK_ERROR = 0.01


def hourly(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """One state per metric_name, metric_type, tags, service, env and hour, whose start is its `timestamp`.

    n_points counts points, n those with a value; total, max and sketch are over values; `last` has the last point by time, then
    point_id. Rows are stored metric rows with point_id. Points are combined before the shuffle. Equal tags in another order make another state.
    """
    hour = F.window("timestamp", width)["start"].alias("_hour")
    return rows.groupBy("metric_name", "metric_type", "tags", "service", "env", hour).agg(*aggregates()).withColumnRenamed("_hour", "timestamp")


def aggregates() -> list[Column]:
    """What a state holds of its points."""
    values = F.when(F.col("metric_type") == "histogram", F.col("value"))
    return [
        F.count("*").alias("n_points"), F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("max"),
        F.max(F.struct("timestamp", "point_id", "value")).alias("last"), F.kll_sketch_agg_double(values, SKETCH_SIZE).alias("sketch"),
    ]


def merged(states: DataFrame, keys: list[str], width: str) -> DataFrame:
    """The states of each span of `width`, a whole number of hours, and each of `keys`, in one: days of hours, months of days."""
    span = F.window("timestamp", width)["start"].alias("_span")
    sums = [F.sum(c).alias(c) for c in ("n_points", "n", "total")]
    most = [F.max(c).alias(c) for c in ("max", "last")]
    made = states.groupBy(*keys, span).agg(*sums, *most, F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))
    return made.withColumnRenamed("_span", "timestamp")


def percentile(share: float) -> Column:
    """A percentile from a state's sketch; null where it has no values."""
    return F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))


def by_type(states: DataFrame, keys: list[str], width: str) -> DataFrame:
    """What rollups.by_type gives of the points, from their states; p50 and p95 are those of the sketches."""
    rolled = merged(states.where(TYPED), ["metric_name", "metric_type", *keys], width)
    return shown(rolled.withColumnRenamed("timestamp", "bucket"), keys)


def shown(states: DataFrame, keys: list[str]) -> DataFrame:
    """The numbers of states by the rule of their type: the total of a count, the last value of a gauge, and of a histogram
    count, average, maximum, median and 95th percentile."""
    kind, is_histogram = F.col("metric_type"), F.col("metric_type") == "histogram"
    return states.select(
        "metric_name", "metric_type", *keys, "bucket",
        F.when(kind == "count", F.col("total")).when(kind == "gauge", F.col("last.value")).alias("value"),
        F.when(is_histogram, F.col("n_points")).alias("n"),
        F.when(is_histogram, F.col("total") / F.col("n_points")).alias("avg"),
        F.when(is_histogram, F.col("max")).alias("max"),
        percentile(0.5).alias("p50"), percentile(0.95).alias("p95"),
    )
