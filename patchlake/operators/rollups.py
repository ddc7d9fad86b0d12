"""Numbers and series over stored metric rows (see points.metric_rows).

Sums and averages are those of doubles: values of any size count, a NaN or an infinity shows in the
result, and the last digits may change with the order of rows. All groupings are combined before the
shuffle; windows run over what is left, one row per bucket and tag value.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions import tags
from patchlake.functions.frames import null_safe_join


@dataclass(frozen=True)
class Series:
    """One aggregated metric: "sum" or "avg" of a metric, for rows with a tag if one is given."""

    agg: str
    metric: str
    tag: tuple[str, str] | None = None

    def matches(self) -> Column:
        found = F.col("metric_name") == self.metric
        return found & tags.has(F.col("tags"), *self.tag) if self.tag else found

    def column(self, rows: DataFrame) -> Column:
        """Over points, or over states of points (partials.hourly), which have their total and number."""
        if "total" not in rows.columns:
            value = F.when(self.matches(), F.col("value"))
            return F.sum(value) if self.agg == "sum" else F.avg(value)
        total, n = (F.sum(F.when(self.matches(), F.col(c))) for c in ("total", "n"))
        return total if self.agg == "sum" else F.when(n > 0, total / n)


def select_rows(rows: DataFrame, repo: str = "*", env: str = "*") -> DataFrame:
    """Rows of a repository and an environment by their tags; "*" takes all."""
    for key, wanted in (("repo", repo), ("env", env)):
        if wanted != "*":
            rows = rows.where(tags.has(F.col("tags"), key, wanted))
    return rows


def rows_with_tag(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(tags.has(F.col("tags"), key, value))


def _of_metrics(rows: DataFrame, series: dict[str, Series]) -> DataFrame:
    """Only the metrics asked for: a filter that reaches the scan."""
    return rows.where(F.col("metric_name").isin(sorted({one.metric for one in series.values()})))


def scalars(rows: DataFrame, **series: Series) -> DataFrame:
    """One row with a number per series, from one scan."""
    return _of_metrics(rows, series).agg(*[one.column(rows).alias(name) for name, one in series.items()])


def over_time(rows: DataFrame, width: str, by: str | None = None, **series: Series) -> DataFrame:
    """One row per time bucket, and per value of the tag `by`; several series share the scan.

    Rows without the tag make a group of their own, with a null value. Over states the width is a whole number of theirs.
    """
    rows = _of_metrics(rows, series)
    keys = [F.window("timestamp", width).alias("_window")]
    if by:
        rows = rows.withColumn(by, tags.value_of(F.col("tags"), by))
        keys.append(F.col(by))
    grouped = rows.groupBy(*keys).agg(*[one.column(rows).alias(name) for name, one in series.items()])
    return grouped.select(F.col("_window.start").alias("bucket"), *([by] if by else []), *series)


def running_total(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Cumulative sum over buckets for each tag value."""
    upto = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(upto)).drop(value)


def by_type(points: DataFrame, keys: list[str], width: str) -> DataFrame:
    """Roll points up by the rule of their type, per metric, keys and time bucket.

    Counts are summed, a gauge keeps its last value (by time, then point_id), a histogram gets count,
    average, maximum, median and 95th percentile. Points of any other type are dropped.
    """
    points = points.where(F.col("metric_type").isin("count", "gauge", "histogram"))
    points = points.withColumn("bucket", F.window("timestamp", width)["start"])
    group = ["metric_name", "metric_type", *keys, "bucket"]
    kind = F.col("metric_type")
    rolled = points.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.sum("value").alias("total"),
        F.max_by("value", F.struct("timestamp", "point_id")).alias("_last"),
        F.max("value").alias("_max"),
    )
    spread = percentiles(points.where(kind == "histogram"), group, "value", {"p50": 0.5, "p95": 0.95})
    joined = null_safe_join(rolled, spread, group, "left")
    is_histogram = kind == "histogram"
    return joined.select(
        *group,
        F.when(kind == "count", F.col("total")).when(kind == "gauge", F.col("_last")).alias("value"),
        F.when(is_histogram, F.col("n")).alias("n"),
        F.when(is_histogram, F.col("total") / F.col("n")).alias("avg"),
        F.when(is_histogram, F.col("_max")).alias("max"),
        "p50",
        "p95",
    )


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles: the smallest value that at least the share of the group's values does not exceed.

    Quantile summaries, which are combined before the shuffle, give two values between which a percentile has to be. The
    values below are counted and only those between are put in order: about 6 / accuracy of the group, whatever its values.
    """
    margin = 3 / accuracy
    ends = [max(0.0, s - margin) for s in shares.values()] + [min(1.0, s + margin) for s in shares.values()]
    found = df.groupBy(*group).agg(F.count(value).alias("_total"), F.percentile_approx(value, ends, accuracy).alias("_ends"))
    targets = F.array(*[
        F.struct(
            F.lit(name).alias("_name"), F.ceil(F.col("_total") * share).alias("_rank"),
            F.col("_ends")[i].alias("_low"), F.col("_ends")[i + len(shares)].alias("_high"),
        )
        for i, (name, share) in enumerate(shares.items())
    ])
    targets = found.where("_total > 0").select(*group, F.inline(targets))
    # equal values are one row from here on
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    placed = null_safe_join(counted, targets, group).where(F.col(value) <= F.col("_high"))
    below = placed.where(F.col(value) < F.col("_low")).groupBy(*group, "_name").agg(F.sum("_n").alias("_before"))
    inside = Window.partitionBy(*group, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    between = placed.where(F.col(value) >= F.col("_low")).withColumn("_upto", F.sum("_n").over(inside))
    between = null_safe_join(between, below, [*group, "_name"], "left").withColumn("_upto", F.col("_upto") + F.coalesce("_before", F.lit(0)))
    hit = between.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    return hit.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in shares])


def displayed(df: DataFrame, **digits: int) -> DataFrame:
    """Round columns for display; nothing before this step is rounded."""
    return df.withColumns({name: F.round(name, places) for name, places in digits.items()})
