"""Windowed rollup of metric rows that keep arriving."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from patchlake.functions import tags
from patchlake.operators import partials
from patchlake.sources import windows_table


def windowed(rows: DataFrame, width: str, late_by: str, by: str | None = None) -> DataFrame:
    """Count and sum per window, metric and value of the tag `by`.

    Rows later than `late_by` behind the newest one are left out, and a window's state is let go once
    it can get no more rows. State is one row per window and key, not per point.
    """
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late_by)
    keys = [F.window("timestamp", width).alias("_window"), "metric_name"]
    if by:
        rows = rows.withColumn(by, tags.value_of(F.col("tags"), by))
        keys.append(by)
    rolled = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
    return rolled.select(F.col("_window.start").alias("bucket"), "metric_name", *([by] if by else []), "n", "total")


def windowed_by_type(rows: DataFrame, width: str, late_by: str, by: list[str]) -> DataFrame:
    """The states (operators/partials) of each window, metric, type and values of the tags `by`: what partials.shown turns into counts, last
    values of gauges and percentiles. All types are rolled up in one pass and from one state per window and key.

    Points may come late and in any order: the last value of a gauge is the last by its own time, then point_id. Points later than
    `late_by` behind the newest are left out, and of other types too."""
    rows = rows.where(partials.TYPED).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late_by)
    tagged = rows.withColumns({key: tags.value_of(F.col("tags"), key) for key in by})
    rolled = tagged.groupBy(F.window("timestamp", width).alias("_window"), "metric_name", "metric_type", *by).agg(*partials.aggregates())
    return rolled.select(F.col("_window.start").alias("bucket"), "metric_name", "metric_type", *by, "n_points", "n", "total", "max", "last", "sketch")


def write_final(rolled: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append every window to parquet when it is final. With `once`, take what is there and stop."""
    writer = rolled.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_current(
    rolled: DataFrame, path: str, checkpoint: str, keys: list[str], merge_every: int = 24, once: bool = False
) -> StreamingQuery:
    """Put every window into the table of windows whenever it changes, the newest ones too, long before they are final.

    `keys` tell windows apart: bucket, metric_name and the tag. Each batch brings the whole state of the windows that it has changed, so
    the table (windows_table.current) has what a rollup of all rows so far gives. A batch that runs again after a failure replaces
    what it wrote. Every `merge_every` batches the days that the last one changed are brought together.
    """

    def put(changed: DataFrame, batch: int) -> None:
        if changed.isEmpty():
            return
        windows_table.put(changed, path, batch)
        if (batch + 1) % merge_every == 0:
            windows_table.merge(changed.sparkSession, path, keys, batch)

    writer = rolled.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
