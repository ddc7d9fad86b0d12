"""The table of metric rows: parquet, partitioned by day."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """Append metric rows. Rows of a day are brought together to avoid small files, and a day that is
    much larger than others is split again by adaptive execution. Files are sorted by metric, so that readers of one
    metric skip most of a day. Without rows nothing is added.
    """
    dated = rows.withColumn("event_date", F.to_date("timestamp"))
    dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "metric_name").write.mode("append").partitionBy("event_date").parquet(path)


def read(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Metric rows of a range of days; the range prunes partitions."""
    rows = spark.read.parquet(path)
    if first_day:
        rows = rows.where(F.col("event_date") >= first_day)
    if last_day:
        rows = rows.where(F.col("event_date") <= last_day)
    return rows
