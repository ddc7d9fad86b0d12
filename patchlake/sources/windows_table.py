"""The table of rolled-up windows that keep changing: parquet, partitioned by day and version.

A batch of a stream adds its changed windows as a version of their days; written again, as after a restart, it replaces that version
and nothing else. A window's state is that of its last version. Merging adds a version with the last state of all windows of a day, and
readers pass over what is older. So writers never change files that readers may have open, and no lock is needed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Windows (with `bucket`, their start) that a batch has changed, with their whole state."""
    _write(rows, path, 2 * batch)


def _write(rows: DataFrame, path: str, version: int) -> None:
    dated = rows.withColumns({"day": F.to_date("bucket"), "version": F.lit(version).cast("long")})
    dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(path)


def _versions(spark: SparkSession, path: str, first_day: str | None, last_day: str | None) -> DataFrame:
    rows = spark.read.parquet(path)
    if first_day:
        rows = rows.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        rows = rows.where(F.col("day") <= F.lit(last_day).cast("date"))
    return rows


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    merged = rows.where(F.col("version") % 2 == 1).groupBy("day").agg(F.max("version").alias("_since"))  # reads folder names only
    live = rows.join(merged, "day", "left").where(F.col("version") >= F.coalesce("_since", F.lit(0)))
    values = [c for c in rows.columns if c not in (*keys, "day", "version")]
    last = F.max_by(F.struct(*values), "version").alias("_last")
    return live.groupBy("day", *keys).agg(last).select("day", *keys, "_last.*")


def current(spark: SparkSession, path: str, keys: list[str], first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """The last state of each window, which `keys` tell apart, with `day`; a range of days prunes folders."""
    return _latest(_versions(spark, path, first_day, last_day), keys)


def merge(spark: SparkSession, path: str, keys: list[str], batch: int) -> None:
    """After a batch, bring together the days that it has changed. Done again it gives the same."""
    rows = spark.read.parquet(path)
    changed = rows.where(F.col("version") == 2 * batch).select("day").distinct()
    before = rows.where(F.col("version") <= 2 * batch).join(changed, "day", "left_semi")
    _write(_latest(before, keys).drop("day"), path, 2 * batch + 1)
