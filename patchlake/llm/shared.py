"""What several operators use: the shared folder, saved tables, numbering of groups of any size."""

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, that the driver and all executors share.

    A temporary folder takes its place in local mode only; on a cluster the setting has to be there.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="patchlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Work the rows out now and keep them as a table below the shared folder, so that lost executors cost no rerun of
    what came before, and several readers see the same rows. Tables are compressed, and readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A task's Arrow batches, few rows at a time: what is made of a batch's texts is many times as large as they are.
    Memory that is let go is given back, as workers live on for other stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ranked(df: DataFrame, rows: int, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0, in an order that depends on the columns `order` alone.

    No window holds a whole group: its rows are dealt over buckets by the hash of `order`, as many as the root of
    `rows`, the rows of `df`, so that neither a bucket nor the list of buckets is long; a group's rows in earlier buckets are
    added from counts. `df` is read
    twice and has to be cheap or kept. Rows equal in keys and order are numbered in any order.
    """
    buckets = math.isqrt(rows) + 1
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(starts, [*keys, "_bucket"]).withColumn(out, F.col("_start") + F.col("_place")).drop("_bucket", "_place", "_start")
