"""Helpers on DataFrames."""

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A filter or an explode over a plain projected column is pushed below the projection by the
    optimizer, with the whole expression put in its place, once for every use. An expression over the
    lines of a file would then run over and over. As the output of a generator it stays where it is.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    return df.select(*kept, F.inline_outer(F.array(made)))


def partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys together, in as many partitions as the session is set to.

    For Python work on each group. Adaptive execution would put partitions of few bytes together, but
    the work is in the groups and not in the bytes. A grouping by the same keys adds no shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, where null meets null. The keys are those of the left side."""
    named = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = [left[key].eqNullSafe(named[f"_right_{key}"]) for key in keys]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return left.join(named, condition, how).drop(*[f"_right_{key}" for key in keys])


def is_broadcast(df: DataFrame) -> bool:
    """Whether Spark broadcasts this side of a join, as far as it knows sizes before it runs: those of saved tables."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def cuts(batch: pd.DataFrame, keys: list[str], most: int | None = None) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end, null being equal to null; runs longer than `most` rows are cut up."""
    before = batch[keys].shift()
    new = ((batch[keys] != before) & ~(batch[keys].isna() & before.isna())).any(axis=1).to_numpy()
    new[:1] = True
    starts = np.flatnonzero(new).tolist()
    spans = zip(starts, [*starts[1:], len(batch)])
    return [(at, min(at + (most or b), b)) for a, b in spans for at in range(a, b, most or b - a)]


def map_groups(
    df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: StructType
) -> DataFrame:
    """Python work on each group, whose rows come in order; `work` gives rows or None.

    Groups follow each other in a sorted partition and are cut out of its Arrow batches, which costs a
    small group far less than a hand-over of its own. One group at a time is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            spans = cuts(batch, keys)
            if not spans:
                continue
            done = [work(batch.iloc[a:b]) for a, b in spans[:-1]]
            done = [rows for rows in done if rows is not None]
            if done:
                yield pd.concat(done, ignore_index=True)
            held = batch.iloc[spans[-1][0] :]  # the last group may go on in the next batch
        rows = None if held is None else work(held)
        if rows is not None:
            yield rows

    return partitioned(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def runs_of(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where runs of rows with equal keys begin, null being equal to null."""
    new = np.ones(batch.num_rows, dtype=bool)
    if batch.num_rows > 1:
        new[1:] = False
        for key in keys:
            before, after = batch[key][:-1], batch[key][1:]
            differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
            new[1:] |= differs | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new).tolist()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Sorted batches in parts that hold whole runs of equal keys: a run that goes on in the next batch is held back for it."""
    held: list[pa.RecordBatch] = []

    def key_at(batch: pa.RecordBatch, row: int) -> list:
        return [batch[key][row].as_py() for key in keys]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key_at(held[-1], held[-1].num_rows - 1) != key_at(batch, 0):
            yield held
            held = []
        last = runs_of(batch, keys)[-1]
        if last:
            yield [*held, batch.slice(0, last)]
            held = []
        held.append(batch.slice(last))
    if held:
        yield held


@contextmanager
def no_collection() -> Iterator[None]:
    """Python's search for cycles of objects pauses meanwhile: it would go over many small rows again and again, which hold none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: Spark's setting by which the shuffle files of a query go when it ends. Without it they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written: nothing reads them again. Else a job of many steps holds the
    shuffles of all of them on disk."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write to parquet and go on from there: what came before, model calls too, is not run again,
    whatever executors are lost later. The path has to be one that all executors share."""
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of saved tables that nothing reads any more, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exploded(df: DataFrame, keys: list, array: Column, *names: str) -> DataFrame:
    """One row per element, with its position if two names are given. Arrays of structs give their fields.

    The outer form is used because the plain one makes the optimizer test the array, and so work it
    out, before the explode; the rows that empty arrays leave behind are dropped after it.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias("_pos", "_item")).where(F.col("_pos").isNotNull())
    key_names = [name for name in rows.columns if name not in ("_pos", "_item")]
    if not names:
        return rows.select(*key_names, "_item.*")
    if len(names) == 1:
        return rows.select(*key_names, F.col("_item").alias(names[0]))
    if names[1] == "*":
        return rows.select(*key_names, F.col("_pos").alias(names[0]), "_item.*")
    return rows.select(*key_names, F.col("_pos").alias(names[0]), F.col("_item").alias(names[1]))
