"""Windows that keep changing: update output, replayed batches, merging, late rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from patchlake.operators import partials, rollups
from patchlake.sources import windows_table
from patchlake.streaming import rollup as stream

KEYS = ["bucket", "metric_name", "repo"]
SCHEMA = "timestamp timestamp, metric_name string, value double, tags array<struct<key:string,value:string>>"


def made(spark, seed, days, n=200):
    r = random.Random(seed)
    rows = [
        (dt.datetime(2024, 1, r.choice(days), r.randrange(24), r.randrange(60)), r.choice(["m1", "m2"]), float(r.randrange(9)), r.choice([[("repo", "a")], [("repo", "b")], []]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rolled(rows):
    """All rows in one batch, as the current table should have them."""
    repo = F.get(F.filter("tags", lambda t: t["key"] == "repo"), F.lit(0))["value"]
    grouped = rows.groupBy(F.window("timestamp", "1 day")["start"].alias("bucket"), "metric_name", repo.alias("repo")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sorted(map(tuple, grouped.collect()), key=str)


def found(df):
    return sorted(map(tuple, df.select(*KEYS, "n", "total").collect()), key=str)


def test_windows_come_out_before_they_are_final(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    seen = None
    for batch, days in enumerate([[1, 2, 3], [2, 3, 4], [4]]):
        rows = made(spark, batch, days)
        rows.coalesce(1).write.mode("append").parquet(source)
        seen = rows if seen is None else seen.union(rows)
        arriving = stream.windowed(spark.readStream.schema(SCHEMA).parquet(source), "1 day", "3 days", by="repo")
        stream.write_current(arriving, out, checkpoint, KEYS, merge_every=2, once=True).awaitTermination()
        now = windows_table.current(spark, out, KEYS)
        assert found(now) == rolled(seen)  # the newest day too, null repositories too
    # a day of its own is read without the others
    one = windows_table.current(spark, out, KEYS, "2024-01-04", "2024-01-04")
    assert found(one) == [x for x in rolled(seen) if x[0].day == 4]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")

    def states(value):
        rows = [(dt.datetime(2024, 1, d), "m", repo, value, float(value)) for d in (1, 2) for repo in ("a", None)]
        return spark.createDataFrame(rows, "bucket timestamp, metric_name string, repo string, n long, total double")

    windows_table.put(states(1), path, 0)
    windows_table.put(states(2).where("repo = 'a'"), path, 1)
    want = found(windows_table.current(spark, path, KEYS))
    assert [(x[0].day, x[2], x[3]) for x in want] == [(1, "a", 2), (1, None, 1), (2, "a", 2), (2, None, 1)]
    windows_table.put(states(2).where("repo = 'a'"), path, 1)
    assert found(windows_table.current(spark, path, KEYS)) == want
    for _ in range(2):  # so does merging, done twice, and a batch that is written again after it
        windows_table.merge(spark, path, KEYS, 1)
        assert found(windows_table.current(spark, path, KEYS)) == want
    windows_table.put(states(2).where("repo = 'a'"), path, 1)
    assert found(windows_table.current(spark, path, KEYS)) == want
    windows_table.put(states(7).where("repo is null and day(bucket) = 2"), path, 2)
    assert [x[3] for x in found(windows_table.current(spark, path, KEYS))] == [2, 1, 2, 7]


def test_rollup_by_type_on_a_stream(spark, tmp_path):
    """Points out of order and late, in three batches: as the rollup of all points in one."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    r = random.Random(9)
    kinds = [("c", "count"), ("g", "gauge"), ("h", "histogram"), ("x", "set")]
    rows = []
    for i in range(600):
        name, kind = r.choice(kinds)
        at = dt.datetime(2024, 1, r.choice([1, 2, 3]), r.randrange(24), r.choice([0, 30]))
        rows.append((i, at, name, kind, r.choice([None, 1.0, 2.5, 7.0]), [("repo", r.choice("ab"))]))
    schema = "point_id long, timestamp timestamp, metric_name string, metric_type string, value double, tags array<struct<key:string,value:string>>"
    points = spark.createDataFrame(rows, schema)
    keys = ["bucket", "metric_name", "metric_type", "repo"]
    for k in range(3):
        points.where(f"point_id % 3 = {k}").coalesce(1).write.mode("append").parquet(source)
        arriving = stream.windowed_by_type(spark.readStream.schema(schema).parquet(source), "1 day", "5 days", by=["repo"])
        stream.write_current(arriving, out, checkpoint, keys, once=True).awaitTermination()
    too_late = spark.createDataFrame([(1000, dt.datetime(2024, 3, 1), "c", "count", 1.0, []), (1001, dt.datetime(2024, 3, 1), "c", "count", 1.0, [])], schema)
    too_late.coalesce(1).write.mode("append").parquet(source)
    stream.write_current(stream.windowed_by_type(spark.readStream.schema(schema).parquet(source), "1 day", "5 days", by=["repo"]), out, checkpoint, keys, once=True).awaitTermination()
    spark.createDataFrame([(1002, dt.datetime(2024, 1, 1), "c", "count", 99.0, [("repo", "a")])], schema).coalesce(1).write.mode("append").parquet(source)
    stream.write_current(stream.windowed_by_type(spark.readStream.schema(schema).parquet(source), "1 day", "5 days", by=["repo"]), out, checkpoint, keys, once=True).awaitTermination()
    got = partials.shown(windows_table.current(spark, out, keys, last_day="2024-01-31"), ["repo"])
    want = rollups.by_type(points.withColumn("repo", F.get("tags", F.lit(0))["value"]), ["repo"], "1 day").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert windows_table.current(spark, out, keys, first_day="2024-02-01").first().n_points == 2
