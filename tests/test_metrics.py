import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from patchlake.operators import points, rollups
from patchlake.plans import dashboard
from patchlake.sources import points_table
from patchlake.streaming import rollup as stream

DAY1, DAY2 = dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 6)


def test_review_points(spark):
    rows = [("o/r", 7, 100, 20, 120, 0.5, 1.5, 2.0, 3, 4), ("o/r", 8, 1, 1, 2, 0.5, 1.5, 2.0, 3, 0)]
    df = spark.createDataFrame(rows, "repo string, pr long, prompt_tokens long, completion_tokens long, total_tokens long, cost double, duration double, context_utilization double, files_changed long, total_changes long")
    made = points.review_points(df, "m", "_experiment", keep=["pr"], service="s", env="e").collect()
    assert len([p for p in made if p.pr == 7]) == 10 and len([p for p in made if p.pr == 8]) == 9
    one = [p for p in made if p.metric == "llm.cost.per_line"]
    assert [(p.value, p.type, p.tags) for p in one] == [(0.125, "gauge", ["repo:o/r", "pr:7", "model:m", "service:s", "env:e", "source:_experiment"])]


def test_embedding_points_and_stored_rows(spark):
    calls = spark.createDataFrame([(3, 0.5, False)], "batch_size long, duration double, success boolean")
    made = points.embedding_points(calls).collect()
    assert [(p.metric, p.value) for p in made] == [
        ("rag.embedding.batch_size", 3.0), ("rag.embedding.api_duration_seconds", 0.5), ("rag.embedding.api_calls", 1.0)]
    assert made[0].tags[-1] == "success:false"
    loose = spark.createDataFrame([("test.metric", 1, None, ["repo:test", "keyless", "url:http://x", ":v"])], "metric string, value int, type string, tags array<string>")
    (row,) = points.metric_rows(loose, service="test-service", env="x").collect()
    assert [(t.key, t.value) for t in row.tags] == [("repo", "test"), ("keyless", ""), ("url", "http://x"), ("", "v")]
    assert (row.metric_type, row.value, row.service, row.env) == ("gauge", 1.0, "test-service", "x")


def stored(spark):
    rows = [
        (1, DAY1, "llm.reviews.total", 1.0, "count", ["repo:a"]), (2, DAY1, "llm.reviews.total", 1.0, "count", ["repo:b"]),
        (3, DAY2, "llm.errors", 3.0, "count", ["repo:a"]), (4, DAY1, "llm.cost.per_review", 0.1, "gauge", ["repo:a"]),
        (5, DAY2, "llm.cost.per_review", 0.2, "gauge", ["repo:a"]), (6, DAY2, "llm.cost.per_review", 0.4, "gauge", ["repo:b", "env:staging"]),
        *[(10 + i, DAY1, "llm.duration.seconds", float(v), "histogram", ["repo:a"]) for i, v in enumerate([5, 1, 3, 3, 2, 90, 7])],
        (30, DAY1, "odd", 1.0, "set", ["repo:a"]),
    ]
    df = spark.createDataFrame(rows, "point_id long, ts timestamp, metric string, value double, type string, tags array<string>")
    return points.metric_rows(df, at=F.col("ts"), keep=["point_id"])


def test_widgets(spark):
    rows = stored(spark)
    assert dashboard.total_reviews(rows).collect()[0].value == 2.0
    assert dashboard.success_rate(rows).collect()[0].value == -50.0  # more errors than reviews
    assert [(r.bucket.day, r.value) for r in dashboard.error_rate(rows).orderBy("bucket").collect()] == [(1, None), (2, None)]
    total = dashboard.cumulative_cost_by_repo(rows).orderBy("repo", "bucket").collect()
    assert [(r.repo, r.bucket.day, r.value) for r in total] == [("a", 1, 0.1), ("a", 2, pytest.approx(0.3)), ("b", 2, 0.4)]
    assert dashboard.avg_cost(rollups.select_rows(rows, env="staging")).collect()[0].value == 0.4
    assert len(dashboard.WIDGETS) == 23


def test_rollup_by_type(spark):
    rows = stored(spark).withColumn("repo", F.lit("x"))
    got = {(r.metric_name, r.bucket.day): r for r in rollups.by_type(rows, ["repo"], "1 day").collect()}
    assert got["llm.reviews.total", 1].value == 2.0 and got["llm.cost.per_review", 2].value == 0.4
    spread = got["llm.duration.seconds", 1]
    assert (spread.n, spread.max, spread.p50, spread.p95) == (7, 90.0, 3.0, 90.0) and abs(spread.avg - 111 / 7) < 1e-9
    assert not any(name == "odd" for name, _ in got)


def test_percentiles_against_sorting(spark):
    values = [((i * 7919) % 1000) / 10 - 20 for i in range(700)] + [5.0] * 300
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    (row,) = rollups.percentiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.95, "d": 1.0}).collect()
    ordered = sorted(values)
    assert (row.a, row.b, row.c, row.d) == (ordered[9], ordered[499], ordered[949], ordered[999])


@pytest.mark.parametrize("draw", [lambda r: r.random() / 1000, lambda r: 10 ** r.uniform(-300, 300), lambda r: float(r.randrange(3))])
def test_percentiles_follow_the_data(spark, draw):
    r = random.Random(1)
    groups = {"a": [draw(r) for _ in range(2000)], None: [draw(r) for _ in range(31)]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values] + [("a", None)], "g string, v double")
    rows = rollups.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, accuracy=200).collect()
    assert {x.g: (x.p50, x.p95) for x in rows} == {g: tuple(sorted(v)[math.ceil(len(v) * s) - 1] for s in (0.5, 0.95)) for g, v in groups.items()}


def test_sums_keep_values_of_any_size(spark):
    cases = {"tiny": [4e-9] * 3, "line": [6.25e-7], "nan": [1.0, float("nan")], "inf": [1.0, float("inf")], "huge": [1e21, 1e21]}
    rows = [(i, DAY1, name, v, "gauge", ["repo:a"]) for i, (name, v) in enumerate((n, v) for n, vs in cases.items() for v in vs)]
    df = spark.createDataFrame(rows, "point_id long, ts timestamp, metric string, value double, type string, tags array<string>")
    stored_rows = points.metric_rows(df, at=F.col("ts"), keep=["point_id"])
    for name, values in cases.items():
        (got,) = rollups.scalars(stored_rows, total=rollups.Series("sum", name), mean=rollups.Series("avg", name)).collect()
        assert got.total == pytest.approx(sum(values), rel=1e-15, nan_ok=True) and got.mean == pytest.approx(sum(values) / len(values), rel=1e-15, nan_ok=True)


def test_points_table(spark, tmp_path):
    path = str(tmp_path / "points")
    points_table.append(stored(spark), path)
    assert points_table.read(spark, path, first_day="2024-01-02").count() == 3
    points_table.append(stored(spark), path)
    assert points_table.read(spark, path).count() == 28


def test_stream_equals_batch(spark, tmp_path):
    stored(spark).where("metric_name like 'llm.%'").write.parquet(str(tmp_path / "in"))
    late = dt.datetime(2024, 1, 9)
    newest = spark.createDataFrame([(99, late, "llm.errors", 1.0, "count", ["repo:a"])], "point_id long, ts timestamp, metric string, value double, type string, tags array<string>")
    points.metric_rows(newest, at=F.col("ts"), keep=["point_id"]).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rolled = stream.windowed(arriving, "1 day", "1 hour", by="repo")
    stream.write_final(rolled, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    got = sorted((r.bucket.day, r.metric_name, r.repo, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = stored(spark).where("metric_name like 'llm.%'").withColumn("repo", F.expr("tags[0].value"))
    wanted = batch.groupBy(F.dayofmonth("timestamp").alias("d"), "metric_name", "repo").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("t"))
    assert [(*g[:4], round(g[4], 6)) for g in got] == sorted((r.d, r.metric_name, r.repo, r.n, r.t) for r in wanted.collect())
