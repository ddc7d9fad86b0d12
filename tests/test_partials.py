"""States of points by the hour, merged, against the points."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from patchlake.functions import tags
from patchlake.operators import partials, points, rollups
from patchlake.plans import dashboard
from patchlake.sources import points_table

NAMES = [("llm.reviews.total", "count"), ("llm.cost.per_review", "gauge"), ("llm.duration.seconds", "histogram"), ("llm.errors", "count"), ("odd", "set")]


def made(spark, n=3000):
    r = random.Random(3)
    rows = []
    for i in range(n):
        name, kind = r.choice(NAMES)
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(60 * 24 * 40))
        rows.append((i, at, name, r.choice([None, *[round(r.expovariate(1), 3) for _ in range(9)]]), kind, [f"repo:{r.choice('ab')}", *r.choice([[], ["env:staging"]])]))
    df = spark.createDataFrame(rows, "point_id long, ts timestamp, metric string, value double, type string, tags array<string>")
    return points.metric_rows(df, at=F.col("ts"), keep=["point_id"])


def close(df, *order):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return made(spark).cache()


@pytest.mark.parametrize("width", ["1 day", "30 days"])
def test_merged_states_are_those_of_the_points(spark, rows, width):
    repo = tags.value_of(F.col("tags"), "repo")
    want = rollups.by_type(rows.withColumn("repo", repo), ["repo"], width).orderBy("metric_name", "repo", "bucket")
    # an hour's points may come in two parts, and hours may be merged to days first
    parts = partials.hourly(rows.where("point_id % 3 = 0")).union(partials.hourly(rows.where("point_id % 3 <> 0")))
    days = partials.merged(parts, ["metric_name", "metric_type", "tags"], "1 day")
    for states in (parts, days):
        got = partials.by_type(states.withColumn("repo", repo), ["repo"], width)
        columns = ["metric_name", "metric_type", "repo", "bucket", "value", "n", "avg", "max", "p50", "p95"]  # few points: sketches hold all
        assert close(got.select(columns), "metric_name", "repo", "bucket") == close(want.select(columns), "metric_name", "repo", "bucket")


def test_percentiles_of_many_points(spark):
    many = spark.range(200_000).selectExpr(
        "id point_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id % 24) timestamp", "'m' metric_name", "'histogram' metric_type",
        "pow(xxhash64(id) % 1000003, 2) value", "cast(array() as array<struct<key:string,value:string>>) tags", "'s' service", "'e' env")
    states = partials.hourly(many)
    assert states.count() == 24
    (row,) = partials.by_type(states, [], "1 day").collect()
    for share, value in ((0.5, row.p50), (0.95, row.p95)):
        rank = many.where(F.col("value") <= value).count() / 200_000
        assert abs(rank - share) <= partials.RANK_ERROR


@pytest.mark.parametrize("name", sorted(dashboard.WIDGETS))
def test_widgets_over_states(spark, rows, name):
    order = [c for c in ("repo", "event_type", "bucket") if c in dashboard.WIDGETS[name](rows).columns]
    assert close(dashboard.WIDGETS[name](partials.hourly(rows)), *order) == close(dashboard.WIDGETS[name](rows), *order)


def test_stored_widgets_read_their_days_only(spark, rows, tmp_path):
    path = str(tmp_path / "states")
    points_table.append(partials.hourly(rows), path)
    chosen = rows.where("timestamp >= '2024-01-05' and timestamp < '2024-01-12'")
    got = dashboard.stored_widget("cost_by_repo", spark, path, "2024-01-05", "2024-01-11", width="7 days")
    assert close(got, "repo", "bucket") == close(dashboard.cost_by_repo(chosen, "7 days"), "repo", "bucket")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "IsNotNull(metric_name)" in plan and "sketch" not in plan
    of_repo = dashboard.stored_widget("total_reviews", spark, path, "2024-01-05", "2024-01-11", repo="a", env="staging")
    want = rollups.select_rows(chosen, "a", "staging")
    assert close(of_repo, "value") == close(dashboard.total_reviews(want), "value")
