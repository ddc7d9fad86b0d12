"""Deliveries into several sinks of one batch, told apart by id; reviews that deliveries start."""

import datetime as dt
import json

from pyspark.sql import functions as F

from patchlake.operators import reviews
from patchlake.plans.review import ReviewRun
from patchlake.streaming import deliveries as stream
from patchlake.streaming import reviews as review_stream

SCHEMA = "delivery_id string, arrived timestamp, event string, signature string, body binary"


def body(repo, number, action="opened"):
    made = {"action": action, "number": number, "pull_request": {"head": {}, "base": {}}, "repository": {"full_name": repo, "owner": {"login": "o"}}, "sender": {}}
    return json.dumps(made).encode()


def land(spark, path, rows):
    made = [(i, dt.datetime(2024, 1, 1, 0, m), event, None, b) for i, m, event, b in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_deliveries_land_once_in_every_sink(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        arriving = stream.distinct_deliveries(stream.read_landing(spark, source, spark.read.parquet(source).schema), "delivery_id", "arrived", "1 hour")
        stream.write_sinks(arriving, out, checkpoint, once=True).awaitTermination()

    land(spark, source, [("a", 1, "pull_request", body("o/r", 1)), ("a", 2, "pull_request", body("o/r", 1)), ("b", 3, "ping", body("o/r", 2)), ("c", 4, "pull_request", b"{broken")])
    # the first try fails after one sink is written: the batch runs again as a whole
    real, calls = stream.put, []

    def failing(rows, folder, sink, batch):
        calls.append(sink)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(rows, folder, sink, batch)

    monkeypatch.setattr(stream, "put", failing)
    try:
        run()
    except Exception as error:
        assert "lost" in str(error)
    run()
    land(spark, source, [("a", 5, "pull_request", body("o/r", 1)), ("d", 6, "pull_request", body("o/r", 3, "closed"))])
    run()  # the same id in a later batch
    held = {sink: sorted(r.delivery_id for r in stream.read_sink(spark, out, sink).collect()) for sink in ("reviews", "rejected", "log")}
    assert held == {"reviews": ["a"], "rejected": ["c"], "log": ["a", "b", "c", "d"]}
    counts = stream.read_sink(spark, out, "counts").groupBy("status").agg(F.sum("n").alias("n")).collect()
    assert {r.status: r.n for r in counts} == {"processing": 1, "ok": 1, "rejected": 1, "skipped": 1}


def test_deliveries_start_reviews(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    one = json.dumps([{"filename": "a.py", "patch": "@@ -1 +1 @@\n+x", "changes": 1}, {"filename": "b.md", "patch": "+y", "changes": 2}, {"filename": "c.py"}])
    lists = spark.createDataFrame([("o/r", 1, one), ("o/r", 2, one), ("o/q", 1, one)], "repo string, pr long, body string")
    good, bad = json.dumps({"content": "cHJpbnQ="}), json.dumps({"content": "Y2Fm6Q=="})
    contents = spark.createDataFrame(
        [("o/r", 1, "a.py", good), ("o/r", 1, "c.py", '{"message":"Not Found"}'), ("o/r", 2, "a.py", bad), ("o/r", 2, "c.py", good), ("o/q", 1, "a.py", good)],
        "repo string, pr long, filename string, body string",
    )
    seen = []

    def review(changed, failed, folder):
        seen.append(([tuple(r) for r in changed.orderBy("repo", "pr", "file_ord").select("repo", "pr", "file_ord", "filename", "changes", "content").collect()], [tuple(r) for r in failed.collect()]))
        counted = changed.groupBy("repo", "pr").count()
        return ReviewRun(reviews.eligible_files(changed), counted, counted, counted, counted)

    def run():
        arriving = stream.read_landing(spark, source, spark.read.parquet(source).schema)
        review_stream.write_reviews(arriving, lists, contents, review, out, checkpoint, once=True).awaitTermination()

    land(spark, source, [("a", 1, "pull_request", body("o/r", 1)), ("b", 2, "pull_request", body("o/r", 1, "synchronize")), ("c", 3, "pull_request", body("o/r", 2)), ("d", 4, "ping", body("o/q", 1)), ("e", 5, "pull_request", body("o/none", 9))])
    run()
    assert seen == [(
        [("o/r", 1, 0, "a.py", 1, "print"), ("o/r", 1, 1, "b.md", 2, None), ("o/r", 1, 2, "c.py", 0, None), ("o/r", 2, 0, "a.py", 1, None), ("o/r", 2, 1, "b.md", 2, None), ("o/r", 2, 2, "c.py", 0, "print")],
        [("o/r", 2, "UnicodeDecodeError")],
    )]
    assert stream.read_sink(spark, out, "points").count() == 2
    land(spark, source, [("f", 9, "pull_request", body("o/r", 1, "synchronize"))])  # a further push: reviewed again, as a batch of its own
    land(spark, source, [("g", 9, "ping", body("o/r", 1))])
    run()
    assert len(seen) == 2 and {r[:2] for r in seen[1][0]} == {("o/r", 1)} and seen[1][1] == []
    assert sorted((r.repo, r.pr, r.batch) for r in stream.read_sink(spark, out, "points").collect()) == [("o/r", 1, 0), ("o/r", 1, 1), ("o/r", 2, 0)]
