"""What a job of several steps leaves on disk."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from checks.corpora import letter_counts
from patchlake.functions.frames import saved
from patchlake.operators import reviews
from patchlake.plans import review
from patchlake.streaming import deliveries as stream
from patchlake.streaming import reviews as review_stream
from tests.test_stream_sinks import body, land


def shuffle_files(spark):
    held = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().endswith(".data")}


def test_shuffles_go_when_a_table_is_saved(spark, tmp_path):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_files(spark), spark.conf.get(setting)
    made = saved(spark.range(1000).selectExpr("id % 7 k").groupBy("k").count().repartition(3, "k"), f"{tmp_path}/t")
    for _ in range(100):
        if left := shuffle_files(spark) - before:
            time.sleep(0.1)
    assert made.count() == 7 and not left and spark.conf.get(setting) == was


def landed(spark):
    files = [{"filename": f, "patch": "@@ -1 +1 @@\n+x", "changes": 1} for f in ("a.py", "b.md", "c.py")]
    lists = spark.createDataFrame([("o/r", n, json.dumps(files)) for n in range(4)], "repo string, pr long, body string")
    good, bad = ('{"content": "cHJpbnQ="}', '{"content": "Y2Fm6Q=="}')
    bodies = [("o/r", n, f, bad if n == 2 and f == "a.py" else good) for n in range(4) for f in ("a.py", "c.py", "gone.py")]
    return lists, spark.createDataFrame(bodies, "repo string, pr long, filename string, body string")


@pytest.fixture(params=["-1", "10MB"])
def broadcasts(spark, request):
    """Joins with the pull requests that are asked for: by a shuffle, or by a broadcast."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield request.param != "-1"
    spark.conf.set(setting, was)


def test_texts_are_shuffled_once_to_their_lists(spark, tmp_path, broadcasts):
    lists, contents = (saved(one, f"{tmp_path}/{k}") for k, one in enumerate(landed(spark)))
    asked = saved(spark.createDataFrame([("o/r", 1, False), ("o/r", 2, True), (None, 3, False)], "repo string, pr long, _gone boolean"), f"{tmp_path}/asked")
    made = review_stream.fetched(asked, lists, contents)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == (3 if broadcasts else 2)
    found = sorted(map(str, made.collect()))
    assert len(found) == 6 and sum("content='print'" in one for one in found) == 3 and sum("_gone=True" in one for one in found) == 3
    assert [tuple(x) for x in review_stream.unreadable(asked, contents).collect()] == [("o/r", 2, "UnicodeDecodeError")]


def test_a_batch_of_reviews_keeps_its_results_only(spark, tmp_path, broadcasts):
    """Its texts are in one table while it is reviewed, and in none after that."""
    source, out = (str(tmp_path / x) for x in ("in", "out"))
    lists, contents = landed(spark)
    tables = {}

    def run(changed, failed, folder):
        seconds = [F.lit(1.0).alias(c) for c in ("duration", "indexing_duration", "retrieval_duration")]
        durations = changed.groupBy(*reviews.PR).agg(F.count("*")).select(*reviews.PR, *seconds)
        made = review.review_pull_requests(changed, durations, failed, letter_counts, lambda prompt: ("1 : look", 1, 1, 2), "s", "m", folder, 26)
        tables.update({name: set(spark.read.parquet(f"{folder}/{name}").columns) for name in os.listdir(folder)})
        return made

    land(spark, source, [("a", 1, "pull_request", body("o/r", 1)), ("b", 2, "pull_request", body("o/r", 2)), ("c", 3, "ping", body("o/r", 3))])
    arriving = stream.read_landing(spark, source, spark.read.parquet(source).schema)
    review_stream.write_reviews(arriving, lists, contents, run, out, f"{tmp_path}/checkpoint", once=True).awaitTermination()
    assert {name for name, columns in tables.items() if {"patch", "content"} <= columns} == {"changed"}
    assert os.listdir(f"{out}/work") == []
    comments = stream.read_sink(spark, out, "comments").select("pr", "path").collect()
    assert sorted(map(tuple, comments)) == [(1, "a.py"), (1, "c.py")]
    assert {x.pr for x in stream.read_sink(spark, out, "points").where("metric = 'llm.errors'").collect()} == {2}
