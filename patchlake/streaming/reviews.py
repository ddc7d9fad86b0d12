"""Reviews that deliveries start: each batch of them is joined to the landed responses of the source host and reviewed as a whole."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from patchlake.functions import text
from patchlake.functions.frames import is_broadcast, null_safe_join, removed, saved, shuffles_removed
from patchlake.operators.deliveries import project, route
from patchlake.operators.reviews import PR, attach_contents
from patchlake.plans.review import GONE, ReviewRun
from patchlake.sources import landed
from patchlake.streaming.deliveries import put

#: What is kept of a batch, by the names of a run's results.
RESULTS = ["comments", "headlines", "fallback_bodies", "security_events", "points"]


def started_reviews(routed: DataFrame) -> DataFrame:
    """(repo, pr) of the pull requests whose review routed deliveries start, each once."""
    asked = project(routed.where("status = 'processing'"), [])
    return asked.select(F.col("full_repo").alias("repo"), F.col("pr_number").alias("pr")).distinct()


def unreadable(asked: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo, pr, error_type) of the asked pull requests that hold a file which can't be read. Of several errors of one the first in
    alphabetical order is given."""
    read = landed.file_contents(contents.where(text.is_reviewed_path(F.col("filename"))), PR).where("error_type is not null")
    return null_safe_join(read, asked, PR).groupBy(*PR).agg(F.min("error_type").alias("error_type"))


def fetched(asked: DataFrame, lists: DataFrame, contents: DataFrame) -> DataFrame:
    """Changed files of `asked` (repo, pr and what else is known of a pull request) with their contents.

    `lists` are landed file lists (repo, pr, body), `contents` landed contents (repo, pr, filename, body). A pull request without a list has no
    files. Contents are decoded where they are read: the text travels, which is smaller than its body. Where that shuffles no text, those of
    the asked ones are picked out first; else texts of others are passed over in the join with the file lists.
    """
    known = [c for c in asked.columns if c not in PR]
    changed = landed.changed_files(null_safe_join(lists, asked, PR), [*PR, *known])
    read = landed.file_contents(contents.where(text.is_reviewed_path(F.col("filename"))), PR).select(*PR, "filename", "content")
    return attach_contents(changed, null_safe_join(read, asked.select(*PR), PR) if is_broadcast(asked) else read, PR)


def write_reviews(
    deliveries: DataFrame,
    lists: DataFrame,
    contents: DataFrame,
    review: Callable[[DataFrame, DataFrame, str], ReviewRun],
    folder: str,
    checkpoint: str,
    secret: str = "",
    once: bool = False,
) -> StreamingQuery:
    """Review the pull requests that arriving deliveries ask for, and write each batch's results below `folder`, a sink per result.

    `review` takes changed files, failed pull requests and a folder for its saved tables, as plans.review.review_pull_requests does. A
    delivery that comes again within a batch starts one review; a later batch with the same pull request reviews it again, as a
    further push asks for. `lists` and `contents` are read anew for each batch. A batch that runs again replaces its results; its saved
    tables go to a folder of that attempt, so that none is left half written, and are removed when its results are.
    Changed files are marked as those of a failed pull request or not, so that a review can pass over them without a copy.
    """
    routed = route(deliveries, secret)

    def run(batch: DataFrame, number: int) -> None:
        work = f"{folder}/work/{number}-{uuid.uuid4().hex}"
        asked = saved(started_reviews(batch), f"{work}/asked")
        if asked.isEmpty():
            return
        failed = saved(unreadable(asked, contents), f"{work}/failed")
        marked = null_safe_join(asked, failed.select(*PR, F.lit(True).alias(GONE)).distinct(), PR, "left").withColumn(GONE, F.coalesce(GONE, F.lit(False)))
        changed = saved(fetched(saved(marked, f"{work}/marked"), lists, contents), f"{work}/changed")
        done = review(changed, failed, work)
        for name in RESULTS:
            with shuffles_removed(batch.sparkSession):
                put(getattr(done, name), folder, name, number)
        removed(batch.sparkSession, work)

    writer = routed.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
