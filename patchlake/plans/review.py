"""Review of many pull requests: context, prompts, answers, comments, totals and points."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import null_safe_join, saved
from patchlake.operators import context, points, reviews
from patchlake.operators.answers import comment_rows, with_comments
from patchlake.operators.batches import embed_queries, embedding_calls
from patchlake.operators.nearest import nearest
from patchlake.operators.scan import issue_rows
from patchlake.plans.indexing import Embed, index_pull_requests, index_runs

PR = ["repo", "pr"]
#: A column that tells whether a changed file is of a failed pull request.
GONE = "_gone"


def retrieve(
    files: DataFrame, index: DataFrame, embed: Embed, folder: str, k: int = fixed.TOP_K, max_tokens: int = fixed.CONTEXT_TOKENS
) -> DataFrame:
    """Files with `similar`, `related`, `context` and `has_index`. Files have `file_path`, `patch`, `content`, `file_ord`.
    Where a pull request has no index, nothing is retrieved and no retrieval point is due.

    The embedded queries are saved below `folder`, so that each text is embedded once; the keys of files, also of those that ask nothing, are
    read from there, and not from the texts again.
    """
    wanted = context.query_text(F.col("patch"), F.col("content"))
    asked = files.select(*PR, F.col("file_ord").alias("query_idx"), "file_path", F.when(text.is_filled(wanted), wanted).alias("_query"))
    queries = saved(embed_queries(asked, "_query", embed), f"{folder}/queries")
    # saved one by one, as each step has a shuffle of its own, which then is gone before the next
    matches = saved(nearest(queries, index.select(*PR, "chunk_idx", "file_path", "embedding"), PR, k, exclude_own_file=True), f"{folder}/matches")
    # the context is worked out on the keys of files: their texts go once to the result
    keys = queries.select(*PR, "query_idx", "file_path").distinct()
    indexed = index.select(*PR).distinct().withColumn("has_index", F.lit(True))
    keys = null_safe_join(keys, indexed, PR, "left").withColumn("has_index", F.coalesce("has_index", F.lit(False)))
    found = context.with_context_text(context.gather(keys, matches, index, PR), max_tokens).withColumnRenamed("query_idx", "file_ord")
    found = saved(found, f"{folder}/contexts")
    return null_safe_join(files, found, [*PR, "file_ord", "file_path"])


def prompts(files: DataFrame, index: DataFrame, embed: Embed, system: str, folder: str) -> DataFrame:
    """Eligible files with their prompt. A pull request with no index rows gets prompts without context."""
    eligible = reviews.eligible_files(files).withColumn("file_path", F.col("filename"))
    found = retrieve(eligible, index, embed, folder)
    return found.withColumn("prompt", reviews.file_prompt(system)).withColumns(context.retrieval_stats())


def answered_files(prompted: DataFrame, generate: Callable[[str], tuple[str, int, int, int]], folder: str) -> DataFrame:
    """One row per prompted file with the model's answer or the error of the call and what the retrieval points need, saved below `folder`."""
    kept = prompted.select(*PR, "file_ord", "filename", "patch", "has_index", *context.retrieval_stats(), "prompt")
    return saved(reviews.generate_answers(kept, generate), f"{folder}/answers")


def commented_files(answered: DataFrame) -> DataFrame:
    """Files whose call went well, with the comments that are on their diff."""
    return with_comments(answered.where(F.col("error_type").isNull()))


def security_events(files: DataFrame) -> DataFrame:
    """Issues in the patches of eligible files, per pull request and file."""
    return issue_rows(reviews.eligible_files(files), "patch", [*PR, "filename"])


def request_security_events(requests: DataFrame) -> DataFrame:
    """Issues in diffs that were sent in by hand."""
    return issue_rows(requests.select("repo", F.col("pr_id").alias("pr"), "diff"), "diff", PR)


def review_points(files: DataFrame, answered: DataFrame, durations: DataFrame, model: str, keep: list[str] = ()) -> DataFrame:
    """Points of every reviewed pull request. `durations` has one row of seconds per (repo, pr)."""
    rolled = reviews.pr_rollup(files, answered.where(F.col("error_type").isNull()))
    return points.review_points(null_safe_join(rolled, durations, PR), model, "webhook", keep)


@dataclass(frozen=True)
class ReviewRun:
    """What one run over many pull requests gives. `points` has all metric points, with (repo, pr)."""

    comments: DataFrame
    headlines: DataFrame
    fallback_bodies: DataFrame
    security_events: DataFrame
    points: DataFrame


def review_pull_requests(
    changed: DataFrame,
    durations: DataFrame,
    failed: DataFrame,
    embed: Embed,
    generate: Callable[[str], tuple[str, int, int, int]],
    system: str,
    model: str,
    folder: str,
    size: int = fixed.EMBEDDING_SIZE,
) -> ReviewRun:
    """The whole review: contents, index, context, prompts, answers, comments, bodies and points.

    `changed` has the changed files with their contents, `durations` seconds per (repo, pr): duration, indexing_duration
    and retrieval_duration (of one file). Pull requests in `failed` (repo, pr, error_type), as those whose contents could
    not be read, get an error point and nothing else. A file whose call failed is left out of the review. Changed files, index, queries and
    answers are saved below `folder`, so that no model is called twice and `changed` is read once. Prompts are made as the model is called.
    Where `changed` has the column GONE, it is a table already, which is not saved again.
    """
    if GONE in changed.columns:
        files = changed.where(~F.col(GONE)).drop(GONE)
    else:
        gone = saved(failed.select(*PR).distinct(), f"{folder}/gone").withColumn(GONE, F.lit(True))  # a table, so that its size is known
        files = saved(null_safe_join(changed, gone, PR, "left").where(F.col(GONE).isNull()).drop(GONE), f"{folder}/files")
    index = index_pull_requests(files, embed, folder, size)
    answered = answered_files(prompts(files, index, embed, system, folder), generate, folder)
    commented = commented_files(answered)
    events = security_events(files)
    runs = null_safe_join(index_runs(files, index), durations.select(*PR, F.col("indexing_duration").alias("duration")), PR)
    found = null_safe_join(answered.where("has_index"), durations.select(*PR, F.col("retrieval_duration").alias("duration")), PR)
    all_points = [
        review_points(files, answered, durations.select(*PR, "duration"), model, keep=PR),
        points.security_points(events, "webhook", keep=PR),
        points.error_points(failed, "webhook", keep=PR),
        points.indexing_points(runs, keep=PR),
        points.retrieval_points(found, keep=PR),
        points.embedding_points(embedding_calls(index, PR), keep=PR),
    ]
    together = all_points[0]
    for more in all_points[1:]:
        together = together.unionByName(more)
    return ReviewRun(
        comment_rows(commented, [*PR, "file_ord"]), reviews.review_headlines(files, commented), reviews.fallback_bodies(commented), events, together
    )


def review_requests(answered: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Requests sent in by hand, with their answers: the responses, and the points of the reviews and of the issues in the diffs."""
    valid = reviews.valid_requests(answered)
    done = valid.withColumns({
        "pr": F.col("pr_id"), "cost": reviews.cost(F.col("prompt_tokens"), F.col("completion_tokens")),
        "context_utilization": reviews.utilization(F.col("prompt_tokens")),
        "total_changes": reviews.complexity(F.col("lines_added"), F.col("lines_deleted")),
    })
    made = points.review_points(done, model, "_experiment", keep=PR)
    return reviews.request_records(valid), made.unionByName(points.security_points(request_security_events(valid), "_experiment", keep=PR))
