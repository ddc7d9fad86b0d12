"""The widgets of the observability dashboard, each a function of stored metric rows.

Time series take the bucket width. Rates are null where no review was counted. Rows are points, or states of points (operators/partials).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.operators.rollups import Series, displayed, over_time, running_total, scalars, select_rows
from patchlake.sources import points_table

DAY = "1 day"
REVIEWS = Series("sum", "llm.reviews.total")
ERRORS = Series("sum", "llm.errors")


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


# Overview

def total_reviews(rows: DataFrame) -> DataFrame:
    return displayed(scalars(rows, value=REVIEWS), value=0)


def avg_cost(rows: DataFrame) -> DataFrame:
    return displayed(scalars(rows, value=Series("avg", "llm.cost.per_review")), value=4)


def success_rate(rows: DataFrame) -> DataFrame:
    """Can fall below zero: a review is counted only when it succeeds."""
    found = scalars(rows, reviews=REVIEWS, errors=ERRORS)
    rate = found.select(_percent(F.col("reviews") - F.col("errors"), F.col("reviews")).alias("value"))
    return displayed(rate, value=1)


def error_count(rows: DataFrame) -> DataFrame:
    return displayed(scalars(rows, value=ERRORS), value=0)


# Performance

def generation_time(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("avg", "llm.duration.seconds"))


def retrieval_latency_ms(rows: DataFrame, width: str = DAY) -> DataFrame:
    found = over_time(rows, width, value=Series("avg", "rag.retrieval.duration_seconds"))
    return found.withColumn("value", F.col("value") * 1000)


def avg_generation_time(rows: DataFrame) -> DataFrame:
    return displayed(scalars(rows, value=Series("avg", "llm.duration.seconds")), value=2)


def avg_retrieval_ms(rows: DataFrame) -> DataFrame:
    found = scalars(rows, value=Series("avg", "rag.retrieval.duration_seconds"))
    return displayed(found.withColumn("value", F.col("value") * 1000), value=0)


# Cost

def cost_by_repo(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, by="repo", value=Series("avg", "llm.cost.per_review"))


def cumulative_cost_by_repo(rows: DataFrame, width: str = DAY) -> DataFrame:
    found = over_time(rows, width, by="repo", cost=Series("sum", "llm.cost.per_review"))
    return running_total(found, "repo", "cost", "value")


# Tokens

def prompt_and_completion(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(
        rows, width, prompt=Series("avg", "llm.tokens.prompt"), completion=Series("avg", "llm.tokens.completion")
    )


def context_utilization(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("avg", "llm.context.utilization_pct"))


# Retrieval

def retrieval_count(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("sum", "rag.retrieval.total"))


def max_similarity(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("avg", "rag.retrieval.max_similarity"))


def chunks_retrieved(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("avg", "rag.retrieval.chunks"))


def context_tokens(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("avg", "rag.retrieval.context_tokens"))


# Indexing and embedding

def indexing_events(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("sum", "rag.indexing.total"))


def files_and_chunks(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, files=Series("avg", "rag.indexing.files"), chunks=Series("avg", "rag.indexing.chunks"))


def embedding_calls(rows: DataFrame, width: str = DAY) -> DataFrame:
    calls = "rag.embedding.api_calls"
    return over_time(
        rows, width, success=Series("sum", calls, ("success", "true")), failed=Series("sum", calls, ("success", "false"))
    )


# Security and errors

def security_by_type(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, by="event_type", value=Series("sum", "security.events"))


def error_rate(rows: DataFrame, width: str = DAY) -> DataFrame:
    found = over_time(rows, width, errors=ERRORS, reviews=REVIEWS)
    return found.select("bucket", _percent(F.col("errors"), F.col("reviews")).alias("value"))


# Pull requests

def files_changed(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("avg", "pr.files_changed"))


def lines_changed(rows: DataFrame, width: str = DAY) -> DataFrame:
    return over_time(rows, width, value=Series("avg", "pr.total_changes"))


WIDGETS = {
    function.__name__: function
    for function in (
        total_reviews, avg_cost, success_rate, error_count, generation_time, retrieval_latency_ms, avg_generation_time,
        avg_retrieval_ms, cost_by_repo, cumulative_cost_by_repo, prompt_and_completion, context_utilization,
        retrieval_count, max_similarity, chunks_retrieved, context_tokens, indexing_events, files_and_chunks,
        embedding_calls, security_by_type, error_rate, files_changed, lines_changed,
    )
}


def stored_widget(
    name: str, spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None, repo: str = "*", env: str = "*", **more
) -> DataFrame:
    """A widget over a stored table of points or of their states, for a range of days, a repository and an environment.

    Folders of other days are not read, nor files and row groups that lack the widget's metrics. `more` goes to the widget: the width of a series."""
    return WIDGETS[name](select_rows(points_table.read(spark, path, first_day, last_day), repo, env), **more)
