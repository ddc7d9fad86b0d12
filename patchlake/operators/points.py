"""Metric points from the rows of reviews, scans, errors, indexing, retrieval and embedding calls.

Every function makes all points of a row in one projection. Columns named in `keep` (a time, say) go
along unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions import tags
from patchlake.functions.frames import exploded

SERVICE = "code-review"


def _points(df: DataFrame, values: list[tuple[str, Column, str]], tag_list: Column, keep: list[str]) -> DataFrame:
    """One row per (metric, value, type); values that are null make no point."""
    made = F.array(*[
        F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(kind).alias("type"))
        for metric, value, kind in values
    ])
    present = F.filter(made, lambda p: p["value"].isNotNull())
    return exploded(df, [*keep, tag_list.alias("tags")], present).select(*keep, "metric", "value", "type", "tags")


def _origin(service: str, env: str) -> dict[str, Column]:
    return {"service": F.lit(service), "env": F.lit(env)}


def review_points(
    reviews: DataFrame, model: str, source: str, keep: list[str] = (), service: str = SERVICE, env: str = fixed.ENV
) -> DataFrame:
    """Ten points per review; nine when no line changed, as cost per line then has no meaning."""
    c = F.col
    values = [
        ("llm.tokens.prompt", c("prompt_tokens"), "gauge"),
        ("llm.tokens.completion", c("completion_tokens"), "gauge"),
        ("llm.tokens.total", c("total_tokens"), "gauge"),
        ("llm.cost.per_review", c("cost"), "gauge"),
        ("llm.duration.seconds", c("duration"), "histogram"),
        ("llm.context.utilization_pct", c("context_utilization"), "gauge"),
        ("pr.files_changed", c("files_changed"), "gauge"),
        ("pr.total_changes", c("total_changes"), "gauge"),
        ("llm.reviews.total", F.lit(1), "count"),
        ("llm.cost.per_line", F.when(c("total_changes") > 0, F.try_divide("cost", "total_changes")), "gauge"),
    ]
    tag_list = tags.compose(
        repo=c("repo"), pr=c("pr"), model=F.lit(model), **_origin(service, env), source=F.lit(source)
    )
    return _points(reviews, values, tag_list, list(keep))


def security_points(
    issues: DataFrame, source: str, keep: list[str] = (), service: str = SERVICE, env: str = fixed.ENV
) -> DataFrame:
    tag_list = tags.compose(
        event_type=F.col("type"), severity=F.col("severity"), repo=F.col("repo"), pr=F.col("pr"),
        **_origin(service, env), source=F.lit(source),
    )
    return _points(issues, [("security.events", F.lit(1), "count")], tag_list, list(keep))


def error_points(
    errors: DataFrame, source: str, keep: list[str] = (), service: str = SERVICE, env: str = fixed.ENV
) -> DataFrame:
    tag_list = tags.compose(
        error_type=F.col("error_type"), repo=F.col("repo"), pr=F.col("pr"), **_origin(service, env), source=F.lit(source)
    )
    return _points(errors, [("llm.errors", F.lit(1), "count")], tag_list, list(keep))


def indexing_points(runs: DataFrame, keep: list[str] = (), service: str = SERVICE, env: str = fixed.ENV) -> DataFrame:
    """Embedding time is taken as a fixed share of the indexing time."""
    values = [
        ("rag.indexing.files", F.col("files_indexed"), "gauge"),
        ("rag.indexing.chunks", F.col("chunks_created"), "gauge"),
        ("rag.indexing.duration_seconds", F.col("duration"), "histogram"),
        ("rag.embedding.duration_seconds", F.col("duration") * fixed.EMBEDDING_SHARE, "histogram"),
        ("rag.indexing.total", F.lit(1), "count"),
    ]
    tag_list = tags.compose(repo=F.col("repo"), pr=F.col("pr"), **_origin(service, env))
    return _points(runs, values, tag_list, list(keep))


def retrieval_points(
    retrievals: DataFrame, keep: list[str] = (), service: str = SERVICE, env: str = fixed.ENV
) -> DataFrame:
    values = [
        ("rag.retrieval.chunks", F.col("chunks_retrieved"), "gauge"),
        ("rag.retrieval.duration_seconds", F.col("duration"), "histogram"),
        ("rag.retrieval.context_tokens", F.col("context_tokens"), "gauge"),
        ("rag.retrieval.total", F.lit(1), "count"),
        ("rag.retrieval.max_similarity", F.col("max_similarity"), "gauge"),
    ]
    tag_list = tags.compose(repo=F.col("repo"), pr=F.col("pr"), **_origin(service, env))
    return _points(retrievals, values, tag_list, list(keep))


def embedding_points(calls: DataFrame, keep: list[str] = (), service: str = SERVICE, env: str = fixed.ENV) -> DataFrame:
    values = [
        ("rag.embedding.batch_size", F.col("batch_size"), "gauge"),
        ("rag.embedding.api_duration_seconds", F.col("duration"), "histogram"),
        ("rag.embedding.api_calls", F.lit(1), "count"),
    ]
    tag_list = tags.compose(**_origin(service, env), success=F.col("success"))
    return _points(calls, values, tag_list, list(keep))


def metric_rows(
    points: DataFrame, at: Column | None = None, service: str = SERVICE, env: str = fixed.ENV, keep: list[str] = ()
) -> DataFrame:
    """Points as they are stored: split tags, double values, type "gauge" where none is given."""
    return points.select(
        *keep,
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.col("metric").alias("metric_name"),
        F.col("value").cast("double").alias("value"),
        F.coalesce("type", F.lit("gauge")).alias("metric_type"),
        F.coalesce(tags.split_pairs(F.col("tags")), F.array().cast("array<struct<key:string,value:string>>")).alias("tags"),
        F.lit(service).alias("service"),
        F.lit(env).alias("env"),
    )
