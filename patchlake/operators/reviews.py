"""Per-file reviews, their prompts and cost, and what a pull request adds up to."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import exploded, null_safe_join
from patchlake.functions.numbers import round_half_even
from patchlake.operators.scan import issues

PR = ["repo", "pr"]
FILES_PER_PART = 100


@dataclass(frozen=True)
class Headings:
    """What stands in front of the parts of a prompt. The order of the parts is given, their wording is not."""

    context: str = "Code of the same repository that is close to this change,\nto compare names and habits with:"
    file: str = "File:"
    content: str = "Its text after the change:"
    patch: str = "The change to review:"
    diff: str = "The changes to review:"


HEADINGS = Headings()


def eligible_files(files: DataFrame, extensions: list[str] = fixed.REVIEWED_EXTENSIONS) -> DataFrame:
    """Files that are reviewed: with a patch, of a wanted extension, with content."""
    return files.where(
        text.is_filled(F.col("patch")) & text.is_reviewed_path(F.col("filename"), extensions) & text.is_filled(F.col("content"))
    )


def attach_contents(
    files: DataFrame, contents: DataFrame, keys: list[str], extensions: list[str] = fixed.REVIEWED_EXTENSIONS
) -> DataFrame:
    """Add `content` to changed files. Only wanted extensions are looked up, the others get null.

    A content row is unique by keys and filename, and so is a changed file.
    """
    wanted = contents.where(text.is_reviewed_path(F.col("filename"), extensions) & text.is_filled(F.col("content")))
    return null_safe_join(files, wanted.select(*keys, "filename", "content"), [*keys, "filename"], "left")


def cost(
    prompt_tokens: Column,
    completion_tokens: Column,
    per_1k_input: float = fixed.COST_PER_1K_INPUT,
    per_1k_output: float = fixed.COST_PER_1K_OUTPUT,
) -> Column:
    return prompt_tokens / 1000 * per_1k_input + completion_tokens / 1000 * per_1k_output


def utilization(prompt_tokens: Column, window: int = fixed.CONTEXT_WINDOW) -> Column:
    """Share of the model's context window in percent."""
    return prompt_tokens / window * 100


def complexity(lines_added: Column, lines_deleted: Column) -> Column:
    return lines_added + lines_deleted


def pr_rollup(files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row per pull request. File and change counts are over all files, the rest over reviewed ones.

    Completion tokens are what is left of the total, not the sum of the files' own.
    """
    changed = files.groupBy(*PR).agg(
        F.count("*").alias("files_changed"), F.coalesce(F.sum("changes"), F.lit(0)).alias("total_changes")
    )
    used = reviewed.groupBy(*PR).agg(
        F.count("*").alias("files_reviewed"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum(cost(F.col("prompt_tokens"), F.col("completion_tokens"))).alias("cost"),
        F.max(utilization(F.col("prompt_tokens"))).alias("context_utilization"),
    )
    joined = null_safe_join(changed, used, PR, "left").fillna(
        0, ["files_reviewed", "total_tokens", "prompt_tokens", "cost", "context_utilization"]
    )
    return joined.withColumn("completion_tokens", F.col("total_tokens") - F.col("prompt_tokens"))


def review_headlines(files: DataFrame, commented: DataFrame) -> DataFrame:
    """Body of the posted review of each pull request, with its number of comments."""
    counted = commented.groupBy(*PR).agg(F.sum(F.size("comments")).alias("n_comments"))
    joined = null_safe_join(files.select(*PR).distinct(), counted, PR, "left").fillna(0, ["n_comments"])
    headline = F.concat(F.lit("AI Code Review - "), F.col("n_comments"), F.lit(" issue(s) found"))
    body = F.when(F.col("n_comments") == 0, fixed.APPROVED_BODY).otherwise(headline)
    return joined.select(*PR, "n_comments", body.alias("body"))


def fallback_bodies(commented: DataFrame) -> DataFrame:
    """The one long comment that stands in for line comments, in parts.

    Joined in the order of `part`, the parts of a pull request are its whole body. Part 0 is the
    heading; each later part holds the comments of up to FILES_PER_PART files, so no pull request is
    gathered in one row, however large it is.
    """
    with_any = commented.where(F.size("comments") > 0)
    piece = F.array_join(
        F.transform("comments", lambda c: F.concat(F.lit("**"), F.col("filename"), F.lit("**: "), c["text"], F.lit("\n\n"))), ""
    )
    pieces = with_any.select(*PR, "file_ord", piece.alias("piece"))
    parts = pieces.groupBy(*PR, (F.floor(F.col("file_ord") / FILES_PER_PART) + 1).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "piece"))), lambda p: p["piece"]), "").alias("body")
    )
    # the first part of a pull request brings its heading, so that comments are matched once
    first = F.row_number().over(Window.partitionBy(*PR).orderBy("part")) == 1
    heading = F.struct(F.lit(0).cast("long").alias("part"), F.lit(fixed.FALLBACK_HEADING).alias("body"))
    own = F.struct("part", "body")
    return exploded(parts.withColumn("_first", first), PR, F.when(F.col("_first"), F.array(heading, own)).otherwise(F.array(own)))


def file_prompt(system: str, headings: Headings = HEADINGS) -> Column:
    """Prompt for one file: `context` (may be empty), `filename`, `content` and `patch`."""
    context = F.when(
        text.is_filled(F.col("context")), F.concat(F.lit(f"\n{headings.context}\n"), F.col("context"), F.lit("\n\n"))
    ).otherwise("")
    return F.concat(
        F.lit(system), F.lit("\n"), context,
        F.lit(f"\n{headings.file}\n"), F.col("filename"),
        F.lit(f"\n\n{headings.content}\n"), F.substring("content", 1, fixed.PROMPT_FILE_CHARS),
        F.lit(f"\n\n{headings.patch}\n"), F.col("patch"), F.lit("\n"),
    )


def request_prompt(system: str, headings: Headings = HEADINGS) -> Column:
    """Prompt for a whole diff that was sent in by hand."""
    return F.concat(
        F.lit(system), F.lit("\n\nRepository: "), F.col("repo"), F.lit("\nPull Request: #"), F.col("pr_id"),
        F.lit("\nFiles changed: "), F.col("files_changed"), F.lit("\nLines added: "), F.col("lines_added"),
        F.lit("\nLines deleted: "), F.col("lines_deleted"), F.lit(f"\n\n{headings.diff}\n"), F.col("diff"), F.lit("\n"),
    )


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with all fields and no negative count."""
    counts = ["files_changed", "lines_added", "lines_deleted"]
    ok = F.col("repo").isNotNull() & F.col("pr_id").isNotNull() & F.col("diff").isNotNull()
    for name in counts:
        ok = ok & F.coalesce(F.col(name) >= 0, F.lit(False))
    return requests.where(ok)


def request_records(answered: DataFrame) -> DataFrame:
    """Response to a request that was sent in by hand, from the request and its answer in one row."""
    found = answered.withColumn("security_issues", issues(F.col("diff")))
    return found.select(
        "repo", "pr_id", F.col("text").alias("review"),
        round_half_even(cost(F.col("prompt_tokens"), F.col("completion_tokens")), 6).alias("cost_usd"),
        F.col("prompt_tokens").alias("tokens_prompt"),
        F.col("completion_tokens").alias("tokens_completion"),
        F.col("total_tokens").alias("tokens_total"),
        (F.col("duration") * 1000).cast("bigint").alias("duration_ms"),
        round_half_even(utilization(F.col("prompt_tokens")), 2).alias("context_utilization_pct"),
        complexity(F.col("lines_added"), F.col("lines_deleted")).alias("pr_complexity"),
        "security_issues",
        F.col("answered_at").alias("timestamp"),
    )


def generate_answers(prompts: DataFrame, generate: Callable[[str], tuple[str, int, int, int]], prompt: str = "prompt") -> DataFrame:
    """Call the model once per row. Adds the answer, its token counts and `error_type` (null when it went well).

    The rows of failed calls are kept with their error, so that they can be counted and left out.
    `generate` returns text, prompt tokens, completion tokens and total tokens.
    """
    kept = [field for field in prompts.schema.fields if field.name != prompt]
    added = [
        T.StructField("text", T.StringType()), T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()), T.StructField("total_tokens", T.LongType()),
        T.StructField("error_type", T.StringType()),
    ]
    names = [field.name for field in kept]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def ask(one: str) -> tuple:
        try:
            return (*generate(one), None)
        except Exception as error:  # a failed call is a result here
            return (None, None, None, None, type(error).__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = list(zip(*map(ask, batch[prompt].to_pylist()))) or [()] * len(added)
            arrays = [*(batch[name] for name in names), *(pa.array(values, kind) for values, kind in zip(answers, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(field.name for field in added)])

    return prompts.mapInArrow(run, T.StructType([*kept, *added]))
