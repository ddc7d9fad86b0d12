"""Model answers: comment lines of the form "number : text", kept when they are on the diff."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import computed, exploded
from patchlake.operators.diffs import on_diff, with_diff_ranges


def has_comments(answer: Column) -> Column:
    """False for an empty answer and for one that says anywhere that all is well."""
    lowered = F.lower(answer)
    clean = lowered.contains(fixed.NO_ISSUES[0])
    for phrase in fixed.NO_ISSUES[1:]:
        clean = clean | lowered.contains(phrase)
    return text.is_filled(answer) & ~clean


def parsed(answer: Column) -> Column:
    """Array of (pos, line, text): filled lines, with the number they start with or null."""
    stripped = F.transform(
        text.lines(text.strip(answer)), lambda line, i: F.struct(i.alias("pos"), text.strip(line).alias("text"))
    )
    numbered = F.transform(
        F.filter(stripped, lambda c: c["text"] != ""),
        lambda c: F.struct(
            c["pos"], F.nullif(F.regexp_extract(c["text"], r"\A\d+", 0), F.lit("")).try_cast("bigint").alias("line"), c["text"].alias("text")
        ),
    )
    return F.when(has_comments(answer), numbered).otherwise(
        F.array().cast("array<struct<pos:int,line:bigint,text:string>>")
    )


def answer_lines(answers: DataFrame, keys: list[str], answer: str = "text") -> DataFrame:
    """All parsed lines as rows, before any filter."""
    rows = exploded(answers, keys, parsed(F.col(answer)))
    return rows.select(*keys, "pos", "line", F.col("text").alias("body"))


def with_comments(df: DataFrame, answer: str = "text", patch: str | None = "patch") -> DataFrame:
    """Add `comments`, the parsed lines that carry a line number; with a patch, one of its lines."""
    found = computed(df, _parsed=parsed(F.col(answer)))
    if patch is None:
        return computed(found, comments=F.filter("_parsed", lambda c: c["line"] != 0)).drop("_parsed")
    found = with_diff_ranges(found, patch, "_ranges")
    kept = F.filter("_parsed", lambda c: (c["line"] != 0) & on_diff(c["line"], F.col("_ranges")))
    return computed(found, comments=kept).drop("_parsed", "_ranges")


def comment_rows(df: DataFrame, keys: list[str], path: str = "filename") -> DataFrame:
    """Comments as they are posted: path, body, line on the new side."""
    rows = exploded(df, [*keys, F.col(path).alias("path")], F.col("comments"))
    return rows.select(
        *keys, "path", "pos", F.col("text").alias("body"), F.coalesce("line", F.lit(1)).alias("line"), F.lit("RIGHT").alias("side")
    )
