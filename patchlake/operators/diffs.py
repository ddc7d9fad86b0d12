"""Lines of a patch that can carry a comment.

Every hunk gives one unbroken range of lines in the new file, so a patch is kept as a short array of
ranges and never has to be spread to rows for a lookup.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import computed, exploded


def _stays(line: Column) -> Column:
    """Anything but a removed line is in the new file; "---" is not read as a removal."""
    return ~line.startswith("-") | line.startswith("---")


def with_diff_ranges(df: DataFrame, patch: str = "patch", out: str = "diff_ranges") -> DataFrame:
    """Add the ranges (first, last) of commentable lines of the new file, one per hunk."""
    df = computed(df, _lines=text.lines(F.coalesce(F.col(patch), F.lit(""))))
    start = lambda line: F.regexp_extract(line, r"\A" + fixed.HUNK_HEADER, 1)
    heads = F.array_compact(
        F.transform(
            "_lines",
            lambda line, i: F.when(line.startswith("@@ -"), F.struct(i.alias("pos"), F.nullif(start(line), F.lit("")).alias("start"))),
        )
    )
    heads = F.transform(
        F.filter(heads, lambda head: head["start"].isNotNull()),
        lambda head: F.struct(head["pos"], head["start"].try_cast("bigint").alias("start")),
    )
    df = computed(df, _heads=F.filter(heads, lambda head: head["start"].isNotNull()))

    def of_hunk(head: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("_heads"), i + 1)["pos"], F.size("_lines"))
        body = F.slice("_lines", head["pos"] + 2, end - head["pos"] - 1)
        count = F.size(F.filter(body, _stays))
        return F.struct(head["start"].alias("first"), (head["start"] + count - 1).alias("last"))

    ranges = F.filter(F.transform("_heads", of_hunk), lambda r: r["last"] >= r["first"])
    return computed(df, **{out: ranges}).drop("_lines", "_heads")


def diff_lines(df: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """One row per commentable line, each line once per file."""
    ranges = with_diff_ranges(df.select(*keys, patch), patch)
    numbers = F.flatten(F.transform("diff_ranges", lambda r: F.sequence(r["first"], r["last"])))
    return exploded(ranges, keys, F.array_distinct(numbers), "line")


def on_diff(line: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: line.between(r["first"], r["last"]))


def changed_lines(patch: Column, sign: str) -> Column:
    """Number of lines that start with the sign."""
    return F.size(F.filter(text.lines(patch), lambda line: line.startswith(sign)))
