"""Context of a file under review: similar chunks, chunks of its own, and their text within a budget."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import computed, null_safe_join
from patchlake.functions.numbers import round_half_even

MIN_SCORE = 0.5
SIMILAR_SHOWN, SIMILAR_CHARS, SIMILAR_SHARE = 3, 400, 0.7
RELATED_SHOWN, RELATED_CHARS, RELATED_SHARE = 2, 300, 0.9


def query_text(patch: Column, content: Column) -> Column:
    """What is searched for: the patch, else the start of the file."""
    return F.when(text.is_filled(patch), patch).otherwise(F.substring(content, 1, fixed.QUERY_CHARS))


def related_chunks(chunks: DataFrame) -> DataFrame:
    """First chunks of every file. `chunk_ord` numbers the chunks of a file, so this is a filter."""
    return chunks.where(F.col("chunk_ord") < fixed.RELATED_CHUNKS)


def _shown(chunk: Column, max_chars: int, score: Column | None = None) -> Column:
    """Heading and fenced text of one chunk, cut at `max_chars`. `chunk.content` may be cut later than that."""
    name = F.when(text.is_filled(chunk["name"]), F.concat(F.lit(" ("), chunk["name"], F.lit(")"))).otherwise("")
    mark = F.lit("")
    if score is not None:
        shown = F.format_string("%.2f", round_half_even(score.cast("double"), 2))
        mark = F.concat(F.lit(" [similarity: "), shown, F.lit("]"))
    long = F.length(chunk["content"]) > max_chars
    body = F.when(long, F.concat(F.substring(chunk["content"], 1, max_chars), F.lit(fixed.CUT_MARK))).otherwise(chunk["content"])
    return F.concat(
        F.lit("### "), chunk["file_path"], F.lit(":"), chunk["start_line"].cast("string"), name, mark,
        F.lit("\n```\n"), body, F.lit("\n```\n"),
    )


def _fill(pieces: Column, used: Column, limit: float) -> Column:
    """Take pieces until one would pass the limit: struct (text, used, stopped)."""

    def add(acc: Column, piece: Column) -> Column:
        stop = acc["stopped"] | (acc["used"] + F.length(piece) > limit)
        return F.struct(
            F.when(stop, acc["text"]).otherwise(F.concat(acc["text"], piece)).alias("text"),
            F.when(stop, acc["used"]).otherwise(acc["used"] + F.length(piece)).alias("used"),
            stop.alias("stopped"),
        )

    start = F.struct(F.lit("").alias("text"), used.cast("int").alias("used"), F.lit(False).alias("stopped"))
    return F.aggregate(pieces, start, add)


def with_context_text(df: DataFrame, max_tokens: int = fixed.CONTEXT_TOKENS, out: str = "context") -> DataFrame:
    """Add the context text from `similar` and `related`, arrays of chunks in rank order.

    Only the pieces count against the budget, not the section headings.
    """
    max_chars = max_tokens * fixed.CHARS_PER_TOKEN
    # A low score is passed over; a piece that does not fit ends its section.
    close = F.filter(F.slice("similar", 1, SIMILAR_SHOWN), lambda c: c["score"] >= MIN_SCORE)
    similar = F.transform(close, lambda c: _shown(c, SIMILAR_CHARS, c["score"]))
    related = F.transform(F.slice("related", 1, RELATED_SHOWN), lambda c: _shown(c, RELATED_CHARS))
    df = computed(df, _similar=similar, _related=related)
    df = computed(df, _first=_fill(F.col("_similar"), F.lit(0), max_chars * SIMILAR_SHARE))
    allowed = F.when(F.col("_first.used") < max_chars * RELATED_SHARE, F.col("_related")).otherwise(F.array().cast("array<string>"))
    df = computed(df, _second=_fill(allowed, F.col("_first.used"), float(max_chars)))
    sections = [
        F.when(F.col(f"{part}.text") != "", F.concat(F.lit(heading), F.col(f"{part}.text")))
        for part, heading in (("_first", fixed.SIMILAR_HEADING), ("_second", fixed.RELATED_HEADING))
    ]
    return df.withColumn(out, F.concat_ws("\n", *sections)).drop("_similar", "_related", "_first", "_second")


def gather(files: DataFrame, matches: DataFrame, chunks: DataFrame, group: list[str]) -> DataFrame:
    """Add `similar` and `related` to files that have `query_idx` and `file_path`.

    `matches` is the result of a search by query_idx, so a file gets at most its k rows. Only the
    start of a chunk is shown, so only that travels.
    """
    shown = max(SIMILAR_CHARS, RELATED_CHARS) + 1
    short = chunks.select(
        *group, "chunk_idx", "chunk_ord", "file_path", "start_line", "name", F.substring("content", 1, shown).alias("content")
    )
    # texts of matched chunks only; a chunk is matched by files of its own group, so no key is hot. The matches are few beside the chunks: they
    # are looked up by hash as the chunks stream by, and no text is sorted
    found = null_safe_join(matches.hint("shuffle_hash"), short, [*group, "chunk_idx"], "left")
    similar = found.groupBy(*group, "query_idx").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "file_path", "start_line", "name", "content", "chunk_idx"))).alias("similar")
    )
    related = related_chunks(short).groupBy(*group, "file_path").agg(
        F.array_sort(F.collect_list(F.struct("chunk_ord", "file_path", "start_line", "name", "content"))).alias("related")
    )
    joined = null_safe_join(null_safe_join(files, similar, [*group, "query_idx"], "left"), related, [*group, "file_path"], "left")
    empty = {name: F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)) for name in ("similar", "related")}
    return joined.withColumns(empty)


def retrieval_stats() -> dict[str, Column]:
    """Columns for the retrieval points, from `similar`, `related` and `context`."""
    return {
        "chunks_retrieved": F.size("similar") + F.size("related"),
        "context_tokens": text.tokens(F.col("context")),
        "max_similarity": F.coalesce(
            F.array_max(F.transform("similar", lambda c: c["score"])).cast("double"), F.lit(0.0)
        ),
    }
