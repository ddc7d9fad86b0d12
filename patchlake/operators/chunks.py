"""Cutting code files into chunks, inside the row: a file needs no shuffle to be cut."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import computed, exploded, null_safe_join
from patchlake.operators.definitions import LineFinder, with_definitions
from patchlake.operators.skew import with_running_start

FILES_AT_A_TIME = 256

_TYPE = "array<struct<start_line:int,end_line:int,chunk_type:string,name:string,content:string>>"


#: What cut_file tells of a chunk.
PARTS = [("start_line", T.IntegerType(), pa.int32()), ("end_line", T.IntegerType(), pa.int32()), *((n, T.StringType(), pa.string()) for n in ("chunk_type", "name", "content"))]


def _chunk(start: Column, end: Column, kind: Column, name: Column, content: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        kind.alias("chunk_type"),
        name.cast("string").alias("name"),
        content.alias("content"),
    )


def _joined(code_lines: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(code_lines, start, count), "\n")


def _none() -> Column:
    return F.array().cast(_TYPE)


def _windows(code_lines: Column, first: Column, count: Column, max_lines: int, overlap: int, kind: Column, name: Column):
    """Chunks of at most `max_lines` over `count` lines from line `first`; the last one reaches the end."""
    step = max(1, max_lines - overlap)
    last = F.ceil(F.greatest(count - max_lines, F.lit(0)) / step).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: _chunk(
            first + k * step,
            first + F.least(k * step + max_lines, count) - 1,
            kind,
            name,
            _joined(code_lines, first + k * step, F.least(F.lit(max_lines), count - k * step)),
        ),
    )


def _header(code_lines: Column, defs: Column, kind: str, name: Column) -> Column:
    """The lines above the first definition, if any of them is filled."""
    end = defs[0]["line"] - 1
    content = _joined(code_lines, F.lit(1), end)
    return F.when((end > 0) & ~text.is_blank(content), F.array(_chunk(F.lit(1), end, F.lit(kind), name, content))).otherwise(_none())


def _last_line(code_lines: Column, defs: Column, i: Column) -> Column:
    return F.coalesce(F.get(defs, i + 1)["line"] - 1, F.size(code_lines))


def _sorted(files: DataFrame) -> DataFrame:
    """Definitions by line; on one line the pattern order decides, as the struct starts (line, type_ord)."""
    return computed(with_definitions(files), _defs=F.array_sort("_defs"))


def cut_file(content: str | None, path: str | None, language: str | None, definitions: LineFinder) -> list[tuple]:
    """Start, end, type, name and content of the chunks of one file."""
    whole = "file", path and path.rsplit("/", 1)[-1], content
    if content is None:
        return [] if language in definitions.rows else [(1, None, *whole)]
    n_lines = content.count("\n") + 1
    defs = definitions(content, language) if n_lines > fixed.SMALL_FILE_LINES else []
    if not defs:
        return [(1, n_lines, *whole)]
    first, at = defs[0][0], defs[0][4]
    cut = [(1, first - 1, "imports", "imports", content[: at - 1])] if content[:at].strip() else []
    lines, _, kinds, names, starts = zip(*defs)
    most, parts = fixed.DEFINITION_CHARS, zip(lines, (*lines[1:], n_lines + 1), kinds, names, starts, (*starts[1:], len(content) + 1))
    cut += [
        (line, after - 1, kind, name, content[at : end - 1 if end - 1 <= at + most else at + most] if end > at else "")
        for line, after, kind, name, at, end in parts
    ]
    return cut


def function_chunks(files: DataFrame, keys: list[str]) -> DataFrame:
    """One chunk per definition, as used for the index. Short files and files without definitions stay whole.

    The lines of files are many, so they are looked for in Python, FILES_AT_A_TIME files at a time: expressions over the elements of an
    array take several times as long.
    """
    given = files.select(*keys, F.col("content").alias("_content"), F.col("file_path").alias("_path"), F.col("language").alias("_language"))
    fields = [*(given.schema[key] for key in keys), T.StructField("chunk_ord", T.IntegerType()), *(T.StructField(n, kind) for n, kind, _ in PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definitions = LineFinder()
        for whole in batches:
            for at in range(0, whole.num_rows, FILES_AT_A_TIME):
                batch = whole.slice(at, FILES_AT_A_TIME)
                cut = [cut_file(*file, definitions) for file in zip(*(batch[name].to_pylist() for name in ("_content", "_path", "_language")))]
                file = np.repeat(np.arange(len(cut)), [len(one) for one in cut])
                ords = pa.array([k for one in cut for k in range(len(one))], pa.int32())
                columns = list(zip(*(chunk for one in cut for chunk in one))) or [()] * len(PARTS)
                arrays = [*(batch[key].take(pa.array(file)) for key in keys), ords, *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, PARTS))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "chunk_ord", *(n for n, _, _ in PARTS)])

    return given.mapInArrow(run, T.StructType(fields))


def code_chunks(
    files: DataFrame, keys: list[str], max_lines: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of at most `max_lines`: the whole file, else by definition, else by fixed size."""
    code, defs = F.col("_lines"), F.col("_defs")
    whole = F.array(_chunk(F.lit(1), F.size(code), F.lit("file"), F.lit(None), F.col("content")))

    def of_definition(d: Column, i: Column) -> Column:
        end = _last_line(code, defs, i)
        count = end - d["line"] + 1
        single = F.array(_chunk(d["line"], end, d["type"], d["name"], _joined(code, d["line"], count)))
        parts = _windows(code, d["line"], count, max_lines, overlap, d["type"], d["name"])
        return F.when(count > max_lines, parts).otherwise(single)

    by_definition = F.concat(
        _header(code, defs, "import", F.lit(None)), F.flatten(F.transform(defs, of_definition))
    )
    chosen = (
        F.when(F.size(code) <= max_lines, whole)
        .when(F.size(defs) > 0, by_definition)
        .otherwise(_fixed(code, max_lines, overlap))
    )
    return _rows(_sorted(files), chosen, keys)


def _fixed(code: Column, max_lines: int, overlap: int) -> Column:
    return _windows(code, F.lit(1), F.size(code), max_lines, overlap, F.lit("block"), F.lit(None))


def fixed_chunks(
    files: DataFrame, keys: list[str], max_lines: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of fixed size with overlap, whatever the file holds."""
    cut = computed(files, _lines=text.lines(F.col("content")))
    return _rows(cut, _fixed(F.col("_lines"), max_lines, overlap), keys)


def _rows(files: DataFrame, chunks: Column, keys: list[str]) -> DataFrame:
    return exploded(files, keys, chunks, "chunk_ord", "*")


def number_chunks(chunks: DataFrame, group: list[str], file_order: str = "file_ord") -> DataFrame:
    """Add `chunk_idx`, the position in the index by file and by chunk in the file, from 0.

    Only one narrow row per file is ordered; the chunk's own position in its file does the rest.
    """
    counts = chunks.groupBy(*group, file_order).agg(F.count("*").alias("_chunks"))
    starts = with_running_start(counts, group, file_order, "_chunks", "_first").drop("_chunks")
    numbered = null_safe_join(chunks, starts, [*group, file_order])
    return numbered.withColumn("chunk_idx", F.col("_first") + F.col("chunk_ord")).drop("_first")


def file_to_chunks(numbered: DataFrame, group: list[str]) -> DataFrame:
    """First and last index and number of chunks by file; a file's chunks are numbered without gaps."""
    return numbered.groupBy(*group, "file_path").agg(
        F.min("chunk_idx").alias("first_idx"), F.max("chunk_idx").alias("last_idx"), F.count("*").alias("n_chunks")
    )


def embedding_text() -> Column:
    """Text handed to the embedding model for a chunk."""
    label = F.when(text.is_filled(F.col("name")), F.concat(F.col("chunk_type"), F.lit(": "), F.col("name"), F.lit("\n")))
    return F.concat(F.lit("File: "), F.col("file_path"), F.lit("\n"), F.coalesce(label, F.lit("")), F.col("content"))


def chunk_embedding_texts(path: str, chunks: list[tuple]) -> list[str]:
    """The same for the chunks of a file, as cut_file gives them, cut as for the model, for Python work."""
    front, most = f"File: {path}\n", fixed.TEXT_TOKENS * fixed.CHARS_PER_TOKEN
    return [(f"{front}{kind}: {name}\n{content}" if name else f"{front}{content}")[:most] for _, _, kind, name, content in chunks]


def embedding_tokens() -> Column:
    """Tokens of that text, cut as for the model, without making it."""
    label = F.when(text.is_filled(F.col("name")), F.length("chunk_type") + F.length("name") + F.lit(len(": \n")))
    n_chars = F.length("file_path") + F.length("content") + F.coalesce(label, F.lit(0)) + F.lit(len("File: \n"))
    most = fixed.TEXT_TOKENS * fixed.CHARS_PER_TOKEN
    return F.floor(F.when(n_chars > most, most).otherwise(n_chars) / fixed.CHARS_PER_TOKEN)
