"""Index of code chunks: cut, numbered, embedded, normalized.

The index is saved below a folder that all executors share, as it is read several times and the model should be called once per batch.
Groups of a bounded size, as pull requests are, go to a task whole, and their files are cut, numbered, batched and embedded there: a file
travels once, before it is cut, and no chunk is joined with anything. Larger groups, as repositories are, are held by no task. Numbers and
batches of their chunks are worked out on narrow tables of keys and tokens and put together by file; a file's text goes once to these, is cut
there, and its chunks go on in few rows to the task that holds their batches. Both ways give the same index.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import no_collection, null_safe_join, partitioned, runs_of, saved, whole_runs
from patchlake.operators.batches import VECTOR_FIELDS, ModelCalls, batch_starts, token_batches
from patchlake.operators.chunks import (
    FILES_AT_A_TIME, PARTS, chunk_embedding_texts, cut_file, embedding_tokens, function_chunks, number_chunks,
)
from patchlake.operators.definitions import LineFinder

Embed = Callable[[list[str]], list[list[float]]]


#: Groups whose files have no more characters than this are indexed by one task each.
WHOLE_GROUP_CHARS = 1_000_000
#: Batches of a larger group that a task holds at a time, each of a bounded number of tokens and chunks.
SPAN = 32


def indexed_files(files: DataFrame, skip_blank: bool) -> DataFrame:
    """Files that go into an index, with their language. A repository index passes over blank files,
    a pull-request index over empty ones."""
    content = F.col("content")
    filled = text.is_filled(content) & ~text.is_blank(content) if skip_blank else text.is_filled(content)
    kept = files.where(text.is_indexed_path(F.col("file_path")) & filled)
    return kept.withColumn("language", text.language(text.extension(F.col("file_path"))))


def chunk_table(files: DataFrame, group: list[str], folder: str, skip_blank: bool = False) -> DataFrame:
    """Numbered chunks of the files of each index, with the tokens of their embedding text.
    `file_ord` orders the files of a group.

    Files are cut once: the numbers come from the saved chunks, of which they read the keys only.
    """
    return number_chunks(cut_files(files, group, folder, skip_blank), group)


def cut_files(files: DataFrame, group: list[str], folder: str, skip_blank: bool = False) -> DataFrame:
    """The chunks of the files of each index as a saved table, not yet numbered."""
    return saved(_cut(indexed_files(files, skip_blank), group), f"{folder}/cut")


def _cut(files: DataFrame, group: list[str]) -> DataFrame:
    return function_chunks(files, [*group, "file_ord", "file_path", "language"]).withColumn("n_tokens", embedding_tokens())


def _places(files: DataFrame, group: list[str], folder: str) -> DataFrame:
    """Number, place in the file and batch of the chunks of each file, in the order of their numbers, as a saved table. No text is in any
    of the tables on the way."""
    chunk = [*group, "file_ord", "chunk_ord"]
    cut = saved(_cut(files, group).select(*chunk, "n_tokens"), f"{folder}/tokens")
    numbers = saved(number_chunks(cut, group), f"{folder}/numbers")
    batches = token_batches(numbers.select(*group, "chunk_idx", "n_tokens"), group, "chunk_idx", "n_tokens")
    placed = null_safe_join(numbers.drop("n_tokens"), batches, [*group, "chunk_idx"])
    own = F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_ord", "batch"))).alias("_places")
    return saved(placed.groupBy(*group, "file_ord").agg(own), f"{folder}/places")


def _index_schema(files: DataFrame, group: list[str]) -> T.StructType:
    own = [T.StructField("chunk_ord", T.IntegerType()), *(T.StructField(name, kind) for name, kind, _ in PARTS), T.StructField("n_tokens", T.LongType())]
    return T.StructType([
        *(files.schema[name] for name in group), T.StructField("chunk_idx", T.LongType()), *(files.schema[name] for name in ("file_ord", "file_path", "language")),
        *own, T.StructField("batch", T.LongType()), *VECTOR_FIELDS,
    ])


#: What is known of a chunk that goes to its batches.
_PLACED = [("chunk_idx", T.LongType(), pa.int64()), ("chunk_ord", T.IntegerType(), pa.int32()), ("batch", T.LongType(), pa.int64()), *PARTS]


def embed_chunks(files: DataFrame, group: list[str], embed: Embed, size: int, folder: str) -> DataFrame:
    """The index of groups of any size, from their files (group, file_ord, file_path, language, content): as embed_groups gives it. No task
    holds more than SPAN batches of a group. The files are read twice, so they should come from a table.

    The chunks of a file that go to one span of batches travel in one row, so that neither keys nor paths come with each of them."""
    keys, span = [*group, "file_ord", "file_path", "language"], [*group, "_span"]
    schema = _index_schema(files, group)
    lists = [T.StructField(name, T.ArrayType(kind)) for name, kind, _ in _PLACED]
    packed = T.StructType([*(files.schema[name] for name in keys), T.StructField("_span", T.LongType()), *lists])
    calls = ModelCalls(embed, size, unit=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definitions = LineFinder()
        for whole in batches:
            for at in range(0, whole.num_rows, FILES_AT_A_TIME):
                with no_collection():
                    made = spans(whole.slice(at, FILES_AT_A_TIME), definitions)
                yield made

    def spans(rows: pa.RecordBatch, definitions: LineFinder) -> pa.RecordBatch:
        cut = [cut_file(*one, definitions) for one in zip(*(rows[name].to_pylist() for name in ("content", "file_path", "language")))]
        n = np.array([len(one) for one in cut])
        places = rows["_places"]
        ends = places.offsets.to_numpy()
        number, place, batch = (places.values.field(name).to_numpy()[ends[0] : ends[-1]] for name in ("chunk_idx", "chunk_ord", "batch"))
        row = np.repeat(np.arange(len(n)), np.diff(ends))
        own = place < n[row]  # of a file that comes in several rows, some may have fewer chunks
        row, number, place, batch = (x[own] for x in (row, number, place, batch))
        new = np.ones(len(row), dtype=bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(batch // SPAN) != 0)
        starts = np.flatnonzero(new)
        chunks = [chunk for one in cut for chunk in one]
        parts = list(zip(*(chunks[k] for k in (np.cumsum(n) - n)[row] + place))) or [()] * len(PARTS)
        offsets = pa.array([*starts, len(row)], pa.int32())
        arrays = [*(rows[name].take(pa.array(row[starts])) for name in keys), pa.array(batch[starts] // SPAN, pa.int64())]
        arrays += [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, (_, _, kind) in zip([number, place, batch, *parts], _PLACED)]
        return pa.RecordBatch.from_arrays(arrays, names=packed.names)

    def indexed(rows: pa.RecordBatch) -> pa.RecordBatch:
        flat = {name: rows[name].flatten() for name, *_ in _PLACED}
        n = np.diff(rows["chunk_idx"].offsets.to_numpy())
        ends = np.cumsum(n).tolist()
        chunks = list(zip(*(flat[name].to_pylist() for name, *_ in PARTS)))
        texts = [one for path, a, b in zip(rows["file_path"].to_pylist(), [0, *ends], ends) for one in chunk_embedding_texts(path, chunks[a:b])]
        number, batch = (flat[name].to_numpy() for name in ("chunk_idx", "batch"))
        order = np.lexsort((number, batch))
        texts, of_row, take = [texts[k] for k in order], pa.array(np.repeat(np.arange(len(n)), n)[order]), pa.array(order)
        tokens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // fixed.CHARS_PER_TOKEN
        starts = np.flatnonzero(np.diff(batch[order], prepend=-1)).tolist()
        given = {name: rows[name].take(of_row) for name in keys} | {name: values.take(take) for name, values in flat.items()} | {"n_tokens": pa.array(tokens)}
        given |= dict(zip((field.name for field in VECTOR_FIELDS), calls(texts, list(zip(starts, [*starts[1:], len(texts)])))))
        return pa.RecordBatch.from_arrays([given[name] for name in schema.names], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_runs(batches, span):
            for rows in pa.Table.from_batches(parts).combine_chunks().to_batches():
                starts = runs_of(rows, span)
                for a, b in zip(starts, [*starts[1:], rows.num_rows]):
                    with no_collection():
                        made = indexed(rows.slice(a, b - a))
                    yield made

    placed = null_safe_join(files.select(*keys, "content"), _places(files, group, folder), [*group, "file_ord"])
    given = partitioned(placed.mapInArrow(pack, packed), *span).sortWithinPartitions(*span, "file_ord")
    return given.mapInArrow(run, schema)


def _numbered(n: np.ndarray, groups: list[int], files: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk the row it is of, its place there, and its number in its group. `n` are the chunks of each row; `groups` and `files` are
    the rows at which groups, and files in them, begin. A file that comes in several rows takes the numbers of all of them; as in a join by
    file and place, a chunk comes as often as its file has rows with such a place."""
    before = np.cumsum(n) - n

    def begin(starts: list[int]) -> np.ndarray:
        return before[np.repeat(starts, np.diff([*starts, len(n)]))]

    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - before[row]
    number = (begin(files) - begin(groups))[row] + place
    return row, place, number


def _copies(n: np.ndarray, files: list[int], row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each chunk comes: once, but for files that come in several rows."""
    copies = np.ones(len(row), dtype=int)
    for a, b in zip(files, [*files[1:], len(n)]):
        if b - a > 1:
            own = slice(*np.searchsorted(row, [a, b]))
            copies[own] = b - a - np.searchsorted(np.sort(n[a:b]), place[own], side="right")
    return copies


def embed_groups(files: DataFrame, group: list[str], embed: Embed, size: int) -> DataFrame:
    """The index of groups that a task can hold, from their files (group, file_ord, file_path, language, content): as embed_chunks
    gives it, with one shuffle of the files."""
    keys = [*group, "file_ord", "file_path", "language"]
    schema = _index_schema(files, group)
    calls = ModelCalls(embed, size, unit=True)

    def indexed(rows: pa.RecordBatch, definitions: LineFinder) -> pa.RecordBatch | None:
        groups, of_files = runs_of(rows, group), runs_of(rows, [*group, "file_ord"])
        paths = rows["file_path"].to_pylist()
        cut = [cut_file(*one, definitions) for one in zip(rows["content"].to_pylist(), paths, rows["language"].to_pylist())]
        n = np.array([len(one) for one in cut])
        if not n.sum():
            return None
        row, place, number = _numbered(n, groups, of_files)
        chunks = [chunk for one in cut for chunk in one]
        texts = [one for path, of_file in zip(paths, cut) for one in chunk_embedding_texts(path, of_file)]
        tokens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // fixed.CHARS_PER_TOKEN
        batch = np.empty(len(row), dtype=np.int64)
        ends = np.cumsum(n)[[*(at - 1 for at in groups[1:]), len(n) - 1]].tolist()
        for a, b in zip([0, *ends], ends):
            in_order = np.lexsort((tokens[a:b], number[a:b])) + a
            batch[a:b] = np.searchsorted(batch_starts(tokens[in_order]), number[a:b], side="right") - 1
        if len(of_files) < rows.num_rows:
            take = np.repeat(np.arange(len(row)), _copies(n, of_files, row, place))
            group_of = np.searchsorted(groups, row[take], side="right")
            take = take[np.lexsort((number[take], group_of))]
            row, place, number, tokens, batch = (x[take] for x in (row, place, number, tokens, batch))
            chunks, texts = [chunks[k] for k in take], [texts[k] for k in take]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (np.diff(np.searchsorted(groups, row, side="right")) != 0) | (np.diff(batch) != 0)
        starts = np.flatnonzero(new).tolist()
        of_row = pa.array(row)
        given = {name: rows[name].take(of_row) for name in keys}
        given |= {"chunk_idx": pa.array(number), "chunk_ord": pa.array(place, pa.int32()), "n_tokens": pa.array(tokens), "batch": pa.array(batch)}
        given |= {name: pa.array(values, kind) for (name, _, kind), values in zip(PARTS, zip(*chunks))}
        given |= dict(zip((field.name for field in VECTOR_FIELDS), calls(texts, list(zip(starts, [*starts[1:], len(texts)])))))
        return pa.RecordBatch.from_arrays([given[name] for name in schema.names], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definitions = LineFinder()
        for parts in whole_runs(batches, group):
            for rows in pa.Table.from_batches(parts).combine_chunks().to_batches():
                at = 0
                for end in [*runs_of(rows, group)[1:], rows.num_rows]:
                    if end - at >= FILES_AT_A_TIME or end == rows.num_rows:
                        with no_collection():
                            made = indexed(rows.slice(at, end - at), definitions)
                        if made is not None:
                            yield made
                        at = end

    given = partitioned(files.select(*keys, "content"), *group).sortWithinPartitions(*group, "file_ord")
    return given.mapInArrow(run, schema)


def embed_files(files: DataFrame, group: list[str], embed: Embed, size: int, folder: str, skip_blank: bool = False) -> DataFrame:
    """Index of files, each group in the way that its size asks for, saved. The files are read several times, so they should come from a table."""
    kept = indexed_files(files, skip_blank).select(*group, "file_ord", "file_path", "language", "content")
    amounts = kept.groupBy(*group).agg(F.sum(F.length("content")).alias("_chars"))
    large = saved(amounts.where(F.col("_chars") > WHOLE_GROUP_CHARS).select(*group), f"{folder}/large")  # a table, so that its size is known
    if large.isEmpty():
        return saved(embed_groups(kept, group, embed, size), f"{folder}/index")
    marked = null_safe_join(kept, large.withColumn("_large", F.lit(True)), group, "left")
    whole = embed_groups(marked.where("_large is null").drop("_large"), group, embed, size)
    parted = embed_chunks(marked.where("_large").drop("_large"), group, embed, size, folder)
    return saved(whole.unionByName(parted), f"{folder}/index")


def fetched_files(pr_files: DataFrame) -> DataFrame:
    """Changed files whose content was fetched: of a reviewed extension, and not empty."""
    return pr_files.where(text.is_reviewed_path(F.col("filename")) & text.is_filled(F.col("content")))


def index_runs(pr_files: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each pull request with an index: the files that were fetched for it, also those that are not indexed, and its chunks."""
    made = chunks.groupBy("repo", "pr").agg(F.count("*").alias("chunks_created"))
    files = fetched_files(pr_files).groupBy("repo", "pr").agg(F.count("*").alias("files_indexed"))
    return null_safe_join(made, files, ["repo", "pr"])


def index_repositories(files: DataFrame, embed: Embed, folder: str, size: int = fixed.EMBEDDING_SIZE) -> DataFrame:
    """Index of whole repositories, keyed by repo. Files have `file_ord`, their order in the repository."""
    return embed_files(files, ["repo"], embed, size, folder, skip_blank=True)


def index_pull_requests(pr_files: DataFrame, embed: Embed, folder: str, size: int = fixed.EMBEDDING_SIZE) -> DataFrame:
    """Index of the changed files of pull requests, keyed by (repo, pr). Contents are fetched for files of the
    reviewed extensions only, so no others are in the index."""
    files = fetched_files(pr_files).withColumn("file_path", F.col("filename"))
    return embed_files(files, ["repo", "pr"], embed, size, folder)
