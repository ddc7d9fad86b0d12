"""Code files from a folder tree."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import partitioned, saved

#: Bytes of contents that a task hands on at once.
BATCH_BYTES = 16_000_000


def read_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """Indexable files below `root`: repo, file_path (relative to root) and decoded content.

    Paths are filtered on the file listing, before any content is decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    at = F.instr("path", base) + len(base)
    found = files.select(F.lit(repo).alias("repo"), F.substring("path", at, F.length("path")).alias("file_path"), "content")
    return decode_files(found.where(text.is_indexed_path(F.col("file_path"))))


def decode_files(files: DataFrame) -> DataFrame:
    return files.withColumn("content", text.decode(F.col("content")))


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def list_tree(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """(file_path, size) of all files below `root`, relative to it, without going into skipped folders.

    Folders are listed by tasks, one level of the tree after the other, and what a level holds is saved below `folder`: a large tree is not
    walked by the driver, and a skipped folder costs its name and no more. The root is a path or address that pyarrow opens on every host.
    """

    def listed(batches) -> Iterator[pa.RecordBatch]:
        files, base = _opened(root)
        base = base.rstrip("/")
        for batch in batches:
            for path in batch["file_path"].to_pylist():
                found = files.get_file_info(pafs.FileSelector(f"{base}/{path}" if path else base))
                is_folder = [x.type == pafs.FileType.Directory for x in found]
                kept = [(x.path[len(base) + 1 :], d, 0 if d else x.size) for x, d in zip(found, is_folder) if not (d and x.base_name in fixed.SKIPPED_DIRS)]
                columns = [pa.array([x[k] for x in kept], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["file_path", "is_folder", "size"])

    schema = "file_path string, is_folder boolean, size long"
    level, levels, folders = 0, [], spark.createDataFrame([("",)], "file_path string")
    while not folders.isEmpty():
        levels.append(saved(partitioned(folders, "file_path").mapInArrow(listed, schema), f"{folder}/level-{level}"))
        folders = levels[-1].where("is_folder").select("file_path")
        level += 1
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found.where("not is_folder").select("file_path", "size")


def read_pruned_tree(spark: SparkSession, root: str, repo: str, folder: str) -> DataFrame:
    """What read_tree gives: repo, file_path and decoded content of the indexable files. Only those are opened, and skipped folders
    are not listed. A file is read by one task; small ones share a batch of rows."""

    def read(batches) -> Iterator[pa.RecordBatch]:
        files, base = _opened(root)
        paths, contents, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["file_path", "content"])

        for batch in batches:
            for path in batch["file_path"].to_pylist():
                with files.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                    contents.append(stream.read())
                paths.append(path)
                size += len(contents[-1])
                if size > BATCH_BYTES:
                    yield out()
                    paths, contents, size = [], [], 0
        yield out()

    wanted = list_tree(spark, root, folder).where(text.is_indexed_path(F.col("file_path"))).select("file_path")
    made = partitioned(wanted, "file_path").mapInArrow(read, "file_path string, content binary")
    return decode_files(made.select(F.lit(repo).alias("repo"), "file_path", "content"))
