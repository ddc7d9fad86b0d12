"""Flat files of token ids with 64-bit document offsets, written in order of an id and read by memory mapping.

Each partition of the sorted documents writes its own files. Where a document starts among all documents is its
place in the partition plus the partition's base, a prefix sum over the partitions' token counts: the driver sees
one row per partition. Files are written under another name and then put in place, so that a task that is run
again, or twice at once, does no harm.
"""

import os
import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm.encoding import encoder
from patchlake.llm.shared import shared_folder, text_or_empty

DOCUMENT = np.dtype([("id", "<i8"), ("is_null", "u1")])


def mounted(folder: str) -> str:
    """The folder as a path. Memory mapping needs one that is mounted wherever tasks run."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files need a shared folder that is mounted on every host, not {folder}")
    return unquote(parts.path)


def _put(path: str, data: bytes) -> None:
    with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(data)
    os.replace(part, path)


def write_token_files(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str | None = None) -> list[tuple]:
    """Write the ids of every text, with `end_id` after each, in ascending order of `key`; give the manifest:
    (path without ending, documents, tokens, base) for each part, in order.

    `.bin` holds the ids, as 16-bit integers if the vocabulary allows, else as 32-bit ones; `.off` 64-bit starts among all
    documents, with the end of the last one; `.doc` the keys. Null and empty texts have the end id only. Null keys come
    first; rows with equal keys come in order of their text's hash, equal rows in any order. Whatever other columns
    there are is not read. An empty table gives an empty manifest. A text is held whole, a partition is not.
    """
    base = mounted(folder or shared_folder(df.sparkSession)) + f"/tokens-{uuid.uuid4().hex}"
    os.makedirs(base)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def write(batches):
        path = f"{base}/part-{TaskContext.get().partitionId():07d}"
        coder = encoder(tokenizer)
        kind = "<u2" if max(coder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], dtype="<u4").tobytes()
        keys, lengths, own = [], [], f"{path}.bin.{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = out or open(own, "wb")  # noqa: SIM115
            ids = coder.encode(batch["text"].to_pylist())
            np.frombuffer(b"".join(x + end for x in ids), dtype="<u4").astype(kind).tofile(out)
            lengths.append(np.array([len(x) // 4 + 1 for x in ids], dtype="<i8"))
            made = np.zeros(batch.num_rows, dtype=DOCUMENT)
            made["is_null"] = batch["key"].is_null().to_numpy(zero_copy_only=False)
            made["id"] = batch["key"].fill_null(0).to_numpy(zero_copy_only=False)
            keys.append(made)
        if out is None:
            return
        out.close()
        os.replace(own, f"{path}.bin")
        lengths = np.concatenate(lengths)
        _put(f"{path}.doc", np.concatenate(keys).tobytes())
        _put(f"{path}.len", lengths.tobytes())
        yield pa.RecordBatch.from_pydict({"path": [path], "documents": [len(lengths)], "tokens": [int(lengths.sum())]})

    parts = sorted(rows.mapInArrow(write, "path string, documents long, tokens long").collect())
    ends = np.cumsum([0] + [p["tokens"] for p in parts]).tolist()
    manifest = [(p["path"], p["documents"], p["tokens"], start) for p, start in zip(parts, ends)]

    def offsets(batches):
        for batch in batches:
            for part in batch.to_pylist():
                lengths = np.fromfile(part["path"] + ".len", dtype="<i8")
                _put(part["path"] + ".off", (part["base"] + np.concatenate([[0], np.cumsum(lengths)])).astype("<i8").tobytes())
            yield batch

    if manifest:
        _parts(df.sparkSession, manifest).mapInArrow(offsets, MANIFEST).write.format("noop").mode("overwrite").save()
    return manifest


MANIFEST = "path string, documents long, tokens long, base long"


def _parts(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """A row per part, about as many in each task."""
    return spark.createDataFrame(manifest, MANIFEST).repartition(len(manifest), "path")


def read_token_files(spark: SparkSession, manifest: list[tuple], with_ids: bool = False) -> DataFrame:
    """A row per document, read back through memory maps: key, start, n_tokens, ids_crc32 of the ids as
    little-endian 32-bit integers, and the ids themselves on request."""
    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for part in batch.to_pylist():
                starts = np.memmap(part["path"] + ".off", dtype="<i8", mode="r")
                keys = np.memmap(part["path"] + ".doc", dtype=DOCUMENT, mode="r")
                wide = os.path.getsize(part["path"] + ".bin") == 4 * part["tokens"]
                ids = np.memmap(part["path"] + ".bin", dtype="<u4" if wide else "<u2", mode="r")
                for at in range(0, len(keys), 10_000):
                    to = min(at + 10_000, len(keys))
                    own = [ids[starts[k] - part["base"] : starts[k + 1] - part["base"]].astype("<u4") for k in range(at, to)]
                    data = [
                        pa.array(keys["id"][at:to], mask=keys["is_null"][at:to].astype(bool)),
                        pa.array(starts[at:to]), pa.array(np.diff(starts[at : to + 1])), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    ]
                    data += [pa.array([x.astype("<i4") for x in own], pa.list_(pa.int32()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays(data, names=names)

    return _parts(spark, manifest).mapInArrow(read, schema)
