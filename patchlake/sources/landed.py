"""Responses of the source host that were landed as JSON text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions.frames import exploded

_FILE = "array<struct<filename:string,patch:string,changes:bigint>>"


def changed_files(landed: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per changed file of a landed file list, in list order. A missing patch is null, a missing count 0."""
    listed = exploded(landed, keys, F.from_json(body, _FILE), "file_ord", "f")
    return listed.select(
        *keys, "file_ord", F.coalesce("f.filename", F.lit("")).alias("filename"), "f.patch",
        F.coalesce("f.changes", F.lit(0)).alias("changes"),
    )


def _content_bytes(body: Column) -> Column:
    return F.try_to_binary(F.regexp_replace(F.get_json_object(body, "$.content"), r"\s", ""), F.lit("base64"))


def content_text(body: Column) -> Column:
    """Text of a landed content response; null when there is none, or when it is no base64 or no UTF-8.
    Line breaks in the base64 are passed over."""
    return F.try_validate_utf8(_content_bytes(body).cast("string"))


def content_error(body: Column) -> Column:
    """Name of what is wrong with a content that is there but can't be read, else null."""
    held = F.get_json_object(body, "$.content").isNotNull()
    return (
        F.when(held & _content_bytes(body).isNull(), "binascii.Error")
        .when(held & content_text(body).isNull(), "UnicodeDecodeError")
    )


def file_contents(landed: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per landed content: filename, content, and error_type, as the error points need it."""
    return landed.select(*keys, "filename", content_text(F.col(body)).alias("content"), content_error(F.col(body)).alias("error_type"))
