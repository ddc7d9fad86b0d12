"""Tags: "key:value" strings on points, key and value structs on stored rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def compose(**values: Column) -> Column:
    """Ordered array of "key:value" from columns. Booleans are written in lower case."""
    return F.array(*[F.concat(F.lit(f"{key}:"), value.cast("string")) for key, value in values.items()])


def split_pairs(tags: Column) -> Column:
    """Cut every tag at its first colon; a tag without one gets an empty value."""
    return F.transform(
        tags,
        lambda tag: F.when(
            F.contains(tag, F.lit(":")),
            F.struct(
                F.substring_index(tag, ":", 1).alias("key"),
                F.substring(tag, F.instr(tag, ":") + 1, F.length(tag)).alias("value"),
            ),
        ).otherwise(F.struct(tag.alias("key"), F.lit("").alias("value"))),
    )


def has(pairs: Column, key: str, value: str) -> Column:
    return F.exists(pairs, lambda pair: (pair["key"] == key) & (pair["value"] == value))


def value_of(pairs: Column, key: str) -> Column:
    """Value of the first tag with the key, or null."""
    return F.get(F.filter(pairs, lambda pair: pair["key"] == key), F.lit(0))["value"]
