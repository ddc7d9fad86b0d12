"""Column expressions on text and paths. Lengths and cuts count code points."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlake import fixed

# White space as Python's str.strip sees it: Unicode spaces and the four separators.
_SPACE = r"[\s\x1c-\x1f]"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def is_filled(text: Column) -> Column:
    """True for text that is there and not empty."""
    return F.coalesce(text != "", F.lit(False))


def tokens(text: Column) -> Column:
    """Estimated tokens: four characters each, rounded down."""
    return F.floor(F.length(text) / fixed.CHARS_PER_TOKEN)


def truncate(text: Column, max_tokens: int = fixed.TEXT_TOKENS) -> Column:
    return F.substring(text, 1, max_tokens * fixed.CHARS_PER_TOKEN)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Extension without its dot; leading dots of a file name start no extension."""
    dotted = F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)\z", 1)
    return F.regexp_replace(dotted, r"\A\.", "")


def language(ext: Column) -> Column:
    key = F.lower(F.regexp_replace(ext, r"\A\.+", ""))
    table = F.create_map(*[F.lit(part) for pair in fixed.LANGUAGES.items() for part in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit("unknown"))


def is_skipped_path(path: Column) -> Column:
    dirs = F.array(*[F.lit(name) for name in fixed.SKIPPED_DIRS])
    return F.arrays_overlap(F.split(path, "/", -1), dirs) | basename(path).isin(fixed.SKIPPED_FILES)


def is_indexed_path(path: Column) -> Column:
    return ~is_skipped_path(path) & F.lower(extension(path)).isin(fixed.INDEXED_EXTENSIONS)


def is_reviewed_path(path: Column, extensions: list[str] = fixed.REVIEWED_EXTENSIONS) -> Column:
    return extension(path).isin(extensions)


def decode(raw: Column) -> Column:
    """Bytes to text: UTF-8, else Latin-1; every line end becomes a newline."""
    as_utf8 = raw.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")
