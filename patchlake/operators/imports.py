"""Python imports of code files: extraction, local modules, classification."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions.frames import exploded, null_safe_join


def _suffixes(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )


def module_names(path: Column) -> Column:
    """All names under which the file can be imported; none for other than .py files.

    Slashes turn into dots before every ".py" is dropped, so "src/pyutils.py" is known as "srcutils".
    """
    dotted = F.replace(F.translate(path, "/\\", ".."), F.lit(".py"), F.lit(""))
    package = F.when(
        dotted.endswith(".__init__"), _suffixes(F.replace(dotted, F.lit(".__init__"), F.lit("")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(path.endswith(".py"), F.array_union(_suffixes(dotted), package)).otherwise(
        F.array().cast("array<string>")
    )


def local_modules(files: DataFrame, repo: list[str], path: str = "file_path") -> DataFrame:
    """Distinct importable names per repository."""
    return exploded(files, repo, module_names(F.col(path)), "module").distinct()


def raw_imports(content: Column, language: Column) -> Column:
    """Imported paths in the order of the patterns, each once; empty for other languages."""
    found = [F.regexp_extract_all(content, F.lit("(?dmU)" + pattern), F.lit(1)) for pattern in fixed.IMPORTS]
    return F.when(language == "python", F.array_distinct(F.concat(*found))).otherwise(
        F.array().cast("array<string>")
    )


def import_rows(files: DataFrame, keys: list[str], found: Column | None = None) -> DataFrame:
    """One row per import of `content`, with what the text alone tells. With `found`, a column of raw_imports made before, no
    content is read."""
    found = raw_imports(F.col("content"), F.col("language")) if found is None else found
    rows = exploded(files, keys, found, "pos", "raw_import")
    rows = rows.withColumn("full_path", F.regexp_replace("raw_import", r"\A\.+", ""))
    return rows.withColumns({
        "module_name": F.substring_index("full_path", ".", 1),
        "is_relative": F.col("raw_import").startswith("."),
    })


def classify(imports: DataFrame, modules: DataFrame, repo: list[str]) -> DataFrame:
    """Add `import_type`: local, stdlib or third_party.

    `modules` has one row per (repo, module), null being a repository like others. Most rows, and all common ones, are decided by
    their text; they go through the joins under names that no module has, so that "os" is no hot key. `imports` is read once.
    """
    by_text = (
        F.when(F.col("is_relative"), "local")
        .when(F.col("module_name").isin(fixed.STDLIB), "stdlib")
        .when(F.lower("module_name").isin(fixed.KNOWN_PACKAGES), "third_party")
    )
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*imports.columns), F.lit(1024)).cast("string"))
    found = imports.withColumn("_by_text", by_text)
    for name in ("raw_import", "module_name"):
        known = modules.select(*repo, F.col("module").alias("_name"), F.lit("local").alias(f"_{name}"))
        found = null_safe_join(found.withColumn("_name", F.when(F.col("_by_text").isNull(), F.col(name)).otherwise(spread)), known, [*repo, "_name"], "left").drop("_name")
    kind = F.coalesce("_by_text", "_raw_import", "_module_name", F.lit("third_party"))
    return found.select(*imports.columns, kind.alias("import_type"))


def imports_by_type(imports: DataFrame, keys: list[str]) -> DataFrame:
    """Three ordered lists per file. A file is one row of text, which bounds its lists."""

    def ordered(kind: str) -> Column:
        picked = F.collect_list(F.when(F.col("import_type") == kind, F.struct("pos", "raw_import", "module_name")))
        return F.array_sort(picked).alias(kind)

    return imports.groupBy(*keys).agg(ordered("local"), ordered("stdlib"), ordered("third_party"))
