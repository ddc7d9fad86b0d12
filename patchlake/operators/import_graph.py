"""The import graph of repositories: which file imports which, and what a change reaches.

An import names a module, and a file is known by every end of its dotted path (see imports.module_names). An absolute import goes to the
file that is known by the longest beginning of its name; of several, to the one with the fewest folders in front of that
name, then to the smallest path. A relative import is counted from the folder of its own file and has to fit a file's whole path.
Imports that reach no file of the repository, and files that import themselves, make no edge. Null repositories are one like others.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions.frames import exploded, null_safe_join, saved
from patchlake.operators.imports import import_rows, module_names


def _dotted(path: Column) -> Column:
    """The whole dotted path of a Python file; a package's is that of its folder."""
    dotted = F.replace(F.translate(path, "/\\", ".."), F.lit(".py"), F.lit(""))
    return F.regexp_replace(dotted, r"\.__init__\z", "")


def _beginnings(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def module_targets(files: DataFrame, repo: list[str], path: str = "file_path") -> DataFrame:
    """(repo, module, target): the file that a name means in each repository. Whole paths stand under a name with "/" in front."""
    file = F.col(path)
    whole = F.when(file.endswith(".py"), F.array(F.struct(F.concat(F.lit("/"), _dotted(file)).alias("module"), F.lit(0).alias("dropped"))))
    size = F.size(F.split(_dotted(file), r"\.", -1))
    ends = F.transform(module_names(file), lambda m: F.struct(m.alias("module"), (size - F.size(F.split(m, r"\.", -1))).alias("dropped")))
    named = exploded(files, [*repo, file.alias("_path")], F.concat(ends, F.coalesce(whole, F.array().cast("array<struct<module:string,dropped:int>>"))))
    best = F.min(F.struct("dropped", "_path")).alias("_best")
    return named.groupBy(*repo, "module").agg(best).select(*repo, "module", F.col("_best._path").alias("target"))


def _asked_name(raw: Column, path: Column) -> Column:
    """The name that an import asks for. A relative one is "/" and the whole path that it means: one dot is the folder
    of the importing file, each more the folder above."""
    dots = F.length(F.regexp_extract(raw, r"\A(\.+)", 1))
    folders = F.split(F.translate(path, "\\", "/"), "/", -1)
    above = F.slice(folders, 1, F.greatest(F.size(folders) - dots, F.lit(0)))
    rest = F.regexp_replace(raw, r"\A\.+", "")
    parts = F.concat(above, F.when(rest != "", F.split(rest, r"\.", -1)).otherwise(F.array().cast("array<string>")))
    return F.when(dots > 0, F.concat(F.lit("/"), F.array_join(parts, "."))).otherwise(raw)


def import_edges(files: DataFrame, repo: list[str], path: str = "file_path", folder: str | None = None) -> DataFrame:
    """Distinct edges (repo, source, target, raw_import) of files with their path, `content` and `language`.

    Each distinct name of a repository is looked up once, however many files ask for it; only names that a file answers
    to are joined back, so "os" and the like never meet in one task. The imports are read twice; with a `folder` they are saved
    below it, so that the contents are searched once."""
    found = import_rows(files, [*repo, F.col(path).alias("source")]).select(*repo, "source", "raw_import")
    asked = found.withColumn("name", _asked_name(F.col("raw_import"), F.col("source")))
    asked = asked if folder is None else saved(asked, f"{folder}/asked")
    names = asked.select(*repo, "name").distinct()
    is_whole = F.startswith("name", F.lit("/"))
    tries = F.when(is_whole, F.array("name")).otherwise(_beginnings(F.col("name")))
    tried = exploded(names, [*repo, "name"], tries, "tries", "module")
    hits = null_safe_join(tried, module_targets(files, repo, path), [*repo, "module"])
    resolved = hits.groupBy(*repo, "name").agg(F.max_by("target", "tries").alias("target"))
    edges = null_safe_join(asked, resolved, [*repo, "name"]).where("source <> target")
    return edges.select(*repo, "source", "target", "raw_import").distinct()


def importers(edges: DataFrame, repo: list[str]) -> DataFrame:
    """The reverse graph: (repo, target, source, imports), with the number of imports by which source reaches target."""
    return edges.groupBy(*repo, "target", "source").agg(F.count("*").alias("imports"))


def import_degrees(edges: DataFrame, repo: list[str]) -> DataFrame:
    """For each file of an edge: how many files it imports, and how many import it."""
    pairs = edges.select(*repo, "source", "target").distinct()
    ends = F.array(F.struct(F.col("source").alias("file_path"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("target").alias("file_path"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return pairs.select(*repo, F.inline(ends)).groupBy(*repo, "file_path").agg(F.sum("out").alias("imported"), F.sum("in").alias("imported_by"))


def affected_files(edges: DataFrame, changed: DataFrame, repo: list[str], folder: str) -> DataFrame:
    """(repo, file_path, steps): the changed files (repo, file_path), with 0 steps, and all files that import one of them over
    any number of steps, with the smallest number.

    Each round joins the files that the last one has found with the reverse edges, and leaves out those already found, so cycles end. Rounds
    are saved below `folder`: a lost executor costs one round. There are as many rounds as the longest of the shortest ways."""
    key = [*repo, "file_path"]
    reverse = saved(edges.select(*repo, F.col("target").alias("file_path"), "source").distinct(), f"{folder}/reverse")
    seen = saved(changed.select(*key).distinct().withColumn("steps", F.lit(0)), f"{folder}/0")
    frontier, step = seen, 0
    while not frontier.isEmpty():
        step += 1
        reached = null_safe_join(reverse, frontier.select(*key), key).select(*repo, F.col("source").alias("file_path")).distinct()
        before = seen.select(*[F.col(c).alias(f"_{c}") for c in key])
        known = [reached[c].eqNullSafe(before[f"_{c}"]) for c in key]
        both = known[0]
        for one in known[1:]:
            both = both & one
        frontier = saved(reached.join(before, both, "left_anti").withColumn("steps", F.lit(step)), f"{folder}/{step}")
        seen = seen.unionByName(frontier)
    return seen
