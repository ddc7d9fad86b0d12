"""Detectors for secrets, personal data and prompt injection.

A detector reports presence only, so a text has at most one issue per detector.
All detectors run in one projection over one scan.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions.frames import exploded

KINDS = ("secret", "pii", "prompt_injection")

# Text without this literal cannot match, and a plain search for it is cheap. The literals have no case.
_NEEDED = {"github_token": "_", "private_key": "-----", "slack_token": "-", "email": "@", "ssn": "-"}

# Ignore case, let a dot stop at newline only, use Unicode classes.
_FLAGS = "(?idU)"


def issues(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Array of the issues found in a text, in report order."""
    found = []
    for order, (kind, name, severity, pattern) in enumerate(fixed.DETECTORS):
        if kind not in kinds:
            continue
        issue = F.struct(
            F.lit(order).alias("ord"),
            F.lit(f"{kind}_{name}").alias("type"),
            F.lit(severity).alias("severity"),
            F.lit(fixed.DETAILS_PREFIX[kind] + name.replace("_", " ")).alias("details"),
        )
        matches = text.rlike(_FLAGS + pattern)
        if name in _NEEDED:
            matches = text.contains(_NEEDED[name]) & matches
        found.append(F.when(matches, issue))
    return F.array_compact(F.array(*found))


def issue_rows(df: DataFrame, text: str, keys: list[str], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per issue, with the key columns of the scanned row."""
    return exploded(df.where(F.col(text).isNotNull()), keys, issues(F.col(text), kinds))


def count_issues(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*(keys or ("type", "severity"))).agg(F.count("*").alias("n"))
