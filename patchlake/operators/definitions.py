"""Definitions of code files, found line by line inside the row."""

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake import fixed
from patchlake.functions import text
from patchlake.functions.frames import computed, exploded, null_safe_join
from patchlake.operators.imports import raw_imports

# A line without one of these cannot match the pattern, so the costly search is left out.
_NEEDED = {
    ("python", "function"): ["def"], ("python", "class"): ["class"], ("python", "async_function"): ["async"],
    ("javascript", "function"): ["function", "("], ("javascript", "class"): ["class"],
    ("typescript", "function"): ["function", "("], ("typescript", "class"): ["class"], ("typescript", "interface"): ["interface"],
    ("java", "method"): ["("], ("java", "class"): ["class"], ("go", "function"): ["func"], ("go", "struct"): ["struct"],
}

_TYPE = "array<struct<line:int,type_ord:int,type:string,name:string>>"


def _name(line: Column, pattern: str, groups: list[int]) -> Column:
    found = [F.regexp_extract(line, "(?U)" + pattern, group) for group in groups]
    return F.coalesce(*[F.nullif(name, F.lit("")) for name in found[:-1]], found[-1])


def _may_match(line: Column, needed: list[str]) -> Column:
    may = line.contains(needed[0])
    for literal in needed[1:]:
        may = may | line.contains(literal)
    return may


def _of_pattern(some: Column, needed: list[str], order: int, kind: str, pattern: str, groups: list[int]) -> Column:
    def found(one: Column) -> Column:
        named = F.struct(
            (one["at"] + 1).alias("line"), F.lit(order).alias("type_ord"), F.lit(kind).alias("type"),
            _name(one["text"], pattern, groups).alias("name"),
        )
        return F.when(_may_match(one["text"], needed), named)

    # The name of a line that does not match is empty; a line that was left out is null.
    return F.filter(F.transform(some, found), lambda d: d["name"] != "")


def _by_language(language: Column, made: Callable[[str, list], Column], none: Column) -> Column:
    chosen = None
    for name, patterns in fixed.DEFINITIONS.items():
        chosen = F.when(language == name, made(name, patterns)) if chosen is None else chosen.when(language == name, made(name, patterns))
    return chosen.otherwise(none)


def _lines_of_use(code_lines: Column, language: Column) -> Column:
    """The lines that any pattern of the language may match, with their place: most lines are looked at once and no more."""

    def kept(name: str, patterns: list) -> Column:
        def one(line: Column, i: Column) -> Column:
            may = [_may_match(line, _NEEDED[name, row[0]]) for row in patterns]
            return F.when(reduce(lambda a, b: a | b, may), F.struct(i.alias("at"), line.alias("text")))

        return F.array_compact(F.transform(code_lines, one))

    return _by_language(language, kept, F.array().cast("array<struct<at:int,text:string>>"))


def definitions(some: Column, language: Column) -> Column:
    """Array of definitions, by type in pattern order and then by line. At most one per type and line."""

    def found(name: str, patterns: list) -> Column:
        return F.concat(*[_of_pattern(some, _NEEDED[name, row[0]], order, *row) for order, row in enumerate(patterns)])

    return _by_language(language, found, F.array().cast(_TYPE))


def with_definitions(files: DataFrame) -> DataFrame:
    """Add `_lines` and `_defs`."""
    files = computed(files, _lines=text.lines(F.col("content")))
    files = computed(files, _some=_lines_of_use(F.col("_lines"), F.col("language")))
    return computed(files, _defs=definitions(F.col("_some"), F.col("language"))).drop("_some")


#: What the patterns' \s and \w stand for, as a Python class: white space, and the categories and other code points of words.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD_KINDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"}
_OTHER_WORDS = "\u200c\u200d\u24b6-\u24e9\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189"


def _any_word() -> str:
    inside = [n for n in range(128, sys.maxunicode + 1) if unicodedata.category(chr(n)) in _WORD_KINDS]
    starts = [n for n, before in zip(inside, [-1, *inside]) if n != before + 1]
    ends = [n for n, after in zip(inside, [*inside[1:], -1]) if after != n + 1]
    return "a-zA-Z0-9_" + _OTHER_WORDS + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


class LineFinder:
    """The same definitions as `with_definitions` gives, by line, for Python work on whole files. A text of ASCII is searched as a whole by
    patterns that begin with a line or a letter, and line by line by the others. Other texts are searched line by line, and classes of all code
    points are built when a line comes that is not of ASCII."""

    def __init__(self) -> None:
        rows = [(language, order, row) for language, patterns in fixed.DEFINITIONS.items() for order, row in enumerate(patterns)]
        self.rows = {language: [(order, _NEEDED[language, row[0]], *row) for name, order, row in rows if name == language] for language in fixed.DEFINITIONS}
        self.ascii = {row[1]: re.compile(row[1], re.ASCII) for _, _, row in rows}
        self.whole = {one: re.compile(re.sub(r"\A\^", r"\n", one).replace("\\s", r"[^\S\n]"), re.ASCII) for one in self.ascii if one[0] == "^" or one[0].isalpha()}  # each has one name, which is not empty
        self.any: dict[str, re.Pattern] = {}

    def _pattern(self, pattern: str, line: str) -> re.Pattern:
        if line.isascii():
            return self.ascii[pattern]
        if not self.any:
            word = _any_word()
            self.any = {one: re.compile(one.replace("\\s", f"[{_SPACE}]").replace("\\w", f"[{word}]")) for one in self.ascii}
        return self.any[pattern]

    def _in_lines(self, content: str, is_ascii: bool, needed: list[str], pattern: str) -> Iterator[tuple[int, re.Match]]:
        """Where a line with a match begins, and its first match. Lines without a literal of the pattern are passed over."""
        search = self.ascii[pattern].search
        for start, end in _lines_with(content, needed):
            if is_ascii:
                match = search(content, start, end)
            else:
                line = content[start:end]
                match = self._pattern(pattern, line).search(line)
            if match:
                yield start, match

    def __call__(self, content: str, language: str | None) -> list[tuple[int, int, str, str, int]]:
        """(line, place of the pattern, type, name, where the line begins), in this order."""
        found, is_ascii = [], content.isascii()
        for order, needed, kind, pattern, groups in self.rows.get(language, ()):
            if not any(literal in content for literal in needed):
                continue
            whole = self.whole.get(pattern) if is_ascii else None
            if whole and pattern[0] == "^":
                found += [(match.start(), order, kind, match[groups[0]]) for match in whole.finditer("\n" + content)]
            elif whole:
                end = -1  # of the line of the last match
                for match in whole.finditer(content):
                    at = match.start()
                    if at > end:
                        end = content.find("\n", at)
                        end = len(content) if end < 0 else end
                        found.append((content.rfind("\n", 0, at) + 1, order, kind, match[groups[0]]))
            else:
                for start, match in self._in_lines(content, is_ascii, needed, pattern):
                    if name := next((match[group] for group in groups if match[group]), ""):
                        found.append((start, order, kind, name))
        found.sort()
        made, line, before = [], 1, 0
        for start, order, kind, name in found:
            line, before = line + content.count("\n", before, start), start
            made.append((line, order, kind, name, start))
        return made


def _lines_with(content: str, literals: list[str]) -> set[tuple[int, int]]:
    """Where the lines that hold one of the literals begin and end."""
    spans = set()
    for literal in literals:
        at = content.find(literal)
        while at >= 0:
            end = content.find("\n", at)
            spans.add((content.rfind("\n", 0, at) + 1, len(content) if end < 0 else end))
            at = -1 if end < 0 else content.find(literal, end)
    return spans


def definition_rows(files: DataFrame, keys: list[str]) -> DataFrame:
    return exploded(with_definitions(files), keys, F.col("_defs"), "pos", "*").drop("type_ord")


def _outline(defs: Column) -> Column:
    """First two definition types with up to three names each."""
    kinds = F.slice(F.array_distinct(F.transform(defs, lambda d: d["type"])), 1, 2)
    return F.transform(
        kinds,
        lambda kind: F.concat(
            kind,
            F.lit(": "),
            F.array_join(F.transform(F.slice(F.filter(defs, lambda d: d["type"] == kind), 1, 3), lambda d: d["name"]), ", "),
        ),
    )


def file_facts(files: DataFrame, keys: list[str]) -> DataFrame:
    """What a file's text tells of it, in one pass: its imports (imports.raw_imports) and its outline."""
    found = raw_imports(F.col("content"), F.col("language")).alias("imports")
    return with_definitions(files).select(*keys, found, _outline(F.col("_defs")).alias("outline"))


def file_summaries(facts: DataFrame, by_type: DataFrame, keys: list[str]) -> DataFrame:
    """One line per file: local and standard modules, then definitions, from file_facts. `by_type` is imports_by_type."""
    outlined = facts.select(*keys, F.col("outline").alias("_outline"))
    joined = null_safe_join(outlined, by_type.select(*keys, "local", "stdlib"), keys, "left")

    def modules(label: str, column: str) -> Column:
        names = F.array_join(F.transform(F.slice(column, 1, 3), lambda i: i["module_name"]), ", ")
        return F.when(F.size(column) > 0, F.concat(F.lit(label), names))

    # concat_ws leaves out nulls.
    summary = F.concat_ws("; ", modules("Local: ", "local"), modules("Stdlib: ", "stdlib"), F.col("_outline"))
    return joined.select(*keys, F.when(summary == "", "No structure detected").otherwise(summary).alias("summary"))
