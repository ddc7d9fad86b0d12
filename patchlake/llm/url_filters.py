"""URL filters: rules are found by one rare token, and only rules so found run their regular expressions.

A rule is indexed under the rarest of its literal tokens. A url is cut into tokens, each token fetches the rules
kept under it from a hash table, and only these are tried. All of it is one expression per row: no shuffle, no
Python, and the time of a row follows its tokens, not the number of rules.
"""

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTRY = "array<array<struct<token:string,rule:string,verdict:string,weight:int,regex:string>>>"


@dataclass(frozen=True)
class Rule:
    """`text` is what is reported. A host rule (host and start of a path) goes before every pattern; among host
    rules the longest wins. A pattern is matched anywhere in host and path: `*` stands for any characters,
    `^` for one that is no letter, digit, `_`, `-` or `.`, or for the end; `||` at its start for the start of
    the host or of one of its labels. Patterns are not reported as a rule, they only make the verdict."""

    text: str
    verdict: str
    pattern: bool = False

    @property
    def weight(self) -> int:
        return len(self.text) + (0 if self.pattern else 1_000_000)

    @property
    def regex(self) -> str:
        if not self.pattern:
            return r"\A(?:[^/]*\.)?" + re.escape(self.text)
        body = self.text.removeprefix("||")
        made = "".join({"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.-]|\z)"}.get(c, re.escape(c)) for c in body)
        return (r"\A(?:[^/]*\.)?" if self.text.startswith("||") else "") + made

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand whole in every url that the rule fits: those with a border on both sides."""
        text = self.text.translate(str.maketrans(UPPER, LOWER))
        text = text[2:] if text.startswith("||") else text if self.pattern else "/" + text
        open_start = self.pattern and not self.text.startswith("||")
        found = []
        for m in re.finditer(r"[a-z0-9]+", text):
            before = text[m.start() - 1] if m.start() else ("*" if open_start else "/")
            after = text[m.end()] if m.end() < len(text) else "*"
            if before != "*" and after != "*":
                found.append(m[0])
        return found


#: The rules of the contract, then patterns of unwanted hosts and paths for all other urls.
DEFAULT_RULES = [
    Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"), Rule("net/fr/", "block"),
    Rule("||casino-*^", "block", True), Rule("||cheap-pills.", "block", True), Rule("||free-bets.", "block", True),
    Rule("||adult-*^", "block", True), Rule("||spam-farm.", "block", True), Rule("||ads-track.", "block", True),
    Rule("/adserver/", "block", True), Rule("/doorway/", "block", True),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path. Both are empty for a null url or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"\A[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"\A[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_index(rules: list[Rule], counts: dict[str, int] | None = None) -> list[list[dict]]:
    """A hash table over the rules. Each stands under its rarest token: by `counts`, how often urls hold a
    token (see `token_counts`), else by how many rules do; longer ones first among equals. Rules without a
    whole token stand under the empty one, which every url asks for."""
    seen = counts if counts is not None else Counter(t for rule in rules for t in set(rule.tokens))
    size = max(1, 2 * len(rules))
    table: list[list[dict]] = [[] for _ in range(size)]
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (seen.get(t, 0), -len(t), t), default="")
        entry = {"token": token, "rule": None if rule.pattern else rule.text, "verdict": rule.verdict, "weight": rule.weight, "regex": rule.regex}
        table[_slot(token, size)].append(entry)
    return table


def _slot(token: str, size: int) -> int:
    """The same as `_slot_column`: letters read as a number in base 31, of at most 12 letters."""
    value = 0
    for c in token[:12]:
        value = (value * 31 + ord(c)) % 1_000_003
    return value % size


def _slot_column(token: Column, size: int) -> Column:
    letters = F.split(F.substring(token, 1, 12), "")
    value = F.aggregate(letters, F.lit(0).cast("int"), lambda v, c: ((v * 31 + F.ascii(c)) % 1_000_003).cast("int"))
    return (value % size).cast("int")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct runs of letters and digits, in lower case, and the empty token."""
    text = F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1))))


def token_counts(df: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """How many urls hold each token of the rules: one row per such token comes back, whatever the input."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    host, path = host_and_path(F.col(url))
    tokens = df.select(F.explode(F.array_intersect(url_tokens(host, path), F.lit(wanted))).alias("token"))
    return {row["token"]: row["n"] for row in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def judged(df: DataFrame, url: str, rules: list[Rule] | None = None, counts: dict[str, int] | None = None, default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict, which replace columns of these names; all others stay.

    Null, empty and broken urls have an empty host and path, so no host rule fits and the verdict is the
    default, unless a pattern fits the empty string. Rows are judged one by one: repeated rows get the same
    answer, an empty table gives an empty table. Rules of the same weight: the smaller text wins.
    """
    rules = DEFAULT_RULES if rules is None else rules
    table = rule_index(rules, counts)
    host, path = host_and_path(F.col(url))
    index = F.from_json(F.lit(json.dumps(table)), _ENTRY)

    def best(parts: Column) -> Column:
        # element_at of the folded table: one look per token
        fetched = F.flatten(F.transform(parts["tokens"], lambda t: F.filter(F.element_at(index, _slot_column(t, len(table)) + 1), lambda e: e["token"] == t)))
        subject = F.concat(parts["host"], parts["path"])
        fitting = F.filter(fetched, lambda e: F.rlike(subject, e["regex"]))
        order = F.transform(fitting, lambda e: F.struct((-e["weight"]).alias("w"), e["rule"].alias("rule"), e["verdict"].alias("verdict")))
        return F.array_min(order)

    parts = F.struct(host.alias("host"), path.alias("path"), url_tokens(host, path).alias("tokens"))
    # a list of one element, so that the parts are worked out once
    made = F.transform(F.array(parts), lambda p: F.struct(p["host"].alias("host"), p["path"].alias("path"), best(p).alias("_url_best")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rows = df.select(*kept, F.inline(made))
    return rows.select(*kept, "host", "path", F.col("_url_best.rule").alias("rule"), F.coalesce(F.col("_url_best.verdict"), F.lit(default)).alias("verdict"))
