"""License scans: sentences are known by name, and licences by the sequence of the names.

Each sentence is normalised and looked up in a table of known licence sentences; the identifiers found in a text,
in order, are matched against an ordered list of rules. All of it stays in one row and in Spark's own functions.
"""

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of known sentences; the SQL looks at texts with one of them only. References such as "under mit" have none.
KEYWORDS = "licen|copyright|warrant|permission|redistribution|public domain|liable|endorse"
#: Texts that this does not find in hold no known sentence and are not cut up. Every known sentence has it, in any writing.
LIKELY = "(?i)" + KEYWORDS.replace(" ", "[^a-z0-9.]+") + "|(?<![a-z0-9.])under(?![a-z0-9.])"

# The wording of published licences, normalised.
_SENTENCES = {
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl.warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.details": "see the gnu general public license for more details",
    "unlicense.grant": "this is free and unencumbered software released into the public domain",
}
_GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
_CC = {"by": "attribution", "by nc": "attribution noncommercial", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
# What comes before a licence's name in a reference to it; all such beginnings count as the one word "under".
_LEAD = (
    "^(this (work|software|file|project|document|program|code|text) is )?(licen[sc]ed|released|distributed|available|published|provided|made available) "
    "under (the terms of )?(the |a |an )?"
)


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier. References to licences by name come in several wordings, made by rule."""
    named: dict[str, list[str]] = {"mit.ref": ["mit license", "mit licence", "mit"], "isc.ref": ["isc license"], "unlicense.ref": ["unlicense"]}
    for v in ("2.0",):
        named[f"apache.ref {v}"] = ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0"]
    for n in ("2", "3"):
        named[f"bsd{n}.ref"] = [f"bsd {n} clause license", f"{n} clause bsd license"]
    for v in ("1.1", "2.0"):
        named[f"mpl.ref {v}"] = [f"mozilla public license version {v}", f"mozilla public license {v}", f"mpl {v}"]
    for short, long in _GNU.items():
        for v in ("1", "2", "2.1", "3"):
            later = f"{short}.ref {v}+"
            named[f"{short}.ref {v}"] = [f"{long} version {v}", f"{long} v{v}", f"{short} {v}", f"{short}v{v}", f"{short} v{v}", f"{short} version {v}"]
            named[later] = [f"{x} or later" for x in named[f"{short}.ref {v}"]] + [f"{x} or any later version" for x in named[f"{short}.ref {v}"]]
    for short, long in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            tag = short.replace(" ", "-")
            named[f"cc.ref {tag} {v}"] = [f"cc {short} {v}", f"creative commons {long} {v}", f"creative commons {long} {v} international", f"creative commons {long} {v} international license"]
    found = {text: name for name, text in _SENTENCES.items()}
    for name, titles in named.items():
        for title in titles:
            found[f"under {title}"] = found[f"under {title} the license"] = name
            if "licen" in title:
                found[title] = found[f"the {title}"] = name
    return found


def licence_rules() -> list[tuple[str, str]]:
    """(sequence of identifiers, licence), in the order in which they are tried; long sequences come before
    the single sentences that they hold."""
    rules = [
        ("bsd.grant bsd.source bsd.binary bsd.endorse bsd.warranty", "BSD-3-Clause"), ("bsd.grant bsd.source bsd.binary bsd.endorse", "BSD-3-Clause"),
        ("bsd.grant bsd.source bsd.binary bsd.warranty", "BSD-2-Clause"), ("bsd.grant bsd.source bsd.binary", "BSD-2-Clause"),
        ("mit.ref mit.grant mit.notice asis.warranty mit.liability", "MIT"), ("mit.grant mit.notice asis.warranty mit.liability", "MIT"), ("mit.grant mit.notice", "MIT"), ("mit.grant", "MIT-like"),
        ("isc.ref isc.grant", "ISC"), ("isc.grant", "ISC"), ("unlicense.grant", "Unlicense"),
        ("apache.ref_2.0 apache.comply apache.copy apache.asis apache.see", "Apache-2.0"), ("apache.comply apache.copy apache.asis apache.see", "Apache-2.0"), ("apache.ref_2.0 apache.comply", "Apache-2.0"),
        ("mit.ref", "MIT"), ("isc.ref", "ISC"), ("unlicense.ref", "Unlicense"), ("bsd2.ref", "BSD-2-Clause"), ("bsd3.ref", "BSD-3-Clause"), ("apache.ref_2.0", "Apache-2.0"),
    ]
    full = lambda v: v if "." in v else f"{v}.0"
    for name in sorted(set(known_sentences().values())):
        kind, _, rest = name.partition(".ref ")
        if kind in _GNU:
            licence = f"{kind.upper()}-{full(rest.rstrip('+'))}-{'or-later' if rest.endswith('+') else 'only'}"
            rules += [(f"{_id(name)} gpl.warranty gpl.details", licence), (f"{_id(name)} gpl.warranty", licence), (_id(name), licence)]
        elif kind == "mpl":
            rules.append((_id(name), f"MPL-{rest}"))
        elif kind == "cc":
            tag, _, v = rest.rpartition(" ")
            rules.append((_id(name), f"CC-{tag.upper()}-{v}"))
    return sorted(rules, key=lambda r: -r[0].count(" "))


def _id(name: str) -> str:
    return name.replace(" ", "_")


def normal_form(sentence: Column) -> Column:
    """Lower case; anything but letters, digits and points becomes one space; points at both ends go; the
    words that lead to a licence's name become one."""
    plain = F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9.]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[. ]+$", ""), "^[. ]+", ""), _LEAD, "under ")


def _slot(text: Column, size: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("int") % size


def scanned(df: DataFrame, text: str, out_ids: str = "sentence_ids", out: str = "licenses") -> DataFrame:
    """Add the identifiers of a text's known sentences, in order, and the licences that the rules find in them.

    A sentence ends at `.`, `!`, `?`, `;` or `:` before white space, or at an empty line. Line breaks inside a
    sentence are white space; where the whole is not known, its lines are tried one by one. Sentences that are
    not known are passed over. A rule that fits takes its identifiers away and is tried once. Both arrays are
    empty for null, empty and other texts; each row stands alone, so repeated rows and empty tables need no care.
    """
    known = known_sentences()
    size = 4 * len(known)
    table: list[list[dict]] = [[] for _ in range(size)]
    for sentence, name in known.items():
        table[int(hashlib.md5(sentence.encode()).hexdigest()[:7], 16) % size].append({"s": sentence, "id": _id(name)})
    index = F.from_json(F.lit(json.dumps(table)), "array<array<struct<s:string,id:string>>>")
    rules = F.from_json(F.lit(json.dumps([{"seq": f" {seq} ", "licence": licence} for seq, licence in licence_rules()])), "array<struct<seq:string,licence:string>>")

    def identify(pieces: Column) -> Column:
        hits = F.transform(F.transform(pieces, normal_form), lambda s: F.get(F.filter(F.element_at(index, _slot(s, size) + 1), lambda e: e["s"] == s), 0)["id"])
        return hits

    def in_sentence(sentence: Column) -> Column:
        whole = identify(F.array(sentence))
        lines = F.filter(identify(F.split(sentence, "\n")), lambda x: x.isNotNull())
        return F.transform(F.array(whole), lambda w: F.when(w[0].isNotNull(), w).when(sentence.contains("\n"), lines).otherwise(F.array().cast("array<string>")))[0]

    body = F.col(f"`{text}`").cast("string")
    ends = F.regexp_replace(F.regexp_replace(body, r"([.!?;:])[ \t\n\r\f\x0B]+", "$1\n\n"), r"\n[ \t\r]*\n", "\x00")
    likely = F.filter(F.split(ends, "\x00"), lambda s: F.rlike(s, F.lit(LIKELY)))
    ids = F.when(F.rlike(body, F.lit(LIKELY)), F.flatten(F.transform(likely, in_sentence)))
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    begin = F.struct(F.lit("").alias("seq"), F.array().cast("array<string>").alias("found"))

    def licences(ids: Column) -> Column:
        start = begin.withField("seq", F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")))

        def step(state: Column, rule: Column) -> Column:
            wide = F.replace(rule["seq"], F.lit(" "), F.lit("  "))
            wide = F.substring(wide, F.lit(2), F.length(wide) - 2)
            hit = F.struct(F.replace(state["seq"], wide, F.lit(" | ")).alias("seq"), F.array_append(state["found"], rule["licence"]).alias("found"))
            return F.when(F.instr(state["seq"], wide) > 0, hit).otherwise(state)

        return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(rules, start, step)["found"])).otherwise(F.array().cast("array<string>"))

    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out_ids, out)]
    made = F.transform(F.array(ids), lambda i: F.struct(i.alias(out_ids), licences(i).alias(out)))
    return df.select(*kept, F.inline(made))
