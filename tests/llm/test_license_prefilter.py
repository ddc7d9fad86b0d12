"""Every known sentence gets past the prefilter."""

import re

from patchlake.llm import license_scans


def test_known_sentences_pass_the_prefilter():
    for s in license_scans.known_sentences():
        for written in (s, s.upper(), s.replace(" ", "\n  "), f"({s})", s.replace(" ", "-")):
            assert re.search(license_scans.LIKELY, written), written


def test_references_without_the_word_license(spark):
    cases = {
        "Released under MIT.": ["MIT"], "Available under CC BY 4.0.": ["CC-BY-4.0"], "Distributed under GPL v3 or later.": ["GPL-3.0-or-later"], "x. This software is published under Apache 2.0. y": ["Apache-2.0"],
        "Provided under\nMPL 2.0": ["MPL-2.0"], "This is free and unencumbered software released into the public\ndomain.": ["Unlicense"], "She sat under the tree. Under it.": [],
    }
    got = license_scans.scanned(spark.createDataFrame([(t,) for t in cases], "text string"), "text").collect()
    assert {r.text: list(r.licenses) for r in got} == cases
