"""Licence rules on whole licences, notices and near misses."""

import re
import time

import pytest

from spindle.llm.licenses import RULES, SENTENCES, _automaton, licenses, scan_licenses, sentences
from spindle.llm.queries import LLM_QUERIES

A = _automaton()


def names(text):
    return [n for _, n in licenses(sentences(text, A))]


@pytest.mark.parametrize("name,wanted", RULES)
def test_every_rule(name, wanted):
    assert names("Some words. " + "\n filler text, ".join(SENTENCES[w][0].replace(" ", "\n  ", 3) for w in wanted) + ".")[0] == name


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []), ("a license to kill, warranty void", []), ("trash Released under the MIT Licence. Yes", ["MIT"]), ("Released under the\n * MIT   License", ["MIT"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under the Apache License, Version 2.0.\nAll rights reserved.", ["Apache-2.0", "all-rights-reserved"]),
        ("Licensed under the Apache License, Version 2.01", []), ("unreleased under the MIT License", []), ("licensed under the GNU General Public License, version 2. Released under the MIT License. Released under the MIT License.", ["GPL-2.0-only", "MIT", "MIT"]),
        (SENTENCES["mit-grant"][0] + " x" * 70 + " " + SENTENCES["mit-notice"][0], []), (SENTENCES["mit-notice"][0] + ". " + SENTENCES["mit-grant"][0], []),
    ],
)
def test_texts(text, want):
    assert names(text) == want


def test_rows(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License", "x"), (1, "Released under the MIT License", "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, licenses string")
    got = sorted(((r.doc_id, r.licenses) for r in scan_licenses(d).collect()), key=repr)
    assert got == sorted([(1, ["MIT"]), (1, ["MIT"]), (None, []), (2, [])], key=repr)
    assert scan_licenses(d.limit(0)).collect() == []


@pytest.mark.parametrize("between", ["\n", "  ", "\n * ", "\r\n# ", "\u00a0", "_", ". "])
def test_broken_lines(spark, between):
    """Every form of every sentence, alone in its text and broken at every space, through the operator."""
    forms = [(name, f.replace(" ", between)) for name, all_forms in SENTENCES.items() for f in all_forms]
    rows = [(i, f"Copyright 2020 x{between}{f}") for i, (_, f) in enumerate(forms)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone = {wanted[0]: name for name, wanted in reversed(RULES) if len(wanted) == 1}
    for i, (name, _) in enumerate(forms):
        assert got[i].sentences == [name] and got[i].licenses == ([alone[name]] if name in alone else [])


def test_full_texts_and_tags():
    gnu = " Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    assert names("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007" + gnu) == ["LGPL-3.0"]
    assert names("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991" + gnu) == ["GPL-2.0"]
    assert names("// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: CC-BY-SA-3.0") == ["GPL-2.0-or-later", "CC-BY-SA-3.0"]
    assert names("licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License") == ["CC-BY-SA-3.0"]
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"
    assert names(isc.format(".")) == ["0BSD"] and names(isc.format(", provided that the above copyright notice and this permission notice appear in all copies.")) == ["ISC"]


MPL = "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n"
EPL = "{}\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\nPUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE\nPROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.\n\n1. DEFINITIONS\n\n\"Contribution\" means:\n\na) in the case of the initial Contributor, the initial {} under this Agreement"
CC4 = "{0}By exercising the Licensed Rights (defined below), You accept and agree to be bound by the\nterms and conditions of this {1} (\"Public License\"). To the extent this Public License may be interpreted as a contract"
GPL2 = "The licenses for most software are designed to take away your\nfreedom to share and change it. By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users."


@pytest.mark.parametrize(
    "text,want",
    [
        (MPL, ["MPL-2.0"]), (MPL.split("Definitions")[1], ["MPL-2.0"]),
        (EPL.format("Eclipse Public License - v 2.0", "content Distributed"), ["EPL-2.0"]), (EPL.format("", "content Distributed"), ["EPL-2.0"]), (EPL.format("Eclipse Public License - v 1.0", "code and documentation distributed"), ["EPL-1.0"]), (EPL.format("", "code and documentation distributed"), ["EPL-1.0"]),
        *[(CC4.format(title, f"Creative Commons {w} 4.0 International Public License"), [n]) for n, w in (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"), ("CC-BY-SA-4.0", "Attribution-ShareAlike")) for title in ("", f"Creative Commons {w} 4.0 International Public License\n\n")],
        ("Creative Commons Legal Code\n\nAttribution-ShareAlike 3.0 Unported\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM", ["CC-BY-SA-3.0"]), ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n", ["CC0-1.0"]),
        (GPL2, ["GPL-2.0"]), ("The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share", []),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble\n\n" + GPL2, ["GPL-2.0"]),
        ("this agreement is about modifications, an artistic licence and creative commons", []),
    ],
)
def test_bodies(text, want):
    """Licences are told by the sentences of their bodies, with a title or without, and told once."""
    assert names(text) == want


def test_many_notices_are_quick():
    text = "Released under the MIT License. x " * 20_000
    found = sentences(text, A)
    began = time.time()
    assert len(licenses(found)) == 20_000 and time.time() - began < 2
    grants = sentences((SENTENCES["mit-grant"][0] + ". ") * 3000 + SENTENCES["mit-notice"][0], A)
    assert [n for _, n in licenses(grants)] == ["MIT"]


def test_query(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "GPL-3.0-only": "licensed under the GNU General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "all-rights-reserved": "All rights reserved"}
    got = {r.doc_id: r for r in LLM_QUERIES["op7_license_scans"](spark, sf).collect()}
    assert set(got) == set(rows)
    for d, t in rows.items():
        want = [n for _, n in sorted((m.start(), n) for n, s in plain.items() for m in re.finditer(re.escape(s), t))]
        assert got[d].licenses == ",".join(want) and got[d].n_licenses == len(want)
