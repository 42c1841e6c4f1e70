"""Licence recognition by sentence rules.

A text is normalised: lower case, one spelling of licence, words and version numbers only. Known sentences of licences,
normalised in the same way, are found in it as whole word runs, wherever lines are broken, and become identifiers with
places. Ordered rules then read the sequence of identifiers: a rule names sentences that must follow each other, with
at most ``GAP`` other words between two of them. Rules are tried from the first; sentences that a rule has used are
gone for the rules after it, so the full text of a licence is not also reported as its short notice.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.textscan import batches

GAP = 60

# Sentences of well-known licences, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as-is-software": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',),
    "mit-name": ("Released under the MIT License", "Licensed under the MIT License", "under the terms of the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License"),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    "isc-as-is": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES',),
    "isc-name": ("Licensed under the ISC License", "Released under the ISC License"),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",),
    "bsd-endorse": ("may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-as-is": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"',),
    "bsd3-name": ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "under the 3-clause BSD license"),
    "bsd2-name": ("Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "under the 2-clause BSD license"),
    "apache2-name": ("Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "under the Apache License 2.0", "under the Apache 2.0 license"),
    "apache2-obtain": ("You may obtain a copy of the License at",),
    "apache2-unless": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an",),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "lgpl-free": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl-free": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "version-3-or-later": ("either version 3 of the License, or (at your option) any later version",),
    "version-2-or-later": ("either version 2 of the License, or (at your option) any later version",),
    "version-2.1-or-later": ("either version 2.1 of the License, or (at your option) any later version",),
    "gpl-hope": ("is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "gpl3-name": ("licensed under the GNU General Public License, version 3", "licensed under the GNU GPL version 3", "licensed under the GPL v3", "licensed under GPLv3", "released under the GNU General Public License, version 3"),
    "gpl2-name": ("licensed under the GNU General Public License, version 2", "licensed under the GNU GPL version 2", "licensed under the GPL v2", "licensed under GPLv2", "released under the GNU General Public License, version 2"),
    "agpl3-name": ("licensed under the GNU Affero General Public License, version 3", "licensed under AGPLv3"),
    "lgpl3-name": ("licensed under the GNU Lesser General Public License, version 3", "licensed under LGPLv3"),
    "mpl2-name": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "cc-by-name": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-name": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-name": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd-name": ("Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-name": ("Licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd-name": ("Licensed under CC BY-NC-ND 4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "cc0-name": ("To the extent possible under law, the author has waived all copyright", "Licensed under CC0 1.0", "dedicated to the public domain under CC0"),
    "gpl3-title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "gpl2-title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "lgpl3-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "lgpl21-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "lgpl2-title": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "agpl3-title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "gnu-verbatim": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",),
    "apache2-title": ("Apache License Version 2.0, January 2004",),
    "mpl2-title": ("Mozilla Public License Version 2.0",),
    "mpl11-title": ("MOZILLA PUBLIC LICENSE Version 1.1",),
    "mpl11-notice": ("The contents of this file are subject to the Mozilla Public License Version 1.1",),
    "epl2-title": ("Eclipse Public License - v 2.0", "under the terms of the Eclipse Public License 2.0", "under the terms of the Eclipse Public License v2.0"),
    "epl1-title": ("Eclipse Public License - v 1.0", "under the terms of the Eclipse Public License v1.0"),
    "boost-title": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0"),
    "boost-grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "bsd-advertising": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "artistic2-title": ("The Artistic License 2.0", "under the terms of the Artistic License 2.0", "under the Artistic License 2.0"),
    "artistic1-title": ('The "Artistic License"',),
    "ofl-title": ("SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007", "licensed under the SIL Open Font License, Version 1.1"),
    "psf2-title": ("PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",),
    "wtfpl-title": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "cddl1-title": ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",),
    "isc-condition": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "gpl3-preamble": ("The GNU General Public License is a free, copyleft license for software and other kinds of works",),
    "agpl3-preamble": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works",),
    "gnu-freedom": ("The licenses for most software are designed to take away your freedom to share and change it",),
    "gpl2-contrast": ("By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free",),
    "lgpl3-terms": ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",),
    "lgpl21-first": ("This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1",),
    "apache2-terms": ('"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',),
    "mpl2-contributor": ('"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software',),
    "mpl11-contributor": ('"Contributor" means each entity that creates or contributes to the creation of Modifications',),
    "cddl1-contributor": ('"Contributor" means each individual or entity that creates or contributes to the creation of Modifications',),
    "epl-accept": ('THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT")',),
    "epl2-contribution": ("in the case of the initial Contributor, the initial content Distributed under this Agreement",),
    "epl1-contribution": ("in the case of the initial Contributor, the initial code and documentation distributed under this Agreement",),
    "artistic2-preamble": ("This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",),
    "artistic1-intent": ("The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package",),
    "ofl-goals": ("The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects",),
    "psf2-agreement": ('This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using',),
    "cc0-title": ("Creative Commons Legal Code CC0 1.0 Universal",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "reserved": ("All rights reserved",),
}

# Licences as sequences of sentences, the more specific first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "as-is-software")),
    ("ISC", ("isc-grant", "isc-condition", "isc-as-is")),
    ("0BSD", ("isc-grant", "isc-as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("Apache-2.0", ("apache2-name", "apache2-obtain", "apache2-unless")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("MPL-2.0", ("mpl2-title", "mpl2-contributor")),
    ("MPL-1.1", ("mpl11-title", "mpl11-contributor")),
    ("CDDL-1.0", ("cddl1-title", "cddl1-contributor")),
    ("EPL-2.0", ("epl2-title", "epl-accept", "epl2-contribution")),
    ("EPL-1.0", ("epl1-title", "epl-accept", "epl1-contribution")),
    ("EPL-2.0", ("epl-accept", "epl2-contribution")),
    ("EPL-1.0", ("epl-accept", "epl1-contribution")),
    ("Artistic-2.0", ("artistic2-title", "artistic2-preamble")),
    ("Artistic-1.0", ("artistic1-title", "artistic1-intent")),
    ("OFL-1.1", ("ofl-title", "ofl-goals")),
    ("PSF-2.0", ("psf2-title", "psf2-agreement")),
    ("AGPL-3.0", ("agpl3-title", "gnu-verbatim", "agpl3-preamble")),
    ("LGPL-3.0", ("lgpl3-title", "gnu-verbatim", "lgpl3-terms")),
    ("LGPL-2.1", ("lgpl21-title", "gnu-verbatim", "lgpl21-first")),
    ("GPL-3.0", ("gpl3-title", "gnu-verbatim", "gpl3-preamble")),
    ("GPL-2.0", ("gpl2-title", "gnu-verbatim", "gnu-freedom", "gpl2-contrast")),
    ("AGPL-3.0", ("agpl3-title", "gnu-verbatim")),
    ("LGPL-3.0", ("lgpl3-title", "gnu-verbatim")),
    ("LGPL-2.1", ("lgpl21-title", "gnu-verbatim")),
    ("LGPL-2.0", ("lgpl2-title", "gnu-verbatim")),
    ("GPL-3.0", ("gpl3-title", "gnu-verbatim")),
    ("GPL-2.0", ("gpl2-title", "gnu-verbatim")),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("AGPL-3.0-or-later", ("agpl-free", "version-3-or-later", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl-free", "version-3-or-later", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-free", "version-2.1-or-later", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "version-3-or-later", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free", "version-2-or-later", "gpl-hope")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free", "version-3-or-later")),
    ("GPL-2.0-or-later", ("gpl-free", "version-2-or-later")),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-name",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd3-name",)),
    ("BSD-2-Clause", ("bsd2-name",)),
    ("Apache-2.0", ("apache2-name",)),
    ("AGPL-3.0-only", ("agpl3-name",)),
    ("LGPL-3.0-only", ("lgpl3-name",)),
    ("GPL-3.0-only", ("gpl3-name",)),
    ("GPL-2.0-only", ("gpl2-name",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-name",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-name",)),
    ("CC-BY-4.0", ("cc-by-name",)),
    ("CC0-1.0", ("cc0-name",)),
    ("Unlicense", ("unlicense",)),
    ("Apache-2.0", ("apache2-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-1.1", ("mpl11-notice",)),
    ("MPL-1.1", ("mpl11-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("Artistic-1.0", ("artistic1-title",)),
    ("OFL-1.1", ("ofl-title",)),
    ("PSF-2.0", ("psf2-title",)),
    ("WTFPL", ("wtfpl-title",)),
    ("CDDL-1.0", ("cddl1-title",)),
    ("AGPL-3.0", ("agpl3-preamble",)),
    ("LGPL-3.0", ("lgpl3-terms",)),
    ("LGPL-2.1", ("lgpl21-first",)),
    ("GPL-3.0", ("gpl3-preamble",)),
    ("GPL-2.0", ("gnu-freedom", "gpl2-contrast")),
    ("Apache-2.0", ("apache2-terms",)),
    ("MPL-2.0", ("mpl2-contributor",)),
    ("MPL-1.1", ("mpl11-contributor",)),
    ("CDDL-1.0", ("cddl1-contributor",)),
    ("Artistic-2.0", ("artistic2-preamble",)),
    ("Artistic-1.0", ("artistic1-intent",)),
    ("OFL-1.1", ("ofl-goals",)),
    ("PSF-2.0", ("psf2-agreement",)),
    ("CC0-1.0", ("cc0-title",)),
    ("all-rights-reserved", ("reserved",)),
)

# Creative Commons licences before 4.0, by rule: codes, their names in words, versions.
for _code, _words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivs"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs")):
    for _version in ("1.0", "2.0", "2.5", "3.0"):
        _name = f"CC-{_code}-{_version}"
        SENTENCES[_name.lower()] = (f"Licensed under CC {_code} {_version}", f"licensed under a Creative Commons {_words} {_version} License", f"licensed under a Creative Commons {_words} {_version} Unported License", f"Creative Commons Legal Code {_words} {_version}")
        RULES += ((_name, (_name.lower(),)),)
# The Creative Commons licences of version 4.0 in full: the title, and the sentence after it that names the licence again.
for _code, _words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    _name, _id = f"CC-{_code}-4.0", f"cc-{_code.lower()}"
    SENTENCES[f"{_id}-title"] = (f"Creative Commons {_words} 4.0 International Public License",)
    SENTENCES[f"{_id}-accept"] = (f"You accept and agree to be bound by the terms and conditions of this Creative Commons {_words} 4.0 International Public License",)
    RULES += ((_name, (f"{_id}-title", f"{_id}-accept")), (_name, (f"{_id}-accept",)), (_name, (f"{_id}-title",)))
# A machine-readable tag for each licence that a rule names, and forms with their "-only" and "-or-later" endings.
_named = {x for x, _ in RULES} - {"all-rights-reserved"}
for _name in sorted(_named | {f"{x}-{end}" for x in _named for end in ("only", "or-later") if re.fullmatch(r"[AL]?GPL-[0-9.]+", x)}):
    SENTENCES[f"tag-{_name.lower()}"] = (f"SPDX-License-Identifier: {_name}",)
    RULES += ((_name, (f"tag-{_name.lower()}",)),)

# A text without any of these has no known sentence. Between words stands whatever normalising makes a space.
_ANCHOR = re.compile(r"licen[cs]e|permission|redistribut|free software|as is|rights reserved|public domain|waived|obtain a copy|warrant|endorse|advertising|any later version|covered software|creation of modifications|this agreement|artistic|creative commons|freedom to share|lesser gpl".replace(" ", r"[\W_]+"), re.I)
_OTHER = re.compile(r"[^\w.+-]+|(?<![0-9])\.|\.(?![0-9])|(?<!\w)[+-]+|[+-]+(?!\w)")


def normalised(text: str) -> str:
    """Words with single spaces between and around them."""
    return f" {' '.join(_OTHER.sub(' ', text.lower().replace('_', ' ')).replace('licence', 'license').split())} "


def _automaton():
    a = ahocorasick.Automaton()
    for name, forms in SENTENCES.items():
        for form in forms:
            words = normalised(form)
            a.add_word(words, (name, len(words)))
    a.make_automaton()
    return a


def sentences(text: str, automaton) -> list[tuple[int, int, str]]:
    """``(start, end, identifier)`` in words of the normalised text, in order; of sentences within others, the others."""
    words = normalised(text)
    found = sorted((at - n + 1, -(at + 1), name) for at, (name, n) in automaton.iter(words))
    out, upto, place, counted = [], 0, 0, 0
    for start, end, name in found:
        if -end <= upto:
            continue
        counted += words.count(" ", place, start + 1)
        place = start + 1
        out.append((counted, counted + words.count(" ", start + 1, -end), name))
        upto = -end
    return out


def licenses(found: list[tuple[int, int, str]], rules=RULES, gap: int = GAP) -> list[tuple[int, str]]:
    """``(start, licence)`` in order of the text. A rule reads on for ``gap`` words only, so time grows with the text."""
    left, out = list(found), []
    there = Counter(x[2] for x in left)
    for name, wanted in rules:
        if any(w not in there for w in wanted):
            continue
        used = [False] * len(left)
        for at, (start, end, first) in enumerate(left):
            if used[at] or first != wanted[0]:
                continue
            taken, k = [at], at + 1
            for w in wanted[1:]:
                while k < len(left) and (used[k] or left[k][2] != w) and left[k][0] - end <= gap:
                    k += 1
                if k == len(left) or left[k][0] - end > gap:
                    break
                taken.append(k)
                end, k = left[k][1], k + 1
            if len(taken) == len(wanted):
                out.append((start, name))
                for i in taken:
                    used[i] = True
        left = [x for x, u in zip(left, used, strict=True) if not u]
        there = Counter(x[2] for x in left)
    return sorted(out)


def _task(source):
    a = _automaton()
    for batch in batches(source, ["text"]):
        seen, names = [], []
        for text in batch.column("text").to_pylist():
            found = sentences(text, a) if text and _ANCHOR.search(text) else []
            seen.append([x[2] for x in found])
            names.append([x[1] for x in licenses(found)] if found else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.list_(pa.string())), pa.array(seen, pa.list_(pa.string()))], ["doc_id", "licenses", "sentences"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, licenses, sentences)``: licences and known sentences of every whole text, in order, repeats included.

    Null and empty texts have none. Rows are independent; repeated ids and null ids stay; other columns are ignored; no
    rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_task, "doc_id long, licenses array<string>, sentences array<string>")
