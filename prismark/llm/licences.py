"""License scans by sentence rules.

A text is cut into pieces, which are normalised; known licence sentences are found wherever they are one piece or several in
a row, so also wrapped over lines, in comments and across paragraphs. The sequence of the identifiers found is then matched
against licence rules in order, each an ordered run of identifiers: what a rule has matched is taken out before the next one is
tried. SPDX expressions and notices that name several licences count as one line for each. All of it is one projection over
whole texts: no shuffle, no Python; texts without a word that all sentences share are passed by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import ascii_lower

# Normalised sentences of public licences and the notices that point to them, by identifier.
SENTENCES = {
    "apache-2.0-comply": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2.0-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl-2.0-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl-2-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-2.1-grant": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
}
# Other wordings of these sentences.
WORDINGS = {"you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2.0-copy"}

# Licences by family: how identifiers begin, the full name, versions, how far it restricts use (0 least), and
# the endings of SPDX identifiers. An empty version is none.
FAMILIES = [
    ("0BSD", "zero clause bsd license", "", 0), ("AFL", "academic free license", "1.1 1.2 2.0 2.1 3.0", 0), ("AGPL", "gnu affero general public license", "1.0 3.0", 1, ("", "-only", "-or-later")),
    ("Apache", "apache license", "1.0 1.1 2.0", 0), ("APSL", "apple public source license", "1.0 1.1 1.2 2.0", 1), ("Artistic", "artistic license", "1.0 2.0", 0),
    ("BSD-2-Clause", "bsd 2 clause license", "", 0), ("BSD-3-Clause", "bsd 3 clause license", "", 0), ("BSD-4-Clause", "bsd 4 clause license", "", 0), ("BSL", "boost software license", "1.0", 0),
    ("BUSL", "business source license", "1.1", 2), ("CC0", "cc0 universal license", "1.0", 0), ("CDDL", "common development and distribution license", "1.0 1.1", 1), ("CECILL", "cecill license", "1.0 2.0 2.1", 1),
    ("CPL", "common public license", "1.0", 1), ("ECL", "educational community license", "1.0 2.0", 0), ("Elastic", "elastic license", "2.0", 3), ("EPL", "eclipse public license", "1.0 2.0", 1),
    ("EUPL", "european union public license", "1.0 1.1 1.2", 1), ("GFDL", "gnu free documentation license", "1.1 1.2 1.3", 1, ("", "-only", "-or-later")), ("GPL", "gnu general public license", "1.0 2.0 3.0", 1, ("", "-only", "-or-later")),
    ("IPL", "ibm public license", "1.0", 1), ("ISC", "isc license", "", 0), ("LGPL", "gnu lesser general public license", "2.0 2.1 3.0", 1, ("", "-only", "-or-later")), ("LPPL", "latex project public license", "1.0 1.1 1.2 1.3a 1.3c", 0),
    ("MIT", "mit license", "", 0), ("MIT-0", "mit no attribution license", "", 0), ("MPL", "mozilla public license", "1.0 1.1 2.0", 1), ("MS-PL", "microsoft public license", "", 0), ("MS-RL", "microsoft reciprocal license", "", 1),
    ("MulanPSL", "mulan permissive software license", "1.0 2.0", 0), ("NCSA", "university of illinois ncsa open source license", "", 0), ("NPL", "netscape public license", "1.0 1.1", 1), ("ODbL", "open data commons open database license", "1.0", 1),
    ("ODC-By", "open data commons attribution license", "1.0", 0), ("OFL", "sil open font license", "1.0 1.1", 0), ("OSL", "open software license", "1.0 1.1 2.0 2.1 3.0", 1), ("PDDL", "open data commons public domain dedication license", "1.0", 0),
    ("PHP", "php license", "3.0 3.01", 0), ("PostgreSQL", "postgresql license", "", 0), ("PSF", "python software foundation license", "2.0", 0), ("QPL", "q public license", "1.0", 1), ("RPL", "reciprocal public license", "1.1 1.5", 1),
    ("RPSL", "realnetworks public source license", "1.0", 1), ("SISSL", "sun industry standards source license", "", 1), ("SPL", "sun public license", "1.0", 1), ("SSPL", "server side public license", "1.0", 2), ("Unlicense", "unlicense", "", 0),
    ("UPL", "universal permissive license", "1.0", 0), ("Vim", "vim license", "", 0), ("W3C", "w3c software notice license", "", 0), ("X11", "x11 license", "", 0), ("Zend", "zend license", "2.0", 0), ("Zlib", "zlib license", "", 0), ("ZPL", "zope public license", "1.1 2.0 2.1", 0),
]
# Of Creative Commons the conditions, their words and how far they restrict use; versions and what notices add to them.
COMMONS = [("BY", "attribution", 0), ("BY-SA", "attribution sharealike", 1), ("BY-ND", "attribution noderivatives", 1), ("BY-NC", "attribution noncommercial", 2), ("BY-NC-SA", "attribution noncommercial sharealike", 2), ("BY-NC-ND", "attribution noncommercial noderivatives", 2)]
COMMONS_VERSIONS = {"1.0": "generic", "2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}
# How notices begin.
NOTICES = ("licensed under", "released under", "distributed under", "this work is licensed under", "this project is licensed under", "this software is licensed under")


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


@dataclass(frozen=True)
class Licence:
    """What notices call a licence (normalised), how far it restricts use, and its SPDX identifiers."""

    names: tuple[str, ...]
    restricts: int
    identifiers: tuple[str, ...]


def _licences() -> dict[str, Licence]:
    """By identifier. Names by rule: with and without an article, `license` and the words `version` or `v` before a version, 2.0 also as 2; short identifiers."""
    out = {}
    for stem, full, versions, level, *endings in FAMILIES:
        for v in versions.split() or [""]:
            name = f"{stem}-{v}" if v else stem
            said = [v, v.removesuffix(".0")] if v.endswith(".0") else [v]
            short = full.removesuffix(" license")
            ways = {f"{full} {by}{x}" for x in said for by in ("", "version ", "v")} | {f"{short} {by}{x}{tail}" for x in said for by in ("", "v") for tail in ("", " license")} if v else {full, short}
            if stem.startswith("BSD-"):
                n = stem[4]
                ways |= {f"{n} clause bsd license", f"{n} clause bsd"}
            if stem == "CC0":
                ways |= {"cc0 1.0 universal", "cc0 1.0 universal license", "creative commons zero v1.0 universal"}
            ways = {_plain(w) for w in (*ways, name)} - {"vim", "elastic", "artistic", "q", "x11", "unlicense" if v else ""}
            out[name] = Licence(tuple(sorted({f"{a}{w}" for w in ways for a in ("", "the ")})), level, tuple(f"{name}{e}" for e in (endings[0] if endings else ("",))))
    for conditions, words, level in COMMONS:
        for v, more in COMMONS_VERSIONS.items():
            name = f"CC-{conditions}-{v}"
            ways = {_plain(w) for w in (name, f"creative commons {words} {v} {more} license", f"creative commons {words} {v} license", f"creative commons {words} {v}", f"cc {conditions} {v} license")}
            out[name] = Licence(tuple(sorted({f"{a}{w}" for w in ways for a in ("", "the ", "a ")})), level, (name,))
    return out


LICENCES = _licences()
#: Identifier of a notice by the licence's name, and of sentences and SPDX lines by sentence.
NAMED = {name: f"{k.lower()}-notice" for k, x in LICENCES.items() for name in x.names}
WHOLE = {s: name for name, s in SENTENCES.items()} | WORDINGS | {f"spdx license identifier {_plain(i)}": f"{k.lower()}-spdx" for k, x in LICENCES.items() for i in x.identifiers}
#: All sentences that are one piece, notices of one licence among them.
KNOWN = WHOLE | {f"{begin} {name}": notice for begin in NOTICES for name, notice in NAMED.items()}
#: Each sentence holds one of these; texts without any are not looked at further.
ANCHORS = "(?i)licen[sc]|releas|distribut|reserved|permi|software|spdx|mozilla"
# What joins licences, and names exceptions, in SPDX expressions; and what joins them in notices.
_SPDX_LINE = r"(?i)(?<=spdx-license-identifier:[^\n]{0,300})"
_JOINED = "[ |]+(?:and[ |]+or|and|or)[ |]+"


#: Sentences of so many words are unmistakable: they may follow words that nothing cuts off, as a holder's name.
LONG = 12
#: A piece ends where white space follows a sentence end or its closing quotes, a list mark or an address, and at every newline.
PIECE_END = r"([.!?;:]+[\"'”’)\]]*|\n[ \t]*\(?[0-9A-Za-z]{1,3}\)|://[^\s]+)[ \t\r]+"


@dataclass(frozen=True)
class LicenceRule:
    """A licence, how far it restricts use (0 least), and the run of sentences that states it."""

    licence: str
    restricts: int
    sentences: tuple[str, ...]


# The rules of whole texts, in the order in which they are tried; those of notices and SPDX identifiers come behind.
RULES = [
    LicenceRule("Apache-2.0", 0, ("apache-2.0-comply", "apache-2.0-copy", "apache-2.0-basis")),
    LicenceRule("MIT", 0, ("mit-grant", "as-is")),
    LicenceRule("BSD-3-Clause", 0, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    LicenceRule("BSD-2-Clause", 0, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    LicenceRule("ISC", 0, ("isc-grant",)),
    LicenceRule("Unlicense", 0, ("unlicense",)),
    LicenceRule("MPL-2.0", 1, ("mpl-2.0-subject",)),
    LicenceRule("LGPL-2.1", 1, ("lgpl-2.1-grant", "lgpl-hope")),
    LicenceRule("AGPL-3.0", 1, ("agpl-3-grant", "gpl-hope")),
    LicenceRule("GPL-2.0", 1, ("gpl-2-grant", "gpl-hope")),
    LicenceRule("GPL-3.0", 1, ("gpl-grant", "gpl-hope")),
    *(LicenceRule(k, x.restricts, (f"{k.lower()}-{kind}",)) for k, x in LICENCES.items() for kind in ("notice", "spdx")),
    LicenceRule("proprietary", 3, ("rights-reserved",)),
]
CLASSES = ("permissive", "copyleft", "non-commercial", "proprietary")


def spdx_lines(text: Column) -> Column:
    """The text with each SPDX expression as a line for each licence: AND and OR end one, WITH and its exception are left out."""
    plain = F.regexp_replace(text, _SPDX_LINE + r"[ \t]+with[ \t]+[A-Za-z0-9.+-]+", "")
    plain = F.regexp_replace(plain, _SPDX_LINE + r"[ \t)]+(?:and|or)[ \t(]+", "\nSPDX-License-Identifier: ")
    return F.when(text.rlike("(?i)spdx-license-identifier"), plain).otherwise(text)


def pieces_of(text: Column) -> Column:
    """The text's pieces, each a-z and 0-9 of the lower-cased piece with all else as single spaces, between bars; "rem" and "dnl" before one are comment marks."""
    cut = F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), PIECE_END, "$1\n")
    words = F.regexp_replace(ascii_lower(cut), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(words, " ?\n[ \n]*(?:(?:rem|dnl)(?=[ \n]) ?)?", "|")


def _one_of(sentences: list[str]) -> str:
    """A pattern of any of the sentences, longest first, their words however apart; sentences of one first word share it."""
    by: dict[str, list[str]] = {}
    for x in sorted(sentences, key=len, reverse=True):
        first, _, rest = x.partition(" ")
        by.setdefault(first, []).append("[ |]+".join(map(re.escape, rest.split())))
    return "(?:" + "|".join(f"{re.escape(w)}(?:[ |]+(?:{'|'.join(filter(None, rest))})){'?' * ('' in rest)}" if any(rest) else re.escape(w) for w, rest in by.items()) + ")"


def sentences_in(text: Column, known: list[str], notices: tuple[str, ...] = (), names: list[str] | None = None) -> Column:
    """The known sentences (two words or more), in order, that begin and end where pieces of the text do, long ones also beginning within one; of several from one place the longest.

    With notices and names a notice, followed by names joined by and, or, is a sentence too.
    """
    long, short = ([s for s in known if (len(s.split()) >= LONG) == x] for x in (True, False))
    ways = [start + _one_of(x) for start, x in (("[ |]", long), (r"\|", short)) if x]
    if notices:
        ways.append(rf"\|{_one_of(list(notices))}[ |]+{_one_of(names)}(?:{_JOINED}{_one_of(names)})*")
    found = F.regexp_extract_all(pieces_of(text), F.lit("(?:" + "|".join(ways) + r")(?=\|)"), 0)
    return F.transform(found, lambda s: F.trim(F.regexp_replace(s, "[ |]+", " ")))


def run_of(names: tuple[str, ...]) -> str:
    """A run of identifiers as text; each has a comma of its own on either side."""
    return "".join(f",{n}," for n in names)


def _constants(values: list[str]) -> Column:
    """An array of strings, as one literal that Spark splits when it plans; | is in none of them."""
    return F.split(F.lit("|".join(values)), "[|]")


def _table(pairs: dict[str, str]) -> Column:
    return F.map_from_arrays(_constants(list(pairs)), _constants(list(pairs.values())))


def matched(names: Column, rules: list[LicenceRule]) -> Column:
    """struct(licences, level): of each rule in order that matches what the rules before it have left."""
    each = F.arrays_zip(_constants([run_of(r.sentences) for r in rules]).alias("run"), _constants([r.licence for r in rules]).alias("licence"), _constants([str(r.restricts) for r in rules]).cast("array<int>").alias("level"))
    line = F.array_join(F.transform(names, lambda n: F.concat(F.lit(","), n, F.lit(","))), "")
    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("licences"), F.lit(-1).alias("level"))

    def step(s: Column, r: Column) -> Column:
        hit = F.contains(s["line"], r["run"])
        after = F.struct(F.replace(s["line"], r["run"], F.lit(",#,")).alias("line"), F.array_append(s["licences"], r["licence"]).alias("licences"), F.greatest(s["level"], r["level"]).alias("level"))
        return F.when(hit, after).otherwise(s)

    return F.aggregate(F.when(F.size(names) > 0, each).otherwise(F.slice(each, 1, 0)), start, step)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[LicenceRule] | None = None) -> DataFrame:
    """One row per row of df: id_col, sentences (identifiers found, in order), licences (distinct, sorted, comma-joined), licence_class, n_sentences.

    The class is that of the most restricting licence, "none" without any. A null or empty text has none. Null ids stay,
    repeated rows give repeated results, an empty table gives none, other columns are not read.

    sentences: other sentences, of two words or more, by identifier; rules: other rules.
    """
    own, rules = sentences is not None, rules or RULES
    whole = {s: n for n, s in sentences.items()} if own else WHOLE
    known = _table(whole)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if own:
        names = F.transform(sentences_in(text, list(whole)), lambda s: F.element_at(known, s))
    else:
        named = _table(NAMED)
        each = F.lit(rf"(?<=(?:under|and|or) ){_one_of(list(NAMED))}(?= (?:and|or) |$)")
        listed = lambda s: F.transform(F.regexp_extract_all(s, each, 0), lambda n: F.element_at(named, n))
        met = sentences_in(spdx_lines(text), list(WHOLE), NOTICES, list(NAMED))
        found = F.flatten(F.transform(met, lambda s: F.coalesce(F.nullif(F.array(F.element_at(known, s)), F.array(F.lit(None).cast("string"))), listed(s))))
        names = F.when(text.rlike(ANCHORS), found).otherwise(F.array().cast("array<string>"))
    rows = df.select(F.col(id_col), names.alias("names"))
    rows = rows.select(id_col, "names", matched(F.col("names"), rules).alias("found"))
    level = F.col("found.level")
    return rows.select(
        id_col,
        F.array_join("names", ",").alias("sentences"),
        F.array_join(F.array_sort(F.array_distinct("found.licences")), ",").alias("licences"),
        F.when(level < 0, F.lit("none")).otherwise(F.get(F.array(*map(F.lit, CLASSES)), level)).alias("licence_class"),
        F.size("names").cast("long").alias("n_sentences"),
    )
