"""Licence recognition by sentence identifiers and ordered rules, with column functions only."""

from __future__ import annotations

import json
import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers and sentences of licence texts and notices, as their publishers word them.
KNOWN = [
    ("MIT_PERMISSION", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT_NOTICE", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT_NOTICE", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("MIT0_PERMISSION", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MIT_TITLE", "MIT License"),
    ("MIT_TITLE", "The MIT License"),
    ("MIT_TITLE", "The MIT License (MIT)"),
    ("BSD_USE", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD_NAMES", "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_ADVERTISING", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("ISC_PERMISSION", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC_PERMISSION", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD_PERMISSION", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("APACHE_COMPLY", "you may not use this file except in compliance with the License"),
    ("APACHE_COPY", "You may obtain a copy of the License at"),
    ("APACHE_COPY", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE_COPY", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE_BASIS", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("APACHE_TITLE", "Apache License"),
    ("APACHE2_DATE", "Version 2.0, January 2004"),
    ("GPL_TITLE", "GNU GENERAL PUBLIC LICENSE"),
    ("LGPL_TITLE", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("LGPL_TITLE", "GNU LIBRARY GENERAL PUBLIC LICENSE"),
    ("AGPL_TITLE", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("GPL2_DATE", "Version 2, June 1991"),
    ("GPL3_DATE", "Version 3, 29 June 2007"),
    ("LGPL21_DATE", "Version 2.1, February 1999"),
    ("AGPL3_DATE", "Version 3, 19 November 2007"),
    ("GPL_FREE", "This program is free software"),
    ("GPL_WARRANTY", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("MPL2_FORM", "This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0"),
    ("MPL2_COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MPL2_COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("MPL2_TITLE", "Mozilla Public License Version 2.0"),
    ("EPL2_TITLE", "Eclipse Public License - v 2.0"),
    ("BSL_TITLE", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("UNLICENSE_FREE", "This is free and unencumbered software released into the public domain"),
    ("ZLIB_PERMISSION", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("CC0_TITLE", "CC0 1.0 Universal"),
    ("RIGHTS", "All rights reserved"),
]

#: How notices name a licence, without its version, and the versions it has.
FAMILIES = [
    ("GPL", ["GNU General Public License", "GNU GPL", "GPL"], ["2.0", "3.0"]),
    ("LGPL", ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL"], ["2.0", "2.1", "3.0"]),
    ("AGPL", ["GNU Affero General Public License", "GNU AGPL", "AGPL"], ["3.0"]),
]

#: Licences that a notice names, and how.
NAMED = [
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0", "Apache 2 License"]),
    ("MIT", ["MIT License", "MIT"]),
    ("ISC", ["ISC License", "ISC"]),
    ("0BSD", ["0BSD"]),
    ("MIT-0", ["MIT-0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"]),
    ("BSD", ["BSD License", "BSD"]),
    ("MPL-2.0", ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"]),
    ("EPL-2.0", ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"]),
    ("Unlicense", ["Unlicense", "The Unlicense"]),
    ("Zlib", ["zlib License", "Zlib"]),
    ("CC0-1.0", ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero v1.0 Universal"]),
]

#: The Creative Commons licences' codes and names.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: What is varied in known sentences, and its one form. Applied in this order to a sentence of a-z, 0-9 and single spaces.
FORMS = [
    (r"^(?:[0-9]{1,2}|[a-d]) (?=redistribut|neither|all advertising)", ""),
    (r"^neither the names? of .{1,200}? nor the names of (?:its|any|other|the) contributors", "neither the name of x nor the names of its contributors"),
    (r"^(?:(?:this|the) [a-z]{1,20}|it|[a-z0-9]{1,30}) (?:is|are) (?:dual |hereby )?(?=(?:licensed|released|distributed|published|provided|available|made available) (?:under|with) )", ""),
    (r"^(?:licensed|released|distributed|published|provided|available|made available) (?:under|with) (?:the )?(?:terms of )?(?:the |a |an )?", "licensed under "),
    (r"^[a-z0-9 ]{1,60} (?=is free software$|is distributed in the hope that it will be useful)", "this program "),
]

#: A sentence without any of these stems can't be a known one; a search for them spares it, or its whole text, the rest.
STEMS = ["licens", "licenc", "permission", "copyright", "redistribut", "rights reserved", "endorse", "free software", "public domain", "advertising materials", "without any warranty", "mozilla", "gpl", "cc0", "version 2", "version 3", "spdx", "released under", "distributed under", "published under", "provided under", "available under"]

#: What precedes the text in a line of a comment, and what ends one.
COMMENT = r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+|dnl |rem |<!--)[ \t]*|[ \t]*(?:\*/|-->)[ \t]*$"

#: Where paragraphs, lines and sentences are cut; a version's dot isn't followed by white space.
PARAGRAPH, LINE, CUT = r"\n[ \t]*\n\s*", r"\n", r"[.!?;:]+\s+|[.!?;:]+$"

#: A tag and the licence it names, of which there may be two; an abbreviation before a version.
TWO_TAGS, TAG, ABBREVIATION = r"spdx-license-identifier:[ \t]*\(?([\w.+-]+)[ \t]+(?:or|and)[ \t]+([\w.+-]+)\)?", r"spdx-license-identifier:[ \t]*", r"\bv\.\s*(?=[0-9])"


def plain(sentence: str) -> str:
    """What ``normalised`` makes of a sentence, for the table."""
    s = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    for pattern, form in FORMS:
        s = re.sub(pattern, form, s)
    return s


def _versions(version: str) -> list[str]:
    short = version.removesuffix(".0")
    return [f"{word}{v}" for word, v in product(("version ", "v", "v ", ""), dict.fromkeys((short, version)))]


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: the texts' sentences, and every wording of a grant by name or tag."""
    out = {plain(text): name for name, text in KNOWN}

    def grant(licence: str, name: str) -> None:
        out.setdefault(plain(f"Licensed under {name}"), f"GRANT {licence}")

    for licence, names in NAMED:
        for name in names:
            grant(licence, name)
        out[f"spdx id {plain(licence)}"] = f"TAG {licence}"
    for code, name in COMMONS.items():
        for version in ("", " 3.0", " 4.0"):
            licence = f"CC-{code}{version.replace(' ', '-')}"
            for form, tail in product((f"CC {code}{version}", f"CC-{code}{version.replace(' ', '-')}", f"Creative Commons {name}{version}"), ("", " International", " License", " International License", " Unported License")):
                grant(licence, form + tail)
            out[f"spdx id {plain(licence)}"] = f"TAG {licence}"
    for family, names, versions in FAMILIES:
        for version in versions:
            said = _versions(version)
            for licence, tails in ((f"{family}-{version}-only", ["", " only"]), (f"{family}-{version}-or-later", [" or later", " or any later version", " or (at your option) any later version", "+"])):
                for name, v, tail in product(names, said, tails):
                    if tail != "+":
                        grant(licence, f"{name}, {v}{tail}")
                out[f"spdx id {plain(licence)}"] = out[f"spdx id {plain(licence.removesuffix('-only'))}"] = f"TAG {licence}"
            out[f"spdx id {plain(f'{family}-{version}')}"] = f"TAG {family}-{version}-only"
            notice = "you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation{}"
            old = "you can redistribute it and/or modify it under the terms of the {}, version {}, as published by the Free Software Foundation"
            short = version.removesuffix(".0")
            for name in names[:-2]:
                out[plain(notice.format(name, f", either version {short} of the License, or (at your option) any later version"))] = f"NOTICE {family}-{version}-or-later"
                out[plain(notice.format(name, f"; either version {short} of the License, or (at your option) any later version"))] = f"NOTICE {family}-{version}-or-later"
                out[plain(notice.format(name, f", version {short} of the License"))] = out[plain(notice.format(name, f", version {short}"))] = f"NOTICE {family}-{version}-only"
                out[plain(old.format(name, short))] = f"NOTICE {family}-{version}-only"
                # with a semicolon before "either", the sentence is cut there
                out[plain(notice.format(name, ""))] = f"NOTICE {family}"
                out[plain(f"either version {short} of the License, or (at your option) any later version")] = f"LATER {version}"
        grant(family, names[0])
    return out


#: Rules over a text's identifiers: a licence, and the identifiers that stand for it in this order, with others between them. Rules are tried one after the other; a rule that matches takes its identifiers away from those after it.
def ordered_rules() -> list[tuple[str, list[str]]]:
    rules = [
        ("BSD-4-Clause", ["BSD_USE", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISING"]), ("BSD-3-Clause", ["BSD_USE", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]), ("BSD-2-Clause", ["BSD_USE", "BSD_SOURCE", "BSD_BINARY"]), ("BSD", ["BSD_USE"]),
        ("MIT", ["MIT_TITLE", "MIT_PERMISSION", "MIT_NOTICE"]), ("MIT", ["MIT_PERMISSION", "MIT_NOTICE"]), ("MIT", ["MIT_PERMISSION"]), ("MIT-0", ["MIT0_PERMISSION"]), ("ISC", ["ISC_PERMISSION"]), ("0BSD", ["0BSD_PERMISSION"]),
        ("Apache-2.0", ["GRANT Apache-2.0", "APACHE_COMPLY", "APACHE_COPY"]), ("Apache-2.0", ["APACHE_TITLE", "APACHE2_DATE"]), ("Apache-2.0", ["APACHE_COMPLY", "APACHE_COPY", "APACHE_BASIS"]),
        ("GPL-2.0", ["GPL_TITLE", "GPL2_DATE"]), ("GPL-3.0", ["GPL_TITLE", "GPL3_DATE"]), ("LGPL-2.1", ["LGPL_TITLE", "LGPL21_DATE"]), ("LGPL-3.0", ["LGPL_TITLE", "GPL3_DATE"]), ("AGPL-3.0", ["AGPL_TITLE", "AGPL3_DATE"]),
        ("MPL-2.0", ["MPL2_FORM", "MPL2_COPY"]), ("MPL-2.0", ["MPL2_FORM"]), ("MPL-2.0", ["MPL2_TITLE"]), ("EPL-2.0", ["EPL2_TITLE"]), ("BSL-1.0", ["BSL_TITLE"]), ("Unlicense", ["UNLICENSE_FREE"]), ("Zlib", ["ZLIB_PERMISSION"]), ("CC0-1.0", ["CC0_TITLE"]),
    ]
    rules += [(f"{family}-{version}-or-later", [f"NOTICE {family}", f"LATER {version}"]) for family, _, versions in FAMILIES for version in versions]
    said = sorted(set(known_sentences().values()))
    rules += [(name.split(" ")[1], [name]) for kind in ("NOTICE ", "TAG ", "GRANT ") for name in said if name.startswith(kind)]
    return [*rules, ("MIT", ["MIT_TITLE"])]


#: Rules over the whole sequence that match only where no other did: a notice that names no version, and a text that only reserves all rights.
LAST_RULES = [("GPL", r"^[^+]*<GPL_FREE>[^+]*<GPL_WARRANTY>[^+]*$"), ("proprietary", r"^(?:<RIGHTS>)+$")]


def rule_pattern(names: list[str]) -> tuple[str, str]:
    """The pattern of a rule over identifiers written ``<ID>``, and what is left of its match: a mark, and what stood between."""
    return "(.*?)".join(f"<{re.escape(n)}>" for n in names), "+" + "".join(f"${k}" for k in range(1, len(names)))


def has_stem(text: Column) -> Column:
    found = F.lit(False)
    for stem in STEMS:
        found = found | F.contains(text, F.lit(stem))
    return found


def normalised(sentence: Column) -> Column:
    """Words of a-z and 0-9 with single spaces, varied parts in one form."""
    s = F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))
    for pattern, form in FORMS:
        s = F.regexp_replace(s, pattern, form)
    return s


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in its order.

    Marks of comments are dropped. Every paragraph is read twice: with its lines joined, as texts are wrapped, and
    line by line, as titles and lists stand; what only the second finds follows the first.
    """
    table, ids = (F.split(F.lit("\n".join(x)), "\n") for x in (known, known.values()))
    low = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "\r\n?", "\n"), TWO_TAGS, "spdx-license-identifier: $1\n\nspdx-license-identifier: $2"), COMMENT, "")
    low = F.regexp_replace(F.regexp_replace(low, TAG, "spdx id "), ABBREVIATION, "v ")

    def of(part: Column) -> Column:
        kept = F.filter(F.split(part, CUT), has_stem)
        found = F.transform(kept, lambda s: F.get(ids, F.array_position(table, normalised(s)).cast("int") - 1))
        return F.filter(found, lambda x: x.isNotNull())

    def both(paragraph: Column) -> Column:
        lines = F.flatten(F.transform(F.split(paragraph, LINE), of))
        joined = of(F.regexp_replace(paragraph, LINE, " "))
        return F.concat(joined, F.array_except(lines, joined))

    paragraphs = F.filter(F.split(low, PARAGRAPH), has_stem)
    return F.when(has_stem(F.lower(text)), F.flatten(F.transform(paragraphs, both))).otherwise(F.array().cast("array<string>"))


def match_rules(line: Column) -> Column:
    """(left, licences, rules): the licences whose rules match the identifiers, and the rules' numbers from 1."""
    patterns = [(licence, *rule_pattern(names)) for licence, names in ordered_rules()] + [(licence, p, "+") for licence, p in LAST_RULES]
    rows = [{"k": k, "licence": licence, "pattern": p, "left": left} for k, (licence, p, left) in enumerate(patterns, 1)]
    rules = F.from_json(F.lit(json.dumps(rows)), "array<struct<k:int,licence:string,pattern:string,left:string>>")
    start = F.struct(line.alias("left"), F.array().cast("array<string>").alias("licences"), F.array().cast("array<int>").alias("rules"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["left"], rule["pattern"])
        return F.when(
            hit,
            F.struct(
                F.regexp_replace(state["left"], rule["pattern"], rule["left"]).alias("left"), F.array_append(state["licences"], rule["licence"]).alias("licences"), F.array_append(state["rules"], rule["k"]).alias("rules")
            ),
        ).otherwise(state)

    return F.aggregate(rules, start, step)


def licence_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The licences of every text: doc_id, n_known (sentences recognised), sequence, licence, rule.

    The whole text is cut into sentences, across wrapped lines and comment marks; each is normalised and looked up
    among the known licence sentences; the sequence of identifiers, in the text's order, is matched with the ordered
    rules. licence has the names of all licences found, joined by `` AND `` in the order of the rules, and rule the
    numbers of these. Everything is computed in the row, so there is no shuffle. A null, empty or licence-free text has
    n_known 0, an empty sequence, and null licence and rule. So has a sequence that no rule matches, but for its own
    n_known. Repeated rows are judged one by one, an empty table gives an empty result, and other columns aren't
    looked at.
    """
    found = docs.select("doc_id", sentence_ids(F.coalesce(F.col(text), F.lit("")), known_sentences()).alias("ids"))
    line = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    found = found.select("doc_id", "ids", F.when(F.size("ids") > 0, match_rules(line)).alias("m"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ", ").alias("sequence"),
        F.nullif(F.array_join(F.array_distinct("m.licences"), " AND "), F.lit("")).alias("licence"), F.nullif(F.array_join(F.transform("m.rules", lambda k: k.cast("string")), ","), F.lit("")).alias("rule"),
    )
