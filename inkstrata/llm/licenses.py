"""Licence scans: sentences are normalised and mapped to identifiers of known licence
sentences; a document's sequence of identifiers is matched against ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of licence notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-title": "The MIT License (MIT)",
    "mit-short-title": "MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-terms": "This project is licensed under the terms of the MIT license.",
    "apache-released": "Released under the Apache License, Version 2.0.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-limits": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-licensed": "Licensed under the GNU General Public License, version 3.",
    "mpl-source": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd": "SPDX-License-Identifier: BSD-3-Clause",
    "lgpl-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "psf-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "bsd-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-old-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-mpl": "SPDX-License-Identifier: MPL-2.0",
    "spdx-lgpl": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-agpl": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-isc": "SPDX-License-Identifier: ISC",
}

#: A rule is a licence and the identifiers that must follow each other in this
#: order; other known sentences may stand between them.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-title",)), ("MIT", ("mit-short-title",)), ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)), ("MIT", ("mit-terms",)), ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache-header", "apache-limits", "apache-copy", "apache-as-is")), ("Apache-2.0", ("apache-released",)),
    ("Apache-2.0", ("apache-licensed",)), ("Apache-2.0", ("spdx-apache",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-author")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("spdx-bsd",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty", "gpl-received")), ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty", "gpl-received")),
    ("GPL-3.0", ("gpl-work",)), ("GPL-3.0", ("gpl-licensed",)), ("GPL-3.0", ("spdx-gpl",)), ("GPL-3.0-or-later", ("spdx-gpl-later",)),
    ("MPL-2.0", ("mpl-source",)), ("ISC", ("isc-grant", "as-is")), ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-old-grant", "isc-as-is")), ("CC-BY-4.0", ("cc-by",)), ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC-BY-SA-4.0", ("cc-by-sa-short",)), ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-warranty", "lgpl-received")), ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-warranty", "lgpl-received")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-warranty", "agpl-received")), ("Unlicense", ("unlicense-domain", "unlicense-free")),
    ("Zlib", ("zlib-as-is", "zlib-grant")), ("EPL-2.0", ("epl",)), ("CC0-1.0", ("cc0",)), ("BSL-1.0", ("boost",)), ("PSF-2.0", ("psf-title",)),
    ("BSD-2-Clause", ("spdx-bsd2",)), ("MPL-2.0", ("spdx-mpl",)), ("LGPL-3.0-or-later", ("spdx-lgpl",)), ("AGPL-3.0-or-later", ("spdx-agpl",)), ("ISC", ("spdx-isc",)),
]

#: Every part of a known sentence has one of these; a text without any, also where a line ends inside,
#: has no known sentence.
KEYWORDS = ["licen", "permission", "warrant", "redistribution", "copyright", "free software", "this software", "public domain"]

#: Parts of known sentences, as they are compared, in which a number or a holder's name stands, and what stands for all.
SLOTS = [
    ("^[0-9]{1,2} ", ""),
    ("^neither the names? of .+ nor the names of (?:its|their|any) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^the names? of .+ may not be used to endorse", "the name of the author may not be used to endorse"),
    ("^the software is provided as is and .+ disclaims? all warranties", "the software is provided as is and the author disclaims all warranties"),
]

#: Identifiers that a tag may hold, alone or in an expression, and what they are reported as.
SPDX = {
    x: x
    for x in (
        "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 "
        "EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL "
        "PSF-2.0 Python-2.0 Unlicense UPL-1.0 WTFPL Zlib"
    ).split()
} | {"GPL-3.0-only": "GPL-3.0", "GPL-3.0": "GPL-3.0", "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0+": "GPL-3.0-or-later"}
#: A tag's expression, to the end of its line; an exception is no licence.
TAG = r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"
EXCEPTION = r"\b[Ww][Ii][Tt][Hh][ \t]+[A-Za-z0-9.+-]+"
IDENTIFIER = r"[A-Za-z0-9][A-Za-z0-9.+-]*"

#: A tag and its value stand on a line of their own, and an abbreviated version is not cut
#: apart. A line that ends without a stop goes on in the next one if that starts in lower
#: case, if capitals stand on both sides, or if it ends inside a licence's name or after a word
#: that ends no sentence; comment marks at line starts are no part of a sentence.
WRAP = [
    (r"(SPDX-License-Identifier):[ \t]+([^ \t\r\n]+)", "\n.\n$1 $2\n.\n"), (r"( v)[.] ([0-9])", r"$1 $2"), (r"\n[ \t]*(?:[#*]+|//+|--+|;+)[ \t]*", "\n"),
    (r"([a-z,0-9)\"])[ \t]*\r?\n[ \t]*([a-z(\"])", r"$1 $2"), (r"([A-Z,])[ \t]*\r?\n[ \t]*([A-Z][A-Z])", r"$1 $2"),
    (r"( (?:GNU|Lesser|Affero|General|Mozilla|Eclipse|Public|Free|Software|Creative|Boost|Apache|Source|Code|the|of|by|in|under|this))[ \t]*\r?\n[ \t]*([A-Z])", r"$1 $2"),
    (r"( (?:Inc|Ltd|Corp|Co))[.] ([a-z])", r"$1 $2"),
]
END = (r"([.!?;:])[ \t\r]+", "$1\n")
OTHER = "[^a-z0-9]+"


def parts_of(sentence: str) -> list[str]:
    """A known sentence as a text's sentences are compared: cut where texts are, in lower case,
    without punctuation."""
    for pattern, by in [*WRAP[:2], END]:
        sentence = re.sub(pattern, re.sub(r"[$](\d)", r"\\\1", by), sentence)
    return [key for x in sentence.split("\n") if (key := _with_slots(re.sub(OTHER, " ", x.lower()).strip()))]


def _with_slots(key: str) -> str:
    for pattern, by in SLOTS:
        key = re.sub(pattern, by, key)
    return key


def known_parts() -> dict[str, str]:
    """Identifier of each part: the sentence's, with /1, /2, ... if it has several parts; what
    several sentences begin with has the first one's."""
    out: dict[str, str] = {}
    for i, s in SENTENCES.items():
        parts = parts_of(s)
        for n, part in enumerate(parts, 1):
            out.setdefault(part, i if len(parts) == 1 else f"{i}/{n}")
    return out


def _in_parts() -> list[tuple[str, str]]:
    """(the parts' identifiers, the sentence's) of the sentences that texts are cut inside."""
    known = known_parts()
    return [("".join(f" {known[x]} " for x in parts_of(s)), f" {i} ") for i, s in SENTENCES.items() if len(parts_of(s)) > 1]


#: What is left of unknown sentences, and of known ones that are not there as a whole.
LEFT_OVER = " ([?]|[a-z0-9-]+/[0-9]) "


def _rule(ids: tuple[str, ...]) -> str:
    return "".join(f" {i} " if n == 0 else f"(.* )?{i} " for n, i in enumerate(ids))


def _patterns() -> list[tuple[str, str]]:
    names = sorted({name for name, _ in RULES})
    return [(name, "|".join(_rule(ids) for n, ids in RULES if n == name)) for name in names]


#: Fixed value: a licence that is not reported where the other, which holds its sentences, is.
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licenses) for every row.

    ``sentence_ids``: the known sentences in order, with a blank around each; ``licenses``:
    the licences whose rules match, in code point order, joined by ``;``. A text that has all
    sentences of the three-clause BSD licence is not reported as the two-clause one too; the
    identifiers in SPDX tags, alone or in expressions, are reported with them. No shuffle and no Python: string and array functions only. Null and empty texts and texts
    without a known sentence give 0, a blank and an empty string. Repeated rows repeat; an
    empty table gives an empty one; very long texts are read whole; other columns, whatever
    their names, are not read.
    """
    text = F.col("text")
    for pattern, by in WRAP:
        text = F.regexp_replace(text, pattern, by)
    sentences = F.split(F.regexp_replace(text, *END), "\n")

    def key(s):
        s = F.trim(F.regexp_replace(F.lower(s), OTHER, " "))
        for pattern, by in SLOTS:
            s = F.regexp_replace(s, pattern, by)
        return s

    known = F.create_map(*[F.lit(x) for pair in known_parts().items() for x in pair])
    found = F.transform(sentences, lambda s: F.concat(F.lit(" "), F.coalesce(F.try_element_at(known, key(s)), F.lit("?")), F.lit(" ")))
    found = F.array_join(found, "")
    for parts, whole in _in_parts():
        found = F.replace(found, F.lit(parts), F.lit(whole))
    ids = F.regexp_replace(found, LEFT_OVER, "")
    has = F.lower("text").rlike("|".join(KEYWORDS).replace(" ", "[^a-z]+"))
    ids = F.coalesce(F.nullif(F.when(has, ids), F.lit("")), F.lit(" "))
    tags = F.regexp_extract_all("text", F.lit(TAG), F.lit(1))
    tagged = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(F.regexp_replace(t, EXCEPTION, ""), F.lit(IDENTIFIER), F.lit(0))))
    named = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    tagged = F.coalesce(F.filter(F.transform(tagged, lambda t: F.try_element_at(named, t)), lambda t: t.isNotNull()), F.array().cast("array<string>"))
    out = docs.select("doc_id", ids.alias("sentence_ids"), tagged.alias("tagged"))
    out = out.select("doc_id", F.regexp_count("sentence_ids", F.lit("[^ ]+")).cast("long").alias("n_known"), "sentence_ids", "tagged")
    patterns = dict(_patterns())
    match = {name: F.col("sentence_ids").rlike(pattern) for name, pattern in patterns.items()}
    hits = [F.when(match[name] & ~match[CONTAINED[name]] if name in CONTAINED else match[name], F.lit(name)) for name in patterns]
    ruled = F.when(F.col("n_known") == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*hits)))
    found = F.array_join(F.array_sort(F.array_union(ruled, "tagged")), ";")
    return out.select("doc_id", "n_known", "sentence_ids", found.alias("licenses"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql() -> str:
    """The same in DuckDB's dialect, which cuts the known sentences up by itself."""
    dollar = lambda by: re.sub(r"[$](.)", r"\\\1", by)

    def cut(text: str, steps: list[tuple[str, str]]) -> str:
        for pattern, by in [*steps, END]:
            text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(dollar(by))}, 'g')"
        return f"string_split({text}, chr(10))"

    key = f"trim(regexp_replace(lower(part), '{OTHER}', ' ', 'g'))"
    for pattern, by in SLOTS:
        key = f"regexp_replace({key}, {_quoted(pattern)}, {_quoted(by)})"
    spdx = ", ".join(f"({_quoted(x)}, {_quoted(y)})" for x, y in SPDX.items())
    raw = ", ".join(f"({n}, {_quoted(i)}, {_quoted(s)})" for n, (i, s) in enumerate(SENTENCES.items()))
    joined = "string_agg(' ' || coalesce(k.id, '?') || ' ', '' ORDER BY o.pos)"
    for parts, whole in _in_parts():
        joined = f"replace({joined}, {_quoted(parts)}, {_quoted(whole)})"
    hits = ", ".join(
        f"CASE WHEN regexp_matches(sentence_ids, {_quoted(pattern)})"
        + (f" AND NOT regexp_matches(sentence_ids, {_quoted(dict(_patterns())[CONTAINED[name]])})" if name in CONTAINED else "")
        + f" THEN {_quoted(name)} END"
        for name, pattern in _patterns()
    )
    return f"""
WITH raw(nr, id, sentence) AS (VALUES {raw}),
cut AS (SELECT nr, id, list_filter({cut('sentence', WRAP[:2])}, lambda x: regexp_matches(lower(x), '[a-z0-9]')) AS parts FROM raw),
each AS (SELECT nr, id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
known AS (SELECT {key} AS sentence, arg_min(CASE WHEN n = 1 THEN id ELSE id || '/' || pos END, nr) AS id FROM each GROUP BY 1),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, {cut("coalesce(text, '')", WRAP)} AS parts FROM documents),
one AS (SELECT r, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM texts),
spdx(tag, name) AS (VALUES {spdx}),
lines AS (SELECT r, unnest(regexp_extract_all(text, {_quoted(TAG)}, 1)) AS line FROM texts),
tags AS (SELECT r, unnest(regexp_extract_all(regexp_replace(line, {_quoted(EXCEPTION)}, '', 'g'), {_quoted(IDENTIFIER)})) AS tag FROM lines),
tagged AS (SELECT r, list(DISTINCT name) AS names FROM tags JOIN spdx USING (tag) GROUP BY r),
ids AS (SELECT r, o.doc_id, regexp_replace({joined}, '{LEFT_OVER}', '', 'g') AS ids
        FROM (SELECT r, doc_id, pos, {key} AS sentence FROM one) o LEFT JOIN known k ON o.sentence = k.sentence GROUP BY r, o.doc_id),
found AS (SELECT doc_id, coalesce(nullif(ids, ''), ' ') AS sentence_ids, coalesce(names, []) AS names FROM ids LEFT JOIN tagged USING (r)),
ruled AS (SELECT doc_id, sentence_ids, names, CASE WHEN sentence_ids = ' ' THEN [] ELSE list_filter([{hits}], lambda x: x IS NOT NULL) END AS hits FROM found)
SELECT doc_id, len(regexp_extract_all(sentence_ids, '[^ ]+'))::BIGINT AS n_known, sentence_ids,
       array_to_string(list_sort(list_distinct(list_concat(hits, names))), ';') AS licenses
FROM ruled
"""
