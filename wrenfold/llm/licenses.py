"""Licence recognition by sentences and rules.

A text is cut into sentences; each is normalised (lower case; runs of other signs become one space) and looked up
among known licence sentences; the identifiers, in text order, are then matched against ordered rules.  A rule takes a
run of adjoining identifiers away, so an earlier, more specific rule (a whole MIT text) leaves nothing for a later
one; identifiers that no rule takes are reported as left over.

A sentence ends at its sign (``. ! ? ; :``) before white space or the end, and at a line without a letter or digit;
so an empty line ends it also behind a comment leader.  A line break alone may be the end of a title or just a wrap:
of the lines between two ends, those from any line to the end, from the first line to any other, and each line by
itself are looked up, the longest first, and what begins inside a found one is not (``MOST_LINES``: a sentence is
wrapped over at most so many lines).  A line with ``SPDX-License-Identifier:`` is a sentence of its own.

All tables are constants of bounded size; all work is built-in functions, row by row, without a shuffle.
Cases: null and empty texts have no sentences; a sentence that repeats is named each time, a licence once;
null ids and repeated rows are carried along; very long texts are cut like any other; an empty table gives
an empty result; bytes that are not UTF-8 are signs like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LINES = 64
END = "\x1e"
SPDX_LINE = r"(?i)SPDX-License-Identifier:[ \t]*([^\n\x1e]*)"
SENTENCE_END = r"[.!?;:]+[ \t\n]+|[.!?;:]+$"
#: Some word of every known sentence: a text without any of them has none, and is not looked into.
TELLING = ("licen", "permission", "redistribut", "warrant", "liable", "copyright", "rights", "domain", "spdx", "disclaim", "profits", "interruption", "software", "program", "gpl", "mpl", "released", "distributed", "available")

# Licence -> how a text calls it, normalised.
NAMES = {
    "MIT": ("mit license", "mit licence"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "ISC": ("isc license",),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0", "gpl v2", "gplv2"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3 0", "gpl v3", "gplv3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "lgpl v2 1", "lgplv2 1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "lgpl v3", "lgplv3"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "agpl v3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 license", "creative commons zero v1 0 universal license"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
}
# What stands before such a name.
LEADS = ("licensed under", "released under", "distributed under", "available under", "this project is licensed under", "this work is licensed under", "this software is licensed under", "this file is licensed under")
# Names that are titles of licence texts, too.
TITLES = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense")

# Identifiers of SPDX that a line may name.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL",
    "Python-2.0", "Unlicense", "UPL-1.0", "WTFPL", "X11", "Zlib", "MIT OR Apache-2.0", "Apache-2.0 OR MIT", "GPL-2.0-only OR MIT", "GPL-2.0 WITH Linux-syscall-note", "GPL-2.0-only WITH Linux-syscall-note",
)
# Identifiers that SPDX has renamed.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only", "GPL-2.0 WITH Linux-syscall-note": "GPL-2.0-only WITH Linux-syscall-note"}

# Normalised sentences of licence texts and of the notices they ask for -> identifier.
TEXTS = {
    "the mit license": "MITtitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDasis",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BSDliability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BSDliability",
    "loss of use data or profits": "BSDlosses",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSDinterruption",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSDgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCasis",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISCliability",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2use",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "https www apache org licenses license 2 0": "ApacheUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this program is free software": "FreeSoftware",
    "this library is free software": "FreeSoftware",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "this library is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPLimplied",
    "if not see https www gnu org licenses": "GPLurl",
    "if not see http www gnu org licenses": "GPLurl",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2ref",
    "this is free and unencumbered software released into the public domain": "UnlicenseRef",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseGrant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0ref",
    "this software is provided as is without any express or implied warranty": "ZlibAsis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "boost software license version 1 0 august 17th 2003": "BSLtitle",
    "do what the fuck you want to public license": "WTFPLtitle",
    "all rights reserved": "Reserved",
}

# Family of the GNU licences -> (its name in a notice, the versions that exist).
GNU = {"GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2 1", "3")), "AGPL": ("gnu affero general public license", ("3",))}


def _short(licence: str) -> str:
    return "".join(c for c in licence if c.isalnum())


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def _gnu() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """The sentences of the GNU notices and the rules for them: joined by a comma or cut by a semicolon, the warranty paragraphs there or not."""
    known, rules = {}, []
    for family, (name, versions) in GNU.items():
        terms = f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
        known[terms] = f"{family}terms"
        known[f"see the {name} for more details"] = f"{family}see"
        for what in ("program", "library"):
            known[f"you should have received a copy of the {name} along with this {what}"] = f"{family}copy"
        tails = [("GPLhope", "GPLimplied", f"{family}see", f"{family}copy", "GPLurl"), ("GPLhope", "GPLimplied", f"{family}see", f"{family}copy"), ("GPLhope", "GPLimplied", f"{family}see"), ()]
        for version in versions:
            number = version.replace(" ", ".") + ("" if " " in version else ".0")
            for later, ending in ((f"either version {version} of the license or at your option any later version", "or-later"), (f"version {version} of the license", "only")):
                key = _short(f"{version}{ending}")
                known[later] = f"Version{key}"
                known[f"{terms} {later}"] = f"{family}terms{key}"
                for tail in tails:
                    rules += [(f"{family}-{number}-{ending}", ("FreeSoftware", f"{family}terms{key}", *tail)), (f"{family}-{number}-{ending}", ("FreeSoftware", f"{family}terms", f"Version{key}", *tail))]
    return known, rules


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """All known sentences, and the rules in the order they are tried."""
    gnu, gnu_rules = _gnu()
    known = TEXTS | gnu
    for licence, names in NAMES.items():
        for name in names:
            known |= {f"{lead}{the}{name}": f"{_short(licence)}ref" for lead in LEADS for the in (" ", " the ", " a ")}
            if licence in TITLES:
                known |= {f"{the}{name}": f"{_short(licence)}title" for the in ("", "the ")}
    known |= {f"spdxid {_plain(x)}": f"{_short(SPDX_OLD.get(x, x))}spdx" for x in (*SPDX, *SPDX_OLD)}
    rules = [
        *[("MIT", (*title, "MITgrant", "MITnotice", *tail)) for title in (("MITtitle",), ()) for tail in (("MITasis", "MITliability"), ())],
        *[("BSD-3-Clause", (*title, "BSDgrant", "BSDsource", "BSDbinary", "BSDname", *tail)) for title in (("BSD3Clausetitle",), ()) for tail in (("BSDasis", "BSDliability", "BSDlosses", "BSDinterruption"), ())],
        *[("BSD-2-Clause", (*title, "BSDgrant", "BSDsource", "BSDbinary", *tail)) for title in (("BSD2Clausetitle",), ()) for tail in (("BSDasis", "BSDliability", "BSDlosses", "BSDinterruption"), ())],
        *[("ISC", (*title, "ISCgrant", *tail)) for title in (("ISCtitle",), ()) for tail in (("ISCasis", "ISCliability"), ())],
        *[("0BSD", ("0BSDgrant", *tail)) for tail in (("ISCasis", "ISCliability"), ())],
        *[("Apache-2.0", ("Apache2ref", "Apache2use", "ApacheCopy", *url, *tail)) for url in (("ApacheUrl",), ()) for tail in (("ApacheAsis", "ApacheSee"), ())],
        ("Zlib", ("ZlibAsis", "ZlibLiability", "ZlibGrant")),
        *gnu_rules,
        ("MPL-2.0", ("MPL2ref", "MPL2copy")), ("MPL-2.0", ("MPL2ref",)), ("EPL-2.0", ("EPL2ref",)),
        *[("Unlicense", (*title, "UnlicenseRef", *tail)) for title in (("Unlicensetitle",), ()) for tail in (("UnlicenseGrant",), ())],
        ("CC0-1.0", ("CC0ref",)), ("BSL-1.0", ("BSLtitle",)), ("WTFPL", ("WTFPLtitle",)), ("Apache-2.0", ("Apache2ref",)),
        *[(x, (f"{_short(x)}ref",)) for x in NAMES], *[(x, (f"{_short(x)}title",)) for x in TITLES], *[(x, (f"{_short(x)}spdx",)) for x in dict.fromkeys(SPDX_OLD.get(x, x) for x in SPDX)],
    ]
    return known, rules


SENTENCES, RULES = _tables()
#: Licences whose texts may not go into a training set that is to be shared freely.
RESTRICTED = ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
if lost := [s for s in SENTENCES if not any(w in s for w in TELLING)]:
    raise AssertionError(f"no telling word in {lost}")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once, however often it occurs."""
    return F.transform(F.array(value), use)[0]


def sentences(text: Column) -> Column:
    """For each stretch between two ends its lines, normalised."""
    told = F.when(text.rlike("(?i)" + "|".join(TELLING)), text).otherwise("")
    marked = F.regexp_replace(F.regexp_replace(told, "\\r\\n?", "\n"), SPDX_LINE, f"{END}spdxid $1{END}")
    parts = F.split(F.regexp_replace(marked, SENTENCE_END, END), END)
    lines = F.transform(parts, lambda s: F.array_join(F.transform(F.split(s, "\n"), normalised), "\n"))  # a line without a letter or digit is now empty
    stretches = F.flatten(F.transform(lines, lambda s: F.split(s, "\n\n+")))
    return F.filter(F.transform(stretches, lambda s: F.filter(F.split(s, "\n"), lambda x: x != "")), lambda x: F.size(x) > 0)


def identifiers(text: Column) -> Column:
    """The identifiers of known sentences, in text order."""
    table = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    known = lambda s: F.try_element_at(table, s)
    found = lambda i, j, x: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), known(x).alias("x"))
    hit = lambda m: m["x"].isNotNull()

    def of(lines: Column) -> Column:
        k = F.size(lines)
        join = lambda a, n: F.array_join(F.slice(lines, a, n), " ")
        heads = F.when(k > 1, F.filter(F.transform(F.sequence(F.least(k - 1, F.lit(MOST_LINES)), F.lit(1), F.lit(-1)), lambda j: found(F.lit(1), j, join(1, j))), hit))
        tail = lambda i: F.filter(F.array(found(i, k, F.when(i > k - MOST_LINES, join(i, k - i + 1)))), hit)
        line = lambda i: F.filter(F.array(found(i, i, F.element_at(lines, i))), hit)
        first = lambda i: F.try_element_at(F.concat(tail(i), F.when(i == 1, F.coalesce(heads, F.array().cast("array<struct<i:int,j:int,x:string>>"))).otherwise(line(i))), F.lit(1))
        every = F.filter(F.transform(F.sequence(F.lit(1), k), first), lambda m: m.isNotNull())
        return _bound(every, lambda ms: F.filter(ms, lambda m: ~F.exists(ms, lambda n: (n["i"] < m["i"]) & (n["j"] >= m["i"]))))

    return F.transform(F.flatten(F.transform(sentences(text), of)), lambda m: m["x"])


def recognise(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), identifiers, licences (sorted, comma-joined), left_over, restricted."""
    ids = docs.select(F.col("doc_id").cast("long"), identifiers(F.coalesce(F.col("text"), F.lit(""))).alias("ids"))
    start = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("seq"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_run(run)).alias("run")) for name, run in RULES])
    taken = lambda s, r: F.when(F.contains(s["seq"], r["run"]), F.struct(F.replace(s["seq"], r["run"], F.lit("|")).alias("seq"), F.array_append(s["found"], r["name"]).alias("found"))).otherwise(s)
    rows = ids.withColumn("end", F.when(F.size("ids") > 0, F.aggregate(rules, start, taken)).otherwise(start))
    licences = F.array_sort(F.array_distinct("end.found"))
    left = F.regexp_replace(F.trim(F.replace("end.seq", F.lit("|"), F.lit(" "))), " +", ",")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("identifiers"), F.array_join(licences, ",").alias("licences"), left.alias("left_over"), F.arrays_overlap(licences, F.array(*map(F.lit, RESTRICTED))).alias("restricted")
    )


def _run(identifiers: tuple[str, ...]) -> str:
    return "".join(f" {x} " for x in identifiers)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same in DuckDB."""
    table = "map([" + ", ".join(map(_quoted, SENTENCES)) + "], [" + ", ".join(map(_quoted, SENTENCES.values())) + "])"
    rules = "[" + ", ".join(f"{{'a': {_quoted(_run(run))}, 'b': [{_quoted(name)}]}}" for name, run in RULES) + "]"
    join = lambda lo, hi: f"array_to_string(l[{lo}:{hi}], ' ')"
    hit = lambda i, j, x: f"{{'i': CAST({i} AS BIGINT), 'j': CAST({j} AS BIGINT), 'x': t[{x}]}}"
    return f"""
WITH told AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i){"|".join(TELLING)}') THEN text ELSE '' END AS text FROM documents),
marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '{SPDX_LINE}', chr(30) || 'spdxid \\1' || chr(30), 'g') AS text FROM told),
parts AS (SELECT doc_id, string_split(regexp_replace(text, '{SENTENCE_END}', chr(30), 'g'), chr(30)) AS p FROM marked),
lines AS (SELECT doc_id, list_transform(p, lambda s: array_to_string(list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), chr(10))) AS p FROM parts),
cut AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(p, lambda s: string_split_regex(s, '\\n\\n+'))), lambda s: list_filter(string_split(s, chr(10)), lambda x: x <> '')), lambda x: len(x) > 0) AS ls, {table} AS t FROM lines),
hits AS (SELECT doc_id, list_transform(ls, lambda l: list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > len(l) - {MOST_LINES} AND t[{join("i", "len(l)")}] IS NOT NULL THEN {hit("i", "len(l)", join("i", "len(l)"))}
  WHEN i = 1 THEN (list_filter(list_transform(range(least(len(l) - 1, {MOST_LINES}), 0, -1), lambda j: {hit("1", "j", join("1", "j"))}), lambda m: m.x IS NOT NULL))[1] WHEN t[l[i]] IS NOT NULL THEN {hit("i", "i", "l[i]")} END), lambda m: m IS NOT NULL)) AS mss FROM cut),
named AS (SELECT doc_id, list_transform(flatten(list_transform(mss, lambda ms: list_filter(ms, lambda m: len(list_filter(ms, lambda n: n.i < m.i AND n.j >= m.i)) = 0))), lambda m: m.x) AS ids FROM hits),
ruled AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS identifiers,
  list_reduce(list_prepend({{'a': ' ' || coalesce(array_to_string(ids, '  '), '') || ' ', 'b': CAST([] AS VARCHAR[])}}, {rules}), lambda s, r: CASE WHEN contains(s.a, r.a) THEN {{'a': replace(s.a, r.a, '|'), 'b': list_concat(s.b, r.b)}} ELSE s END) AS e FROM named),
f AS (SELECT *, list_sort(list_distinct(e.b)) AS l FROM ruled)
SELECT doc_id, n_sentences, identifiers, coalesce(array_to_string(l, ','), '') AS licences, regexp_replace(trim(replace(e.a, '|', ' ')), ' +', ',', 'g') AS left_over, list_has_any(l, [{", ".join(map(_quoted, RESTRICTED))}]) AS restricted
FROM f"""
