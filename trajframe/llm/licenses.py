"""License scans: ordered signature rules behind a keyword prefilter.

A document's keywords choose the rules that are tried at all; a detection whose interval lies inside that of a
detection of better priority (or, at equal priority, of a longer or earlier one) is suppressed. One row in, one row out.

Defined results: a null text is empty: no words, no labels, score 0, null first and last word. Repeated rows give
repeated results. A column that has the result's name is replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import count_words, find_spans, read, run_of, runs_of, then, whole_text

#: A character of a word (before A-Z are lower-cased), and what stands between words. Listed one by one: Java tests a
#: list with one look-up and a union of ranges range by range.
_ASCII = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_W = rf"[{_ASCII}\x{{80}}-\x{{10FFFF}}]"
_GAP = rf"[^{_ASCII}\x{{80}}-\x{{10FFFF}}]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def phrase_pattern(phrase: str) -> str:
    return rf"(?i)(?<!{_W}){_GAP.join(phrase.split())}(?!{_W})"


def _v(version: str) -> str:
    """A version as a pattern: 2.0 also matches 2."""
    major, minor = version.split(".")
    return rf"{major}(?:\.0)?(?![.0-9]*[1-9])" if minor == "0" else rf"{major}\.{minor}"


#: Fixed values: (label, keyword, signature) from the texts of licenses themselves; a blank stands for any white space.
BODIES = (
    ("mit", "the above copyright", r"The above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "without restriction", r"deal in the Software without restriction, including without limitation the rights to use"),
    ("bsd", "redistributions", r"Redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"Redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", r"Neither the names? of .{1,80}? nor the names of (?:its|the) contributors may be used to endorse"),
    ("bsd-4-clause", "all advertising", r"All advertising materials mentioning features or use of this software must display"),
    ("isc", "the software is provided", r"THE SOFTWARE IS PROVIDED \"AS IS\" AND (?:THE AUTHOR|ISC) DISCLAIMS ALL WARRANTIES"),
    ("zlib", "altered source", r"Altered source versions must be plainly marked as such"),
    ("zlib", "the origin of", r"The origin of this software must not be misrepresented"),
    ("apache-2.0", "you may not use", r"you may not use this file except in compliance with the License"),
    ("apache-2.0", "each contributor", r"each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"),
    ("apache", "licensed under the apache", r"Licensed under the Apache License"),
    ("gpl", "you can redistribute", r"you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "you can redistribute", r"you can redistribute it and/or modify it under the terms of the GNU (?:Lesser|Library) General Public License"),
    ("agpl", "you can redistribute", r"you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("gpl", "without even the", r"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-or-later", "any later version", r"(?:either )?version [0-9.]+ of the License,? or (?:\(at your option\) )?any later version"),
    ("gpl", "everyone is permitted", r"Everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-exception", "special exception", r"As a special exception, .{0,80}?(?:permission|you may|the copyright holders)"),
    ("gpl-classpath-exception", "classpath exception", r"Classpath exception"),
    ("gcc-exception", "gcc runtime", r"GCC Runtime Library Exception"),
    ("mpl-2.0", "this source code form", r"This Source Code Form is subject to the terms of the Mozilla Public License, v\. 2\.0"),
    ("mpl-1.1", "the contents of this file", r"The contents of this file are subject to the Mozilla Public License Version 1\.1"),
    ("cddl", "the contents of this file", r"The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("epl", "this program and the", r"This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("unlicense", "this is free and", r"This is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible", r"To the extent possible under law, .{1,80}? has waived all copyright and related or neighboring rights"),
    ("cc0", "the person who", r"The person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-sa", "if you remix", r"If you remix, transform, or build upon the material, you must distribute your contributions under the same license"),
    ("wtfpl", "you just do what", r"You just DO WHAT THE FUCK YOU WANT TO"),
    ("bsl", "boost software", r"Distributed under the Boost Software License"),
    ("ofl", "reserved font name", r"with Reserved Font Name"),
    ("ofl", "the font software", r"The Font Software may be sold as part of a larger software package"),
    ("postgresql", "postgresql license", r"PostgreSQL Licen[cs]e"),
    ("beerware", "beer ware", r"THE BEER-WARE LICENSE"),
    ("json", "shall be used for good", r"The Software shall be used for Good, not Evil"),
    ("artistic", "distribute this package", r"distribute this Package.{0,40}? Artistic License"),
    ("perl", "same terms as perl", r"under the same terms as Perl itself"),
    ("python", "psf license", r"PSF LICENSE AGREEMENT FOR PYTHON"),
    ("dual", "dual licensed", r"dual[\s-]licensed under"),
    ("dual", "at your option", r"at your option, under (?:either|the terms of)"),
    ("sspl", "server side public", r"Server Side Public License"),
    ("busl", "business source", r"Business Source License"),
    ("elastic", "elastic license", r"Elastic License"),
    ("commons-clause", "commons clause", r"Commons Clause"),
    ("polyform", "polyform", r"PolyForm (?:Noncommercial|Small Business|Shield|Perimeter|Strict)"),
    ("openrail", "openrail", r"OpenRAIL(?:-[MDS])?"),
    ("spdx-url", "spdx.org", r"spdx\.org/licenses/[A-Za-z0-9.-]+"),
    ("osi-url", "opensource.org", r"opensource\.org/licenses?/[A-Za-z0-9.-]+"),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit"),
    ("bsd", "opensource.org", r"opensource\.org/licenses?/bsd"),
    ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("no-redistribution", "no part of this", r"No part of this .{1,40}? may be reproduced"),
    ("no-redistribution", "reproduction prohibited", r"reproduction prohibited"),
    ("trade-secret", "trade secret", r"contains (?:confidential|proprietary) (?:[a-z]+ ){0,5}?trade secrets?"),
)


def _rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, pattern, strength), the best priority first.

    1: machine-readable tags and addresses; 2: full names with a version; 3: abbreviations with a version;
    4: names without a version; 5: general reservations. Families times versions give some 250 rules.
    """
    rules: list[tuple[int, str, str, str, float]] = []

    def add(priority, label, keyword, pattern, strength):
        rules.append((priority, label, keyword.replace("-", " "), rf"(?i)(?<![a-z0-9])(?:{pattern})(?![a-z0-9])", strength))

    gnu = {
        "gpl": (r"General\s+Public\s+Licen[cs]e", "general public", ("1.0", "2.0", "3.0")),
        "lgpl": (r"(?:Lesser|Library)\s+General\s+Public\s+Licen[cs]e", "general public", ("2.0", "2.1", "3.0")),
        "agpl": (r"Affero\s+General\s+Public\s+Licen[cs]e", "general public", ("1.0", "3.0")),
        "gfdl": (r"Free\s+Documentation\s+Licen[cs]e", "free documentation", ("1.1", "1.2", "1.3")),
    }
    for name, (full, keyword, versions) in gnu.items():
        for v in versions:
            add(1, f"{name}-{v}", "spdx", rf"SPDX-License-Identifier:\s*{name}-{v}(?:-only|-or-later|\+)?", 1.0)
            add(1, f"{name}-{v}", "gnu.org", rf"gnu\.org/(?:old-)?licenses/(?:old-licenses/)?{name}-{v}", 1.0)
            add(2, f"{name}-{v}", keyword, rf"(?:GNU\s+)?{full},?\s+(?:as\s+published.{{0,60}}?)?(?:version|v\.?)\s*{_v(v)}", 0.95)
            add(3, f"{name}-{v}", name, rf"{name}[\s-]?v?{_v(v)}", 0.8)
        add(4, name, keyword, rf"(?:GNU\s+)?{full}", 0.8)
        add(4, name, name, rf"(?:GNU\s+){name}", 0.6)
    creative = {
        "by": r"Attribution",
        "by-sa": r"Attribution[\s-]+Share\s?Alike",
        "by-nd": r"Attribution[\s-]+No\s?Deriv(?:ative)?s?",
        "by-nc": r"Attribution[\s-]+Non-?Commercial",
        "by-nc-sa": r"Attribution[\s-]+Non-?Commercial[\s-]+Share\s?Alike",
        "by-nc-nd": r"Attribution[\s-]+Non-?Commercial[\s-]+No\s?Deriv(?:ative)?s?",
    }
    for code, full in creative.items():
        short = code.replace("-", r"[\s-]")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(1, f"cc-{code}-{v}", "spdx", rf"SPDX-License-Identifier:\s*CC-{code}-{v}", 1.0)
            add(1, f"cc-{code}-{v}", "creativecommons", rf"creativecommons\.org/licenses/{code}/{v}", 1.0)
            add(2, f"cc-{code}-{v}", "creative commons", rf"Creative\s+Commons\s+{full}\s+{_v(v)}", 0.95)
            add(3, f"cc-{code}-{v}", "cc by", rf"CC[\s-]{short}[\s-]?v?{_v(v)}", 0.9)
        add(4, f"cc-{code}", "creative commons", rf"Creative\s+Commons\s+{full}", 0.8)
        add(4, f"cc-{code}", "cc by", rf"CC[\s-]{short}", 0.7)
    versioned = {
        "apache": (r"Apache\s+(?:Software\s+)?Licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
        "mpl": (r"Mozilla\s+Public\s+Licen[cs]e", "mozilla public", ("1.0", "1.1", "2.0")),
        "epl": (r"Eclipse\s+Public\s+Licen[cs]e", "eclipse public", ("1.0", "2.0")),
        "cddl": (r"Common\s+Development\s+and\s+Distribution\s+Licen[cs]e", "common development", ("1.0", "1.1")),
        "eupl": (r"European\s+Union\s+Public\s+Licen[cs]e", "european union public", ("1.0", "1.1", "1.2")),
        "artistic": (r"Artistic\s+Licen[cs]e", "artistic license", ("1.0", "2.0")),
        "bsl": (r"Boost\s+Software\s+Licen[cs]e", "boost software", ("1.0",)),
        "ofl": (r"(?:SIL\s+)?Open\s+Font\s+Licen[cs]e", "open font", ("1.0", "1.1")),
        "afl": (r"Academic\s+Free\s+Licen[cs]e", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        "osl": (r"Open\s+Software\s+Licen[cs]e", "open software", ("1.0", "2.0", "2.1", "3.0")),
        "cpl": (r"Common\s+Public\s+Licen[cs]e", "common public", ("1.0",)),
        "lppl": (r"LaTeX\s+Project\s+Public\s+Licen[cs]e", "latex project", ("1.0", "1.2", "1.3")),
        "zpl": (r"Zope\s+Public\s+Licen[cs]e", "zope public", ("2.0", "2.1")),
        "odbl": (r"Open\s+Data(?:base)?\s+(?:Commons\s+)?(?:Open\s+Database\s+)?Licen[cs]e", "open data", ("1.0",)),
        "php": (r"PHP\s+Licen[cs]e", "php license", ("3.0",)),
        "psf": (r"Python\s+Software\s+Foundation\s+Licen[cs]e", "python software", ("2.0",)),
        "ms-pl": (r"Microsoft\s+Public\s+Licen[cs]e", "microsoft public", ("1.0",)),
    }
    for name, (full, keyword, versions) in versioned.items():
        for v in versions:
            add(1, f"{name}-{v}", "spdx", rf"SPDX-License-Identifier:\s*{name}-{v}", 1.0)
            add(2, f"{name}-{v}", keyword, rf"{full},?\s+(?:\(?the\s+\"License\"\)?,?\s+)?(?:version|v\.?)?\s*{_v(v)}", 0.95)
            if name not in ("psf", "php", "bsl", "ofl"):
                add(3, f"{name}-{v}", name, rf"{name}[\s-]v?{_v(v)}", 0.7)
        add(4, name, keyword, full, 0.8)
    add(1, "apache-2.0", "apache", r"apache\.org/licenses/LICENSE-2\.0", 1.0)
    plain = {
        "mit": ("mit license", r"MIT\s+Licen[cs]e"),
        "isc": ("isc license", r"ISC\s+Licen[cs]e"),
        "zlib": ("zlib", r"zlib(?:/libpng)?\s+Licen[cs]e"),
        "unlicense": ("unlicense", r"(?:The\s+)?Unlicense"),
        "wtfpl": ("wtfpl", r"WTFPL"),
        "cc0": ("cc0", r"CC0(?:[\s-]1\.0)?"),
        "ncsa": ("ncsa", r"(?:University\s+of\s+Illinois/)?NCSA\s+(?:Open\s+Source\s+)?Licen[cs]e"),
        "x11": ("x11 license", r"X11\s+Licen[cs]e"),
        "openssl": ("openssl license", r"OpenSSL\s+Licen[cs]e"),
        "vim": ("vim license", r"Vim\s+Licen[cs]e"),
        "ruby": ("ruby license", r"Ruby\s+Licen[cs]e"),
        "w3c": ("w3c software", r"W3C\s+Software(?:\s+Notice\s+and)?\s+Licen[cs]e"),
    }
    for label, (keyword, pattern) in plain.items():
        add(1, label, "spdx", rf"SPDX-License-Identifier:\s*{label}", 1.0)
        add(3, label, keyword, pattern, 0.9)
    for n, word in (("0", "zero"), ("2", "two"), ("3", "three"), ("4", "four")):
        add(1, f"bsd-{n}-clause", "spdx", rf"SPDX-License-Identifier:\s*(?:0BSD|BSD-{n}-Clause)" if n == "0" else rf"SPDX-License-Identifier:\s*BSD-{n}-Clause", 1.0)
        add(3, f"bsd-{n}-clause", "bsd", rf"(?:{n}|{word})[\s-]clause\s+BSD|BSD\s+(?:{n}|{word})[\s-]clause", 0.9)
    add(4, "bsd", "bsd", r"BSD(?:[\s-]style)?\s+Licen[cs]e", 0.8)
    add(3, "mit", "permission is hereby", r"Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 0.95)
    add(3, "isc", "permission to use", r"Permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software", 0.95)
    add(3, "bsd", "redistribution and use", r"Redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 0.95)
    for label, keyword, pattern in BODIES:
        add(3, label, keyword, r"\s+".join(pattern.split(" ")), 0.95)
    add(5, "reserved", "rights reserved", r"(?:All|Some)\s+rights\s+reserved", 0.4)
    add(5, "copyright", "copyright", r"Copyright\s+(?:\(c\)|©)?\s*(?:19|20)[0-9]{2}", 0.4)
    add(5, "public-domain", "public domain", r"(?:in|to|into)\s+the\s+public\s+domain", 0.4)
    add(5, "proprietary", "proprietary", r"proprietary\s+and\s+confidential|confidential\s+and\s+proprietary", 0.5)
    for keyword in ("noncommercial use", "non commercial use"):
        add(5, "non-commercial", keyword, r"non-?commercial\s+use\s+only", 0.4)
    return sorted(rules, key=lambda r: r[:3])


RULES = _rules()
#: One expression finds all keywords, as hits are normalised: hyphens and white space are a single space. A keyword is a literal that each
#: match of its rule holds, and nothing is asked of what follows it (GPLv3, Open Database), so the prefilter lets through all that a rule matches.
KEYWORDS = sorted({r[2] for r in RULES}, key=lambda k: (-len(k), k))
_AS_PATTERN = [k.replace(".", r"\.").replace(" ", r"[\s-]+").replace("license", "licen[cs]e") for k in KEYWORDS]
#: Alternatives by their first letter, so that most places fail after a few comparisons.
KEYWORD_PATTERN = r"(?i)(?<![a-z0-9])(?:" + "|".join(
    f"{c}(?:" + "|".join(k[1:] for k in _AS_PATTERN if k[0] == c) + ")" for c in sorted({k[0] for k in _AS_PATTERN})
) + ")"
PRIORITIES = 5
_FOUND = "array<struct<priority:int,length:int,start:int,end:int,label:string,strength:double>>"


def find_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """Adds the detections that survive suppression, as array<struct<priority,length,start,end,label,strength>>.

    ``length`` is negative, so that sorting puts the longer of two detections of one priority first.
    """
    text = whole_text(text_col)
    hits = F.array_distinct(
        F.transform(
            F.regexp_extract_all(text, F.lit(KEYWORD_PATTERN), F.lit(0)),
            lambda k: F.replace(F.regexp_replace(F.lower(k), r"[\s-]+", " "), F.lit("licence"), F.lit("license")),
        )
    )
    rules = F.from_json(
        F.lit(json.dumps([dict(zip(("priority", "label", "keyword", "pattern", "strength"), r, strict=True)) for r in RULES])),
        "array<struct<priority:int,label:string,keyword:string,pattern:string,strength:double>>",
    )
    # An array of one struct: its fields are evaluated once for a document, not once for each rule.
    once = F.array(F.struct(text.alias("text"), hits.alias("hits")))
    tried = lambda d: F.filter(rules, lambda r: F.array_contains(d["hits"], r["keyword"]))
    spans = lambda d, r: F.transform(
        find_spans(d["text"], r["pattern"]),
        lambda s: F.struct(
            r["priority"].alias("priority"),
            (s["start"] - s["end"]).alias("length"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            r["label"].alias("label"),
            r["strength"].alias("strength"),
        ),
    )
    found = F.flatten(F.flatten(F.transform(once, lambda d: F.transform(tried(d), lambda r: spans(d, r)))))
    return docs.withColumn(out_col, F.array_sort(unsuppressed(found)))


def unsuppressed(found: Column) -> Column:
    """The detections that don't lie inside another of better priority, nor of the same one and longer, or as long with a smaller label.

    In order of start, the longer first, a detection is inside an earlier one exactly if the furthest end so far, over all priorities up to
    its own, isn't before its end. Furthest ends are found for each run of detections first, then inside each run.
    """
    # Rows that are found twice are as long and of one label: the second goes.
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), d["length"].alias("length"), d["priority"].alias("priority"), d["label"].alias("label"), d.alias("d"))))
    nothing = F.array_repeat(F.lit(-1), PRIORITIES)

    def furthest(d: Column) -> Column:
        """For each run, the ends by priority over all runs before it."""
        one = lambda run, p: F.coalesce(F.array_max(F.transform(F.filter(run, lambda x: x["priority"] == p), lambda x: x["d"]["end"])), F.lit(-1))
        own = F.transform(runs_of(d["o"]), lambda r: F.transform(F.sequence(F.lit(1), F.lit(PRIORITIES)), lambda p: one(run_of(d["o"], r), p)))
        first = F.struct(nothing.alias("ends"), F.array().cast("array<array<int>>").alias("out"))
        merged = lambda acc, x: F.struct(F.zip_with(acc["ends"], x, lambda a, b: F.greatest(a, b)).alias("ends"), F.concat(acc["out"], F.array(acc["ends"])).alias("out"))
        return F.aggregate(own, first, merged, lambda acc: acc["out"])

    def kept(d: Column, ends: Column, run: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            covered = F.array_max(F.slice(acc["ends"], F.lit(1), x["priority"])) >= x["d"]["end"]
            ends = F.transform(acc["ends"], lambda e, i: F.when(i == x["priority"] - 1, F.greatest(e, x["d"]["end"])).otherwise(e))
            return F.struct(ends.alias("ends"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(x["d"]))).alias("out"))

        return F.aggregate(run_of(d["o"], run), F.struct(ends.alias("ends"), F.array().cast(_FOUND).alias("out")), step, lambda acc: acc["out"])

    placed = then(F.array(F.struct(order.alias("o"))), ends=furthest)
    return F.flatten(F.flatten(F.transform(placed, lambda e: F.transform(e["ends"], lambda ends, run: kept(e["d"], ends, run)))))


def base_places(text: Column) -> Column:
    """array<struct<label,n,first,from_end>> of the base phrases that a text holds: how often, the words before the
    first place, the words from the start of the last place to the end."""
    phrases = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(phrase_pattern(p)).alias("pattern"), F.lit(len(p.split())).alias("words")) for p, label in BASE))
    # The last two words of each phrase are looked for first, without their boundaries.
    any_phrase = "|".join(_GAP.join(p.split()[-2:]) for p, _ in BASE)
    cut = F.transform(phrases, lambda p: F.struct(p.alias("p"), F.split(text, p["pattern"], -1).alias("gaps")))
    found = F.transform(
        F.filter(cut, lambda c: F.size(c["gaps"]) > 1),
        lambda c: F.struct(
            c["p"]["label"].alias("label"),
            (F.size(c["gaps"]) - 1).cast("long").alias("n"),
            count_words(F.element_at(c["gaps"], 1), _W + "+").alias("first"),
            (count_words(F.element_at(c["gaps"], -1), _W + "+") + c["p"]["words"]).alias("from_end"),
        ),
    )
    none = F.array().cast("array<struct<label:string,n:bigint,first:bigint,from_end:bigint>>")
    return F.when(F.regexp_like(text, F.lit("(?i)" + any_phrase)), found).otherwise(none)


def op3_licenses(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = whole_text("text")
    docs = find_licenses(docs).withColumn("n_words", count_words(text, _W + "+")).withColumn("places", base_places(text))
    places = F.col("places")
    base = F.array_sort(F.transform(places, lambda p: p["label"]))
    found = F.transform("licenses", lambda d: d["label"])
    strength = F.array_max(F.transform("licenses", lambda d: d["strength"]))
    return docs.select(
        "doc_id",
        "n_words",
        F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc + p["n"]).alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["first"])).alias("first_word"),
        (F.col("n_words") - F.array_min(F.transform(places, lambda p: p["from_end"]))).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, found))), ",").alias("labels"),
        F.greatest(F.coalesce(strength, F.lit(0.0)), F.when(F.size(base) > 0, 0.4).otherwise(0.0)).alias("score"),
    )
