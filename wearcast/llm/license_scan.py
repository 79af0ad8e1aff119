"""License scans: sentence-rule recognition, DataFrame operations only.

A text is cut into pieces (at line ends and behind . ! ? ; : before white
space), each is normalised (A-Z lower-cased, all but a-z and 0-9 one space),
and known licence sentences become identifiers.  A known sentence stands from
the start of a piece to the end of the same or a later one: it may be wrapped
over lines, with comment marks before them, but not over a blank line, and it
may be cut where it has such a cut itself.  Where several sentences start, the
longest is taken; a sentence whose parts are all known gives those of its parts.
The row of a text's identifiers, unknown sentences left out, is matched against ordered rules: a
rule is a row of adjacent identifiers; rules are tried in order, what a rule
matches is taken out, and what no rule takes stays as unmatched.

Texts without any of the words that every known sentence has at least one of
(ANCHORS; checked when the tables are built) are not cut up: they cannot match.
All is one projection: no shuffle, and each task holds one text at a time.

Null and empty texts have no sentences.  Repeated rows are scanned each for
itself; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licence texts and references, by identifier
SENTENCES = {
    "apache2-ref": ["Licensed under the Apache License, Version 2.0.",
                    "Licensed under the Apache License, Version 2.0 (the \"License\")",
                    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache2-compliance": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "The MIT License (MIT)", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "GNU General Public License version 3"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program."],
    "gpl2-ref": ["This work is licensed under the GNU General Public License, version 2."],
    "lgpl-ref": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-ref": ["Released under the BSD License.", "Licensed under the BSD License."],
    "mpl2-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by-ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-ref": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under the CC0 1.0 Universal license."],
    "all-rights": ["All rights reserved."],
}
# ordered: full texts before their parts, parts before bare references
RULES = [
    ("MIT", ["mit-ref", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-ref", "apache2-compliance", "apache2-copy", "apache2-asis"]),
    ("Apache-2.0", ["apache2-ref", "apache2-copy", "apache2-asis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("MIT", ["mit-ref"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("LGPL-3.0", ["lgpl-ref"]),
    ("BSD", ["bsd-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("Proprietary", ["all-rights"]),
]
ANCHORS = ["licen", "reserved", "permi", "warrant", "redistribut", "copyright"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUT, BREAK = r"([.!?;:])[ \t\r\n]+", "\n"
WRAP, END = "\n", "\x02"      # in a normalised text: an end of line, and a cut or a blank line


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def known(sentences: dict[str, list[str]]) -> dict[str, str]:
    """Identifier by normalised sentence; the sentences are cut as texts are."""
    table = {}
    for name, variants in sentences.items():
        for v in variants:
            parts = [n for p in re.sub(CUT, r"\1" + BREAK, v).split(BREAK) if (n := normalise(p))]
            table[parts[0] if len(parts) == 1 else normalise(v)] = name
    missing = [s for s in table if not any(a in s for a in ANCHORS)]
    if missing:
        raise ValueError(f"sentences without an anchor word: {missing}")
    return table


def finder(sentences: dict[str, list[str]]) -> str:
    """Pattern of all known sentences in a text of `normalised`, the longest first."""
    cut = {}
    for v in (v for variants in sentences.values() for v in variants):
        parts = [n for p in re.sub(CUT, r"\1" + BREAK, v).split(BREAK) if (n := normalise(p))]
        cut[" ".join(parts)] = parts
    rows = []
    for whole, parts in cut.items():
        between = " " if len(parts) > 1 and all(p in cut for p in parts) else f"[ {WRAP}{END}]"
        rows.append((len(whole), between.join(p.replace(" ", f"[ {WRAP}]") for p in parts)))
    return f"(?<=[{WRAP}{END}])(?:" + "|".join(p for _, p in sorted(rows, reverse=True)) + f")(?=[{WRAP}{END}])"


def normalised(text: Column) -> Column:
    """The normalised text in a frame of END; its pieces are parted by WRAP or END."""
    cut = F.regexp_replace(F.translate(text, END, "-"), CUT, f"$1{END}")
    plain = F.regexp_replace(F.translate(cut, UPPER, LOWER), f"[^a-z0-9{WRAP}{END}]+", " ")
    ends = F.regexp_replace(F.concat(F.lit(END), plain, F.lit(END)), f"[ {WRAP}]*(?:{END}|{WRAP}[ {WRAP}]*{WRAP})[ {WRAP}{END}]*", END)
    return F.regexp_replace(ends, f" ?{WRAP} ?", WRAP)


def scan(docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(doc_id, n_sentences, identifiers, licenses, unmatched): known sentences
    found, their identifiers in order, the licences whose rules matched in
    order of the rules, and the identifiers that no rule took; comma-joined."""
    table = known(sentences)
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    lower = F.lower(F.col("text"))
    may = F.lit(False)
    for a in ANCHORS:
        may = may | F.contains(lower, F.lit(a))
    matches = F.regexp_extract_all(normalised(F.col("text")), F.lit(finder(sentences)), F.lit(0))
    ids = F.transform(matches, lambda s: F.element_at(lookup, F.translate(s, WRAP + END, "  ")))
    found = docs.select("doc_id", F.when(may, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    found = found.select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    rest = F.concat(F.lit(","), F.array_join(F.col("ids"), ",,"), F.lit(","))
    seq = found.withColumn("rest", F.when(F.size("ids") > 0, rest).otherwise(""))
    hits = F.struct(F.col("rest").alias("rest"), F.lit("").alias("licenses"))
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(ids) + ",").alias("ids")) for name, ids in rules])
    hits = F.aggregate(rows, hits, lambda acc, r: F.when(
        F.contains(acc["rest"], r["ids"]),
        F.struct(F.replace(acc["rest"], r["ids"], F.lit(";")).alias("rest"),
                 F.when(F.contains(F.concat(F.lit(","), acc["licenses"], F.lit(",")), F.concat(F.lit(","), r["name"], F.lit(","))), acc["licenses"])
                 .when(acc["licenses"] == "", r["name"]).otherwise(F.concat(acc["licenses"], F.lit(","), r["name"])).alias("licenses"))).otherwise(acc))
    left = F.trim(F.regexp_replace("hits.rest", "[,;]+", " "))
    return seq.withColumn("hits", F.when(F.size("ids") > 0, hits)).select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("identifiers"),
        F.coalesce("hits.licenses", F.lit("")).alias("licenses"), F.coalesce(F.replace(left, F.lit(" "), F.lit(",")), F.lit("")).alias("unmatched"))


def oracle_sql() -> str:
    """The result in DuckDB SQL over `documents` (doc_id unique) where each known
    sentence stands in one piece: sentences over several pieces are not joined here."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in known(SENTENCES).items())
    steps, prev = [], "seq"
    for k, (name, ids) in enumerate(RULES):
        pat = quote("," + ",,".join(ids) + ",")
        has = f"contains(rest, {pat})"
        steps.append(f"r{k} AS (SELECT doc_id, n, ids, replace(rest, {pat}, ';') AS rest, CASE WHEN {has} AND NOT list_contains(lic, {quote(name)}) "
                     f"THEN list_append(lic, {quote(name)}) ELSE lic END AS lic FROM {prev})")
        prev = f"r{k}"
    return f"""
WITH lines AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
one AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS rn FROM lines),
norm AS (SELECT doc_id, rn, trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s FROM one),
known(s, id) AS (VALUES {values}),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY rn) AS ids, string_agg(',' || id || ',', '' ORDER BY rn) AS rest
          FROM norm JOIN known USING (s) GROUP BY doc_id),
seq AS (SELECT doc_id, n, ids, rest, CAST([] AS VARCHAR[]) AS lic FROM found),
{", ".join(steps)}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS identifiers,
       coalesce(array_to_string(lic, ','), '') AS licenses,
       coalesce(replace(trim(regexp_replace(rest, '[,;]+', ' ', 'g')), ' ', ','), '') AS unmatched
FROM documents d LEFT JOIN {prev} USING (doc_id)"""
