"""Operator 2: licence recognition by sentences and ordered rules. DataFrame functions only.

A text is cut into sentences twice: with line ends as borders, and with lines of a paragraph joined (licences
are often wrapped; a line without letters or digits, such as that of a comment's frame, ends a paragraph). A
sentence is normalised to lower-case ASCII words, without a list's mark and with one spelling of the names that
licences are issued under, and looked up among known licence sentences. What is left is a sequence of identifiers,
runs of unknown sentences being one 0. The rules are tried in order on the sequence of either cut; a rule that
matches puts a 0 in the place of its identifiers, so what stands beside it does not become neighbours.

Only texts that hold one of the stems that every rule needs are cut up at all. Each row is worked on alone: no
join, no shuffle.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import quoted

# Fixed values: (identifier, sentence as the cuts leave it). Different spellings share an identifier.
SENTENCES = [
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    (11, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    (11, "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    (12, "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    (13, "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    (21, "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    (22, "you may not use this file except in compliance with the License"),
    (23, "You may obtain a copy of the License at"),
    (24, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    (25, "See the License for the specific language governing permissions and limitations under the License"),
    (26, "http://www.apache.org/licenses/LICENSE-2.0"),
    (26, "https://www.apache.org/licenses/LICENSE-2.0"),
    (27, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (50, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (51, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    (52, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    (53, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (54, "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (60, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    (60, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    (61, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (62, "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    (70, "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    (71, "2.0"),
    (72, "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    (72, "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    (73, "Mozilla Public License Version 2.0"),
    (80, "This program is free software"),
    (80, "This library is free software"),
    (81, "<one line to give the program's name and a brief idea of what it does.> Copyright (C) <year> <name of author>"),
    (82, "either version 2 of the License, or (at your option) any later version"),
    (83, "either version 2.1 of the License, or (at your option) any later version"),
    (84, "either version 3 of the License, or (at your option) any later version"),
    (85, "version 2 of the License"),
    (86, "version 2.1 of the License"),
    (87, "version 3 of the License"),
    (100, "This is free and unencumbered software released into the public domain"),
    (101, "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    (110, "CC0 1.0 Universal"),
    (110, "Creative Commons CC0 1.0 Universal"),
    (110, "Creative Commons Legal Code CC0 1.0 Universal"),
    (111, "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"),
    (120, "SPDX-License-Identifier"),
]
# Fixed values: (family, name, versions, title with the date of each).
GNU = [
    ("GPL", "GNU General Public License", {"2.0": "Version 2, June 1991", "3.0": "Version 3, 29 June 2007"}),
    ("LGPL", "GNU Lesser General Public License", {"2.1": "Version 2.1, February 1999", "3.0": "Version 3, 29 June 2007"}),
    ("AGPL", "GNU Affero General Public License", {"3.0": "Version 3, 19 November 2007"}),
]
# Fixed values: (licence by its SPDX name, what people call it).
SPOKEN = [
    ("MIT", ["MIT License", "MIT licence"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License"]),
    ("ISC", ["ISC License"]),
    ("MPL-2.0", ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU General Public License v2.0"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU General Public License v3.0"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"]),
    ("Unlicense", ["Unlicense"]),
    ("CC0-1.0", ["CC0 1.0 License"]),
    ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
]
FORMS = ["{}", "The {}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This software is released under the {}"]
SUFFIXES = ["", "-only", "-or-later"]  # of GNU licences in SPDX tags
SPDX_FIRST, SPOKEN_FIRST, GNU_FIRST = 300, 200, 400
STEMS = ["licen", "permission", "copyright", "redistribut", "cc0", "cc.by", "unencumbered"]
# Fixed values: (licence, identifiers that must follow one another), the first rule first; no licence: a mere example.
SHIPPED_RULES = [
    ("MIT", [10, 11, 12, 13]),
    ("MIT", [10, 11, 12]),
    ("Apache-2.0", [21, 22, 23, 26, 24, 25]),
    ("Apache-2.0", [21, 22, 23, 24, 25]),
    ("Apache-2.0", [21, 22, 23]),
    ("Apache-2.0", [21]),
    ("Apache-2.0", [27]),
    ("BSD-4-Clause", [50, 51, 52, 54]),
    ("BSD-3-Clause", [50, 51, 52, 53]),
    ("BSD-2-Clause", [50, 51, 52]),
    ("ISC", [60, 62]),
    ("ISC", [60]),
    ("0BSD", [61, 62]),
    ("0BSD", [61]),
    ("MPL-2.0", [70, 71, 72]),
    ("MPL-2.0", [70, 71]),
    ("MPL-2.0", [73]),
    ("Unlicense", [100, 101]),
    ("Unlicense", [100]),
    ("CC0-1.0", [110, 111]),
    ("CC0-1.0", [111]),
    ("CC0-1.0", [110]),
]
# Spellings that are one, after normalising: marks of lists before a clause, and the holder's name.
SPELLINGS = [
    ("^([0-9]{1,2}|[a-z]) (redistributions|neither|all|the) ", 2, " "),
    ("^neither the names? of .+ nor the names of .*contributors", 0, "neither the name of the copyright holder nor the names of its contributors"),
]
BORDER = r"[.!?;:]+[\x20\x09-\x0D]+|\n"
PARAGRAPH_BORDER = r"[.!?;:]+[\x20\x09-\x0D]+|\n[^A-Za-z0-9\n]*\n"
LIST_NUMBER = "^[0-9]{1,2}$"  # what a border leaves of '1. Redistributions ...'; no sentence of its own


def normalised(sentence: str) -> str:
    """Lower-case ASCII letters and digits, all else one space."""
    out = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in sentence)
    return " ".join(out.split())


@cache
def known() -> tuple[dict[str, int], list[tuple[str, list[int]]]]:
    """Normalised sentence to identifier, and the rules: those listed, those of GNU notices, SPDX tags, spoken names."""
    sentences, rules, gnu = {normalised(s): k for k, s in SENTENCES}, list(SHIPPED_RULES), []
    tags = {name for name, _ in SPOKEN} | {"0BSD", "BSD-4-Clause"}
    number = GNU_FIRST
    for family, name, versions in GNU:
        given = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
        plain = number
        sentences[normalised(given)] = plain
        number += 1
        for version, title in versions.items():
            short, later = version.removesuffix(".0"), {"2.0": 82, "2.1": 83, "3.0": 84}[version]
            texts = [f"{given}, either version {short} of the License, or (at your option) any later version", f"{given}, version {short} of the License", f"{name} {title}"]
            sentences |= {normalised(t): number + k for k, t in enumerate(texts)}
            licence = f"{family}-{version}"
            tags |= {licence + end for end in SUFFIXES}
            # the notice that the licence's own text shows is no notice
            rules = [("", [81, 80, number]), ("", [81, 80, plain, later]), *rules]
            gnu += [(f"{licence}-or-later", [number]), (f"{licence}-or-later", [plain, later]), (f"{licence}-only", [number + 1]), (f"{licence}-only", [plain, later + 3]), (licence, [number + 2])]
            number += len(texts)
    rules += gnu
    for k, tag in enumerate(sorted(tags)):
        # a tag's name is a sentence that counts behind the word for tags only
        sentences.setdefault(normalised(tag), SPDX_FIRST + k)
        rules.append((tag, [120, sentences[normalised(tag)]]))
    for k, (licence, names) in enumerate(SPOKEN):
        sentences |= {normalised(form.format(name)): SPOKEN_FIRST + k for name in names for form in FORMS if normalised(form.format(name)) not in sentences}
        rules.append((licence, [SPOKEN_FIRST + k]))
    return sentences, rules


def _sequence(sentences: Column) -> Column:
    """``<id><id>...`` of the sentences; empty ones and numbers of lists are left out, and a run of unknown ones is one ``<0>``."""
    table = known()[0]
    lookup = F.create_map(*(x for s, k in table.items() for x in (F.lit(s), F.lit(k))))

    def words(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
        for pattern, group, put in SPELLINGS:
            plain = F.regexp_replace(plain, pattern, (f"${group}" if group else "") + put)
        return plain

    kept = F.filter(F.transform(sentences, words), lambda w: (w != "") & ~w.rlike(LIST_NUMBER))
    found = F.transform(kept, lambda w: F.when(w.isin(list(table)), F.concat(F.lit("<"), F.element_at(lookup, w).cast("string"), F.lit(">"))).otherwise("<0>"))
    return F.regexp_replace(F.array_join(found, ""), "(<0>)+", "<0>")


def _after_rules(sequence: Column, names: Column) -> tuple[Column, Column]:
    """(what the rules leave of the sequence, the names of those that matched)."""
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("".join(f"<{k}>" for k in ids)).alias("ids")) for n, ids in known()[1]))
    start = F.struct(sequence.alias("left"), names.alias("names"))
    end = F.aggregate(
        rules,
        start,
        lambda state, rule: F.when(
            F.contains(state["left"], rule["ids"]),
            F.struct(F.replace(state["left"], rule["ids"], F.lit("<0>")).alias("left"), F.when(rule["name"] != "", F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names")),
        ).otherwise(state),
    )
    return end["left"], end["names"]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids, licenses (sorted, distinct) and n_unmatched.

    sentence_ids are the known sentences in the order of the text, line cut first, then those that only the
    paragraph cut finds; n_unmatched counts those of the line cut that no rule took. A null or empty text, or
    one without known sentences, has empty arrays. Null ids and repeated rows are kept as they are; other
    columns are not read; an empty table gives an empty result.
    """
    empty = F.array().cast("array<string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    likely = text.rlike("(?i)" + "|".join(STEMS))
    cut = plain.select(
        "doc_id",
        F.when(likely, _sequence(F.split(text, BORDER))).otherwise("").alias("lines"),
        F.when(likely, _sequence(F.transform(F.split(text, PARAGRAPH_BORDER), lambda p: F.replace(p, F.lit("\n"), F.lit(" "))))).otherwise("").alias("paragraphs"),
    )
    left, by_line = _after_rules(F.col("lines"), empty)
    _, by_paragraph = _after_rules(F.col("paragraphs"), empty)
    matched = cut.select("doc_id", "lines", "paragraphs", left.alias("left"), F.array_sort(F.array_distinct(F.concat(by_line, by_paragraph))).alias("licenses"))

    def ids(sequence: Column) -> Column:
        return F.array_remove(F.regexp_extract_all(sequence, F.lit("<([0-9]+)>"), F.lit(1)), "0")

    lines, paragraphs = ids(F.col("lines")), ids(F.col("paragraphs"))
    return matched.select("doc_id", F.concat(lines, F.array_except(paragraphs, lines)).alias("sentence_ids"), "licenses", F.size(ids(F.col("left"))).cast("long").alias("n_unmatched"))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_unmatched")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The digest in DuckDB's SQL."""
    pairs = ", ".join(f"({_quoted(s)}, {k})" for s, k in known()[0].items())
    stems = "|".join(STEMS)

    ctes = []
    source = "seq"
    for number, (name, ids) in enumerate(known()[1]):
        pattern = _quoted("".join(f"<{k}>" for k in ids))
        ctes.append(
            f"r{number} as (select * replace (replace(l, {pattern}, '<0>') as l, replace(p, {pattern}, '<0>') as p, "
            f"case when {_quoted(name)} <> '' and (contains(l, {pattern}) or contains(p, {pattern})) then list_append(names, {_quoted(name)}) else names end as names) from {source})"
        )
        source = f"r{number}"
    border, paragraph = BORDER.replace("\\x20", " "), PARAGRAPH_BORDER.replace("\\x20", " ")
    border, paragraph = (b.replace("\\x09", "\\t").replace("\\x0D", "\\r") for b in (border, paragraph))
    words = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, group, put in SPELLINGS:
        words = f"regexp_replace({words}, '{pattern}', '{chr(92) + str(group) if group else ''}{put}')"
    return f"""
with known(s, id) as (values {pairs}),
likely as (select doc_id, coalesce(text, '') as text, regexp_matches(coalesce(text, ''), '{stems}', 'i') as likely from documents),
cut as (select doc_id, likely, string_split_regex(text, '{border}') as a,
        list_transform(string_split_regex(text, '{paragraph}'), lambda q: replace(q, chr(10), ' ')) as b from likely),
parts as (select row_number() over () as rid, * from cut),
la as (select rid, unnest(a) as s, generate_subscripts(a, 1) as pos from parts where likely),
lb as (select rid, unnest(b) as s, generate_subscripts(b, 1) as pos from parts where likely),
na as (select rid, pos, {words} as w from la),
nb as (select rid, pos, {words} as w from lb),
sa as (select rid, regexp_replace(string_agg('<' || coalesce(id, 0) || '>', '' order by pos), '(<0>)+', '<0>', 'g') as q from na left join known on s = w where w <> '' and not regexp_matches(w, '{LIST_NUMBER}') group by rid),
sb as (select rid, regexp_replace(string_agg('<' || coalesce(id, 0) || '>', '' order by pos), '(<0>)+', '<0>', 'g') as q from nb left join known on s = w where w <> '' and not regexp_matches(w, '{LIST_NUMBER}') group by rid),
seq as (select p.doc_id, coalesce(sa.q, '') as lines, coalesce(sb.q, '') as paragraphs, coalesce(sa.q, '') as l, coalesce(sb.q, '') as p, []::varchar[] as names
        from parts p left join sa using (rid) left join sb using (rid)),
{", ".join(ctes)},
done as (select doc_id, names, list_filter(regexp_extract_all(lines, '<([0-9]+)>', 1), lambda x: x <> '0') as a,
         list_filter(regexp_extract_all(paragraphs, '<([0-9]+)>', 1), lambda x: x <> '0') as b,
         list_filter(regexp_extract_all(l, '<([0-9]+)>', 1), lambda x: x <> '0') as rest from {source})
select doc_id, len(a) + len(list_filter(b, lambda x: not list_contains(a, x))) as n_sentences,
  array_to_string(a || list_filter(b, lambda x: not list_contains(a, x)), ',') as sentence_ids,
  array_to_string(list_sort(list_distinct(names)), ',') as licenses, len(rest)::bigint as n_unmatched
from done
"""
