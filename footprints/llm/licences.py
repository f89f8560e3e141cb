"""Licence recognition: known licence sentences become identifiers, and sequences of identifiers are matched with ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- Fixed values: sentences of public licences and notices, normalised, by identifier -----------
SENTENCES = {
    "mit-title": ["the mit license", "mit license", "the mit license mit"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this work is licensed under the mit license", "distributed under the mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "mit-liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "isc-warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-notice": ["released under the bsd license", "licensed under the bsd license", "this project is licensed under the bsd license"],
    "apache-2-notice": [
        "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0",
        "this work is licensed under the apache license version 2 0", "this project is licensed under the apache license version 2 0",
    ],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache-basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "apache-limits": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-free-2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "gpl-details": ["see the gnu general public license for more details"],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "unlicense-domain": ["this is free and unencumbered software released into the public domain under no license", "this is free and unencumbered software released into the public domain"],
}
# Notices that name a version: the sentence is the same for each.
for _version in ("1", "2", "3"):
    SENTENCES[f"gpl-{_version}-notice"] = [
        f"{start} under the gnu general public license version {_version}{end}"
        for start in ("this work is licensed", "licensed", "released", "this project is licensed", "distributed") for end in ("", " 0")
    ]
    SENTENCES[f"lgpl-{_version}-notice"] = [f"{start} under the gnu lesser general public license version {_version}{end}" for start in ("this work is licensed", "licensed", "released") for end in ("", " 0", " 1")]
for _kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    for _version in ("2 0", "3 0", "4 0"):
        SENTENCES[f"cc-{_kind}-{_version}".replace(" ", "-")] = [f"{start} under cc {_kind} {_version}" for start in ("this work is licensed", "licensed", "released")]
SENTENCES["cc0"] = ["licensed under cc0 1 0", "released under cc0 1 0", "this work is licensed under cc0 1 0"]

# A rule is a licence, the identifiers that must follow each other (unknown sentences may lie between, known ones may not), and
# what finding them says: the whole text or a notice. Of rules that overlap the earlier one holds.
RULES = [
    ("MIT", "text", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", "text", ["isc-grant", "isc-warranty"]),
    ("Apache-2.0", "header", ["apache-2-notice", "apache-use", "apache-copy", "apache-basis", "apache-limits"]),
    ("GPL-3.0-or-later", "header", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", "header", ["gpl-free-2", "gpl-hope", "gpl-details"]),
    ("MPL-2.0", "header", ["mpl-notice", "mpl-copy"]),
    ("Unlicense", "notice", ["unlicense-domain"]),
    ("Apache-2.0", "notice", ["apache-2-notice"]),
    ("MIT", "notice", ["mit-notice"]),
    ("MIT", "notice", ["mit-title"]),
    ("BSD", "notice", ["bsd-notice"]),
    ("MPL-2.0", "notice", ["mpl-notice"]),
    ("CC0-1.0", "notice", ["cc0"]),
    *[(f"GPL-{v}.0-only", "notice", [f"gpl-{v}-notice"]) for v in ("1", "2", "3")],
    *[(f"LGPL-{v}.x-only", "notice", [f"lgpl-{v}-notice"]) for v in ("1", "2", "3")],
    *[(f"CC-{k.upper()}-{v}.0", "notice", [f"cc-{k}-{v}-0"]) for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("2", "3", "4")],
]
# Every known sentence holds one of these, so that other texts need not be cut into sentences.
HINTS = ["licen", "permission", "warrant", "liable", "redistribution", " cc", "mpl", "unencumbered", "copyright notice"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Texts are cut at line ends, and at . ! ? ; or : ahead of white space. A known sentence may go over several such parts, as wrapped
# lines and clauses do, but not over a blank line.
SENTENCE_END = r"([.!?;:])\s+"
OTHER = "[^a-z0-9]+"


def may_hold(lowered: Column) -> Column:
    """Whether a text in lower case holds a hint of any known sentence."""
    hint = F.lit(False)
    for word in HINTS:
        hint = hint | F.contains(lowered, F.lit(word))
    return hint


def _known() -> str:
    """A pattern for the known sentences, from the beginning of a part to the end of one; of several the longest is found."""
    by_first: dict[str, list[str]] = {}
    for form in sorted((form for forms in SENTENCES.values() for form in forms), key=lambda f: (-len(f), f)):
        first, _, rest = form.partition(" ")
        by_first.setdefault(first, []).append(f" {rest}".replace(" ", "[ \n]") if rest else "")
    return r"(?<![^\n])(?:" + "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in by_first.items()) + r")(?![^\n])"


KNOWN = _known()


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; other sentences leave no trace."""
    table = F.create_map(*[x for name, forms in SENTENCES.items() for form in forms for x in (F.lit(form), F.lit(name))])
    parts = F.regexp_replace(F.translate(text, UPPER, LOWER), SENTENCE_END, "$1\n")
    # Words between single blanks, parts between single line ends, and blank lines kept.
    parts = F.regexp_replace(F.regexp_replace(parts, "[^a-z0-9\n]+", " "), " ?\n ?", "\n")
    found = F.regexp_extract_all(F.trim(parts), F.lit(KNOWN), F.lit(0))
    return F.array_compact(F.transform(found, lambda s: F.try_element_at(table, F.translate(s, "\n", " "))))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences) per row: the known sentences in order, and (licence, kind) of the rules that match.

    Sentences are compared lower-cased, each run of other characters than a-z and 0-9 being one blank, so that line ends and comment
    marks of wrapped texts do not matter. Rules are tried in order; a
    match takes its sentences away from those after it, so that a whole text is not its own notice as well. A rule that matches
    several times is listed once. A null or empty text, or one without known sentences, has empty lists; repeated rows get equal
    answers, and other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hinted = texts.withColumn("_lower", F.lower("text")).select("doc_id", "text", may_hold(F.col("_lower")).alias("_hint"))
    found = hinted.select("doc_id", F.when(F.col("_hint"), sentence_ids(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    some = F.size("sentence_ids") > 0
    # Each identifier between blanks of its own, so that a sequence is a substring.
    found = found.withColumn("_rest", F.when(some, F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))))
    names = [f"{licence}:{kind}" for licence, kind, _ in RULES]
    step = F.struct(F.col("_rest").alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(ids) + " ").alias("ids")) for name, (_, _, ids) in zip(names, RULES)])

    def apply(state, rule):
        hit = F.contains(state["rest"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["ids"], F.lit(" | "))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_union(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    return found.select(
        "doc_id", "sentence_ids", F.when(some, F.aggregate(rules, step, apply, lambda s: s["found"])).otherwise(F.array().cast("array<string>")).alias("licences")
    )
