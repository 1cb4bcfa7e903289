"""Licences of texts: known sentences are found first, then ordered sequences of them.

Only built-in functions are used; the tables of sentences and rules are fixed and small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence identifiers and the sentences, in lower case, with only letters, digits and dots.
SENTENCES = [
    ("apache2-short", "licensed under the apache license version 2.0"),
    ("apache2-use", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-short", "released under the mit license"),
    ("mit-short", "licensed under the mit license"),
    ("mit-short", "this project is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl3-short", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-short", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc-by-nc4", "licensed under cc by nc 4.0"),
    ("cc-by-nc4", "this work is licensed under cc by nc 4.0"),
    ("cc-by4", "licensed under cc by 4.0"),
    ("cc-by4", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

# Rule, licence, and the sentences that must follow each other; longer rules come first.
RULES = [
    ("apache-2.0-header", "Apache-2.0", ["apache2-use", "apache2-copy", "apache2-see"]),
    ("mit-text", "MIT", ["mit-grant", "as-is"]),
    ("gpl-3.0-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("bsd-text", "BSD", ["bsd-grant", "bsd-as-is"]),
    ("apache-2.0-use", "Apache-2.0", ["apache2-use"]),
    ("apache-2.0-line", "Apache-2.0", ["apache2-short"]),
    ("mit-line", "MIT", ["mit-short"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("gpl-3.0-line", "GPL-3.0", ["gpl3-short"]),
    ("gpl-3.0-grant", "GPL-3.0-or-later", ["gpl-free"]),
    ("bsd-grant", "BSD", ["bsd-grant"]),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("cc-by-4.0-line", "CC-BY-4.0", ["cc-by4"]),
    ("cc0-line", "CC0-1.0", ["cc0"]),
]


# More of both, which the SQL does not have; a sentence is as ``canonical`` leaves it.
_SUBJECTS = "this (?:project|work|software|program|library|package|code|file|repository) is "
_VERBS = "(?:licensed|released|distributed|available|published|provided) under "
_SEE = " see (?:the )?license(?: file)?(?:[ .](?:md|txt))?(?: for (?:more )?(?:details|information))?"
_NAMES = [
    ("apache2-short", ["apache", "apache license"], ["2.0", "version 2.0"]),
    ("mit-short", ["mit"], [""]),
    ("gpl3-short", ["gnu general public license", "gnu gpl", "gpl"], ["3", "3.0", "v3", "v3.0"]),
    ("gpl2-short", ["gnu general public license", "gnu gpl", "gpl"], ["2", "2.0", "v2", "v2.0"]),
    ("lgpl3-short", ["gnu lesser general public license", "gnu lgpl", "lgpl"], ["3", "3.0", "v3", "v3.0"]),
    ("lgpl21-short", ["gnu lesser general public license", "gnu lgpl", "lgpl"], ["2.1", "v2.1"]),
    ("agpl3-short", ["gnu affero general public license", "gnu agpl", "agpl"], ["3", "3.0", "v3", "v3.0"]),
    ("mpl2-short", ["mozilla public license", "mpl"], ["2.0", "v2.0"]),
    ("bsd2-short", ["bsd 2 clause", "2 clause bsd", "simplified bsd"], [""]),
    ("bsd3-short", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"], [""]),
    ("isc-short", ["isc"], [""]),
    ("cc-by4", ["cc by", "creative commons attribution"], ["4.0", "4.0 international"]),
    ("cc-by-sa4", ["cc by sa", "creative commons attribution sharealike"], ["4.0", "4.0 international"]),
    ("cc-by-nc4", ["cc by nc", "creative commons attribution noncommercial"], ["4.0", "4.0 international"]),
    ("cc0-short", ["cc0", "cc0 1.0"], ["", "universal"]),
]
_GRANT = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
MORE_SENTENCES = [
    (i, f"licensed under {x} {version}{v}".strip())
    for i, names, versions in _NAMES
    for x in names
    for v in versions
    for version in (["", "version "] if i.startswith(("gpl", "lgpl", "agpl", "mpl")) else [""])
] + [
    ("gpl-free", _GRANT.format("general public license", "3")),
    ("gpl2-free", _GRANT.format("general public license", "2")),
    ("lgpl3-free", _GRANT.format("lesser general public license", "3")),
    ("lgpl21-free", _GRANT.format("lesser general public license", "2.1")),
    ("agpl3-free", _GRANT.format("affero general public license", "3")),
    ("mpl2-text", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain"),
    *[(f"spdx-{x.lower()}", "spdx license identifier " + x.lower().replace("-", " ")) for x in (
        "Apache-2.0", "MIT", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")],
]
_LICENSES = {
    "gpl2-short": "GPL-2.0", "lgpl3-short": "LGPL-3.0", "lgpl21-short": "LGPL-2.1", "agpl3-short": "AGPL-3.0", "mpl2-short": "MPL-2.0",
    "bsd2-short": "BSD-2-Clause", "bsd3-short": "BSD-3-Clause", "isc-short": "ISC", "cc-by-sa4": "CC-BY-SA-4.0", "cc0-short": "CC0-1.0",
    "gpl2-free": "GPL-2.0-or-later", "lgpl3-free": "LGPL-3.0-or-later", "lgpl21-free": "LGPL-2.1-or-later", "agpl3-free": "AGPL-3.0-or-later",
    "mpl2-text": "MPL-2.0", "isc-grant": "ISC", "unlicense-text": "Unlicense", "spdx-apache-2.0": "Apache-2.0", "spdx-mit": "MIT",
    "spdx-gpl-3.0-only": "GPL-3.0", "spdx-gpl-3.0-or-later": "GPL-3.0-or-later", "spdx-gpl-2.0-only": "GPL-2.0",
    "spdx-gpl-2.0-or-later": "GPL-2.0-or-later", "spdx-lgpl-3.0-or-later": "LGPL-3.0-or-later", "spdx-lgpl-2.1-or-later": "LGPL-2.1-or-later",
    "spdx-agpl-3.0-only": "AGPL-3.0", "spdx-agpl-3.0-or-later": "AGPL-3.0-or-later", "spdx-mpl-2.0": "MPL-2.0", "spdx-bsd-2-clause": "BSD-2-Clause",
    "spdx-bsd-3-clause": "BSD-3-Clause", "spdx-isc": "ISC", "spdx-cc0-1.0": "CC0-1.0", "spdx-cc-by-4.0": "CC-BY-4.0",
    "spdx-cc-by-sa-4.0": "CC-BY-SA-4.0", "spdx-unlicense": "Unlicense",
}
ALL_RULES = RULES + [(i, x, [i]) for i, x in _LICENSES.items()]
# every sentence has one of these, whatever signs and line breaks stand between its words
_GAP = "[^a-z0-9]+(?:(?:rem|dnl)[^a-z0-9]+)*"
HINTS = f"licens|permission|warrant|redistribut|copyright|(?:released|available|published|distributed|provided){_GAP}under|public{_GAP}domain|software"


# what a sentence may begin with, and how long one may be
_STARTS = f"^(?:(?:{_SUBJECTS})?{_VERBS}|[a-z0-9]+(?: [a-z0-9]+)? is free software |" + "|".join(
    sorted({" ".join(x.replace(".", "[.]").split()[:3]) for _, x in SENTENCES + MORE_SENTENCES})
) + ")"
MAX_WORDS = max(len(x.split()) for _, x in SENTENCES + MORE_SENTENCES) + 24  # room for what ``canonical`` takes away
MAX_CHARS = max(len(x) for _, x in SENTENCES + MORE_SENTENCES) + 160


def _sequence(sentences: list[str]) -> str:
    return "".join(f"<{s}>" for s in sentences)


def normalised(sentence: Column) -> Column:
    """Lower case; letters, digits and dots only; no dots at the end."""
    plain = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(plain, "[ .]+$", ""))


def canonical(sentence: Column) -> Column:
    """A normalised sentence in the one form that the map of sentences has of its wordings."""
    short = F.regexp_replace(sentence, f"^(?:{_SUBJECTS})?{_VERBS}(?:the )?(?:terms of (?:the )?)?", "licensed under ")
    short = F.when(F.startswith(short, F.lit("licensed under ")), F.regexp_replace(short, f"(?: license)?(?:{_SEE})?$", "")).otherwise(short)
    return F.regexp_replace(short, "^[a-z0-9]+(?: [a-z0-9]+)? is free software you can ", "this program is free software you can ")


def sentence_id(sentence: Column) -> Column:
    """The identifier of a normalised sentence, null if it isn't known: looked up as it is, then in its canonical form."""
    known = dict((x, i) for i, x in MORE_SENTENCES + SENTENCES)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, sentence), F.try_element_at(table, canonical(sentence)))


def _runs(pieces: Column, at: Column) -> Column:
    """``at``, and the pieces from there on as far as a known sentence could go."""
    near = F.transform(F.slice(pieces, at + 1, F.lit(MAX_WORDS)), lambda x: F.left(x, F.lit(MAX_CHARS)))
    return F.struct(at.alias("at"), F.left(F.array_join(near, "\n"), F.lit(MAX_CHARS)).alias("ahead"))


def _longest(start: Column) -> Column:
    """``at, n, id``: the longest run of pieces that is a known sentence; n and id are null if there is none."""
    lines = F.sequence(F.lit(1), F.size(F.split(start["ahead"], "\n")))
    run = lambda n: F.replace(F.call_function("substring_index", start["ahead"], F.lit("\n"), n), F.lit("\n"), F.lit(" "))
    known = F.transform(lines, lambda n: F.struct(n.alias("n"), sentence_id(run(n)).alias("id")))
    best = F.try_element_at(F.filter(known, lambda r: r["id"].isNotNull()), F.lit(-1))
    return F.struct(start["at"].alias("at"), best["n"].alias("n"), best["id"].alias("id"))


def known_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, sentence_id`` of every known sentence.

    A text is cut into pieces at line ends and after . ! ? and white space, blank ones
    and comment signs left out. A sentence is one piece or several in a row, joined by
    spaces; runs that begin like a known sentence are looked up in the map of
    sentences, up to the length of its longest one. Of runs with one start the longest counts, and a
    sentence into which an earlier one reaches does not.
    """
    text = F.lower(F.regexp_replace(text_col, "([.!?])[ \t\r\n]+", "$1\n"))
    text = F.regexp_replace(text, "(?m)^[ \t]*(?:rem|dnl) ", "")
    text = F.regexp_replace(F.concat(text, F.lit("\n")), "[^a-z0-9.\n]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, "(?<![ .])[ .]++(?=\n)", ""), "(?<=\n) +", "")
    found = docs.where(F.lower(text_col).rlike(HINTS)).select(F.col(id_col).alias("doc_id"), text.alias("text"))
    pieces = found.select("doc_id", F.array_remove(F.split(F.ltrim("text"), "\n"), "").alias("pieces"))
    begins = lambda at: F.left(F.array_join(F.slice("pieces", at + 1, F.lit(5)), " "), F.lit(100)).rlike(_STARTS)
    places = F.filter(F.transform("pieces", lambda _, at: at), begins)
    starts = pieces.select("doc_id", F.transform(places, lambda at: _runs(F.col("pieces"), at)).alias("starts"))
    known = starts.select("doc_id", F.filter(F.transform("starts", _longest), lambda m: m["id"].isNotNull()).alias("known"))

    def free(m: Column, i: Column) -> Column:
        before = F.slice("known", F.greatest(i + 1 - MAX_WORDS, F.lit(1)), F.least(i, F.lit(MAX_WORDS)))
        return ~F.exists(before, lambda e: e["at"] + e["n"] > m["at"])

    sentences = known.select("doc_id", F.inline(F.filter("known", free)))
    return sentences.select("doc_id", F.col("at").alias("place"), F.col("id").alias("sentence_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rule_id, license, occurrences, sentences`` of every rule that a document meets.

    The known sentences of a document stand in order, whatever lies between them. A rule is
    met where its sentences follow each other there; what one rule has used is not used by
    later ones. ``sentences`` is how many known sentences the document has. Null and empty
    texts meet nothing; rows with the same id count as one document, repeated rows once.
    """
    found = known_sentences(docs, id_col, text_col).distinct()
    rest = found.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence_id"))), lambda s: F.concat(F.lit("<"), s["sentence_id"], F.lit(">"))), "").alias("rest"),
        F.count("*").alias("sentences"),
    )
    rules = {}
    for rule, license_, sentences in ALL_RULES:
        if len(sentences) > 1:
            rest = rest.withColumn("rest", F.replace("rest", F.lit(_sequence(sentences)), F.lit(f"<={rule}>")))
        rules[f"={rule}" if len(sentences) > 1 else sentences[0]] = F.struct(F.lit(rule).alias("rule_id"), F.lit(license_).alias("license"))
    table = F.create_map(*[x for name, rule in rules.items() for x in (F.lit(name), rule)])
    names = F.regexp_extract_all("rest", F.lit("<([^>]*)>"), F.lit(1))
    met = F.filter(F.transform(names, lambda n: F.try_element_at(table, n)), lambda r: r.isNotNull())
    times = rest.select("doc_id", "sentences", F.inline(met)).groupBy("doc_id", "sentences", "rule_id", "license").agg(F.count("*").alias("occurrences"))
    return times.select("doc_id", "rule_id", "license", "occurrences", "sentences")


def oracle_sql() -> str:
    """The same as SQL, for sentences that are lines of their own and without ``MORE_SENTENCES``."""
    values = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES)
    steps, last = [], "sequences"
    for i, (_, _, sentences) in enumerate(RULES):
        sequence = _sequence(sentences)
        gone = f"replace(rest, '{sequence}', '#')"
        steps.append(f"s{i} AS (SELECT * REPLACE ({gone} AS rest), CAST((length(rest) - length({gone})) / {len(sequence) - 1} AS BIGINT) AS n{i} FROM {last})")
        last = f"s{i}"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, '{x}' AS license, n{i} AS occurrences, sentences FROM {last} WHERE n{i} > 0" for i, (r, x, _) in enumerate(RULES))
    return f"""
    WITH known(sentence_id, sentence) AS (VALUES {values}),
    parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents),
    placed AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS place FROM parts),
    found AS (SELECT DISTINCT doc_id, place, sentence_id FROM (SELECT doc_id, place,
      trim(regexp_replace(regexp_replace(lower(sentence), '[^a-z0-9.]+', ' ', 'g'), '[ .]+$', '')) AS sentence FROM placed) JOIN known USING (sentence)),
    sequences AS (SELECT doc_id, string_agg('<' || sentence_id || '>', '' ORDER BY place, sentence_id) AS rest, count(*) AS sentences FROM found GROUP BY doc_id),
    {", ".join(steps)}
    {rows}"""
