"""Licence scans by sentence-rule recognition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Sentences of public licence texts and notices, normalised (lower case, words of a-z and 0-9).
SENTENCES: dict[str, str] = {
    "mit-name": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-notice-the": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync4-notice": "licensed under cc by nc 4 0",
    "ccby4-notice": "licensed under cc by 4 0",
    "ccbysa4-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "licensed under cc0 1 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all-rights": "all rights reserved",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache2-terms": "terms and conditions for use reproduction and distribution",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "fsf-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2-title": "eclipse public license v 2 0",
    "epl2-provided": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "mpl2-title": "mozilla public license version 2 0",
    "mpl2-definitions": "1 definitions",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost1-title": "boost software license version 1 0 august 17th 2003",
}
# A licence and the sentences that must follow one another in this order, others between them allowed.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-condition")),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-notice-the", "apache2-comply")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("MPL-2.0", ("mpl2-title", "mpl2-definitions")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("GPL-3.0", ("gpl3-title", "fsf-verbatim")),
    ("GPL-2.0", ("gpl2-title", "fsf-verbatim")),
    ("LGPL-2.1", ("lgpl21-title", "fsf-verbatim")),
    ("LGPL-3.0", ("lgpl3-title", "fsf-verbatim")),
    ("AGPL-3.0", ("agpl3-title", "fsf-verbatim")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-2.0", ("epl2-title", "epl2-provided")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost1-title",)),
]
#: Ends of paragraphs, and places where a sentence may end or run on: a line break, or . ! ? ; : before white space.
PARAGRAPH_END, BREAK = r"\n\s*\n", r"\n|[.!?;:]+(?=\s)"


def marked_words(text: Column) -> Column:
    """The words (a-z and 0-9, lower case) of a text, each after a space, with H where a paragraph and S where perhaps a sentence ends."""
    parts = F.regexp_replace(F.regexp_replace(F.lower(text), PARAGRAPH_END, " H "), BREAK, " S ")
    return F.regexp_replace(F.concat(F.lit(" H "), parts, F.lit(" H ")), "[^a-z0-9HS]+", " ")


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known licence sentences of a text in order, the longest at each place.

    A sentence begins and ends at a break, and may run over breaks within its paragraph: over the ends of
    wrapped lines, and over marks like those in "free software: you" or "v. 2.0".
    """
    longest = sorted(known.items(), key=lambda x: -len(x[1]))
    either = "|".join("(?: S)*+ ".join(v.split()) for _, v in longest)
    names = F.create_map(*[F.lit(x) for k, v in longest for x in (v, k)])
    hits = F.regexp_extract_all(marked_words(text), F.lit(f"(?<=[HS]) (?:{either})(?= [HS])"), F.lit(0))
    return F.transform(hits, lambda raw: F.element_at(names, F.trim(F.replace(raw, F.lit(" S"), F.lit("")))))


def tables(known: DataFrame, rules: DataFrame) -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """known(sentence_id, sentence) and rules(license, rule, position, sentence_id) as scan() takes them; sentences are normalised here.

    The rule set becomes a constant of the plan, so its size is what is read here: thousands of sentences, not millions.
    """
    words = F.trim(F.regexp_replace(F.lower("sentence"), "[^a-z0-9]+", " "))
    held = {r.sentence_id: r.sentence for r in known.select("sentence_id", words.alias("sentence")).where("sentence <> ''").collect()}
    listed = rules.groupBy("license", "rule").agg(F.array_sort(F.collect_list(F.struct("position", "sentence_id"))).alias("s")).orderBy("license", "rule")
    return held, [(r.license, tuple(x.sentence_id for x in r.s)) for r in listed.collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """(id, n_sentences, sentence_ids, licenses) for every row of docs: known sentences in text order, and the licences whose rule they satisfy.

    A rule holds when its sentences occur in its order, with any others between. licenses is sorted and
    without repeats. Every row is judged by its own text, without a shuffle. Null and empty texts have
    none. Rows with a null id and repeated rows stay. An empty table gives no rows. Other columns are ignored.
    """
    known, rules = known or SENTENCES, rules or RULES
    found = docs.select(F.col(id_col).alias("id"), sentence_ids(text_or_empty(text_col), known).alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    hits = F.array(*[F.when(line.rlike("," + ",(?:.*,)?".join(map(re.escape, seq)) + ","), F.lit(name)) for name, seq in rules])
    judged = F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(F.array_compact(hits)))).otherwise(F.array().cast("array<string>"))
    return found.select("id", F.size("sentence_ids").alias("n_sentences"), "sentence_ids", judged.alias("licenses"))
