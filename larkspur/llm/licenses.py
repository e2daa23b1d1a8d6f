"""License scans by sentence rules, in SQL functions only.

A text is cut into sentences, each sentence is normalised (lower case, letters, digits and dots inside numbers kept,
everything else one blank) and looked up in a fixed table of known licence sentences. The identifiers found, in the order
of the text, are then matched against ordered rules: a licence is recognised where its sentences follow each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences that SPDX lines and notices name, in normalised form, and the identifiers of such sentences.
SPDX = {
    "mit": "mit-notice",
    "apache 2.0": "apache-2-notice",
    "gpl 2.0": "gpl-2-notice",
    "gpl 2.0 only": "gpl-2-notice",
    "gpl 2.0 or later": "gpl-2-notice",
    "gpl 3.0": "gpl-3-notice",
    "gpl 3.0 only": "gpl-3-notice",
    "gpl 3.0 or later": "gpl-3-notice",
    "lgpl 2.1 only": "lgpl-2.1-notice",
    "lgpl 2.1 or later": "lgpl-2.1-notice",
    "lgpl 3.0 only": "lgpl-3-notice",
    "lgpl 3.0 or later": "lgpl-3-notice",
    "agpl 3.0 only": "agpl-3-notice",
    "agpl 3.0 or later": "agpl-3-notice",
    "mpl 2.0": "mpl-2-notice",
    "bsd 2 clause": "bsd-2-notice",
    "bsd 3 clause": "bsd-3-notice",
    "isc": "isc-notice",
    "unlicense": "unlicense-notice",
    "cc0 1.0": "cc0-notice",
    "bsl 1.0": "bsl-notice",
    "cc by 4.0": "cc-by-4-notice",
    "cc by sa 4.0": "cc-by-sa-4-notice",
    "cc by nc 4.0": "cc-by-nc-4-notice",
}

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2.0": "apache-2-notice",
    "licensed under the apache license version 2.0 the license": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "you may obtain a copy of the license at": "apache-2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4.0": "cc-by-nc-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "cc-by-nc-4-notice",
    "licensed under cc by 4.0": "cc-by-4-notice",
    "licensed under cc by sa 4.0": "cc-by-sa-4-notice",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all rights reserved": "all-rights-reserved",
    "apache license version 2.0 january 2004": "apache-2-title",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu lesser general public license version 2.1 february 1999": "lgpl-2.1-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "mozilla public license version 2.0": "mpl-2-title",
    "boost software license version 1.0 august 17th 2003": "bsl-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl-2.1-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0": "mpl-2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "distributed under the boost software license version 1.0": "bsl-notice",
} | {f"spdx license identifier {name}": notice for name, notice in SPDX.items()}

# Rules, each a licence and the sentence identifiers that must follow each other. Longer rules first.
RULES = (
    ("MIT", "full-text", ("mit-grant", "mit-condition", "mit-warranty")),
    ("Apache-2.0", "header", ("apache-2-notice", "apache-2-compliance", "apache-2-copy")),
    ("GPL-2.0", "header", ("gpl-2-grant", "gpl-warranty")),
    ("GPL-3.0", "header", ("gpl-3-grant", "gpl-warranty")),
    ("LGPL-2.1", "header", ("lgpl-2.1-grant", "lgpl-warranty")),
    ("LGPL-3.0", "header", ("lgpl-3-grant", "lgpl-warranty")),
    ("AGPL-3.0", "header", ("agpl-3-grant", "gpl-warranty")),
    ("MPL-2.0", "header", ("mpl-2-terms", "mpl-2-copy")),
    ("BSD-3-Clause", "full-text", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "full-text", ("bsd-source", "bsd-binary")),
    ("ISC", "full-text", ("isc-grant", "isc-warranty")),
    ("Unlicense", "full-text", ("unlicense-domain", "unlicense-grant")),
    ("CC0-1.0", "dedication", ("cc0-dedication",)),
    ("BSL-1.0", "full-text", ("bsl-grant",)),
    ("Apache-2.0", "title", ("apache-2-title",)),
    ("GPL-2.0", "title", ("gpl-2-title",)),
    ("GPL-3.0", "title", ("gpl-3-title",)),
    ("LGPL-2.1", "title", ("lgpl-2.1-title",)),
    ("LGPL-3.0", "title", ("lgpl-3-title",)),
    ("AGPL-3.0", "title", ("agpl-3-title",)),
    ("MPL-2.0", "title", ("mpl-2-title",)),
    ("BSL-1.0", "title", ("bsl-title",)),
    ("MIT", "notice", ("mit-notice",)),
    ("Apache-2.0", "notice", ("apache-2-notice",)),
    ("GPL-2.0", "notice", ("gpl-2-notice",)),
    ("GPL-3.0", "notice", ("gpl-3-notice",)),
    ("LGPL-2.1", "notice", ("lgpl-2.1-notice",)),
    ("LGPL-3.0", "notice", ("lgpl-3-notice",)),
    ("AGPL-3.0", "notice", ("agpl-3-notice",)),
    ("MPL-2.0", "notice", ("mpl-2-notice",)),
    ("BSD-2-Clause", "notice", ("bsd-2-notice",)),
    ("BSD-3-Clause", "notice", ("bsd-3-notice",)),
    ("ISC", "notice", ("isc-notice",)),
    ("Unlicense", "notice", ("unlicense-notice",)),
    ("CC0-1.0", "notice", ("cc0-notice",)),
    ("BSL-1.0", "notice", ("bsl-notice",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", "notice", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-4-notice",)),
    ("Proprietary", "notice", ("all-rights-reserved",)),
)

#: Operators within an SPDX line; each operand is a sentence of its own, exceptions are left out.
SPDX_JOINT = r"(?<=spdx-license-identifier:[^\r\n]{0,200})[ \t)]+(?:and|or)[ \t(]+"
SPDX_EXCEPTION = r"(?<=spdx-license-identifier:[^\r\n]{0,200})[ \t]+with[ \t]+[a-z0-9.-]+"

#: What ends every sentence: ! ? or dots that a blank or the end follows.
FLOWING = r"[!?]+|\.+(?=\s|$)"

#: What may end one or stand within: a line end, a colon or a semicolon. Headings and copyright lines often have no other end.
BREAK = r"[\n\r:;]+"


def sentence_ids(text: Column, table: Column, telling: str, words: int) -> Column:
    """Identifiers of a text's known sentences, in order: runs of pieces between two FLOWING ends, the longest from the left.

    Every run of neighbouring lines and parts at colons and semicolons is looked up, so a sentence may be wrapped, and follow or precede
    lines without a full stop. telling: a pattern that every known sentence matches; words: most words of one.
    """
    known = F.map_keys(table)

    def ids(stretch: Column) -> Column:
        parts = F.filter(F.transform(F.split(stretch, BREAK, -1), normalised), lambda s: s != "")

        def longest(s: Column, i: Column) -> Column:
            """The longest known run that starts here, as (size, id); only a known sentence's beginning is tried."""
            runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size(parts) - i)), lambda n: F.struct(n.alias("size"), F.element_at(table, F.array_join(F.slice(parts, i + 1, n), " ")).alias("id")))
            hit = F.array_max(F.filter(runs, lambda r: r["id"].isNotNull()))
            return F.when(F.exists(known, lambda k: (k == s) | F.startswith(k, F.concat(s, F.lit(" ")))), F.struct(i.alias("at"), hit.alias("hit")))

        hits = F.filter(F.transform(parts, longest), lambda x: x["hit"].isNotNull())
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            taken = F.struct((x["at"] + x["hit"]["size"]).alias("free"), F.concat(acc["out"], F.array(x["hit"]["id"])).alias("out"))
            return F.when(x["at"] >= acc["free"], taken).otherwise(acc)

        return F.aggregate(hits, start, step, lambda acc: acc["out"])

    low = F.lower(text)
    apart = F.regexp_replace(F.regexp_replace(low, SPDX_EXCEPTION, ""), SPDX_JOINT, "\nspdx-license-identifier: ")
    low = F.when(low.contains("spdx-license-identifier:"), apart).otherwise(low)
    stretches = F.filter(F.split(low, FLOWING, -1), lambda s: s.rlike(telling))
    return F.flatten(F.transform(stretches, ids))


def normalised(s: Column) -> Column:
    """Lower case; a dot or digit inside a number stays, every other run of signs is one blank."""
    s = F.regexp_replace(F.lower(s), r"(?<![0-9])\.|\.(?![0-9])", " ")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}.]+", " "))


def rule_hits(name: str, kind: str, ids: tuple[str, ...]) -> Column:
    """Matches "name:kind:index" of one rule in the column sentence_ids."""
    wanted = F.array(*map(F.lit, ids))
    places = F.sequence(F.lit(0), F.size("sentence_ids") - len(ids))
    here = F.filter(places, lambda i: F.slice("sentence_ids", i + 1, len(ids)) == wanted)
    hits = F.transform(here, lambda i: F.concat(F.lit(f"{name}:{kind}:"), i.cast("string")))
    return F.when(F.size("sentence_ids") >= len(ids), hits).otherwise(F.array().cast("array<string>"))


def license_scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """One row per row of docs: doc_id, sentence_ids (array), licenses (sorted array), matches (array), n_licenses.

    sentence_ids are the identifiers of the known sentences in the order of the text. A match is
    "licence:kind:index", index being the place in sentence_ids where the rule's sequence starts; a notice inside a
    longer match of the same licence is still reported. An SPDX line names each licence of its expression. The table of known sentences is fixed and small, so it is a
    literal of the plan: no join, no shuffle, one pass over whole texts of any length. Null and empty texts give empty arrays, an
    empty table an empty result. Rows that repeat a doc_id are scanned one by one. Only doc_id and text are read.
    """
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.coalesce("text", F.lit(""))
    # a text with a known sentence has the sentence's longest word: texts without any of those need no cutting
    telling = "|".join(sorted({max(re.findall(r"[^\W\d_]+", s), key=len) for s in known}))
    words = max(len(s.split()) for s in known)
    rows = docs.select("doc_id", "text").withColumn("__lk_table", table)
    rows = rows.withColumn("sentence_ids", F.when(F.lower(text).rlike(telling), sentence_ids(text, F.col("__lk_table"), telling, words)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("matches", F.concat(*[rule_hits(*rule) for rule in rules]))
    rows = rows.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.split_part(m, F.lit(":"), F.lit(1))))))
    return rows.select("doc_id", "sentence_ids", "licenses", "matches", F.size("licenses").cast("long").alias("n_licenses"))
