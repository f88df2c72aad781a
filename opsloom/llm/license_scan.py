"""License scans by sentence rules: known licence sentences get identifiers, and ordered rules match their sequence.

A text is cut to sentences, each is normalised and looked up among the known ones; unknown sentences fall away. The
identifiers left, in order, are matched against the rules from the most specific on; what a rule has matched is taken,
so a long licence is not told again as the short notice it contains. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised, with their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0": "apache-notice",
    "licensed under the apache license version 2.0 the license": "apache-header",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "licensed under cc by-nc 4.0": "cc-by-nc-notice",
    "licensed under cc by 4.0": "cc-by-notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-notice",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "cc-by-nc-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "spdx-license-identifier mit": "spdx-mit",
    "spdx-license-identifier apache-2.0": "spdx-apache",
    "spdx-license-identifier gpl-3.0-or-later": "spdx-gpl3",
    "spdx-license-identifier bsd-3-clause": "spdx-bsd3",
}
# Licences and the sentence sequences that tell them, the most specific first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("spdx-gpl3",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Unlicense", ("unlicense",)),
)
#: Every known sentence holds one of these; texts without any are not cut to sentences.
HINTS = ("licen", "permission", "copyright", "software", "redistribution", "warrant")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In order: lines that go on are joined; a sentence ends with its line or with a stop before white space.
JOINS = (('([a-z,;])[ \\t]*\\r?\\n[ \\t]*([a-z("])', "{1} {2}"), ("([A-Z,;])[ \\t]*\\r?\\n[ \\t]*([A-Z][A-Z])", "{1} {2}"), ("([.!?])[ \\t\\r\\x0B\\f]+", "{1}\n"))
_DROPPED, _EDGES = "[^a-z0-9.\\-]+", "^[ .\\-]+|[ .\\-]+$"

if not all(any(h in s for h in HINTS) for s in SENTENCES):
    raise ValueError("a known sentence has no hint")


def _sentences(text: Column) -> Column:
    for pattern, to in JOINS:
        text = F.regexp_replace(text, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    parts = F.split(F.translate(text, UPPER, LOWER), "\n")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, _DROPPED, " "), _EDGES, ""))


def apply(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: (doc_id, n_known, sentence_ids, licenses).

    ``sentence_ids`` are those of the known sentences in order, comma-joined; ``licenses`` the distinct licences in
    rule order, comma-joined. Null and empty texts, and texts without a known sentence, have 0 and empty strings.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.translate(t, UPPER, LOWER)
    hinted = low.contains(HINTS[0])
    for h in HINTS[1:]:
        hinted = hinted | low.contains(h)
    # Sentences are looked up one by one; what is not known is null and goes.
    ids = F.filter(F.transform(_sentences(t), lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())
    ids = F.when(hinted, ids).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(key).alias("doc_id"), ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"))
    # A sequence is a string with each identifier between commas of its own; a matched rule leaves "|" behind.
    out = out.withColumn("__rest", F.when(F.col("sentence_ids") == "", "").otherwise(F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(","))))
    for i, (_, rule) in enumerate(RULES):
        pattern = "," + ",,".join(rule) + ","
        out = out.withColumn(f"__r{i}", F.col("__rest").contains(pattern)).withColumn("__rest", F.replace("__rest", F.lit(pattern), F.lit("|")))
    names = F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"__r{i}"), name) for i, (name, _) in enumerate(RULES)]))))
    return out.select("doc_id", "n_known", "sentence_ids", names.alias("licenses"))


def oracle_sql(table: str = "documents") -> str:
    """The same as SQL for DuckDB, over ``table`` (doc_id, text)."""
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    text = "coalesce(text, '')"
    for pattern, to in JOINS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    rows = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    steps, last = [], "start"
    for i, (_, rule) in enumerate(RULES):
        pattern = quote("," + ",,".join(rule) + ",")
        steps.append(f"s{i} AS (SELECT * EXCLUDE (rest), contains(rest, {pattern}) AS r{i}, replace(rest, {pattern}, '|') AS rest FROM {last})")
        last = f"s{i}"
    names = ", ".join(f"CASE WHEN r{i} THEN {quote(name)} END" for i, (name, _) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {rows}),
cut AS (
  SELECT rid, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(translate({text}, '{UPPER}', '{LOWER}'), chr(10)) AS parts FROM {table})
),
named AS (
  SELECT cut.rid, cut.doc_id, cut.pos, known.id
  FROM cut LEFT JOIN known ON known.sentence = regexp_replace(regexp_replace(cut.part, {quote(_DROPPED)}, ' ', 'g'), {quote(_EDGES)}, '', 'g')
),
told AS (
  SELECT rid, any_value(doc_id) AS doc_id, count(id) AS n_known, coalesce(string_agg(id, ',' ORDER BY pos) FILTER (WHERE id IS NOT NULL), '') AS sentence_ids
  FROM named GROUP BY rid
),
start AS (SELECT *, CASE WHEN sentence_ids = '' THEN '' ELSE ',' || replace(sentence_ids, ',', ',,') || ',' END AS rest FROM told),
{", ".join(steps)}
SELECT doc_id, CAST(n_known AS BIGINT) AS n_known, sentence_ids,
       array_to_string(list_filter([{names}], lambda n, i: n IS NOT NULL AND list_position([{names}], n) = i), ',') AS licenses
FROM {last}
"""
