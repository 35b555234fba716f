"""License scans: known licence sentences in a text, and the licences their order spells.

Native: DataFrame functions only, one pass, no shuffle. A text is cut into
sentences; a normalised sentence that is known becomes its identifier; the
identifiers of a text, in order, are matched against rules, each an ordered list
of identifiers. A rule matches if its identifiers occur in this order, other
known sentences between them or not.

The sentences and rules are parameters of fixed size (a mapping held in the plan),
not data that grows with the corpus.

Defined results
* null, empty or sentence-free text: no identifiers, no licence;
* a sentence that occurs twice is listed twice; each licence is listed once;
* normal form: A-Z to a-z, each run of signs other than a-z and 0-9 one space, no
  blanks at the ends; sentences end at . ! ? ; : followed by white space, or at a blank line;
* a single line break, with the comment signs around it, may stand for a blank or end a
  sentence: a known sentence is found wrapped, and also as a line among lines without signs;
* the SQL counterpart ends sentences at each line break, so it agrees on texts without
  wrapped sentences only;
* rows are judged one by one, so repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import ascii_lower

# Of the SQL counterpart; HARD and SOFT below mark the ends in the code.
SENTENCE_END = r"[.!?;:]+[ \t\r\n]+|[\r\n]+"
# Sentences of public licences and their usual notices, in normal form.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "see the license for the specific language governing permissions and limitations under the license",
    7: "released under the mit license",
    8: "licensed under the mit license",
    9: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    10: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    11: "this work is licensed under the gnu general public license version 3",
    12: "this work is licensed under the gnu general public license version 2",
    13: "this program is free software",
    14: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    15: "either version 3 of the license or at your option any later version",
    16: "either version 2 of the license or at your option any later version",
    17: "this program is distributed in the hope that it will be useful but without any warranty",
    18: "licensed under cc by nc 4 0",
    19: "licensed under cc by 4 0",
    20: "licensed under cc by sa 4 0",
    21: "this work is licensed under a creative commons attribution 4 0 international license",
    22: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    23: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    24: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    25: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    26: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    27: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    28: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    29: "this source code form is subject to the terms of the mozilla public license v 2 0",
    30: "this is free and unencumbered software released into the public domain",
    31: "all rights reserved",
}
RULES = [
    ("Apache-2.0", [1]),
    ("Apache-2.0", [2, 3, 4]),
    ("Apache-2.0", [2, 5, 6]),
    ("MIT", [7]),
    ("MIT", [8]),
    ("MIT", [9, 10]),
    ("GPL-3.0", [11]),
    ("GPL-2.0", [12]),
    ("GPL-3.0-or-later", [13, 14, 15]),
    ("GPL-2.0-or-later", [13, 14, 16]),
    ("CC-BY-NC-4.0", [18]),
    ("CC-BY-NC-4.0", [22]),
    ("CC-BY-4.0", [19]),
    ("CC-BY-4.0", [21]),
    ("CC-BY-SA-4.0", [20]),
    ("CC-BY-SA-4.0", [23]),
    ("BSD-3-Clause", [24, 25, 26, 27]),
    ("BSD-2-Clause", [24, 25, 26]),
    ("ISC", [28]),
    ("MPL-2.0", [29]),
    ("Unlicense", [30]),
]


HARD, SOFT = "\x01", "\x02"
# In this order: signs and white space to words with blanks, hard ends and single line breaks between them.
MARKS = [
    (r"[.!?;:]+[ \t\r\n]+", HARD),
    (r"\r\n?", "\n"),
    (rf"\n[^a-z0-9{HARD}\n]*\n[^a-z0-9{HARD}]*", HARD),
    (r"\n", SOFT),
    (rf"[^a-z0-9{HARD}{SOFT}]+", " "),
    (rf"[ {SOFT}]*{HARD}[ {HARD}{SOFT}]*", HARD),
    (rf" *{SOFT}[ {SOFT}]*", SOFT),
]


def sentence_ids(text: Column, sentences: dict[int, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    marked = F.translate(F.coalesce(ascii_lower(text), F.lit("")), HARD + SOFT, "  ")
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    longest = sorted(sentences.values(), key=len, reverse=True)
    known = rf"(?<![a-z0-9 ])(?:{'|'.join(s.replace(' ', f'[ {SOFT}]') for s in longest)})(?![a-z0-9 ])"
    ids = F.create_map(*[x for i, s in sentences.items() for x in (F.lit(s), F.lit(i))])
    found = F.regexp_extract_all(F.trim(marked), F.lit(known), F.lit(0))
    return F.transform(found, lambda s: F.element_at(ids, F.translate(s, SOFT, " ")))


def like_pattern(rule: list[int]) -> str:
    return "%" + "%".join(f"<{i}>" for i in rule) + "%"


def license_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[int, str] | None = None, rules: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """Rows doc_id, sentence_ids (array), licenses (array, sorted): one for each input row."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), sentence_ids(F.col(f"`{text_col}`"), sentences).alias("sentence_ids"))
    spelled = F.concat(F.lit("<"), F.array_join(F.col("sentence_ids").cast("array<string>"), "><"), F.lit(">"))
    found = F.array(*[F.when(F.col("spelled").like(like_pattern(ids)), F.lit(name)) for name, ids in rules])
    docs = docs.withColumn("spelled", spelled)
    return docs.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(F.array_compact(found))).alias("licenses"))


def license_sql(sentences: dict[int, str] | None = None, rules: list[tuple[str, list[int]]] | None = None) -> str:
    """The digest of the scan in DuckDB's SQL."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = ", ".join(f"({i}, '{s}')" for i, s in sentences.items())
    names = ", ".join(f"('{n}', '{like_pattern(r)}')" for n, r in rules)
    return rf"""
WITH known(id, s) AS (VALUES {known}), rules(license, pattern) AS (VALUES {names}),
cut AS (SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{SENTENCE_END}') a FROM documents),
one AS (SELECT doc_id, i, trim(regexp_replace(a[i], '[^a-z0-9]+', ' ', 'g')) s FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) i FROM cut)),
hit AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) ids, '<' || string_agg(id, '><' ORDER BY i) || '>' spelled, count(*) n
        FROM one JOIN known USING (s) GROUP BY doc_id),
lic AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) licenses
        FROM (SELECT DISTINCT doc_id, license FROM hit JOIN rules ON spelled LIKE pattern) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_sentences, coalesce(ids, '') sentence_ids, coalesce(licenses, '') licenses
FROM documents d LEFT JOIN hit USING (doc_id) LEFT JOIN lic USING (doc_id)
"""
