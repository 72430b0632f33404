"""Licence recognition by sentences and ordered rules, in SQL functions only.

A text is cut into sentences, each is normalised (lower case, letters, digits
and version dots only) and mapped to the identifier of the first known licence
sentence whose pattern it matches; other sentences have none.  The identifiers
of a text, in order, are then matched against the rules in order: a rule is a
sequence of identifiers, finds all its occurrences, and takes them away from
the rules after it.  What no rule takes is reported as unmatched.  Between two
sentences of a rule at most ``GAP`` others may stand: known sentences that are
further apart belong to different notices.

All of it works on one row at a time: no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import constant, text_or_empty

# Sentences of public licence texts as ``CUT`` yields them,
# normalised, as patterns that must match the whole sentence.  In order; the
# first match names it.
_WORK = "(this (program|library|file|software|package|work)|[a-z0-9.]+)"
_REDISTRIBUTE = "you can redistribute it and or modify it under the terms of the gnu"
# Licences by the SPDX ids that name them, normalised; others are "spdx-other".
_SPDX = {
    "AGPL-3.0": r"agpl 3[.]0( only| or later)?", "LGPL-2.0": r"lgpl 2[.]0( only| or later)?", "LGPL-2.1": r"lgpl 2[.]1( only| or later)?",
    "LGPL-3.0": r"lgpl 3[.]0( only| or later)?", "GPL-1.0": r"gpl 1[.]0( only| or later)?", "MPL-1.1": r"mpl 1[.]1", "MPL-2.0": r"mpl 2[.]0( no copyleft exception)?",
    "EPL-1.0": r"epl 1[.]0", "EPL-2.0": r"epl 2[.]0", "BSD-2-Clause": "bsd 2 clause", "ISC": "isc", "0BSD": "0bsd", "Zlib": "zlib", "BSL-1.0": r"bsl 1[.]0",
    "CC0-1.0": r"cc0 1[.]0", "CC-BY-4.0": r"cc by 4[.]0", "CC-BY-SA-4.0": r"cc by sa 4[.]0", "CC-BY-NC-4.0": r"cc by nc 4[.]0", "Unlicense": "unlicense",
}
SENTENCES = [
    ("spdx-apache-2.0", r"spdx license identifier apache 2.0"),
    ("spdx-mit", r"spdx license identifier mit"),
    ("spdx-gpl-3.0", r"spdx license identifier gpl 3.0( only| or later)?"),
    ("spdx-gpl-2.0", r"spdx license identifier gpl 2.0( only| or later)?"),
    ("spdx-bsd-3", r"spdx license identifier bsd 3 clause"),
    *[(f"spdx-{licence.lower()}", f"spdx license identifier {id}") for licence, id in _SPDX.items()],
    ("spdx-other", r"spdx license identifier .*"),
    ("apache-2.0-ref", r"(.* )?licensed under the apache license,? version 2.0( the license)?"),
    ("apache-2.0-comply", r"you may not use this file except in compliance with the license"),
    ("apache-2.0-copy", r"you may obtain a copy of the license at.*"),
    ("apache-2.0-asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("apache-2.0-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-ref", r"(.* )?(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", r"(the|this) software is provided (by the copyright holders and contributors )?as is.*"),
    ("no-liability", r"in no event shall the (authors|copyright (holder|owner)s?).*be liable.*"),
    ("gpl-3.0-ref", r"(.* )?licensed under the gnu general public license,? version 3( or later)?"),
    ("gpl-2.0-ref", r"(.* )?licensed under the gnu general public license,? version 2( or later)?"),
    ("gpl-3.0-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 3.*"),
    ("gpl-2.0-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 2.*"),
    ("free-software", rf"{_WORK} is free software"),
    ("redistribute-gpl-3.0", rf"{_REDISTRIBUTE} general public license.*version 3.*"),
    ("redistribute-gpl-2.0", rf"{_REDISTRIBUTE} general public license.*version 2.*"),
    ("redistribute-lgpl-3.0", rf"{_REDISTRIBUTE} lesser general public license.*version 3.*"),
    ("redistribute-lgpl-2.1", rf"{_REDISTRIBUTE} lesser general public license.*version 2[.]1.*"),
    ("redistribute-lgpl", rf"{_REDISTRIBUTE} (lesser|library) general public license.*"),
    ("redistribute-agpl-3.0", rf"{_REDISTRIBUTE} affero general public license.*version 3.*"),
    ("redistribute-agpl", rf"{_REDISTRIBUTE} affero general public license.*"),
    ("redistribute-gpl", rf"{_REDISTRIBUTE} general public license.*"),
    ("version-2", r"(either )?version 2([.]0)? of the license.*"),
    ("version-2.1", r"(either )?version 2[.]1 of the license.*"),
    ("version-3", r"(either )?version 3([.]0)? of the license.*"),
    ("gpl-no-warranty", rf"{_WORK} is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl-more", r"see the gnu (lesser |library |affero )?general public license for more details"),
    ("gpl-copy", r"you should have received a copy of the gnu (lesser |library |affero )?general public license.*"),
    ("lgpl-ref", r"(.* )?licensed under the gnu lesser general public license.*"),
    ("agpl-ref", r"(.* )?licensed under the gnu affero general public license.*"),
    ("bsd-redistribute", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("bsd-source", r"(1 )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-endorse", r"(3 )?neither the name of .* nor the names of its contributors may be used to endorse or promote products.*"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license.*2.0.*"),
    ("mpl-head", r"this source code form is subject to the terms of the mozilla public license v"),
    ("version-2.0", r"2[.]0"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file,? you can obtain one at.*"),
    ("cc-by-nc-4.0-ref", r"(.* )?licensed under (a )?(cc by nc|creative commons attribution noncommercial) 4.0.*"),
    ("cc-by-sa-4.0-ref", r"(.* )?licensed under (a )?(cc by sa|creative commons attribution sharealike) 4.0.*"),
    ("cc-by-4.0-ref", r"(.* )?licensed under (a )?(cc by|creative commons attribution) 4.0.*"),
    ("cc0", r".*(cc0 1.0|dedicated to the public domain).*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("apache-2.0-title", r"(.* )?apache license version 2[.]0 january 2004.*"),
    ("gpl-3.0-title", r"(.* )?gnu general public license version 3 29 june 2007.*"),
    ("gpl-2.0-title", r"(.* )?gnu general public license version 2 june 1991.*"),
    ("lgpl-3.0-title", r"(.* )?gnu lesser general public license version 3 29 june 2007.*"),
    ("lgpl-2.1-title", r"(.* )?gnu lesser general public license version 2[.]1 february 1999.*"),
    ("agpl-3.0-title", r"(.* )?gnu affero general public license version 3 19 november 2007.*"),
    ("mpl-2.0-title", r"mozilla public license version 2[.]0.*"),
    ("bsl-1.0-title", r"boost software license version 1[.]0 august 17th 2003.*"),
    ("bsl-1.0-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation.*"),
    ("isc-grant", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that.*"),
    ("isc-as-is", r"the software is provided as is and .* disclaims all warranties.*"),
    ("isc-no-liability", r"in no event shall .* be liable for any special direct indirect or consequential damages.*"),
    ("rights", r"(.* )?all rights reserved"),
    ("copyright", r"copyright (c )?[0-9].*"),
    ("other-licence", r".*\b(licensed under|license agreement|terms of the license|public license)\b.*"),
]
_GPL_TAIL = ["gpl-no-warranty", "gpl-more", "gpl-copy"]
# The GNU notices: the heads that CUT makes of their wordings, each with and without the rest.
_GNU = [(licence, free + head + tail) for licence, heads in [
    ("GPL-3.0", [["redistribute-gpl-3.0"], ["redistribute-gpl", "version-3"]]),
    ("GPL-2.0", [["redistribute-gpl-2.0"], ["redistribute-gpl", "version-2"]]),
    ("LGPL-3.0", [["redistribute-lgpl-3.0"], ["redistribute-lgpl", "version-3"]]),
    ("LGPL-2.1", [["redistribute-lgpl-2.1"], ["redistribute-lgpl", "version-2.1"]]),
    ("LGPL-2.0", [["redistribute-lgpl", "version-2"]]),
    ("AGPL-3.0", [["redistribute-agpl-3.0"], ["redistribute-agpl", "version-3"]]),
] for head in heads for free in (["free-software"], []) for tail in (_GPL_TAIL, [])]
# Rules in order, whole licences before what refers to them.
RULES = [
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "as-is", "no-liability"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "as-is", "no-liability"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    *[(licence, [f"{licence.lower()}-title"]) for licence in ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0")],
    ("BSL-1.0", ["bsl-1.0-title", "bsl-1.0-grant"]),
    ("BSL-1.0", ["bsl-1.0-title"]),
    ("BSL-1.0", ["bsl-1.0-grant"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-no-liability"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-2.0-ref", "apache-2.0-comply", "apache-2.0-copy", "apache-2.0-asis", "apache-2.0-see"]),
    ("Apache-2.0", ["apache-2.0-ref"]),
    *_GNU,
    ("GPL-3.0", ["gpl-3.0-free", "gpl-no-warranty", "gpl-more", "gpl-copy"]),
    ("GPL-3.0", ["gpl-3.0-free"]),
    ("GPL-2.0", ["gpl-2.0-free", "gpl-no-warranty", "gpl-more", "gpl-copy"]),
    ("GPL-2.0", ["gpl-2.0-free"]),
    ("GPL-3.0", ["gpl-3.0-ref"]),
    ("GPL-2.0", ["gpl-2.0-ref"]),
    ("LGPL", ["lgpl-ref"]),
    ("AGPL", ["agpl-ref"]),
    ("MPL-2.0", ["mpl-head", "version-2.0", "mpl-copy"]),
    ("MPL-2.0", ["mpl-head", "version-2.0"]),
    ("MPL-2.0", ["mpl-2.0", "mpl-copy"]),
    ("MPL-2.0", ["mpl-2.0"]),
    ("MIT", ["mit-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-ref"]),
    ("CC-BY-4.0", ["cc-by-4.0-ref"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-2.0", ["spdx-apache-2.0"]),
    ("MIT", ["spdx-mit"]),
    ("GPL-3.0", ["spdx-gpl-3.0"]),
    ("GPL-2.0", ["spdx-gpl-2.0"]),
    ("BSD-3-Clause", ["spdx-bsd-3"]),
    *[(licence, [f"spdx-{licence.lower()}"]) for licence in _SPDX],
    ("all-rights-reserved", ["copyright", "rights"]),
    ("all-rights-reserved", ["rights"]),
]
# Every pattern above holds one of these words, so other sentences are passed over.
KEYWORDS = ("licen|copyright|permission|redistribut|provided|warrant|liable|rights|public domain|cc0|unencumbered|endorse|may not use|may obtain|unless required|"
            "is free software|distributed in the hope|of the mpl|^2[.]0$")
# Each id of an SPDX expression, the first after the tag and the others after an
# operator; the oracle's SQL has only the first.
SPDX_EACH = (r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+:-]+)"
             r"|\G(?!\A)(?:[ \t]+|[ \t]*\)[ \t)]*)(?:OR|AND|WITH|or|and|with)(?:[ \t]*\([ \t(]*|[ \t]+)([A-Za-z0-9.+:-]+)")
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"
CUT = r"[.!?:;][ \t\r\n]+|\n[ \t\r]*\n"
GAP = 8  # other sentences that may stand between two of a rule
COMMENT = r"(^|\n)[ \t]*(//+|#+|\*+|/\*+|;+|--+)[ \t]*"


def _spark_id(sentence):
    out = F.when(F.lit(False), "")
    for name, pattern in SENTENCES:
        out = out.when(sentence.rlike(f"^({pattern})$"), name)
    return F.when(sentence.rlike(KEYWORDS), out)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licences, unmatched)`` of every
    row of ``docs(doc_id, text, ...)``; the last three are lists.

    ``sentence_ids`` are the known sentences in order; ``licences`` the
    distinct licences of the rules that matched, in order of name;
    ``unmatched`` the known sentences that no rule took.  A null or empty text
    has none of them.  Repeated rows stay repeated, null ids stay null.
    """
    text = F.regexp_replace(F.regexp_replace(text_or_empty(), COMMENT, "$1"), SPDX_EACH, ". SPDX License Identifier $1$2 . ")
    sentence = F.transform(F.split(text, CUT), lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9.,]+", " "), r"[.,]+( |$)", " ")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(sentence, lambda s: s != "").alias("sentences"))
    named = F.transform("sentences", lambda s, i: F.struct(_spark_id(s).alias("id"), i.alias("at")))
    rows = rows.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.filter(named, lambda s: s["id"].isNotNull()).alias("_named"))
    rows = rows.withColumn("sentence_ids", F.transform("_named", lambda s: s["id"]))
    # "<a><b>~<c>": a rule's sequence is found as a piece of it, and blanked out; "~" where sentences are too far apart
    far = lambda s, i: (i > 0) & (s["at"] - F.get("_named", i - 1)["at"] > GAP + 1)
    rows = rows.withColumn("_left", F.concat(F.lit(""), F.concat_ws("", F.transform("_named", lambda s, i: F.concat(
        F.when(far(s, i), "~").otherwise(""), F.lit("<"), s["id"], F.lit(">"))))))
    rules = constant([["".join(f"<{s}>" for s in sequence), licence] for licence, sequence in RULES], "array<array<string>>")

    def apply(done, rule):
        left, found = F.replace(done["left"], rule[0], F.lit("|")), F.array_append(done["found"], rule[1])
        return F.when(F.contains(done["left"], rule[0]), F.struct(left.alias("left"), found.alias("found"))).otherwise(done)

    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<string>").alias("found"))
    rows = rows.withColumn("_done", F.when(F.col("_left") == "", start).otherwise(F.aggregate(rules, start, apply)))
    return rows.select(
        "doc_id", "n_sentences", "sentence_ids", F.array_sort(F.array_distinct("_done.found")).alias("licences"),
        F.regexp_extract_all("_done.left", F.lit("<([^>]*)>"), F.lit(1)).alias("unmatched"))


def scan_sql(table: str = "documents") -> str:
    """The same as DuckDB SQL, lists joined by commas; of an SPDX expression
    it reads only the first id, and none behind a parenthesis."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {q(f'^({p})$')}) THEN {q(n)}" for n, p in SENTENCES)
    left, steps, found = "ids", [], []
    for k, (licence, sequence) in enumerate(RULES):
        piece = q("".join(f"<{s}>" for s in sequence))
        steps.append(f"r{k} AS (SELECT *, CASE WHEN contains({left}, {piece}) THEN {q(licence)} END AS f{k}, replace({left}, {piece}, '|') AS l{k} FROM {f'r{k - 1}' if k else 'named'})")
        found.append(f"f{k}")
        left = f"l{k}"
    return f"""WITH cut AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), {q(COMMENT)}, '\\1', 'g'), {q(SPDX)}, '. SPDX License Identifier \\1 . ', 'g'), {q(CUT)}),
    lambda s: trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.,]+', ' ', 'g'), '[.,]+( |$)', ' ', 'g'))), lambda s: s <> '') AS ss FROM {table}),
marked AS (
  SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences,
    list_filter(list_transform(ss, lambda s, i: {{'id': CASE WHEN NOT regexp_matches(s, {q(KEYWORDS)}) THEN NULL {cases} END, 'at': i}}), lambda x: x.id IS NOT NULL) AS found FROM cut),
named AS (SELECT doc_id, n_sentences, list_transform(found, lambda x: x.id) AS sids, array_to_string(list_transform(found, lambda x, i:
    CASE WHEN i > 1 AND x.at - found[i - 1].at > {GAP + 1} THEN '~' ELSE '' END || '<' || x.id || '>'), '') AS ids FROM marked),
{', '.join(steps)}
SELECT doc_id, n_sentences, array_to_string(sids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{', '.join(found)}], lambda f: f IS NOT NULL))), ',') AS licences,
  array_to_string(regexp_extract_all({left}, '<([^>]*)>', 1), ',') AS unmatched
FROM r{len(RULES) - 1}"""
