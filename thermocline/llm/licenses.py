"""License scans: sentences are mapped to known licence sentences, their identifiers matched against ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

# The GNU licences: short name, adjective, SPDX name, versions.
GNU = (("gpl", "general", "GPL", ("3", "2")), ("lgpl", "lesser general", "LGPL", ("3", "2 1")), ("agpl", "affero general", "AGPL", ("3",)))
# How public licences state themselves, sentence by sentence as the cut leaves them (it also falls after ':' and
# ';'), in lower case, punctuation as one blank.
SENTENCES = {
    "apache2_by_name": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
                        "the asf licenses this file to you under the apache license version 2 0 the license",
                        "licensed under the terms of the apache license version 2 0", "spdx license identifier apache 2 0"),
    "apache2_condition": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at",
                     "you may obtain a copy of the license at http www apache org licenses license 2 0",
                     "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache2_as_is": ("unless required by applicable law or agreed to in writing software distributed under the license is "
                      "distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "mit_by_name": ("released under the mit license", "licensed under the mit license",
                    "this project is licensed under the mit license", "distributed under the mit license",
                    "this project is licensed under the mit license see the license file for details",
                    "licensed under the terms of the mit license", "this project is licensed under the terms of the mit license",
                    "released under the terms of the mit license", "spdx license identifier mit"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation "
                  "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                  "permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the software",),
    "mit_as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to "
                  "the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "gnu_free": ("this program is free software", "this library is free software"),
    "gnu_hope": ("this program is distributed in the hope that it will be useful but without any warranty",
                 "this library is distributed in the hope that it will be useful but without any warranty"),
    "gnu_implied": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that "
                  "the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the "
                   "following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_by_name": ("licensed under the bsd license", "released under the bsd license", "licensed under the terms of the bsd license",
                    "spdx license identifier bsd 2 clause", "spdx license identifier bsd 3 clause"),
    "mpl2_by_name": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                     "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies",
                  "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies"),
    "isc_as_is": ("the software is provided as is and the author disclaims all warranties with regard to this software including all "
                  "implied warranties of merchantability and fitness",),
    "isc_by_name": ("licensed under the isc license", "released under the isc license", "spdx license identifier isc"),
    "unlicense_free": ("this is free and unencumbered software released into the public domain",),
    "unlicense_grant": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
                        "as a compiled binary for any purpose commercial or non commercial and by any means",),
    "unlicense_by_name": ("licensed under the unlicense", "released under the unlicense", "spdx license identifier unlicense"),
    "zlib_as_is": ("this software is provided as is without any express or implied warranty",),
    "zlib_liable": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter "
                   "it and redistribute it freely subject to the following restrictions",),
    "zlib_by_name": ("licensed under the zlib license", "released under the zlib license", "spdx license identifier zlib"),
    "epl2_by_name": ("licensed under the eclipse public license version 2 0", "spdx license identifier epl 2 0",
                     "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which "
                     "is available at https www eclipse org legal epl 2 0",
                     "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which "
                     "accompanies this distribution"),
    "cc_by_nc_by_name": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "spdx license identifier cc by nc 4 0",
                         "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc_by_sa_by_name": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "spdx license identifier cc by sa 4 0",
                         "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc_by_by_name": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "spdx license identifier cc by 4 0",
                      "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc0_by_name": ("dedicated to the public domain under cc0 1 0", "spdx license identifier cc0 1 0"),
    "reserved": ("all rights reserved",),
}
for _v in ("3", "2", "2 1"):
    SENTENCES[f"gnu{_v.replace(' ', '')}_version"] = (f"either version {_v} of the license or at your option any later version",)
for _short, _adjective, _, _versions in GNU:
    _license = f"gnu {_adjective} public license"
    _terms = f"you can redistribute it and or modify it under the terms of the {_license} as published by the free software foundation"
    SENTENCES[f"{_short}_terms"] = (_terms,)
    SENTENCES[f"{_short}_see"] = (f"see the {_license} for more details",)
    for _v in _versions:
        _name, _tag = f"{_short}{_v.replace(' ', '')}", f"spdx license identifier {_short} {_v if ' ' in _v else _v + ' 0'}"
        SENTENCES[f"{_name}_terms"] = (f"{_terms} either version {_v} of the license or at your option any later version",)
        SENTENCES[f"{_name}_by_name"] = (
            *(f"{start}licensed under the {terms}{name} version {_v}" for start in ("", "this work is ") for terms in ("", "terms of the ")
              for name in (_license, _short)), _tag, f"{_tag} only", f"{_tag} or later")
# How sentences end that name somebody at their start.
ENDINGS = {"bsd_names": "may be used to endorse or promote products derived from this software without specific prior written permission"}


def _gnu_rules(short: str, spdx: str, version: str):
    """A GNU licence's notice, its terms cut once or not, and its name."""
    number, rest = version.replace(" ", ""), ("gnu_hope", "gnu_implied", f"{short}_see")
    name = f"{spdx}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
    return ((f"{name}-or-later", ("gnu_free", f"{short}{number}_terms", *rest)),
            (f"{name}-or-later", ("gnu_free", f"{short}_terms", f"gnu{number}_version", *rest)),
            (f"{name}-notice", (f"{short}{number}_by_name",)))


# Rules in the order they are tried: licence, and its sentences in the order they must stand.
RULES = (
    ("Apache-2.0", ("apache2_by_name", "apache2_condition", "apache2_copy", "apache2_as_is")),
    ("Apache-2.0-notice", ("apache2_by_name",)),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT-notice", ("mit_by_name",)),
    *(rule for short, _, spdx, versions in GNU for version in versions for rule in _gnu_rules(short, spdx, version)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-notice", ("bsd_by_name",)),
    ("MPL-2.0-notice", ("mpl2_by_name",)),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC-notice", ("isc_by_name",)),
    ("Unlicense", ("unlicense_free", "unlicense_grant")),
    ("Unlicense-notice", ("unlicense_by_name",)),
    ("Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant")),
    ("Zlib-notice", ("zlib_by_name",)),
    ("EPL-2.0-notice", ("epl2_by_name",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_by_name",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_by_name",)),
    ("CC-BY-4.0", ("cc_by_by_name",)),
    ("CC0-1.0", ("cc0_by_name",)),
    ("all-rights-reserved", ("reserved",)),
)
NAMES = tuple(dict.fromkeys(name for name, _ in RULES))
#: A full text makes the notice of the same licence superfluous.
COVERS = {f"{whole}-notice": whole for whole in NAMES if f"{whole}-notice" in NAMES}
COVERS |= {f"{name.removesuffix('-or-later')}-notice": name for name in NAMES if name.endswith("-or-later")}
COVERS |= {"BSD-notice": "BSD-2-Clause", "BSD-2-Clause": "BSD-3-Clause"}

# Words that every known sentence and every statement about a licence has one of.
MARKS = (r"(?i)licen[sc]|copyright|permission|warrant|redistribut|all rights reserved|obtain a copy|public domain|software")
UNKNOWN = "unknown"
CUT, KEPT = "\x01", "\x02"
#: What a cut would tear apart: an SPDX tag from its name, and "v. 2.0"; and a script's first line, which stands alone.
TAG, VERSION, SCRIPT = r"(?i)(SPDX-License-Identifier):[ \t]*", r"\b([vV])\.([^0-9A-Za-z]+[0-9])", r"\A(#![^\n]{0,250})\n"
#: After closing marks, and at lines of nothing but comment signs.
SENTENCE_END = r"([.!?;:])\s+|\n[ \t\r#*/%;!-]*\n\s*"
NOT_WORD = r"[^a-z0-9]+"


def sentences(text: Column) -> Column:
    """Sentences that speak of licences, as written: cut after closing marks and at lines without words."""
    whole = F.regexp_replace(F.regexp_replace(text, TAG, "$1" + KEPT * 2), VERSION, "$1" + KEPT + "$2")
    cut = F.split(F.regexp_replace(F.regexp_replace(whole, SCRIPT, "$1" + CUT), SENTENCE_END, "$1" + CUT), CUT)
    written = lambda s: F.regexp_replace(F.regexp_replace(s, KEPT * 2, ": "), KEPT, ".")
    return F.transform(F.filter(cut, lambda s: F.rlike(s, F.lit(MARKS))), written)


def normalised(sentence: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one blank."""
    return F.btrim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), NOT_WORD, " "))


def _known() -> Column:
    return F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])


def _named(known: Column, sentence: Column) -> Column:
    """The identifier of a known sentence, or else of a known ending; null for others."""
    plain = normalised(sentence)
    ends = [F.when(F.endswith(plain, F.lit(end)), F.lit(name)) for name, end in ENDINGS.items()]
    return F.coalesce(F.try_element_at(known, plain), *ends)


def _follows(ids: Column, rule: tuple[str, ...]) -> Column:
    """Whether the rule's sentences stand in ``ids`` in this order, others between them or not."""
    if len(rule) == 1:
        return F.array_contains(ids, rule[0])
    wanted = F.array(*map(F.lit, rule))
    done = F.aggregate(ids, F.lit(0), lambda at, x: at + F.when(x == F.get(wanted, at), 1).otherwise(0))
    return done == len(rule)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, ids, licenses) of every row of ``docs``.

    ``sentences`` are those that speak of licences; ``ids`` their identifiers.  A sentence may run over lines; one that
    is not known as a whole is looked up line by line, and is "unknown" if no line is known either.  ``licenses`` holds
    the rules that hold, in the order of the rules, without notices that a full text covers.  Null texts have none.
    Rows are handled one by one, nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    read = docs.select("doc_id", F.when(F.rlike(text, F.lit(MARKS)), sentences(text)).otherwise(none).alias("sentences"))
    known = _known()

    def identifiers(sentence):
        whole = _named(known, sentence)
        by_line = F.array_compact(F.transform(F.split(sentence, "\n"), lambda x: _named(known, x)))
        return F.when(whole.isNotNull(), F.array(whole)).when(F.size(by_line) > 0, by_line).otherwise(F.array(F.lit(UNKNOWN)))

    named = read.withColumn("ids", F.flatten(F.transform("sentences", identifiers)))
    holds = named.withColumn("holds", F.array_distinct(F.array_compact(F.array(
        *[F.when(_follows(F.col("ids"), rule), F.lit(name)) for name, rule in RULES]))))
    covered = F.create_map(*[F.lit(x) for pair in COVERS.items() for x in pair])
    return holds.select("doc_id", "sentences", "ids", F.filter(
        "holds", lambda r: ~F.coalesce(F.array_contains("holds", F.try_element_at(covered, r)), F.lit(False))).alias("licenses"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence sentences and the licences they amount to."""
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"),
        F.size(F.filter("ids", lambda s: s != UNKNOWN)).cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    """One row per sentence; the order of a rule is asked for with places instead of a fold."""
    known = ", ".join(f"('{t}', '{name}')" for name, texts in SENTENCES.items() for t in texts)
    rules = []
    for i, (name, rule) in enumerate(RULES):
        joins = "".join(f" JOIN found s{k} ON s{k}.doc_id = s{k - 1}.doc_id AND s{k}.place > s{k - 1}.place AND s{k}.id = '{s}'"
                        for k, s in enumerate(rule) if k)
        rules.append(f"SELECT DISTINCT s0.doc_id, {NAMES.index(name)} AS number, '{name}' AS rule FROM found s0{joins} WHERE s0.id = '{rule[0]}'")
    covered = ", ".join(f"('{a}', '{b}')" for a, b in COVERS.items())
    plain = f"trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '{NOT_WORD}', ' ', 'g'))"
    ending = " ".join(f"WHEN ends_with(plain, '{end}') THEN '{name}'" for name, end in ENDINGS.items())
    named = f"(SELECT *, coalesce(known.id, CASE {ending} END) AS name FROM (SELECT *, {plain} AS plain FROM {{0}}) p LEFT JOIN known ON known = plain)"
    whole = f"regexp_replace(regexp_replace(coalesce(text, ''), '{TAG}', '\\1' || chr(2) || chr(2), 'g'), '{VERSION}', '\\1' || chr(2) || '\\2', 'g')"
    return f"""
WITH known(known, id) AS (VALUES {known}), covered(notice, whole) AS (VALUES {covered}),
cut AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS number FROM (
  SELECT doc_id, string_split(regexp_replace(regexp_replace({whole}, '{SCRIPT}', '\\1' || chr(1)), '{SENTENCE_END}', '\\1' || chr(1), 'g'), chr(1)) AS parts
  FROM documents)),
sentence AS (SELECT doc_id, number, part FROM cut WHERE regexp_matches(part, '{MARKS}')),
line AS (SELECT doc_id, number, unnest(parts) AS part, generate_subscripts(parts, 1) AS line
         FROM (SELECT *, string_split(part, chr(10)) AS parts FROM sentence)),
whole AS (SELECT doc_id, number, 0 AS line, name AS id FROM {named.format('sentence')} WHERE name IS NOT NULL),
by_line AS (SELECT doc_id, number, line, name AS id FROM {named.format('line')} l WHERE name IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id = l.doc_id AND w.number = l.number)),
placed AS (SELECT * FROM whole UNION ALL SELECT * FROM by_line UNION ALL
  SELECT doc_id, number, 0, '{UNKNOWN}' FROM sentence s
  WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id = s.doc_id AND w.number = s.number)
    AND NOT EXISTS (SELECT 1 FROM by_line w WHERE w.doc_id = s.doc_id AND w.number = s.number)),
found AS MATERIALIZED (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY number, line) AS place FROM placed),
held AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(rules)})),
told AS (SELECT * FROM held h WHERE NOT EXISTS (
  SELECT 1 FROM covered c JOIN held w ON w.rule = c.whole WHERE c.notice = h.rule AND w.doc_id = h.doc_id)),
per_doc AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (id <> '{UNKNOWN}') AS n_known,
                   string_agg(id, ',' ORDER BY place) AS sentence_ids FROM found GROUP BY doc_id),
licences AS (SELECT doc_id, string_agg(rule, ',' ORDER BY number) AS licenses FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_known, 0) AS n_known,
       coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN licences USING (doc_id)
"""


OP10_SQL = _sql()
