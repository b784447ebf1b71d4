"""License scans by sentence rules [native].

Each text is cut into sentences, the license-like ones are normalised and looked
up among known license sentences, and the resulting sequence of identifiers is
matched against ordered rules: the first rule whose identifiers occur in a row
consumes them, every time they do, so longer rules stand before their parts.

Plan: a projection with higher-order functions and two map literals; one scan of
two columns, no shuffle, no Python. A single regex skips documents that have no
license word at all.

Edge cases: null and empty texts have no sentences and status ``none``; repeated
documents each get a row; repeated notices are listed as often as they occur in
``sentence_ids`` and once in ``licenses``; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.llm.common import table, whole_text

#: Normalised sentences of public license notices and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2_under",
    "licensed under the apache license version 2 0 the license": "apache2_under",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at": "apache2_copy",
    "http www apache org licenses license 2 0": "apache2_url",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "this work is licensed under the gnu general public license version 3": "gpl3_under",
    "this work is licensed under the gnu general public license version 2": "gpl2_under",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_nowarranty",
    "see the gnu general public license for more details": "gpl_see",
    "licensed under the gnu lesser general public license version 3": "lgpl3_under",
    "licensed under the gnu affero general public license version 3": "agpl3_under",
    "released under the mit license": "mit_under",
    "licensed under the mit license": "mit_under",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_asis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "the mit license": "mit_title",
    "the mit license mit": "mit_title",
    "mit license": "mit_title",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_asis",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd_liability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd_liability",
    "bsd 2 clause license": "bsd2_title",
    "bsd 3 clause license": "bsd3_title",
    "isc license": "isc_title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_asis",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd_grant",
    "boost software license version 1 0 august 17th 2003": "bsl_title",
    "distributed under the boost software license version 1 0": "bsl_under",
    "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor": "bsl_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement": "bsl_asis",
    "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "bsl_liability",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl_grant",
    "this software is provided as is without any express or implied warranty": "zlib_asis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "you should have received a copy of the gnu general public license along with this program": "gpl_copy",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_later",
    "see the gnu lesser general public license for more details": "lgpl_see",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_under",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_copy",
    "apache license version 2 0 january 2004": "apache2_title",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4_under",
    "spdx license identifier bsd 2 clause": "bsd2_spdx",
    "spdx license identifier isc": "isc_spdx",
    "spdx license identifier mpl 2 0": "mpl2_spdx",
    "spdx license identifier gpl 2 0 only": "gpl2_spdx",
    "spdx license identifier gpl 3 0 or later": "gpl3later_spdx",
    "spdx license identifier gpl 2 0 or later": "gpl2later_spdx",
    "licensed under cc by nc 4 0": "ccbync4_under",
    "licensed under cc by sa 4 0": "ccbysa4_under",
    "licensed under cc by 4 0": "ccby4_under",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4_under",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_under",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "spdx license identifier apache 2 0": "apache2_spdx",
    "spdx license identifier mit": "mit_spdx",
    "spdx license identifier gpl 3 0 only": "gpl3_spdx",
    "spdx license identifier bsd 3 clause": "bsd3_spdx",
    "all rights reserved": "all_rights",
}

#: Ordered rules: (license, identifiers that follow one another).
RULES = [
    ("Apache-2.0", ["apache2_under", "apache2_comply", "apache2_copy", "apache2_url", "apache2_asis", "apache2_see"]),
    ("Apache-2.0", ["apache2_under", "apache2_comply", "apache2_copy", "apache2_asis", "apache2_see"]),
    ("GPL-3.0-or-later", ["gpl3_later", "gpl_nowarranty", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl2_later", "gpl_nowarranty", "gpl_see"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_asis", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_asis"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_asis", "bsd_liability"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_asis", "bsd_liability"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSL-1.0", ["bsl_grant", "bsl_notice", "bsl_asis", "bsl_liability"]),
    ("ISC", ["isc_grant", "isc_asis"]),
    ("Zlib", ["zlib_asis", "zlib_grant", "zlib_notice"]),
    ("LGPL-2.1-or-later", ["lgpl21_later"]),
    ("EPL-2.0", ["epl2_under"]),
    ("MPL-2.0", ["mpl2_under", "mpl2_copy"]),
    ("BSL-1.0", ["bsl_under"]),
    ("0BSD", ["0bsd_grant"]),
    ("BSD-2-Clause", ["bsd2_spdx"]),
    ("ISC", ["isc_spdx"]),
    ("MPL-2.0", ["mpl2_spdx"]),
    ("GPL-2.0-only", ["gpl2_spdx"]),
    ("GPL-3.0-or-later", ["gpl3later_spdx"]),
    ("GPL-2.0-or-later", ["gpl2later_spdx"]),
    ("Apache-2.0", ["apache2_under"]),
    ("Apache-2.0", ["apache2_spdx"]),
    ("GPL-3.0-or-later", ["gpl3_later"]),
    ("GPL-2.0-or-later", ["gpl2_later"]),
    ("GPL-3.0-only", ["gpl3_under"]),
    ("GPL-3.0-only", ["gpl3_spdx"]),
    ("GPL-2.0-only", ["gpl2_under"]),
    ("LGPL-3.0-only", ["lgpl3_under"]),
    ("AGPL-3.0-only", ["agpl3_under"]),
    ("MIT", ["mit_under"]),
    ("MIT", ["mit_spdx"]),
    ("BSD-3-Clause", ["bsd3_spdx"]),
    ("CC-BY-NC-4.0", ["ccbync4_under"]),
    ("CC-BY-SA-4.0", ["ccbysa4_under"]),
    ("CC-BY-4.0", ["ccby4_under"]),
    ("MPL-2.0", ["mpl2_under"]),
    ("Unlicense", ["unlicense"]),
    ("All-Rights-Reserved", ["all_rights"]),
]

#: Every known sentence holds one of these, and only sentences that do are looked at.
LIKE = "licen[sc]e|licensed|copyright|permission|redistribut|warrant|public domain|free software|rights reserved|this file except|conditions of any kind|software is provided|this notice may not"

#: Normalised copyright lines differ by year and holder; they are known by their form, and stand outside the sequences.
COPYRIGHT = "^(portions )?copyright (c )?([0-9]{4} )+[a-z0-9 ]+$"
OUTSIDE = "copyright"


def license_scan(docs: DataFrame) -> DataFrame:
    """Adds to (doc_id, source): sentence_ids, licenses, n_sentences, n_known, n_unknown, status.

    ``n_sentences`` counts the license-like sentences; ``status`` is ``none`` without
    any, ``known`` if a rule matched and every license-like sentence is known,
    ``partial`` if a rule matched beside unknown ones, else ``unknown``.
    """
    names = list(SENTENCES)
    known = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(SENTENCES[n]) for n in names)))
    norm = lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    like = lambda s: s.rlike(LIKE)

    def cut(s):
        """A wrapped sentence if it is known as a whole, else its lines."""
        return F.when(F.try_element_at(known, norm(s)).isNotNull(), F.array(s)).otherwise(F.split(s, "\n"))

    ends = F.split(F.regexp_replace("text", r"([.!?;])[ \t-\r]+", "$1\u001e"), "\u001e|\n[ \t\r]*\n")
    d = docs.select("doc_id", "source", whole_text().alias("text"))
    d = d.withColumn("text", F.when(F.col("text").rlike(f"(?i){LIKE}"), F.col("text")).otherwise(""))
    d = d.withColumn("_s", F.transform(F.filter(ends, lambda s: like(F.lower(s))), cut))
    d = d.withColumn("sentences", F.filter(F.transform(F.flatten("_s"), norm), like))
    name_of = lambda s: F.coalesce(F.try_element_at(known, s), F.when(s.rlike(COPYRIGHT), OUTSIDE))
    d = d.withColumn("ids", F.filter(F.transform("sentences", name_of), lambda i: i.isNotNull()))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(seq) + ",").alias("seq")) for name, seq in RULES))
    none = F.array().cast("array<string>")

    def consume(acc, rule):
        hit = F.instr(acc["rest"], rule["seq"]) > 0
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["seq"], F.lit(",#,"))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"))

    # Every identifier has commas of its own on both sides, so that neighbours share none: ,a,,b,
    start = F.struct(F.concat(F.lit(","), F.array_join(F.filter("ids", lambda i: i != OUTSIDE), ",,"), F.lit(",")).alias("rest"), none.alias("found"))
    d = d.withColumn("found", F.when(F.size("ids") == 0, none).otherwise(F.aggregate(rules, start, consume, lambda a: a["found"])))
    n, k = F.size("sentences"), F.size("ids")
    return d.select(
        "doc_id", "source", "sentences", "ids",
        F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct("found"), ",").alias("licenses"),
        n.cast("long").alias("n_sentences"), k.cast("long").alias("n_known"), (n - k).cast("long").alias("n_unknown"),
        F.when(n == 0, "none").when(F.size("found") == 0, "unknown").when(n == k, "known").otherwise("partial").alias("status"),
    )


def op1_of(docs: DataFrame) -> DataFrame:
    return license_scan(docs).select("doc_id", "source", "sentence_ids", "licenses", "n_sentences", "n_known", "n_unknown", "status")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_of(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    steps, last = [], "seqs"
    for j, (name, seq) in enumerate(RULES):
        s = "," + ",,".join(seq) + ","
        steps.append(f"r{j} AS (SELECT rid, CASE WHEN contains(rest, '{s}') THEN replace(rest, '{s}', ',#,') ELSE rest END AS rest, CASE WHEN contains(rest, '{s}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{j}"
    # the first of equal names, in order
    names = f"(SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(found) AS x, unnest(range(len(found))) AS i) GROUP BY x))"
    return rf"""
WITH known(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
c AS (SELECT rid, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT rid, regexp_split_to_array(regexp_replace(text, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(30), 'g'), chr(30) || '|\n[\x20\x09\x0D]*\n') AS x FROM d)),
l AS (SELECT rid, i, CASE WHEN {norm.format('s')} IN (SELECT s FROM known) THEN [s] ELSE string_split(s, chr(10)) END AS y FROM c WHERE regexp_matches(lower(s), '{LIKE}')),
t AS (SELECT rid, i, j, {norm.format('z')} AS s FROM (SELECT rid, i, unnest(y) AS z, unnest(range(len(y))) AS j FROM l)),
u AS (SELECT rid, i, j, t.s, coalesce(known.id, CASE WHEN regexp_matches(t.s, '{COPYRIGHT}') THEN '{OUTSIDE}' END) AS id FROM t LEFT JOIN known ON t.s = known.s WHERE regexp_matches(t.s, '{LIKE}')),
a AS (SELECT rid, count(*) AS n, count(id) AS k, string_agg(id, ',' ORDER BY i, j) AS ids, coalesce(string_agg(id, ',,' ORDER BY i, j) FILTER (id <> '{OUTSIDE}'), '') AS seq FROM u GROUP BY rid),
seqs AS (SELECT rid, ',' || seq || ',' AS rest, CAST([] AS VARCHAR[]) AS found FROM a WHERE k > 0),
{', '.join(steps)},
m AS (SELECT rid, found, {names} AS names FROM {last})
SELECT d.doc_id, d.source, coalesce(a.ids, '') AS sentence_ids, coalesce(m.names, '') AS licenses, coalesce(a.n, 0)::BIGINT AS n_sentences,
       coalesce(a.k, 0)::BIGINT AS n_known, (coalesce(a.n, 0) - coalesce(a.k, 0))::BIGINT AS n_unknown,
       CASE WHEN a.n IS NULL THEN 'none' WHEN coalesce(len(m.found), 0) = 0 THEN 'unknown' WHEN a.n = a.k THEN 'known' ELSE 'partial' END AS status
FROM d LEFT JOIN a ON d.rid = a.rid LEFT JOIN m ON d.rid = m.rid
"""


OP1_SQL = _sql()
