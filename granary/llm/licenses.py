"""Licence recognition by sentence rules.

A text is cut into sentences, each sentence is normalised and looked up among known licence sentences, and the
sequence of identifiers found is matched against rules in a fixed order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import LOWER, UPPER, ascii_lower

#: Normalised licence sentence -> identifier.
SENTENCES = {
    "released under the mit license": "MitName",
    "licensed under the mit license": "MitName",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitDisclaimer",
    "licensed under the apache license version 2 0": "Apache2Name",
    "licensed under the apache license version 2 0 the license": "Apache2Name",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "this work is licensed under the gnu general public license version 3": "Gpl3Name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplHope",
    "licensed under cc by nc 4 0": "CcByNc4Name",
    "licensed under cc by 4 0": "CcBy4Name",
    "licensed under cc by sa 4 0": "CcBySa4Name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdDisclaimer",
    "all rights reserved": "AllRights",
    "you may obtain a copy of the license at": "ApacheCopy",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21Later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LgplHope",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Later",
    "this source code form is subject to the terms of the mozilla public license v": "MplName",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MplCopy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MplCopy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBsdGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscDisclaimer",
    "this is free and unencumbered software released into the public domain": "UnlicenseName",
    "cc0 1 0 universal": "Cc0Name",
    "licensed under cc0 1 0": "Cc0Name",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Name",
}

#: Licence identifiers that a tag line may name.
TAGGED = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
SENTENCES |= {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', tag.lower())}": f"Tag-{tag}" for tag in TAGGED}

#: Rules in the order in which they are tried; what a rule matches is used up.
RULES = [
    ("BSD-3-Clause", ["AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdDisclaimer"]),
    ("BSD-2-Clause", ["AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdDisclaimer"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdDisclaimer"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdDisclaimer"]),
    ("MIT", ["MitGrant", "MitNotice", "MitDisclaimer"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GplHope"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GplHope"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("Apache-2.0", ["Apache2Name", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["Apache2Name"]),
    ("MIT", ["MitName"]),
    ("GPL-3.0-only", ["Gpl3Name"]),
    ("CC-BY-NC-4.0", ["CcByNc4Name"]),
    ("CC-BY-SA-4.0", ["CcBySa4Name"]),
    ("CC-BY-4.0", ["CcBy4Name"]),
    ("AGPL-3.0-or-later", ["Agpl3Later", "GplHope"]),
    ("AGPL-3.0-or-later", ["Agpl3Later"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later", "GplHope"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later", "LgplHope"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later"]),
    ("MPL-2.0", ["MplName", "MplCopy"]),
    ("MPL-2.0", ["MplName"]),
    ("ISC", ["IscGrant", "IscDisclaimer"]),
    ("ISC", ["IscGrant"]),
    ("0BSD", ["ZeroBsdGrant", "IscDisclaimer"]),
    ("Unlicense", ["UnlicenseName"]),
    ("CC0-1.0", ["Cc0Name"]),
    ("EPL-2.0", ["Epl2Name"]),
    *[(tag, [f"Tag-{tag}"]) for tag in TAGGED],
    ("Proprietary", ["AllRights"]),
]

#: A sentence ends at one of .!?; before white space, at a colon that ends its line, and at a line without letters and digits.
BREAK = r"\n[^a-z0-9\n]*\n|[.!?;][\x20\x09-\x0D]+|:[\x20\x09]*\n"


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_licenses), one row per row of `docs`.

    sentence_ids lists the identifiers found in text order, licenses the rules that matched in rule order, each
    once per rule, both space-joined; a text that is null, empty or without a known sentence gives empty strings.
    Line ends inside a sentence are spaces, and marks at the start of a line don't count, so that wrapped and
    commented texts are read as they are meant; a piece that is no known sentence is looked up line by line as well,
    for names on a line of their own. Unknown sentences are skipped over. Texts are read whole, ids and rows may
    repeat, an empty table gives an empty result, and other columns are not read. The list is fixed, so it travels
    inside the plan.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    there = lambda x: x.isNotNull()
    parts = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), BREAK, -1)
    lines = lambda s: F.when(F.contains(s, F.lit("\n")), F.filter(F.transform(F.split(s, "\n"), lambda x: known[_normal(x)]), there))
    found = F.transform(parts, lambda s: F.struct(s.alias("s"), known[_normal(s)].alias("id")))
    ids = F.flatten(F.filter(F.transform(found, lambda p: F.when(p["id"].isNotNull(), F.array(p["id"])).otherwise(lines(p["s"]))), there))
    out = docs.select(F.col(doc_id).alias("doc_id"), F.array_join(ids, " ").alias("sentence_ids"))
    rest, found = F.concat(F.lit(" "), F.replace("sentence_ids", F.lit(" "), F.lit("  ")), F.lit(" ")), []
    for k, (name, sequence) in enumerate(RULES):
        sought = "".join(f" {x} " for x in sequence)
        out = out.withColumn(f"_rest{k}", rest)
        found.append(F.when(F.contains(F.col(f"_rest{k}"), F.lit(sought)), F.lit(name)))
        rest = F.replace(F.col(f"_rest{k}"), F.lit(sought), F.lit(" # "))
    return out.select("doc_id", "sentence_ids", F.concat_ws(" ", *found).alias("licenses"), F.size(F.array_compact(F.array(*found))).alias("n_licenses"))


def license_sql(table: str = "documents") -> str:
    """The same scan as DuckDB SQL."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    sql = (
        f"WITH known(sentence, ident) AS (VALUES {values}), "
        f"pieces AS (SELECT doc_id, unnest(s) AS piece, generate_subscripts(s, 1) AS place FROM (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}') AS s FROM {table})), "
        "looked AS (SELECT pieces.*, ident FROM pieces LEFT JOIN known ON trim(regexp_replace(piece, '[^a-z0-9]+', ' ', 'g')) = known.sentence), "
        "lines AS (SELECT doc_id, place, unnest(l) AS line, generate_subscripts(l, 1) AS nth FROM (SELECT doc_id, place, string_split(piece, chr(10)) AS l FROM looked WHERE ident IS NULL AND contains(piece, chr(10)))), "
        "named AS (SELECT doc_id, place, nth, known.ident FROM lines JOIN known ON trim(regexp_replace(line, '[^a-z0-9]+', ' ', 'g')) = known.sentence UNION ALL SELECT doc_id, place, 0, ident FROM looked WHERE ident IS NOT NULL), "
        "found AS (SELECT doc_id, string_agg(ident, ' ' ORDER BY place, nth) AS ids FROM named GROUP BY doc_id), "
        f"r0 AS (SELECT d.doc_id, coalesce(f.ids, '') AS sentence_ids, ' ' || replace(coalesce(f.ids, ''), ' ', '  ') || ' ' AS rest FROM {table} d LEFT JOIN found f ON d.doc_id = f.doc_id)"
    )
    flags: list[str] = []
    for k, (_, sequence) in enumerate(RULES):
        sought = "".join(f" {x} " for x in sequence)
        flags.append(f"m{k}")
        sql += f", r{k + 1} AS (SELECT * EXCLUDE (rest), contains(rest, '{sought}') AS m{k}, replace(rest, '{sought}', ' # ') AS rest FROM r{k})"
    names = ", ".join(f"CASE WHEN m{k} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    count = " + ".join(f"m{k}::INT" for k in range(len(RULES)))
    return sql + f" SELECT doc_id, sentence_ids, concat_ws(' ', {names}) AS licenses, CAST({count} AS INT) AS n_licenses FROM r{len(RULES)}"
