"""License scans: passages of a text compared with licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, all but a-z and 0-9 as a space; so line breaks and comment marks make no
difference. Passages are placed where a template's bigrams stand: a start s is one at which a quarter or more of them lie in their
places, and a passage reaches from one start s to the end that another one at most half a template later gives (words may have been put in
between). Dice >= t needs two thirds of a template's bigrams in the text (at t = 0.8), which leaves hardly a template to compare,
and a passage with between t / (2 - t) and (2 - t) / t times as many distinct bigrams. The words by which a template differs from its
relatives (a version, "lesser") must be in the passage. Passages compete for the words that they share: of each word the best one
counts, and a passage stays if it has more than half of its words; so a notice has one licence.

Everything is a built-in expression; templates are literals, of fixed number. Null and empty texts have no passages. Equal
passages of a document count once; repeated rows count together under their doc_id. Documents without a match give no row. The first
line of BSD licences is BSD-2-Clause unless the document has the third clause. Extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import _let
from .runtime import table, written

THRESHOLD = 0.8
#: SPDX ids, the words that tell a template from its relatives, and the wording of public licence notices.
TEMPLATES = (
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "apache 2", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "mit", "SPDX-License-Identifier: MIT"),
    ("MIT", "", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "2", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "lesser 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", "3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "lesser 2 1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lesser 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gpl 3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "gpl 3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "gpl 2", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "gpl 2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "lgpl 3", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL-2.1", "lgpl 2 1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "agpl 3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("GPL-3.0", "3 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "2 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "lesser 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "lesser 2 1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "affero 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "bsd 2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "bsd 3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "eclipse 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "boost", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "nc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "by", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "sa", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "noncommercial sharealike", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: A licence whose notice begins like another's, which it gives way to.
GIVES_WAY = ("BSD-2-Clause", "BSD-3-Clause")


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_pairs(text: str) -> list[tuple[str, str]]:
    w = normal_words(text)
    return list(zip(w, w[1:], strict=False))


def _up(x: float) -> int:
    return int(x - 1e-9) + (x - 1e-9 > int(x - 1e-9))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Numbers of distinct bigrams that a passage may have for a template of ``size``, rounded outwards."""
    return _up(threshold / (2 - threshold) * size), int((2 - threshold) / threshold * size + 1e-9)


def _grams(w: Column) -> Column:
    n = F.size(w)
    return F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda x, y: F.xxhash64(x, y))


def _known(pairs: list[tuple[str, str]]) -> Column:
    return F.array(*(F.xxhash64(F.lit(x), F.lit(y)) for x, y in pairs))


def _templates(threshold: float) -> Column:
    """All templates as a literal array of their figures, in order."""
    rows = []
    for license_id, keys, text in TEMPLATES:
        pairs = template_pairs(text)
        low, high = bounds(len(set(pairs)), threshold)
        figures = {"license": license_id, "n": len(pairs) + 1, "size": len(set(pairs)), "low": low, "high": high}
        words = F.array(*map(F.lit, keys.split())) if keys else F.array().cast("array<string>")
        rows.append(F.struct(*(F.lit(v).alias(k) for k, v in figures.items()), words.alias("keys"), _known(pairs).alias("grams")))
    return F.array(*rows)


def candidates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """k1, k2 (a row's key), doc_id, w, b and t: rows and the templates of which they have enough bigrams."""
    every = sorted({p for _, _, text in TEMPLATES for p in template_pairs(text)})

    def enough(m: Column) -> Column:
        hits = []
        for t, (_, _, text) in enumerate(TEMPLATES):
            pairs = sorted(set(template_pairs(text)))
            least = bounds(len(pairs), threshold)[0]  # Dice >= t with as many bigrams of its own
            hits.append(F.when(F.size(F.array_intersect(m, _known(pairs))) >= least, F.lit(t)))
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    doc, text = F.col("doc_id").cast("long"), F.col("text")
    w = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    grams = _let(w, lambda x: F.struct(x.alias("w"), _grams(x).alias("b")))
    rows = documents.where("text is not null").select(F.coalesce(doc, F.lit(-1)).alias("k1"), F.xxhash64(text, doc.isNull()).alias("k2"), doc.alias("doc_id"), grams.alias("g"))
    rows = rows.withColumn("ts", _let(F.array_intersect("g.b", _known(every)), lambda m: F.when(F.size(m) >= 2, enough(m))))
    return rows.where(F.size("ts") > 0).select("k1", "k2", "doc_id", "g.w", "g.b", F.explode("ts").alias("t"))


def passages(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, lo, hi (words), dice, part (hash of the words) of the passages that win."""
    rows = written(candidates(documents, threshold).dropDuplicates(["k1", "k2", "t"]), "license_candidates")
    of, row = F.get(_templates(threshold), F.col("t")), ["k1", "k2", "t"]
    each = rows.select(*row, of["grams"].alias("grams"), F.posexplode("b").alias("pos", "h")).where(F.array_contains("grams", F.col("h")))
    own = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda k: F.get("grams", k) == F.col("h"))
    starts = each.select(*row, "pos", F.explode(own).alias("k")).groupBy(*row, (F.col("pos") - F.col("k")).alias("s")).agg(F.count("*").alias("votes"))
    starts = written(starts.where(4 * F.col("votes") >= of["size"]).select(*row, "s", of["n"].alias("n")), "license_starts")
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    block = F.floor(F.col("s") / half)
    later = starts.select(*row, F.col("s").alias("s2"), block.alias("block"))
    met = starts.select(*row, "s", "n", F.explode(F.array(block, block + 1)).alias("block")).join(later.hint("merge"), [*row, "block"]).where("s2 between s and s + floor(n / 2)")
    found = met.select(*row, F.greatest("s", F.lit(0)).alias("lo"), (F.col("s2") + F.col("n")).alias("hi")).distinct().join(rows.hint("merge"), row)
    found = found.withColumn("hi", F.least("hi", F.size("w"))).withColumn("own", F.array_distinct(F.slice("b", F.col("lo") + 1, F.col("hi") - F.col("lo") - 1)))
    words = F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    dice = 2.0 * F.size(F.array_intersect("own", of["grams"])) / (F.size("own") + of["size"])
    found = found.where(F.size("own").between(of["low"], of["high"]) & (F.size(F.array_except(of["keys"], words)) == 0)).withColumn("dice", dice).where(F.col("dice") >= threshold)
    found = written(found.select(*row, "doc_id", "lo", "hi", "dice", of["license"].alias("license"), F.xxhash64(words).alias("part")).distinct(), "license_passages")

    place = F.struct("dice", (F.col("hi") - F.col("lo")).alias("n"), (-F.col("t")).alias("t"), (-F.col("lo")).alias("lo"))
    best = found.select("k1", "k2", place.alias("p"), F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("pos")).groupBy("k1", "k2", "pos").agg(F.max("p").alias("p"))
    wins = best.groupBy("k1", "k2", "p").agg(F.count("*").alias("wins")).where("2 * wins > p.n")
    wins = wins.select("k1", "k2", (-F.col("p.t")).alias("t"), (-F.col("p.lo")).alias("lo"), (-F.col("p.lo") + F.col("p.n")).alias("hi"))
    return found.join(wins.hint("merge"), ["k1", "k2", "t", "lo", "hi"], "left_semi").select("doc_id", "license", "lo", "hi", "dice", "part")


def scan(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_parts (distinct passages), dice (the best, to six places)."""
    rows = passages(documents, threshold).groupBy("doc_id", "license").agg(F.countDistinct("part").alias("n_parts"), F.round(F.max("dice"), 6).alias("dice"))
    weak, strong = GIVES_WAY
    other = rows.where(F.col("license") == strong).select(F.col("doc_id").alias("other"))
    stays = rows.where(F.col("license") == weak).join(other, F.col("doc_id").eqNullSafe(F.col("other")), "left_anti")
    return rows.where(F.col("license") != weak).unionByName(stays)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = ", ".join("(" + ", ".join([str(k), *("'" + x.replace("'", "''") + "'" for x in row)]) + ")" for k, row in enumerate(TEMPLATES))
    words = "list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t0 AS (SELECT t, id, {words.format('keys')} AS keys, {words.format('x')} AS w FROM (VALUES {quoted}) AS v(t, id, keys, x)),
templates AS (SELECT t, id, keys, len(w) AS n, {pairs} AS b, len(list_distinct({pairs})) AS size FROM t0),
tg AS (SELECT t, unnest(b) AS g, generate_subscripts(b, 1) - 1 AS k FROM templates),
d0 AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT row_number() OVER () AS r, doc_id, {words.format('text')} AS w FROM d0),
d AS (SELECT r, doc_id, w, {pairs} AS b FROM d1 WHERE len(w) >= 2),
dg AS (SELECT r, unnest(b) AS g, generate_subscripts(b, 1) - 1 AS pos FROM d),
starts AS (SELECT r, t, pos - k AS s, count(*) AS votes FROM dg JOIN tg USING (g) GROUP BY ALL),
kept AS (SELECT r, t, s, n FROM starts JOIN templates USING (t) WHERE 4 * votes >= size),
spans AS (SELECT DISTINCT a.r, a.t, greatest(a.s, 0) AS lo, least(b.s + a.n, len(d.w)) AS hi FROM kept a JOIN kept b ON a.r = b.r AND a.t = b.t AND b.s BETWEEN a.s AND a.s + a.n // 2 JOIN d ON d.r = a.r),
own AS (SELECT s.*, doc_id, id, size, list_distinct(d.b[lo + 1:hi - 1]) AS own, x.b AS tb, d.w[lo + 1:hi] AS words, keys FROM spans s JOIN d USING (r) JOIN templates x USING (t)),
found AS (SELECT *, 2.0 * len(list_intersect(own, list_distinct(tb))) / (len(own) + size) AS dice FROM own
  WHERE len(own) * (2 - {THRESHOLD}) >= {THRESHOLD} * size - 1e-6 AND len(own) * {THRESHOLD} <= (2 - {THRESHOLD}) * size + 1e-6 AND len(list_filter(keys, lambda k: NOT list_contains(words, k))) = 0),
good AS (SELECT * FROM found WHERE dice >= {THRESHOLD}),
places AS (SELECT r, t, lo, hi, unnest(range(lo, hi)) AS pos, dice FROM good),
best AS (SELECT r, t, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY r, pos ORDER BY dice DESC, hi - lo DESC, t, lo) AS place FROM places) WHERE place = 1),
wins AS (SELECT r, t, lo, hi FROM best GROUP BY ALL HAVING 2 * count(*) > hi - lo),
rows AS (SELECT doc_id, id AS license, count(DISTINCT array_to_string(words, ' ')) AS n_parts, round(max(dice), 6) AS dice FROM good SEMI JOIN wins USING (r, t, lo, hi) GROUP BY doc_id, id)
SELECT * FROM rows WHERE license <> '{GIVES_WAY[0]}' OR NOT EXISTS (FROM rows o WHERE o.doc_id IS NOT DISTINCT FROM rows.doc_id AND o.license = '{GIVES_WAY[1]}')"""


ORACLE = _oracle()
