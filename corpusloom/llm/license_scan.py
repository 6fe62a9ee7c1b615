"""Licence scans: Dice coefficient over word bigrams between a text's units and licence templates.

Units are a text's lines and the whole text.  Both sides are normalised: lower case, everything but letters and
digits is a blank.  Bigrams count with multiplicity; Dice is 2 * common / (|unit| + |template|).  A Dice of at least t
needs |unit| between t / (2 - t) and (2 - t) / t times |template|; units beyond all templates' bounds are dropped
before their bigrams are made, and each template meets only units within its own bounds.

scan() holds to these units, as its SQL does.  passages() also finds notices that are wrapped over lines, share a line
with other prose or are part of a full licence text: its units are all runs of words of a text, line ends being
blanks, whose size lies within a template's bounds.

DataFrame functions only.  The template table is fixed by the code (TEMPLATES), so its broadcast is bounded.
Defined results: null and empty texts have no matches; equal values go to the smaller template name; each repeated
row is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.8

#: Templates: short notices as they stand in texts, and permission paragraphs.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_BSD_HEAD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
_BSD_THIRD = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. '
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Full licence texts of one page and the GNU licences' other notices, which passages() compares besides TEMPLATES.
TEXTS: list[tuple[str, str]] = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-1.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 1 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Neighbouring words, joined by a blank; empty for fewer than two words."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def template_bigrams(spark, templates=None) -> DataFrame:
    """(template, license, t_size, bigram, t_count); template numbers follow the list."""
    rows = [(k, name, text) for k, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    table = spark.createDataFrame(rows, "template int, license string, text string")
    words = F.split(normalised(F.col("text")), " ")
    listed = table.withColumn("grams", bigrams(words)).withColumn("t_size", F.size("grams").cast("long"))
    return listed.select("template", "license", "t_size", F.explode("grams").alias("bigram")).groupBy("template", "license", "t_size", "bigram").agg(F.count("*").alias("t_count"))


def size_bounds(templates=None) -> list[int]:
    """Bigram counts of the templates."""
    import re

    return [max(0, len(re.findall(r"[^\W_]+", text)) - 1) for _, text in (TEMPLATES if templates is None else templates)]


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=None) -> DataFrame:
    """doc_id, unit (line from 0; -1 the whole text), license, n_bigrams, common, dice: the best template of each
    unit that reaches the threshold."""
    spark = docs.sparkSession
    sizes = size_bounds(templates)
    low, high = threshold / (2 - threshold) * min(sizes) - 1e-6, (2 - threshold) / threshold * max(sizes) + 1e-6
    rows = C.docs_of(docs).where("text is not null").withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("unit", "piece"))
    whole = rows.where(F.instr("text", "\n") > 0).select("row", "doc_id", F.lit(-1).alias("unit"), F.col("text").alias("piece"))
    count = F.regexp_count("piece", F.lit(r"[\p{L}\p{N}]+")) - 1
    units = lines.unionByName(whole).withColumn("n_bigrams", count.cast("long")).where(F.col("n_bigrams").between(low, high))
    each = units.select("row", "doc_id", "unit", "n_bigrams", F.explode(bigrams(F.split(normalised(F.lower("piece")), " "))).alias("bigram"))
    known = F.broadcast(template_bigrams(spark, templates))
    least, most = threshold * F.col("t_size"), (2 - threshold) * F.col("t_size")
    within = (F.col("n_bigrams") * (2 - threshold) >= least - 1e-9) & (F.col("n_bigrams") * threshold <= most + 1e-9)
    met = each.join(known, "bigram").where(within)
    shared = met.groupBy("row", "doc_id", "unit", "n_bigrams", "template", "license", "t_size", "bigram").agg(F.least(F.count("*"), F.first("t_count")).alias("both"))
    dice = (2.0 * F.col("common")) / (F.col("n_bigrams") + F.col("t_size"))
    scored = shared.groupBy("row", "doc_id", "unit", "n_bigrams", "template", "license", "t_size").agg(F.sum("both").alias("common")).withColumn("dice", dice).where(F.col("dice") >= threshold)
    best = scored.groupBy("row", "doc_id", "unit", "n_bigrams").agg(F.min_by(F.struct("license", "common", "dice"), F.struct(-F.col("dice"), "license", "template")).alias("b"))
    return best.select("doc_id", F.col("unit").cast("int").alias("unit"), F.col("b.license").alias("license"), "n_bigrams", F.col("b.common").alias("common"), F.col("b.dice").alias("dice"))


def anchors(known: list, threshold: float) -> list[str]:
    """Bigrams of which every run that reaches the threshold with some template has one.

    Such a run shares threshold / (2 - threshold) of the template's bigrams, so it can't miss all of a set that is
    larger than the rest; the longest bigrams are taken as the rarest."""
    out: set[str] = set()
    for k in {r["template"] for r in known}:
        mine = sorted((r for r in known if r["template"] == k), key=lambda r: (-len(r["bigram"]), r["bigram"]))
        room = mine[0]["t_size"] - threshold / (2 - threshold) * mine[0]["t_size"] + 1e-6
        for r in mine:
            out.add(r["bigram"])
            if (room := room - r["t_count"]) < 0:
                break
    return sorted(out)


def passages(docs: DataFrame, threshold: float = THRESHOLD, templates=None) -> DataFrame:
    """doc_id, start (word from 0), n_bigrams, license, common, dice: the runs of words of a text that reach the
    threshold with a template.

    A best run starts and ends at bigrams that count, so only such runs are compared.  Of overlapping runs that with
    the largest common * dice stays; ties go to the smaller license, template, start and end."""
    known = template_bigrams(docs.sparkSession, TEMPLATES + TEXTS if templates is None else templates)
    listed = known.collect()
    stretch = int((2 - threshold) / threshold * max(r["t_size"] for r in listed) + 1e-6)
    rows = C.docs_of(docs).where("text is not null").withColumn("row", F.monotonically_increasing_id())
    grams = rows.select("row", "doc_id", bigrams(F.split(normalised(F.col("text")), " ")).alias("grams"))
    held = grams.where(F.arrays_overlap("grams", F.array(*map(F.lit, anchors(listed, threshold)))))
    met = held.select("row", "doc_id", F.posexplode("grams").alias("pos", "bigram")).join(F.broadcast(known), "bigram")
    by = ["row", "doc_id", "template", "license", "t_size"]
    each = met.groupBy(*by, "bigram", "t_count").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    n = F.col("t_count").cast("int")
    # a hit counts in a run unless t_count hits of its bigram stand before it there: the run starts at or before prev
    hits = each.select(*by, F.inline(F.transform("at", lambda p, k: F.struct(p.alias("pos"), F.when(k >= n, F.get(F.col("at"), k - n)).alias("prev")))))
    ahead = Window.partitionBy("row", "template").orderBy("pos").rangeBetween(0, stretch - 1)
    ends = hits.withColumn("ahead", F.collect_list(F.struct("pos", "prev")).over(ahead))
    ends = ends.where(F.size("ahead") * (2 - threshold) >= threshold * F.col("t_size") - 1e-6)
    counted = F.filter("ahead", lambda x: x["prev"].isNull() | (x["prev"] < F.col("pos")))

    def run(x, k):
        size, common = (x["pos"] - F.col("pos") + 1).cast("long"), (k + 1).cast("long")
        dice = (2.0 * common) / (size + F.col("t_size"))
        return F.struct((-(2.0 * common * common) / (size + F.col("t_size"))).alias("rank"), "license", "template", F.col("pos").alias("start"), x["pos"].alias("end"), size.alias("n_bigrams"), common.alias("common"), dice.alias("dice"))

    runs = ends.select("row", "doc_id", F.filter(F.transform(counted, run), lambda x: x["dice"] >= threshold).alias("runs")).where(F.size("runs") > 0)
    found = runs.groupBy("row", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))
    apart = lambda taken, x: ~F.exists(taken, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"]))
    taken = F.aggregate("runs", F.filter("runs", lambda x: F.lit(False)), lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return found.select("doc_id", F.explode(taken).alias("r")).select("doc_id", "r.start", "r.n_bigrams", "r.license", "r.common", "r.dice")


def oracle_sql(threshold: float = THRESHOLD, templates=None) -> str:
    """The same for DuckDB."""
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(TEMPLATES if templates is None else templates))
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    grams = lambda w: f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    return f"""
      WITH t AS (SELECT template, license, string_split({norm('text')}, ' ') AS w FROM (VALUES {values}) v(template, license, text)),
      tg AS (SELECT template, license, len(w) - 1 AS t_size, unnest({grams('w')}) AS bigram FROM t),
      tb AS (SELECT template, license, t_size, bigram, count(*) AS t_count FROM tg GROUP BY ALL),
      u AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit, unnest(string_split(text, chr(10))) AS piece FROM documents
            UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
      w AS (SELECT doc_id, unit, string_split({norm('piece')}, ' ') AS w FROM u),
      g AS (SELECT doc_id, unit, len(w) - 1 AS n_bigrams, unnest({grams('w')}) AS bigram FROM w),
      gb AS (SELECT doc_id, unit, n_bigrams, bigram, count(*) AS n FROM g GROUP BY ALL),
      s AS (SELECT doc_id, unit, n_bigrams, template, license, t_size, sum(least(n, t_count)) AS common FROM gb JOIN tb USING (bigram) GROUP BY ALL),
      d AS (SELECT *, (2.0::DOUBLE * common) / (n_bigrams + t_size) AS dice FROM s)
      SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, CAST(n_bigrams AS BIGINT) AS n_bigrams, CAST(common AS BIGINT) AS common, CAST(dice AS DOUBLE) AS dice
      FROM d WHERE dice >= {threshold}
      QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license, template) = 1"""
