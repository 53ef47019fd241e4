"""Licence scans with DataFrame functions only.

Texts are cut into units: the lines and, for notices that run over several lines, the
paragraphs (lines between blank lines).  A unit matches a licence template if the Dice
coefficient of their word-bigram multisets, 2 * common / (bigrams of both), is 0.8 or
more.  That needs  size(unit) >= t / (2 - t) * size(template)  and  size(template) >=
t / (2 - t) * size(unit)  with t = 0.8, so templates outside the size bounds are pruned,
and units outside the bounds of every template never get bigrams.

Words are runs of letters and digits, lower-cased.  Edge cases: null and empty texts
match nothing; units and templates under two words have no bigrams and match nothing;
of a unit only its best template counts, ties go to
the smallest licence name; rows are told apart by id and text, so repeated
rows get equal results; an empty table gives an empty result; extra columns are
ignored; texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_DICE = 0.8
# Templates are a parameter; this many of their bigrams at most are broadcast (about 60 bytes each).
BROADCAST_BIGRAMS = 500_000

# Notices under which works are commonly licensed, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "Proprietary": [
        "All rights reserved.",
    ],
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bigrams(words: str) -> Column:
    """Array of the word bigrams of the array column ``words``."""
    return F.expr(f"CASE WHEN size({words}) < 2 THEN cast(array() AS array<string>) ELSE "
                  f"transform(sequence(0, size({words}) - 2), i -> concat({words}[i], ' ', {words}[i + 1])) END")


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(template, license, bigram, in_template, template_size) of every template with a bigram."""
    rows = [(f"{name}#{k}", name, text) for name, texts in templates.items() for k, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "template string, license string, text string")
    pairs = frame.select("template", "license", words_of(F.col("text")).alias("w")).select(
        "template", "license", bigrams("w").alias("b")).select("template", "license", F.size("b").alias("template_size"),
                                                                F.explode_outer("b").alias("bigram"))
    return pairs.where("bigram is not null").groupBy("template", "license", "template_size", "bigram").agg(
        F.count("*").alias("in_template"))


def _sizes(templates: dict[str, list[str]]) -> list[int]:
    import re

    return [len(re.findall(r"[^\W_]+", t)) - 1 for texts in templates.values() for t in texts]


def matching_units(docs: DataFrame, id_col: str, text_col: str, templates: dict[str, list[str]],
                   min_dice: float = MIN_DICE) -> DataFrame:
    """(id, text_hash, unit, license, dice): the best template of every unit that matches one."""
    sizes = _sizes(templates)
    ratio = min_dice / (2 - min_dice)
    low, high = ratio * min(sizes), max(sizes) / ratio
    table = template_table(docs.sparkSession, templates)
    units = (docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .select("id", "text_hash", F.expr(
                 # several-line paragraphs repeat their lines; one-line ones are lines already
                 r"concat(split(text, '\n'), filter(split(text, '\n[\\x20\\t\r]*\n'), u -> contains(trim(u), '\n')))")
                 .alias("units"))
             .select("id", "text_hash", F.posexplode_outer("units").alias("unit", "u")))
    sized = (units.select("id", "text_hash", "unit", words_of(F.col("u")).alias("w"))
             .where((F.size("w") - 1 >= low) & (F.size("w") - 1 <= high)))
    pairs = (sized.select("id", "text_hash", "unit", (F.size("w") - 1).alias("size"), bigrams("w").alias("b"))
             .select("id", "text_hash", "unit", "size", F.posexplode_outer("b").alias("at", "bigram")))
    small = sum(sizes) <= BROADCAST_BIGRAMS
    fits = ((F.col("size") >= ratio * F.col("template_size")) & (F.col("template_size") >= ratio * F.col("size")))
    common = (pairs.join(F.broadcast(table) if small else table, "bigram").where(fits)
              # repeated rows give the same (id, text, unit, place) and count once
              .select("id", "text_hash", "unit", "size", "template", "license", "template_size", "bigram", "at",
                      "in_template").distinct()
              .groupBy("id", "text_hash", "unit", "size", "template", "license", "template_size", "bigram", "in_template")
              .agg(F.count("*").alias("in_unit"))
              .groupBy("id", "text_hash", "unit", "size", "template", "license", "template_size")
              .agg(F.sum(F.least("in_unit", "in_template")).alias("common")))
    return (common.withColumn("dice", 2 * F.col("common") / (F.col("size") + F.col("template_size")))
            .where(F.col("dice") >= min_dice).groupBy("id", "text_hash", "unit")
            .agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best"))
            .select("id", "text_hash", "unit", "best.license", (-F.col("best.minus")).alias("dice")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: dict[str, list[str]] = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """(id, n_matches, license, dice, licenses) of every row: the best match and all licences found."""
    best = F.min(F.struct((-F.col("dice")).alias("minus"), "license"))
    per_row = (matching_units(docs, id_col, text_col, templates, min_dice).groupBy("id", "text_hash")
               .agg(F.count("*").alias("n_matches"), best.alias("best"),
                    F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses")))   # at most one name a licence
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"))
    same = rows.row_id.eqNullSafe(per_row.id) & (rows.row_hash == per_row.text_hash)
    return rows.join(per_row, same, "left").select(
        F.col("row_id").alias(id_col), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"),
        F.coalesce("licenses", F.lit("")).alias("licenses"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP5_SQL = f"""
WITH template_rows(template, license, body) AS (VALUES {", ".join(
    f"({_quoted(f'{n}#{k}')}, {_quoted(n)}, {_quoted(t)})" for n, texts in TEMPLATES.items() for k, t in enumerate(texts))}),
template_words AS (
    SELECT template, license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM template_rows),
template_bigrams AS (
    SELECT template, license, len(w) - 1 AS template_size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
    FROM template_words),
template_counts AS (
    SELECT template, license, template_size, bigram, count(*) AS in_template FROM template_bigrams GROUP BY ALL),
units AS (
    SELECT doc_id, unnest(list_concat(
        list_transform(string_split(text, chr(10)), lambda x: {{'u': x}}),
        list_transform(list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda x: contains(trim(x), chr(10))), lambda x: {{'u': x}})))
        .u AS u
    FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, row_number() OVER () AS unit, regexp_extract_all(lower(u), '[\\p{{L}}\\p{{N}}]+') AS w FROM units),
unit_bigrams AS (
    SELECT doc_id, unit, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
    FROM numbered),
unit_counts AS (SELECT doc_id, unit, size, bigram, count(*) AS in_unit FROM unit_bigrams GROUP BY ALL),
scored AS (
    SELECT doc_id, unit, license, 2.0::DOUBLE * sum(least(in_unit, in_template)) / (size + template_size) AS dice
    FROM unit_counts JOIN template_counts USING (bigram) GROUP BY doc_id, unit, size, template, license, template_size),
matched AS (
    SELECT doc_id, unit, arg_min(license, (-dice, license)) AS license, max(dice) AS dice
    FROM scored WHERE dice >= 0.8 GROUP BY doc_id, unit),
per_doc AS (
    SELECT doc_id, count(*) AS n_matches, arg_min(license, (-dice, license)) AS license, max(dice) AS dice,
           string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM matched GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, license, dice, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""
