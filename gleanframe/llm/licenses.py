"""License scan: Dice coefficient of word bigrams against license templates.

A text is normalised (lower case, words of letters and digits, every number as ``0``) and read line by
line. Three kinds of unit are compared with the templates: a line, a run of lines in a row that may be
parts of a license, so that a license that was wrapped is found whole, and a window of words, across line
ends, so that a license between other words or beside another license is found. Windows begin and end with bigrams of
the template. Since their ends are chosen to score best, they must also hold ``least`` of the template's bigrams. Of windows of one license that overlap, that of the most shared bigrams counts, and none that overlaps a
line or run that matches the license. The score of a unit and a template is
``2 * shared / (bigrams of the unit + bigrams of the template)``, over distinct bigrams of words.

Two bounds prune lines. A score of ``least`` needs a unit whose size is within ``least / (2 -
least)`` and its inverse times the template's; and that share of the unit's bigrams must be the template's,
so as many of its words are words of templates. The second bound counts repeated words, so
it also drops lines that repeat unknown words; a license in them is found as a window. Lines that fail the second bound never leave the scan; the rest
is compared once for each distinct text, in an equi-join on bigrams, where the first bound cuts.

Lines, runs and windows are DataFrame expressions over the words of a text; windows are looked for in texts that
hold enough bigrams of a template. A license line that stands in a third of all documents is one text in
the comparison; its matches return to the documents by a join on the text, whose hot keys Spark splits.

Defined results: null and empty texts have no matches. A unit of one word has no bigrams and matches
nothing. A unit that fits several templates gives a row for each. Repeated rows each give their rows, as
do null ids. Lines without words are passed over and do not end a run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanframe.llm.common import let, written

LEAST = 0.8

# License notices and permission texts in common use, one template each.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "Licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Licensed under the BSD License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "CC-BY-SA",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "CC-BY-NC",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("All rights reserved", "All rights reserved."),
)


def normalised(text: Column) -> Column:
    """Lower-case words with one blank between them; line ends stay."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(letters, r"\p{N}+", "0")


def words_in(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def pairs(words: Column) -> Column:
    """The pairs of words that follow each other."""
    found = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(words[i - 1], F.lit(" "), words[i])
    )
    return F.when(F.size(words) > 1, found).otherwise(F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    """The distinct pairs of words that follow each other."""
    return F.array_distinct(pairs(words))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, license, grams``: every template with its bigrams."""
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
        for i, (name, text) in enumerate(templates)
    ]
    words = words_in(F.translate(normalised(F.col("text")), "\n", " "))
    return (
        spark.range(1)
        .select(F.inline(F.array(*rows)))
        .select("template", "license", let(words, bigrams).alias("grams"))
    )


def vocabulary(templates=TEMPLATES) -> list[str]:
    """All words of the templates, normalised like texts."""
    import re

    text = "\n".join(t for _, t in templates).lower()
    return sorted(set(re.sub(r"\d+", "0", re.sub(r"[\W_]+", " ", text)).split()))


def _units(lines: Column, known: list[str], least: float) -> Column:
    """Lines that can match, and runs of such lines: array of ``first_line, last_line, words``."""
    share = least / (2 - least)

    def possible(line: Column) -> Column:
        size = F.size(line["words"])
        return (size > 1) & (F.size(F.filter(line["words"], lambda w: w.isin(known))) >= share * (size - 1) - 1e-9)

    numbered = F.transform(
        lines, lambda words, i: F.struct(i.alias("first_line"), i.alias("last_line"), words.alias("words"))
    )

    def joined(found: Column) -> Column:
        runs = F.aggregate(
            found,
            F.slice(found, 1, 0),
            lambda done, x: F.when(
                F.get(done, F.size(done) - 1)["last_line"] == x["first_line"] - 1,
                F.concat(
                    F.slice(done, F.lit(1), F.size(done) - 1),
                    F.transform(
                        F.slice(done, -1, 1),
                        lambda run: F.struct(
                            run["first_line"].alias("first_line"),
                            x["last_line"].alias("last_line"),
                            F.concat(run["words"], x["words"]).alias("words"),
                        ),
                    ),
                ),
            ).otherwise(F.concat(done, F.array(x))),
        )
        return F.concat(found, F.filter(runs, lambda run: run["last_line"] > run["first_line"]))

    return let(F.filter(numbered, possible), joined)


def _licenses(spark: SparkSession, templates, least: float) -> tuple[Column, Column]:
    """Constants: every license with its templates, their bigrams and bounds of a window's; and all bigrams."""
    of_license: dict[str, list[Column]] = {}
    every: set[str] = set()
    for r in template_table(spark, templates).where(F.size("grams") > 0).collect():
        size = len(r["grams"])
        every.update(r["grams"])
        of_license.setdefault(r["license"], []).append(
            F.struct(
                F.lit(r["template"]).alias("template"),
                F.lit(r["grams"]).alias("grams"),
                F.lit(math.ceil(least * size - 1e-9)).alias("fewest_shared"),
                F.lit(math.floor((2 - least) / least * size + 1e-9)).alias("most_grams"),
            )
        )
    licenses = F.array(
        *[F.struct(F.lit(name).alias("license"), F.array(*found).alias("templates")) for name, found in of_license.items()]
    )
    return licenses.cast(
        "array<struct<license: string, templates: array<struct<"
        "template: int, grams: array<string>, fewest_shared: int, most_grams: int>>>>"
    ), F.lit(sorted(every)).cast("array<string>")


def _texts(documents: DataFrame, licenses: Column, every: Column, known: list[str], least: float) -> DataFrame:
    """``doc_id, units, licenses, lines`` of texts that have units, or bigrams enough for a window of ``licenses``.

    Lines are kept for windows only.
    """

    def enough(lines: Column) -> Column:
        def of_license(shared: Column) -> Column:
            return F.filter(
                licenses,
                lambda x: F.exists(
                    x["templates"],
                    lambda t: (F.size(shared) >= t["fewest_shared"])
                    & (F.size(F.array_intersect(shared, t["grams"])) >= t["fewest_shared"]),
                ),
            )["license"]

        return let(F.array_intersect(let(F.flatten(lines), pairs), every), of_license)

    def read(lines: Column) -> Column:
        units = F.transform(
            _units(lines, known, least),
            lambda u: F.struct(
                u["first_line"].alias("first_line"),
                u["last_line"].alias("last_line"),
                F.array_join(u["words"], " ").alias("unit_text"),
            ),
        )
        return F.struct(units.alias("units"), enough(lines).alias("licenses"), lines.alias("lines"))

    lines = F.filter(F.transform(F.split(normalised(F.col("text")), "\n"), words_in), lambda words: F.size(words) > 0)
    found = F.filter(
        F.transform(F.array(lines), read), lambda x: (F.size(x["units"]) > 0) | (F.size(x["licenses"]) > 0)
    )
    for_windows = F.when(F.size("licenses") > 0, F.col("lines")).otherwise(F.array().cast("array<array<string>>"))
    return documents.select("doc_id", F.inline(found)).withColumn("lines", for_windows)


def _linked(grams: Column) -> Column:
    """Each bigram of a text in order: ``at, gram`` and the places ``before, after`` where it stands next."""
    alike = F.sort_array(F.transform(grams, lambda gram, at: F.struct(gram.alias("gram"), at.alias("at"))))

    def neighbours(alike: Column) -> Column:
        def place(x: Column, i: Column, otherwise: Column) -> Column:
            y = F.get(alike, i)
            return F.when(y["gram"] == x["gram"], y["at"]).otherwise(otherwise)

        return F.transform(
            alike,
            lambda x, i: F.struct(
                x["at"].alias("at"),
                x["gram"].alias("gram"),
                place(x, i - 1, F.lit(-1)).alias("before"),
                place(x, i + 1, F.size(alike)).alias("after"),
            ),
        )

    return F.sort_array(let(alike, neighbours))


def _best_windows(linked: Column, template: Column, least: float) -> Column:
    """The best window from each bigram of the template, if it scores ``least``, as an array in the order of choice.

    A window whose first bigram comes again is no better than the one that starts there, so it ends before; and
    one of too many bigrams cannot reach ``least``. So a bigram is met once for each of the template at most.
    """
    size = F.size(template["grams"])

    def of_spots(spots: Column) -> Column:
        def best(first: Column) -> Column:
            end = F.least(first["after"], F.element_at(spots, -1)["at"] + 1)
            new = F.filter(
                F.slice(linked, first["at"] + 1, end - first["at"]), lambda x: x["before"] < first["at"]
            )
            counted = F.transform(
                F.slice(new, F.lit(1), template["most_grams"]),
                lambda x, i: F.struct(x["at"].alias("at"), (i + 1).alias("grams"), x["gram"].alias("gram")),
            )
            shared = F.filter(counted, lambda x: F.array_contains(template["grams"], x["gram"]))
            scored = F.transform(
                shared,
                lambda x, i: F.struct(
                    (2 * (i + 1) / (x["grams"] + size)).alias("dice"), x["at"].alias("last"), (i + 1).alias("shared")
                ),
            )
            return F.array_max(
                F.filter(scored, lambda x: (x["dice"] >= least) & (x["shared"] >= template["fewest_shared"]))
            )

        def in_order(first: Column, x: Column) -> Column:
            return F.struct(
                (-x["shared"]).alias("unshared"),
                (-x["dice"]).alias("undice"),
                first["at"].alias("first"),
                F.element_at(spots, 1)["at"].alias("first_spot"),
                template["template"].alias("template"),
                x["last"].alias("last"),
                x["dice"].alias("dice"),
            )

        enough = F.size(F.array_distinct(spots["gram"])) >= template["fewest_shared"]
        starts = F.when(enough, spots).otherwise(F.slice(spots, 1, 0))
        windows = F.transform(starts, lambda first: let(best(first), lambda x: F.when(x.isNotNull(), in_order(first, x))))
        return F.filter(windows, lambda x: x.isNotNull())

    return let(F.filter(linked, lambda x: F.array_contains(template["grams"], x["gram"])), of_spots)


def _covered(units: Column, lines: Column, templates: Column, least: float) -> Column:
    """A byte for each word, ``1`` in units that match a template, else ``0``."""

    def matches(unit: Column) -> Column:
        def any_fits(grams: Column) -> Column:
            def fits(t: Column) -> Column:
                shared = F.size(F.array_intersect(grams, t["grams"]))
                return 2 * shared / (F.size(grams) + F.size(t["grams"])) >= least

            return F.exists(templates, fits)

        return let(let(F.split(unit["unit_text"], " "), bigrams), any_fits)

    def marked(covered: Column) -> Column:
        others = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        ones = F.transform(covered, lambda i: F.struct(i.alias("line"), F.lit("1").alias("mark")))
        zeros = F.transform(others, lambda i: F.struct(i.alias("line"), F.lit("0").alias("mark")))
        marks = F.sort_array(F.concat(ones, zeros))
        by_line = F.zip_with(lines, marks, lambda words, x: F.repeat(x["mark"], F.size(words)))
        return F.array_join(by_line, "").cast("binary")

    numbers = F.transform(F.filter(units, matches), lambda u: F.sequence(u["first_line"], u["last_line"]))
    return let(F.array_distinct(F.flatten(numbers)), marked)


def _apart(windows: Column, covered: Column) -> Column:
    """The windows in the order of choice without those that overlap covered words or a window before them.

    Chosen windows are marked among the covered words: bytes, since an array would be copied for each window.
    """

    def size(x: Column) -> Column:
        return x["last"] + 2 - x["first"]

    def mark(x: Column) -> Column:
        return F.concat(F.lit("<"), F.repeat(F.lit("1"), size(x) - 2), F.lit(">")).cast("binary")

    def words(marks: Column, x: Column) -> Column:
        return F.substring(marks, x["first"] + 1, size(x))

    def add(marks: Column, x: Column) -> Column:
        before = F.substring(marks, F.lit(1), x["first"])
        after = F.substring(marks, x["last"] + 3, F.length(marks))
        free = words(marks, x) == F.repeat(F.lit("0"), size(x)).cast("binary")
        return F.when(free, F.concat(before, mark(x), after)).otherwise(marks)

    chosen = let(
        F.aggregate(windows, covered, add), lambda marks: F.filter(windows, lambda x: words(marks, x) == mark(x))
    )
    # the same words may be a window of several templates
    places = F.sort_array(
        F.transform(chosen, lambda x, i: F.struct(x["first"].alias("first"), i.alias("turn"), x["last"].alias("last"), x["dice"].alias("dice")))
    )
    return let(places, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["first"] != x["first"])))


def _windows(texts: DataFrame, licenses: Column, least: float) -> DataFrame:
    def of_license(linked: Column, license_: Column) -> Column:
        found = F.flatten(F.transform(license_["templates"], lambda t: _best_windows(linked, t, least)))
        covered = _covered(F.col("units"), F.col("lines"), license_["templates"], least)
        return let(
            F.sort_array(found),
            lambda x: F.when(F.size(x) > 0, _apart(x, covered)),
        )

    of_text = F.explode("licenses").alias("license")
    words = F.flatten("lines")
    license_ = F.filter(licenses, lambda x: x["license"] == F.col("license"))[0]
    found = let(let(let(words, pairs), _linked), lambda linked: let(license_, lambda x: of_license(linked, x)))
    line_of = F.flatten(F.transform("lines", lambda words, i: F.array_repeat(i, F.size(words))))
    return (
        texts.select("doc_id", "units", "lines", of_text)
        .select("doc_id", "license", line_of.alias("line_of"), F.explode(found).alias("found"))
        .select(
            "doc_id",
            F.col("line_of")[F.col("found.first")].alias("first_line"),
            F.col("line_of")[F.col("found.last") + 1].alias("last_line"),
            "license",
            "found.dice",
        )
    )


def windows(documents: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, first_line, last_line, license, dice`` of windows of words that match and that no line or run covers."""
    licenses, every = _licenses(documents.sparkSession, templates, least)
    return _windows(_texts(documents, licenses, every, vocabulary(templates), least), licenses, least)


def scan(documents: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, first_line, last_line, license, dice`` of every unit and license that match.

    Of several templates of one license the best counts. Lines are numbered from 0 among those with words.
    """
    spark = documents.sparkSession
    licenses, every = _licenses(spark, templates, least)
    texts = written(_texts(documents, licenses, every, vocabulary(templates), least), "licenses")
    units = texts.select("doc_id", F.inline("units"))
    wanted = template_table(spark, templates).where(F.size("grams") > 0)
    index = wanted.select(
        "template", "license", F.size("grams").alias("template_size"), F.explode("grams").alias("gram")
    )
    low, high = least / (2 - least), (2 - least) / least
    found = (
        units.select("unit_text")
        .distinct()
        .withColumn("grams", let(F.split("unit_text", " "), bigrams))
        .select("unit_text", F.size("grams").alias("unit_size"), F.explode("grams").alias("gram"))
        .join(index, "gram")
        .where(F.col("unit_size").between(low * F.col("template_size"), high * F.col("template_size")))
        .groupBy("unit_text", "unit_size", "template", "license", "template_size")
        .agg(F.count("*").alias("shared"))
        .withColumn("dice", 2 * F.col("shared") / (F.col("unit_size") + F.col("template_size")))
        .where(F.col("dice") >= least)
        .groupBy("unit_text", "license")
        .agg(F.max("dice").alias("dice"))
    )
    whole = units.join(found, "unit_text").select("doc_id", "first_line", "last_line", "license", "dice")
    return whole.unionByName(_windows(texts, licenses, least))
