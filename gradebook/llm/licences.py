"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.sources.checkpoints import written_once

# Short notices that stand for their licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause/name": "Licensed under the BSD 3-Clause License.",
    "MIT/name": "Licensed under the MIT License.",
}
# Titles of licence files; only a whole line is compared with these, as prose may name a licence.
TITLES = {
    "Apache-2.0/title": "Apache License Version 2.0",
    "MIT/title": "MIT License",
    "GPL-3.0/title": "GNU General Public License Version 3",
    "GPL-3.0/short title": "GNU General Public License",
    "LGPL-3.0/title": "GNU Lesser General Public License Version 3",
    "BSD-2-Clause/title": "BSD 2-Clause License",
    "BSD-3-Clause/title": "BSD 3-Clause License",
    "MPL-2.0/title": "Mozilla Public License Version 2.0",
    "CC-BY-4.0/title": "Creative Commons Attribution 4.0 International License",
    "CC0-1.0/title": "CC0 1.0 Universal License",
}
#: Words before a notice that deny it.
_DENIED = r"(?i)(?:\b(?:not|never|no longer|without being|nicht|kein|pas|non|no)\b|n['’]t\b)(?:\W+\w+){0,2}\W*$"
_DENIES_UNIT = r"(?i)(?:\b(?:not|never|nicht|kein|pas)\b|n['’]t\b)(?:\W+\w+){0,3}\W+(?:licen[sc]ed|released|distributed|available|covered)\b"
_SPDX = "SPDX-License-Identifier: "
_HINT = r"(?i)licen[sc]e|copyright|permission is|redistribut|public domain|spdx"
_FILE = r"(?i)(?:^|/)(?:un)?licen[sc]e[^/]*$|(?:^|/)copying[^/]*$|(?:^|/)notice[^/]*$"
_TERM = r"[^\p{L}\p{N}.\-+]+"


def licences(
    files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES,
    titles: Mapping[str, str] = TITLES, least: float = 0.75, file_share: float = 0.5,
) -> DataFrame:
    """The licence of every file: its own, or that of the nearest ancestor directory with a licence file.

    Lines and paragraphs that mention a licence, and windows of each template's length in longer ones, laid where the template's own mention
    would fall on theirs, are compared with the templates (licence/variant: notice), whole lines also with ``titles`` and with SPDX identifiers,
    by the cosine of TF-IDF vectors. A window after a word that denies it does not count, nor does a line with one that holds it; a term's weight counts in how many distinct notices of all files, and
    templates, it occurs. The best of at least ``least`` is the file's own licence, ties by name. A file is a licence file if its name says
    so or its best notice holds ``file_share`` of its words. Its directory passes the licence on to
    every file below it that has none; of several licence files the best match counts, then the first path.

    One row per row of ``files``: path, licence, cosine, origin (own, inherited or null), licence_dir. Rows that share a path
    are one file, whose texts all count. A null or empty text has no licence of its own. A null path
    inherits nothing, and its rows are told apart by their texts. Equal notices are compared once, however many files hold them.
    Other columns are not looked at.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    file = F.coalesce("path", F.concat(F.lit("\0"), F.xxhash64("text").cast("string")))
    whole = (
        rows.where(F.col("text").rlike(_HINT))
        .select(file.alias("file"), "path", F.regexp_count("text", F.lit(r"\S+")).alias("words"), F.explode(F.array_distinct(F.concat(
            F.split("text", "\n"), F.split("text", r"\n[ \t]*\n")))).alias("unit"))
        .where(F.col("unit").rlike(_HINT)))
    units = whole.select("file", "path", "words", F.inline(_notices(F.col("unit"), templates)))
    notices = written_once(
        units.groupBy("notice", "whole").agg(F.count("*").alias("files")).withColumn("key", F.monotonically_increasing_id()), "notices")
    spark = files.sparkSession
    all_templates = {**templates, **titles, **{f"{name}/spdx": _SPDX + name for name in {t.split("/")[0] for t in templates}}}
    known = spark.createDataFrame(
        [(name, text, name in templates) for name, text in sorted(all_templates.items())], "name string, text string, anywhere boolean")

    # Full stops belong to a term only inside it, as in a version.
    terms = lambda c: F.explode(F.array_remove(F.split(F.lower(c), rf"\.*(?:{_TERM}|$)\.*"), ""))
    of_notice = notices.select("key", "whole", terms(F.col("notice")).alias("term")).groupBy("key", "whole", "term").agg(F.count("*").alias("tf"))
    of_template = known.select("name", "anywhere", terms(F.col("text")).alias("term")).groupBy("name", "anywhere", "term").agg(F.count("*").alias("tf"))
    spread = of_notice.select("term").unionByName(of_template.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = notices.count() + len(all_templates)
    weights = spread.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = of_notice.join(weights, "term").select("key", "whole", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    other = of_template.join(weights, "term").select("name", "anywhere", "term", (F.col("tf") * F.col("idf")).alias("v"))
    length = other.groupBy("name").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    matched = (
        weighed.join(other, "term").where("whole OR anywhere").groupBy("key", "name").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        .join(norm, "key").join(length, "name")
        .select("key", F.substring_index("name", "/", 1).alias("licence"), F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9).alias("cosine"))
        .where(F.col("cosine") >= least)
        .groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("best")))
    found = notices.join(matched, "key").select("notice", "whole", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("cosine"))
    own = written_once(
        units.join(found, ["notice", "whole"]).groupBy("file", "path").agg(F.min(F.struct(
            (-F.col("cosine")).alias("minus"), "licence",
            (-(F.regexp_count("notice", F.lit(r"\S+")) / F.col("words"))).alias("share"))).alias("best"))
        .select("file", "path", "best.licence", (-F.col("best.minus")).alias("cosine"), (-F.col("best.share")).alias("share")), "own")

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    passing = (
        own.where(F.col("path").isNotNull() & (F.col("path").rlike(_FILE) | (F.col("share") >= file_share)))
        .groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "path", "licence")).alias("best"))
        .select("dir", F.col("best.licence").alias("dir_licence"), (-F.col("best.minus")).alias("dir_cosine")))
    depth = F.size(F.split("dir", "/"))
    steps = F.split(F.col("parent"), "/")
    parents = rows.select(directory.alias("parent")).where("parent IS NOT NULL").distinct()
    above = parents.select("parent", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))).alias("dir")).distinct()
    nearest = (
        above.join(passing, "dir").groupBy("parent")
        .agg(F.max(F.struct(depth.alias("depth"), F.length("dir").alias("length"), "dir", "dir_licence", "dir_cosine")).alias("near"))
        .select("parent", F.col("near.dir").alias("dir"), F.col("near.dir_licence").alias("dir_licence"), F.col("near.dir_cosine").alias("dir_cosine")))
    nearest = written_once(nearest, "nearest")
    return (
        rows.select("path", file.alias("file"), directory.alias("parent"))
        .join(own.select("file", "licence", "cosine"), "file", "left").join(nearest, "parent", "left")
        .select(
            F.col("path").alias(path_col), F.coalesce("licence", "dir_licence").alias("licence"), F.coalesce("cosine", "dir_cosine").alias("cosine"),
            F.when(F.col("licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").alias("origin"),
            F.when(F.col("licence").isNull(), F.col("dir")).alias("licence_dir")))


def _notices(unit: Column, templates: Mapping[str, str]) -> Column:
    """(notice, whole): a unit, and its windows: for every word that mentions a licence and every place that such a word has in a template, as many words as the template has."""
    places = sorted({
        (at, len(text.split())) for text in templates.values() for at, word in enumerate(text.split()) if re.search(_HINT, word)})
    longest = max((length for _, length in places), default=0)
    layout = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(length).alias("length")) for at, length in places])

    def windows(words: Column) -> Column:
        hints = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(_HINT), i)), lambda i: i.isNotNull())
        laid = F.flatten(F.transform(hints, lambda h: F.transform(layout, lambda p: F.struct((h - p["at"]).alias("start"), p["length"].alias("length")))))
        inside = F.filter(F.array_distinct(laid), lambda p: (p["start"] >= 0) & (p["start"] + p["length"] <= F.size(words)) & (p["length"] < F.size(words)))
        denied = lambda p: F.array_join(F.slice(words, F.greatest(F.lit(1), p["start"] - 3), F.least(p["start"], F.lit(4))), " ").rlike(_DENIED)
        laid_out = F.transform(F.filter(inside, lambda p: (p["start"] == 0) | ~denied(p)), lambda p: F.array_join(F.slice(words, p["start"] + 1, p["length"]), " "))
        return F.filter(laid_out, lambda window: ~window.rlike(_DENIES_UNIT))

    words = F.filter(F.split(unit, r"\s+"), lambda w: w != "")
    short = F.regexp_count(unit, F.lit(r"\S+")) <= longest + 8
    own = F.when(short & unit.rlike(_DENIES_UNIT), F.array().cast("array<string>")).otherwise(F.array(unit))
    laid = F.array_distinct(F.transform(F.array(words), windows)[0])
    as_notices = lambda texts, whole: F.transform(texts, lambda t: F.struct(t.alias("notice"), F.lit(whole).alias("whole")))
    return F.concat(as_notices(own, True), as_notices(laid, False))
