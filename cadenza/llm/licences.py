"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then
nearest-ancestor inheritance. DataFrame operations only.

A text is compared as a whole, and in parts. Its whole vector is held against wordings of
notices and full licence texts: a document that is close to one of them is a licence file and
speaks for its directory. Its parts are held against the wordings: a document with a part that
is close to one has that licence as a header. Parts are runs of one to four lines (those without
terms left out), so a header that wraps is one part however its comment marks look, and windows
that slide over the terms of the whole text. Documents without a licence of their own inherit
that of the nearest directory above them that has a licence file.

A match counts only if text and template share a term that names something: "licensed under
the" alone is close to several wordings and names no licence.

Inverse document frequencies of template terms are counted over all documents; a term outside
the templates weighs as one that a single document holds. A vector reaches a cosine of c with
a template only if it holds one of the template's heaviest terms, as many of them as leave
less than c squared of the squared weights to the rest. Texts and lines without such a term
are left out before any vector is built; that loses none.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Wordings of notices of common licences, short and long.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
]
#: Identifiers that a file can state instead of a notice.
SPDX = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
#: Terms of wordings that name no licence; numbers don't either.
NAMELESS = frozenset(
    "a an and any are as be by clause code dedicated file files following for form forms free identifier in international is it library licence licensed license "
    "may not of only or other person public released software source spdx subject terms that the this to under universal use version with without work you".split()
)
TERM = "[a-z]+|[0-9]+(?:[.][0-9]+)*"
#: Cosines from which on a line is a notice, and a document is a licence file.
LEAST_COSINE, LEAST_FILE_COSINE = 0.5, 0.7
#: Licences whose full text is in ``licence_texts``.
FULL_TEXTS = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MIT", "MPL-2.0")
#: The ``window`` of a whole text; parts have the number of terms that are compared at once.
WHOLE = 0
LEAST_WINDOW = 16
#: So many lines at most are compared as one part.
RUN = 4


def full_texts() -> list[tuple[str, str]]:
    return [(name, pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()) for name in FULL_TEXTS]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _one_of(some) -> str:
    """SQL that tells whether ``x`` is one of some terms; one expression, however many they are."""
    return "x IN (" + ", ".join(f"'{t}'" for t in sorted(some)) + ")"


def names_something(term: str) -> bool:
    return term not in NAMELESS and not term[0].isdigit()


def template_terms(spark, notices: list[tuple[str, str]], full: list[tuple[str, str]]) -> DataFrame:
    """``template, licence, window, term, n``: all wordings for whole texts, and the notices for parts
    with the window that holds any two of their kind, a power of two."""
    wordings = spark.createDataFrame([(i, *t, i < len(notices)) for i, t in enumerate([*notices, *full])], "template int, licence string, wording string, notice boolean")
    each = wordings.withColumn("terms", terms(F.col("wording")))
    window = F.greatest(F.lit(LEAST_WINDOW), F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.size("terms"))))).cast("int")
    each = each.withColumn("window", F.explode(F.when(F.col("notice"), F.array(F.lit(WHOLE), window)).otherwise(F.array(F.lit(WHOLE)))))
    return each.select("template", "licence", "window", F.explode("terms").alias("term")).groupBy("template", "licence", "window", "term").agg(F.count("*").alias("n"))


def _weight(n: Column, idf: Column) -> Column:
    return (1.0 + F.log(n.cast("double"))) * idf


def heaviest_terms(vectors: list[Row], least: dict[int, float]) -> dict[int, list[str]]:
    """By window: terms of which a vector holds one at least, if its cosine to one of the templates is ``least`` or more.

    ``vectors`` has rows ``template, window, term, t``."""
    out: dict[int, set[str]] = {}
    by_template: dict[tuple[int, int], list[tuple[float, str]]] = {}
    for v in vectors:
        by_template.setdefault((v["template"], v["window"]), []).append((v["t"], v["term"]))
    for (_, window), weights in by_template.items():
        left = sum(t * t for t, _ in weights)
        # a little less, as cosines are rounded
        bound = (least[window] ** 2 - 0.01) * left
        for t, term in sorted(weights, reverse=True):
            if left <= bound:
                break
            out.setdefault(window, set()).add(term)
            left -= t * t
    return {window: sorted(found) for window, found in out.items()}


def parts(texts: DataFrame, windows: list[int], among: Column) -> DataFrame:
    """``key, window, terms``: the parts of each of ``texts (key, text)`` that are compared, for each of ``windows``.

    Runs of up to :data:`RUN` lines that fit into the window, and as many terms as the window
    has, every half of it, whatever the lines are. ``among`` is a column over ``found``: parts
    for which it is false are left out."""
    lines = texts.select("key", F.filter(F.transform(F.split("text", "\n"), terms), lambda line: F.size(line) > 0).alias("lines")).filter(F.size("lines") > 0)
    near = lines.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("lines")), lambda at: F.slice("lines", at, RUN))).alias("near"))
    near = near.withColumn("found", F.flatten("near")).filter(among)
    runs = near.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("near")), lambda k: F.flatten(F.slice("near", F.lit(1), k)))).alias("found")).filter(among)
    fit = F.filter(F.array(*map(F.lit, windows)), lambda w: F.size("found") <= w)
    runs = runs.select("key", F.explode(fit).alias("window"), "found")
    starts = [F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - w // 2, F.lit(1)), F.lit(w // 2)), (lambda w: lambda at: F.struct(F.lit(w).alias("window"), at.alias("at")))(w)) for w in windows]
    # only the places are exploded, the terms of a place are cut out after that
    slid = texts.select("key", terms(F.col("text")).alias("all")).select("key", "all", F.explode(F.concat(*starts)).alias("p"))
    slid = slid.select("key", F.col("p.window").alias("window"), F.expr("slice(all, p.at, p.window)").alias("found")).filter(among)
    return runs.unionByName(slid).withColumnRenamed("found", "terms")


def _names(term: str) -> Column:
    return ~F.col(term).isin(*sorted(NAMELESS)) & ~F.substring(term, 1, 1).between("0", "9")


def cosines(units: DataFrame, vectors: DataFrame, weights: DataFrame, unknown: Column) -> DataFrame:
    """``unit, window, licence, cosine`` of the best template for each of ``units (unit, window, terms)``.

    ``vectors (template, licence, window, term, t)`` has the templates; a unit is compared with
    those of its window. ``weights (term, idf)`` covers their terms; other terms weigh
    ``unknown``. Templates with which it shares no term that names something don't count.
    Ties go to the licence that comes first by name.
    """
    lengths = vectors.groupBy("template", "window").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_length"))
    own = units.select("unit", "window", F.explode("terms").alias("term")).groupBy("unit", "window", "term").agg(F.count("*").alias("n"))
    own = own.join(weights, "term", "left").select("unit", "window", "term", _weight(F.col("n"), F.coalesce("idf", unknown)).alias("w"))
    size = own.groupBy("unit", "window").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = own.join(vectors, ["window", "term"]).groupBy("unit", "window", "template", "licence").agg(F.sum(F.col("w") * F.col("t")).alias("dot"), F.max(_names("term")).alias("named")).filter("named")
    scored = dots.join(size, ["unit", "window"]).join(lengths, ["template", "window"])
    scored = scored.select("unit", "window", "licence", F.round(F.col("dot") / (F.col("length") * F.col("t_length")), 9).alias("cosine"))
    best = scored.groupBy("unit", "window").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return best.select("unit", "window", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def ancestors(directory: str = "directory") -> Column:
    """A directory and all above it, nearest first; the root is the empty string."""
    parts = F.split(F.col(directory), "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.col(directory) == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))


def inherit(directories: DataFrame, granted: DataFrame) -> DataFrame:
    """``directory, licence, from_directory``: for each of ``directories`` the licence of the
    nearest directory at or above it among ``granted (directory, licence)``; none found, no row."""
    above = directories.select("directory", F.posexplode(ancestors()).alias("distance", "above"))
    given = granted.select(F.col("directory").alias("above"), F.col("licence"))
    near = above.join(given, "above").groupBy("directory").agg(F.min_by(F.struct("licence", "above"), "distance").alias("g"))
    return near.select("directory", "g.licence", F.col("g.above").alias("from_directory"))


def scan_licences(docs: DataFrame, directory: Column, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE, least_file: float = LEAST_FILE_COSINE) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, directory, licence, cosine, how, from_directory``.

    ``directory`` is a column over ``docs``, parts joined by ``/``. ``how`` is ``file`` (the
    whole text reaches ``least_file`` with a wording or a full licence text, at any length),
    ``header`` (else: a part reaches ``least`` with a wording), ``inherited`` or ``none``.
    The best template counts; of the licence files of a directory the best one does, ties to
    the smallest id. A notice inside a long line, and one that wraps over up to four lines,
    count like one on a line of its own. Of several licences in a text the closest is told;
    a version that no template has is told as the nearest that one has.

    * null and empty texts have no terms and can inherit; a null directory is the root
    * null ids are judged like others, but speak for a directory only where no file has an id
    * rows that repeat id and text get the same answer each; equal texts are judged once
    * an empty table gives an empty result; other columns are ignored
    """
    spark = docs.sparkSession
    table = template_terms(spark, templates, full_texts())
    known = [r["term"] for r in table.select("term").distinct().orderBy("term").collect()]  # bounded by the templates, as the next two lists
    text = F.coalesce(docs["text"], F.lit(""))
    n = docs.count()
    idf = lambda df: F.log((1.0 + F.lit(n)) / (1.0 + df)) + 1.0
    seen = docs.select(F.array_distinct(terms(text)).alias("seen"))
    counted = seen.select(F.explode(F.expr(f"filter(seen, x -> {_one_of(known)})")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = stage(table.select("term").distinct().join(counted, "term", "left").select("term", idf(F.coalesce("df", F.lit(0))).alias("idf")), "weights")
    vectors = stage(table.join(weights, "term").select("template", "licence", "window", "term", _weight(F.col("n"), F.col("idf")).alias("t")), "vectors")
    collected = vectors.collect()
    bounds = {v["window"]: least_file if v["window"] == WHOLE else least for v in collected}
    heavy = heaviest_terms(collected, bounds)
    naming: dict[int, set[str]] = {}
    for v in collected:
        if names_something(v["term"]):
            naming.setdefault(v["window"], set()).add(v["term"])
    holds = lambda what, some: F.expr(f"exists({what}, x -> {_one_of(some)})") if some else F.lit(False)
    possible = lambda what, of: holds(what, set().union(*(heavy[w] for w in of))) & holds(what, set().union(*(naming.get(w, ()) for w in of)))
    sliding = sorted(w for w in heavy if w != WHOLE)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(directory.cast("string"), F.lit("")).alias("directory"), text.alias("text"), terms(text).alias("found"))
    kept = kept.select("doc_id", "directory", F.when(possible("found", list(heavy)), F.col("text")).alias("text"))
    rows = stage(kept.withColumn("key", F.sha2("text", 256)), "rows")
    texts = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"))
    whole = texts.select("key", F.unhex(F.md5("key")).alias("unit"), F.lit(WHOLE).alias("window"), terms(F.col("text")).alias("terms"))
    windows = parts(texts, sliding, possible("found", sliding)).select("key", F.unhex(F.md5(F.array_join("terms", " "))).alias("unit"), "window", "terms") if sliding else whole.limit(0)
    wanted = F.lit(False)
    for w in heavy:
        wanted = wanted | ((F.col("window") == w) & possible("terms", [w]))
    asked = stage(whole.unionByName(windows).filter(wanted), "units")
    units = asked.groupBy("unit", "window").agg(F.first("terms").alias("terms"))
    enough = F.col("cosine") >= F.when(F.col("window") == WHOLE, least_file).otherwise(least)
    scored = stage(cosines(units, vectors, weights, idf(F.lit(1))).filter(enough), "cosines")
    best = F.struct((-F.col("cosine")).alias("c"), "licence")
    per_text = asked.select("key", "unit", "window").distinct().join(scored, ["unit", "window"]).groupBy("key").agg(F.min(F.when(F.col("window") == WHOLE, best)).alias("file"), F.min(F.when(F.col("window") != WHOLE, best)).alias("header"))
    # written, so that the join can split a text that very many documents have
    per_text = stage(per_text.select(F.col("key").alias("__key"), F.coalesce("file", "header").alias("b"), F.col("file").isNotNull().alias("is_file")), "judged-texts")
    own = (
        rows.filter("key IS NOT NULL")
        .join(per_text, F.col("key") == F.col("__key"), "left")
        .select("doc_id", "directory", F.col("b.licence").alias("own"), (-F.col("b.c")).alias("cosine"), "is_file")
        .union(rows.filter("key IS NULL").select("doc_id", "directory", F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(False)))
    )
    files = own.filter("own IS NOT NULL AND is_file").groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "own")).alias("f"))
    granted = files.select("directory", F.col("f.own").alias("licence"))
    given = stage(inherit(rows.select("directory").distinct(), granted).withColumnsRenamed({"directory": "__directory", "licence": "given"}), "inherited")
    how = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return own.join(given, F.col("directory") == F.col("__directory"), "left").select(
        "doc_id", "directory", F.coalesce("own", "given").alias("licence"), "cosine", how.alias("how"), F.when(how == "inherited", F.col("from_directory")).alias("from_directory")
    )
