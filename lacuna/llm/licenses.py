"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a window of consecutive words of a text, whatever its line ends: ``template size / containment`` words long for
each template, at every place. Blocks and templates are sets of words. A block matches a template if it contains at
least ``CONTAINMENT`` of the template's words, all words that ``MARKS`` requires and none that it excludes. Tokens are ordered
by the number of texts that hold them, rarest first. A template's prefix, its rarest ``n - need + 1`` words, must share a
word with any text that holds a matching block; texts are joined to templates on prefix words. A pair stays if the
text has enough of the words (length) and if what follows the shared word on both sides can still reach the needed
overlap (position). In the texts that are left, a window stays if it holds enough places of template words (length), and
is verified by intersecting the sets. Templates are fixed values of a few hundred words in all, so they travel in the plan.

Besides, the base finds the places of three phrases, word by word.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stage

CONTAINMENT = 0.8

# Phrases of the base with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Texts and headers as their publishers word them, and short names of licenses. All of at most four words must
# stand in a window; longer ones have ``MARKS`` where 0.8 of them does not tell licenses apart.
TEMPLATES = {
    "mit-notice": "under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "Work licensed under the GNU General Public License 3",
    "gpl-2.0-notice": "General Public License 2",
    "lgpl-notice": "Lesser General Public License",
    "agpl-notice": "Affero General Public License",
    "bsd-notice": "under the BSD License",
    "mpl-2.0-notice": "Mozilla Public License 2.0",
    "cc-by-nc-4.0-name": "BY-NC 4.0",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
}
# Words of a window that a template's license needs, and words that name another license.
_OTHER_GPL = ("affero", "lesser", "library")
_OTHER_CC = ("sa", "nd", "sharealike", "noderivs", "noderivatives")
MARKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0-notice": (("apache", "license", "2", "0"), ()),
    "apache-2.0-header": (("apache", "license", "2", "0"), ()),
    "gpl-3.0-notice": (("gnu", "general", "public", "license", "3"), _OTHER_GPL),
    "gpl-2.0-notice": (("general", "public", "license", "2"), _OTHER_GPL),
    "gpl-header": (("gnu", "general", "public", "license"), _OTHER_GPL),
    "mpl-2.0-notice": (("mozilla", "public", "license", "2"), ()),
    "mpl-2.0-header": (("mozilla", "public", "license", "2"), ()),
    "cc-by-nc-4.0-name": ((), _OTHER_CC),
    "cc-by-nc-4.0-notice": (("attribution", "noncommercial", "4", "0"), _OTHER_CC),
    "mit-permission": (("subject", "conditions"), ()),
}
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Words; texts that begin or end with a separator give an empty one there."""
    return F.split(text, _SEPARATORS)


def words(text: Column) -> Column:
    return F.filter(_split(F.translate(text, _UPPER, _LOWER)), lambda w: w != "")


def template_tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(template_tokens(text)))


def _needed(size: int, containment: float) -> int:
    return max(1, ceil(containment * size - 1e-9))


def _places(w: Column) -> Column:
    """Structs (start, label) of all places of the phrases in words, found from their last word, which they share."""
    last = {p.split()[-1] for p in PHRASES}
    if len(last) != 1:
        raise ValueError("the phrases must end in one word")
    ends = F.filter(F.transform(w, lambda x, i: F.when(x == last.copy().pop(), i)), lambda i: i.isNotNull())

    def at(i: Column, phrase: str) -> Column:
        before = phrase.split()[:-1]
        same = F.lit(True)
        for back, x in enumerate(reversed(before), 1):
            same = same & F.coalesce(F.get(w, i - back) == x, F.lit(False))
        return F.when(same, F.struct((i - len(before)).alias("start"), F.lit(PHRASES[phrase]).alias("label")))

    found = F.flatten(F.transform(ends, lambda i: F.array(*[at(i, p) for p in PHRASES])))
    return F.filter(found, lambda x: x.isNotNull())


def _sets(templates: dict[str, str]) -> dict[str, list[str]]:
    return {t: template_words(x) for t, x in templates.items()}


def _known(templates: dict[str, str]) -> list[str]:
    """The words of the templates and their marks."""
    marks = [w for t in templates for side in MARKS.get(t, ()) for w in side]
    return sorted({w for s in _sets(templates).values() for w in s} | set(marks))


def scanned(docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str], containment: float) -> DataFrame:
    """(uid, id, n_words, places, known, words): one pass over the texts, stored.

    ``known`` are the distinct words of a text that templates have; ``words`` all words in order, null for texts with too few
    of every template.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words(text).alias("w"))
    of_templates = F.array(*[F.lit(w) for w in _known(templates)])
    rows = rows.select("id", "w", F.array_intersect(of_templates, F.col("w")).alias("known"))
    enough = F.lit(False)
    for s in _sets(templates).values():
        both = F.size(F.array_intersect(F.array(*[F.lit(w) for w in s]), F.col("known")))
        enough = enough | (both >= _needed(len(s), containment))
    none = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    return stage(
        rows.select(
            F.monotonically_increasing_id().alias("uid"),
            "id",
            F.size("w").cast("long").alias("n_words"),
            F.when(F.array_contains("w", "license"), _places(F.col("w"))).otherwise(none).alias("places"),
            "known",
            F.when(enough, F.col("w")).alias("words"),
        ),
        "licenses",
    )


def _best(hits: Column) -> Column:
    """The largest overlap of a window with its template, 0 without a match; a window starts at a word of ``hits``."""

    def at(k: Column) -> Column:
        return F.get(hits, k)["i"]

    def overlap(k: Column) -> Column:
        # a mark that excludes may stand up to two words before: 'Lesser General Public License'
        near = F.filter(F.slice(hits, F.greatest(k - 1, F.lit(1)), F.col("span") + 2), lambda h: (h["i"] >= at(k) - 2) & (h["i"] < at(k) + F.col("span")))
        block = F.transform(F.filter(near, lambda h: h["i"] >= at(k)), lambda h: h["x"])
        good = (F.size(F.array_except("required", block)) == 0) & ~F.arrays_overlap("excluded", F.transform(near, lambda h: h["x"]))
        return F.when(good, F.size(F.array_intersect("template_words", block))).otherwise(F.lit(0))

    places = F.when(F.size(hits) >= F.col("need"), F.sequence(F.lit(0), F.size(hits) - F.col("need"))).otherwise(F.expr("cast(array() as array<int>)"))
    full = F.filter(places, lambda k: at(k + F.col("need") - 1) < at(k) + F.col("span"))
    return F.coalesce(F.array_max(F.transform(full, overlap)), F.lit(0))


def template_matches(rows: DataFrame, templates: dict[str, str], containment: float) -> DataFrame:
    """(uid, template, contained): all matches of texts with templates, with the largest share of the template in a window."""
    spark = rows.sparkSession
    sets = _sets(templates)
    counts = rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}  # at most one row per template word
    order = sorted({w for s in sets.values() for w in s}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes, whole = [], []
    for t, s in sets.items():
        need = _needed(len(s), containment)
        ranked = sorted(s, key=rank.__getitem__)
        prefixes += [(t, w, j, len(s), need) for j, w in enumerate(ranked[: len(s) - need + 1])]
        required, excluded = MARKS.get(t, ((), ()))
        length = len(template_tokens(templates[t]))
        whole.append((t, s, [*{*s, *required, *excluded}], list(required), list(excluded), len(s), need, ceil(length / containment - 1e-9)))
    prefix = spark.createDataFrame(prefixes, "template string, word string, j int, size int, need int")
    columns = "template string, template_words array<string>, marked array<string>, required array<string>, excluded array<string>, size int, need int, span int"
    every = spark.createDataFrame(whole, columns)
    texts = rows.where("words is not null")
    ordered = texts.select("uid", F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("known")).alias("known"))
    tokens = ordered.select("uid", F.size("known").alias("n"), F.posexplode("known").alias("i", "word"))
    pairs = tokens.join(F.broadcast(prefix), "word").where("n >= need and least(n - i, size - j) >= need").select("uid", "template").distinct()
    near = texts.select("uid", "words").join(pairs, "uid").join(F.broadcast(every), "template")
    placed = F.transform("words", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    # stored, and filtered after a grouping: the optimizer would put the whole expression into every step of the search
    hits = stage(near.withColumn("hits", F.filter(placed, lambda h: F.array_contains(F.col("marked"), h["x"]))).drop("words"), "hits")
    best = hits.select("uid", "template", "size", "need", _best(F.col("hits")).alias("overlap"))
    verified = best.groupBy("uid", "template", "size", "need").agg(F.max("overlap").alias("overlap"))
    return verified.where("overlap >= need").select("uid", "template", (F.col("overlap") / F.col("size")).alias("contained"))


def licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(id, n_words, places, templates, contained) per document row.

    ``places`` are structs (start, label) of the phrases, ``templates`` the matching templates, sorted, ``contained``
    the largest share of a template found in a window (0 without a match). A null text is empty. Repeated rows give one row each;
    null ids stay null.
    """
    templates = TEMPLATES if templates is None else templates
    rows = scanned(docs, id_col, text_col, templates, containment)
    found = template_matches(rows, templates, containment)
    by_row = found.groupBy("uid").agg(F.sort_array(F.collect_set("template")).alias("templates"), F.max("contained").alias("contained"))
    joined = rows.drop("known", "words").join(by_row, "uid", "left")
    return joined.select(
        "id",
        "n_words",
        "places",
        F.coalesce("templates", F.expr("cast(array() as array<string>)")).alias("templates"),
        F.coalesce("contained", F.lit(0.0)).alias("contained"),
    )
