"""Licence notices and texts, found by the Dice coefficient of word bigrams with templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.native import let, sums_before

#: Licence ids and the notices or opening paragraphs that name them. Fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Least Dice coefficient, in hundredths.
LEAST = 80
_PARAGRAPH = r"\n[\x20\x09]*\n"


def _bigrams(words: Column) -> Column:
    """All bigrams in their order, as hashes."""
    return F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))), F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def _template_bigrams(text: str) -> tuple[int, Column]:
    words = template_words(text)
    pairs = list(dict.fromkeys(zip(words, words[1:], strict=False)))
    return len(pairs), F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in pairs])


def words_of_unit(unit: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), "")


def size_bounds(size: int, least: int) -> tuple[int, int]:
    """The bigram counts that can reach the coefficient with ``size`` bigrams."""
    return math.ceil(size * least / (200 - least)), size * (200 - least) // least


def licence_units(docs: DataFrame, keep: list[str], text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: int = LEAST) -> DataFrame:
    """The ``keep`` columns and ``_licences``: (licence, unit, dice) of every matching unit of the whole text.

    Units are the lines of a text and its paragraphs between blank lines, numbered from 0, lines
    first; a paragraph of one line is not looked at twice. Units and templates are lower-cased
    and reduced to runs of a-z and 0-9. A unit matches a template if twice the distinct bigrams
    they share are at least ``least`` hundredths of both their numbers, or if that holds for a
    window of the unit, of no more bigrams than can reach the coefficient; a window within one
    line counts for that line only. Of licences that match overlapping words of a unit, the one
    with the largest coefficient over all windows stays, in ties that with more words in common,
    and all if these are equal too. A unit has one entry per licence, with the unit's coefficient
    if that is large enough and else its best window's; entries are sorted by unit and licence.

    Null and empty texts and units of fewer than two words match nothing. Repeated rows are
    answered alike; columns of ``keep`` pass unchanged, but one named ``_licences`` is left out.
    An empty table gives an empty result.
    """
    rows = []
    for name, text in templates or TEMPLATES:
        n, grams = _template_bigrams(text)
        if n:
            low, high = size_bounds(n, least)
            words = list(dict.fromkeys(template_words(text)))
            rows.append((low, F.struct(F.lit(name).alias("licence"), F.lit(n).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high"), grams.alias("grams"), F.array(*map(F.lit, words)).alias("words"))))
    known = F.array(*[row for _, row in rows])
    every = F.array_distinct(F.flatten(F.transform(known, lambda t: t["grams"])))
    low = min((n for n, _ in rows), default=1)
    entry = "struct<licence:string,unit:bigint,whole:double,score:double,near:double,start:int,end:int>"
    none = F.expr(f"cast(array() as array<{entry}>)")

    def dice(own: Column, grams: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(own, grams)) / (F.size(F.array_distinct(own)) + F.size(grams))

    def window(grams: Column, t: Column) -> Column:
        """(score, start, end) of the best window; one that begins or ends outside the template is never best."""
        places = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())

        def ends(p: Column, first: Column, k: Column) -> Column:
            last = F.filter(F.slice(p, k + t["low"], t["high"]), lambda q: q < first + t["high"])
            return F.transform(last, lambda q: F.struct(dice(F.slice(grams, first + 1, q - first + 1), t["grams"]).alias("score"), (-first).alias("start"), q.alias("end")))

        return let(places, lambda p: F.array_max(F.flatten(F.transform(p, lambda first, k: ends(p, first, k)))))

    def matches(unit: Column, number: Column, paragraph: bool) -> Column:
        def crosses(e: Column) -> Column:
            counts = F.transform(F.split(unit, "\n"), lambda x: F.size(words_of_unit(x)).cast("bigint"))
            return F.exists(sums_before(counts), lambda b: (e["start"] < b) & (b <= e["end"] + 1))

        def compared(words: Column, grams: Column, own: Column, some: Column) -> Column:
            def one(t: Column) -> Column:
                whole = F.when(F.size(own).between(t["low"], t["high"]), dice(own, t["grams"]))
                whole = F.when(whole * 100 >= least, whole)

                def made(w: Column) -> Column:
                    start = F.coalesce(-w["start"], F.lit(0))
                    end = F.coalesce(w["end"], F.size(grams) - 1)
                    part = F.array_distinct(F.slice(words, start + 1, end - start + 2))
                    return F.struct(t["licence"].alias("licence"), number.cast("bigint").alias("unit"), whole.alias("whole"), F.greatest(whole, w["score"]).alias("score"),
                                    (2.0 * F.size(F.array_intersect(part, t["words"])) / (F.size(part) + F.size(t["words"]))).alias("near"), start.alias("start"), end.alias("end"))

                return let(window(grams, t), made)

            likely = F.filter(known, lambda t: F.size(F.array_intersect(some, t["grams"])) >= t["low"])
            entries = F.filter(F.transform(likely, one), lambda e: e["score"] * 100 >= least)
            # Largest first where words overlap.
            kept = let(entries, lambda es: F.filter(es, lambda e: ~F.exists(es, lambda x: (x["licence"] != e["licence"]) & (x["start"] <= e["end"] + 1) & (x["end"] + 1 >= e["start"]) & (
                (x["score"] > e["score"]) | ((x["score"] == e["score"]) & (x["near"] > e["near"]))))))
            return F.filter(kept, lambda e: e["whole"].isNotNull() | crosses(e)) if paragraph else kept

        def of_grams(words: Column, grams: Column) -> Column:
            return let(F.array_distinct(grams), lambda own: let(F.array_intersect(own, every), lambda some: F.when(F.size(some) >= low, compared(words, grams, own, some)).otherwise(none)))

        return let(words_of_unit(unit), lambda w: F.when(F.size(w) > low, let(_bigrams(w), lambda g: of_grams(w, g))).otherwise(none))

    def best(entries: Column) -> Column:
        # Sorted by unit, licence, whole units first, and falling coefficient; the first of each unit and licence stays.
        ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["unit"].alias("unit"), e["licence"].alias("licence"), e["whole"].isNull().alias("part"), (-F.coalesce(e["whole"], e["score"])).alias("order"))))
        return let(ordered, lambda s: F.transform(
            F.filter(s, lambda e, k: (k == 0) | (F.get(s, k - 1)["unit"] != e["unit"]) | (F.get(s, k - 1)["licence"] != e["licence"])),
            lambda e: F.struct(e["licence"].alias("licence"), e["unit"].alias("unit"), (-e["order"]).alias("dice"))))

    def found(text: Column) -> Column:
        blocks = F.filter(F.split(text, _PARAGRAPH), lambda p: F.contains(p, F.lit("\n")))

        def both(lines: Column) -> Column:
            in_lines = F.flatten(F.transform(lines, lambda u, k: matches(u, k, False)))
            return F.concat(in_lines, F.flatten(F.transform(blocks, lambda u, k: matches(u, F.size(lines) + k, True))))

        return best(let(F.split(text, "\n"), both))

    own = [c for c in keep if c != "_licences"]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(*[F.col(f"`{c}`") for c in own], let(text, found).alias("_licences"))
