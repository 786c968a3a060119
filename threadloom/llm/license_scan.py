"""License scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Texts are cut into words (runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased) and
shingles of five words. Templates fall into classes by their number of shingles, each class twice the last. A
class has windows of twice its shingles, half overlapping, so that any occurrence lies whole in some window, and
makes a large part of it: a template of which ``CONTAINMENT`` is left has a Jaccard similarity of at least
``likeness(class)`` with that window. Bands have one row; their number is chosen so that a match is retrieved with
probability ``RECALL`` at least. A retrieved template matches if the window has ``CONTAINMENT`` of its shingles.

A window can only agree with a template in a band if it holds the shingle that is the template's minimum there. So
shingles are first looked up among those minima, and signatures are computed only for windows that hold one: the
result is the same as from all windows.

Memory is bounded by blocks of a text, and time is linear in its length, also where every word is part of a notice.

Edge cases: null and empty texts have no licenses; texts shorter than a shingle are one shingle of all their words,
as are templates; repeated rows are each reported; no template, or an empty table, gives no match; other columns
take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, shared

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.999
#: Words of a block; a power of two, so that every class of windows fits into it without remainder.
BLOCK = 8192
#: Rows of the template tables (minima, bands) up to which minima are a hash set within the plan; beyond, a join looks them up.
LITERAL = 20_000
#: Rows of the template tables (some 50 bytes each) up to which they are broadcast; larger ones are shuffled.
BROADCAST = 500_000

# The wording of common license notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "under the GNU General Public License, version 3",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-2.0-notice": "under the GNU General Public License, version 2",
    "lgpl-3.0": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-1.0-notice": "has waived all copyright and related or neighboring rights to",
    "cc0-1.0": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s)",
}
# The notices of the GNU licenses stand in their full texts too. Each part is so short that another name or version leaves less than CONTAINMENT of it.
_GNU = "the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License"
TEMPLATES |= {k: _GNU.format(name, version) for k, name, version in (("gpl-2.0", "", "2"), ("gpl-3.0", "", "3"), ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3.0-notice", "Lesser ", "3"), ("agpl-3.0", "Affero ", "3"))}
# Creative Commons: the short notice, the long one, and a passage of the full text. ``cc-by-4.0-notice`` and ``cc-by-nc-4.0-notice`` are above.
for _k, _name in (("by", ""), ("by-sa", "-ShareAlike"), ("by-nd", "-NoDerivatives"), ("by-nc", "-NonCommercial"), ("by-nc-sa", "-NonCommercial-ShareAlike"), ("by-nc-nd", "-NonCommercial-NoDerivatives")):
    TEMPLATES[f"cc-{_k}-4.0"] = f"the terms and conditions of this Creative Commons Attribution{_name} 4.0 International Public License"
    TEMPLATES[f"cc-{_k}-4.0-short"] = f"Licensed under CC {_k.upper()} 4.0."
    TEMPLATES[f"cc-{_k}-4.0-long"] = f"This work is licensed under a Creative Commons Attribution{_name} 4.0 International License."
del TEMPLATES["cc-by-4.0-long"], TEMPLATES["cc-by-nc-4.0-short"]


def likeness(size: int) -> float:
    """Least Jaccard similarity of a window of ``2 * size`` shingles and a template of over half of ``size`` of them, of which ``CONTAINMENT`` is left."""
    least = size // 2 + 1
    shared_ones = math.ceil(CONTAINMENT * least)
    return shared_ones / (2 * size + least - shared_ones)


def bands(size: int, recall: float = RECALL) -> int:
    """Number of one-row bands that retrieve a match of this class with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - likeness(size)))


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Arrays of words, in order; one of all words if there are fewer than ``n``; none if there are none."""
    all_of = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.slice(words, i + 1, n))
    return F.when(F.size(words) > 0, all_of).otherwise(F.array().cast("array<array<string>>"))


def _hash(shingle: Column) -> Column:
    return F.xxhash64(*[F.get(shingle, F.lit(k)) for k in range(SHINGLE)])


def _minima(hashes: Column, count: Column) -> Column:
    """MinHash signature: for each band the least of the shingles' hashes under that band's seed."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """(license, class, grams): distinct shingles of each template; ``templates`` is a dict or (license, text) rows."""
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(list(templates.items()), "license string, text string")
    grams = rows.select("license", F.array_distinct(shingles(decontam.words(F.col("text")))).alias("grams")).where((F.size("grams") > 0) & F.col("license").isNotNull())
    doubled = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("grams").cast("double")))).cast("int")
    return grams.select("license", doubled.alias("class"), "grams")


def _windows_held(positions: Column, size: int, step: int) -> Column:
    """Numbers, within a block, of the windows of a class that hold any of the positions: at most two for each."""
    shift = size.bit_length() - 1
    both = F.transform(positions, lambda i: F.array(F.shiftright(i, shift), F.shiftright(i, shift) - 1))
    return F.filter(F.array_distinct(F.flatten(both)), lambda m: (m >= 0) & (m < step >> shift))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, key: str = "doc_id", text: str = "text", literal: int = LITERAL, broadcast: int = BROADCAST) -> DataFrame:
    """(key, n_licenses, licenses, n_words) for every row of ``docs``; licenses are sorted and joined by commas.

    Texts go through in blocks of ``BLOCK`` words, each with as many more as its last windows reach into the next. Within
    a block the windows to look at are found as numbers, once each, and only then cut out: memory is bounded by the
    block and time grows with the length, however often a notice is repeated. All that is shuffled are a small row for
    each text and for each template found.
    """
    known = template_table(docs.sparkSession, templates)
    classes = {r["class"]: r["n"] for r in known.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class").collect()}  # a row for each doubling
    rows = sum(n * max(bands(c), 2 * c) for c, n in classes.items())
    near = F.broadcast if rows <= broadcast else lambda df: df
    count = F.coalesce(*[F.when(F.col("class") == c, F.lit(bands(c))) for c in classes], F.lit(None).cast("int"))
    hashes = F.transform("grams", _hash)
    signed = known.select("license", "class", "grams", hashes.alias("hashes"), _minima(hashes, count).alias("theirs")).select("*", F.posexplode("theirs").alias("band", "value"))
    minima = signed.select("class", F.explode(F.filter("hashes", lambda h: F.xxhash64(h, F.col("band")) == F.col("value"))).alias("hash")).distinct()

    widest = max(classes, default=1)
    step = max(BLOCK, widest)
    read = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), decontam.words(F.col(text)).alias("w"))
    last = F.greatest(F.size("w") - SHINGLE, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.floor(last / step).cast("int")), lambda b: F.struct((b * step).alias("first"), F.least(last - b * step, F.lit(step + widest - 1)).alias("last"), F.slice("w", b * step + 1, step + widest + SHINGLE - 1).alias("w")))
    blocks = read.select("key", "text_hash", F.size("w").alias("n_words"), F.explode(cut).alias("b")).select("key", "text_hash", "n_words", "b.*")
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.col("last"))).otherwise(F.array().cast("array<int>"))
    hash_at = lambda i: decontam._hash(F.col("w"), i, SHINGLE)
    numbered = lambda c, numbers: F.transform(numbers, lambda m: F.struct(F.lit(c).alias("class"), m.alias("number")))
    none = F.array().cast("array<struct<class:int,number:int>>")
    if rows <= literal:
        of: dict[int, list[int]] = {c: [] for c in classes}
        for r in minima.collect():  # at most ``literal`` rows
            of[r["class"]].append(r["hash"])
        every = sorted({h for hs in of.values() for h in hs})
        hit = blocks.withColumn("hits", F.filter(places, lambda i: hash_at(i).isin(every)))
        among = lambda hs: F.filter("hits", lambda i: hash_at(i).isin(hs))
        held = hit.withColumn("held", F.concat(none, *[numbered(c, _windows_held(among(hs), c, step)) for c, hs in of.items()]))
    else:
        # Places are looked up by a join without their words; windows held meet their blocks again.
        looked = blocks.select("key", "text_hash", "first", F.posexplode(F.transform(places, hash_at)).alias("i", "hash")).join(near(minima), "hash")
        number = F.filter(F.array(F.floor(F.col("i") / F.col("class")), F.floor(F.col("i") / F.col("class")) - 1), lambda m: (m >= 0) & (m < F.floor(F.lit(step) / F.col("class"))))
        spread = looked.select("key", "text_hash", "first", "class", F.explode(number.cast("array<int>")).alias("number"))
        sets = spread.groupBy("key", "text_hash", "first").agg(F.collect_set(F.struct("class", "number")).alias("held"))
        same = F.col("b.key").eqNullSafe(F.col("s.key")) & F.col("b.text_hash").eqNullSafe(F.col("s.text_hash")) & (F.col("b.first") == F.col("s.first"))
        held = blocks.alias("b").join(sets.alias("s"), same, "left").select("b.*", F.coalesce("s.held", none).alias("held"))
    # A row of each text's own goes along with its first block, so that texts without a window stay too.
    part = lambda s: F.slice("w", s["number"] * s["class"] + 1, 2 * s["class"] + SHINGLE - 1)
    own = F.array(F.struct(F.lit(None).cast("int").alias("class"), F.lit(1).alias("n"), F.lit(None).cast("array<string>").alias("part")))
    cuts = F.transform("held", lambda s: F.struct(s["class"].alias("class"), F.lit(0).alias("n"), part(s).alias("part")))
    windows = held.select("key", "text_hash", "n_words", F.explode(F.when(F.col("first") == 0, F.concat(own, cuts)).otherwise(cuts)).alias("p")).select("key", "text_hash", "n_words", "p.*")

    # Retrieval works on hashes. A window meets a template in many bands: it is verified in the first of them only, by
    # hashes, and what passes by its words.
    held_grams = F.size("part") - SHINGLE
    hashed = windows.select("*", F.when(F.col("class").isNotNull(), F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(held_grams, F.lit(0))), lambda i: decontam._hash(F.col("part"), i, SHINGLE)))).alias("own"))
    signature = hashed.select("*", _minima(F.col("own"), count).alias("minima"))
    banded = signature.select("*", F.posexplode_outer("minima").alias("band", "value"))
    # The text's own row has no band: it is counted once, as windows' rows count nothing.
    retrieved = banded.join(near(signed), ["class", "band", "value"], "left")
    first_band = F.array_position(F.zip_with("minima", "theirs", lambda a, b: a == b), True) == F.col("band") + 1
    enough = lambda shared_ones, of: F.size(shared_ones) >= CONTAINMENT * F.size(of)
    verified = F.when(F.col("license").isNotNull() & first_band, F.when(enough(F.array_intersect("own", "hashes"), F.col("hashes")), F.when(enough(F.array_intersect(shingles(F.col("part")), "grams"), F.col("grams")), F.col("license"))))
    found = retrieved.select("key", "text_hash", "n_words", "n", verified.alias("license")).where(F.col("license").isNotNull() | (F.col("n") > 0))
    summed = found.groupBy("key", "text_hash", "n_words").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("license")).alias("names"))
    each = summed.select("*", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("__row"))
    return each.select(F.col("key").alias(key), F.size("names").cast("long").alias("n_licenses"), F.array_join("names", ",").alias("licenses"), F.col("n_words").cast("long").alias("n_words"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
