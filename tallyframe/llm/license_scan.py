"""License notices by MinHash bands over overlapping windows, verified exactly (DataFrame operations only).

Texts and templates are normalised alike (lower case, marks dropped) and cut into shingles of five words. For
every template length there are windows a quarter longer, every quarter of it, so one of them holds the whole notice.
Windows without any template shingle cannot match and are not built. Each window has ``BANDS`` bands of ``ROWS``
minimum hashes; a window that holds four fifths of a template has a Jaccard similarity of at least 0.36 (0.6 for notices of
ten words or more), and so shares a band with probability above 0.99 (above 0.999999). Band matches are then
verified: the share of the template's shingles that the window contains. Where notices overlap, the best one is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

SHINGLE, BANDS, ROWS = 5, 40, 2
#: Public license notices; fixed texts.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
    "https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def shingled(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``_h``: hashes of the five-word shingles in order; a shorter text is one shingle of all its words."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), "")
    rows = rows.withColumn("_w", words)
    return rows.withColumn("_h", F.expr(
        f"CASE WHEN size(_w) >= {SHINGLE} THEN transform(sequence(0, size(_w) - {SHINGLE}), i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(SHINGLE))}))"
        " WHEN size(_w) > 0 THEN array(xxhash64(array_join(_w, ' '))) ELSE cast(array() AS array<bigint>) END"))


def banded(rows: DataFrame) -> DataFrame:
    """One row per band of the shingle set ``_s``: adds ``band`` and ``code``."""
    least = F.transform(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), lambda k: F.array_min(F.transform("_s", lambda x: F.xxhash64(x, k))))
    rows = rows.withColumn("_m", least)
    codes = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64({', '.join(f'_m[b * {ROWS} + {r}]' for r in range(ROWS))}))")
    return rows.select(*[c for c in rows.columns if c != "_m"], F.posexplode(codes).alias("band", "code"))


def _best_of_overlapping(met: DataFrame, longest: int) -> DataFrame:
    """The matches that no better match of another notice overlaps by more than half of the shorter one.

    A match reaches from its first to its last shingle of the notice, ``start`` to ``stop``, so that notices in a row do
    not overlap. It looks at the starts within the length of the longest window only: the frame is bounded whatever the text.
    """
    reach = longest + longest // 4
    near = Window.partitionBy("_n").orderBy("start").rangeBetween(-reach, reach)
    met = met.withColumn("_near", F.collect_list(F.struct("containment", "n", "license", "start", "stop")).over(near))
    beats = "(x.containment > containment OR (x.containment = containment AND (x.n > n OR (x.n = n AND x.license < license))))"
    shared = "2 * (least(x.stop, stop) - greatest(x.start, start)) > least(x.stop - x.start, stop - start)"
    return met.filter(F.expr(f"NOT exists(_near, x -> x.license <> license AND {shared} AND {beats})")).drop("_near")


def scan(docs: DataFrame, notices: dict[str, str] | None = None, containment: float = 0.8, overlapping: bool = False) -> DataFrame:
    """``doc_id, license, containment, word`` of every notice found: the best share and the first word of its window.

    Notices need five words at least. Null and empty texts hold none; documents without a notice have no row, a repeated row
    has the row of its id, and null ids count as one id. Several notices in a text each have a row. Where several
    notices share most of their words in the text, only the one that is contained best counts, the longer and then the lesser name in ties;
    ``overlapping`` keeps them all.
    """
    spark: SparkSession = docs.sparkSession
    notices = NOTICES if notices is None else notices
    known = shingled(spark.createDataFrame(list(notices.items()), "license string, notice string"), F.col("notice"))
    known = materialise(known.select("license", F.size("_w").alias("n"), F.array_distinct("_h").alias("_s")))
    lengths = sorted({r.n for r in known.select("n").collect()})  # the templates are a fixed list
    if not lengths or lengths[0] < SHINGLE:
        raise ValueError("a notice has fewer than five words")
    every = [x for r in known.select("_s").collect() for x in r._s]
    rows = shingled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")), F.col("_text")).select("doc_id", "_h")
    wanted = F.array(*[F.lit(x).cast("long") for x in sorted(set(every))])
    # the row number keeps the filter above the shingles, which would else be computed again for every word
    rows = rows.withColumn("_hit", F.array_intersect("_h", wanted)).withColumn("_n", F.monotonically_increasing_id())
    rows = materialise(rows.filter((F.size("_hit") > 0) & (F.col("_n") >= 0)).select("doc_id", "_n", "_h", "_hit"))
    rows = rows.withColumn("_at", F.expr("filter(sequence(0, size(_h) - 1), i -> array_contains(_hit, _h[i]))"))
    windows = []
    for n in lengths:  # (length, start) of every window that holds a hit
        stride, extra = max(1, n // 4), max(1, n // 4)
        span = n + extra - SHINGLE  # shingles after the first
        windows.append(f"flatten(transform(_at, p -> transform(sequence(cast(ceil(greatest(0, p - {span}) / {stride}) AS int), cast(floor(p / {stride}) AS int)),"
                       f" j -> struct({n} AS n, j * {stride} AS word, {span + 1} AS size))))")
    rows = rows.select("doc_id", "_n", "_h", F.explode(F.array_distinct(F.expr(f"concat({', '.join(windows)})"))).alias("_x"))
    rows = rows.select("doc_id", "_n", "_x.n", "_x.word", F.slice("_h", F.col("_x.word") + 1, F.col("_x.size")).alias("_s"))
    table = banded(known).select("license", F.col("n"), "band", "code", F.col("_s").alias("_t"))
    met = banded(rows).join(F.broadcast(table), ["n", "band", "code"])  # a fixed list of notices
    share = F.size(F.array_intersect("_s", "_t")) / F.size("_t")
    met = met.withColumn("containment", share).filter(F.col("containment") >= containment)
    if not overlapping:
        at = F.expr("filter(sequence(0, size(_s) - 1), i -> array_contains(_t, _s[i]))")
        met = met.select("doc_id", "_n", "license", "n", "word", "containment", at.alias("_a")).withColumn("start", (F.col("word") + F.col("_a")[0]).cast("long"))
        met = met.withColumn("stop", F.col("word") + F.element_at("_a", -1) + SHINGLE).drop("_a").distinct()
        met = _best_of_overlapping(met, lengths[-1])
    best = F.max(F.struct("containment", (-F.col("word")).alias("w")))
    return met.groupBy("doc_id", "license").agg(best.alias("b")).select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.w")).alias("word"))
