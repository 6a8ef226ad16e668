"""License scans: MinHash bands over overlapping windows, then exact containment. No Python in tasks.

A template of ``m`` words is looked for in windows of ``2 m`` words that start every ``m``
words, so each copy lies whole in some window. Its shingles (five words) and those of the
window have a Jaccard similarity of at least ``J = p (m - 4) / (2 m - 4 + (1 - p) (m - 4))``
where ``p`` is the wanted containment. With one row a band and ``b`` bands a window that
holds the template is retrieved with probability ``1 - (1 - J) ** b``; ``b`` is chosen per
template so that this is ``certain`` (0.999) or more. Retrieved pairs are checked exactly:
the share of the template's distinct shingles in the window.

A band of a window can only equal a template's if the window holds the shingle that is the
template's minimum. Texts without any of those shingles (at most bands times templates, a
bounded set of constants) therefore have no retrieved window and are finished in the same
pass; the others write their windows. Nothing is dropped or capped.

Words are runs of letters and digits, lower case. Nulls: a null text has no words; null
ids and repeated rows are rows of their own; texts under five words match nothing; extra
columns are ignored; an empty table gives no rows. Templates under five words are an error.
"""

from math import ceil, log

from pyspark.sql import functions as F

from quire.llm.common import stored

N = 5
#: Notices by licence, as their publishers word them (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies'
    ),
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0",
}


def words_of(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words):
    """Hash of the ``N`` words from each word on, in order."""
    last = F.size(words) - N
    joined = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(N)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), joined)).otherwise(F.array().cast("array<bigint>"))


def bands_for(m, containment=0.75, certain=0.999):
    """Bands that retrieve a contained template of ``m`` words with probability ``certain``."""
    j = containment * (m - N + 1) / (2 * m - N + 1 + (1 - containment) * (m - N + 1))
    return ceil(log(1 - certain) / log(1 - j))


def _minima(shingles, bands):
    """Minimum of each band's hash over an array of shingles."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))))


def prepared(spark, templates, containment, certain):
    """Template table: name, words, bands, distinct shingles, minimum and minimal shingle per band."""
    rows = spark.createDataFrame(list(templates.items()), "license string, notice string")
    rows = rows.withColumn("words", words_of(F.col("notice"))).withColumn("width", F.size("words"))
    sizes = {r["width"] for r in rows.select("width").distinct().collect()}
    if min(sizes) < N:
        raise ValueError(f"a template needs {N} words at least")
    bands = F.lit(None).cast("int")
    for m in sizes:
        bands = F.when(F.col("width") == m, F.lit(bands_for(m, containment, certain))).otherwise(bands)
    rows = rows.withColumn("bands", bands).withColumn("shingles", F.array_distinct(shingles_of(F.col("words"))))
    rows = rows.withColumn("minima", _minima(F.col("shingles"), F.col("bands")))
    least = lambda v, b: F.get(F.filter("shingles", lambda x: F.xxhash64(x, b) == v), F.lit(0))
    return rows.withColumn("keys", F.transform("minima", least)).select("license", "width", "bands", "shingles", "minima", "keys")


def scan(docs, templates=None, containment=0.75, certain=0.999):
    """Per document ``matches``: licence, first word of the window, containment; best window of each licence first."""
    spark = docs.sparkSession
    table = prepared(spark, templates or TEMPLATES, containment, certain)
    # constants, bounded by bands times templates
    known = table.select("license", "width", "bands", "keys").collect()
    keys = sorted({k for r in known for k in r["keys"]})
    widths = {}
    for r in known:
        widths[r["width"]] = max(r["bands"], widths.get(r["width"], 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("shingles", shingles_of(F.col("words")))
    hits = F.filter(F.transform("shingles", lambda x, i: F.when(x.isin(keys), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "shingles", hits.alias("hits"))
    rows = rows.withColumn("shingles", F.when(F.size("hits") > 0, F.col("shingles")))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "license-hits")
    found = rows.filter(F.size("hits") > 0)
    size = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(b).alias("bands")) for w, b in sorted(widths.items())]))
    windows = found.select("uid", "shingles", "hits", size.alias("s")).select("uid", "shingles", "hits", "s.*")
    # windows begin at multiples of the width; a hit lies in its own and in the one before
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.transform(F.array(F.lit(0), F.lit(1)), lambda k: (F.floor(i / F.col("width")) - k).cast("int")))))
    windows = windows.select("uid", "shingles", "width", "bands", F.explode(F.filter(starts, lambda k: k >= 0)).alias("k"))
    windows = windows.select(
        "uid", "width", "bands", (F.col("k") * F.col("width")).alias("at"),
        F.slice("shingles", F.col("k") * F.col("width") + 1, 2 * F.col("width") - N + 1).alias("inside"),
    ).filter(F.size("inside") > 0)
    banded = windows.select("uid", "at", "width", "inside", F.posexplode(_minima(F.col("inside"), F.col("bands"))).alias("band", "value"))
    theirs = table.select("license", "width", F.col("shingles").alias("wanted"), F.posexplode("minima").alias("band", "value"))
    # the templates are a parameter, not data: a bounded broadcast
    met = banded.join(F.broadcast(theirs), ["width", "band", "value"])
    met = met.groupBy("uid", "license", "at").agg(F.first("inside").alias("inside"), F.first("wanted").alias("wanted"))
    share = F.size(F.array_intersect("wanted", "inside")) / F.size("wanted")
    good = met.select("uid", "license", "at", share.alias("share")).filter(F.col("share") >= containment)
    best = good.groupBy("uid", "license").agg(F.max(F.struct("share", (-F.col("at")).alias("less"))).alias("top"), F.count("*").alias("n"))
    per = best.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("license", (-F.col("top.less")).alias("at_word"), F.col("top.share").alias("containment"), F.col("n").alias("n_windows")))).alias("matches")
    )
    none = F.array().cast("array<struct<license:string,at_word:int,containment:double,n_windows:bigint>>")
    return rows.select("uid", "doc_id").join(per, "uid", "left").select("doc_id", F.coalesce("matches", none).alias("matches"))
