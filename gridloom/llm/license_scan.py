"""License scans with MinHash bands over overlapping word windows, in DataFrame operations only.

A text becomes its words (lower case, letters and digits) and the hashes of its shingles: word pairs for notices, and
five words for templates of over ``LONG`` words, whose single pairs would be common ones. Templates are single notices
or whole license texts of any length from two shingles on. They fall into size classes (see
:func:`size_class`); for each class in use windows of a fixed number of shingles overlap so that some window holds any
template of the class whole, and the template is at least half of that window. Each window has ``bands`` MinHash
values of one row each, and a window retrieves a template where a value is equal. With a Jaccard similarity of J a
template is missed with probability (1 - J)^bands: for a whole copy J >= 0.5, 1e-6 at 20 bands; for the least verified
share of 0.8 in the widest window J >= 0.36, 1.3e-4. (Pairs of function words have no part in a template's MinHash;
where they are a fifth of it, J falls by as much.) What is retrieved is verified exactly, by the shingles
themselves: the share of the template's distinct shingles that are in the window.

A band value can only equal a template's where the window holds that template's minimal shingle, so windows are made
only around such shingles. This leaves out windows whose bands cannot collide, nothing else, and texts without one
end in the scan. Templates are a fixed list; its table (a row per template and band) is broadcast. No shuffle carries
text; the matches alone are grouped, by (doc_id, license).

Defined results: a null or empty text matches nothing; matches of rows with one doc_id (repeated rows, or a null
doc_id) are reported together; a window that holds two templates reports both; a template of one word or none raises
an error; no match gives no row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import constant

#: Notices as their licenses (or custom) word them, and whole license texts without their copyright lines.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "CC0 1.0 Universal Public Domain Dedication",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-name": "licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}
BANDS = 20
CONTAINMENT = 0.8
#: Templates of more words are compared by shingles of five words, others by pairs.
LONG = 40
#: Pairs of these words are left out of a template's MinHash (not of its verification): they are in nearly every text.
FUNCTION_WORDS = "a an and any are as at be by for from in is it not of on or that the this to was with".split()


def size_class(n: int) -> tuple[int, int]:
    """(shingles of a window, step) for a template of ``n`` shingles.

    Classes are least .. most with most about 1.4 times least, from 2 on. Windows have at most twice the least, and
    most + step - 1 shingles, so one of them holds the template wherever it is.
    """
    least = 2
    while True:
        most = max(least, int(1.4 * least))
        if n <= most:
            step = (2 * least - most + 2) // 2
            return most + step - 1, step
        least = most + 1


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def shingle_words(n_words: int) -> int:
    """Words of a shingle for a template of so many words."""
    return 5 if n_words > LONG else 2


def cut(text: Column) -> Column:
    """w (words), h2 and h5 (hashes of all shingles of two and five words). The words are the variable of a lambda, so they are made once."""
    def hashed(w: Column) -> Column:
        n = F.size(w)
        h2 = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
        return F.struct(w.alias("w"), h2.alias("h2"))

    def longer(c: Column) -> Column:
        n = F.greatest(F.size(c["w"]) - 4, F.lit(0))
        h4 = F.zip_with(F.slice(c["h2"], F.lit(1), n), F.slice(c["h2"], F.lit(3), n), lambda a, b: F.xxhash64(a, b))
        h5 = F.zip_with(h4, F.slice(c["w"], F.lit(5), n), lambda a, b: F.xxhash64(a, b))
        return F.struct(c["w"].alias("w"), c["h2"].alias("h2"), h5.alias("h5"))

    return F.element_at(F.transform(F.transform(F.array(words(text)), hashed), longer), 1)


def plain_shingles(w: Column, k: Column) -> Column:
    """The distinct shingles of ``k`` words themselves."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.concat_ws(" ", F.slice(w, i, k))))


def _under(window: Column, i: int) -> Column:
    """The window's shingles under hash function i."""
    return F.transform(window, lambda x: F.xxhash64(F.lit(i), x))


def _bands(window: Column, bands: int) -> Column:
    return F.array(*[F.array_min(_under(window, i)) for i in range(bands)])


def _minimal(own: Column, i: int) -> Column:
    """The shingle that is minimal under hash function i, as an array of one."""
    by_hash = F.array_sort(F.transform(own, lambda x: F.struct(F.xxhash64(F.lit(i), x).alias("k"), x.alias("x"))))
    return F.slice(F.transform(by_hash, lambda s: s["x"]), 1, 1)


def _windows(at: Column, size: int, step: int) -> Column:
    """Windows around the places ``at``: they begin at multiples of the step, in (p - size, p]."""
    first = F.transform(at, lambda p: F.greatest(F.ceil((p - size + 1) / step), F.lit(0)).cast("int"))
    last = F.transform(at, lambda p: F.floor(p / step).cast("int"))
    near = F.array_distinct(F.flatten(F.zip_with(first, last, lambda a, b: F.sequence(a, b))))
    return F.transform(near, lambda s: F.struct((s * step).alias("start"), F.lit(size).alias("size")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, start, size (the window, in shingles), containment of every verified window."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in templates.items()], "license string, notice string").withColumn("cut", cut(F.col("notice")))
    table = table.withColumn("k", F.when(F.size("cut.w") > LONG, 5).otherwise(2)).filter(F.size("cut.w") > 2)
    table = table.select("license", "k", F.array_distinct(F.when(F.col("k") == 5, F.col("cut.h5")).otherwise(F.col("cut.h2"))).alias("own"), plain_shingles(F.col("cut.w"), F.col("k")).alias("plain")).filter(F.size("own") > 1)
    usual = spark.createDataFrame([(a, b) for a in FUNCTION_WORDS for b in FUNCTION_WORDS], "a string, b string").select(F.xxhash64("a", "b")).collect()
    telling = F.array_except("own", constant(np.array([r[0] for r in usual], np.int64)))
    table = table.withColumn("telling", F.when(F.size(telling) > 1, telling).otherwise(F.col("own")))
    table = table.withColumn("bands", _bands(F.col("telling"), bands)).withColumn("minimal", F.flatten(F.array(*[_minimal(F.col("telling"), i) for i in range(bands)])))
    rows = table.collect()  # the template list, fixed
    if bad := sorted(set(templates) - {r["license"] for r in rows}):
        raise ValueError(f"templates of under two shingles: {bad}")
    kinds = sorted({r["k"] for r in rows})
    # the shingles of templates that are minimal under some hash, and those of them that a text has
    anchors = {k: constant(np.array(sorted({x for r in rows if r["k"] == k for x in r["minimal"]}), np.int64)) for k in kinds}
    # a generator, so that what follows reads the arrays instead of making them again
    hashed = docs.select("doc_id", F.inline(F.array(cut(F.col("text")))))
    hit = hashed.filter(reduce(lambda a, b: a | b, [F.arrays_overlap(f"h{k}", anchors[k]) for k in kinds]))
    hit = hit.select("doc_id", "w", *[f"h{k}" for k in kinds], *[F.array_intersect(f"h{k}", anchors[k]).alias(f"found{k}") for k in kinds])
    def windows_of(k: int) -> Column:
        """Each window takes its own part of the text along, and nothing else."""
        at = F.filter(F.transform(f"h{k}", lambda x, i: F.when(F.array_contains(f"found{k}", x), i)), lambda i: i.isNotNull())
        sizes = sorted({size_class(len(r["own"])) for r in rows if r["k"] == k})
        starts = F.element_at(F.transform(F.array(at), lambda places: F.concat(*[_windows(places, size, step) for size, step in sizes])), 1)
        return F.transform(starts, lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["size"].alias("size"), F.slice(f"h{k}", s["start"] + 1, s["size"]).alias("window"), F.slice("w", s["start"] + 1, s["size"] + k - 1).alias("words")))

    parts = [windows_of(k) for k in kinds]
    windows = hit.select("doc_id", F.explode(F.concat(*parts)).alias("part")).select("doc_id", "part.*")
    keyed = windows.select("*", F.posexplode(_bands(F.col("window"), bands)).alias("band", "key"))
    listed = spark.createDataFrame([(r["license"], r["k"], size_class(len(r["own"]))[0], i, key, r["plain"]) for r in rows for i, key in enumerate(r["bands"])], "license string, k int, size int, band int, key long, plain array<string>")
    found = keyed.join(F.broadcast(listed), ["k", "size", "band", "key"])
    share = F.size(F.array_intersect(plain_shingles(F.col("words"), F.col("k")), F.col("plain"))) / F.size("plain")
    return found.select("doc_id", "license", "start", "size", share.alias("containment")).filter(F.col("containment") >= containment).distinct()


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found: doc_id, license, containment (the best), first_word, windows."""
    best = scan(docs, templates).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("first_word"), F.count(F.lit(1)).alias("windows"))
    return best


def brute_force(texts: dict[int, str | None], templates: dict[str, str] | None = None, containment: float = CONTAINMENT, step: int | None = None) -> dict[tuple[int, str], float]:
    """(doc_id, license) -> best containment over all windows, from the shingles themselves; for tests.

    step: of the windows; None for that of the scan, 1 for windows at every position.
    """
    out: dict[tuple[int, str], float] = {}

    def cut_words(text: str) -> list[str]:
        return re.findall(r"[^\W_]+", text.lower())

    def shingles(w: list[str], k: int) -> list[tuple[str, ...]]:
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    for name, notice in (templates or TEMPLATES).items():
        k = shingle_words(len(cut_words(notice)))
        own = set(shingles(cut_words(notice), k))
        size, usual = size_class(len(own))
        for doc_id, text in texts.items():
            every = shingles(cut_words(text or ""), k)
            if own.isdisjoint(every):
                continue
            best = max((len(own & set(every[s : s + size])) / len(own) for s in range(0, max(1, len(every)), step or usual)), default=0.0)
            if best >= containment:
                out[doc_id, name] = best
    return out
