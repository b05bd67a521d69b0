"""Licence scans: Dice coefficient over word bigrams against templates.

Every line of every whole text, and the text as a whole, is normalised (lower case, anything but
letters and digits becomes one space) and compared to each template: twice the common word bigrams over
the sum of both counts, repeats counted. A coefficient of at least the threshold needs a bigram count
within fixed bounds of the template's, so a unit meets only templates of its size; most meet none.

NULL texts count as empty. A unit of fewer than two words has no bigrams and matches nothing. Equal
rows give equal rows. Ties of the best template go to the smallest name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import text_of

LEAST = Fraction(4, 5)
#: Short licence notices in common use.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This work has been released into the public domain.",
}


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bounds(count: int, least: Fraction = LEAST) -> tuple[int, int]:
    """Smallest and largest bigram count that can reach the threshold against ``count`` bigrams."""
    return math.ceil(least * count / (2 - least)), math.floor((2 - least) * count / least)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: Fraction = LEAST) -> DataFrame:
    """(doc_id, n_hits, licenses, best_license, best_dice) for every document.

    The template table is a literal, so its size is known. A unit is counted in words before it is cut
    into bigrams; texts are never shuffled, only the few units that have a template of their size.
    """
    spark = docs.sparkSession
    table = [(size, name, _bigrams(text)) for name, text in templates.items()
             for low, high in [bounds(len(_bigrams(text)), least)] for size in range(max(1, low), high + 1)]
    sizes = spark.createDataFrame(table, "size int, license string, template array<string>")
    largest = max(size for size, *_ in table)
    rows = docs.select("doc_id", text_of().alias("__text"), F.monotonically_increasing_id().alias("__row"))
    lines = F.split("__text", "\n")
    whole = F.when(F.size(lines) > 1, F.array("__text")).otherwise(F.array().cast("array<string>"))

    def counted(units: Column) -> Column:
        """Units of two words up to one above the largest size."""
        words = F.transform(units, lambda u: F.split(normalised(u), " "))
        return F.filter(words, lambda w: (F.size(w) >= 2) & (F.size(w) <= largest + 1))

    units = rows.select("doc_id", "__row", F.explode_outer(counted(F.concat(lines, whole))).alias("__words"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("__words") - 1), lambda i: F.array_join(F.slice("__words", i, 2), " ")
    )
    units = units.select("doc_id", "__row", F.when(F.size("__words") >= 2, pairs).alias("__pairs"))
    met = units.join(F.broadcast(sizes), F.size("__pairs") == F.col("size"), "left")

    def times(pairs: Column, pair: Column) -> Column:
        return F.size(F.filter(pairs, lambda p: p == pair))

    common = F.aggregate(
        F.array_distinct("__pairs"),
        F.lit(0),
        lambda s, p: s + F.least(times(F.col("__pairs"), p), times(F.col("template"), p)),
    )
    total = F.col("size") + F.size("template")
    good = least.denominator * 2 * F.col("common") >= least.numerator * F.col("total")
    scored = met.select("doc_id", "__row", "license", common.alias("common"), total.alias("total"))
    dice = 2.0 * F.col("common") / F.col("total")
    hit = scored.select("doc_id", "__row", F.when(good, F.struct((-dice).alias("d"), "license")).alias("hit"))
    found = hit.groupBy("__row", "doc_id").agg(
        F.count("hit").alias("n_hits"), F.collect_set("hit.license").alias("names"), F.min("hit").alias("best")
    )
    return found.select(
        "doc_id",
        "n_hits",
        F.array_join(F.array_sort("names"), ",").alias("licenses"),
        F.col("best.license").alias("best_license"),
        (-F.col("best.d")).alias("best_dice"),
    )
