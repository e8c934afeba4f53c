"""X5: licence notices in texts, by family, all in the JVM.

A phrase matches wherever its words follow one another, in any case and with anything but letters and digits of ASCII between them, so also
over a line break. Of phrases of a family that start at the same place the one that is named first counts; matches of a family
don't overlap, those of different families may.

Rows: null and empty texts have no notices. Repeated rows give their spans each; an empty table gives none. Further columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query, table

# fixed values: how notices name their licences
PHRASES = {
    "agpl": ("GNU Affero General Public License",),
    "apache": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD", "under the BSD License", "under a BSD-style license"),
    "cc": ("Licensed under CC BY", "Creative Commons Attribution", "under a Creative Commons", "licensed under CC0"),
    "gpl": ("GNU General Public License", "SPDX-License-Identifier: GPL"),
    "lgpl": ("GNU Lesser General Public License", "SPDX-License-Identifier: LGPL"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy", "Released under the MIT License", "under the MIT License", "SPDX-License-Identifier: MIT"),
    "mpl": ("Mozilla Public License", "SPDX-License-Identifier: MPL"),
    "proprietary": ("All rights reserved",),
}


def pattern(phrases: tuple[str, ...] | list[str]) -> str:
    """A pattern for the words of any of the phrases, read alike by Java and RE2."""
    words = (re.findall(r"[0-9A-Za-z]+", phrase) for phrase in phrases)
    return "(?i)(?:" + "|".join("[^0-9A-Za-z]+".join(w) for w in words) + ")"


def notices(docs: DataFrame, phrases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, family, start and end (code points, end exclusive) of each notice. A pattern of all phrases picks the texts that have any,
    so that only these are read family by family."""
    phrases = PHRASES if phrases is None else phrases
    if not any(phrases.values()):
        return docs.select("doc_id", F.lit("").alias("family"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end")).limit(0)
    some = docs.select("doc_id", "text").where(F.col("text").rlike(pattern([p for own in phrases.values() for p in own])))
    each = []
    for family, own in sorted(phrases.items()):
        if own:
            found, between = F.regexp_extract_all("text", F.lit(pattern(own)), F.lit(0)), F.split("text", pattern(own), -1)
            each.append(F.struct(F.lit(family).alias("family"), F.transform(found, F.length).alias("sizes"), F.transform(between, F.length).alias("gaps")))
    rows = some.select("doc_id", F.inline(F.array(*each))).where("size(sizes) > 0").select("doc_id", "family", "sizes", "gaps", F.posexplode("sizes").alias("at", "size"))
    start = F.expr("aggregate(slice(sizes, 1, at), 0, (a, x) -> a + x) + aggregate(slice(gaps, 1, at + 1), 0, (a, x) -> a + x)").cast("bigint")
    return rows.select("doc_id", "family", start.alias("start"), (start + F.col("size")).alias("end"))


def _sql(family: str, own: tuple[str, ...]) -> str:
    return f"SELECT doc_id, '{family}' AS family, list_transform(regexp_extract_all(text, '{pattern(own)}'), lambda x: len(x)) AS sizes, list_transform(string_split_regex(text, '{pattern(own)}'), lambda x: len(x)) AS gaps FROM documents"


@query(
    "x5_licences",
    "WITH found AS ("
    + " UNION ALL ".join(_sql(f, own) for f, own in PHRASES.items())
    + "), placed AS (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM found) "
    + 'SELECT doc_id, family, (coalesce(list_sum(sizes[1 : i - 1]), 0) + list_sum(gaps[1 : i]))::BIGINT AS start, (list_sum(sizes[1 : i]) + list_sum(gaps[1 : i]))::BIGINT AS "end" FROM placed',
)
def licences(spark, sf_dir):
    return notices(table(spark, sf_dir, "documents"))
