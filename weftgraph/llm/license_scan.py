"""License scans by sparse TF-IDF cosine to templates, then inheritance along directories, in SQL functions only.

A file that speaks of a licence anywhere in its text is read in blocks: each
line that does, and each paragraph that does; a licence file in all its
paragraphs. Marks of comments are taken off the lines first. The terms of a
block are weighed by TF-IDF, with document frequencies counted over all blocks
of the corpus and the templates, and compared with each template by cosine, so
what else a file says does not blur its notice. A licence has several templates
(tags, one-line notices, headers, paragraphs of its text); a file has the
licence whose templates it meets best together. A block counts for a template
only if it has its names, versions and modifiers (non-commercial, say) and no
versions or modifiers that the licence lacks, which cosine alone would pass
over; blocks that deny a licence count for none. A file with a licence tag has
what the tag says, an expression of several licences as it stands.

A file without a licence of its own inherits that of the licence file in the
nearest directory above it. The nearest is found for each distinct directory
by joining its ancestors with the licensed directories, and joined back, so
the files of a large directory are not multiplied. Terms, directories and
files that stand for very many rows are joined by broadcast.

A null path or text is the empty string; such files have no licence of their
own. Equally good licences go by name, and of licence files in one directory
the best decides. Rows with equal ids, paths and texts give one row each; texts
of any length are read whole. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, hot_keys, join_unique

#: Tags, notices, headers and paragraphs by which each licence is known, from their public texts.
TEMPLATES = {
    "0BSD": ["SPDX-License-Identifier: 0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AGPL-3.0": [
        "SPDX-License-Identifier: AGPL-3.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-1.1": ["SPDX-License-Identifier: Apache-1.1", "The Apache Software License, Version 1.1", "Licensed under the Apache License, Version 1.1"],
    "Apache-2.0": [
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSL-1.0": ["SPDX-License-Identifier: BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "BSD-2-Clause": [
        "SPDX-License-Identifier: BSD-2-Clause",
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-3-Clause": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["SPDX-License-Identifier: CC-BY-4.0", "Licensed under CC BY 4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["SPDX-License-Identifier: CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["SPDX-License-Identifier: CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["SPDX-License-Identifier: CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["SPDX-License-Identifier: CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"],
    "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0", "Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v 2.0"],
    "GPL-2.0": [
        "SPDX-License-Identifier: GPL-2.0",
        "This work is licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "SPDX-License-Identifier: GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "SPDX-License-Identifier: LGPL-2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "SPDX-License-Identifier: LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved", "Proprietary and confidential. Unauthorized copying of this file, via any medium is strictly prohibited."],
    "Unlicense": ["SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."],
    "WTFPL": ["SPDX-License-Identifier: WTFPL", "Released under the WTFPL License", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "Zlib": ["SPDX-License-Identifier: Zlib", "Released under the zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
#: Names that a block must have where a template has them.
NAMES = ["0bsd", "agpl", "apache", "boost", "bsd", "bsl", "cc", "cc0", "creative", "eclipse", "epl", "gnu", "gpl", "isc", "lgpl", "mit", "mozilla", "mpl", "unlicense", "wtfpl", "zlib"]
#: Words by which relatives differ, by pattern.
MODIFIERS = {"affero": r"affero|\bagpl", "lesser": r"lesser general|\blgpl", "nc": r"\bnc\b|non-?commercial", "nd": r"\bnd\b|no-?deriv", "sa": r"\bsa\b|share-?alike"}
VERSION = r"(?:\bversion |\bv[.]? ?|-|\bby |\bbsd |\bcc0 |attribution |commercial |alike |derivatives )([0-9](?:[.][0-9])?)\b"
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+() -]*)"
NEGATED = r"(?i)\bnot (?:be )?(?:licen[sc]ed|released) under|\bno longer (?:licen[sc]ed|released) under"
CUE = r"(?i)licen[sc]|copyright|all rights reserved|spdx|redistribution and use|permission (is hereby|to use)|neither the name|free software|public domain|proprietary"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
COMMENT_MARK = r"^[ \t]*(//+|#+|/?\*+/?|--+|;+|%+|<!--)?[ \t]*"
PARAGRAPH_END = r"\n([ \t\r]*\n)+"
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
MIN_COSINE = 0.6


def _terms(block: Column) -> Column:
    return F.regexp_extract_all(F.lower(block), F.lit(f"({TERM})"), F.lit(1))


def _marks(block: Column) -> Column:
    """The versions that a block names, as 2.0 for 2, and its modifiers."""
    low = F.lower(block)
    versions = F.transform(F.regexp_extract_all(low, F.lit(VERSION), F.lit(1)), lambda v: F.when(F.length(v) == 1, F.concat(v, F.lit(".0"))).otherwise(v))
    found = F.array_compact(F.array(*(F.when(low.rlike(pattern), F.lit(name)) for name, pattern in MODIFIERS.items())))
    return F.array_distinct(F.concat(versions, found))


def _names(terms: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, NAMES)), terms)


def blocks_of(files: DataFrame) -> DataFrame:
    """(file, at, terms, marks) of the blocks to compare; ``files`` has file, name and text."""
    named = F.col("name").rlike(LICENSE_FILE)
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, COMMENT_MARK, ""))
    found = files.where(F.col("text").rlike(CUE) | named).select("file", named.alias("named"), lines.alias("lines"))
    found = found.withColumn("paragraphs", F.split(F.array_join("lines", "\n"), PARAGRAPH_END))
    blocks = F.array_distinct(F.concat(F.filter("lines", lambda x: x.rlike(CUE)), F.filter("paragraphs", lambda x: F.col("named") | x.rlike(CUE))))
    found = found.select("file", F.posexplode(blocks).alias("at", "block")).where(~F.col("block").rlike(NEGATED))
    return found.select("file", "at", _terms(F.col("block")).alias("terms"), _marks(F.col("block")).alias("marks")).where(F.size("terms") > 0)


def own_licenses(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(file, license, cosine) of the files that have one; ``files`` has file, name and text."""
    blocks = cut(blocks_of(files))
    counts = cut(blocks.select("file", "at", F.explode("terms").alias("term")).groupBy("file", "at", "term").agg(F.count("*").alias("tf")))
    known = _templates(files.sparkSession)
    theirs = known.select("license", "template", F.explode("terms").alias("term")).groupBy("license", "template", "term").agg(F.count("*").alias("tf"))
    n = counts.select("file", "at").distinct().count() + sum(map(len, TEMPLATES.values()))
    seen = counts.groupBy("term").agg(F.count("*").alias("n")).unionByName(theirs.groupBy("term").agg(F.count("*").alias("n")))
    seen = cut(seen.groupBy("term").agg(F.sum("n").alias("n")))
    idf = seen.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("n"))) + 1).alias("idf"))
    weighed = join_unique(counts, idf, ["term"], hot=hot_keys(seen, ["term"])).select("file", "at", "term", (F.col("tf") * F.col("idf")).alias("w"))
    target = idf.join(F.broadcast(theirs), "term").select("license", "template", "term", (F.col("tf") * F.col("idf")).alias("v"))  # the templates' terms
    norms = target.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    target = target.join(F.broadcast(norms), ["license", "template"]).select("license", "template", "term", (F.col("v") / F.col("norm")).alias("v"))
    by_term = F.broadcast(target.groupBy("term").agg(F.collect_list(F.struct("license", "template", "v")).alias("in")))
    norm = weighed.groupBy("file", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(by_term, "term").select("file", "at", "w", F.explode("in").alias("t")).groupBy("file", "at", "t.license", "t.template").agg(F.sum(F.col("w") * F.col("t.v")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")
    met = dots.join(norm, ["file", "at"]).select("file", "at", "license", "template", cosine).where(F.col("cosine") >= min_cosine)
    # What tells a licence from its relatives must agree: the template's names and marks are there, and no marks that the licence has not.
    allowed = known.groupBy("license").agg(F.array_distinct(F.flatten(F.collect_list("needs"))).alias("allowed"))
    rules = F.broadcast(known.join(allowed, "license").select("license", "template", "needs", "names", "allowed"))
    met = met.join(rules, ["license", "template"]).join(blocks.select("file", "at", "marks", _names(F.col("terms")).alias("named")), ["file", "at"])
    met = met.where((F.size(F.array_except("needs", "marks")) == 0) & (F.size(F.array_except("names", "named")) == 0) & (F.size(F.array_except("marks", "allowed")) == 0))
    met = met.groupBy("file", "license", "template").agg(F.max("cosine").alias("cosine"))
    met = met.groupBy("file", "license").agg(F.max("cosine").alias("cosine"), F.round(F.sum("cosine"), 4).alias("all"))
    best = F.struct(-F.col("all"), -F.col("cosine"), "license")
    return met.groupBy("file").agg(F.min_by("license", best).alias("license"), F.min_by("cosine", best).alias("cosine"))


def tagged(text: Column) -> Column:
    """The first licence tag of a text as it stands, an expression of several licences too; null if it has none."""
    tag = F.rtrim(F.regexp_replace(F.regexp_extract(text, SPDX, 1), "[ -]+$", ""))
    return F.when(tag != "", tag)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(name, i, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    named = spark.createDataFrame(rows, "license string, template int, text string").select("license", "template", _terms(F.col("text")).alias("terms"), _marks(F.col("text")).alias("needs"))
    return named.withColumn("names", _names(F.col("terms")))


def scan(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, path, license, cosine, origin) of every row; ``files`` has id, path and text. origin: header, file, inherited, or null."""
    path, text = F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))
    key = path, text, F.coalesce(F.col("id").cast("string"), F.lit("null"))
    rows = files.select("id", path.alias("path"), text.alias("text"), F.struct(F.xxhash64(*key).alias("a"), F.xxhash64(F.lit("again"), *key).alias("b")).alias("file"))
    rows = rows.withColumns({"name": F.regexp_extract("path", "([^/]*)$", 1), "dir": F.regexp_replace("path", "/?[^/]*$", "")})
    own = cut(own_licenses(rows.select("file", "name", "text"), min_cosine))
    rows = join_unique(cut(rows.withColumn("tag", tagged(F.col("text"))).drop("text")), own, ["file"], "left").drop("file")
    rows = cut(rows.withColumns({"license": F.coalesce("tag", "license"), "cosine": F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("cosine"))}).drop("tag"))
    licensed = rows.where(F.col("name").rlike(LICENSE_FILE) & F.col("license").isNotNull())
    licensed = licensed.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("inherited"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))
    root = F.when(F.col("dir") == "", F.array().cast("array<struct<dir:string,depth:int>>")).otherwise(above)
    up = F.explode(F.concat(F.array(F.struct(F.lit("").alias("dir"), F.lit(0).alias("depth"))), root)).alias("up")
    sizes = cut(rows.groupBy("dir").agg(F.count("*").alias("n")))
    dirs = cut(sizes.select(F.col("dir").alias("under"), up).select("under", "up.dir", "up.depth"))
    nearest = join_unique(dirs, cut(licensed), ["dir"]).groupBy("under").agg(F.max_by("inherited", "depth").alias("inherited")).withColumnRenamed("under", "dir")
    rows = join_unique(rows, cut(nearest), ["dir"], "left", hot=hot_keys(sizes, ["dir"]))
    named = F.col("name").rlike(LICENSE_FILE)
    origin = F.when(F.col("license").isNotNull(), F.when(named, "file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited")
    return rows.select("id", "path", F.coalesce("license", "inherited").alias("license"), "cosine", origin.alias("origin"))
