"""Licence scans, in DataFrame operations only.

Every line, paragraph and sentence, without the marks of comments, and of files named like one
the whole licence file, is compared with licence templates by the cosine of sparse TF-IDF
vectors; the nearest template names the passage's licence.  Where a paragraph has one its
sentences don't count, and where a sentence has one the paragraph's lines don't: a piece of a
notice may lack its version.  A file takes the licences of its own notices; one without takes those of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, sized, stored

# A term is a run of these without the marks at its end; no pattern here repeats a group, as Java's matcher recurses on those.
TERM, ENDS = r"[a-z0-9][a-z0-9.+-]*", ".+-"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
OPENING, CLOSING = r"^[ \t]*[#;*/!%<>-]*[ \t]*", r"[ \t\r]*[*/>-]*[ \t\r]*$"  # marks of comments around a line
SENTENCE = r"\.[ \t\r\n]+([A-Z])"
LEAST = 0.8
FAMILIES = {"BSD": "BSD-"}  # a name that gives way to those that begin so
BROADCAST_UNITS = 200_000  # distinct passages with a licence that may be broadcast

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_NAMES = [("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
_CC = [("CC-BY-4.0", "Attribution", "BY"), ("CC-BY-SA-4.0", "Attribution-ShareAlike", "BY-SA"), ("CC-BY-NC-4.0", "Attribution-NonCommercial", "BY-NC"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives", "BY-ND"), ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike", "BY-NC-SA"), ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives", "BY-NC-ND")]
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_KEPT = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MPL = "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"

#: Licence and notice, as published; neighbours stand side by side, so that the nearest wins.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    *((spdx, f"This work is licensed under the {name}, version {version}.") for spdx, name, version in _GNU_NAMES),
    *((spdx, _GNU.format(name, version)) for spdx, name, version in _GNU_NAMES),
    *((spdx, f"Licensed under CC {short} 4.0.") for spdx, _, short in _CC),
    *((spdx, f"This work is licensed under a Creative Commons {name} 4.0 International License.") for spdx, name, _ in _CC),
    ("BSD", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_KEPT}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_KEPT} {_BSD_NAMES}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("MPL-1.1", _MPL),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def terms_of(text: str) -> list[str]:
    return [x.rstrip(ENDS) for x in re.findall(TERM, text.lower())]


class Model:
    """Template vectors; their size is that of the templates given."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST):
        counts = [Counter(terms_of(text)) for _, text in templates]
        found_in = Counter(term for c in counts for term in c)
        self.least = least
        self.idf = {term: 1 + math.log((1 + len(counts)) / (1 + n)) for term, n in found_in.items()}
        self.unknown = 1 + math.log(1 + len(counts))  # of a term that no template has
        self.rows = []
        for i, ((name, _), c) in enumerate(zip(templates, counts)):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            self.rows += [(i, name, t, n * self.idf[t] / norm) for t, n in sorted(c.items())]
        # A text's cosine to a template is at most the root of the squared weights of the template's terms that it has.
        self.squares = [{t: w * w for k, _, t, w in self.rows if k == i} for i in range(len(counts))]


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda x: F.rtrim(x, F.lit(ENDS)))


def _paragraphs(text: Column) -> Column:
    """Without the marks of comments."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, OPENING, ""), CLOSING, ""))
    return F.split(F.array_join(lines, "\n"), "\n\n")


def _pieces(paragraph: Column) -> Column:
    """The paragraph, its sentences and its lines, with rank 0 to 2."""
    def ranked(passages: Column, rank: int) -> Column:
        return F.transform(passages, lambda p: F.struct(F.lit(rank).alias("rank"), p.alias("passage")))

    sentences = F.split(F.regexp_replace(paragraph, SENTENCE, ".\x01$1"), "\x01")
    return F.concat(ranked(F.array(paragraph), 0), ranked(sentences, 1), ranked(F.split(paragraph, "\n"), 2))


def _hopeful(terms: Column, model: Model) -> Column:
    """Whether some template's terms among these weigh enough for the threshold: so must those of any part that reaches it."""
    templates = F.expr(f"array({', '.join('array(' + ', '.join(f"struct('{t}' as t, {w!r}D as w)" for t, w in own.items()) + ')' for own in model.squares)})")
    present = F.array_intersect(terms, F.expr(f"array({', '.join(f"'{t}'" for t in sorted(model.idf))})"))
    least = model.least * model.least - 1e-6

    def enough(held: Column) -> Column:
        return F.exists(templates, lambda own: F.aggregate(own, F.lit(0.0), lambda a, x: a + F.when(F.array_contains(held, x["t"]), x["w"]).otherwise(0.0)) >= least)

    return F.exists(F.array(present), enough)


def notices(files: DataFrame, model: Model) -> DataFrame:
    """``files(path, text)`` to ``(path, license, score)``: the best score of each licence found in each file."""
    spark = files.sparkSession
    some = stored(files.where(_hopeful(_terms(F.col("text")), model)).select("path", F.xxhash64("text").alias("file"), "text"))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)
    parts = some.select("path", "file", F.posexplode(_paragraphs(F.col("text"))).alias("part", "paragraph"))
    parts = parts.where(_hopeful(_terms(F.col("paragraph")), model)).select("path", "file", "part", F.explode(_pieces(F.col("paragraph"))).alias("x")).select("path", "file", "part", "x.*")
    passages = parts.unionByName(some.where(named).select("path", "file", F.lit(-1).alias("part"), F.lit(0).alias("rank"), F.col("text").alias("passage")))
    passages = passages.withColumn("terms", _terms(F.col("passage"))).where(_hopeful(F.col("terms"), model))
    # Equal passages are scored once, however many files share them.
    passages = stored(passages.select("path", "file", "part", "rank", F.sha2("passage", 256).alias("unit"), "terms"))
    distinct = passages.select("unit", "terms").dropDuplicates(["unit"])
    counted = distinct.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n"))
    values = ", ".join(f"({i}, '{name}', '{t}', {w!r}D, {model.idf[t]!r}D)" for i, name, t, w in model.rows)
    vectors = spark.sql(f"select * from values {values} as v(template, license, term, weight, idf)")
    idf = broadcast_if_small(vectors.select("term", "idf").distinct(), BROADCAST_UNITS)
    weighed = stored(counted.join(idf, "term", "left").select("unit", "term", (F.col("n") * F.coalesce("idf", F.lit(model.unknown))).alias("x")))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(broadcast_if_small(vectors, BROADCAST_UNITS), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "unit").withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= model.least)
    nearest = scored.groupBy("unit").agg(F.max_by(F.struct("license", "score"), F.struct(F.round("score", 9), -F.col("template"))).alias("best"))
    # A passage that very many files share is no hot key while the passages with a licence are few.
    nearest = broadcast_if_small(stored(nearest.select("unit", "best.license", "best.score")), BROADCAST_UNITS)
    found = passages.drop("terms").join(nearest, "unit").groupBy("path", "file", "part").agg(F.min("rank").alias("least"), F.collect_set(F.struct("rank", "license", "score")).alias("all"))
    found = found.select("path", F.explode(F.filter("all", lambda x: x["rank"] == F.col("least"))).alias("x"))
    return found.groupBy("path", "x.license").agg(F.max("x.score").alias("score"))


def _names(licences: Column) -> Column:
    """A set of licences in writing, families left out beside their members."""
    kept = licences
    for family, members in FAMILIES.items():
        kept = F.when(F.exists(licences, lambda x: x.startswith(members)), F.array_remove(kept, family)).otherwise(kept)
    return F.array_join(F.array_sort(kept), ",")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, model: Model | None = None) -> DataFrame:
    """``files(path, text)`` to ``(path, own, score, inherited, license)``, one row per row.

    ``own``: the licences of the file's notices, comma-joined; ``score`` the best.  ``inherited``:
    those of the licence files in the nearest directory above (the root, "", included), unless the
    file has its own.  Null and empty texts have no notices; a null path neither notices nor
    directory.  Rows that share a path share their licences.  Other columns are ignored.
    """
    model = model or Model()
    found = sized(notices(files.where("path is not null"), model))
    own = found.groupBy("path").agg(_names(F.collect_set("license")).alias("own"), F.max("score").alias("score"))
    held = found.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)).select(_directory(F.col("path")).alias("above"), "license")
    held = sized(held.groupBy("above").agg(_names(F.collect_set("license")).alias("inherited")))
    directories = files.where("path is not null").select(_directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    # Path join: each directory with all directories above it; the deepest that holds a licence wins.
    above = directories.select("directory", F.explode(F.when(F.col("directory") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    above = above.withColumn("above", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(held, "above").groupBy("directory").agg(F.max_by("inherited", "depth").alias("inherited"))
    rows = files.select("path").withColumn("directory", _directory(F.col("path")))
    joined = rows.join(own, "path", "left").join(nearest, "directory", "left")
    inherited = F.when(F.col("own").isNull(), F.col("inherited"))
    return joined.select("path", F.coalesce("own", F.lit("")).alias("own"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), F.coalesce(inherited, F.lit("")).alias("inherited"), F.coalesce("own", inherited, F.lit("")).alias("license"))


#: Documents carry no path; the query lays them out by source and id, every eighth as a licence file, some of those one level up.
PATH = """concat(coalesce(source, ''), '/', doc_id div 2000, case when doc_id % 40 = 0 then '' else concat('/', doc_id div 400) end, case when doc_id % 8 = 0 then concat('/LICENSE-', doc_id) else concat('/', doc_id, '.txt') end)"""

_V = Model()
SQL = rf"""
WITH f AS (SELECT doc_id, text, concat(coalesce(source, ''), '/', doc_id // 2000, CASE WHEN doc_id % 40 = 0 THEN '' ELSE concat('/', doc_id // 400) END,
  CASE WHEN doc_id % 8 = 0 THEN concat('/LICENSE-', doc_id) ELSE concat('/', doc_id, '.txt') END) AS path FROM documents),
v(template, license, term, weight, idf) AS (VALUES {', '.join(f"({i}, '{n}', '{t}', CAST({w!r} AS DOUBLE), CAST({_V.idf[t]!r} AS DOUBLE))" for i, n, t, w in _V.rows)}),
l AS (SELECT path, doc_id, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '{OPENING}', ''), '{CLOSING}', '')) AS lines FROM f),
g AS (SELECT path, unnest(range(len(ps))) AS part, unnest(ps) AS p FROM (SELECT path, string_split(array_to_string(lines, chr(10)), chr(10) || chr(10)) AS ps FROM l)),
u AS (SELECT DISTINCT path, part, rank, passage FROM (
  SELECT path, part, 2 AS rank, unnest(string_split(p, chr(10))) AS passage FROM g
  UNION ALL SELECT path, part, 0, p FROM g
  UNION ALL SELECT path, part, 1, unnest(string_split(regexp_replace(p, '{SENTENCE}', '.' || chr(1) || '\1', 'g'), chr(1))) FROM g
  UNION ALL SELECT path, -1, 0, text FROM f WHERE doc_id % 8 = 0)),
q AS (SELECT DISTINCT passage FROM u),
t AS (SELECT passage, term, count(*) AS n FROM (SELECT passage, rtrim(unnest(regexp_extract_all(lower(passage), '{TERM}')), '{ENDS}') AS term FROM q) GROUP BY ALL),
x AS (SELECT passage, term, n * coalesce(idf, CAST({_V.unknown!r} AS DOUBLE)) AS x FROM t LEFT JOIN (SELECT DISTINCT term, idf FROM v) USING (term)),
nn AS (SELECT passage, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
dd AS (SELECT passage, template, license, sum(x * weight) AS dot FROM x JOIN v USING (term) GROUP BY ALL),
b AS (SELECT passage, license, dot / norm AS score, row_number() OVER (PARTITION BY passage ORDER BY round(dot / norm, 9) DESC, template) AS r FROM dd JOIN nn USING (passage) WHERE dot / norm >= {LEAST}),
h AS (SELECT path, license, score, rank, min(rank) OVER (PARTITION BY path, part) AS least FROM u JOIN b USING (passage) WHERE r = 1),
s AS (SELECT path, license, max(score) AS score FROM h WHERE rank = least GROUP BY ALL),
own AS (SELECT path, string_agg(license, ',' ORDER BY license) FILTER (license <> 'BSD' OR NOT has) AS own, max(score) AS score FROM (SELECT *, bool_or(starts_with(license, 'BSD-')) OVER (PARTITION BY path) AS has FROM s) GROUP BY path),
held AS (SELECT dir, string_agg(license, ',' ORDER BY license) FILTER (license <> 'BSD' OR NOT has) AS l FROM (SELECT *, bool_or(starts_with(license, 'BSD-')) OVER (PARTITION BY dir) AS has FROM (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license FROM s WHERE contains(path, '/LICENSE-'))) GROUP BY dir),
near AS (SELECT path, arg_max(l, length(dir)) AS l FROM f JOIN held ON starts_with(path, dir || '/') GROUP BY path)
SELECT doc_id, path, coalesce(own, '') AS own, round(coalesce(score, 0), 4) AS score, CASE WHEN own IS NULL THEN coalesce(l, '') ELSE '' END AS inherited, coalesce(own, l, '') AS license
FROM f LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""
