"""Licences of files: statements matched to templates, and inherited from the nearest directory.

Every line is compared with short licence notices by the cosine of sparse TF-IDF vectors. A licence file
speaks for its directory, and a file without a statement of its own has the licence of its nearest ancestor
directory that has one. Everything is made of built-in column functions, aggregates and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.tables import OWN
from tickloom.session import written_once

# SPDX licence names with the notices that commonly state them.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LicenseRef-Reserved", "All rights reserved"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "Released into the public domain by the Unlicense"),
)

#: Cosine from which a line states a licence.
COSINE = 0.7
SEPARATORS = "[^a-z0-9]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def _template_words(notice: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in notice.lower()).split()


def inverse_frequencies(files: DataFrame, text_col: str) -> tuple[DataFrame, float]:
    """``word, idf`` of every word of the texts, and the IDF of a word that no text has."""
    counts = files.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("word")).groupBy(
        "word").agg(F.count(F.lit(1)).alias("n"))
    size = files.count()
    idf = F.log(F.lit(float(size + 1)) / (F.col("n") + 1)) + 1
    return written_once(counts.select("word", idf.alias("idf"))), math.log(size + 1) + 1


def template_vectors(
    counted: DataFrame, absent_idf: float, templates: tuple
) -> dict[str, dict[str, float]]:
    """The templates' vectors of length one."""
    vocabulary = sorted({w for _, notice in templates for w in _template_words(notice)})
    known = {r["word"]: r["idf"] for r in counted.where(F.col("word").isin(vocabulary)).collect()}
    vectors = {}
    for name, notice in templates:
        words = _template_words(notice)
        raw = {w: words.count(w) * known.get(w, absent_idf) for w in words}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors[name] = {w: v / norm for w, v in raw.items()}
    return vectors


def anchors(vectors: dict[str, dict[str, float]], cosine: float) -> list[str]:
    """Words of which a line must have one to reach the cosine with any template.

    Of each template, its heaviest words, until the rest of its vector is shorter than the cosine.
    """
    chosen = set()
    for vector in vectors.values():
        rest = 1.0
        for word, weight in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
            if rest < cosine * cosine * (1 - 1e-9):
                break
            chosen.add(word)
            rest -= weight * weight
    return sorted(chosen)


def statements(
    lines: DataFrame, counted: DataFrame, vectors: dict[str, dict[str, float]], cosine: float,
) -> DataFrame:
    """Of the distinct lines (``line``), those that state a licence: ``line, license, score``.

    ``counted`` has the IDF of every word of the lines.
    """
    terms = lines.select("line", F.explode(words_of(F.col("line"))).alias("word")).groupBy(
        "line", "word").agg(F.count(F.lit(1)).alias("n"))
    weighed = terms.join(counted, "word").withColumn("v", F.col("n") * F.col("idf"))
    products = [
        F.sum(F.col("v") * F.coalesce(F.create_map(
            *[F.lit(x) for pair in sorted(vector.items()) for x in pair])[F.col("word")],
            F.lit(0.0))).alias(name)
        for name, vector in sorted(vectors.items())]
    scored = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"), *products)
    # The largest cosine; of equal ones the first name, since names are negated by their place.
    best = F.array_max(F.array(*[
        F.struct((F.col(f"`{name}`") / F.col("norm")).alias("score"), F.lit(-i).alias("place"),
                 F.lit(name).alias("license")) for i, name in enumerate(sorted(vectors))]))
    found = scored.select("line", best.alias("b")).select("line", "b.license", "b.score")
    return found.where(F.col("score") >= cosine)


def scan_licenses(
    files: DataFrame, path_col: str, text_col: str = "text", licence_file: Column | None = None,
    templates: tuple = TEMPLATES, cosine: float = COSINE,
) -> DataFrame:
    """Adds ``own_license, own_score, own_line, license, license_dir`` to files with paths.

    ``own_license`` is that of the line closest to a template, the first of equals, if any reaches the
    cosine, and ``own_line`` its place from 0. ``licence_file`` says, for a file with a licence of its own,
    whether it speaks for its directory; by default, files named like licences do. Of several in a
    directory, the first by path does, then by licence. It may name ``own_line``. ``license`` is the file's own or else that of the
    nearest ancestor directory with one, named in ``license_dir``; null if there is none. Null or empty texts
    state nothing; a null path has no directory, and a path without a slash is in the directory ``""``.
    Repeated rows are treated alike; no rows give no rows. Input columns with the names of the new ones
    are replaced.
    """
    new = ("own_license", "own_score", "own_line", "license", "license_dir")
    row, folder, path, text = (f"{OWN}{c}" for c in ("row", "dir", "path", "text"))
    kept = [c for c in files.columns if c not in new]
    if licence_file is None:
        licence_file = F.lower(F.element_at(F.split(F.col(path_col), "/"), -1)).rlike(
            r"^(licen[cs]e|copying|notice|unlicense)([.-].*)?$")
    named = files.select(
        *kept, F.monotonically_increasing_id().alias(row), F.col(path_col).alias(path),
        F.regexp_replace(F.regexp_replace(F.col(path_col), "[^/]*$", ""), "/+$", "").alias(folder))
    lined = named.select(row, F.col(text_col).cast("string").alias(text))
    counted, absent_idf = inverse_frequencies(lined, text)
    vectors = template_vectors(counted, absent_idf, templates)
    pattern = rf"(?i)(^|[^a-z0-9])({'|'.join(anchors(vectors, cosine))})($|[^a-z0-9])"
    lines = written_once(lined.where(F.col(text).rlike(pattern)).select(
        row, F.posexplode(F.split(text, "\n")).alias("place", "line")).where(
        F.col("line").rlike(pattern)))
    # Distinct lines are counted before they move, so a line that many files have is compared once.
    stated = statements(lines.select("line").distinct(), counted, vectors, cosine)
    own = lines.join(stated, "line").groupBy(row).agg(F.max(F.struct(
        "score", (-F.col("place")).alias("place"), "license")).alias("best")).select(
        F.col(row).alias(f"{OWN}at"), F.col("best.license").alias("own_license"),
        F.col("best.score").alias("own_score"), (-F.col("best.place")).alias("own_line"))
    placed = named.join(own, F.col(row) == F.col(f"{OWN}at"), "left")
    speaking = placed.where(F.col("own_license").isNotNull() & F.col(folder).isNotNull()) \
        .where(licence_file)
    governed = speaking.groupBy(F.col(folder).alias("ancestor")).agg(
        F.min(F.struct(path, "own_license")).alias("first")).select(
        "ancestor", F.col("first.own_license").alias("license"))
    parts = F.split(folder, "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor")))
    above = placed.select(folder).where(F.col(folder).isNotNull()).distinct().select(
        folder, F.explode(up).alias("a")).select(folder, "a.depth", "a.ancestor")
    nearest = above.join(governed, "ancestor").groupBy(F.col(folder).alias(f"{OWN}of")).agg(
        F.max(F.struct("depth", "ancestor", "license")).alias("near"))
    joined = placed.join(nearest, F.col(folder) == F.col(f"{OWN}of"), "left")
    return joined.select(
        *kept, "own_license", "own_score", "own_line",
        F.coalesce("own_license", "near.license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.ancestor")).alias("license_dir"))
