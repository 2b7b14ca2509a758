"""License scans: TF-IDF cosine of header lines and licence files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import needs, without, written

#: The notices that state a licence in a header, by licence.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "All-Rights-Reserved": ["All rights reserved."],
}
#: Whole licence texts by licence, in the folder beside this module; short ones are without the holder's line.
TEXTS = {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
#: Licences whose notice stands beside others' as well: they hold only where no other is stated, and make no licence file.
WEAK = ("All-Rights-Reserved",)
#: Cosines from which a run of lines is a licence header, and a whole text is a licence file.
HEADER, FILE = 0.75, 0.85
#: A licence file has at most so many times the words of the licence's text; longer ones bundle several.
LONGEST = 2
#: Lines of the longest run, and the share of its words that each line of a run of two or more has from the notices. A notice
#: wrapped over more than RUN lines is not seen as one.
RUN, SHARE = 8, 0.6

#: SQL: words of a lower-cased string: runs of letters and digits, with dots inside numbers.
WORDS = r"regexp_extract_all(lower({}), '[0-9]+([.][0-9]+)*|[\\p{{L}}\\p{{N}}]+', 0)"
TEXT = "coalesce(text, '')"
#: SQL: lines that hold a letter or digit.
LINES = r"filter(split(text, '\n'), l -> l rlike '[\\p{L}\\p{N}]')"


def quoted(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


class Model:
    """Templates as TF-IDF vectors of length 1; n files, df of them with a word of the templates.

    Notices come first, then whole texts; `licences` names each template's licence.
    """

    def __init__(self, notices: list[tuple[str, dict[str, int]]], texts: list[tuple[str, dict[str, int]]], df: dict[str, int], n: int):
        self.n, self.licences, self.notices = n, [name for name, _ in [*notices, *texts]], len(notices)
        self.lengths = [sum(counts.values()) for _, counts in [*notices, *texts]]
        self.vectors = []
        for _, counts in [*notices, *texts]:
            raw = {w: c * (math.log((1 + n) / (1 + df.get(w, 0))) + 1) for w, c in counts.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append({w: x / norm for w, x in raw.items()})
        self.vocabulary = sorted({w for v in self.vectors for w in v})

    def telling(self, header: float, whole: float) -> list[str]:
        """Words of which a text must hold one to reach its threshold with any template: by Cauchy's inequality
        the words shared with a template must have squared weights of at least the threshold's square."""
        out = set()
        for k, v in enumerate(self.vectors):
            least, rest = min(header, whole) if k < self.notices else whole, 0.0
            for w, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
                rest += x * x
                if rest >= least * least - 1e-9:
                    out.add(w)
        return sorted(out)

    def table(self, spark) -> DataFrame:
        """(word, weights): for each word of the templates its weight in each; one literal, as large as the parameter."""
        rows = [{"word": w, "weights": [v.get(w, 0.0) for v in self.vectors]} for w in self.vocabulary]
        return literal(spark, rows, "word string, weights array<double>")


def literal(spark, rows: list[dict], schema: str) -> DataFrame:
    """A parameter as a table of one literal; never data."""
    kind = f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("t")).select("t.*")


def template_words(spark, templates: dict[str, list[str]]) -> list[tuple[str, dict[str, int]]]:
    """(licence, words with counts) of each template; words are those that the files' lines have."""
    rows = [{"licence": name, "k": k, "text": text} for name, texts in templates.items() for k, text in enumerate(texts)]
    if not rows:
        return []
    words = literal(spark, rows, "licence string, k int, text string").select("licence", "k", F.explode(F.expr(WORDS.format("text"))).alias("word"))
    out: dict[tuple[str, int], dict[str, int]] = {}
    for r in words.groupBy("licence", "k", "word").count().orderBy("licence", "k", "word").collect():
        out.setdefault((r.licence, r.k), {})[r.word] = r["count"]
    return [(name, v) for (name, _), v in out.items()]


def document_frequencies(files: DataFrame) -> DataFrame:
    """(word, df): in how many files each word occurs, whatever word it is; '' counts the files. Written."""
    words = files.select(F.explode(F.expr(f"array_append(array_distinct({WORDS.format(TEXT)}), '')")).alias("word"))
    return written(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")))


def pieces(near: DataFrame, vocabulary: list[str], telling: list[str]) -> DataFrame:
    """(path, _row, piece, words): whole texts (piece -1) and runs of lines of the files `near` (path, _row, text).

    A run is one line that holds a telling word, or two to RUN consecutive ones of which one does and each has
    at least SHARE of its words from the vocabulary, that of the notices, as the lines of a wrapped notice have. Lines are rows
    before runs are made, and only those that a run can have are kept; a run is a row.
    """
    known, told = quoted(vocabulary), quoted(telling)
    lines = near.select("path", "_row", F.posexplode(F.expr(LINES)).alias("line", "l")).select("path", "_row", "line", F.expr(WORDS.format("l")).alias("w"))
    flags = lines.withColumns({"told": F.expr(f"arrays_overlap(w, {told})"), "dense": F.expr(f"size(filter(w, x -> array_contains({known}, x))) >= {SHARE}D * size(w)")}).where("told or dense")
    ahead = f"collect_list(struct(line as line, w as w, told as told, dense as dense)) over (partition by path, _row order by line rows between current row and {RUN - 1} following)"
    run = "slice(x, 1, k)"
    whole = f"exists({run}, y -> y.told) and (k = 1 or forall({run}, y -> y.dense) and x[k - 1].line = line + k - 1)"
    each = flags.withColumn("x", F.expr(ahead)).withColumn("k", F.explode(F.expr(f"filter(sequence(1, size(x)), k -> {whole})")))
    runs = each.select("path", "_row", (F.col("line") * RUN + F.col("k") - 1).cast("long").alias("piece"), F.expr(f"flatten(transform({run}, y -> y.w))").alias("words"))
    return near.select("path", "_row", F.lit(-1).cast("long").alias("piece"), F.expr(WORDS.format("text")).alias("words")).union(runs)


def scanned(files: DataFrame, notices: dict[str, list[str]], texts: dict[str, list[str]], header: float, whole: float) -> DataFrame:
    """(path, _row, licence, score, is_file) of the files that state a licence themselves."""
    spark = files.sparkSession
    keyed = files.select("path", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), F.col("text"))
    frequency = document_frequencies(files)
    vectors = template_words(spark, notices), template_words(spark, texts)
    vocabulary = sorted({w for part in vectors for _, v in part for w in v})
    df = {r.word: r.df for r in frequency.where(F.col("word").isin(["", *vocabulary])).collect()}
    model = Model(*vectors, df, df.get("", 0))
    telling = model.telling(header, whole)
    near = keyed.where(F.expr(f"arrays_overlap({WORDS.format('text')}, {quoted(telling)})"))
    # Rows equal in path and text are one file.
    near = written(near.groupBy("path", "_row").agg(F.first("text").alias("text")))
    found = written(pieces(near, sorted({w for _, v in vectors[0] for w in v}), telling).where(F.size("words") > 0).withColumn("id", F.xxhash64("path", "piece")))
    counted = found.select("_row", "id", F.explode("words").alias("word")).groupBy("_row", "id", "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = frequency.select("word", (F.log((1 + F.lit(model.n)) / (1 + F.col("df"))) + 1).alias("idf"))
    # The templates are a parameter, so their table may be broadcast.
    weighed = counted.join(idf, "word").join(F.broadcast(model.table(spark)), "word", "left").withColumn("x", F.col("tf") * F.col("idf"))
    dots = [F.sum(F.expr(f"coalesce(x * weights[{k}], 0D)")).alias(f"d{k}") for k in range(len(model.licences))]
    sums = weighed.groupBy("_row", "id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    scores = ", ".join(f"struct(round(d{k} / norm, 9) as score, {k} as template, '{n}' as licence, {'true' if n in WEAK else 'false'} as weak, {model.lengths[k] if k >= model.notices else 'null'} as length)" for k, n in enumerate(model.licences))
    scored = found.select("path", "_row", "piece", "id", F.size("words").alias("n")).join(sums, ["_row", "id"]).select("path", "_row", "piece", "n", F.expr(f"array({scores})").alias("s"))
    # Runs of lines are compared to notices, whole texts to all templates.
    stated = f"filter(s, x -> case when piece < 0 then x.score >= {whole!r} and coalesce(n <= {LONGEST} * x.length, true) else x.template < {model.notices} and x.score >= {header!r} end)"
    each = scored.select("path", "_row", "piece", F.explode(F.expr(stated)).alias("s"))
    whole_first = F.expr("struct(not s.weak as strong, piece < 0 as is_file, s.score as score, s.licence as licence)")
    top = each.groupBy("path", "_row").agg(F.max(whole_first).alias("s"))
    return top.select("path", "_row", "s.licence", "s.score", F.expr("s.is_file and s.strong").alias("is_file"))


def directory(path: str) -> str:
    """SQL: the directory of a path, without the last slash; '' for the root."""
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def licences(files: DataFrame, notices: dict[str, list[str]] | None = None, texts: dict[str, list[str]] | None = None, header: float = HEADER, whole: float = FILE) -> DataFrame:
    """files (path, text, ...) with licence, how ('header', 'inherited' or 'none'), score and licence_path.

    A file whose whole text has a TF-IDF cosine of `whole` or more to a notice, or to a licence text of at least half its
    words, is a licence file and states that licence. Any other file states a licence if a run of at most RUN of its lines (see `pieces`) has one of
    `header` or more to a notice. A whole text decides before runs, of several the best score holds, of equal ones the
    licence that sorts last; the licences in WEAK hold only if no other is stated. Every file without a statement
    takes the licence of the nearest directory upwards, its own first, that has a licence file; of several there
    the best score, then the smallest path.

    Each word weighs by the share of all files that hold it, so equal shares give equal verdicts at every size. A null,
    empty or wordless text states nothing but inherits; a null path is a file in no directory; a text of any
    length is taken whole. Rows equal in path and text are one file, and each stays a row; an empty table stays
    empty; columns of files with the names of outputs are replaced. Only built-in functions.
    """
    needs(files, "path", "text")
    added = ["licence", "how", "score", "licence_path"]
    files = without(files, [*added, "_ps_row", "_ps_dir", "_ps_path", "_ps_hash", "_ps_own", "_ps_own_score"])
    stated = written(scanned(files, NOTICES if notices is None else notices, TEXTS if texts is None else texts, header, whole))
    sources = stated.where("is_file and path is not null").select(F.expr(directory("path")).alias("dir"), "licence", "score", "path")
    order = F.struct(-F.col("score"), F.col("path"))
    sources = sources.groupBy("dir").agg(F.min_by("licence", order).alias("licence"), F.max("score").alias("score"), F.min_by("path", order).alias("licence_path"))
    # Directories, each once, with all of their ancestors; the deepest that has a licence is the nearest.
    dirs = files.where("path is not null").select(F.expr(directory("path")).alias("_ps_dir")).distinct()
    parts = "split(_ps_dir, '/')"
    above = dirs.select("_ps_dir", F.explode(F.expr(f"transform(sequence(0, if(_ps_dir = '', 0, size({parts}))), k -> array_join(slice({parts}, 1, k), '/'))")).alias("dir"))
    met = above.join(sources, "dir")
    # Written, so that a directory with a great share of the files can be split where they meet.
    near = written(met.groupBy("_ps_dir").agg(*[F.max_by(c, F.length("dir")).alias(f"_ps_near_{c}") for c in ("licence", "score", "licence_path")]))
    own = stated.select(F.col("path").alias("_ps_path"), F.col("_row").alias("_ps_hash"), F.col("licence").alias("_ps_own"), F.col("score").alias("_ps_own_score")).hint("shuffle_hash")
    keyed = files.withColumn("_ps_row", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_ps_dir", F.expr(directory("path")))
    both = keyed.join(own, F.col("path").eqNullSafe(F.col("_ps_path")) & (F.col("_ps_row") == F.col("_ps_hash")), "left").join(near, "_ps_dir", "left")
    return both.select(
        *[F.col(f"`{c}`") for c in files.columns],
        F.coalesce("_ps_own", "_ps_near_licence").alias("licence"),
        F.expr("case when _ps_own is not null then 'header' when _ps_near_licence is not null then 'inherited' else 'none' end").alias("how"),
        F.coalesce("_ps_own_score", "_ps_near_score").alias("score"),
        F.expr("case when _ps_own is not null then path else _ps_near_licence_path end").alias("licence_path"),
    )
