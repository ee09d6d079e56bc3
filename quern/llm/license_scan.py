r"""License scans with DataFrame functions: a trained classifier of paragraphs.

Paragraphs end at blank lines, which have no letter or digit. Notices are looked for in each
line and, as they may be wrapped, in each paragraph's words across its lines: in windows of
``WIDE`` words, every ``WIDE / 2``, so that any run of half as many words is whole in one.
Of lines and windows with a word of ``GATE``, which every text that can be confirmed has one
of, word 1- to 3-grams of the templates' vocabulary are looked up, and a softmax regression over
them gives each family's chance, with a class ``unknown`` and a temperature that calibrates
the chances. A family other than unknown with a chance of ``CHANCE`` or more is confirmed
if one of the family's templates has ``CONFIRM`` of its word pairs in the line or window.
A family that windows of a paragraph show and none of its lines counts there once; a line
whose matched pairs are all in the template of another family that a window shows is a piece
of that notice and does not count.

The regression is fitted here, on paragraphs generated from the templates (words lost,
words around) and from sentences that merely use their words; no table is read for it.
Weights, vocabulary and templates are constants of the expression, of a size that
the templates fix. Scanning is one narrow pass of built-in functions, without a
shuffle, and only lines and windows with a word of ``GATE`` are scored.

Defined results: a null text counts as empty; texts, lines and paragraphs of any length are read
whole; no paragraph gives family ``none``; of several families the one of the most confirmed
lines and paragraphs counts, then the first by name; repeated rows give equal rows; an empty
table gives no row; other columns, whatever their names, are ignored. A licence outside these
families, and a notice that holds less than ``CONFIRM`` of all templates, is not found.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import documents

CHANCE, CONFIRM = 0.5, 0.6
#: Words of a window; the longest template has less than half as many.
WIDE = 64

#: Notices of public licences, by family; digits read as 0 (fixed values).
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license version 0", "this program is free software under the gnu affero general public license", "spdx license identifier agpl 0"),
    "apache": ("licensed under the apache license version 0.0", "released under the apache license 0.0", "you may not use this file except in compliance with the license", "spdx license identifier apache 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "licensed under the 0 clause bsd license", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "spdx license identifier bsd 0 clause"),
    "cc0": ("to the extent possible under law the author has waived all copyright", "released under cc0 0.0 universal public domain dedication", "spdx license identifier cc0 0"),
    "cc_by": ("licensed under cc by 0.0", "licensed under a creative commons attribution 0.0 international license", "spdx license identifier cc by 0"),
    "cc_by_nc": ("licensed under cc by nc 0.0", "licensed under a creative commons attribution noncommercial 0.0 international license", "spdx license identifier cc by nc 0"),
    "cc_by_sa": ("licensed under cc by sa 0.0", "licensed under a creative commons attribution sharealike 0.0 international license", "spdx license identifier cc by sa 0"),
    "epl": ("licensed under the eclipse public license version 0.0", "made available under the terms of the eclipse public license v 0.0", "spdx license identifier epl 0"),
    "gpl": ("this work is licensed under the gnu general public license version 0", "you can redistribute it and or modify it under the terms of the gnu general public license", "released under the gnu general public license", "spdx license identifier gpl 0"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "spdx license identifier isc license"),
    "lgpl": ("licensed under the gnu lesser general public license version 0", "under the terms of the gnu lesser general public license", "spdx license identifier lgpl 0"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit license"),
    "mpl": ("subject to the terms of the mozilla public license v 0.0", "licensed under the mozilla public license version 0.0", "spdx license identifier mpl 0"),
    "proprietary": ("all rights reserved", "copyright 0 all rights reserved no part may be reproduced without permission"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx license identifier unlicense license"),
}
FAMILIES = ("unknown", *sorted(TEMPLATES))
_OTHER = ("the driver lost his license last week", "with your permission we will start", "copyright law was debated in court", "a poetic licence of the author", "the fishing license costs 0 euros", "he asked for permission to leave", "the license plate of the car", "they were permitted to enter", "license fees rose by 0 percent", "the general public was not permitted inside", "version 0.0 of the report was released under pressure")
_AROUND = "the of and a in to was that he it for on as with his at by this from they she which or we an there were their been has when who will more no if out so what up said about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state".split()

_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[a-z0-9]+")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(_DIGITS.sub("0", paragraph.lower()))


#: Words of templates that are too frequent elsewhere to select by, if there are others.
_PLAIN = frozenset("all author be code charge conditions copy file following free general in is it law may mit part public software terms under use version without work".split())


def gate() -> list[str]:
    """Words of which any text with ``CONFIRM`` of some template's word pairs has one.

    Pairs without such a word are fewer than the pairs that confirm, for each template.
    """
    every, out = [words_of(t) for ts in TEMPLATES.values() for t in ts], set()
    for words in sorted(every, key=len):
        pairs = set(zip(words, words[1:], strict=False))
        while len(left := [x for x in pairs if out.isdisjoint(x)]) >= (len(words) - 1) * CONFIRM:
            some = sorted({w for x in left for w in x if w.isalpha() and w not in _AROUND})
            out.add(max(some, key=lambda w: (w not in _PLAIN, sum(w in x for x in left), sum(w in e for e in every), len(w))))
    return sorted(out)


GATE = gate()


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _paragraphs(seed: int, each: int):
    """Generated (words, class) for fitting and calibrating."""
    rng = np.random.default_rng(seed)
    some = lambda n: [_AROUND[int(k)] for k in rng.integers(len(_AROUND), size=int(rng.integers(n)))]
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES.get(family, _OTHER):
            for _ in range(each):
                words = [w for w in words_of(t) if rng.random() > 0.08]
                yield [*some(6), *words, *some(6)], k
    for _ in range(10 * each):
        yield some(20), 0


def fit(seed: int = 3, each: int = 20, steps: int = 250, ridge: float = 1e-3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Vocabulary, weights (class by gram) and constants, divided by the temperature."""
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t))})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(seed):
        rows = list(_paragraphs(seed, each))
        x = np.zeros((len(rows), len(vocabulary)))
        for r, (words, _) in enumerate(rows):
            x[r, [at[g] for g in grams(words) if g in at]] = 1
        return x, np.array([k for _, k in rows])

    def chances(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(seed)
    w, b, want = np.zeros((len(FAMILIES), len(vocabulary))), np.zeros(len(FAMILIES)), np.eye(len(FAMILIES))[y]
    for _ in range(steps):
        d = (want - chances(x @ w.T + b)) / len(x)
        w += 4.0 * (d.T @ x - ridge * w)
        b += 4.0 * d.sum(0)
    x, y = matrix(seed + 1)
    z = x @ w.T + b
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(np.maximum(chances(z / t)[np.arange(len(y)), y], 1e-12)).sum())
    return vocabulary, np.round(w / heat, 4), np.round(b / heat, 4)


def _constant(values, kind: str) -> Column:
    """An array constant, which the optimiser folds from one string."""
    joined = F.split(F.lit("|".join(map(str, values))), r"\|")
    return joined if kind == "string" else joined.cast(f"array<{kind}>")


def scan(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, license, n_paragraphs, n_confirmed, families, chance.

    ``n_paragraphs`` are the lines with a word of ``GATE``; ``n_confirmed`` are lines, and
    families of paragraphs that windows only show; ``families`` are those confirmed, in order
    of the text's paragraphs; ``chance`` is the greatest chance of those, 0 without any.
    """
    vocabulary, w, b = model
    many = len(vocabulary)
    terms, weights, constants, names = _constant(vocabulary, "string"), _constant(w.ravel(), "double"), _constant(b, "double"), _constant(FAMILIES, "string")
    pairs = lambda words: [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
    templates = F.array(*[F.struct(F.lit(k).alias("of"), _constant(pairs(words_of(t)), "string").alias("pairs")) for k, f in enumerate(FAMILIES) for t in TEMPLATES.get(f, ())])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"))
    gated = r"(?i)(?<![a-z0-9])(?:" + "|".join(GATE) + ")(?![a-z0-9])"
    words = lambda p: F.regexp_extract_all(F.regexp_replace(F.lower(p), "[0-9]+", "0"), F.lit("[a-z0-9]+"), F.lit(0))
    none = F.array().cast("array<string>")
    # a paragraph, then units: its number, whether a window, words
    parts = F.filter(F.split("body", r"\n(?:[^A-Za-z0-9\n]*\n)+"), lambda p: p.rlike(gated))
    rows = rows.select("doc_id", F.when(F.col("body").rlike(gated), parts).otherwise(none).alias("parts"))
    rows = rows.select("doc_id", F.transform("parts", lambda p: F.struct(F.filter(F.split(p, "\n"), lambda x: x.rlike(gated)).alias("lines"), F.when(p.contains("\n"), words(p)).otherwise(none).alias("all"))).alias("parts"))
    starts = lambda v: F.sequence(F.lit(0), F.greatest(F.ceil((F.size(v) - WIDE) / F.lit(WIDE / 2)), F.lit(0)).cast("int"))
    windows = lambda v: F.filter(F.transform(starts(v), lambda i: F.slice(v, i * (WIDE // 2) + 1, WIDE)), lambda x: F.arrays_overlap(x, _constant(GATE, "string")))
    unit = lambda at, wide, v: F.struct(at.alias("part"), F.lit(wide).alias("wide"), v.alias("words"))
    units = F.flatten(F.transform("parts", lambda p, at: F.concat(F.transform(p["lines"], lambda x: unit(at, False, words(x))), F.transform(windows(p["all"]), lambda x: unit(at, True, x)))))
    rows = rows.select("doc_id", units.alias("words"))

    def run(v, n):
        many = F.size(v) - (n - 1)
        some = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.array_join(F.slice(v, i, n), " "))
        return F.when(many > 0, some).otherwise(F.array().cast("array<string>"))

    rows = rows.select("doc_id", F.transform("words", lambda u: F.struct(u["part"].alias("part"), u["wide"].alias("wide"), F.array_distinct(F.concat(u["words"], run(u["words"], 2), run(u["words"], 3))).alias("grams"), F.array_distinct(run(u["words"], 2)).alias("pairs"))).alias("p"))
    known = lambda g: F.filter(F.transform(g, lambda x: F.array_position(terms, x)), lambda i: i > 0)
    rows = rows.select("doc_id", F.transform("p", lambda x: F.struct(known(x["grams"]).alias("at"), x["pairs"].alias("pairs"), x["part"].alias("part"), x["wide"].alias("wide"))).alias("p"))
    zero = F.lit(0.0)
    logit = lambda at: F.transform(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1)), lambda k: F.aggregate(at, F.get(constants, k), lambda a, i: a + F.get(weights, (k * many + i - 1).cast("int"))))
    rows = rows.select("doc_id", F.transform("p", lambda x: F.struct(logit(x["at"]).alias("z"), x["pairs"].alias("pairs"), x["part"].alias("part"), x["wide"].alias("wide"))).alias("p"))
    rows = rows.select("doc_id", F.transform("p", lambda x: F.struct(F.array_max(x["z"]).alias("top"), x["z"].alias("z"), x["pairs"].alias("pairs"), x["part"].alias("part"), x["wide"].alias("wide"))).alias("p"))
    total = lambda x: F.aggregate(x["z"], zero, lambda a, z: a + F.exp(z - x["top"]))
    rows = rows.select("doc_id", F.transform("p", lambda x: F.struct((F.array_position(x["z"], x["top"]) - 1).cast("int").alias("of"), (F.lit(1.0) / total(x)).alias("chance"), x["pairs"].alias("pairs"), x["part"].alias("part"), x["wide"].alias("wide"))).alias("p"))
    alike = lambda x: F.exists(templates, lambda t: (t["of"] == x["of"]) & (F.size(F.array_intersect(t["pairs"], x["pairs"])) >= F.size(t["pairs"]) * CONFIRM))
    sure = F.filter("p", lambda x: (x["of"] > 0) & (x["chance"] >= CHANCE) & alike(x))
    rows = rows.select("doc_id", F.size(F.filter("p", lambda x: ~x["wide"])).cast("long").alias("n_paragraphs"), F.transform(sure, lambda x: F.struct(F.get(names, x["of"]).alias("family"), x["chance"].alias("chance"), x["part"].alias("part"), x["wide"].alias("wide"), x["of"].alias("of"), x["pairs"].alias("pairs"))).alias("sure"))
    # a line that is a piece of the notice of another family that a window shows is no notice of its own
    within = lambda t, x, y: F.exists(templates, lambda u: (u["of"] == y["of"]) & (F.size(F.array_except(F.array_intersect(t["pairs"], x["pairs"]), u["pairs"])) == 0))
    own = lambda x, y: F.exists(templates, lambda t: (t["of"] == x["of"]) & (F.size(F.array_intersect(t["pairs"], x["pairs"])) >= F.size(t["pairs"]) * CONFIRM) & ~within(t, x, y))
    piece = lambda x: F.exists("sure", lambda y: y["wide"] & (y["part"] == x["part"]) & (y["of"] != x["of"]) & ~own(x, y))
    rows = rows.withColumn("sure", F.when(F.size("sure") > 1, F.filter("sure", lambda x: x["wide"] | ~piece(x))).otherwise(F.col("sure")))
    # of a paragraph's windows the first of a family that no line shows
    first = F.filter("sure", lambda x, i: ~x["wide"] | ~F.exists(F.slice("sure", 1, i), lambda y: (y["part"] == x["part"]) & (y["family"] == x["family"])))
    rows = rows.select("doc_id", "n_paragraphs", first.alias("found"))
    found = F.transform("found", lambda x: x["family"])
    rows = rows.select("doc_id", "n_paragraphs", "found", F.array_distinct(found).alias("kinds"))
    votes = F.transform("kinds", lambda k: F.struct(F.size(F.filter("found", lambda x: x["family"] == k)).alias("n"), k.alias("family")))
    best = F.array_sort(votes, lambda x, y: F.when(x["n"] != y["n"], y["n"] - x["n"]).when(x["family"] < y["family"], -1).when(x["family"] > y["family"], 1).otherwise(0))
    return rows.select("doc_id", F.coalesce(F.get(best, F.lit(0))["family"], F.lit("none")).alias("license"), "n_paragraphs", F.size("found").cast("long").alias("n_confirmed"), F.array_join("kinds", ",").alias("families"), F.round(F.coalesce(F.array_max(F.transform("found", lambda x: x["chance"])), F.lit(0.0)), 6).alias("chance"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), fit())
