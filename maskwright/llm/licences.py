"""Licence recognition by sentences.

A text's sentences are normalised (lower case, letters and digits only, one space) and those that are known licence sentences
become identifiers, in the order of the text; this sequence is matched against licence rules, longest first, and what a rule
has used is used up. So a licence is told from another that shares sentences with it by which sentences stand together: between
two of a rule's sentences at most ``most_gap`` other words may stand (an address, a heading, a sentence not known).

Plan, DataFrame functions only: one regular expression decides which texts can hold a licence sentence at all (every known
sentence has one of its words); only those are cut into sentences. A known sentence that holds a cut itself is met as a run of
as many parts. Identifiers come from an equi-join with the dictionary, which is broadcast when measured to be small. Rows are
numbered, so repeated rows stay apart; only identifiers are shuffled, never texts. A line that stands in a third of all documents is a dictionary hit in the scan and meets nobody.

Null or empty text: no sentence, no licence. Null doc_id: as any other. Repeated rows: each by itself. Of known sentences that
overlap, the one that begins first counts, of these the longest, of these the first by identifier. Empty table: empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.workspace import bounded_broadcast, stage

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "AllRights": ["All rights reserved."],
    "MITNote": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License."],
    "MITGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MITNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MITWarranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "ISCGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSDGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSDSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSDBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSDEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ApacheNote": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "ApacheUse": ["you may not use this file except in compliance with the License."],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "ApacheBasis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL3Note": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3."],
    "GPL2Note": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPL3Later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL2Later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPLNoWarranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "LGPLNote": ["Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "MPLNote": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CCBYNCNote": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CCBYNote": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CCBYSANote": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0Note": ["Released under CC0 1.0, without copyright."],
    "UnlicenseNote": ["This is free and unencumbered software released into the public domain."],
}

#: Licences as sequences of sentence identifiers; of two as long that fit at one place the earlier here wins.
RULES = [
    ("MIT", ["MITGrant", "MITNotice", "MITWarranty"]),
    ("Apache-2.0", ["ApacheNote", "ApacheUse", "ApacheCopy", "ApacheBasis"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("GPL-3.0-or-later", ["GPL3Later", "GPLNoWarranty"]),
    ("GPL-2.0-or-later", ["GPL2Later", "GPLNoWarranty"]),
    ("GPL-3.0-or-later", ["GPL3Later"]),
    ("GPL-2.0-or-later", ["GPL2Later"]),
    ("ISC", ["ISCGrant"]),
    ("Apache-2.0", ["ApacheNote"]),
    ("MIT", ["MITNote"]),
    ("GPL-3.0-only", ["GPL3Note"]),
    ("GPL-2.0-only", ["GPL2Note"]),
    ("LGPL-3.0-only", ["LGPLNote"]),
    ("MPL-2.0", ["MPLNote"]),
    ("CC-BY-NC-4.0", ["CCBYNCNote"]),
    ("CC-BY-4.0", ["CCBYNote"]),
    ("CC-BY-SA-4.0", ["CCBYSANote"]),
    ("CC0-1.0", ["CC0Note"]),
    ("Unlicense", ["UnlicenseNote"]),
    ("All-rights-reserved", ["AllRights"]),
]
#: Every known sentence has one of these words.
_HINTS = ("licen", "rights", "permission", "copyright", "redistribut", "public domain", "express", "required by")
#: Where a sentence ends, in a text and in the dictionary alike.
_STOP = r"(?<=[.!?;:])[\"')\]]*\s+"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _hint() -> str:
    known = [normalise(x) for xs in SENTENCES.values() for x in xs]
    odd = [x for x in known if not any(h in x for h in _HINTS) and "warranty" not in x]
    if odd:
        raise ValueError(f"no hint word in: {odd}")
    return "(?i)" + "|".join(h.replace(" ", "[^a-z0-9]+") for h in (*_HINTS, "warranty"))


def parts_of(sentence: str) -> int:
    """The number of parts into which a text's sentences are cut where this one stands."""
    return sum(1 for x in re.split(_STOP, sentence) if normalise(x))


def dictionary(spark: SparkSession, sentences: dict[str, list[str]] | None = None) -> DataFrame:
    """sentence (normalised), identifier."""
    return spark.createDataFrame(sorted({(normalise(x), k) for k, xs in (sentences or SENTENCES).items() for x in xs}), "sentence string, identifier string")


def _normal(part: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(part), "[^a-z0-9]+", " "))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _bound(make, *values: Column) -> Column:
    """``make`` of values that are computed once each, however often it uses them."""
    names = [f"v{k}" for k in range(len(values))]
    return F.transform(F.array(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])), lambda x: make(*[x[n] for n in names]))[0]


def before(sizes: Column) -> Column:
    """For each place of ``sizes``, and the one past its end, the sum of what stands before. Sums are made over groups of about
    the square root of all, so n places cost n**1.5 steps."""

    def by_groups(own: Column, k: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / k).cast("int")), lambda j: _sum(F.slice(own, j * k + 1, k)))
        starts = lambda g: F.transform(g, lambda _, j: _sum(F.slice(g, F.lit(1), j)))
        at = lambda g: F.transform(own, lambda _, i: F.get(g, F.floor(i / k).cast("int")) + _sum(F.slice(own, F.floor(i / k).cast("int") * k + 1, F.pmod(i, k))))
        return _bound(lambda g: _bound(at, starts(g)), groups)

    every = F.concat(sizes, F.array(F.lit(0)))
    return _bound(by_groups, every, F.ceil(F.sqrt(F.size(every))).cast("int"))


def _words(part: Column) -> Column:
    return F.size(F.split(part, " "))


def _runs(groups: Column, most: int) -> Column:
    """Of groups of normalised parts every run of one to ``most`` parts of a group, as (at, words, sentence): the number of
    words before it in the text, its own, and its words. A known sentence may hold a sign that cuts ('free software: you')."""

    def of_group(own: Column, ends: Column, base: Column) -> Column:
        run = lambda i, n: F.struct((base + F.get(ends, i)).cast("long").alias("at"), (F.get(ends, i + n) - F.get(ends, i)).alias("words"), F.array_join(F.slice(own, i + 1, n), " ").alias("sentence"))
        return F.flatten(F.transform(own, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(own) - i)), lambda n: run(i, n))))

    each = lambda gs, starts: F.flatten(F.transform(gs, lambda g, j: _bound(of_group, g, before(F.transform(g, _words)), F.get(starts, j))))
    return _bound(lambda gs: _bound(each, gs, before(F.transform(gs, lambda g: _sum(F.transform(g, _words))))), groups)


def _parts(cut: Column) -> Column:
    return F.filter(F.transform(cut, _normal), lambda x: x != "")


def sentences_of(text: Column, most: int) -> Column:
    """Sentences as (at, words, sentence). A sentence ends with its sign before white space, or with a blank line; a line that is
    a sentence by itself counts too, so a notice without a full stop is found. Both ways count the same words, so a sentence
    has one place however it is cut."""
    running = F.split(F.regexp_replace(text, r"(?<![\n])\n(?![ \t\r]*\n)[ \t]*(?:[#*/;%-]+[ \t]+)?", " "), _STOP + r"|\n[ \t\r]*\n", -1)
    lines = F.transform(F.split(text, r"\n", -1), lambda x: _parts(F.split(x, _STOP, -1)))
    return F.concat(_runs(F.array(_parts(running)), most), _runs(lines, most))


def sentence_hits(documents: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """row, doc_id, hits: the known sentences of each row of (row, doc_id, text) as (at, minus words, identifier), in order."""
    words, _ = bounded_broadcast(known, 200_000)
    nothing = F.array().cast("array<struct<at:bigint,words:int,sentence:string>>")
    itself = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).alias("words"), F.concat(F.lit("\x01"), F.col("row").cast("string")).alias("sentence")))
    cut = documents.select("row", "doc_id", F.inline(F.concat(itself, F.when(F.col("text").rlike(_hint()), sentences_of(F.col("text"), most)).otherwise(nothing))))
    # one pass gives a row for each document and those of its known sentences, so row numbers are drawn once
    met = stage(cut.join(words, "sentence", "left").filter((F.col("at") < 0) | F.col("identifier").isNotNull()).select("row", "doc_id", "at", "words", "identifier"), "licence-sentences")
    hit = F.when(F.col("at") >= 0, F.struct("at", (-F.col("words")).alias("minus"), "identifier"))
    return met.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set(hit)).alias("hits"))


def apart(hits: Column) -> Column:
    """Hits without those that begin inside an earlier one (of two at one place, the longer is the earlier)."""
    end = lambda x: x["at"] - x["minus"]
    meets = F.exists(F.sequence(F.lit(1), F.size(hits) - 1), lambda i: F.get(hits, i)["at"] < end(F.get(hits, i - 1)))
    kept = F.aggregate(hits, F.slice(hits, 1, 0), lambda a, x: F.when((F.size(a) > 0) & (x["at"] < end(F.element_at(a, -1))), a).otherwise(F.concat(a, F.array(x))))
    return F.when((F.size(hits) > 1) & meets, kept).otherwise(hits)


def sequence_of(hits: Column, most_gap: int) -> Column:
    """Identifiers in angle brackets and in order, with a bar where more than ``most_gap`` other words stand between."""
    gap = lambda x, i: x["at"] - F.get(hits, i - 1)["at"] + F.get(hits, i - 1)["minus"]
    return F.array_join(F.transform(hits, lambda x, i: F.concat(F.when((i > 0) & (gap(x, i) > most_gap), "| ").otherwise(""), F.lit("<"), x["identifier"], F.lit(">"))), " ")


def recognise(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Licences of a sequence, sorted and distinct: rules by falling length (of equal ones in the order given), each using up
    what it matches."""
    state = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" ".join(f"<{x}>" for x in seq)).alias("seq")) for name, seq in sorted(rules, key=lambda r: -len(r[1]))])

    def step(acc: Column, rule: Column) -> Column:
        fits = F.contains(acc["left"], rule["seq"])
        return F.struct(F.when(fits, F.replace(acc["left"], rule["seq"], F.lit("|"))).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    return F.array_sort(F.aggregate(table, state, step)["found"])


def scan(documents: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, most_gap: int = 40) -> DataFrame:
    """doc_id, n_sentences (known ones), identifiers (in the text's order), licences (sorted) for each row of (doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", F.monotonically_increasing_id())
    most = max((parts_of(x) for xs in (sentences or SENTENCES).values() for x in xs), default=1)
    found = sentence_hits(rows, dictionary(documents.sparkSession, sentences), most).select("doc_id", apart(F.col("hits")).alias("hits"))
    return found.select("doc_id", F.size("hits").cast("long").alias("n_sentences"), F.col("hits.identifier").alias("identifiers"), recognise(sequence_of(F.col("hits"), most_gap), rules or RULES).alias("licences"))
