"""Licence scans through a positional index of rare licence words, with DataFrame functions only."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col

#: Runs of letters, digits and all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The letters that words are compared without regard to the case of.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Phrases that give a label wherever their words stand in a row.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words in order, and a phrase of it that must be there."""

    label: str
    words: str
    phrase: str


# Public licence notices, lower case without punctuation, by SPDX label: what files say in front, then the whole
# texts of the short licences.
TEMPLATES = (
    Template("MIT", "released under the mit license", "mit license"),
    Template("MIT", "licensed under the mit license", "mit license"),
    Template("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("Apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("GPL-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("GPL-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("GPL", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    Template("LGPL", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "terms of the gnu lesser general public license"),
    Template("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    Template("Unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template(
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons "
        "to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "the rights to use copy modify merge publish distribute sublicense",
    ),
    Template(
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties "
        "of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
        "of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "the author disclaims all warranties with regard to this software",
    ),
    Template(
        "BSD",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    Template(
        "Zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
        "acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented "
        "as being the original software 3 this notice may not be removed or altered from any source distribution",
        "the origin of this software must not be misrepresented",
    ),
)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _places(words: Column, phrase: str) -> Column:
    """Where the words of the phrase start in the array, counted from 0."""
    first, *rest = phrase.split()

    def start(w: Column, i: Column) -> Column:
        held = w == first
        for n, other in enumerate(rest, 1):
            held = held & F.coalesce(F.get(words, i + n) == other, F.lit(False))
        return F.when(held, i)

    return F.filter(F.transform(words, start), lambda x: x.isNotNull())


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents (column words: array of strings), and how many of them hold each word of the vocabulary, which bounds what goes to the driver."""
    held = words.select(F.explode(F.array_append(F.array_intersect("words", _strings(vocabulary)), F.lit(""))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.pop("", 0), found


def scan_licenses(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, rare: int = 6, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are compared with A-Z in lower case. base_labels are those of the phrases whose words stand in a row somewhere; n_base counts
    the places, first_word and last_word are the first and last of their starts (null if there is none). The method:
    document frequencies of the templates' words over all of docs give their IDF; the index keeps the `rare` words of highest
    IDF of each template, with their places in it. All indexed words that a file holds are looked up; each place
    minus the template's is where the template would start, and `least` different words must agree on it (all, if the
    template has fewer). The template's phrase must stand there too, whole. score is the share of a template's indexed words
    that agree, the highest over the labels found, 0 if none is.

    Null text counts as empty: 0 words, no labels (empty strings), score 0. A null id stays null; repeated rows each get
    their row; empty tables give none; other columns are not read. Only places of indexed words in rows that hold a template's phrase are exploded, so other rows cost nothing.
    """
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    split = texts.select("doc_id", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0)).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    n_docs, df = document_frequencies(split, vocabulary)
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for w in vocabulary}

    postings, needed, size = [], {}, {}
    for number, t in enumerate(templates):
        words = t.words.split()
        kept = sorted(set(words), key=lambda w: (-idf[w], w))[:rare]
        needed[number], size[number] = min(least, len(kept)), len(kept)
        postings += [(w, number, at) for at, w in enumerate(words) if w in kept]
    indexed = sorted({w for w, _, _ in postings}, key=lambda w: (-idf[w], w))
    phrase_at = [(number, t.words.split().index(t.phrase.split()[0]), t.phrase) for number, t in enumerate(templates)]
    for number, at, phrase in phrase_at:
        words = templates[number].words.split()
        starts = [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        phrase_at[number] = (number, starts[0], phrase)

    none = F.array().cast("array<int>")
    words = F.col("words")
    base = [F.when(F.array_contains(words, p.split()[0]), _places(words, p)).otherwise(none) for p, _ in phrases]
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(F.col("own"), w), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    no_hits = F.array().cast("array<struct<word:string,at:int>>")
    proofs = F.concat(*(_proofs(words, number, at, phrase, max(phrase.split(), key=lambda w: (w in indexed, idf[w]))) for number, at, phrase in phrase_at))
    own = F.array_intersect(words, _strings(indexed))
    found = (
        split.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words", F.array(*base).alias("base"), own.alias("own"))
        .withColumn("proofs", F.when(F.size("own") >= 1, proofs).otherwise(F.array().cast("array<struct<template:int,offset:int>>")))
        .select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "base", F.when(F.size("proofs") >= 1, hits).otherwise(no_hits).alias("hits"), "proofs")
    )
    every = F.flatten("base")
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(F.get("base", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())))
    row = found.select("row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base_list"), "hits", "proofs")
    index = _index(postings)
    possible = F.flatten(F.transform("hits", lambda h: F.transform(F.coalesce(F.element_at(index, h["word"]), F.array().cast("array<struct<template:int,place:int>>")), lambda p: F.struct(p["template"].alias("template"), (h["at"] - p["place"]).alias("offset"), h["word"].alias("word")))))
    proven = F.transform("proofs", lambda p: F.struct(p["template"].alias("template"), p["offset"].alias("offset"), F.lit(None).cast("string").alias("word")))
    carried = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_list"]
    spread = row.select(*carried, F.explode_outer(F.when(F.size("proofs") > 0, F.concat(possible, proven))).alias("e")).select(*carried, "e.template", "e.offset", "e.word")
    agreed = spread.groupBy(*carried, "template", "offset").agg(F.count_distinct("word").alias("agree"), F.bool_or(F.col("word").isNull()).alias("proof"))
    numbers = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v))))
    ok = F.col("proof") & F.col("template").isNotNull() & (F.col("agree") >= F.element_at(numbers(needed), F.col("template")))
    label = F.element_at(_strings([t.label for t in templates]), F.col("template") + 1)
    out = agreed.groupBy(*carried).agg(F.collect_set(F.when(ok, label)).alias("more"), F.max(F.when(ok, F.col("agree") / F.element_at(numbers(size), F.col("template")))).alias("best"))
    text_of = lambda c: F.array_join(c, ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text_of(F.col("base_list")).alias("base_labels"), text_of(F.array_sort(F.array_union("base_list", "more"))).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score")
    )


def _proofs(words: Column, number: int, at: int, phrase: str, rarest: str) -> Column:
    """(template, offset) for each place of a template's phrase: where the template would start."""
    starts = F.transform(_places(words, phrase), lambda i: F.struct(F.lit(number).alias("template"), (i - at).alias("offset")))
    return F.when(F.array_contains(words, rarest), starts).otherwise(F.array().cast("array<struct<template:int,offset:int>>"))


def _index(postings: list[tuple[str, int, int]]) -> Column:
    """word -> its places in the templates, as a literal map."""
    by_word: dict[str, list[tuple[int, int]]] = {}
    for w, number, at in postings:
        by_word.setdefault(w, []).append((number, at))
    return F.create_map(*(x for w, held in by_word.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(n).alias("template"), F.lit(at).alias("place")) for n, at in held)))))
