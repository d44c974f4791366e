"""Licence scan with a positional index of rare licence words.

Notices are known word sequences, with the position of each word. Inverse document frequencies over
the whole corpus rank the words of each mandatory phrase; only places of the rarest ones are looked
up. Each says where its notice would have to begin, and the notice counts where all words of its
mandatory phrase stand at their positions from there.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.text import NOT_WORD, lower_ascii, plain
from budgetstar.sources.shared import cut_lineage

# Phrases whose places are always reported, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    phrase: str  # mandatory: stands in the text, word by word


# Opening sentences and usual short forms of public licences.
NOTICES = (
    Notice("mit", "released under the MIT License", "mit license"),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Notice("apache", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    Notice("gpl", "licensed under the GNU General Public License, version 3", "gnu general public license"),
    Notice("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "terms of the gnu general public license"),
    Notice("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    Notice("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Notice("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    Notice("epl", "made available under the terms of the Eclipse Public License", "eclipse public license"),
    Notice("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Notice("cc0", "dedicated to the public domain under CC0 1.0 Universal", "cc0 1 0 universal"),
    Notice("cc-by", "Licensed under CC BY 4.0", "licensed under cc by 4 0"),
    Notice("cc-by-sa", "Licensed under CC BY-SA 4.0", "licensed under cc by sa 4 0"),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0", "licensed under cc by nc 4 0"),
    Notice("cc-by-nd", "Licensed under CC BY-ND 4.0", "licensed under cc by nd 4 0"),
)


def notice_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


@dataclass(frozen=True)
class Index:
    """The notices, each with its words by position."""

    notices: tuple[Notice, ...]

    @property
    def longest(self) -> list[str]:
        """A word of every phrase that can be reported: the longest of a mandatory phrase, and of a base phrase."""
        longest = {max(n.phrase.split(), key=len) for n in self.notices}
        return sorted(longest | {max(p.split(), key=len) for p in BASE})

    @property
    def vocabulary(self) -> list[str]:
        base = {w for p in BASE for w in p.split()}
        return sorted({w for n in self.notices for w in notice_words(n.text)} | base)

    @property
    def anchors(self) -> list[str]:
        """Words whose rows take part in the document frequencies: all, so that no row with one goes uncounted."""
        return self.vocabulary


def build_index(notices: tuple[Notice, ...] = NOTICES) -> Index:
    for number, notice in enumerate(notices):
        words, phrase = notice_words(notice.text), notice.phrase.split()
        if not any(words[i : i + len(phrase)] == phrase for i in range(len(words))):
            raise ValueError(f"The phrase of notice {number} does not stand in its text")
    return Index(tuple(notices))


def scan(docs: DataFrame, index: Index | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts, places, labels and score; null text counts as empty.

    The text is read once; later steps need the notice words that each row holds, for the document
    frequencies, and all words of the few documents that can hold a phrase, which are written. From
    there each row is looked at alone, in time linear in its words. ``score`` is the share of the best
    notice's inverse document frequency that stands in place, 0 without a label; base phrases alone
    score their own notice's share or at least 0.5.
    """
    index = index or build_index()
    listed = F.split(lower_ascii(F.coalesce("text", F.lit(""))), NOT_WORD)
    body = plain(docs, key, text).select("doc_id", F.filter(listed, lambda w: w != "").alias("words"))
    noted = body.select("doc_id", "words", F.array_intersect("words", F.lit(index.anchors)).alias("held"))
    # No mandatory or base phrase stands in a text without its longest word, so the words of other texts end here.
    telling = F.when(F.arrays_overlap("held", F.lit(index.longest)), F.col("words")).otherwise(F.array().cast("array<string>"))
    table = cut_lineage(noted.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "held", telling.alias("words")))

    documents, held = document_frequencies(table)
    idf = {w: math.log((documents + 1) / (held.get(w, 0) + 1)) + 0.01 for w in index.vocabulary}
    # A phrase cannot stand in a text without its rarest word, so looking that one up loses no notice.
    rarest = [min(n.phrase.split(), key=lambda w: (-idf[w], w)) for n in index.notices]
    looked_up = sorted({*rarest, *(p.split()[0] for p in BASE)})
    spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.lit(looked_up), F.get("words", i)))
    spotted = table.withColumn("spots", F.when(F.size("words") > 0, spots).otherwise(F.array().cast("array<int>")))
    found = spotted.select("doc_id", "n_words", _base_places().alias("base"), _notices(index, idf, rarest).alias("notices"))

    labels = F.concat(F.transform("base", lambda b: b["label"]), F.transform("notices", lambda n: n["label"]))
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0))
    least = F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.greatest(F.round(F.least(best, F.lit(1.0)), 6), least).alias("score"),
    )


def _stands(begin: Column, phrase: list[str]) -> Column:
    """Whether the words of a phrase stand from a place on."""
    there = F.lit(True)
    for step, word in enumerate(phrase):
        there = there & F.coalesce(F.get("words", begin + step) == word, F.lit(False))
    return there


def _notice_stands(i: Column, phrase: list[str], rare: int) -> Column:
    """Whether a place holds the rarest word of a phrase, and the phrase stands around it."""
    return (F.get("words", i) == phrase[rare]) & _stands(i - rare, phrase)


def _share(begin: Column, shares: list[tuple[str, float]]) -> Column:
    parts = [F.when(F.get("words", begin + k) == w, F.lit(share)).otherwise(F.lit(0.0)) for k, (w, share) in enumerate(shares)]
    return reduce(Column.__add__, parts)


def _base_places() -> Column:
    """Label and first word of every place where a base phrase stands."""

    def found(phrase: list[str], label: str) -> Column:
        firsts = F.filter("spots", lambda i: _stands(i, phrase))
        return F.transform(firsts, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

    return F.concat(*[found(p.split(), label) for p, label in BASE.items()])


def document_frequencies(table: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of the corpus, and its rows that hold each notice word: never more entries than notice words."""
    rows = table.count()
    held = table.select(F.explode("held").alias("word"))
    return rows, {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _notices(index: Index, idf: dict[str, float], rarest: list[str]) -> Column:
    """``label`` and best ``share`` of the notices that stand in a row.

    A spot of the rarest word of a mandatory phrase says where its notice would begin; the phrase has
    to stand there, and the other words of the notice that do add their share.
    """
    found = []
    for number, notice in enumerate(index.notices):
        words, phrase = notice_words(notice.text), notice.phrase.split()
        rare = phrase.index(rarest[number])
        ahead = rare + next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        total = sum(idf[w] for w in words)
        there = partial(_notice_stands, phrase=phrase, rare=rare)
        shares = [(w, idf[w] / total) for w in words]
        best = F.array_max(F.transform(F.filter("spots", lambda i: there(i)), lambda i: _share(i - ahead, shares)))
        found.append(F.struct(F.lit(notice.label).alias("label"), best.alias("share")))
    return F.filter(F.array(*found), lambda n: n["share"].isNotNull())
