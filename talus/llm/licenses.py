"""Licence scans with a positional rare-token index.

The licence texts to find are templates: word sequences with a label and mandatory key phrases. Document frequencies of
the templates' words are counted over all documents; a template's `ANCHORS` words of highest inverse document frequency
are its index entries, each with its places in the template. A file's words are looked up in the index; every hit proposes
a template at a start (place of the word minus its place in the template). Proposals are intersected by relative position:
the share of the template's rare words that stand where they should must reach `AGREEMENT`, and the key phrases must stand
word for word at theirs. The phrases of the base rules are templates that must match in full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import ascii_lower, computed, row_column

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 3
AGREEMENT = 0.6
_PLACES, _BEFORE = 1 << 33, 1 << 10   # more starts than a text has; more words than a template has

# The phrases of the base rules and their labels.
BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The contract's phrases of the base rules. A licence that is only named is left to the method.
CONTRACT_BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NAMED = [("mit", "the mit license", ["the mit license"])]

# Well-known licence notices, the phrases that must stand in them, and their labels.
NOTICES = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation",
     ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
     ["gnu affero general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["except in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ["permission to use copy modify"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", ["all rights reserved"]),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_phrases: tuple[tuple[int, tuple[str, ...]], ...]   # (place in the template, words)
    base: bool

    @property
    def whole(self) -> bool:
        """Must stand word for word from its first word to its last."""
        return any(phrase == self.words for _, phrase in self.key_phrases)


def templates(notices=NOTICES, base=BASE) -> list[Template]:
    out = [Template(label, tuple(p.split()), ((0, tuple(p.split())),), True) for p, label in base.items()]
    for label, text, phrases in notices:
        words = tuple(text.split())
        places = []
        for phrase in phrases:
            part = tuple(phrase.split())
            at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
            places.append((at, part))
        out.append(Template(label, words, tuple(places), False))
    return out


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def inverse_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log((1 + documents) / (1 + documents with the word)) for the templates' words, over all documents. The result has
    one entry per template word, whatever the number of documents."""
    flags = [F.sum(F.coalesce(F.array_contains("found", w), F.lit(False)).cast("long")).alias(f"w{i}") for i, w in enumerate(vocabulary)]
    found = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    row = docs.select(F.explode(F.array(found)).alias("found")).agg(F.count("*").alias("n"), *flags).first()
    return {w: math.log((1 + row["n"]) / (1 + (row[f"w{i}"] or 0))) for i, w in enumerate(vocabulary)}


def rarest(words: tuple[str, ...], idf: dict[str, float], n: int) -> list[str]:
    return sorted(set(words), key=lambda w: (-idf[w], w))[:n]


def scan(docs: DataFrame, notices=NOTICES, base=BASE) -> DataFrame:
    """docs -> (row, n_words, places, matches): `places` are the starts of base phrases with their label, `matches` the
    accepted notices (label, start, share of rare words in place). A NULL text has no words. Matching places are all
    found, however many a file holds."""
    all_ = templates(notices, base)
    vocabulary = sorted({w for t in all_ for w in t.words})
    idf = inverse_frequencies(docs.select("text"), vocabulary)
    # A template that must stand in full needs one anchor. Any other notice is proposed by any of its anchors.
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(all_):
        for w in rarest(t.words, idf, 1 if t.whole else ANCHORS):
            for at in [i for i, x in enumerate(t.words) if x == w][:1 if t.whole else None]:
                postings.setdefault(w, []).append((number, at))
    rows = computed(docs.select(row_column(docs)), words=words_of(F.col("row.text")))
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(sorted(postings)))
    rows = computed(rows, hits=F.when(F.size("words") > 0, hits).otherwise(F.array().cast("array<int>")))
    index = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (
        F.lit(w), F.array(*[F.struct(F.lit(n).alias("t"), F.lit(a).alias("at")) for n, a in ps]))])
    # A template at a start is one whole number, so that the distinct ones are found by hashing, not by comparing pairs.
    code = lambda i, p: F.lit(_PLACES) * p["t"] + (i - p["at"] + _BEFORE)
    codes = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.transform(
        F.element_at(index, F.get("words", i)), lambda p: code(i, p)))))
    proposed = F.transform(codes, lambda c: F.struct(
        F.floor(c / F.lit(_PLACES)).cast("int").alias("t"), (c % F.lit(_PLACES) - _BEFORE).cast("int").alias("start")))
    rows = computed(rows, proposed=proposed)
    at = lambda start, i, w: F.coalesce(F.get("words", start + i) == w, F.lit(False))

    def stands(p: Column, t: Template) -> Column:
        out = p["start"] >= 0
        for first, phrase in t.key_phrases:
            for i, w in enumerate(phrase):
                out = out & at(p["start"], first + i, w)
        return out

    def share(p: Column, t: Template) -> Column:
        rare = rarest(t.words, idf, max(ANCHORS, len(set(t.words)) // 2))
        spots = [(i, w) for i, w in enumerate(t.words) if w in rare]
        return sum((at(p["start"], i, w).cast("double") for i, w in spots), F.lit(0.0)) / len(spots)

    of = lambda numbers, value, other: lambda p: _cases(p, [(n, value(p, all_[n])) for n in numbers], other)
    based = [n for n, t in enumerate(all_) if t.base]
    other = [n for n, t in enumerate(all_) if not t.base]
    labels = F.array(*[F.lit(t.label) for t in all_])
    places = F.filter(F.filter("proposed", lambda p: p["t"] < len(based)), of(based, stands, F.lit(False)))
    weighed = F.transform(
        F.filter(F.filter("proposed", lambda p: p["t"] >= len(based)), of(other, stands, F.lit(False))),
        lambda p: F.struct(F.get(labels, p["t"]).alias("label"), p["start"].alias("start"), of(other, share, F.lit(0.0))(p).alias("share")))
    return rows.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.transform(places, lambda p: F.struct(F.get(labels, p["t"]).alias("label"), p["start"].alias("start"))).alias("places"),
        F.filter(weighed, lambda m: m["share"] >= AGREEMENT).alias("matches"))


def _cases(p: Column, cases: list[tuple[int, Column]], other: Column) -> Column:
    out = None
    for n, value in cases:
        out = F.when(p["t"] == n, value) if out is None else out.when(p["t"] == n, value)
    return other if out is None else out.otherwise(other)


def digest(docs: DataFrame, notices=NOTICES, base=BASE) -> DataFrame:
    """The contract's columns for every row; repeated rows are scanned each on their own. A NULL or empty text has no words, no
    labels (empty strings), NULL places and score 0."""
    found = scan(docs.select("doc_id", "text"), notices, base)
    names = lambda *arrays: F.array_join(F.sort_array(F.array_distinct(F.concat(*[
        F.transform(a, lambda x: x["label"]) for a in arrays]))), ",")
    start = F.transform("places", lambda x: x["start"])
    best = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)))
    return found.select("row.doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                        F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
                        names("places").alias("base_labels"), names("places", "matches").alias("labels"), best.alias("score"))
