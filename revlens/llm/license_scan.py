"""Licence notices in texts, by a positional index of the words that are rarest in the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import map_texts

# Phrases that name a licence by themselves.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

# Notices as the licences word them, each with the phrases that must stand in it unchanged.
NOTICES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("distributed under the license", "without warranties or conditions")),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("to the public domain worldwide",)),
    ("epl", "are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("warranties of merchantability", "noninfringement")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable",)),
    *[(label, f"spdx license identifier {name}", (f"spdx license identifier {name}",)) for label, name in (("agpl", "agpl"), ("apache", "apache 2 0"), ("bsd", "bsd"), ("cc0", "cc0"), ("gpl", "gpl"), ("isc", "isc"), ("lgpl", "lgpl"), ("mit", "mit"), ("mpl", "mpl 2 0"))],
)

#: The share of a notice's words, weighted by rarity, that must stand in their places.
SHARE = 0.8
#: Rarest required words of a notice that are looked up; any place has them all.
ANCHORS = 3
#: Upper case to lower, other ASCII but digits and letters to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Template(NamedTuple):
    """A notice: its words, the places of those that must all be there, and whether it is a bare phrase."""

    label: str
    words: tuple[bytes, ...]
    must: tuple[int, ...]
    bare: bool


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    out = [Template(label, tuple(words_of(text)), tuple(range(len(words_of(text)))), True) for label, text in phrases]
    for label, text, required in notices:
        words, must = words_of(text), set()
        for phrase in map(words_of, required):
            starts = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
            if not starts:
                raise ValueError(f"{label}: a required phrase isn't part of the notice")
            must.update(range(starts[0], starts[0] + len(phrase)))
        out.append(Template(label, tuple(words), tuple(sorted(must)), False))
    return out


def rarity(docs: DataFrame, known: list[Template]) -> dict[bytes, float]:
    """The inverse document frequency, over all of `docs`, of every word of the templates (a few hundred)."""
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dict.fromkeys([b"", *sorted(vocabulary)], 0)
        for batch in batches:
            n[b""] += batch.num_rows
            for text in batch.column(0):
                for w in vocabulary.intersection(words_of(text.as_py())):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r.word): r.n for r in rows}
    return {w: math.log(1 + (n.get(b"", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


class Index:
    """Rare words with their postings (template, place), and the search of one text."""

    def __init__(self, known: list[Template], idf: dict[bytes, float]):
        self.known = known
        self.anchors = [sorted(t.must, key=lambda q, t=t: (-idf[t.words[q]], t.words[q], q))[:ANCHORS] for t in known]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, (t, places) in enumerate(zip(known, self.anchors, strict=True)):
            for q in places:
                self.postings.setdefault(t.words[q], []).append((k, q))
        self.rare = frozenset(self.postings)
        self.weights = [[idf[w] for w in t.words] for t in known]
        self.sums = [sum(w) for w in self.weights]

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, word where it begins, share) of all places where its required words stand, in the order of the text."""
        if self.rare.isdisjoint(words):
            return []
        found = self.rare.intersection(words)
        lists = [k for k, t in enumerate(self.known) if all(t.words[q] in found for q in self.anchors[k])]
        wanted = {self.known[k].words[q] for k in lists for q in self.anchors[k]}
        at: dict[bytes, list[int]] = {w: [] for w in wanted}
        for i, w in enumerate(words):
            if w in wanted:
                at[w].append(i)
        where = {w: np.array(v, np.int64) for w, v in at.items()}
        out = []
        for k in lists:
            t = self.known[k]
            begins = None
            for q in self.anchors[k]:
                own = where[t.words[q]] - q
                begins = own if begins is None else np.intersect1d(begins, own, assume_unique=True)
            for b in begins.tolist():
                if b + t.must[0] < 0 or b + t.must[-1] >= len(words) or any(words[b + q] != t.words[q] for q in t.must):
                    continue
                held = sum(w for q, w in enumerate(self.weights[k]) if 0 <= b + q < len(words) and words[b + q] == t.words[q])
                out.append((k, b, round(held / self.sums[k], 6)))
        return sorted(out, key=lambda x: (x[1], x[0]))


_PLACE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("share", T.DoubleType())]))
_ARROW_PLACE = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, share: float = SHARE) -> DataFrame:
    """`docs` (text and any other columns) with n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Words are runs of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased. The rarity of each word
    of the templates is counted over all of `docs`. For each template the index holds its rarest required words; a text's
    places of these words, less their place in the template, are intersected, and what is left is verified: all
    required phrases stand there, and the template's other words to at least `share` of their weight. As every
    place has all required words, none is missed, whatever `share`.

    Bare phrases are templates of which every word is required: n_base counts their places (those of different phrases each, and
    places that overlap too), first_word and last_word are where the first and last begin (null without any). base_labels
    and labels are sorted, distinct, joined by commas; labels has the notices' too. score is the largest share of
    any place, below `share` too; 0 without places. places lists them all: label, template's number, first word, share.

    Null or empty texts have no words. Rows are judged one by one, so repeated rows repeat. New columns take the place
    of columns of their names. A text goes through whole. An empty table gives an empty table.
    """
    known = templates(phrases, notices)
    idf = rarity(docs, known)

    def make():
        index = Index(known, idf)

        def f(texts, _):
            cols: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")}
            for text in texts:
                words = words_of(text)
                found = index.places(words)
                base = [(known[k].label, b) for k, b, _ in found if known[k].bare]
                good = {known[k].label for k, _, s in found if s >= share}
                row = (len(words), len(base), base[0][1] if base else None, base[-1][1] if base else None, ",".join(sorted({x for x, _ in base})), ",".join(sorted(good)))
                row += (max((s for _, _, s in found), default=0.0), [{"label": known[k].label, "template": k, "word": b, "share": s} for k, b, s in found])
                for column, value in zip(cols.values(), row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _ARROW_PLACE]
            return {c: pa.array(v, t) for (c, v), t in zip(cols.items(), types, strict=True)}

        return f

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), _PLACE]
    return map_texts(docs, make, list(zip(names, kinds, strict=True)))
