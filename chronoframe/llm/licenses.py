"""Licence scan by a positional rare-token index.

Templates are word sequences. Each is posted under its ANCHORS rarest places, by
inverse document frequency over the whole corpus, among those that its mandatory
key phrases cover. A file's licence words are looked up from the rarest down: a
word brings the templates whose rarest anchor it is, and their starts there are
intersected, by relative position, with those that the other anchors allow. A
start that remains stands when every key phrase is found where the template has
it. All anchors are mandatory words, so no place is missed.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import arrow_map, table, text_or_empty

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence texts and notices. Label, text, mandatory key phrases (each stands in the text).
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ["permission is hereby granted", "free of charge"],
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ["apache license version 2 0"],
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ["terms of the gnu general public license", "either version 2 of the license"],
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["terms of the gnu general public license", "either version 3 of the license"],
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        ["mozilla public license"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ["redistribution and use", "source and binary forms"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["permission to use copy modify", "for any purpose"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["in no event will the authors be held liable", "permission is granted to anyone"],
    ),
    (
        "bsl-1.0",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ["boost software license"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose",
        ["unencumbered software", "public domain"],
    ),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd"]),
]
#: Places of a template whose postings are intersected.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # (offset in the template, words)
    base: bool


def _split(text: str) -> tuple[bytes, ...]:
    return tuple(WORD.findall(text.encode().lower()))


def _offset(words: tuple[bytes, ...], part: tuple[bytes, ...]) -> int:
    for i in range(len(words) - len(part) + 1):
        if words[i : i + len(part)] == part:
            return i
    raise ValueError(f"key phrase {part!r} is not in its template")


def templates(base: dict[str, str] = BASE, notices=NOTICES) -> list[Template]:
    out = [Template(label, w := _split(phrase), ((0, w),), True) for phrase, label in base.items()]
    for label, text, keys in notices:
        w = _split(text)
        out.append(Template(label, w, tuple((_offset(w, k), k) for k in map(_split, keys)), False))
    return out


class Index:
    """Postings of templates under their rarest mandatory words; `weight`: inverse document frequency of each licence word."""

    def __init__(self, made: list[Template], weight: dict[bytes, float]):
        self.made = made
        self.weight = weight
        self.postings: dict[bytes, list[int]] = defaultdict(list)
        self.anchors: list[list[tuple[int, bytes]]] = []
        for t, x in enumerate(made):
            places = {at + i: w for at, phrase in x.keys for i, w in enumerate(phrase)}
            rarest = sorted(places.items(), key=lambda p: (-weight.get(p[1], 0.0), p[0]))[:ANCHORS]
            self.anchors.append(rarest)
            self.postings[rarest[0][1]].append(t)
        self.looked_up = {w for rarest in self.anchors for _, w in rarest}
        self.totals = [sum(weight.get(w, 0.0) for w in x.words) or 1.0 for x in made]

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its weight found in place), every place once."""
        places: dict[bytes, list[int]] = {}
        for at, w in enumerate(words):
            if w in self.looked_up:
                places.setdefault(w, []).append(at)
        found = []
        for rare in sorted(places, key=lambda w: -self.weight.get(w, 0.0)):
            for t in self.postings.get(rare, ()):
                (offset, _), *others = self.anchors[t]
                starts = {at - offset for at in places[rare]}
                for offset, w in others:
                    starts &= {at - offset for at in places.get(w, ())}
                x = self.made[t]
                for start in starts:
                    if all(start + o >= 0 and tuple(words[start + o : start + o + len(k)]) == k for o, k in x.keys):
                        got = sum(self.weight.get(w, 0.0) for i, w in enumerate(x.words) if 0 <= start + i < len(words) and words[start + i] == w)
                        found.append((t, start, min(1.0, got / self.totals[t])))
        return sorted(found)


def word_weights(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the licence words over all documents.

    What reaches the driver is one row for each word of the templates.
    """

    def rows(batch):
        seen: Counter = Counter()
        for text in batch["text"]:
            seen.update(vocabulary.intersection(WORD.findall(text.encode().lower())))
        yield ("", len(batch["text"]))
        for w, n in seen.items():
            yield (w.decode(), n)

    counts = arrow_map(docs.select(text_or_empty(text_col).alias("text")), rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"].encode(): r["n"] for r in counts.collect()}
    total = got.pop(b"", 0)
    return {w: math.log((total + 1) / (got.get(w, 0) + 0.5)) + 1e-9 for w in vocabulary}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices=NOTICES) -> DataFrame:
    """Licence evidence of every document, one row for each input row.

    Returns `id_col`, n_words, n_base, first_word, last_word, base_labels, labels,
    score, places (array of template label, start word, share).
    Null and empty texts have no words: zero counts, null first_word and
    last_word, empty labels, score 0. Null ids stay null; repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored.
    score is the largest share of a template's weight found in place.
    """
    made = templates(base, notices)
    weight = word_weights(docs, {w for x in made for w in x.words}, text_col)

    state: dict = {}

    def rows(batch):
        index = state.get("index") or state.setdefault("index", Index(made, weight))
        for key, text in zip(batch["id"], batch["text"], strict=True):
            words = WORD.findall(text.encode().lower())
            found = index.scan(words)
            basic = [(t, s) for t, s, _ in found if made[t].base]
            starts = [s for _, s in basic]
            yield (
                key, len(words), len(basic), min(starts, default=None), max(starts, default=None),
                ",".join(sorted({made[t].label for t, _ in basic})), ",".join(sorted({made[t].label for t, _, _ in found})),
                max((x for _, _, x in found), default=0.0), [{"label": made[t].label, "start": s, "share": x} for t, s, x in found],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(
        docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), rows,
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,share:double>>",
    )
    return out.withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")
