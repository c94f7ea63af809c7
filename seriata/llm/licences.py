"""Licence scans by a positional index of rare words.

Templates are word sequences with mandatory key phrases. Inverse document
frequencies of all template words are counted over the whole corpus. A file's
licence words are taken from the one of the highest such frequency down: the
first that a template's key phrase has proposes where the template begins, by
the phrase's postings of that word; each further word of the phrase keeps those
beginnings only that its own postings agree with by relative position. What is
left is verified word by word, and the template's share of all its words there,
weighed by their frequencies, decides about the label.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

#: Phrases whose every place counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further templates as label: (template, its mandatory phrase), sentences of the licences or of their usual notices.
TEMPLATES = {
    "mit": (
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
        ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
        ("licensed under the mit license", "licensed under the mit license"),
        ("spdx license identifier mit", "license identifier mit"),
    ),
    "apache-2": (
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "under the apache license version 2 0"),
        ("you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
        ("spdx license identifier apache 2 0", "license identifier apache 2 0"),
    ),
    "bsd": (
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
        ("spdx license identifier bsd", "license identifier bsd"),
    ),
    "gpl": (
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
        ("you should have received a copy of the gnu general public license along with this program", "copy of the gnu general public license"),
        ("spdx license identifier gpl", "license identifier gpl"),
    ),
    "lgpl": (
        ("under the terms of the gnu lesser general public license as published by the free software foundation", "terms of the gnu lesser general public license"),
        ("you should have received a copy of the gnu lesser general public license along with this library", "copy of the gnu lesser general public license"),
        ("spdx license identifier lgpl", "license identifier lgpl"),
    ),
    "agpl": (
        ("under the terms of the gnu affero general public license as published by the free software foundation", "terms of the gnu affero general public license"),
    ),
    "mpl-2": (
        ("this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license v 2 0"),
        ("mozilla public license version 2 0", "mozilla public license version 2 0"),
    ),
    "epl-2": (("made available under the terms of the eclipse public license 2 0", "terms of the eclipse public license 2 0"),),
    "isc": (("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),),
    "zlib": (("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),),
    "boost": (("distributed under the boost software license version 1 0", "boost software license version 1 0"),),
    "unlicense": (("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),),
    "cc0": (
        ("creative commons cc0 1 0 universal", "creative commons cc0 1 0"),
        ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ),
    "cc-by": (("licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),),
    "cc-by-sa": (("licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),),
    "cc-by-nd": (("licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0"),),
    "cc-by-nc": (("licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),),
    "cc-by-nc-sa": (("licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "creative commons attribution noncommercial sharealike 4 0"),),
    "cc-by-nc-nd": (("licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives 4 0"),),
}
#: The share of a template's words, by weight, that must stand around its phrase for its label.
LEAST_SHARE = 0.6

_WORD = {*range(48, 58), *range(97, 123), *range(128, 256)}
#: A-Z to lower case, every byte that is in no word to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and all other code points over 127."""
    return (text or "").encode().translate(WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    at: int  # where the mandatory phrase begins
    phrase: tuple[bytes, ...]
    is_base: bool

    @classmethod
    def of(cls, label: str, text: str, phrase: str, is_base: bool) -> Template:
        words, must = tuple(text.encode().split()), tuple(phrase.encode().split())
        return cls(label, words, next(i for i in range(len(words)) if words[i : i + len(must)] == must), must, is_base)


def templates() -> list[Template]:
    return [Template.of(x, p, p, True) for p, x in BASE.items()] + [Template.of(label, t, p, False) for label, some in TEMPLATES.items() for t, p in some]


class Index:
    """Postings of phrase words: which templates' phrases have them, and at which relative positions."""

    def __init__(self, df: dict[bytes, int], n_docs: int):
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary()}
        self.templates = templates()
        self.weight = [sum(self.idf[w] for w in t.words) for t in self.templates]
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, t in enumerate(self.templates):
            for i, w in enumerate(t.phrase):
                self.postings[w][k].append(t.at + i)
        self.needs = [frozenset(t.phrase) for t in self.templates]

    def beginnings(self, words: list[bytes]) -> dict[int, list[int]]:
        """Where each template's phrase stands, told by where the template would begin (below 0 if the file begins later)."""
        places = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                places[w].append(i)
        able = {k for k, need in enumerate(self.needs) if need <= places.keys()}
        found: dict[int, list[int]] = {}
        for w in sorted(places, key=lambda w: (-self.idf[w], w)) if able else ():
            for k, at in self.postings[w].items():
                if k not in able:
                    continue
                if k not in found:
                    found[k] = sorted({p - i for p in places[w] for i in at})
                found[k] = [s for s in found[k] if all(0 <= s + i < len(words) and words[s + i] == w for i in at)]
        return {k: starts for k, starts in found.items() if starts}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """(start, label) of every base place, all labels, and the best score."""
        base, labels, best = [], set(), 0.0
        for k, starts in self.beginnings(words).items():
            t = self.templates[k]
            for start in starts:
                if tuple(words[start + t.at : start + t.at + len(t.phrase)]) != t.phrase:
                    continue
                if t.is_base:
                    base.append((start, t.label))
                share = sum(self.idf[w] for i, w in enumerate(t.words) if 0 <= start + i < len(words) and words[start + i] == w) / self.weight[k]
                if share >= LEAST_SHARE:
                    labels.add(t.label)
                best = max(best, 1.0 if t.is_base else 0.5 + share / 2 if share >= LEAST_SHARE else share / 2)
        return base, labels, best


def vocabulary() -> set[bytes]:
    return {w for t in templates() for w in t.words}


def frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many rows of docs each template word stands, and the number of rows: as many numbers as there are words."""
    known = frozenset(vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = Counter(), 0
        for batch in slices(batches, 0):
            rows += batch.num_rows
            for text in batch.column(0):
                n.update(known.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in n), ""]), pa.array([*n.values(), rows], pa.int64())], ["word", "n"])

    found = {r.word.encode(): r.n for r in docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row per row of docs: licence labels and where the base phrases stand.

    Null and empty texts have no words and no labels, with score 0; a null
    doc_id stays null; repeated rows are each scanned; very long texts are read
    whole, one at a time; without rows there are none in the result; other
    columns do not matter. A base phrase's label is always kept; a template adds
    its own if its phrase and LEAST_SHARE of its words stand there.
    """
    counted = frequencies(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*counted)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                base, labels, score = index.scan(words) if not index.postings.keys().isdisjoint(words) else ([], (), 0.0)
                at = [i for i, _ in base]
                rows.append((doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 6)))
            types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(scan), SCHEMA)
