"""Licence scans over a positional index of rare words.

Licence notices are templates of words. The inverse document frequency of their words is counted over all documents. A
template's rarest words, so many that no alignment can reach the wanted share of its weight without one of them, stand
in an index of postings (template, position). A file's words are looked up there, rarest first: two words at the right distance
in a template point to the same place of the file, so their postings meet in one (template, start). What is heavy enough is
aligned with the whole template, and mandatory phrases of the licence must stand there too.

Words are told apart in bytes: the ASCII letters, lower-cased, digits and all bytes of other letters.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.llm.common import table

#: Phrases that name a licence outright.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licence notices (label, words, phrases that must stand there).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "distributed under the terms of the mit license", ["mit license"]),
    ("mit", "spdx license identifier mit", ["identifier mit"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "spdx license identifier isc", ["identifier isc"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "version 2"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2", "spdx license identifier apache 2 0", ["identifier apache 2"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("bsd-3", "spdx license identifier bsd 3 clause", ["bsd 3 clause"]),
    ("bsd-3", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("bsd-2", "spdx license identifier bsd 2 clause", ["bsd 2 clause"]),
    ("bsd-2", "licensed under the bsd 2 clause license", ["bsd 2 clause"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-2", "spdx license identifier gpl 2 0", ["identifier gpl 2"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "spdx license identifier gpl 3 0", ["identifier gpl 3"]),
    ("lgpl-2", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ["gnu lesser general public license", "version 2"]),
    ("lgpl-2", "licensed under the gnu lesser general public license version 2", ["gnu lesser general public license", "version 2"]),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ["gnu lesser general public license", "version 3"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license", "version 3"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "2 0"]),
    ("mpl-2", "licensed under the mozilla public license version 2", ["mozilla public license", "version 2"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license", "2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("cc0-1", "this work is licensed under cc0 1 0", ["cc0 1 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by", "this work is licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "this work is licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives"]),
    ("cc-by-nd", "this work is licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("bsl-1", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["authors be held liable for any damages arising"]),
    ("wtfpl", "do what the fuck you want to public license", ["want to public license"]),
    ("artistic-2", "licensed under the artistic license 2 0", ["artistic license 2"]),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", ["proprietary and confidential"]),
]

#: The share of a template's weight that must stand in its place.
LEAST_SHARE = 0.7
#: How many words before and after a template its mandatory phrases may stand.
SLACK = 4
PIECE = 1 << 20
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def word_list(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def vocabulary() -> list[bytes]:
    texts = [*BASE, *(t for _, t, _ in TEMPLATES), *(p for _, _, ps in TEMPLATES for p in ps)]
    return sorted({w for t in texts for w in word_list(t)})


def occurrences(text: bytes, number: dict[bytes, int], piece: int = PIECE) -> tuple[int, np.ndarray, np.ndarray]:
    """How many words a text has, and place and number of those that ``number`` knows. Words live a piece at a time."""
    plain, at, n, places, numbers = text.translate(_PLAIN), 0, 0, [], []
    while at < len(plain):
        end = plain.find(b" ", at + piece)
        words = plain[at : end if end >= 0 else len(plain)].split()
        found = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(found >= 0)
        places.append(known + n)
        numbers.append(found[known])
        n += len(words)
        at = end if end >= 0 else len(plain)
    if not places:
        return 0, np.empty(0, np.int64), np.empty(0, np.int32)
    return n, np.concatenate(places), np.concatenate(numbers)


def phrase_starts(places: np.ndarray, numbers: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Places where the words of a phrase stand one after the other."""
    last = len(numbers) - len(phrase) + 1
    if last <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(numbers[:last] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[(numbers[at + k] == phrase[k]) & (places[at + k] == places[at] + k)]
    return places[at]


@dataclass
class Template:
    label: str
    words: np.ndarray
    weights: np.ndarray
    phrases: list[list[int]]
    least: float = 0.0  # the weight that a match has
    spare: float = 0.0  # the weight of the words that the index doesn't have


@dataclass
class Index:
    """Templates with the weights of their words, and the postings of their rarest ones."""

    number: dict[bytes, int]
    templates: list[Template]
    idf: np.ndarray
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    @classmethod
    def build(cls, idf: np.ndarray, share: float = LEAST_SHARE) -> Index:
        number = {w: k for k, w in enumerate(vocabulary())}
        ids = lambda text: [number[w] for w in word_list(text)]
        out = cls(number, [], idf)
        for label, text, phrases in TEMPLATES:
            words = np.array(ids(text), np.int32)
            t = Template(label, words, idf[words], [ids(p) for p in phrases])
            t.least, t.spare = share * float(t.weights.sum()), float(t.weights.sum())
            for p in np.argsort(-t.weights, kind="stable"):
                if t.spare < t.least:
                    break
                t.spare -= float(t.weights[p])
                out.postings[int(words[p])].append((len(out.templates), int(p)))
            out.templates.append(t)
        return out

    def starts(self, places: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[Template, np.ndarray]]:
        """Each template with the starts at which its rare words weigh enough, by their postings' relative positions."""
        present = sorted((int(w) for w in np.unique(numbers) if int(w) in self.postings), key=lambda w: -self.idf[w])
        met: dict[int, list[tuple[np.ndarray, float]]] = defaultdict(list)
        for w in present:
            at = places[numbers == w]
            for t, p in self.postings[w]:
                met[t].append((at - p, float(self.idf[w])))
        for t, hits in met.items():
            found, of = np.unique(np.concatenate([s for s, _ in hits]), return_inverse=True)
            weight = np.bincount(of, np.concatenate([np.full(len(s), w) for s, w in hits]))
            template = self.templates[t]
            yield template, found[weight + template.spare >= template.least - 1e-9]

    def matches(self, places: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[str, float]]:
        """(label, share) of every place where a template is aligned and all its phrases stand."""
        for template, starts in self.starts(places, numbers):
            for start in starts:
                wanted = start + np.arange(len(template.words))
                at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
                hit = (places[at] == wanted) & (numbers[at] == template.words)
                weight = float(template.weights[hit].sum())
                if weight < template.least - 1e-9:
                    continue
                low, high = np.searchsorted(places, [start - SLACK, start + len(template.words) + SLACK])
                near = places[low:high], numbers[low:high]
                if all(len(phrase_starts(*near, p)) for p in template.phrases):
                    yield template.label, weight / float(template.weights.sum())

    def scan(self, text: bytes) -> tuple:
        n, places, numbers = occurrences(text, self.number)
        base = [(label, phrase_starts(places, numbers, [self.number[w] for w in word_list(p)])) for p, label in BASE.items()]
        found = np.concatenate([at for _, at in base])
        base_labels = {label for label, at in base if len(at)}
        own = list(self.matches(places, numbers))
        labels = base_labels | {label for label, _ in own}
        score = 1.0 if base_labels else max((share for _, share in own), default=0.0)
        first, last = (int(found.min()), int(found.max())) if len(found) else (None, None)
        return n, len(found), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(score, 1.0)


def word_weights(texts: DataFrame) -> np.ndarray:
    """The inverse document frequency of every licence word over all texts (text binary), by its number."""
    words = vocabulary()
    number = {w: k for k, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                count[np.unique(occurrences(text.as_py(), number)[2])] += 1
                n += 1
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"word": np.append(held, -1), "n": np.append(count[held], n)})

    # As many rows as there are licence words, and one for the number of texts.
    counts = texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    held = {r["word"]: r["n"] for r in counts}
    return np.array([math.log(1 + held.get(-1, 0) / (1 + held.get(k, 0))) for k in range(len(words))])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = LEAST_SHARE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base_labels`` has the licences that a phrase names outright, ``labels`` also those whose notice stands in the text, by
    at least ``share`` of its weight; both sorted and comma-joined, empty if none. ``score`` is the largest share found, 1
    where a phrase names a licence, else 0. A null text counts as empty, repeated rows are told alike, any ids do.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text)
    index = Index.build(word_weights(rows.select("text")), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(index.scan(t.as_py()) for t in batch.column("text")), strict=True)) or [()] * len(types)
            columns = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(found, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by their whole texts."""
    return scan_licenses(table(spark, sf_dir, "documents"))
