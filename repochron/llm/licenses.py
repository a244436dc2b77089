"""License scans: a positional index of the rare words of license notices, and exact phrases."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import table, text_bytes

#: A word of a UTF-8 text whose A-Z are lower-cased: digits, a-z and all bytes above 127.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARE = 0.8        # of a notice's IDF weight that must stand in place
DRIFT = 2          # words by which a part of a notice may be shifted

#: Phrases and labels of the base scan.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


class Template(NamedTuple):
    """A license notice, its label, and the phrases without which it does not count."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Wording of public license notices and the phrases that tell them apart.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the Software), to deal in the Software without restriction, including "
             "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
             "copies of the Software, and to permit persons to whom the Software is furnished to do so",
             ("permission is hereby granted free of charge", "merge publish distribute sublicense")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at",
             ("apache license version 2 0",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3",
             ("gnu general public license version 3",)),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
             "(at your option) any later version", ("gnu general public license", "version 3")),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
             "(at your option) any later version", ("gnu general public license", "version 2")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation",
             ("gnu lesser general public license",)),
    Template("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software "
             "Foundation, either version 3 of the License", ("gnu affero general public license", "version 3")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license", "2 0")),
    Template("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
             ("creative commons attribution noncommercial",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("unencumbered software released into the public domain",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors "
             "be held liable for any damages arising from the use of this software",
             ("in no event will the authors be held liable",)),
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class _Notice(NamedTuple):
    label: str
    words: np.ndarray      # vocabulary ids by position
    weight: np.ndarray     # IDF by position, summing to 1
    keys: list[np.ndarray]
    hits: int              # rare words that any accepted place must hold


class Index:
    """Postings of the templates' rare words.

    A place of a notice counts from ``share`` of its weight on, so it can't consist of frequent words
    alone: of the words in falling order of IDF, as many are *rare* as it takes until what is left,
    even with one rare word, stays below ``share``. Every place that counts then holds two rare words
    (one, where a single word outweighs the rest), at the same relative position up to ``drift``.
    """

    def __init__(self, templates: Sequence[Template], phrases: Mapping[str, str], df: Mapping[bytes, int], n_docs: int,
                 share: float = SHARE, drift: int = DRIFT):
        self.share, self.drift, self.vocab = share, drift, {}
        self.notices: list[_Notice] = []
        self.phrases = [(label, self._ids(phrase)) for phrase, label in phrases.items() if words_of(phrase.encode())]
        postings: dict[int, list[tuple[int, int]]] = {}
        for t in templates:
            ids = self._ids(t.text)
            if not len(ids):
                continue
            names = words_of(t.text.encode())
            weight = np.array([1e-3 + math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in names])
            weight /= weight.sum()
            total = Counter()
            for i, w in zip(ids.tolist(), weight.tolist()):
                total[i] += w
            rare, left, most, hits = set(), 1.0, 0.0, 1
            for i, w in sorted(total.items(), key=lambda x: (-x[1] / np.count_nonzero(ids == x[0]), x[0])):
                if left < share - 1e-9 and (hits == 2 or left + most < share - 1e-9):
                    break
                rare.add(i)
                left, most = left - w, max(most, w)
            hits = 2 if left + most < share - 1e-9 else 1
            for q, i in enumerate(ids.tolist()):
                if i in rare:
                    postings.setdefault(i, []).append((len(self.notices), q))
            self.notices.append(_Notice(t.label, ids, weight, [self._ids(k) for k in t.keys], hits))
        n = len(self.vocab)
        self.starts = np.zeros(n + 1, np.int64)
        self.starts[1:] = np.cumsum([len(postings.get(i, ())) for i in range(n)])
        flat = [p for i in range(n) for p in postings.get(i, ())]
        self.post_notice = np.array([p[0] for p in flat], np.int64)
        self.post_at = np.array([p[1] for p in flat], np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text.encode())], np.int64)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))

    def base(self, ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Starts of every phrase."""
        return [(label, places(ids, phrase)) for label, phrase in self.phrases]

    def notices_in(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Best place (label, first word, words, share) of every notice that the text holds."""
        known = np.flatnonzero(ids >= 0)
        lists = self.starts[ids[known] + 1] - self.starts[ids[known]]
        known, lists = known[lists > 0], lists[lists > 0]
        if not len(known):
            return []
        at = np.repeat(known, lists)
        entry = np.repeat(self.starts[ids[known]], lists) + np.arange(len(at)) - np.repeat(np.cumsum(lists) - lists, lists)
        notice, offset = self.post_notice[entry], at - self.post_at[entry]
        found = []
        for t in np.unique(notice).tolist():
            diagonal = np.sort(offset[notice == t])
            shifts = np.unique((np.unique(diagonal)[:, None] + np.arange(-self.drift, self.drift + 1)).ravel())
            agree = np.searchsorted(diagonal, shifts + self.drift, "right") - np.searchsorted(diagonal, shifts - self.drift)
            best = self._verify(ids, self.notices[t], shifts[agree >= self.notices[t].hits])
            if best is not None:
                found.append(best)
        return found

    def _verify(self, ids: np.ndarray, notice: _Notice, shifts: np.ndarray):
        best, n = None, len(notice.words)
        padded = np.concatenate((np.full(n + self.drift, -1), ids, np.full(n + 2 * self.drift, -1)))
        for k in range(0, len(shifts), 1024):
            part = shifts[k: k + 1024]
            at = part[:, None] + np.arange(n) + n + self.drift
            same = np.zeros(at.shape, bool)
            for d in range(-self.drift, self.drift + 1):
                index = at + d
                np.logical_or(same, padded[np.clip(index, 0, len(padded) - 1)] == notice.words, out=same)
            shares, straight = same @ notice.weight, (padded[at] == notice.words) @ notice.weight
            for i in np.flatnonzero(shares >= self.share - 1e-9).tolist():
                low = max(0, int(part[i]) - self.drift)
                window = ids[low: int(part[i]) + n + self.drift]
                rank = (round(float(shares[i]), 12), float(straight[i]))
                if (best is None or rank > best[0]) and all(len(places(window, key)) for key in notice.keys):
                    best = (rank, (notice.label, max(0, int(part[i])), n, min(1.0, float(shares[i]))))
        return best and best[1]


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions where the ids of ``phrase`` stand consecutively."""
    m = len(ids) - len(phrase) + 1
    if m <= 0 or not len(phrase):
        return np.empty(0, np.int64)
    at = np.flatnonzero(ids[:m] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


def document_frequencies(docs: DataFrame, words: frozenset[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all documents each of ``words`` stands, and the number of documents. What comes to
    the driver is bounded by the number of words asked for, which is that of the templates."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                seen.update(words.intersection(words_of(text)))
                seen[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in rows}
    return df, df.pop(b"", 0)


SCHEMA = ("n_words long, n_places long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
          "score double, notices array<struct<label:string,start:long,length:long,share:double>>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES,
                 phrases: Mapping[str, str] = PHRASES, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """Licenses that each text names or quotes.

    Two scans without shuffle of texts: document frequencies of the templates' words over all documents,
    then the search. Each file's licence words of highest IDF are looked up in the positional index;
    places where their postings agree on one relative position are compared with the whole notice, whose
    words count by IDF (``share``, shifts up to ``drift`` words); then its key phrases must stand there.
    ``phrases`` are found wherever their words stand consecutively.

    Returns id, ``n_words``, ``n_places`` (of all phrases), ``first_word`` / ``last_word`` (their first and
    last start, null without any), ``base_labels`` and ``labels`` (sorted, distinct; the latter with those of
    notices), ``score`` (1 with a phrase, else the largest share of a notice found, else 0) and ``notices``
    (the best place of each notice found). Null and empty texts: no words, no labels, score 0. Each row
    counts by itself, so repeated rows and null ids stay; an empty table gives no rows; other columns
    don't matter. Long texts are searched whole, in time linear in their words.
    """
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    vocab = frozenset(w for t in templates for w in words_of(t.text.encode()))
    df, n_docs = document_frequencies(narrow, vocab, "__text")
    index = Index(templates, phrases, df, n_docs, share, drift)
    arrow = pa.schema([("n_words", pa.int64()), ("n_places", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                       ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
                       ("notices", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                                                       ("share", pa.float64())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column(1)):
                ids = index.encode(words_of(text))
                base, first, last, n = set(), None, None, 0
                for label, at in index.base(ids):
                    if len(at):
                        base.add(label)
                        n += len(at)
                        first = int(at[0]) if first is None else min(first, int(at[0]))
                        last = int(at[-1]) if last is None else max(last, int(at[-1]))
                found = index.notices_in(ids)
                rows.append({"n_words": len(ids), "n_places": n, "first_word": first, "last_word": last,
                             "base_labels": sorted(base), "labels": sorted(base.union(f[0] for f in found)),
                             "score": 1.0 if base else max((f[3] for f in found), default=0.0),
                             "notices": [dict(zip(("label", "start", "length", "share"), f)) for f in found]})
            out = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=[batch.schema.names[0], *arrow.names])

    id_type = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(scan, f"`{id_col}` {id_type}, {SCHEMA}")


def op11_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of all ``documents``: counted words, places of the base phrases, labels, score."""
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.col("n_places").alias("n_base"), "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
