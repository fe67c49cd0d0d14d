"""License scans with a positional index of rare license words.

The index holds, for each license template, its words of highest inverse
document frequency with their positions. A file's words are looked up in it;
postings that agree on (template, file position - template position) vote for
one alignment. Alignments with enough votes are verified: the share of template
words that stand where the template has them, and the template's mandatory key
phrases. Base phrases (short names of licenses) are counted at every place.

Null text is empty: no words, no labels, null first and last word, score 0.
Repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.llm.arrays import FOLD, LETTERED, Chunk, chunks, row_starts, word_hash, words
from markwise.llm.columns import corpus_counts, per_text

# Phrases that name a license wherever they stand, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License texts as their authors publish them (opening passages), and the phrases a copy must contain.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software",
        ["permission is hereby granted", "without restriction"],
    ),
    "mit-notice": ("Released under the MIT License", ["mit license"]),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ["under the apache license", "in compliance with the license"],
    ),
    "apache-notice": ("Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        ["gnu general public license", "free software foundation"],
    ),
    "gpl-notice": (
        "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"],
    ),
    "cc-by-nc-notice": ("Licensed under CC BY-NC 4.0", ["cc by nc"]),
    "cc-by-notice": ("Licensed under CC BY 4.0", ["cc by 4 0"]),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ["creative commons attribution 4 0"],
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ["redistribution and use", "are permitted provided that"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee"],
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ["mozilla public license"],
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        ["free and unencumbered software"],
    ),
}

FIELDS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double"
)


def _split(text: str) -> list[str]:
    data = FOLD[np.frombuffer(text.encode(), dtype=np.uint8)]
    found = words(data, np.array([0, len(data)]), LETTERED)
    return [data[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]


def _hashes(text: str) -> np.ndarray:
    return np.array([word_hash(w) for w in _split(text)], dtype=np.uint64)


@dataclass(frozen=True)
class Index:
    """Postings of the rare words of each template, sorted by word hash."""

    names: list[str]
    texts: list[np.ndarray]
    phrases: list[list[np.ndarray]]
    word: np.ndarray
    template: np.ndarray
    position: np.ndarray


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of all templates and the number of documents that hold each, over every document."""
    vocabulary = np.unique(np.concatenate([_hashes(text) for text, _ in TEMPLATES.values()]))

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for c in chunks(batch.column(0)):
            found = words(FOLD[c.data], c.bounds, LETTERED)
            at = np.minimum(np.searchsorted(vocabulary, found.hash), len(vocabulary) - 1)
            hit = vocabulary[at] == found.hash
            pairs = np.unique(found.row[hit] * len(vocabulary) + at[hit])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))

    return vocabulary, corpus_counts(docs.select("text"), count, len(vocabulary))


def build_index(docs: DataFrame, rare: int = 8) -> Index:
    """The ``rare`` rarest words of each template by document frequency in ``docs``, at all their positions."""
    vocabulary, df = document_frequency(docs)
    names, texts, phrases, postings = [], [], [], []
    for t, (name, (text, keys)) in enumerate(TEMPLATES.items()):
        hashes = _hashes(text)
        frequency = df[np.searchsorted(vocabulary, hashes)]
        chosen = hashes[np.lexsort((hashes, frequency))]
        chosen = chosen[np.sort(np.unique(chosen, return_index=True)[1])][:rare]
        names.append(name)
        texts.append(hashes)
        phrases.append([_hashes(k) for k in keys])
        postings += [(int(h), t, p) for p, h in enumerate(hashes) if h in chosen]
    postings.sort()
    word, template, position = zip(*postings, strict=True)
    return Index(names, texts, phrases, np.array(word, np.uint64), np.array(template), np.array(position))


def _places(hashes: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word indexes where ``phrase`` stands consecutively inside one row."""
    n, k = len(hashes), len(phrase)
    if n < k:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(hashes[: n - k + 1] == phrase[0])
    for i in range(1, k):
        at = at[hashes[at + i] == phrase[i]]
    return at[row[at] == row[at + k - 1]]


def _alignments(index: Index, hashes, row, starts, votes: int) -> np.ndarray:
    """Rows of (row, template, start word) on which at least ``votes`` rare words agree (all of a shorter template)."""
    low, high = (np.searchsorted(index.word, hashes, side) for side in ("left", "right"))
    at = np.flatnonzero(high > low)
    n = (high - low)[at]
    posting = np.repeat(low[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    template = index.template[posting]
    found, count = np.unique(
        np.stack([row[at], template, at - starts[row[at]] - index.position[posting]]), axis=1, return_counts=True
    )
    need = np.minimum(votes, np.bincount(index.template, minlength=len(index.names)))
    return found[:, count >= need[found[1]]].T


def scan(docs: DataFrame, index: Index | None = None, votes: int = 3, least: float = 0.8) -> DataFrame:
    """License labels and places per document.

    ``labels`` joins the base labels with those of templates verified with at
    least ``least`` of their words in place and all key phrases present.
    ``score`` is 1 with a base phrase, else the best verified share, else 0.
    """
    index = index or build_index(docs)
    base = [(label, _hashes(phrase)) for phrase, label in BASE_PHRASES.items()]

    def compute(c: Chunk) -> list:
        found = words(FOLD[c.data], c.bounds, LETTERED)
        n_rows = len(c.bounds) - 1
        starts = row_starts(found.row, n_rows)
        n_base, score = np.zeros(n_rows, np.int64), np.zeros(n_rows)
        first, last = np.full(n_rows, np.iinfo(np.int64).max), np.full(n_rows, -1)
        base_labels = [set() for _ in range(n_rows)]
        labels = [set() for _ in range(n_rows)]
        for label, phrase in base:
            at = _places(found.hash, found.row, phrase)
            r = found.row[at]
            np.add.at(n_base, r, 1)
            np.minimum.at(first, r, at - starts[r])
            np.maximum.at(last, r, at - starts[r])
            for x in np.unique(r):
                base_labels[x].add(label)
        for r, t, start in _alignments(index, found.hash, found.row, starts, votes):
            own, text = found.hash[starts[r] : starts[r + 1]], index.texts[t]
            a, b = max(0, start), min(len(own), start + len(text))
            share = float((own[a:b] == text[a - start : b - start]).mean() * (b - a) / len(text)) if b > a else 0.0
            if share < least:
                continue
            zero = np.zeros(len(own), np.int64)
            if all(len(_places(own, zero, p)) for p in index.phrases[t]):
                labels[r].add(index.names[t].removesuffix("-notice"))
                score[r] = max(score[r], share)
        score[n_base > 0] = 1.0
        none = n_base == 0
        return [
            np.diff(starts), n_base, np.ma.array(first, mask=none), np.ma.array(last, mask=none),
            [",".join(sorted(x)) for x in base_labels],
            [",".join(sorted(x | y)) for x, y in zip(base_labels, labels, strict=True)], score,
        ]

    rows = docs.select("doc_id", per_text(compute, FIELDS)(F.col("text")).alias("found"))
    return rows.select("doc_id", "found.*")
