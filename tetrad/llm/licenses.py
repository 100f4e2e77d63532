"""Licence scan with a positional rare-token index.

Licence templates and the base phrases are word sequences. The words' document
frequencies are counted over the corpus; each template is indexed under its
highest-IDF words, with their positions in it. A text's licence words are looked
up there, every hit names a template and the place where it would begin, and a
place is kept if the hits of the template's rare words agree on it (for base
phrases: all of them). Kept places are verified: the mandatory key phrases must
stand in full at their relative positions, and the IDF share of template words
that stand at theirs is the score.

Words are compared by 64-bit hashes. Defined cases: a null text is an empty
text; it has no words, no labels (empty strings) and score 0. Phrases do not
reach over the end of a text. Rows may repeat. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.llm import words as W
from tetrad.llm.common import share

# --- fixed values: base phrases and their labels
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# --- fixed values: licence notices as (label, words, mandatory key phrases)
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0", ["except in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights",
     ["waived all copyright"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", ["gnu general public license", "free software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["permission is hereby granted", "free of charge"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]
#: rare words under which a template is indexed, how many of them must agree, and the least score of a label
RARE_WORDS, AGREE, LEAST_SCORE = 3, 2, 0.75

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Index:
    """Templates, their vocabulary, and postings of their rarest words."""

    def __init__(self, document_frequency: dict[str, int], n_docs: int, templates=TEMPLATES, base=BASE):
        self.vocabulary = vocabulary(templates, base)
        hashed = sorted((W.hash_of(w.encode()), i) for i, w in enumerate(self.vocabulary))
        self.hash = np.array([h for h, _ in hashed], np.uint64)
        self.word = np.array([i for _, i in hashed], np.int32)
        idf = [1 + math.log((n_docs + 1) / (document_frequency.get(w, 0) + 1)) for w in self.vocabulary]
        self.idf = np.array(idf)
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.rows = []                  # (label, word numbers, key phrases as (at, numbers), is base, votes needed)
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for label, text, keys in [*[(a, b, [b]) for a, b in base], *templates]:
            t, is_base = np.array([number[w] for w in text.split()], np.int32), len(self.rows) < len(base)
            spans = []
            for k in keys:
                k = np.array([number[w] for w in k.split()], np.int32)
                at = next(i for i in range(len(t)) if (t[i:i + len(k)] == k).all())
                spans.append((at, k))
            rare = sorted(set(t.tolist()), key=lambda w: (-idf[w], self.vocabulary[w]))[:RARE_WORDS]
            hits = 0
            for at, w in enumerate(t.tolist()):
                if w in rare:
                    self.postings.setdefault(w, []).append((len(self.rows), at))
                    hits += 1
            self.rows.append((label, t, spans, is_base, hits if is_base else min(AGREE, hits)))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of every word hash, -1 for other words."""
        at, there = W.find(self.hash, h)
        return np.where(there, self.word[at], -1)

    def places(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray):
        """(template, start, score) of all verified places, and the best score
        per document. ``first``, ``end``: each document's range of words."""
        votes: dict[int, list[np.ndarray]] = {}
        licence = np.flatnonzero(ids >= 0)
        own = ids[licence]
        for w, posts in self.postings.items():
            at = licence[own == w]
            if len(at):
                for t, offset in posts:
                    s, d = at - offset, doc[at]
                    votes.setdefault(t, []).append(s[(s >= first[d]) & (s + len(self.rows[t][1]) <= end[d])])
        found, best = [], np.zeros(len(first))
        for t in sorted(votes):
            label, words, spans, is_base, needed = self.rows[t]
            start, n = np.unique(np.concatenate(votes[t]), return_counts=True)
            start = start[n >= needed]
            if not len(start):
                continue
            hit = ids[start[:, None] + np.arange(len(words))] == words
            score = np.where(hit.all(1), 1.0, np.minimum(1.0, hit @ self.idf[words] / self.idf[words].sum()))
            ok = np.ones(len(start), bool)
            for at, k in spans:
                ok &= hit[:, at:at + len(k)].all(1)
            start, score = start[ok], score[ok]
            np.maximum.at(best, doc[start], score)
            good = score >= (1 if is_base else LEAST_SCORE)
            found.append((t, start[good]))
        return found, best


def vocabulary(templates=TEMPLATES, base=BASE) -> list[str]:
    return sorted({w for row in [*templates, *base] for w in row[1].split()})


def _read(data, offsets):
    data = W.LOWER[data]
    starts, ends, doc = W.spans(data, offsets, W.NON_ALNUM)
    return W.hashes(data, starts, ends), doc


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Number of documents that hold each licence word, and of all documents."""
    names = vocabulary()
    index = Index({}, 0)

    def count(batches):
        total, n = np.zeros(len(names), np.int64), 0
        for b in batches:
            for i, j, data, offsets in W.slices(b.column("text")):
                h, doc = _read(data, offsets)
                ids = index.numbers(h)
                known = ids >= 0
                pairs = np.unique(doc[known] * len(names) + ids[known])
                total += np.bincount(pairs % len(names), minlength=len(names))
                n += j - i
        yield pa.record_batch({"word": pa.array([*names, None], pa.string()), "n": pa.array([*total.tolist(), n], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in rows}
    return df, df.pop(None, 0)


_SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` (doc_id, text) with the result of the scan as struct ``s``."""
    held = share(docs.sparkSession, index)

    @F.arrow_udf(f"struct<{','.join(c.strip().replace(' ', ':') for c in _SCHEMA.split(','))}>")
    def run(texts: pa.Array) -> pa.Array:
        ix, out = held.value, {c.split()[0]: [] for c in _SCHEMA.split(",")}
        for i, j, data, offsets in W.slices(texts):
            h, doc = _read(data, offsets)
            n = np.bincount(doc, minlength=j - i)
            end = np.cumsum(n)
            first = end - n
            found, best = ix.places(ix.numbers(h), first, end, doc)
            base: dict[int, list[int]] = {}
            names: dict[int, set[str]] = {}
            base_names: dict[int, set[str]] = {}
            for t, starts in found:
                label, _, _, is_base, _ = ix.rows[t]
                for s in starts.tolist():
                    d = int(doc[s])
                    names.setdefault(d, set()).add(label)
                    if is_base:
                        base_names.setdefault(d, set()).add(label)
                        base.setdefault(d, []).append(s - int(first[d]))
            out["n_words"] += n.tolist()
            out["score"] += best.tolist()
            for d in range(j - i):
                b = base.get(d)
                out["n_base"].append(len(b) if b else 0)
                out["first_word"].append(min(b) if b else None)
                out["last_word"].append(max(b) if b else None)
                out["base_labels"].append(",".join(sorted(base_names.get(d, ()))))
                out["labels"].append(",".join(sorted(names.get(d, ()))))
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.StructArray.from_arrays([pa.array(out[c], kinds[k]) for c, k in (x.split() for x in _SCHEMA.split(","))],
                                          [x.split()[0] for x in _SCHEMA.split(",")])
    return docs.select("doc_id", run("text").alias("s"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return scan(own, Index(*document_frequencies(own))).select("doc_id", "s.*")
