"""License scans: phrases by place, and an exact set-similarity join of stretches of text with license templates.

A stretch is any run of at most ``STRETCH`` times a template's number of words, wherever its lines are
broken.  It meets the template when it holds at least ``THRESHOLD`` of the template's distinct words, among them all that mark this
license (``must``), and none that mark a relative of it (``without``): the grants of one family differ in a word.
The join is exact:

* the words of all templates are ordered by their frequency over the whole corpus, rarest first;
* prefix filter: a template of n distinct words that needs o = ceil(threshold * n) of them must share one
  of its n - o + 1 rarest words with the stretch, so only the surroundings of such a word are looked at;
* positional filter: where that word is the stretch's rarest, all others that it shares with the template stand behind it in the order;
  so surroundings that hold fewer than o words of the template from its position on, repeated ones counted, can't meet it.

What passes is counted exactly.  The templates are a few opening sentences of public license texts, so
their table is small by construction; the join never pairs texts with texts.

Defined cases: null or empty text has no words, counts 0, null places and empty labels; repeated rows are
scanned each by itself; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, hash_bytes, text_chunks, words

#: phrase -> label of the contract.  Fixed values.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)



class Template(NamedTuple):
    label: str
    text: str
    must: str = ""
    without: str = ""


#: label, a sentence of the license's own wording (public texts), words that mark it, words that mark a relative.  Fixed values.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "Licensed under the MIT License", "mit"),
    Template("mit", "Released under the MIT License", "mit"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu", "lesser affero"),
    Template("gpl", "Licensed under the GNU General Public License", "gnu", "lesser affero"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lesser"),
    Template("lgpl", "Licensed under the GNU Lesser General Public License", "lesser"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero"),
    Template("agpl", "Licensed under the GNU Affero General Public License", "affero"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "eclipse"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by", "Licensed under CC BY 4.0", "cc by", "nc sa nd"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution", "noncommercial sharealike noderivatives"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "nc", "sa nd"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "noncommercial", "sharealike noderivatives"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", "sa", "nc nd"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike", "noncommercial"),
    Template("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work", "cc0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)

THRESHOLD = 0.85
STRETCH = 1.5  # words of a stretch for each word of the template
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw.lower())  # bytes.lower() changes A-Z only


def vocabulary(templates) -> list[bytes]:
    """Words of all templates, with those that part their families."""
    return sorted({w for t in templates for x in t[1:] for w in word_list(x.encode())})


def _most(at: list[int], kinds: list[int], width: int, must: set[int], without: set[int]) -> int:
    """Greatest number of distinct kinds at places that lie within ``width``, with all of ``must`` and no place of ``without`` between."""
    held: dict[int, int] = {}
    best = left = 0
    for i, (p, k) in enumerate(zip(at, kinds, strict=True)):
        if k in without:
            held, left = {}, i + 1
            continue
        held[k] = held.get(k, 0) + 1
        while p - at[left] >= width:
            out = kinds[left]
            held[out] -= 1
            if not held[out]:
                del held[out]
            left += 1
        if len(held) > best and must <= held.keys():
            best = len(held)
    return best


class Scanner:
    def __init__(self, frequency: dict[bytes, int], phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, stretch: float = STRETCH) -> None:
        self.phrases = [(word_list(p.encode()), label) for p, label in phrases]
        self.phrase_hash = [([np.uint64(hash_bytes(w)) for w in p], label) for p, label in self.phrases]
        self.order = sorted(vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.order)}
        hashes = np.array([hash_bytes(w) for w in self.order], dtype=np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.templates = []
        for label, t, *marks in templates:
            must, without = ({rank[w] for w in word_list(x.encode())} for x in (*marks, "", "")[:2])
            every = word_list(t.encode())
            own = sorted({rank[w] for w in every})
            need = math.ceil(threshold * len(own) - 1e-9)
            inside, wall = np.zeros((2, len(self.order) + 1), dtype=bool)  # the last place is for all other words
            inside[own] = True
            wall[sorted(without)] = True
            self.templates.append((label, len(own), need, math.floor(stretch * len(every)), inside, wall, own[: len(own) - need + 1], must, without))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the order of template words, or -1."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, self.by_hash[at], -1)

    def best(self, low: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, counts: np.ndarray) -> list[dict[str, float]]:
        """For each text: label -> greatest containment over its stretches, where a template is met."""
        found: list[dict[str, float]] = [{} for _ in range(len(counts) - 1)]
        if not self.templates or not len(h):
            return found
        word = self.ranks(h)
        for label, size, need, width, inside, wall, prefix, must, without in self.templates:
            place = np.flatnonzero(inside[word])
            order = word[place]
            near = []
            for rarest in prefix:
                hit = place[order == rarest]
                if not len(hit):
                    continue
                d = np.searchsorted(counts, hit, side="right") - 1
                a, b = np.maximum(counts[d], hit - width + 1), np.minimum(counts[d + 1], hit + width)
                behind = place[order >= rarest]
                ok = np.searchsorted(behind, b) - np.searchsorted(behind, a) >= need
                near.append(np.stack([a[ok], b[ok], d[ok]]))
            if not near:
                continue
            a, b, d = np.concatenate(near, axis=1)
            if not len(a):
                continue
            by_place = np.lexsort((b, a))  # all surroundings of a template have one width, but at the ends of a text
            a, b, d = a[by_place], np.maximum.accumulate(b[by_place]), d[by_place]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1])  # surroundings that touch are one
            first = np.flatnonzero(new)
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
                at = [k for k in (np.flatnonzero((inside | wall)[word[a[i] : b[j - 1]]]) + a[i]).tolist() if low[s[k] : e[k]].tobytes() == self.order[word[k]]]
                most = _most(at, word[at].tolist(), width, must, without)
                if most >= need:
                    found[d[i]][label] = max(found[d[i]].get(label, 0.0), most / size)
        return found

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple]:
        low = LOWER[buf]
        h, s, e, counts = words(low, offs, ALNUM)
        n = len(offs) - 1
        places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for (hs, label), (ws, _) in zip(self.phrase_hash, self.phrases, strict=True):
            k = len(hs)
            if len(h) < k:
                continue
            at = np.flatnonzero(h[k - 1 :] == hs[-1])  # the last word is the rarest
            for j in range(k - 1):
                at = at[h[at + j] == hs[j]]
            for i in at:
                d = int(np.searchsorted(counts, i, side="right")) - 1
                if i + k <= counts[d + 1] and all(low[s[i + j] : e[i + j]].tobytes() == ws[j] for j in range(k)):
                    places[d].append((int(i - counts[d]), label))
        found = self.best(low, h, s, e, counts)
        out = []
        for d in range(n):
            more = found[d]
            own = sorted({x for _, x in places[d]})
            starts = [p for p, _ in places[d]]
            out.append(
                (
                    int(counts[d + 1] - counts[d]), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(own), ",".join(sorted({*own, *more})), 1.0 if own else max(more.values(), default=0.0),
                )
            )
        return out


def template_frequency(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How often each template word stands in all texts; a table of as many rows as the templates have words."""
    known = vocabulary(templates)
    hashes = np.array([hash_bytes(w) for w in known], dtype=np.uint64)
    order = np.argsort(hashes)
    sorted_hashes = hashes[order]

    def count(batches):
        total = np.zeros(len(order), dtype=np.int64)
        for batch in batches:
            for _, _, buf, offs in text_chunks(batch.column("text")):
                h, _, _, _ = words(LOWER[buf], offs, ALNUM)
                at = np.searchsorted(sorted_hashes, h)
                at[at == len(order)] = 0
                total += np.bincount(at[sorted_hashes[at] == h], minlength=len(order))
        yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(total)], names=["i", "n"])

    rows = docs.select("text").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {known[r["i"]]: r["n"] for r in rows}


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, stretch: float = STRETCH) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    scanner = Scanner(template_frequency(docs, templates), phrases, templates, threshold, stretch)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for _, _, buf, offs in text_chunks(batch.column("text")):
                rows += scanner.scan(buf, offs)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()], strict=True)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
