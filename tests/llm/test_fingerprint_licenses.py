import hashlib
import re

import numpy as np

from graphloom.llm import fingerprint, licenses

from .data import awkward, documents


def _shingles(t, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_op5_successors_edits_and_likeness(spark):
    rng = np.random.default_rng(0)
    voc = [f"w{i}" for i in range(4000)]
    texts = awkward() + [" ".join(rng.choice(voc, size=rng.integers(20, 600))) for _ in range(60)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs.repartition(7)).collect()}
    assert len(got) == len(texts)
    n = len(texts)
    errors = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i - 1) % n] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest(), i
        for a, b, c in ((t, e, "near_edited"), (t, nxt, "near_next")):
            x, y = _shingles(a), _shingles(b)
            j = len(x & y) / len(x | y) if x | y else 1.0
            assert 0 <= got[i][c] <= 1
            errors.append(got[i][c] - j)
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.01
    assert got[0]["fingerprint"] == got[9]["fingerprint"] and len(got[0]["fingerprint"]) == 512
    one = fingerprint.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(docs.where("false")).collect() == []


def test_op5_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b c d e f", "q r s t u v", "k l m n o p", None], ids=[5, 5, None, 1])
    got = fingerprint.fingerprints(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "5", "5", "None"]


def met(w):
    """Labels and greatest share over all stretches of the words."""
    split = lambda x: re.findall(r"[a-z0-9]+", x.lower())
    labels, score = set(), 0.0
    for t in licenses.TEMPLATES:
        own, n = set(split(t.text)), len(split(t.text)) * 3 // 2
        for a in range(len(w)):
            part = w[a : a + n]
            for k in range(len(part)):  # no stretch with a word of a relative
                if part[k] in split(t.without):
                    part = part[:k]
                    break
            share = len(own & set(part)) / len(own)
            if share >= licenses.THRESHOLD - 1e-9 and set(split(t.must)) <= set(part):
                labels.add(t.label)
                score = max(score, share)
    return labels, score


def test_op8_labels_of_a_family(spark):
    cases = {
        "Licensed under CC BY 4.0": "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
        "Licensed under the GNU Lesser General Public License": "lgpl",
        "made available under the terms of the Eclipse Public License: this program and the accompanying materials are": "epl",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(spark, list(cases))).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    two = licenses.scan(documents(spark, ["a b c x", "a b", "c b a"]), phrases=(), templates=(("t", "a b c"),)).collect()  # without marks
    assert sorted((r["doc_id"], r["labels"]) for r in two) == [(0, "t"), (1, ""), (2, "t")]


def test_op8_against_brute_force(spark):
    texts = awkward() + [
        "nothing here", "Licensed under the Apache License, Version 2.0.\nx under the mit license under the MIT license",
        "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files",
        "by nc cc by nc cc\nby nc", "the licensed apache", "GNU General Public License: Licensed under the license",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for i, t in enumerate(texts):
        w = W.findall(low(t or ""))
        at = sorted((j, lab) for p, lab in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        r = got[i]
        assert r["n_words"] == len(w) and r["n_base"] == len(at), i
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        labels = {x for _, x in at}
        labels |= met(w)[0]
        assert r["labels"] == ",".join(sorted(labels)), (t, r["labels"], labels)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)


def test_op8_stretches_of_words_whatever_the_lines(spark):
    rng = np.random.default_rng(2)
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    filler = lambda n: " ".join(rng.choice(["wir", "haus", "the", "license", "of", "software", "und", "baum"], size=n))
    texts = [
        "Das Programm kommt mit Quelltext und steht hier.\nLicensed under the Apache License, Version 2.0",
        f"Ein Haus mit Garten. {filler(30)} Licensed under the GNU General Public License",
        filler(50) + "\n" + "\n".join(" ".join(gpl.split()[i : i + 5]) for i in range(0, 31, 5)) + "\n" + filler(50),
        "Licensed\nunder\nthe\nMIT\n\nLicense",
        "mit " * 400 + "Licensed under the MIT License " + "license " * 400,
    ]
    for _ in range(60):  # templates with words dropped and put in, between other words
        w = list(rng.choice([t.text for t in licenses.TEMPLATES]).split())
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(len(w))] = rng.choice(["x", "x y z", "", "the"])
        texts.append(filler(rng.integers(0, 40)) + " " + rng.choice([" ", "\n"]).join(w) + " " + filler(rng.integers(0, 40)))
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for i, t in enumerate(texts):
        want, score = met(words(t))
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == want | base, t
        assert abs(got[i]["score"] - (1.0 if base else score)) < 1e-9
    assert [got[i]["labels"] for i in range(4)] == ["apache-2", "gpl", "gpl", "mit"]
