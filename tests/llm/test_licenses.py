"""Related licenses are told apart."""

from __future__ import annotations

import pytest

from veeduria.llm import license_scan as L

PRE, POST = "some words of a file header here ", " and then the file goes on with other words"
TEXTS = [
    ("licensed under the GNU Lesser General Public License version 3", "lgpl-3"),
    ("licensed under the GNU Affero General Public License, version 3", "agpl-3"),
    ("licensed under the GNU General Public License version 2", "gpl-2"),
    ("licensed under the GNU General Public License, either version 3", "gpl-3"),
    ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
    ("licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution 4.0 Worldwide License", "cc-by"),
    ("licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("licensed under CC BY-SA 4.0", ""),
    ("licensed under the Apache License, Version 1.1", ""), ("licensed under the GNU Library General Public License version 4", ""),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License", "lgpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License", "gpl"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]


@pytest.fixture(scope="module")
def labels(spark):
    texts = [t for t, _ in TEXTS] + [t for t, _ in L.SENTENCES]
    df = spark.createDataFrame([(i, PRE + t + POST) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.labels for r in L.scan(df).collect()}


@pytest.mark.parametrize("n", range(len(TEXTS)))
def test_named_licenses(labels, n):
    assert labels[n] == TEXTS[n][1], TEXTS[n]


@pytest.mark.parametrize("n", range(len(L.SENTENCES)))
def test_every_sentence_has_its_own_label_alone(labels, n):
    text, label = L.SENTENCES[n]
    base = {b for phrase, b in L.BASE if phrase in text}
    assert labels[len(TEXTS) + n] == ",".join(sorted(base | {label}))


def test_one_edit_in_every_sentence(spark):
    """A word put in, lost or replaced, not among those that tell: the label
    stays; one of those lost: it goes."""
    rows, want = [], {}
    for n, (text, label) in enumerate(L.SENTENCES):
        w = text.split()
        plain = [i for i, x in enumerate(w) if x not in L.TELLING and 1 < i < len(w) - 2]
        for kind, at in (("in", len(w) // 2), ("lost", plain[len(plain) // 2]), ("other", plain[len(plain) // 2])):
            x = {"in": w[:at] + ["extra"] + w[at:], "lost": w[:at] + w[at + 1:], "other": w[:at] + ["extra"] + w[at + 1:]}[kind]
            if len(w) >= 8:
                want[len(rows)] = label
                rows.append((len(rows), PRE + " ".join(x) + POST))
    got = {r.doc_id: r.labels.split(",") for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [(rows[i][1], got[i]) for i in want if want[i] not in got[i]]
    assert not missed
