"""License notices in documents: winnowed fingerprints of the templates in an
inverted index pick candidates, a banded alignment measures them.

Fingerprints follow winnowing (Schleimer, Wilkerson and Aiken, 2003) on words:
the least hash in every window of ``WINDOW`` hashes of ``GRAM`` consecutive words is
kept, so any shared run of WINDOW + GRAM - 1 words shares a fingerprint. The
templates are a short given list; their index travels with the task's code.
Documents are fingerprinted where they are read, hits vote for the diagonal on
which a template would lie, and the text around each diagonal is aligned globally
against the template within a band: the words that may be missing, or half the
template for inserted runs, to both sides (word edit distance with
free document ends). Nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm.common import prepare

GRAM, WINDOW = 3, 2

# fixed values: license notices and grants as their publishers word them
TEMPLATES = {
    "mit_notice": "Released under the MIT License.",
    "apache_2_notice": "Licensed under the Apache License, Version 2.0.",
    "gpl_3_notice": "licensed under the GNU General Public License, version 3.",
    "cc_by_nc_4_notice": "Licensed under CC BY-NC 4.0.",
    "mit_grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "isc_grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "apache_2_header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"),
    "gpl_header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "bsd_grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"),
    "mpl_2_header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"),
}
TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*", re.UNICODE)


def tokens(text: str):
    """(lower-cased words, start, end) by code points."""
    ws, s, e = [], [], []
    for m in TOKEN.finditer(text):
        ws.append(m.group(0).lower())
        s.append(m.start())
        e.append(m.end())
    return ws, s, e


def winnow(grams, window: int = WINDOW):
    """Positions of the winnowed fingerprints of a sequence of gram hashes
    (rightmost least hash of every window)."""
    n = len(grams)
    if n == 0:
        return []
    if n < window:
        return [int(np.argmin(grams))]
    out, last = [], -1
    for i in range(n - window + 1):
        w = grams[i:i + window]
        p = i + window - 1 - int(np.argmin(w[::-1]))
        if p != last:
            out.append(p)
            last = p
    return out


class Index:
    """Fingerprint -> [(template, position)] and the templates' words."""

    def __init__(self, templates: dict, gram: int = GRAM, window: int = WINDOW):
        self.gram, self.window, self.words, self.at, self.vocabulary = gram, window, {}, {}, set()
        for name, text in sorted(templates.items()):
            w = tokens(text)[0]
            self.words[name] = w
            self.vocabulary.update(w)
            grams = [tuple(w[i:i + gram]) for i in range(max(1, len(w) - gram + 1))]
            order = np.array([_hash(g) for g in grams], np.uint64)
            for p in winnow(order, window):
                self.at.setdefault(grams[p], []).append((name, p))


def _hash(gram) -> int:
    import zlib
    x = zlib.crc32(" ".join(gram).encode("utf-8"))
    return (x * 0x9E3779B97F4A7C15 + (x >> 7)) & 0xFFFFFFFFFFFFFFFF


def align(template, doc, band: int, first: int):
    """Alignment of all of ``template`` with a part of ``doc`` (doc ends are
    free) inside the band doc index - template index in [first, first + band):
    (matched words, first and last matched doc index) of the alignment with
    most matches less differences, or (0, -1, -1)."""
    m, low = len(template), -10**9
    score = np.full((m + 1, band), low)
    step = np.zeros((m + 1, band), np.int8)          # 1 pair, 2 template word left out, 3 doc word left out
    for b in range(band):
        if 0 <= first + b <= len(doc):
            score[0, b] = 0
    for i in range(1, m + 1):
        for b in range(band):
            j = i + first + b                         # doc words used
            if j < 0 or j > len(doc):
                continue
            best, how = low, 0
            if j == 0:                                # the template's head is left out before the text begins
                best, how = -i, 2
            if j >= 1 and score[i - 1, b] > low:
                best, how = score[i - 1, b] + (1 if template[i - 1] == doc[j - 1] else -1), 1
            if b + 1 < band and score[i - 1, b + 1] - 1 > best:
                best, how = score[i - 1, b + 1] - 1, 2
            if b > 0 and j >= 1 and score[i, b - 1] - 1 > best:
                best, how = score[i, b - 1] - 1, 3
            score[i, b], step[i, b] = best, how
    b = int(np.argmax(score[m]))
    if score[m, b] <= low:
        return 0, -1, -1
    i, hit = m, []
    while i > 0:
        how, j = step[i, b], i + first + b
        if how == 1:
            if template[i - 1] == doc[j - 1]:
                hit.append(j - 1)
            i -= 1
        elif how == 2 and j == 0:
            break
        elif how == 2:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return (len(hit), hit[-1], hit[0]) if hit else (0, -1, -1)


def scan_text(text: str, index: Index, percent: int):
    """[(template, words, matched, start, end)] of a whole text."""
    ws, s, e = tokens(text)
    hits: dict = {}
    inside = [w in index.vocabulary for w in ws]      # cheap filter: a fingerprint only has template words
    for p in range(len(ws) - index.gram + 1):
        if inside[p] and inside[p + 1]:
            for name, q in index.at.get(tuple(ws[p:p + index.gram]), ()):
                hits.setdefault(name, []).append((p, p - q))
    out = []
    for name, at in hits.items():
        t, seen = index.words[name], bytearray(len(ws))
        # words that may be missing, or a run inserted before it outweighs the lesser half
        wide = max(len(t) * (100 - percent) // 100, len(t) // 2) + 1
        places: dict = {}
        for p, d in at:
            places.setdefault(d, []).append(p)
        for d in sorted(places, key=lambda d: (-len(places[d]), d)):
            if all(seen[p] for p in places[d]):
                continue                              # explained by an alignment found before
            lo = max(0, d - wide)
            part = ws[lo:d + len(t) + wide]
            n, a, z = align(t, part, 2 * wide + 1, d - wide - lo)
            if n and 100 * n >= percent * len(t):
                seen[lo + a:lo + z + 1] = b"\x01" * (z - a + 1)
                out.append((name, len(t), n, s[lo + a], e[lo + z]))
    # overlapping reports of one template: the one with most matches, then the first
    best = []
    for r in sorted(out, key=lambda r: (r[0], -r[2], r[3])):
        if not any(b[0] == r[0] and b[3] < r[4] and r[3] < b[4] for b in best):
            best.append(r)
    return sorted(best, key=lambda r: (r[3], r[0]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None,
                 percent: int = 80, max_templates: int = 10_000) -> DataFrame:
    """One row per find: (doc_id, license, n_words, n_matched, start, end):
    at least ``percent`` % of a template's words aligned, span in code points.

    Null and empty texts have no finds; repeated rows give repeated finds;
    null ids stay null; an empty table gives none. ``templates`` (name ->
    text, English in TEMPLATES by default) is a given list of at most
    ``max_templates``; more is an error."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > max_templates:
        raise ValueError("too many templates for an index carried by the tasks")
    prepare(docs.sparkSession)

    def run(frames):
        index = Index(templates)
        for pdf in frames:
            rows = [(doc, *r) for doc, text in zip(pdf["doc_id"], pdf["text"]) for r in scan_text(text, index, percent)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "n_words", "n_matched", "start", "end"])
            yield out
    text = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text.where("text <> ''").mapInPandas(
        run, "doc_id string, license string, n_words long, n_matched long, start long, end long").withColumn(
            "doc_id", F.col("doc_id").cast("long"))
