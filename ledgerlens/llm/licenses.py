"""Licence notices in documents, found by conditional compression.

A notice is a stretch of words that holds a template's key words and differs
from its wording in at most a fifth of its words. So wherever a notice is, the
words around its first key word hold nearly all of the template's: these places
are the candidate blocks, and no notice lies outside them. Each block is
compressed alone and with every template as a raw zstandard dictionary, which
ranks the templates by the bytes that they save. The ranking decides: down the
ranking, the stretch that differs least from a template is found exactly, and
the first template whose wording that stretch has, but for a fifth, is the
notice (of templates that save the same, the one that differs least). So a long
notice with a few words changed is found as such, and not as the short one that
it holds unchanged. The text before and after the notice's words is then
searched in the same way, so neighbouring notices are all found. Blocks repeat a
lot, so each worker remembers its answers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_parts

# Wordings of notices as their licensors publish them, with the words that tell them apart (the least common one first).
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "This project is licensed under the terms of the MIT license."),
    ("MIT", "permission granted free charge", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu general public 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general public 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser general public 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero general public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "bsd 3 clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "mozilla public 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "creative commons attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "creative commons attribution sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0 1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("ISC", "permission fee provided", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "eclipse public 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "boost 1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("all-rights-reserved", "reserved all rights", "All rights reserved."),
]
#: Short forms of the same kind.
SHORT_FORMS: list[tuple[str, str, str]] = [
    ("MIT", "mit", "Released under MIT."),
    ("MIT", "mit", "License: MIT"),
    ("Apache-2.0", "apache 2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "bsd 2 clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "bsd 3 clause", "BSD 3-Clause License"),
    ("GPL-2.0", "gpl v2", "GNU GPL v2"),
    ("GPL-3.0", "gpl v3", "GNU GPL v3"),
    ("GPL-2.0", "gplv2", "Licensed under the GPLv2"),
    ("GPL-3.0", "gplv3", "Licensed under the GPLv3"),
    ("ISC", "isc", "ISC License"),
]
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_CUT = re.compile(r"\n+|(?<=[.!?;:])\s+(?!\d)")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: A line that names a licence by its short name, for every licence above.
TEMPLATES += [(name, "spdx identifier " + " ".join(wording(name)), f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(t[0] for t in (*TEMPLATES, *SHORT_FORMS)) if name != "all-rights-reserved"]

#: Largest share of words that may differ, of the template's words.
DIFFERENT = 0.2
#: Words of a block that are searched at once, in lengths of the longest notice.
PIECE = 8


class Scanner:
    """Templates as dictionaries, with a bounded memo of blocks."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...], memo: int = 50_000):
        self.templates = [(name, key.split(), wording(text)) for name, key, text in templates]
        self.sets = [(frozenset(key), frozenset(words), int(DIFFERENT * len(words))) for _, key, words in self.templates]
        options = {"level": 19, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = []
        for _, _, text in templates:
            raw = " ".join(wording(text)).encode()
            given = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(dict_data=given, **options))
        #: Words that each notice may cover, and the longest.
        self.reach = [len(words) + different for (_, _, words), (_, _, different) in zip(self.templates, self.sets)]
        self.longest = max(self.reach)
        self.anchors: dict[str, list[int]] = {}
        for n, (_, key, _) in enumerate(self.templates):
            self.anchors.setdefault(key[0], []).append(n)
        self.anchor = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, self.anchors)) + r")(?![^\W_])", re.IGNORECASE)
        self.match = lru_cache(maxsize=memo)(self._match)

    def may_hold(self, words: set[str] | frozenset[str], number: int) -> bool:
        """False only if a stretch of these words cannot be the numbered notice."""
        key, own, different = self.sets[number]
        return key <= words and len(own - words) <= different

    def candidate_blocks(self, text: str) -> list[tuple[int, int]]:
        """Spans around first key words whose neighbourhood may hold a notice; overlapping ones are one."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        found: list[list[int]] = []
        for hit in self.anchor.finditer(text):
            numbers = self.anchors.get(hit[0].lower(), ())
            reach = max((self.reach[n] for n in numbers), default=0)
            at = _around(text, hit.start(), hit.end(), reach)
            words = {text[p:q].lower() for p, q in at}
            if any(self.may_hold(words, n) for n in numbers):
                if found and at[0][0] <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], at[-1][1])
                else:
                    found.append([at[0][0], at[-1][1]])
        return [(a, b) for a, b in found]

    def saved(self, block: tuple[str, ...], numbers: list[int]) -> list[int]:
        """Bytes of the block's compressed size that each of the numbered templates saves."""
        raw = " ".join(block).encode("utf-8", "surrogatepass")
        plain = len(self.alone.compress(raw))
        return [plain - len(self.given[n].compress(raw)) for n in numbers]

    def _match(self, block: tuple[str, ...]) -> tuple[tuple[str, int, int, int], int, int] | None:
        """The best notice of a block, and its first word and the one after its last; None without one.

        A notice is: licence, bytes saved, and the words missing from and added to the template's wording.
        """
        held = frozenset(block)
        numbers = [n for n in range(len(self.templates)) if self.may_hold(held, n)]
        if not numbers:
            return None
        ranked = sorted(zip(self.saved(block, numbers), numbers), key=lambda x: (-x[0], x[1]))
        for saved, tied in groupby(ranked, key=lambda x: x[0]):
            fits = []
            for _, number in tied:
                name, key, words = self.templates[number]
                found = alignment(words, block, key, self.sets[number][2])
                if found:
                    missing, added, first, last = found
                    fits.append(((missing + added) / len(words), number, (name, saved, missing, added), first, last))
            if fits:
                return min(fits)[2:]
        return None

    def notices(self, words: tuple[str, ...]) -> list[tuple[int, int, tuple[str, int, int, int]]]:
        """All notices of a run of words, in order: first word, the one after the last, and the notice."""
        out, todo = [], [(0, len(words))]
        while todo:
            a, b = todo.pop()
            hit = self.match(words[a:b]) if a < b else None
            if hit:
                notice, first, last = hit
                out.append((a + first, a + last, notice))
                todo += [(a, a + first), (a + last, b)]
        return sorted(out)


def _around(text: str, begin: int, end: int, reach: int) -> list[tuple[int, int]]:
    """Spans of the word at ``begin`` and of ``reach`` words before and after it, as far as the text goes."""
    size = 12 * reach
    while True:
        a, b = max(0, begin - size), min(len(text), end + size)
        at = [m.span() for m in _WORD.finditer(text, a, b)]
        # words at the edges may be cut off
        if a:
            at = [x for x in at if x[0] > a + 1]
        if b < len(text):
            at = [x for x in at if x[1] < b - 1]
        here = bisect_right(at, (begin, len(text))) - 1
        if (here >= reach or not a) and (len(at) - here > reach or b == len(text)):
            return at[max(0, here - reach) : here + reach + 1]
        size *= 4


def alignment(template: list[str], block: tuple[str, ...] | list[str], key: list[str] = (), different: int | None = None) -> tuple[int, int, int, int] | None:
    """The stretch of the block that differs least from the template and has all key words: words missing, words added, its first word and the one after its last.

    Differences are words to take out of the template or to put in; a stretch
    with more than ``different`` of them is no answer.
    """
    size, count = len(block), len(template)
    numbers = {w: k for k, w in enumerate(dict.fromkeys(template))}
    own = np.array([numbers.get(w, -1) for w in block], np.int64)
    at, one = np.arange(size + 1), size + 1
    # differences so far, then the first word of the stretch, in one number: of equal costs the longest stretch stays
    best = at
    for word in template:
        taken = best + one  # the word is missing
        hit = np.flatnonzero(own == numbers[word]) + 1
        taken[hit] = np.minimum(taken[hit], best[hit - 1])
        best = np.minimum.accumulate(taken - at * one) + at * one  # words of the block are added behind it
    cost, start = best // one, best % one
    length = at - start
    missing = (count + cost - length) // 2
    limit = count if different is None else different
    wanted = set(key)
    ends = np.flatnonzero((cost <= limit) & (length > 0))
    for end in ends[np.lexsort((ends, missing[ends], cost[ends]))].tolist():
        first = int(start[end])
        if wanted.issubset(block[first:end]):
            return int(missing[end]), int(cost[end] - missing[end]), first, end
    return None


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str, str], ...]) -> Scanner:
    return Scanner(templates)


def scan_text(text: str, own: Scanner) -> list[tuple[int, int, str, int, int, int]]:
    """Confirmed notices of a text: begin, end, licence, bytes saved, words missing, words added.

    Blocks of any length are searched piece by piece; pieces overlap by the
    longest notice. A notice spans its sentences, as far as no other notice lies in them.
    """
    hits: list[tuple[int, int, tuple[str, int, int, int]]] = []
    for a, b in own.candidate_blocks(text):
        at = [m.span() for m in _WORD.finditer(text, a, b)]
        words = tuple(text[p:q].lower() for p, q in at)
        begin = 0
        while begin < len(words):
            end = min(len(words), begin + PIECE * own.longest)
            stop = end if end == len(words) else end - own.longest
            for first, last, notice in own.notices(words[begin:end]):
                if begin + first < stop or end == len(words):
                    hits.append((at[begin + first][0], at[begin + last - 1][1], notice))
                    stop = max(stop, begin + last)
            begin = stop
    if not hits:
        return []
    edges = [0, *(x for m in _CUT.finditer(text) for x in m.span()), len(text)]
    begins, ends = edges[::2], edges[1::2]
    found = []
    for k, (begin, end, notice) in enumerate(hits):
        p = begins[bisect_right(begins, begin) - 1]
        q = ends[bisect_left(ends, end)]
        if k:
            p = max(p, hits[k - 1][1])
        if k + 1 < len(hits):
            q = min(q, hits[k + 1][0])
        found.append((p, q, *notice))
    return found


def licence_blocks(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple[tuple[str, str, str], ...] = (*TEMPLATES, *SHORT_FORMS)) -> DataFrame:
    """Confirmed licence blocks: id, block (number in the text, from 0), begin, end, license, saved, missing, added.

    Null and empty texts have no blocks; texts are read whole; repeated rows
    report their blocks each; a null id is kept; other columns are ignored. An
    empty table gives an empty result.
    """
    names = ["i", "block", "begin", "end", "license", "saved", "missing", "added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(templates)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(t for _, part in text_parts(batch, "t") for t in part):
                for number, hit in enumerate(scan_text(text, own)):
                    at.append(k)
                    rows.append((number, *hit))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(run, f"i {kind}, block int, begin long, end long, license string, saved int, missing int, added int")
    return out.withColumnRenamed("i", id_column)
