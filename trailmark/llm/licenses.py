"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens, chained into spans."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases and labels of the contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Characteristic passages of public licences, as their texts or usual notices have them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license"),
    ("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    *((f"cc-by-{x.replace(' ', '-')}", f"licensed under cc by {x} 4 0") for x in ("sa", "nc", "nd", "nc sa", "nc nd")),
)
#: Words of a match that may be chained; words of the text that may lie between two matches; share of a template that a span covers.
LEAST, GAP, SHARE = 4, 8, 0.5
#: Makes separators of everything but ASCII letters and digits and of bytes beyond ASCII; lower-cases A-Z.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Automaton:
    """A suffix automaton of several token sequences. A state knows where its strings end in which sequences."""

    def __init__(self, sequences: list[tuple[int, list[int]]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [set()]
        for owner, tokens in sequences:
            last = 0
            for i, t in enumerate(tokens):
                last = self._add(last, t)
                self.ends[last].add((owner, i + 1))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.size[s]):
            if self.size[self.link[s]] >= least:  # shorter strings are never asked for
                self.ends[self.link[s]] |= self.ends[s]
        # What each state's suffixes add: (size of the longest one, owner, its ends) for owners that no longer string has.
        self.more: list[list[tuple[int, int, list[int]]]] = [[] for _ in self.link]
        for s in range(1, len(self.link)):
            seen, at = set(), s
            while at > 0 and self.size[at] >= least:
                here: dict[int, list[int]] = {}
                for o, e in self.ends[at]:
                    if o not in seen:
                        here.setdefault(o, []).append(e)
                self.more[s] += [(self.size[at], o, sorted(e)) for o, e in sorted(here.items())]
                seen |= here.keys()
                at = self.link[at]

    def _state(self, size: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.link) - 1

    def _copy(self, p: int, q: int, t: int) -> int:
        c = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _add(self, last: int, t: int) -> int:
        if (q := self.next[last].get(t)) is not None:  # another sequence has it already
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, q, t)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, t)
        return new

    def matches(self, tokens: list[int], least: int) -> dict[int, list[tuple[int, int, list[int]]]]:
        """For each sequence its longest matches: start and end of those of `least` tokens or more that can't be extended, and
        where the sequence has their ends. A sequence that holds only a suffix of another's match has a match of its own."""
        out: dict[int, list[tuple[int, int, list[int]]]] = {}
        open_: dict[int, tuple[int, list[int]]] = {}  # matches that end at the last token: their sizes and ends
        s = n = 0
        for i, t in enumerate([*tokens, None]):
            while s and t not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if t in self.next[s]:
                s, n = self.next[s][t], n + 1
            now = {o: (min(size, n), ends) for size, o, ends in self.more[s] if min(size, n) >= least} if n >= least else {}
            for o, (size, ends) in open_.items():
                if o not in now or now[o][0] != size + 1:
                    out.setdefault(o, []).append((i - size, i, ends))
            open_ = now
        return out


def chains(found: list[tuple[int, int, list[int]]], gap: int) -> list[tuple[int, int, int]]:
    """Covered template words, start and end in the text of the best chain from each first match, best ones first.

    found: matches of one template, by end: start and end in the text, and their ends in the template. A chain's matches
    rise in the text and in the template, at most `gap` words apart in the text; where two overlap, in either, the words
    that they share count once. So repeats, and passages out of order, cover no more than one of them.
    """
    parts = sorted((a, e - (b - a), b - a) for a, b, ends in found for e in ends)
    best: list[tuple[int, int]] = []  # covered, first match
    near = 0
    longest = max((n for _, _, n in parts), default=0)
    for i, (a, t, n) in enumerate(parts):
        while parts[near][0] + longest + gap < a:
            near += 1
        top = (n, -i)
        for j in range(near, i):
            pa, pt, pn = parts[j]
            if pa < a and pt < t and a - (pa + pn) <= gap:
                gain = n - max(0, pa + pn - a, pt + pn - t)
                if gain > 0:
                    top = max(top, (best[j][0] + gain, best[j][1]))
        best.append(top)
    ends: dict[int, tuple[int, int]] = {}
    for i, (covered, first) in enumerate(best):
        ends[first] = max(ends.get(first, (0, 0)), (covered, -i))
    return sorted(((c, parts[-first][0], parts[-i][0] + parts[-i][2]) for first, (c, i) in ends.items()), key=lambda x: (-x[0], x[1], x[2]))


class LicenseScanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, least: int = LEAST, gap: int = GAP, share: float = SHARE):
        self.least, self.gap, self.share, self.templates = least, gap, share, templates
        self.ids: dict[bytes, int] = {}
        number = lambda x: [self.ids.setdefault(w, len(self.ids) + 1) for w in x.encode().split()]
        self.phrases = [(number(p), label) for p, label in phrases]
        tokens = [number(x) for _, x in templates]
        self.sizes = [len(x) for x in tokens]
        self.automaton = Automaton(list(enumerate(tokens)), least)

    def scan(self, text: str | None) -> dict:
        """n_words; places (start, label) of the phrases; spans (start, end, label, share of the template covered)."""
        found = text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
        places = []
        for p, label in self.phrases:
            at = np.flatnonzero(ids[: len(ids) - len(p) + 1] == p[0]) if len(ids) >= len(p) else np.zeros(0, np.int64)
            for k in range(1, len(p)):
                at = at[ids[at + k] == p[k]]
            places += [(int(i), label) for i in at]
        # A match stays within a run of known words: only runs that are long enough are streamed through the automaton.
        known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        parts: dict[int, list[tuple[int, int, list[int]]]] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.least:
                for o, ms in self.automaton.matches(ids[a:b].tolist(), self.least).items():
                    parts.setdefault(o, []).extend((a + x, a + y, ends) for x, y, ends in ms)
        return {"n_words": len(found), "places": sorted(places), "spans": self._spans(parts)}

    def _spans(self, parts: dict[int, list[tuple[int, int, list[int]]]]) -> list[tuple[int, int, str, float]]:
        """Chains that cover enough of their template. Of chains that overlap in the text the one of the larger share stays, of
        equal shares the one that covers more words, then the one whose template comes first."""
        all_ = []
        for o, found in parts.items():
            if sum(b - a for a, b, _ in found) >= self.share * self.sizes[o]:
                all_ += [(-c / self.sizes[o], -c, o, start, end) for c, start, end in chains(found, self.gap) if c >= self.share * self.sizes[o]]
        starts: list[int] = []
        taken: list[tuple[int, int, str, float]] = []
        for share, _, o, start, end in sorted(all_):
            at = bisect.bisect_left(starts, start)
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                starts.insert(at, start)
                taken.insert(at, (start, end, self.templates[o][0], -share))
        return taken


def scan_licenses(docs: DataFrame, scanner: LicenseScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (start, label), spans (start, end, label, share): a row for each row, without a shuffle.

    Null and empty texts have no words; null ids and repeated rows stay; other columns are ignored; an empty table gives an
    empty one. Whole texts are streamed; a long text costs its words and its matches.
    """
    scanner = scanner or LicenseScanner()
    place, span = pa.struct([("start", pa.int64()), ("label", pa.string())]), pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scanner.scan(x.as_py()) for x in batch.column(1)]
            places = [[{"start": a, "label": b} for a, b in m["places"]] for m in made]
            spans = [[{"start": a, "end": b, "label": c, "share": d} for a, b, c, d in m["spans"]] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m["n_words"] for m in made], pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "places", "spans"])

    schema = "doc_id long, n_words long, places array<struct<start:bigint,label:string>>, spans array<struct<start:bigint,end:bigint,label:string,share:double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns. score: 1 with a base phrase, else the largest share of a template that a span covers."""
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    n = F.size("places").cast("long")
    return scanned.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
