"""Licence scan by a generalised suffix automaton.

The automaton holds the tokens of all licence templates. A text is streamed
through it once; the matching statistics give, for each word, the longest run of
words ending there that occurs in a template. Long runs of one template are
chained into spans, and what a chain covers of its template decides the label.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from itertools import chain, pairwise, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_texts

#: Phrases whose every occurrence gives a label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, notice). Short notices as authors put them into files.
TEMPLATES = [
    ("agpl", "gnu affero general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "licensed under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
#: A run counts from this many words on; runs of a template chain over gaps of at most GAP words.
MIN_RUN, GAP = 4, 8
#: A chain gives its label if it covers this share of the template.
COVER = 0.6
#: Lower-cases A-Z, and turns what is no letter, digit or non-ASCII byte into a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class SuffixAutomaton:
    """Of several token lists; a state knows the first place (template, end) for each template that its strings occur in."""

    def __init__(self, lists: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for k, tokens in enumerate(lists):
            last = 0
            for i, x in enumerate(tokens):
                last = self._extend(last, x)
                self.ends[last].setdefault(k, i + 1)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[v]]
            for k, i in self.ends[v].items():
                up[k] = min(i, up.get(k, i))

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, x: int) -> int:
        q = self.next[p][x]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = twin
            p = self.link[p]
        return twin

    def _extend(self, p: int, x: int) -> int:
        if x in self.next[p]:
            return self._split(p, x)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x)
        return new

    def statistics(self, tokens: Iterable[int]):
        """For each token: length of the longest match that ends there, and its state."""
        v = n = 0
        for x in tokens:
            while v and x not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if x in self.next[v]:
                v, n = self.next[v][x], n + 1
            yield n, v


@cache
def _model():
    lists = [t.encode().split() for _, t in TEMPLATES]
    ids = {w: i for i, w in enumerate(sorted({w for t in lists for w in t}))}
    return ids, [len(t) for t in lists], SuffixAutomaton([[ids[w] for w in t] for t in lists])


def covered_spans(words: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(template, first word, end word, words covered) of each chain that covers COVER of its template.

    Only maximal runs count: the match of a word that no longer match of the
    next word extends. Words in no template cannot be in a run, so runs of known
    words are all that the automaton needs to see.
    """
    ids, sizes, automaton = _model()
    known = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).astype(np.int8), [0]))))
    open_: dict[int, list[int]] = {}
    done = []
    for a, b in edge.reshape(-1, 2):
        if b - a < MIN_RUN:
            continue
        stats = automaton.statistics(known[a:b].tolist())
        for end, ((n, v), (longer, _)) in enumerate(pairwise(chain(stats, [(0, 0)])), int(a) + 1):
            if n < MIN_RUN or longer == n + 1:
                continue
            for k, t_end in automaton.ends[v].items():
                c = open_.get(k)  # template end, first, end, covered
                if c and end > c[2] and end - n - c[2] <= GAP and t_end > c[0]:
                    new = min(n, t_end - c[0], end - c[2])
                    open_[k] = [t_end, c[1], end, c[3] + new]
                else:
                    if c:
                        done.append((k, *c[1:]))
                    open_[k] = [t_end, end - n, end, n]
    done += [(k, *c[1:]) for k, c in open_.items()]
    return sorted(x for x in done if x[3] >= COVER * sizes[x[0]])


def scan(text: bytes) -> tuple:
    words = text.translate(FOLD).split()
    n, first, last, total, base = len(words), None, None, 0, set()
    if b"license" in words or b"cc" in words:
        line = b" " + b" ".join(words) + b" "
        for phrase, label in PHRASES.items():
            key, at, i = b" " + phrase.encode() + b" ", 0, 0
            while (to := line.find(key, at)) >= 0:
                i += line.count(b" ", at, to)  # the words so far, carried on
                at = to
                first, last, total = min(i, i if first is None else first), max(i, i if last is None else last), total + 1
                base.add(label)
                at, i = to + 1, i + 1
    spans = covered_spans(words)
    own = {TEMPLATES[k][0] for k, *_ in spans}
    best = max([c / len(TEMPLATES[k][1].split()) for k, _, _, c in spans], default=0.0)
    score = min(1.0, max(best, 0.5 if base else 0.0))
    return n, total, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), score, ",".join(f"{TEMPLATES[k][0]}:{a}:{b}" for k, a, b, _ in spans)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def _scan_all(texts: list[bytes]) -> dict:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    return dict(zip(names, zip(*map(scan, texts), strict=True) if texts else [[] for _ in names], strict=True))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: phrase counts, ``labels``, ``score`` and ``spans`` (label:first:end in words).

    ``score``: the largest share of a template that a chain covers, at least 0.5
    where a base phrase stands, 0 without labels. Null and empty texts have no
    words, no labels and null places. Repeated rows give repeated rows, an empty
    table an empty one. Time is linear in the length of a text, also of one that
    is nothing but phrases.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(slim, _scan_all, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {COLUMNS}", keep=["doc_id"])
