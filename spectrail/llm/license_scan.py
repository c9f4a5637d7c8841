"""Licence notices in texts: exact phrases by words, and short notices with a bounded number of errors.

A text is put into normal form: ASCII letters in lower case, and each run of other ASCII characters than letters and
digits as one space. A notice that may have k errors is split into k + 1 parts: by the pigeonhole principle one of them
occurs unchanged, so an automaton over all parts finds every place where the notice can be. Around each such seed the
regex library matches the notice with at most k insertions, deletions or substitutions and reports the span.

Errors of a notice: one for each 12 characters, 1 at least. The window around a seed holds the whole notice and k more
characters on either side, so every match lies in the window of one of its seeds. Matches of a notice don't overlap: that
with the fewest errors comes first, of equals the leftmost; a window that a match has taken from is searched again in what
is left of it. So the matches are those of a search of the whole text for the best match, and then for the best of what
lies before and after it; but no search is longer than a window, and the time grows with the text.

Defined cases: null and empty texts have no words, no labels and score 0; a text of any length is scanned whole; repeated
rows are scanned alike; of matches of one notice that tie, the leftmost is kept; a null id stays null; an empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NORMAL

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening words of short notices, and the labels that they get when found with errors or without.
NOTICES = {
    "released under the mit license": "notice-mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "notice-mit",
    "licensed under the apache license version 2 0": "notice-apache-2",
    "licensed under cc by nc 4 0": "notice-cc-by-nc-4",
    "this work is licensed under the gnu general public license": "notice-gpl",
    "subject to the terms of the mozilla public license": "notice-mpl",
    "redistribution and use in source and binary forms with or without modification": "notice-bsd",
    "licensed under a creative commons attribution": "notice-cc",
    "this is free and unencumbered software released into the public domain": "notice-unlicense",
    "all rights reserved no part of this": "notice-reserved",
}

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
MATCH = "struct<label:string,first_word:long,last_word:long,start:long,stop:long,errors:int>"


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]) -> None:
        self.phrases = [(f" {p} ".encode(), label, p.count(" ")) for p, label in phrases.items()]
        self.notices = []
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        self.seeds = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for notice, label in notices.items():
            k = max(1, len(notice) // 12)
            self.notices.append((label, len(notice), k, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")))
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((len(self.notices) - 1, b))
        for seed, places in seeds.items():
            self.seeds.add_word(seed, places)
        self.seeds.make_automaton()

    def exact(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, last word) of each place of each phrase."""
        line, found, begins = b" " + b" ".join(words) + b" ", [], None
        for phrase, label, more in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                if begins is None:  # where each word's space is
                    begins = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
                first = bisect.bisect_left(begins, at)
                found.append((label, first, first + more))
                at = line.find(phrase, at + 1)
        return found

    def best(self, n: int, part: str) -> tuple[int, int, int] | None:
        """(errors, start, end) of the best match of a notice in a short part of a text, the leftmost of equals."""
        if (n, part) not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            m = self.notices[n][3].search(part)
            self.known[n, part] = m and (sum(m.fuzzy_counts), m.start(), m.end())
        return self.known[n, part]

    def fuzzy(self, line: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, errors, notice length) of the notices in a text in normal form."""
        starts: dict[int, set[int]] = {}
        for end, places in self.seeds.iter(line):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - offset)
        found = []
        for n, own in starts.items():
            label, size, k, _ = self.notices[n]
            queue: list[tuple[int, int, int, int, int]] = []

            def search(a: int, b: int, n: int = n, least: int = size - k, queue: list = queue) -> None:
                if b - a >= least and (m := self.best(n, line[a:b])):
                    heapq.heappush(queue, (m[0], a + m[1], a + m[2], a, b))

            for start in own:
                search(max(0, start - k), min(len(line), start + size + k))
            taken: list[tuple[int, int]] = []
            while queue:
                errors, start, end, a, b = heapq.heappop(queue)
                near = taken[max(0, bisect.bisect_left(taken, (a, a)) - 1) : bisect.bisect_left(taken, (b, b))]
                near = [x for x in near if x[1] > a]
                if all(y <= start or x >= end for x, y in near):
                    bisect.insort(taken, (start, end))
                    found.append((label, start, end, errors, size))
                else:
                    for x, y in zip([a, *(y for _, y in near)], [*(x for x, _ in near), b], strict=True):
                        search(x, y)
        return found

    def scan(self, text: str) -> tuple[int, list[tuple], list[tuple], float]:
        """Words, base matches and notice matches (label, words, code points, errors), and the best score."""
        words = text.encode("utf-8", "surrogatepass").translate(NORMAL).split()
        base = self.exact(words)
        line = b" ".join(words).decode("utf-8", "surrogatepass")
        near = self.fuzzy(line)
        if not base and not near:
            return len(words), [], [], 0.0
        spans = [m.span() for m in WORD.finditer(text)]
        place = lambda label, a, b, errors: (label, a, b, spans[a][0], spans[b][1], errors)
        score = max([1.0] * bool(base) + [1 - errors / size for *_, errors, size in near])
        notices, begins = [], [0, *(m.end() for m in re.finditer(" ", line))] if near else []
        for label, start, stop, errors, _ in near:
            stop = max(start + 1, stop)
            while stop - 1 > start and line[stop - 1] == " ":
                stop -= 1
            while start < stop - 1 and line[start] == " ":
                start += 1
            notices.append(place(label, bisect.bisect_right(begins, start) - 1, bisect.bisect_right(begins, stop - 1) - 1, errors))
        return len(words), sorted(place(*x, 0) for x in base), sorted(notices), score


@functools.lru_cache(4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(notices))


def scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, phrases and notices (label, words, code points, errors) and score, 1 less the share of errors."""
    given = tuple(phrases.items()), tuple(notices.items())
    kind = pa.list_(pa.struct([("label", pa.string()), *((x, pa.int64()) for x in ("first_word", "last_word", "start", "stop")), ("errors", pa.int32())]))
    fields = [f.name for f in kind.value_type]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(*given)
        for b in batches:
            rows = [own.scan(x.as_py()) for x in b.column(1)]
            lists = [pa.array([[dict(zip(fields, m, strict=True)) for m in r[k]] for r in rows], kind) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), *lists, pa.array([r[3] for r in rows], pa.float64())], ["doc_id", "n_words", "phrases", "notices", "score"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scanned, f"doc_id long, n_words long, phrases array<{MATCH}>, notices array<{MATCH}>, score double")
