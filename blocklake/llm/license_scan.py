"""License scans: fuzzy short-notice search.

A notice is a short phrase with a number of edits it may carry. By the pigeonhole
principle a phrase cut into edits + 1 pieces keeps one piece whole, so exact
finds of the pieces locate all candidates; the regex library's bounded-error
matching then verifies the window around them and reports the span.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklake.llm.common import map_rows, utf8


@dataclass(frozen=True)
class Notice:
    """A phrase of a license. edits: insertions, deletions and substitutions of characters it may carry;
    fixed: words that a match must hold unchanged (the name, a version), or another license would match."""

    label: str
    phrase: str
    edits: int
    fixed: tuple[str, ...]
    base: bool = False


#: The base notices come first; the others are the method's own.
NOTICES = (
    Notice("mit", "under the mit license", 2, ("mit",), True),
    Notice("apache-2", "apache license version 2", 2, ("apache", "2"), True),
    Notice("cc-by-nc", "cc by nc", 0, ("cc", "by", "nc"), True),
    Notice("gpl-3", "gnu general public license version 3", 3, ("gnu", "3")),
    Notice("gpl-2", "gnu general public license version 2", 3, ("gnu", "2")),
    Notice("mpl-2", "mozilla public license version 2", 3, ("mozilla", "2")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4, ("noncommercial",)),
    Notice("bsd", "redistribution and use in source and binary forms", 4, ("binary", "source")),
)

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start_word:long,end_word:long,edits:int,text:string>>"

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """phrase cut into edits + 1 pieces of nearly equal length, with their offsets."""
    n, k = len(phrase), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds notices in one text; built once per task. The time is in proportion to the text and its seeds."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        # a match stands between spaces; from a given start, (?b) finds the one with the fewest edits
        verify = lambda n: regex.compile(rf"(?b)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?![^ ])") if n.edits else None
        self.notices = [(n, [(at, seed.encode()) for at, seed in pieces(n.phrase, n.edits)], verify(n)) for n in notices]

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_SPLIT).split()
        norm = b" %b " % b" ".join(words)
        places, base, labels, found, score = [], set(), set(), [], 0.0
        spaces: np.ndarray | None = None
        for notice, seeds, pattern in self.notices:
            hits: list[tuple[int, int, int, str]] = []  # start, end in bytes, edits, text
            if notice.base or pattern is None:
                exact, at = b" %b " % notice.phrase.encode(), -1
                while (at := norm.find(exact, at + 1)) >= 0:
                    hits.append((at + 1, at + len(exact) - 1, 0, notice.phrase))
            whole = len(hits)
            if pattern is not None:
                hits += self._fuzzy(norm, notice, seeds, pattern)
            if not hits:
                continue
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            first = (np.searchsorted(spaces, [h[0] for h in hits]) - 1).tolist()
            last = np.searchsorted(spaces, [h[1] for h in hits]).tolist()
            labels.add(notice.label)
            if notice.base and whole:
                places += first[:whole]
                base.add(notice.label)
            score = max(score, 1 - min(h[2] for h in hits) / len(notice.phrase))
            skip = whole if pattern is not None else 0  # the fuzzy search has found these as well
            found += [(notice.label, *x) for x in self._apart(list(zip(first[skip:], last[skip:], [h[2] for h in hits[skip:]], [h[3] for h in hits[skip:]], strict=True)), pattern is None)]
        matches = [dict(zip(("label", "start_word", "end_word", "edits", "text"), x, strict=True)) for x in sorted(found)]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, matches

    @staticmethod
    def _apart(hits: list[tuple[int, int, int, str]], overlapping: bool) -> list[tuple[int, int, int, str]]:
        """Of hits that share a word, the one with the fewest edits, then the first."""
        if overlapping:
            return hits
        taken, out = set(), []
        for hit in sorted(hits, key=lambda h: (h[2], h[0], h[1])):
            if taken.isdisjoint(range(hit[0], hit[1])):
                taken.update(range(hit[0], hit[1]))
                out.append(hit)
        return out

    @staticmethod
    def _fuzzy(norm: bytes, notice: Notice, seeds: list[tuple[int, bytes]], pattern: regex.Pattern) -> list[tuple[int, int, int, str]]:
        """The best match from every word that a seed allows as its start, if it holds the fixed words."""
        length, edits, starts = len(notice.phrase), notice.edits, set()
        for offset, seed in seeds:
            at = -1
            while (at := norm.find(seed, at + 1)) >= 0:
                low, high = max(0, at - offset - 4 * edits - 1), at - offset + 4 * edits  # an edit can cost up to four bytes
                while (low := norm.find(b" ", low, high)) >= 0:
                    low += 1
                    starts.add(low)
        out, fixed, exact = [], set(notice.fixed), notice.phrase.encode() + b" "
        most = length + edits + 1  # one more than a match can have, so that what follows it is seen
        for start in starts:
            if norm.startswith(exact, start):
                out.append((start, start + len(exact) - 1, 0, notice.phrase))
                continue
            window = norm[start : start + 4 * most].decode("utf-8", "replace")
            m = pattern.match(window, 0, most)
            if m and not fixed.issubset(m.group().split()):  # a worse one from here may hold the fixed words
                ends = [i for i in range(max(1, length - edits), min(most, len(window))) if window[i] == " "]
                worse = [x for x in (pattern.fullmatch(window, 0, i) for i in ends) if x and fixed.issubset(x.group().split())]
                m = min(worse, key=lambda x: sum(x.fuzzy_counts), default=None)
            if m:
                hit = m.group().rstrip(" ")
                out.append((start, start + len(hit.encode()), sum(m.fuzzy_counts), hit))
        return out


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of docs: key, counts, labels, score and the matches with their spans in words.

    Other columns of docs are left out, so their names can't clash. A null text is empty: no words, null
    places, empty labels, score 0. Equal rows give equal rows. No shuffle: each text is scanned where it is read.
    """
    columns = docs.select(F.col(key).alias("key"), utf8(F.col(text)).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(columns, lambda s, k, t: (k, *s.scan(t)), f"key {kind}, {SCHEMA}", lambda: Scanner(notices)).withColumnRenamed("key", key)
