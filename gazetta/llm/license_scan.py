"""Fuzzy search for short license notices.

A notice that may differ in k places is split into k + 1 pieces, of which one must
then stand unchanged. An automaton finds all pieces of all notices in one pass over
a text; around each hit the regex library matches the whole notice with at most k
errors and says where it stands and how many there are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gazetta.llm.common import lean, table

#: Phrases of the base rules with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices in lower case without punctuation, their labels, and the errors
#: (characters put in, left out or changed) that each may have.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("this program is free software you can redistribute it and or modify it", "gpl", 6),
    ("apache license", "apache", 1),
    ("licensed under the apache license version", "apache", 3),
    ("mit license", "mit", 1),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7),
    ("bsd 3 clause license", "bsd", 1),
    ("bsd 2 clause license", "bsd", 1),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("creative commons zero", "cc0", 1),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons attribution noderivatives", "cc-by-nd", 3),
    ("gnu free documentation license", "gfdl", 2),
    ("boost software license", "bsl", 2),
    ("python software foundation license", "psf", 3),
    ("european union public licence", "eupl", 2),
    ("sil open font license", "ofl", 2),
    ("open database license", "odbl", 2),
    ("common development and distribution license", "cddl", 3),
    ("the artistic license", "artistic", 1),
    ("this software is provided as is without any express or implied warranty", "zlib", 6),
    ("the software is provided as is without warranty of any kind express or implied", "mit", 6),
)

#: Lower case for A-Z; what isn't a letter, digit or beyond ASCII separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of a notice, of lengths that differ by one at most, with their places."""
    n = errors + 1
    edge = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


def _space(line: str, at: int) -> int:
    """The next space, or the end."""
    found = line.find(" ", at)
    return found if found >= 0 else len(line)


class Finder:
    """The automaton of all pieces and the pattern of each notice."""

    def __init__(self, notices=NOTICES, phrases=None):
        self.notices, self.phrases = notices, phrases or PHRASES
        own: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, errors) in enumerate(notices):
            for at, piece in pieces(notice, errors):
                own.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in own.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}(?![^ ])") for n, _, k in notices]
        self.exact = [(f" {p} ", label) for p, label in self.phrases.items()]

    def windows(self, line: str) -> Iterator[tuple[int, int, int]]:
        """Notice, start and end of the stretches that a notice around a found piece can cover, in whole words, joined where they overlap.

        A search in a stretch takes its end for the text's, so a stretch that ended
        inside a word would find notices that the text doesn't have.
        """
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(line):
            start = end - size + 1
            for i, at in where:
                notice, _, k = self.notices[i]
                found.setdefault(i, []).append((max(0, line.rfind(" ", 0, max(0, start - at - k) + 1)), _space(line, start - at + len(notice) + k)))
        for i, spans in found.items():
            spans.sort()
            a, b = spans[0]
            for c, d in spans[1:]:
                if c > b:
                    yield i, a, b
                    a = c
                b = max(b, d)
            yield i, a, b

    def places(self, line: str) -> list[tuple[int, str]]:
        """Start and label of each place of a base phrase, in the line with a space at either end."""
        out = []
        for phrase, label in self.exact:
            at = line.find(phrase)
            while at >= 0:
                out.append((at + 1, label))
                at = line.find(phrase, at + 1)
        return out

    def notices_in(self, line: str) -> list[tuple[int, int, str, int, float]]:
        """Start, end, label, errors and likeness of the notices found, by start; end is exclusive."""
        out = set()
        for i, a, b in self.windows(line):
            notice, label, _ = self.notices[i]
            for m in self.patterns[i].finditer(line, a, b):
                errors = sum(m.fuzzy_counts)
                out.add((m.start(), m.end(), label, errors, 1 - errors / len(notice)))
        return sorted(out)


@lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


def scan(text: str | None, find: Finder) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans of a text."""
    words = split_words(text or "")
    line = f" {b' '.join(words).decode()} "
    base = find.places(line)
    found = find.notices_in(line)
    if not base and not found:
        return len(words), 0, None, None, "", "", 0.0, ""
    edges = list(accumulate((len(w) + 1 for w in line[1:-1].split(" ")), initial=1))  # where words start
    word_at = lambda at: bisect_right(edges, at) - 1
    starts = [word_at(at) for at, _ in base]
    own = {label for _, label in base}
    spans = ",".join(f"{label}:{word_at(a)}:{word_at(b - 1) + 1}:{errors}" for a, b, label, errors, _ in found)
    score = 1.0 if base else max((x[4] for x in found), default=0.0)
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[2] for x in found})), score, spans


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scanned(docs: DataFrame) -> DataFrame:
    """What `scan` tells of each row of docs (doc_id, text); spans: label:first word:word after:errors.

    Null and empty texts have no words and no labels, and score 0. Repeated rows
    get equal results, an empty table gives no rows, other columns are ignored.
    """
    columns = [x.split() for x in _OUT.split(", ")][1:]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            rows = [scan(t.as_py(), find) for t in batch.column(1)]
            told = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)]
            # ids don't leave Arrow, where a null leaves the others as they are
            yield pa.RecordBatch.from_arrays([batch.column(0), *told], names=["doc_id", *(name for name, _ in columns)])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(run), _OUT)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
