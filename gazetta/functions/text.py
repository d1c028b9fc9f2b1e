"""Chunks, snippets, highlights and tokens as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetta.functions.arrays import once, running
from gazetta.functions.normalize import _c, one_space

#: A token is a run of letters, digits and underscores of the lower-cased text.
TOKEN = r"[\p{L}\p{N}_]+"
#: Windows of a stretch of a text that are cut from it together.
STRETCH = 32


def chunk_texts(text: Column | str, size: int = 1200, overlap: int = 200) -> Column:
    """Overlapping windows of a text with white space made single, in order, without blank ones."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunk size must be positive, and the overlap from 0 to less than it")

    def cut(body: Column) -> Column:
        # cutting reads a text from its beginning, so long ones are cut into stretches of many windows first
        step, last = size - overlap, F.greatest(F.length(body) - overlap - 1, F.lit(0))

        def windows(p: Column) -> Column:
            starts = F.sequence(F.lit(0), F.least(last - p, F.lit((STRETCH - 1) * step)), F.lit(step))
            return once(F.substring(body, p + 1, F.lit(STRETCH * step + overlap)), lambda part: F.transform(starts, lambda q: F.trim(F.substring(part, q + 1, F.lit(size)))))

        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(STRETCH * step)), windows)), lambda x: x != "")

    return once(one_space(F.coalesce(_c(text), F.lit(""))), cut)


def chunk_id(key: Column | str, index: Column | str, text: Column | str) -> Column:
    name = F.concat_ws(":", _c(key), _c(index).cast("string"))
    return F.concat(name, F.lit(":"), F.substring(F.sha1(F.concat_ws(":", name, _c(text))), 1, 12))


def query_words(query: str) -> list[str]:
    return query.split()


def query_tokens(query: str) -> list[str]:
    """Tokens of a query by the same rule as of texts; repeated ones count as often as they occur."""
    return re.findall(r"\w+", query.lower())


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def _hits(lowered: Column, word: str) -> Column:
    """Starts of a word's non-overlapping places."""

    ends = lambda pieces: F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) + len(word))
    return F.transform(running(once(F.split(lowered, re.escape(word), -1), ends)), lambda end: end - len(word))


def snippets(text: Column | str, query: str, window: int = 120, gap: int = 80, most: int = 3) -> Column:
    """Stretches of a text around the words of a query, joined where they are near, without their first and last token."""
    words = [w.lower() for w in query_words(query)]
    if not words:
        return F.expr("cast(array() as array<string>)")

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.array(F.struct(last["l"].alias("l"), F.greatest(last["r"], s["r"]).alias("r")))
        # what comes after the last stretch wanted can't be joined to one that is
        return F.when(F.size(acc) > most, acc).when(s["l"] <= last["r"] + gap, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.concat(acc, F.array(s)))

    def cut(body: Column) -> Column:
        starts = F.array_sort(once(F.lower(body), lambda low: F.concat(*[_hits(low, w) for w in words])))
        spans = F.transform(starts, lambda i: F.struct(F.greatest(F.lit(0), i - window // 2).alias("l"), F.least(F.length(body), i + window // 2).alias("r")))
        merged = F.aggregate(spans, F.expr("cast(array() as array<struct<l:int,r:int>>)"), merge)
        return F.transform(F.slice(merged, 1, most), lambda s: _trimmed(F.substring(body, s["l"] + 1, s["r"] - s["l"])))

    return once(one_space(F.coalesce(_c(text), F.lit(""))), cut)


def _trimmed(piece: Column) -> Column:
    return F.concat(F.lit("..."), F.trim(F.regexp_replace(F.regexp_replace(piece, r"^\S*\s", ""), r"\s\S*$", "")), F.lit("..."))


def highlighted(text: Column | str, query: str) -> Column:
    """Whole words of the query between marks, in either case."""
    words = query_words(query)
    if not words:
        return _c(text)
    return F.regexp_replace(_c(text), r"(?iuU)\b(" + "|".join(map(re.escape, words)) + r")\b", "<mark>$1</mark>")


def escaped(text: Column | str) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def preview(text: Column | str, query: str, escape: bool = False) -> Column:
    """Highlighted snippets, or the first 200 characters; nothing of an empty text."""

    def shown(text: Column) -> Column:
        start = F.concat(F.left(text, F.lit(200)), F.when(F.length(text) > 200, "...").otherwise(""))
        body = once(snippets(text, query), lambda found: F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: highlighted(x, query)), " ... ")).otherwise(highlighted(start, query)))
        return F.when(text == "", "").otherwise(F.concat(F.lit("<div class='preview'>"), body, F.lit("</div>")))

    text = F.coalesce(_c(text), F.lit(""))
    return once(escaped(text) if escape else text, shown)
