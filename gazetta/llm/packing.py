"""Packing of documents into sequences of like cost.

A token costs the same in every layer but attention, whose cost grows with the
square of a piece's length, as a piece attends to itself only. Documents are cut to
the length of a sequence, sorted by falling length, and each goes to the sequence of
the lowest cost so far that has room for it; where none has, it is cut, and its parts
fill up the sequences of the lowest cost that have room at all. As many sequences are
open as the tokens fill, so cuts are rare until the short documents at the end.

Each task packs its own documents, a window of some millions of tokens at a time, and
takes what doesn't fill a sequence on to the next window; so nothing is exchanged, and
memory depends on the window only. What is left at a task's end fills sequences of
powers of two, which aren't padded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from gazetta.llm.common import lean, table

#: Tokens of a sequence, and the id behind each document.
LENGTH, END = 4096, 2
#: Cost of a token, and of each pair of tokens of a piece: attention costs as much as the rest at some 6,000 tokens, as in a model of width 1,024.
LINEAR, QUADRATIC = 1.0, 1 / 6144
#: Tokens that are packed together.
WINDOW = 1 << 21
#: Vocabulary file, by its name in the package of public tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: Chunks whose ids a task keeps in one of two generations, and the longest of them in bytes.
KEPT, LONGEST = 400_000, 48
#: Bytes of texts that are split together, and plain words that are encoded as one text.
CHARS, JOINED = 1 << 22, 64

#: A word of plain letters, with a stop or comma behind it, which is a token of its own.
_WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]?)")
#: A word's last token ends with it.
_WORD_END = "</w>"


def cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Cost of a piece of so many tokens."""
    return linear * length + quadratic * length * length


class Encoder:
    """Ids of texts by a tokenizer that splits at white space and drops it, and takes capitals as small letters, so that what stands between white space is encoded once and kept."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        known = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(known.values()) + 1, bool)
        self.ends[[i for token, i in known.items() if token.endswith(_WORD_END)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of some texts (null: none), with END behind them; long ones are encoded stretch by stretch."""
        out: list[np.ndarray] = []
        for part in _slices(_sizes(texts)):
            some = texts.slice(part.start, part.stop - part.start)
            if len(some) == 1 and some[0].is_valid and some[0].as_buffer().size > CHARS:
                stretches = [self._ids(pa.array([raw], pa.string()))[0] for raw in _stretches(some[0].as_buffer().to_pybytes())]
                out.append(np.concatenate([x[:-1] for x in stretches] + [stretches[-1][-1:]]))
            else:
                out += self._ids(some)
        return out

    def _ids(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("")
        # special tokens are known by their capitals
        texts = texts if pc.any(pc.match_substring(texts, "<|")).as_py() else pc.ascii_lower(texts)
        chunks = pc.ascii_split_whitespace(texts)
        each = chunks.flatten().dictionary_encode()
        known = self._known(each.dictionary.cast(pa.binary()).to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = each.indices.to_numpy()
        n, first = size[which], np.cumsum(size) - size
        end = np.cumsum(n)
        # END stands behind each text's own
        texts_end = np.r_[0, end][np.asarray(chunks.offsets)] + np.arange(len(texts) + 1)
        out = np.full(texts_end[-1], END, np.uint32)
        inside = np.ones(len(out), bool)
        inside[texts_end[1:] - 1] = False
        at = np.repeat(first[which] - (end - n), n)
        at += np.arange(len(at))
        out[inside] = np.frombuffer(b"".join(known), np.uint32)[at]
        return [out[a:b] for a, b in zip(texts_end[:-1], texts_end[1:], strict=True)]

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct chunks, as bytes."""
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, chunks))
        missing = [i for i, x in enumerate(out) if x is None]
        old, new = self.old.get, []
        for i in missing:
            if (x := old(chunks[i])) is None:
                new.append(chunks[i])
            else:
                out[i] = self.young[chunks[i]] = x
        if new:
            found = self._encoded(new)
            for i in missing:
                if out[i] is None:
                    out[i] = found[chunks[i]]
            self.young.update({c: x for c, x in found.items() if len(c) <= LONGEST})
        return out

    def _encoded(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new chunks. Plain words are encoded many at a time, and cut behind the tokens that end words."""
        plain, tailed, other = {}, [], [b".", b","]
        for c in chunks:
            if (m := _WORD.fullmatch(c)) is None:
                other.append(c)
            elif m[2]:
                tailed.append(m.groups())
            else:
                plain[c] = None
        for stem, _ in tailed:
            if stem not in plain:
                plain[stem] = self.young.get(stem)
        words = [w for w, ids in plain.items() if ids is None]
        joined = [b" ".join(words[i : i + JOINED]).decode() for i in range(0, len(words), JOINED)]
        encode = self.tokenizer.encode_batch_fast
        ids = np.array([i for x in encode(joined, add_special_tokens=False) for i in x.ids], np.uint32)
        cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        flat = ids.tobytes()
        plain.update({w: flat[a:b] for w, a, b in zip(words, cut[:-1], cut[1:], strict=True)})
        rest = dict(zip(other, [np.array(x.ids, np.uint32).tobytes() for x in encode([c.decode() for c in other], add_special_tokens=False)], strict=True))
        return plain | rest | {stem + tail: plain[stem] + rest[tail] for stem, tail in tailed}


def _sizes(texts: pa.Array) -> list[int]:
    """Bytes of each text."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def _stretches(raw: bytes) -> Iterator[bytes]:
    """Bytes of a text in stretches of about CHARS, cut at a space, which no token crosses."""
    at = 0
    while at < len(raw):
        end = at + CHARS
        if end >= len(raw) or (end := raw.find(b" ", end)) < 0:
            end = len(raw)
        yield raw[at:end]
        at = end


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Slices of about CHARS together, one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= CHARS or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, total = i + 1, 0


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    return Encoder(vocabulary)


def assigned(lengths: np.ndarray, rooms: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (piece, begin, length, sequence, offset) that fill sequences with so much room each, and what is left of the pieces (piece, begin, length).

    Pieces come in falling length, those of equal length in order. One goes to the
    sequence of the lowest cost, the first of equals, that has room for it whole, else
    what fits of it to the lowest of those that have room.
    """
    room, costs = rooms.astype(np.int64), np.zeros(len(rooms))
    out, rest = [], []
    left = int(room.sum())
    for piece in np.argsort(-lengths, kind="stable").tolist():
        begin, length = 0, int(lengths[piece])
        while length:
            if not left:
                rest.append((piece, begin, length))
                break
            fits = np.flatnonzero(room >= length)
            if not len(fits):
                fits = np.flatnonzero(room)
            to = int(fits[costs[fits].argmin()])
            n = min(length, int(room[to]))
            out.append((piece, begin, n, to, int(rooms[to] - room[to])))
            room[to] -= n
            costs[to] += cost(n, linear, quadratic)
            begin, length, left = begin + n, length - n, left - n
    return out, rest


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_TYPES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "cost": pa.float64(), "ids": pa.list_(pa.int32())}


def packed(docs: DataFrame, with_ids: bool = True, window: int = WINDOW, vocabulary: str = VOCABULARY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost (of its sequence) and ids.

    A null or empty text is the end id alone, as is one of white space. Repeated rows
    and rows without a doc_id are documents of their own. Texts of any length are
    encoded stretch by stretch. An empty table gives no rows; other columns are
    ignored. sequence_id tells the task and the sequence in it: a task that runs again
    over the same rows names and fills its sequences alike.
    """
    names = [*[c.split()[0] for c in _OUT.split(", ")], *(["ids"] if with_ids else [])]
    schema = _OUT + (", ids array<int>" if with_ids else "")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        own = encoder(vocabulary)
        for batch in batches:
            for part in _slices(_sizes(batch.column(1))):
                some = batch.slice(part.start, part.stop - part.start)
                yield from zip(some.column(0).to_pylist(), own.encode(some.column(1)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        documents: list[tuple[int | None, np.ndarray]] = []
        waiting: list[tuple[int, int, int]] = []  # document, start, length
        tokens = sequences = 0

        def fill(rooms: list[int]) -> pa.RecordBatch:
            """A batch of the pieces that fill the sequences; what is left of them waits on."""
            nonlocal documents, waiting, tokens, sequences
            lengths = np.array([x[2] for x in waiting])
            out, rest = assigned(lengths, np.array(rooms), linear, quadratic)
            spent = np.zeros(len(rooms))
            for _, _, n, to, _ in out:
                spent[to] += cost(n, linear, quadratic)
            columns: dict[str, list] = {c: [] for c in names}
            for piece, begin, n, to, offset in out:
                doc, start, _ = waiting[piece]
                doc_id, ids = documents[doc]
                some = ids[start + begin : start + begin + n]
                row = (doc_id, start + begin, n, zlib.crc32(some.astype("<u4").tobytes()), len(ids), place + sequences + to, offset, spent[to], some.astype(np.int32))
                for c, v in zip(columns.values(), row, strict=False):
                    c.append(v)
            kept = [(waiting[p][0], waiting[p][1] + begin, n) for p, begin, n in sorted(rest)]
            used = {doc: i for i, doc in enumerate(dict.fromkeys(d for d, _, _ in kept))}
            documents, waiting = [(documents[d][0], documents[d][1].copy()) for d in used], [(used[d], s, n) for d, s, n in kept]
            tokens, sequences = tokens - sum(rooms), sequences + len(rooms)
            return pa.RecordBatch.from_arrays([pa.array(v, _TYPES[c]) for c, v in columns.items()], names=names)

        for doc_id, ids in encoded(batches):
            waiting += [(len(documents), s, min(LENGTH, len(ids) - s)) for s in range(0, len(ids), LENGTH)]
            documents.append((doc_id, ids))
            tokens += len(ids)
            if tokens >= window:
                yield fill([LENGTH] * (tokens // LENGTH))
        if tokens:
            yield fill([LENGTH] * (tokens // LENGTH) + powers(tokens % LENGTH))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(run), schema)


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost")


QUERIES = {"op13_cost_packing": op13_cost_packing}
