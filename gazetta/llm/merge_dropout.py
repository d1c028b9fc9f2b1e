"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges of a public BPE vocabulary are taken from an agenda, best first and the
leftmost of equals; each candidate that comes up is skipped if a keyed hash of the
seed, the document, the word's position in it and the candidate's place says so. No
piece of the vocabulary crosses from a word into the space mark before the next one,
nor contains a line break, so words are segmented one by one. What doesn't depend on
the key, a word's plain segmentation and its merges, is kept by a task, up to a
bound. An occurrence of which no plain merge is skipped has the plain segmentation;
all others are segmented anew, together: a matrix holds the symbols and agendas of
many words, and each round does the best merge of every row.
Characters without a piece become bytes, as does a literal space mark, so that
decoding gives back every text.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetta.llm.common import lean, table

#: Vocabulary file, chance that a merge is skipped, and the seed of the keyed hash.
MODEL, DROPOUT, SEED = "/opt/tokenizers/piece_bpe_32k.model", 0.1, 7
#: Words whose plain segmentation is kept in one of two generations (some 350 bytes each).
KEPT = 120_000
#: Words that were met once of which the hash is remembered.
SEEN = 300_000
#: Characters of the texts whose new words are segmented together, and rows of a matrix of them.
CHARS, ROWS = 2_000_000, 1 << 13

#: The space mark of the pieces, and what stands for a mark in the text itself: a
#: surrogate, which no UTF-8 text has.
_MARK, _ESCAPE = "\u2581", "\ud800"
_WORD = re.compile("\u2581*[^\u2581\n\ud800]+|\u2581+|\n|\ud800")
_M1, _M2, _64 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids, self.bytes, self.text = {}, [0] * 256, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece] = i
                self.text[i] = piece.replace(_MARK, " ").encode()
        # better merges have higher scores
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-sp.get_score(self.ids[p]), self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order)}

    def segment(self, word: str, key: int, dropout: float, path: list[int] | None = None) -> list[int]:
        """Ids of one word. key and dropout decide which merges are skipped; without dropout it is the plain segmentation. path gets the places of the merges done."""
        if word == _ESCAPE:
            return [self.bytes[b] for b in _MARK.encode()]
        rank, n = self.rank, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        bar = int(dropout * 65536)
        while agenda:
            _, i, m, j = heapq.heappop(agenda)
            if end[i] != m or end[m] != j:
                continue
            if bar:
                h = ((key ^ _place(i, m, j)) * _M1) & _64
                if (((h ^ h >> 29) * _M2 & _64) >> 48) < bar:
                    continue
            if path is not None:
                path.append(_place(i, m, j))
            end[i], end[m] = j, 0
            if j < n:
                before[j] = i
                if (r := rank.get(word[i : end[j]])) is not None:
                    heapq.heappush(agenda, (r, i, j, end[j]))
            if (b := before[i]) >= 0 and (r := rank.get(word[b:j])) is not None:
                heapq.heappush(agenda, (r, b, i, j))
        out, i = [], 0
        while i < n:
            piece = word[i : end[i]]
            if (x := self.ids.get(piece)) is None:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(x)
            i = end[i]
        return out

    @cached_property
    def pairs(self):
        """Symbols for the matrix agenda: of each code point; of pairs of symbols, in the slots of a table by hash, the pair, the rank and the merged symbol; and the piece of each symbol."""
        symbols = dict.fromkeys(c for p in self.ids for c in p) | dict.fromkeys(self.ids)
        symbols = {p: i for i, p in enumerate(symbols)}
        points = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                points[ord(p)] = i
        found = [(symbols[p[:k]] << 32 | symbols[p[k:]], r, symbols[p]) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        key, rank, merged = (np.array(x, np.int64) for x in zip(*found, strict=True))
        slots = np.full(1 << _SLOTS, -2, np.int64)
        put = np.zeros((2, 1 << _SLOTS), np.int32)
        left, slot = np.arange(len(key)), _slot(key)
        while len(left):  # those whose slot is taken go one further
            free = slots[slot] == -2
            slots[slot[free]] = key[left[free]]
            done = slots[slot] == key[left]
            put[0, slot[done]], put[1, slot[done]] = rank[left[done]], merged[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & ((1 << _SLOTS) - 1)
        return points, slots, put[0], put[1], np.array([self.ids.get(p, -1) for p in symbols], np.int32)

    def segment_all(self, words: list[str], keys: np.ndarray, dropout: float, paths: list | None = None) -> list[bytes]:
        """Like segment for many words, as bytes of 32-bit ids. Each word is a row of a matrix, of which every round does the best merge of every row. paths, a list of their number, gets the places of each word's merges as bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                done: list[tuple[np.ndarray, np.ndarray]] | None = None if paths is None else []
                for i, ids in zip(part, self._rounds([words[i] for i in part], size[part], keys[part], high, dropout, done), strict=True):
                    out[i] = ids
                if paths is not None:
                    row, place = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*done, strict=True) if done else ((), ())))
                    flat = place[np.argsort(row, kind="stable")].tobytes()
                    edge = (np.r_[0, np.cumsum(np.bincount(row, minlength=len(part)))] * 8).tolist()
                    for i, a, b in zip(part, edge[:-1], edge[1:], strict=True):
                        paths[i] = flat[a:b]
        for i in np.flatnonzero(size > 64):
            path: list[int] = []
            out[i] = np.array(self.segment(words[i], int(keys[i]), dropout, path), np.int32).tobytes()
            if paths is not None:
                paths[i] = np.array(path, np.uint64).tobytes()
        return out

    def _rounds(self, words: list[str], size: np.ndarray, keys: np.ndarray, width: int, dropout: float, done: list | None = None) -> list[bytes]:
        points, pair, rank, merged, ids = self.pairs
        n, none = len(words), 1 << 30
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width) < size[:, None]
        # a piece stands where it begins; after and before tell where the next and the last one begin, so a merge moves nothing
        symbol = np.full((n, width + 2), -1, np.int32)
        symbol[:, :width][inside] = points[text]
        after = np.tile(np.arange(1, width + 3, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int16), (n, 1))
        alive = inside.copy()
        bar = int(dropout * 65536)

        def look(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank (none if there is no merge or it is skipped) and merged symbol of the piece at col with the next one."""
            m = after[row, col]
            a, b = symbol[row, col], symbol[row, m]
            want = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) << 32 | b)
            at = _slot(want)
            ok = pair[at] == want
            on = np.flatnonzero(~ok & (pair[at] != -2) & (want >= 0))
            while len(on):
                at[on] = (at[on] + 1) & ((1 << _SLOTS) - 1)
                ok[on] = pair[at[on]] == want[on]
                on = on[~ok[on] & (pair[at[on]] != -2)]
            if bar:
                j = np.minimum(after[row, m], width)
                place = col.astype(np.uint64) << np.uint64(42) | m.astype(np.uint64) << np.uint64(21) | j.astype(np.uint64)
                h = (keys[row] ^ place) * np.uint64(_M1)
                ok &= ((h ^ h >> np.uint64(29)) * np.uint64(_M2) >> np.uint64(48)) >= bar
            return np.where(ok, rank[at], none), merged[at]

        best = np.full((n, width), none, np.int32)
        into = np.zeros((n, width), np.int32)
        row, col = np.nonzero(inside[:, 1:])
        best[row, col], into[row, col] = look(row, col)
        active = np.arange(n)
        while len(active):
            own = best if len(active) == n else best[active]
            at = own.argmin(1)
            go = own[np.arange(len(active)), at] < none
            active, at = active[go], at[go]
            if not len(active):
                break
            m = after[active, at]
            j = after[active, m]
            if done is not None:
                done.append((active, at << 42 | m.astype(np.int64) << 21 | j))
            symbol[active, at] = into[active, at]
            alive[active, m] = False
            best[active, m] = none
            after[active, at], before[active, j] = j, at
            best[active, at], into[active, at] = look(active, at)
            left = before[active, at]
            some = left >= 0
            rows, cols = active[some], left[some]
            best[rows, cols], into[rows, cols] = look(rows, cols)
        known = np.where(symbol[:, :width] >= 0, ids[symbol[:, :width]], -1).astype(np.int32)
        flat, edge = known[alive].tobytes(), np.r_[0, np.cumsum(alive.sum(1))] * 4
        out = [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        for i in np.flatnonzero(((known < 0) & alive).any(1)):
            cut = np.r_[np.flatnonzero(alive[i]), size[i]]
            ids_of = [[known[i, a]] if known[i, a] >= 0 else self._bytes(words[i][a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out[i] = np.array([t for x in ids_of for t in x], np.int32).tobytes()
        return out

    def _bytes(self, piece: str) -> list[int]:
        return [self.bytes[b] for b in (_MARK if piece == _ESCAPE else piece).encode()]

    def decode(self, ids) -> str:
        return b"".join([self.text[int(i)] for i in ids]).decode()[1:]


def _place(i: int, m: int, j: int) -> int:
    """64 bits of a candidate that merges [i, m) and [m, j). In words of over two million characters several may share one, which only makes their draws alike."""
    return (i << 42 ^ m << 21 ^ j) & _64


#: Bits of the number of slots for pairs of symbols.
_SLOTS = 20


def _slot(pairs: np.ndarray) -> np.ndarray:
    """Where the search for a pair begins."""
    return ((pairs.view(np.uint64) * np.uint64(_M1)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(model: str = MODEL) -> Vocabulary:
    return Vocabulary(model)


class Segmenter:
    """Plain segmentations of words that a task has made, as bytes of 32-bit ids, and the places of their merges, as bytes of 64-bit numbers."""

    def __init__(self, model: str, seed: int, dropout: float):
        self.vocab, self.seed, self.dropout = vocabulary(model), seed, dropout
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.seen: set[int] = set()

    def plain(self, order: list[str], counts: np.ndarray) -> list[tuple[bytes, bytes] | None]:
        """The plain segmentation of each of some distinct words and the places of its merges; None for words that are met for the first time and once.

        Those are segmented with their own draws at once, and don't fill up what is
        kept. Two generations: what is used again outlives the words that fill one up.
        """
        if len(self.kept) > KEPT:
            self.kept, self.old = {}, self.kept
        if len(self.seen) > SEEN:
            self.seen.clear()
        young, old, seen = self.kept, self.old, self.seen
        out: list = list(map(young.get, order))
        new, at = [], []
        for i in [i for i, x in enumerate(out) if x is None]:
            w = order[i]
            if (x := old.get(w)) is not None:
                out[i] = young[w] = x
            elif counts[i] > 1 or hash(w) in seen:
                new.append(w)
                at.append(i)
            else:
                seen.add(hash(w))
        paths: list = [b""] * len(new)
        ids = self.vocab.segment_all(new, np.zeros(len(new), np.uint64), 0.0, paths)
        for i, w, own in zip(at, new, zip(ids, paths, strict=True), strict=True):
            out[i] = young[w] = own
        return out

    def encode(self, texts: list[str], docs: list[int], copies: list[int] | None = None) -> list[np.ndarray]:
        found = [words(t) for t in texts]
        flat = [w for own in found for w in own]
        if not flat:
            return [np.empty(0, np.int32) for _ in texts]
        order, which = _distinct(flat)
        plain = self.plain(order, np.bincount(which, minlength=len(order)))
        keys = np.concatenate([_keys(doc, copy, len(own), self.seed) for doc, copy, own in zip(docs, copies or [0] * len(docs), found, strict=True)])
        ids_of = [x and x[0] for x in plain]
        out = [ids_of[i] for i in which.tolist()]
        first = np.fromiter((x is None for x in plain), bool, len(plain))
        anew = np.flatnonzero(self._skipped([x[1] if x else b"" for x in plain], which, keys) | first[which])
        again = self.vocab.segment_all([flat[i] for i in anew], keys[anew], self.dropout)
        for i, ids in zip(anew.tolist(), again, strict=True):
            out[i] = ids
        edge = np.r_[0, np.cumsum([len(own) for own in found])].tolist()
        return [np.frombuffer(b"".join(out[a:b]), np.int32) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _skipped(self, paths: list[bytes], which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Of each occurrence, whether one of its word's plain merges is skipped."""
        places = np.frombuffer(b"".join(paths), np.uint64)
        size = np.array([len(x) // 8 for x in paths])
        n = size[which]
        first = np.cumsum(size) - size
        at = np.arange(n.sum()) + np.repeat(first[which] - (np.cumsum(n) - n), n)
        h = (np.repeat(keys, n) ^ places[at]) * np.uint64(_M1)
        skip = ((h ^ h >> np.uint64(29)) * np.uint64(_M2) >> np.uint64(48)) < int(self.dropout * 65536)
        return np.bincount(np.repeat(np.arange(len(which)), n)[skip], minlength=len(which)) > 0


@lru_cache(maxsize=2)
def segmenter(model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> Segmenter:
    return Segmenter(model, seed, dropout)


def _keys(doc: int, copy: int, n: int, seed: int) -> np.ndarray:
    """Key of each of a document's n words."""
    base = xxhash.xxh3_64_intdigest(f"{seed}:{doc}:{copy}".encode())
    at = np.uint64(base) + np.arange(n, dtype=np.uint64) * np.uint64(_M1)
    at = (at ^ at >> np.uint64(30)) * np.uint64(_M2)
    return at ^ at >> np.uint64(31)


def words(text: str) -> list[str]:
    """Words of a text with the space mark before them; a literal space mark is a word by itself."""
    if not text:
        return []
    if _MARK in text:
        text = text.replace(_MARK, _ESCAPE)
    return _WORD.findall(_MARK + text.replace(" ", _MARK))


def encode(text: str, doc: int = 0, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> np.ndarray:
    """Ids of a text; doc is part of the key of each of its words."""
    return segmenter(model, seed, dropout).encode([text], [doc])[0]


def _distinct(flat: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words of a list, and which of them each is."""
    order = dict.fromkeys(flat)
    order.update(zip(order, range(len(order)), strict=True))
    return list(order), np.fromiter(map(order.__getitem__, flat), np.int64, len(flat))


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of about so much together, one item at least."""
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def _encoder(model: str, seed: int, dropout: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is kept has no cycles, and walking through it costs more than the work
        try:
            yield from encode_batches(batches, Segmenter(model, seed, dropout))  # kept for one task
        finally:
            gc.enable()

    def encode_batches(batches: Iterator[pa.RecordBatch], own: Segmenter) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices([x.as_buffer().size if x.is_valid else 0 for x in batch.column(1)], CHARS):
                some = batch.slice(part.start, part.stop - part.start)
                keys, texts, copies = (some.column(i).to_pylist() for i in range(3))
                ids = own.encode([t or "" for t in texts], [d or 0 for d in keys], copies)
                null = np.array([t is None for t in texts], bool)
                size = np.array([len(x) for x in ids], np.int64)
                edge = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), mask=np.r_[null, False])
                flat = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(size), pa.ListArray.from_arrays(edge, flat)], names=["doc_id", "n_tokens", "ids"])

    return lean(run)


def encoded(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, n_tokens and ids of each row of docs (doc_id, text, and copy if repeated rows are to differ: see numbered).

    A null text has null ids and no tokens, an empty one an empty array. Texts and words
    may be of any length. Rows with
    equal doc_id, text and copy get equal ids; a null doc_id counts as 0. An empty table
    gives no rows; other columns are ignored.
    """
    copy = "cast(copy as long)" if "copy" in docs.columns else "0L"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", f"coalesce({copy}, 0L) as copy").mapInArrow(_encoder(model, seed, dropout), "doc_id long, n_tokens long, ids array<int>")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, and copy: 0, 1, ... among rows that are equal in both."""
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    return docs.select("doc_id", "text", (F.row_number().over(same) - 1).alias("copy"))


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of each row of tokens (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [None if not x.is_valid else vocab.decode(x.values.to_numpy()) if len(x) else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; the copies that the mix makes of one get draws of their own, by its number where it tells one."""
    return encoded(docs if "copy" in docs.columns else numbered(docs))


QUERIES = {"op6_merge_dropout": op6_merge_dropout}
