"""N-gram Jaccard join over a metric space of shingle sets, exact and by regions.

Jaccard distance is a metric, and two documents link when it is 0.2 or less. Over
a whole corpus almost every pair of documents is at distance 1, so pivots that are
documents tell such pairs apart from nothing. The first level of pivots are
therefore singleton sets {s}, one for each shingle s, in the order of rarity:

* a document lies in the Voronoi region of its rarest shingle;
* the triangle inequality says how far a partner within the radius may have its
  own region: among the n - ceil(0.8 n) + 1 rarest shingles of a set of n. The
  document is replicated to these regions and to no others, with its place among
  its shingles, which bounds the overlap that a region can stand for;
* a document with n - ceil(0.8 n) + 1 or more shingles that no other document
  holds has its window full of empty regions, so it is dropped before anything
  is built for it.

Inside a region the recursion goes on with documents as pivots: each round takes
some members as pivots, measures the exact distance of the others to them, links
what is within the radius, and joins what remains. A pair goes on only if its
members have different components so far and lie in the same ring around the
region's first pivot: |d(x, p) - d(y, p)| <= 0.2. The number of pivots in a region
grows by a factor from round to round, and a region ends when all its members have
one component. A group of near copies so costs a few pivots times its size and not
all its pairs, and no link between components is lost.

The corpus-wide shingle counts go through one exchange of packed, sorted arrays
that are combined on the map side; shingle sets themselves are built again only
for the documents that can have a partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm.common import lean, only_ids, settled, sized, stored, table, trimmed, written
from gazetta.session import removed

#: Words of a shingle, and the similarity from which documents link, as a ratio
#: of integers so that comparisons are exact.
WORDS, NUM, DEN = 5, 4, 5
#: Largest distance of linked documents.
RADIUS = 1 - NUM / DEN
#: Pivots of a region in the first round, and the factor from round to round.
PIVOTS, GROWTH = 1, 16
#: Characters of documents for each part of the shingle counts (a word and its space take six or seven, so some
#: 200,000 shingles, 10 MB while they are counted), and of the documents that are packed together.
PART_CHARS, CHARS = 1_500_000, 3_000_000
#: Parts for each task that counts them, in mean; so tasks are of like size for any number of texts and any settings.
TOGETHER = 2
#: Rows that a batch of documents or a part of the counts is split into at most, and bytes that are split again together.
#: With more parts than that, rows are split over several exchanges, digit by digit.
FAN, AGAIN = 1024, 32_000_000
#: Tasks of an exchange at most.
TASKS = 20_000
#: Members of a region that are joined in one task; larger regions are dealt out over several.
SPLIT = 512
#: Rows of a round's tables (regions, pivots, distances, roots) that are broadcast at most, some 150 bytes each; larger ones are sorted and merged.
MET = 100_000
#: Edges that one task joins to stars, in mean; the stars of several tasks are united by rounds.
STARS = 200_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_EMPTY = np.empty(0, np.uint64)
_PACKED = "part long, batch long, kind int, a binary, b binary, c binary, d binary"
_SHARED = np.uint32(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit keys of the distinct shingles of a text."""
    words = text.encode().translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return _EMPTY
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    keys = word[: n - WORDS + 1] * _ODD[0]
    for j in range(1, WORDS):
        keys += word[j : n - WORDS + 1 + j] * _ODD[j]
    return np.unique(_mix(keys))


def set_id(keys: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([_mix(keys ^ _ODD[1]).sum(), _mix(keys + _ODD[2]).sum()], np.uint64).tobytes()


def _window(n: int) -> int:
    """Regions to which a document with n shingles is replicated."""
    return n - -(-n * NUM // DEN) + 1


def _packer(parts: int, with_sets: bool, levels: int = 1, fan: int = FAN):
    """Batches of documents as packed shingle codes, and one row about the batch itself.

    kind 0: a: sorted 32-bit codes of one part, b: for each the document's index
    in the batch, or _SHARED where several documents of the batch hold it, c (if
    with_sets): how many. kind 1: a: doc_id, b: n and the shingles shared inside
    the batch, c: set ids, d (if with_sets): the sets. A batch is named by its place
    and contents, so that a task that runs again names it alike, or not at all.
    With several levels kind 0 has the codes whole, part is their first digit, and
    kind 1 the last digits of the batch.
    """
    top = fan ** (levels - 1)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId() << 32
        for frame in _parts_of(frames):
            place += 1
            sets = [shingle_set(x) for x in frame["text"]]
            ids = [set_id(x) for x in sets]
            at = xxhash.xxh3_64_intdigest(b"".join([frame["doc_id"].to_numpy(np.int64).tobytes(), *ids]), seed=place) >> 1
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            first = dict(zip(reversed(ids), range(len(ids) - 1, -1, -1), strict=True))
            own = np.fromiter((first[x] == i for i, x in enumerate(ids)), bool, len(ids))
            keys = np.concatenate([x if o else _EMPTY for x, o in zip(sets, own, strict=True)])
            doc = np.repeat(np.arange(len(sets), dtype=np.uint32), n * own)
            code = _code(keys, parts)
            order = np.argsort(code)
            code, doc = code[order], doc[order]
            head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
            count = np.diff(np.r_[head, len(code)])
            shared = np.bincount(doc[np.repeat(count > 1, count)], minlength=len(sets)).astype(np.int64)
            code, doc = code[head], np.where(count > 1, _SHARED, doc[head])
            part = (code >> np.uint64(32)).astype(np.int64) // top
            edge = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
            local = code.astype(np.uint32) if levels == 1 else code
            cut = [(part[a], slice(a, b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out = [(int(p), at, 0, local[s].tobytes(), doc[s].tobytes(), count[s].astype(np.uint32).tobytes() if with_sets else None, None) for p, s in cut]
            about = np.concatenate([n, shared, [len(code)]])
            out.append((at % parts if levels == 1 else at % fan**levels, at, 1, frame["doc_id"].to_numpy(np.int64).tobytes(), about.tobytes(), b"".join(ids), b"".join(x.tobytes() for x in sets) if with_sets else None))
            yield pd.DataFrame(out, columns=["part", "batch", "kind", "a", "b", "c", "d"])

    return lean(pack)


def _parts_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of about CHARS characters of text, in order."""
    for frame in frames:
        if len(frame):
            turn = np.cumsum(frame["text"].str.len().fillna(0)) // CHARS
            for _, part in frame.groupby(turn.to_numpy(), sort=True):
                yield part


def _code(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 bits of each key. Keys that fall together only seem to be shared, which drops no document."""
    return ((keys >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))


def _splitter(level: int, levels: int, fan: int = FAN):
    """Rows of kind 0 whose part is the first digits of codes, as rows by one digit more; many batches share one, so d names the batch of each code."""
    unit = fan ** (levels - level)

    def emit(rows: list[tuple]) -> pd.DataFrame:
        code, doc, times, batch = (np.concatenate(x) for x in zip(*rows, strict=True))
        part = (code >> np.uint64(32)).astype(np.int64) // unit
        order = np.argsort(part, kind="stable")
        return _cut(part[order], 0, code[order], doc[order], times[order], batch[order])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            yield frame[frame["kind"] == 1]
            for row in frame[frame["kind"] == 0].itertuples(index=False):
                rows.append(_elements(row))
                size += 24 * len(rows[-1][0])
                if size >= AGAIN:
                    yield emit(rows)
                    rows, size = [], 0
        if rows:
            yield emit(rows)

    return lean(split)


def _elements(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, documents, times and batches of a row of kind 0 with whole codes."""
    code, doc = np.frombuffer(row.a, np.uint64), np.frombuffer(row.b, np.uint32)
    times = np.frombuffer(row.c, np.uint32) if row.c is not None else np.where(doc == _SHARED, 2, 1).astype(np.uint32)
    return code, doc, times, np.frombuffer(row.d, np.int64) if row.d is not None else np.full(len(code), row.batch, np.int64)


def _cut(key: np.ndarray, kind: int, *arrays: np.ndarray) -> pd.DataFrame:
    """A row of a kind for each key of sorted ones, with the arrays' parts."""
    edge = np.r_[np.flatnonzero(np.diff(key, prepend=-1)), len(key)]
    rows = [(int(key[a]), -1, kind, *[x[a:b].tobytes() for x in arrays]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pd.DataFrame(rows, columns=["part", "batch", "kind", "a", "b", "c", "d"]).astype({"part": "int64", "batch": "int64", "kind": "int32"})


def _counter(with_sets: bool):
    """For each batch, what one part says: of each document, how many of its codes other batches hold too; with sets, the shared codes and their counts."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        sent = frame[frame["kind"] == 0]
        out = [frame[frame["kind"] == 1]]
        if len(sent):
            local = [np.frombuffer(x, np.uint32) for x in sent["a"]]
            sizes = np.array([len(x) for x in local])
            code, doc = np.concatenate(local), np.concatenate([np.frombuffer(x, np.uint32) for x in sent["b"]])
            times = np.concatenate([np.frombuffer(x, np.uint32) for x in sent["c"]]).astype(np.int64) if with_sets else np.where(doc == _SHARED, 2, 1)
            _, back = np.unique(code, return_inverse=True)
            df = np.bincount(back, weights=times).astype(np.int64)[back]
            rows, start = [], 0
            for (batch, part), size in zip(sent[["batch", "part"]].itertuples(index=False), sizes, strict=True):
                s = slice(start, start + size)
                start += size
                hit = df[s] > 1
                if with_sets:
                    codes = code[s][hit].astype(np.uint64) | np.uint64(part) << np.uint64(32)
                    rows.append((part, batch, 2, codes.tobytes(), df[s][hit].tobytes(), np.int64(size).tobytes(), None))
                else:
                    at, n = np.unique(doc[s][hit & (doc[s] != _SHARED)], return_counts=True)
                    rows.append((part, batch, 2, at.tobytes(), n.tobytes(), np.int64(size).tobytes(), None))
            out.append(pd.DataFrame(rows, columns=frame.columns))
        return pd.concat(out)

    return _trimming(count)


def _counter_of_levels(with_sets: bool, fan: int = FAN):
    """_counter for whole codes of many batches. What it says (kind 3) is split by the last digit of the batch: batch, document or code, number, and the codes of the batch here, in its first element."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        sent = frame[frame["kind"] == 0]
        out = [frame[frame["kind"] == 1]]
        if len(sent):
            code, doc, times, batch = (np.concatenate(x) for x in zip(*map(_elements, sent.itertuples(index=False)), strict=True))
            _, back = np.unique(code, return_inverse=True)
            df = np.bincount(back, weights=times.astype(np.int64)).astype(np.int64)[back]
            names, sizes = np.unique(batch, return_counts=True)
            hit = df > 1
            if with_sets:
                who, what, n = batch[hit], code[hit], df[hit]
            else:
                hit &= doc != _SHARED
                pair, n = np.unique(np.array([batch[hit], doc[hit].astype(np.int64)]), axis=1, return_counts=True)
                who, what = pair[0], pair[1].astype(np.uint64)
            # an element of each batch with the number of its codes, and the answers
            who, what, n = np.r_[names, who], np.r_[np.zeros(len(names), np.uint64), what], np.r_[np.zeros(len(names), np.int64), n]
            codes = np.r_[sizes, np.zeros(len(who) - len(names), np.int64)]
            key = who % fan
            order = np.argsort(key, kind="stable")
            out.append(_cut(key[order], 3, who[order], what[order], n[order], codes[order]))
        return pd.concat(out)

    return _trimming(count)


def _returner(level: int, fan: int = FAN):
    """Rows of kind 3 by the last digits of their batches, as rows by one digit more."""

    def emit(rows: list[tuple]) -> pd.DataFrame:
        who, what, n, codes = (np.concatenate(x) for x in zip(*rows, strict=True))
        key = who % fan**level
        order = np.argsort(key, kind="stable")
        return _cut(key[order], 3, who[order], what[order], n[order], codes[order])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            yield frame[frame["kind"] == 1]
            for row in frame[frame["kind"] == 3].itertuples(index=False):
                rows.append(_answers(row))
                size += 32 * len(rows[-1][0])
                if size >= AGAIN:
                    yield emit(rows)
                    rows, size = [], 0
        if rows:
            yield emit(rows)

    return lean(split)


def _answers(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.a, np.int64), np.frombuffer(row.b, np.uint64), np.frombuffer(row.c, np.int64), np.frombuffer(row.d, np.int64)


def _by_batch(run, with_sets: bool):
    """run, a function of the rows of one batch, for a group of batches that kind 3 speaks of together."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["kind"] == 1]
        said = [_answers(r) for r in frame[frame["kind"] == 3].itertuples(index=False)]
        who, what, n, codes = (np.concatenate(x) for x in zip(*said, strict=True)) if said else (np.empty(0, np.int64), _EMPTY, np.empty(0, np.int64), np.empty(0, np.int64))
        out = []
        for at in own["batch"]:
            mine = who == at
            hit = mine & (codes == 0)
            first = what[hit] if with_sets else what[hit].astype(np.uint32)
            told = pd.DataFrame([(0, at, 2, first.tobytes(), n[hit].tobytes(), np.int64(codes[mine].sum()).tobytes(), None)], columns=frame.columns)
            out.append(run(pd.concat([own[own["batch"] == at], told])))
        if len(np.setdiff1d(who, own["batch"])):
            raise RuntimeError("a batch of documents was read in two orders; run the join on a written table")
        return pd.concat(out)

    return group


def _trimming(run):
    """run, a function of a group, with trimmed() behind it."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        settled()
        try:
            return run(frame)
        finally:
            trimmed()

    return group


def _gathered(frame: pd.DataFrame):
    """The row about a batch and the answers for it; raises if an answer is missing or belongs to other contents of the batch."""
    own, said = frame[frame["kind"] == 1], frame[frame["kind"] == 2]
    got = sum(np.frombuffer(x, np.int64)[0] for x in said["c"])
    if len(own) != 1 or np.frombuffer(own["b"].iloc[0], np.int64)[-1] != got:
        raise RuntimeError("a batch of documents was read in two orders; run the join on a written table")
    own = own.iloc[0]
    ids = np.frombuffer(own["a"], np.int64)
    n, shared = np.frombuffer(own["b"], np.int64)[:-1].reshape(2, -1)
    return own, said, ids, n, shared, [own["c"][i : i + 16] for i in range(0, len(own["c"]), 16)]


def _documents(frame: pd.DataFrame) -> pd.DataFrame:
    own, said, ids, n, shared, sets = _gathered(frame)
    shared = shared.copy()
    for a, b in zip(said["a"], said["b"], strict=True):
        np.add.at(shared, np.frombuffer(a, np.uint32), np.frombuffer(b, np.int64))
    return pd.DataFrame({"doc_id": ids, "n": n, "set_id": sets, "shared": shared})


def _regions(parts: int):
    """Sets of documents and the shared shingles among the rarest of each, which are its regions, with their places and the tasks that each is dealt to, by the documents that hold it."""

    def regions(frame: pd.DataFrame) -> pd.DataFrame:
        own, said, ids, n, _, sets = _gathered(frame)
        keys = np.frombuffer(own["d"], np.uint64)
        code = np.concatenate([np.frombuffer(x, np.uint64) for x in said["a"]] or [_EMPTY])
        df = np.concatenate([np.frombuffer(x, np.int64) for x in said["b"]] or [np.empty(0, np.int64)])
        order = np.argsort(code)
        code, df = code[order], df[order]
        out, start = [], 0
        for i, size in enumerate(n):
            own_keys = keys[start : start + size]
            start += size
            if not size or not len(code):
                continue
            c = _code(own_keys, parts)
            at = np.minimum(np.searchsorted(code, c), len(code) - 1)
            rare = np.where(code[at] == c, df[at], 1)
            first = np.lexsort((own_keys, rare))[: _window(int(size))]
            places = np.flatnonzero(rare[first] > 1)
            first = first[places]
            if len(first):
                out.append((sets[i], int(size), own_keys.tobytes(), own_keys[first].view(np.int64), places, -(-rare[first] // SPLIT)))
        return pd.DataFrame(out, columns=["set_id", "n", "keys", "regions", "places", "salts"])

    return regions


def _distance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        both, links = [], []
        for x, y in zip(frame["keys_x"], frame["keys_y"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - common
            both.append(1 - common / union)
            links.append(DEN * common >= NUM * union)
        yield pd.DataFrame({"x": frame["x"], "y": frame["y"], "d": both, "linked": links}, columns=["x", "y", "d", "linked"])


def _n_parts(docs: DataFrame) -> int:
    """Parts of the shingle counts, in proportion to the texts, so that a part is of like size whatever their number."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(1, -(-chars // PART_CHARS))


def _counted(docs: DataFrame, with_sets: bool, run, schema: str) -> DataFrame:
    """run(rows of a batch) for each batch of docs, with what all parts of the shingle counts say of it.

    A batch is split into FAN rows at most, whatever the number of parts, and so is
    what a part says; beyond that many parts both are split digit by digit, with an
    exchange for each, so the work for a text doesn't grow with the number of texts.
    """
    parts = _n_parts(docs)
    levels = _levels(parts)
    tasks = min(TASKS, max(1, parts // TOGETHER))
    told = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_packer(parts, with_sets, levels, FAN), _PACKED)
    for level in range(2, levels + 1):
        told = told.repartition(tasks, "part").mapInPandas(_splitter(level, levels, FAN), _PACKED)
    counter = _counter(with_sets) if levels == 1 else _counter_of_levels(with_sets, FAN)
    # rows about a batch are no part's; they go by the batch
    told = told.repartition(tasks, "part").groupBy("part").applyInPandas(counter, _PACKED)
    for level in range(2, levels + 1):
        told = told.repartition(tasks, "part").mapInPandas(_returner(level, FAN), _PACKED)
    if levels == 1:
        # the row about a batch carries the number of parts from here on
        told = told.withColumn("part", F.when(F.col("kind") == 1, F.lit(parts)).otherwise(F.col("part")))
        return told.groupBy("batch").applyInPandas(_trimming(run(parts)), schema)
    return told.groupBy("part").applyInPandas(_trimming(_by_batch(run(parts), with_sets)), schema)


def _levels(parts: int) -> int:
    """Digits of the parts."""
    levels = 1
    while FAN**levels < parts:
        levels += 1
    return levels


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), set_id (equal for equal sets) and shared (shingles that other documents hold, or seem to) of each row; written."""
    return written(_counted(docs, False, lambda _: _documents, "doc_id long, n long, set_id binary, shared long"), "sets")


def _with_regions(docs: DataFrame) -> DataFrame:
    return written(_counted(docs, True, _regions, "set_id binary, n long, keys binary, regions array<long>, places array<long>, salts array<long>"), "regions")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, d, linked of distinct pairs, by the exact sets."""
    keys = sets.select("set_id", "keys")
    both = pairs.join(keys.select(F.col("set_id").alias("x"), F.col("keys").alias("keys_x")).hint("merge"), "x")
    both = both.join(keys.select(F.col("set_id").alias("y"), F.col("keys").alias("keys_y")).hint("merge"), "y")
    return both.select("x", "y", "keys_x", "keys_y").mapInPandas(lean(_distance), "x binary, y binary, d double, linked boolean")


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges u, v of a task as edges from each node to the smallest that it can reach by them."""
    up: dict = {}

    def root(x):
        top = x
        while (over := up.get(top, top)) != top:
            top = over
        while x != top:
            up[x], x = top, up[x]
        return top

    for frame in frames:
        for u, v in zip(frame["u"], frame["v"], strict=True):
            a, b = sorted((root(u), root(v)))
            if a != b:
                up[b] = a
    nodes = list(up)
    yield pd.DataFrame({"u": nodes, "v": [root(x) for x in nodes]}, columns=["u", "v"])


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """node and root (the smallest node it can reach) of each node of edges u, v, without the roots; and the table's path.

    Each task joins its own edges to stars; those of several tasks are united by
    large-star and small-star rounds. edges is read twice, so it should be written.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    tasks = max(1, -(-pairs.count() // STARS))
    kind = pairs.schema["u"].dataType.simpleString()
    edges, path = stored(pairs.coalesce(tasks).mapInPandas(lean(_stars), f"u {kind}, v {kind}"), "edges")
    before = None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        edges, path = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(spark, old)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), path


def _dealt(regions: DataFrame) -> DataFrame:
    """A row of regions (region, salts, ...) for each of the tasks that a region is dealt to."""
    return regions.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).drop("salts")


def _met(members: DataFrame, regions: DataFrame, few: bool) -> DataFrame:
    """members with the columns of regions (region, salts, ...), a row or a few for each region; few are broadcast, else they go to all tasks of their region."""
    if few:
        return members.join(F.broadcast(regions.drop("salts")), "region")
    return members.join(_dealt(regions).hint("merge"), ["region", "salt"])


def linked_sets(sets: DataFrame) -> DataFrame | None:
    """node and root of the sets that link with another set: joins the regions round by round.

    A region with many members is dealt to several tasks by a hash of the member;
    what is joined to them, a row or a few for each region, goes to all of these.
    Tables of a round are removed when the next one has been written.
    """
    spark = sets.sparkSession
    at = sets.select(F.explode(F.arrays_zip("regions", "places", "salts")).alias("at"), "set_id", "n")
    salt = F.pmod(F.xxhash64("set_id"), F.col("at.salts"))
    at = at.select(F.col("at.regions").alias("region"), salt.alias("salt"), F.col("at.salts").alias("salts"), F.col("at.places").alias("place"), "set_id", F.lit(None).cast("double").alias("ring"), F.col("set_id").alias("root"), "n")
    members, members_path = stored(at, "members")
    edges = roots = roots_path = None
    pivots = PIVOTS
    while True:
        still = members.groupBy("region").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("salts").alias("salts")).where("a != b").select("region", "salts")
        still, still_path = stored(still, "open")
        n_open = still.count()
        if not n_open:
            for path in (members_path, still_path):
                removed(spark, path)
            return roots
        members = _met(members, still, n_open <= MET)
        # one pivot for each of so many parts of a region, by a minimum that is combined before the exchange
        part = F.pmod(F.xxhash64("set_id", F.lit(pivots)), F.lit(pivots))
        chosen = members.groupBy("region", part.alias("of")).agg(F.min(F.struct("set_id", "ring", "root", "n", "place", "salts")).alias("p"))
        chosen, chosen_path = stored(chosen.select("region", F.col("p.salts").alias("salts"), F.col("p.set_id").alias("pivot"), F.col("p.ring").alias("p_ring"), F.col("p.root").alias("p_root"), F.col("p.n").alias("p_n"), F.col("p.place").alias("p_place")), "pivots")
        few = chosen.count() <= MET
        near = _met(members, chosen, few).where("root != p_root")
        # the region of the rarest common shingle has the whole overlap at or behind it in both sets
        least = NUM * (F.col("n") + F.col("p_n"))
        near = near.where(((NUM + DEN) * (F.col("n") - F.col("place")) >= least) & ((NUM + DEN) * (F.col("p_n") - F.col("p_place")) >= least))
        near = near.where(F.coalesce(F.abs(F.col("ring") - F.col("p_ring")) <= RADIUS + 1e-9, F.lit(True)))
        pairs = near.select(F.greatest("set_id", "pivot").alias("x"), F.least("set_id", "pivot").alias("y")).distinct()
        measured, measured_path = stored(_measured(pairs, sets), "distances")
        new = measured.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
        if roots is None or new.limit(1).count():
            old = roots_path
            roots, roots_path = components(new if edges is None else edges.unionByName(new))
            if old:
                removed(spark, old)
            edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        # pivots have met every member of their region and leave it
        rest = members.join(sized(chosen.select("region", F.col("pivot").alias("set_id")), MET), ["region", "set_id"], "left_anti")
        if pivots == 1:
            ring = measured.select(F.col("x").alias("set_id"), F.col("y").alias("pivot"), "d").unionByName(measured.select(F.col("y").alias("set_id"), F.col("x").alias("pivot"), "d"))
            rest = _met(rest.drop("ring"), chosen.select("region", "salts", "pivot"), few).join(sized(ring, MET), ["set_id", "pivot"], "left").withColumn("ring", F.col("d"))
        rest = rest.drop("root").join(sized(roots.select(F.col("node").alias("set_id"), "root"), MET), "set_id", "left")
        old = members_path
        members, members_path = stored(rest.select("region", "salt", "salts", "set_id", "ring", F.coalesce("root", "set_id").alias("root"), "n", "place"), "members")
        for path in (old, still_path, chosen_path, measured_path):
            removed(spark, path)
        pivots *= GROWTH


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    Rows with equal doc_id count as one document with several texts only in what
    they link; each row is returned. Empty and null texts, and texts of white
    space, have n_shingles 0 and are their own component; texts under five words
    are one shingle. Rows without a doc_id link with nothing and have a null
    component_id. An empty table gives no rows. Other columns are ignored. docs
    should be a table, or written, since it is read twice.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = given.where("doc_id IS NOT NULL")
    rows = document_sets(known)
    classes = rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.max("shared").alias("shared"))
    classes = written(classes, "classes")
    may = written(classes.where(F.col("shared") * DEN >= F.col("n") * NUM).select(F.col("first_id").alias("doc_id")).distinct(), "candidates")
    sets = _with_regions(only_ids(known, may, "doc_id"))
    sets = sets.dropDuplicates(["set_id"]) if rows.groupBy("doc_id").count().where("count > 1").limit(1).count() else sets
    roots = linked_sets(sets)
    if roots is None:
        named = classes.select("set_id", F.col("first_id").alias("component_id"))
    else:
        rooted = classes.join(sized(roots.select(F.col("node").alias("set_id"), "root"), MET), "set_id", "left")
        rooted = written(rooted.select("set_id", "first_id", F.coalesce("root", "set_id").alias("root")), "rooted")
        # only sets that link have another name than their own, and a component may hold most of them: they aren't dealt out by root
        linked = rooted.where("root != set_id").unionByName(rooted.join(sized(roots.select(F.col("root").alias("set_id")).distinct()), "set_id", "left_semi").select(rooted.columns))
        smallest = written(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
        named = linked.join(sized(smallest), "root").select("set_id", "component_id")
        named = written(named.unionByName(rooted.join(sized(named.select("set_id")), "set_id", "left_anti").select("set_id", F.col("first_id").alias("component_id"))), "named")
    out = rows.join(named.hint("merge"), "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(_without_id(given))


def _without_id(given: DataFrame) -> DataFrame:
    count = F.pandas_udf(lambda s: s.map(lambda x: len(shingle_set(x))).astype("int64"), "long")
    lost = given.where("doc_id IS NULL")
    return lost.select("doc_id", count("text").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id; rows that repeat its doc_id go."""
    found = written(jaccard_join(docs).where("doc_id IS NOT NULL"), "groups")
    gone = written(found.where("component_id != doc_id").select("doc_id").distinct(), "gone")
    twice = written(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = only_ids(docs, gone, "doc_id", "left_anti").select(docs.columns)
    once = only_ids(kept, twice, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(only_ids(kept, twice, "doc_id").select(docs.columns).dropDuplicates(["doc_id"]))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
