"""Whitening of embeddings by QDWH spectral divide and conquer.

The covariance of the distinct vectors is summed up by Spark; what the driver holds
are sums by dimension and one matrix of the dimensions, whatever the number of rows.
Its invariant subspaces are split by polar decompositions: with a shift between two
eigenvalues, the polar factor U of the shifted matrix has the eigenvalues 1 and -1,
and (U + I) / 2 projects on the subspace above the shift. U comes from the dynamically
weighted Halley iteration in its QR form (Nakatsukasa, Bai and Gygi 2010; Nakatsukasa
and Higham 2013). Each part is split again until it has one dimension or nothing
to split; parts below the components that are wanted aren't. The components, divided by
the roots of their eigenvalues, then go with each task over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm.common import lean, table, written

#: Components that the query returns, and steps of a unit of an entry.
COMPONENTS, STEPS = 4, 256
#: A component is kept if its eigenvalue is more than this share of the largest.
LEAST = 1e-10
#: A subspace is split no further if its matrix is a multiple of the identity up to this share of the whole's norm.
FLAT = 1e-15
#: Rows of a matrix that a task makes at once.
ROWS = 4096
#: Groups in which what tasks say is summed up before it is summed up altogether.
GROUPS = 32

_LONG = 2**62


# ---- QDWH ----------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, itself symmetric, by the dynamically weighted Halley iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds all singular values
    low = 1e-16  # a bound too low costs a step or two
    for _ in range(40):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 1e-15 and moved < 1e-8:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of a symmetric matrix, the one of the larger eigenvalues first; None if no shift tells them apart."""
    n = len(a)
    center, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    best = None
    # the mean lies between the least and the largest eigenvalue; others serve where it is one of them or near
    for move in (0.0, 0.3, -0.3, 0.13, -0.13, 0.6, -0.6):
        u = polar(a - (center + move * spread) * np.eye(n))
        above = (u + np.eye(n)) / 2
        k = round(np.trace(above))
        if not 0 < k < n:
            continue
        # two steps of subspace iteration with the projector
        start = above @ np.random.default_rng(n).standard_normal((n, k))
        basis = np.linalg.qr(above @ np.linalg.qr(start)[0], mode="complete")[0]
        high, rest = basis[:, :k], basis[:, k:]
        error = np.linalg.norm(rest.T @ a @ high)
        if best is None or error < best[0]:
            best = error, high, rest
        if error <= 1e-14 * np.linalg.norm(a):
            break
    return best and best[1:]


def eigen(a: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix (all if None), falling, and their unit eigenvectors as rows."""
    n = len(a)
    k = n if k is None else min(k, n)
    a = (a + a.T) / 2
    norm = np.linalg.norm(a)
    done: list[tuple[float, np.ndarray]] = []
    todo = [(np.eye(n), a)]  # the subspace of the largest eigenvalues is last
    while todo and len(done) < k:
        basis, own = todo.pop()
        own = (own + own.T) / 2
        m = len(own)
        flat = np.linalg.norm(own - np.trace(own) / m * np.eye(m)) <= FLAT * norm
        parts = None if m == 1 or flat else split(own)
        if parts is None:
            done += [(own[i, i], basis[:, i]) for i in range(m)]
            continue
        high, rest = parts
        todo += [(basis @ rest, rest.T @ own @ rest), (basis @ high, high.T @ own @ high)]
    done.sort(key=lambda x: -x[0])
    vectors = np.array([v / np.linalg.norm(v) for _, v in done[:k]]).reshape(-1, n)
    return np.array([v @ a @ v for v in vectors]), vectors


# ---- vectors ---------------------------------------------------------------


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a column of lists and their entries as long x = floor(STEPS * c), by the lists' length; without rows that are null or hold null or non-finite entries."""
    column = column.cast(pa.large_list(pa.float64()))
    edge = np.asarray(column.offsets, np.int64)
    size = np.diff(edge)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    fine = valid & (bad[edge[1:]] == bad[edge[:-1]])
    out = {}
    for d in np.unique(size[fine]):
        rows = np.flatnonzero(fine & (size == d))
        entries = flat[edge[rows][:, None] + np.arange(d)] if d else np.empty((len(rows), 0))
        out[int(d)] = rows, np.clip(np.floor(STEPS * entries), -_LONG, _LONG).astype(np.int64)
    return out


_WIDTHS = ((np.int16, 2), (np.int32, 4), (np.int64, 8))


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the narrowest width that holds it, so that equal rows are equal bytes."""
    out: list = [b""] * len(x)
    top = np.abs(x).max(1, initial=0)
    width = np.digitize(top, [1 << 15, 1 << 31])
    for w, (kind, _) in enumerate(_WIDTHS):
        for i, row in zip(np.flatnonzero(width == w), x[width == w].astype(kind), strict=True):
            out[i] = bytes([w]) + row.tobytes()
    return out


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(b[1:], _WIDTHS[b[0]][0]).astype(np.int64) for b in column.to_pylist()])


def fit_list(vectors: DataFrame) -> DataFrame:
    """d (length) and x (packed) of each distinct vector of vectors (embedding); written. A batch leaves out its own repeats, a task those of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for d, (_, x) in _matrix(batch.column(0).slice(at, ROWS)).items():
                    own = list(dict.fromkeys(_packed(x)))
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(own), pa.int32()), pa.array(own, pa.binary())], names=["d", "x"])

    return written(vectors.select("embedding").mapInArrow(lean(run), "d int, x binary").distinct(), "fit")


def _told(fit: DataFrame, start: Callable, add: Callable, join: Callable, schema: str) -> list:
    """What all rows say: each task folds its vectors, then groups of tasks are joined, then these by the driver, GROUPS rows at most.

    start() gives a state, add(state, x) and join(state, state) states; a state is a dict of arrays by the names of schema.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                x = _unpacked(batch.column(0).slice(at, ROWS))
                state = add(start(x.shape[1]) if state is None else state, x)
        if state is not None:
            part = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_pylist([{"part": part} | {c: np.asarray(state[c]).ravel().tolist() for c in names}], _arrow(names, schema))

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        state = _joined(frame, join)
        return pd.DataFrame([{c: np.asarray(state[c]).ravel().tolist() for c in names}])

    told = fit.select("x").mapInArrow(lean(run), f"part int, {schema}")
    rows = told.groupBy("part").applyInPandas(together, schema).toPandas()
    return _joined(rows, join) if len(rows) else None


def _arrow(names: list[str], schema: str) -> pa.Schema:
    kinds = {"array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([("part", pa.int32()), *[(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]])


def _joined(frame: pd.DataFrame, join: Callable) -> dict:
    names = [c for c in frame.columns if c != "part"]
    states = [{c: list(v) for c, v in zip(names, row, strict=True)} for row in frame[names].itertuples(index=False)]
    state = states[0]
    for other in states[1:]:
        state = join(state, other)
    return state


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of the vectors of a fit list, and their exact sums by dimension."""

    def add(state: dict, x: np.ndarray) -> dict:
        exact = x.sum(0).tolist() if np.abs(x).max(initial=0) < _LONG // ROWS else [sum(c) for c in x.T.tolist()]
        return {"n": [state["n"][0] + len(x)], "s": [str(int(a) + b) for a, b in zip(state["s"], exact, strict=True)]}

    def join(a: dict, b: dict) -> dict:
        return {"n": [a["n"][0] + b["n"][0]], "s": [str(int(p) + int(q)) for p, q in zip(a["s"], b["s"], strict=True)]}

    told = _told(fit, lambda d: {"n": [0], "s": ["0"] * d}, add, join, "n array<long>, s array<string>")
    return (0, []) if told is None else (int(told["n"][0]), [int(x) for x in told["s"]])


def covariance(fit: DataFrame, n: int, total: list[int], weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the vectors of a fit list, or of what weights (rows) make of them: centred before multiplying.

    Without weights the centre is known exactly; with them each batch is centred at
    its own mean, and the means are joined with the sums of products.
    """
    mean = np.array([float(t // n) + (t % n) / n for t in total])
    w = weights

    def add(state: dict, x: np.ndarray) -> dict:
        own = x - mean
        if w is None:
            return {"m": [0.0], "c": np.asarray(state["c"]) + (own.T @ own).ravel(), "k": [0.0]}
        own = own @ w.T
        center = own.mean(0)
        return join(state, {"k": [float(len(own))], "m": center, "c": ((own - center).T @ (own - center)).ravel()})

    def join(a: dict, b: dict) -> dict:
        c = np.asarray(a["c"]) + np.asarray(b["c"])
        if w is None:
            return {"k": [0.0], "m": [0.0], "c": c}
        ka, kb, ma, mb = a["k"][0], b["k"][0], np.asarray(a["m"]), np.asarray(b["m"])
        apart = mb - ma
        return {"k": [ka + kb], "m": ma + apart * kb / (ka + kb), "c": c + np.outer(apart, apart).ravel() * ka * kb / (ka + kb)}

    size = len(total) if w is None else len(w)
    told = _told(fit, lambda d: {"k": [0.0], "m": [0.0] if w is None else np.zeros(size), "c": np.zeros(size * size)}, add, join, "k array<double>, m array<double>, c array<double>")
    return np.asarray(told["c"]).reshape(size, size) / n


# ---- whitening -------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """n vectors and their exact sums; components by falling eigenvalue as rows, and what whitens: they over the roots of the eigenvalues."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)[:, None]


def fitted(vectors: DataFrame, components: int | None = COMPONENTS) -> Whitening | None:
    """The whitening of vectors (embedding), from each distinct one once; None without a vector. Components without variance (LEAST) are left out."""
    fit = fit_list(vectors)
    lengths = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()  # one row
    if not lengths:
        return None
    fit = fit.where(F.col("d") == lengths[0]["d"])
    n, total = sums(fit)
    if not total:
        return Whitening(n, total, np.empty(0), np.empty((0, 0)), 0.0, 0.0)
    v = covariance(fit, n, total)
    values, directions = eigen(v, components) if v.any() else (np.empty(0), np.empty((0, len(total))))
    kept = values > LEAST * max(values, default=0.0)
    out = Whitening(n, total, values[kept], directions[kept], float(np.trace(v)), 0.0)
    if not len(out.values):
        return out
    error = np.abs(covariance(fit, n, total, out.weights) - np.eye(len(out.values))).max()
    return Whitening(out.n, out.total, out.values, out.vectors, out.trace, float(error))


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - total) ** 2 of each row, exact; None beyond a long."""
    top = float(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)
    if top * top * max(1, len(total)) < 2**62:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * a - t) ** 2 for a, t in zip(row, total, strict=True)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whitened(vectors: DataFrame, components: int | None = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row of vectors (vec_id, embedding) and component.

    Rows whose vector is null, or holds null or non-finite entries, have none; nor have
    those of another length than most distinct vectors have (of two lengths that are as
    frequent the larger counts). Repeated rows are returned each and fit once; a null
    vec_id stays null. Without two different vectors nothing varies, and there are no
    components and no rows, as with an empty table; with few dimensions or vectors there
    are as many as vary. Entries beyond 2^62 / 256 count as that; a deviation beyond
    a long is null. Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fitted(vectors, components)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], schema)
    weights, mean, d, k = fit.weights, np.array([float(t // fit.n) + (t % fit.n) / fit.n for t in fit.total]), len(fit.total), len(fit.values)
    explained, total, n, error = fit.values / fit.trace, fit.total, fit.n, fit.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                rows, x = _matrix(some.column(1)).get(d, (np.empty(0, np.int64), np.empty((0, d), np.int64)))
                each = pa.array(np.repeat(rows, k))
                m = len(rows) * k
                deviation = pa.array(deviations(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                arrays = [
                    some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, n)), deviation,
                    pa.array(((x - mean) @ weights.T).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(m, error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(lean(run), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
