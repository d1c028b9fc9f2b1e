"""Quality classifier: a sparse ensemble of rules over text statistics.

The statistics are Spark column expressions. A bounded sample of labelled rows is
fetched with its statistics; small boosted trees are grown on it, every path from
a root is a conjunction of thresholds and so a rule, and a logistic regression
with an L1 penalty keeps few of them. The kept rules become one Spark expression
again, so scoring is a projection over the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm.common import WORD, table, written

#: Labelled rows to learn from, at most: those with the smallest hashes of doc_id.
SAMPLE = 20_000
#: Trees, their depth, smallest leaf as a share of the sample, and thresholds tried for a statistic.
TREES, DEPTH, LEAF, BINS = 24, 3, 0.004, 24
#: L1 penalty of the logistic regression, for rows in mean.
PENALTY = 0.0015


def statistics(text: Column | str = "text") -> dict[str, Column]:
    """Statistics by name; a null text counts as empty."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words = F.split(text, r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    return {
        "n_chars": F.length(text).cast("double"),
        "n_words": count(WORD).cast("double"),
        "word_length": F.length(text) / F.greatest(count(WORD), F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "words_per_distinct": F.size(words) / F.sqrt(F.size(F.array_distinct(words)) * F.size(words)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "symbols": count(r"[#*$%&|<>]") / chars,
        "exclaimed": count("!") / chars,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count("[0-9]") / chars,
        "stops": count("[.,;:?]") / chars,
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, threshold, above) that all hold, and a weight."""

    conditions: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0

    def column(self) -> Column:
        held = F.lit(True)
        for name, at, above in self.conditions:
            held = held & ((F.col(name) > at) if above else (F.col(name) <= at))
        return F.when(held, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        logit = F.lit(self.intercept)
        for rule in self.rules:
            logit = logit + rule.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _tree(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: tuple, least: int, out: list) -> None:
    """Grows one tree by Newton gain; out gets (rows, path, value) of the leaves, and of inner nodes with value None."""
    g, h = residual[rows].sum(), weight[rows].sum() + 1.0
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 2 * least:
        for j, at in enumerate(cuts):
            left = x[rows, j][:, None] <= at
            n, gl, hl = left.sum(0), residual[rows] @ left, weight[rows] @ left + 1.0
            gain = gl**2 / hl + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / h
            gain[(n < least) | (len(rows) - n < least)] = 0
            if len(at) and gain.max() > best[0]:
                best = (gain.max(), (j, at[gain.argmax()]))
    if path:
        out.append((rows, path, None if best[1] else g / h))
    elif not best[1]:
        return
    if best[1]:
        j, at = best[1]
        side = x[rows, j] <= at
        _tree(x, cuts, residual, weight, rows[side], (*path, (j, at, False)), least, out)
        _tree(x, cuts, residual, weight, rows[~side], (*path, (j, at, True)), least, out)


def _paths(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 2)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] if len(col) else c for c, col in zip(cuts, x.T, strict=True)]
    least, logit, paths = max(2, int(LEAF * len(y))), np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        nodes: list = []
        _tree(x, cuts, y - p, p * (1 - p), np.arange(len(y)), (), least, nodes)
        for rows, path, value in nodes:
            paths[path] = None
            if value is not None:
                logit[rows] += 0.3 * np.clip(value, -4, 4)
        if not nodes:
            break
    return list(paths)


def _lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    scale = z.std(0) + 1e-9
    z1 = np.c_[np.ones(len(y)), (z - z.mean(0)) / scale]
    w = v = np.zeros(z1.shape[1])
    step, t = 4 / max(np.linalg.eigvalsh(z1.T @ z1 / len(y))[-1], 1e-9), 1.0
    for _ in range(600):
        grad = z1.T @ (1 / (1 + np.exp(-z1 @ v)) - y) / len(y)
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (last - 1) / t * (new - w)
        w = new
    weights = w[1:] / scale
    return float(w[0] - weights @ z.mean(0)), weights


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """A model of rows of statistics x and labels y; without both labels, the smoothed share of label 1."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), ())
    paths = _paths(x, y)
    held = lambda path: np.all([(x[:, j] > at) == above for j, at, above in path], axis=0)
    rules, seen = [], set()
    for path in paths:
        if (bits := np.packbits(held(path)).tobytes()) not in seen:
            seen.add(bits)
            rules.append(path)
    if not rules:
        return fit(x, y[:0], names)
    intercept, weights = _lasso(np.stack([held(p) for p in rules], 1).astype(float), y)
    kept = [Rule(tuple((names[j], float(at), bool(above)) for j, at, above in p), float(w)) for p, w in zip(rules, weights, strict=True) if abs(w) > 1e-4]
    return Model(intercept, tuple(kept))


def remainder(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, modulo 3; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns labels.quality from at most `sample` labelled rows that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(remainder("doc_id") != 1)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most `sample` pairs of numbers, which bounds the broadcast and what the driver gets
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    stats = statistics()
    rows = docs.select("doc_id", "text").dropna(subset=["doc_id"]).join(F.broadcast(known), "doc_id")
    # of rows that repeat a doc_id one counts, the same in every run: `sample` rows at most
    rows = rows.select("doc_id", F.struct("quality", *[c.alias(k) for k, c in stats.items()]).alias("row"))
    got = rows.groupBy("doc_id").agg(F.min("row").alias("row")).orderBy("doc_id").select("row.*").toPandas()
    return fit(got[list(stats)].to_numpy(float), got["quality"].to_numpy(float), list(stats))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, with the columns of docs before them under their own names in `_doc`.

    Null and empty texts get the score of their statistics, which are those of an
    empty text; repeated rows get equal scores; an empty table gives no rows.
    Columns of any name may stand beside doc_id and text.
    """
    rows = _scores(docs, model)
    return rows.select("_doc", F.col("_doc.doc_id").cast("long").alias("doc_id"), (remainder(F.col("_doc.doc_id").cast("string")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scores(docs: DataFrame, model: Model) -> DataFrame:
    """_doc, score and _at. A filter that names _at isn't moved below the statistics, where each rule would compute its own anew."""
    stats = statistics(F.col("_doc.text"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    rows = rows.select("_doc", F.monotonically_increasing_id().alias("_at"), *[c.alias(k) for k, c in stats.items()])
    return rows.select("_doc", "_at", model.score().alias("score"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).drop("_doc")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled documents of the corpus."""
    model = train(docs, table(spark, sf_dir, "labels"))
    kept = _scores(docs, model).where("_at >= 0 AND score >= 0.5")
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


QUERIES = {"op10_quality_rules": op10_quality_rules}
