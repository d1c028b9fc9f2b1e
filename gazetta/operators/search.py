"""Ranked full-text search over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.text import preview, query_tokens, tokens
from gazetta.operators.index import Inverted

K1, B = 1.2, 0.75


def checked(query: str) -> str:
    if not query or not query.strip():
        raise ValueError("the query is empty")
    return query


def selected_sources(choice: str) -> list[str]:
    """Sources of a choice in the interface."""
    return ["NSE", "SEBI"] if choice == "All" else [choice]


def filtered(chunks: DataFrame, filters: dict[str, list] | None) -> DataFrame:
    """Rows with one of the values in each named column; None doesn't filter, an empty list lets nothing through."""
    for name, values in (filters or {}).items():
        if values is not None:
            chunks = chunks.where(F.col(name).isin(list(values)) if values else F.lit(False))
    return chunks


def bm25(tf: Column, dl: Column, df: Column, n: Column, average: Column, times: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def with_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """The columns of chunks, the number of tokens (dl), and how often each term stands among them (tf0, tf1, ...)."""
    own = chunks.select("*", tokens("chunk_text").alias("_tokens"))
    counts = [(F.size("_tokens") - F.size(F.array_remove("_tokens", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    return own.select(*chunks.columns, F.size("_tokens").alias("dl"), *counts)


def search(chunks: DataFrame, query: str, filters: dict[str, list] | None = None, size: int = 40) -> DataFrame:
    """The best chunks for a query: score and the columns of chunks, best first, ties by chunk_id.

    Needs no index, and reads all chunks: once narrow, for the statistics, which are
    of the whole index, and once for the rows with a term. search_index reads the
    postings of the query's terms instead.
    """
    words = query_tokens(checked(query))
    terms = sorted(set(words))
    if not terms:
        return chunks.limit(0).select(F.lit(0.0).alias("score"), *chunks.columns)
    counts = with_counts(chunks.select("chunk_text"), terms)
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("average"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        score = score + F.when(F.col(f"tf{i}") > 0, bm25(F.col(f"tf{i}"), F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("average"), F.lit(words.count(t)))).otherwise(0.0)
    ranked = with_counts(filtered(chunks, filters), terms).crossJoin(F.broadcast(stats)).withColumn("score", score)  # stats is one row
    # the score is positive with any term; a condition on both sides stays above the counts, which so are made once
    return ranked.where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(size).select("score", *chunks.columns)


def search_index(index: Inverted, chunks: DataFrame, query: str, filters: dict[str, list] | None = None, size: int = 40) -> DataFrame:
    """The same from an inverted index: reads the postings of the query's terms, and of chunks the rows that can be among the best.

    Without filters the best are known before chunks is read, so it is joined with
    `size` rows at most; with filters it is filtered first.
    """
    words = query_tokens(checked(query))
    terms = sorted(set(words))
    times = F.coalesce(*[F.when(F.col("term") == t, F.lit(words.count(t))) for t in terms], F.lit(0))
    hits = index.postings.where(F.col("term").isin(terms)).select("term", "chunk_id", "tf", "dl", times.alias("times"))
    of_terms = index.terms.where(F.col("term").isin(terms)).select(F.col("term").alias("_term"), "df")  # a row for each word of the query
    hits = hits.join(F.broadcast(of_terms), F.col("term") == F.col("_term")).crossJoin(F.broadcast(index.totals))  # totals is one row
    # summed up in the order of the terms, so that equal scores are equal to the last digit
    part = F.struct("term", bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("average"), F.col("times")).alias("score"))
    parts = hits.groupBy("chunk_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a part for each term of the query
    scores = parts.select("chunk_id", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["score"]).alias("score"))
    if not any(v is not None for v in (filters or {}).values()):
        scores = F.broadcast(scores.orderBy(F.desc("score"), "chunk_id").limit(size))  # `size` rows
    return filtered(chunks, filters).join(scores, "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(size).select("score", *chunks.columns)


def response(hits: DataFrame, query: str, escape: bool = False) -> DataFrame:
    """id, score, preview and document of each hit."""
    document = F.struct(*[c for c in hits.columns if c != "score"])
    return hits.select(F.col("chunk_id").alias("id"), "score", preview("chunk_text", query, escape).alias("preview"), document.alias("document"))
