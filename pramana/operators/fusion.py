"""Fusion of ranked lists: weighted scores, reciprocal ranks, and reciprocal ranks by the scripts a list can reach."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.operators.postings import rounded

RRF_K = 60


def normalized(run: DataFrame, how: str = "minmax") -> DataFrame:
    """``run`` (qid, pid, score, ...) with ``norm``: the score by the query's range (0.5 where all are equal) or deviation (0 then)."""
    w = Window.partitionBy("qid")
    if how == "minmax":
        low, high = F.min("score").over(w), F.max("score").over(w)
        return run.withColumn("norm", F.when(high - low < 1e-12, 0.5).otherwise((F.col("score") - low) / F.greatest(high - low, F.lit(1e-300))))
    if how != "zscore":
        raise ValueError("how: minmax or zscore")
    mean, sd = F.avg("score").over(w), F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0))
    return run.withColumn("norm", F.when(sd < 1e-12, 0.0).otherwise((F.col("score") - mean) / F.greatest(sd, F.lit(1e-300))))


def _both(lexical: DataFrame, dense: DataFrame, *columns: str) -> DataFrame:
    left = lexical.select("qid", "pid", F.col("rank").alias("lex_rank"), *[F.col(c).alias(f"lex_{c}") for c in columns])
    right = dense.select("qid", "pid", F.col("rank").alias("dense_rank"), *[F.col(c).alias(f"dense_{c}") for c in columns])
    return left.join(right, ["qid", "pid"], "full_outer")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best; equal scores: first the lexical list in its order, then what only the dense one has."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("lex_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last(), "pid")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("qid", "pid", "score", "rank")


def weighted(lexical: DataFrame, dense: DataFrame, *, alpha: float | Column = 0.4, k: int = 10, how: str = "minmax") -> DataFrame:
    """alpha * lexical + (1 - alpha) * dense normalized scores; a list that lacks a passage adds 0."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    both = _both(normalized(lexical, how), normalized(dense, how), "norm")
    score = F.round(a * F.coalesce("lex_norm", F.lit(0.0)) + (1 - a) * F.coalesce("dense_norm", F.lit(0.0)), 9)
    return _ranked(both.withColumn("score", score), k)


def reciprocal(lexical: DataFrame, dense: DataFrame, *, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """The sum of 1 / (rrf_k + rank) over both lists."""
    vote = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    return _ranked(_both(lexical, dense).withColumn("score", F.round(vote("lex_rank") + vote("dense_rank"), 9)), k)


def reciprocal_many(runs: DataFrame, *, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal ranks over any number of lists in ``runs`` (qid, pid, rank); equal scores go by the best rank, then by id."""
    sums = runs.groupBy("qid", "pid").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("lex_rank"), F.count(F.lit(1)).alias("lists")).withColumn("dense_rank", F.lit(0))
    return _ranked(sums, k)


def script_aware(lexical: DataFrame, dense: DataFrame, passage_scripts: DataFrame, query_scripts: DataFrame, *, k: int = 10, rrf_k: int = RRF_K, count_observed_votes: bool = False) -> DataFrame:
    """Reciprocal ranks scaled by 2 / the number of lists that could have found the passage.

    The lexical list can find a passage in the query's own script, or any if the query is mixed or unknown; the dense one any.
    With ``count_observed_votes`` a list that did find a passage could. ``passage_scripts`` (pid, script), ``query_scripts``
    (qid, script); a passage without one is unknown.
    """
    both = _both(lexical, dense).join(passage_scripts.select("pid", F.col("script").alias("p")), "pid", "left").join(query_scripts.select("qid", F.col("script").alias("q")), "qid", "left")
    q, p = F.coalesce("q", F.lit("unknown")), F.coalesce("p", F.lit("unknown"))
    could = q.isin("mixed", "unknown") | (p == q)
    if count_observed_votes:
        could = could | F.col("lex_rank").isNotNull()
    vote = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    score = (vote("lex_rank") + vote("dense_rank")) * 2 / F.when(could, 2).otherwise(1)
    return _ranked(both.withColumn("score", F.round(score, 9)), k)


def explained(lexical: DataFrame, dense: DataFrame, passage_scripts: DataFrame, query_scripts: DataFrame, *, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """The ranking of ``script_aware`` with what it is made of: ``lexical_rank, dense_rank, lexical_vote, dense_vote, lists``, the number of lists that could have found the passage."""
    top = script_aware(lexical, dense, passage_scripts, query_scripts, k=k, rrf_k=rrf_k)
    x = top.join(_both(lexical, dense), ["qid", "pid"]).join(passage_scripts.select("pid", F.col("script").alias("p")), "pid", "left").join(query_scripts.select("qid", F.col("script").alias("q")), "qid", "left")
    q, p = F.coalesce("q", F.lit("unknown")), F.coalesce("p", F.lit("unknown"))
    vote = lambda r: F.round(F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0)), 9)
    return x.select("qid", "pid", "rank", "score", F.coalesce("lex_rank", F.lit(0)).alias("lexical_rank"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), vote("lex_rank").alias("lexical_vote"), vote("dense_rank").alias("dense_vote"), F.when(q.isin("mixed", "unknown") | (p == q), 2).otherwise(1).cast("bigint").alias("lists"))


def fused(lexical: list[tuple[np.ndarray, np.ndarray]], dense: list[tuple[np.ndarray, np.ndarray]], size: int, *, k: int, alpha: float | None = None, rrf_k: int = RRF_K, could=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(question, document, score, rank) as ``weighted`` (with alpha), ``script_aware`` (with could) or ``reciprocal`` fuse, of lists in arrays.

    For each question (documents, scores) by rank; ``size``: how many documents there are; ``could``: of arrays of questions and
    documents, whether both lists could have found the document.
    """
    sides = []
    for lists in (lexical, dense):
        n = np.array([len(d) for d, _ in lists], dtype="int64")
        q, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
        docs, scores = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
        high, low = scores[first], scores[first + np.repeat(n, n) - 1]
        norm = np.where(high - low < 1e-12, 0.5, (scores - low) / np.maximum(high - low, 1e-300))
        sides.append((q * size + docs, np.arange(len(q)) - first + 1.0, norm))
    keys = np.union1d(sides[0][0], sides[1][0])
    ranks, norms = [np.full(len(keys), np.inf) for _ in sides], [np.zeros(len(keys)) for _ in sides]
    for (key, rank, norm), r, v in zip(sides, ranks, norms):
        at = np.searchsorted(keys, key)
        r[at], v[at] = rank, norm
    q, docs = keys // max(size, 1), keys % max(size, 1)
    if alpha is not None:
        score = alpha * norms[0] + (1 - alpha) * norms[1]
    else:
        score = 1.0 / (rrf_k + ranks[0]) + 1.0 / (rrf_k + ranks[1])
        if could is not None:
            score = score * 2 / np.where(could(q, docs), 2, 1)
    score = rounded(score, 9)
    order = np.lexsort((docs, ranks[1], ranks[0], -score, q))
    q, docs, score = q[order], docs[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    best = rank <= k
    return q[best], docs[best], score[best], rank[best]
