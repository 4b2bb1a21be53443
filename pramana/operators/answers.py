"""Answers taken from passages, prompts, gates before an answer, and scores of answers against gold and evidence."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pramana.functions import text as T


def exact_match(prediction: Column, gold: Column) -> Column:
    """Equal in the form for comparison, or the same single amount."""
    return (T.normalize_answer(prediction) == T.normalize_answer(gold)) | F.coalesce(T.amount_key(prediction) == T.amount_key(gold), F.lit(False))


def token_f1(p: Column, g: Column) -> Column:
    """F1 of the multisets of words of two arrays (see answer_tokens; columns, no expressions with UDFs); 1 for two empty ones, 0 for one."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    overlap = F.aggregate(F.transform(F.array_distinct(p), lambda w: F.least(times(p, w), times(g, w))), F.lit(0), lambda a, x: a + x)
    n = F.size(p) + F.size(g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * overlap / F.greatest(n, F.lit(1)))


def _lcs(a, b) -> int:
    """Length of the longest common subsequence of two lists of words: rows of the table are the bits of one integer."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for w in a:
        hit = free & places.get(w, 0)
        free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


def rouge_l_precision(answer: Column, passage: Column) -> Column:
    """Longest common subsequence of answer and passage over the answer's words; 0 for an empty answer."""
    return _rouge_udf()(T.answer_tokens(answer), T.answer_tokens(passage))


def _rouge_udf():
    @F.pandas_udf(DoubleType())
    def rouge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lcs(x, y) / len(x) if len(x) else 0.0 for x, y in zip(a, b)], dtype="float64")

    return rouge


def extractive(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``qid, pid, answer, confidence``: the sentence of the found passages (qid, pid, rank, text) that best covers the question.

    A sentence scores |q & s| / (1 + 0.02 |s|), times 1.6 if the question asks for a quantity and it has a digit, over
    1 + 0.35 (rank - 1); the first of equals wins. Without any overlap the lead sentence of the first passage has confidence 0.15.
    """
    asked = questions.select("qid", F.array_distinct(T.tokenize(F.col("question"))).alias("q"), F.col("question").rlike(r"(?iu)how (much|many)|amount|rate|percent|कितन|राशि|kitn").alias("quantity"))
    # A passage is found for many questions: its sentences are tokenized once.
    texts = hits.groupBy("pid").agg(F.first("text").alias("text"))
    sentences = texts.select("pid", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "s")).withColumn("terms", F.array_distinct(T.tokenize(F.col("s"))))
    # The question goes to its passages, so that a question's sentences meet as the best of each task.
    x = hits.select("qid", "pid", "rank").join(asked, "qid").join(sentences, "pid")
    overlap = F.size(F.array_intersect("q", "terms"))
    score = overlap / (1 + 0.02 * F.size("terms")) * F.when(F.col("quantity") & F.col("s").rlike("[0-9०-९]"), 1.6).otherwise(1.0) / (1 + 0.35 * (F.col("rank") - 1))
    best = x.withColumn("score", F.round(score, 9)).groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("less"), "rank", "pos", "pid", "s")).alias("b")).select("qid", "b.pid", "b.s", (-F.col("b.less")).alias("score"))
    return best.select("qid", "pid", F.col("s").alias("answer"), F.round(F.when(F.col("score") > 0, F.least(F.lit(0.95), 0.35 + 0.12 * F.col("score"))).otherwise(0.15), 6).alias("confidence"))


def prompts(questions: DataFrame, hits: DataFrame, *, max_chars: int = 900, instruction: str = "Answer from the passages only.") -> DataFrame:
    """``qid, prompt``: the instruction, the found passages numbered with id, scheme and section, and the question."""
    head = F.format_string("[%d] id=%s (%s, %s)\n", F.col("rank"), F.col("pid"), F.col("scheme"), F.when(F.coalesce("section_path", F.lit("")) == "", "lead").otherwise(F.col("section_path")))
    shown = hits.withColumn("shown", F.concat(head, F.substring(F.coalesce("text", F.lit("")), 1, max_chars)))
    context = shown.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]), "\n\n").alias("context"))
    return context.join(questions, "qid").select("qid", F.concat(F.lit(instruction + "\n\nPassages:\n"), "context", F.lit("\n\nQuestion: "), "question", F.lit("\n")).alias("prompt"))


def gates(hits: DataFrame, lexical: DataFrame, *, tau: float, bm25_floor: float) -> DataFrame:
    """``qid, decision, top_score, margin, confidence``: below_floor, below_tau or answer."""
    top = hits.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"))
    x = top.join(lexical.groupBy("qid").agg(F.max("score").alias("lex")), "qid")
    refused = (F.col("lex") < bm25_floor) | (F.col("top") < tau)
    decision = F.when(F.col("lex") < bm25_floor, "below_floor").when(F.col("top") < tau, "below_tau").otherwise("answer")
    confidence = F.when(refused, 1 - F.least("top", F.lit(1.0))).otherwise(F.least(F.greatest("top", F.lit(0.0)), F.lit(1.0)))
    return x.select("qid", decision.alias("decision"), F.round("top", 6).alias("top_score"), F.round(F.col("top") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"), F.round(confidence, 6).alias("confidence"))
