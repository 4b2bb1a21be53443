"""Tables as the queries see them, each repeated row once, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.session import table

#: Searches take the questions whose number is divisible by this as queries, against all passages.
QUERY_STEP = 100

PASSAGE_COLUMNS = ["doc_id", "scheme", "lang", "text", "section_path", "page", "token_count"]
PASSAGES = "(SELECT passage_id, " + ", ".join(f"max({c}) AS {c}" for c in PASSAGE_COLUMNS) + " FROM passages GROUP BY passage_id)"
ITEMS = (
    "(SELECT DISTINCT id, question, query_lang, answerable, gold_passage_ids, script, passage_lang, unanswerable_class, answer_gold, answer_gold_hi, scheme, difficulty_tags, split, annotator, second_pass, verified, notes, source FROM qa_items)"
)
QUESTIONS = f"(SELECT * FROM {ITEMS} WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % {QUERY_STEP} = 0)"
RUNS = "(SELECT DISTINCT query_id, passage_id, method_name, coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, component_scores[method_name]) AS score FROM runs)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id, method_name ORDER BY round(score, 9) DESC NULLS LAST, passage_id) AS rank FROM {RUNS})"


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").groupBy("passage_id").agg(*[F.max(c).alias(c) for c in PASSAGE_COLUMNS])


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_items").drop("loaded_at").dropDuplicates(["id"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % QUERY_STEP == 0)


def runs(spark: SparkSession, d: str) -> DataFrame:
    own = F.coalesce(F.nanvl("score", F.lit(None).cast("double")), F.col("component_scores")[F.col("method_name")])
    return table(spark, d, "runs").select("query_id", "passage_id", "method_name", own.alias("score")).dropDuplicates(["query_id", "passage_id", "method_name"])


def ranked_runs(spark: SparkSession, d: str) -> DataFrame:
    from pramana.operators.topk import ranks

    return ranks(runs(spark, d), ["query_id", "method_name"], "score", "passage_id")


def split_name(c: Column) -> Column:
    """train, dev or test in one spelling."""
    return F.lower(F.trim(c))
