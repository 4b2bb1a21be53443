"""The queries pN_... over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm import sql
from pramana.llm.alignment import align
from pramana.llm.consensus import MinimaxConsensus, annotator_key, krippendorff_alpha, latest_votes
from pramana.llm.encoding import decode, encode
from pramana.llm.language import LanguageFilters, detect_segments, fit_filters, language_name
from pramana.llm.mixing import SourceMixer
from pramana.llm.overlap import SplitOverlap
from pramana.llm.pairs import PairChecker
from pramana.llm.quality import document_statistics, sketches, verdicts
from pramana.llm.rank_fusion import normal_score_ranking
from pramana.llm.sentences import sentence_units, train
from pramana.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def unique_items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """qa_items, a repeated item once, with the given columns."""
    t = table(spark, d, "qa_items").where("id is not null")
    return t.groupBy("id").agg(F.max_by(F.struct(*columns), F.coalesce("loaded_at", F.lit("1900-01-01").cast("timestamp"))).alias("v")).select("id", "v.*")


# 1. Consensus from several annotators' labels


def p1_votes(spark: SparkSession, d: str) -> DataFrame:
    second = table(spark, d, "second_pass").select("id", annotator_key(F.col("labelled_by")).alias("annotator"), F.col("answerable").cast("int").alias("label"), F.col("labelled_at").alias("at"), F.col("label_id").alias("seq"))
    first = table(spark, d, "qa_items").select("id", annotator_key(F.col("annotator")).alias("annotator"), F.col("answerable").cast("int").alias("label"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("seq"))
    asked = table(spark, d, "second_pass").where("answerable is not null").select("id").distinct()
    return latest_votes(second.unionByName(first.join(asked, "id", "left_semi")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = MinimaxConsensus().fit(p1_votes(spark, d))
    first = table(spark, d, "qa_items").where("id is not null and answerable is not null").groupBy("id").agg(F.max_by("answerable", "loaded_at").alias("answerable"))
    return items.join(first, "id").where(F.col("label") != F.col("answerable").cast("int")).select("id")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    items, _ = MinimaxConsensus().fit(p1_votes(spark, d))
    return items.select("id", (F.col("label") == 1).alias("answerable"), F.round("confidence", 6).alias("confidence"), "n_votes", F.round("agreement", 6).alias("agreement"))


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    return MinimaxConsensus().fit(p1_votes(spark, d))[1]


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return krippendorff_alpha(p1_votes(spark, d))


# 2. Missing or wrong document language labels


def language_filters(spark: SparkSession, d: str) -> LanguageFilters:
    """Filters from the clean languages of passages, those of documents, and the partly wrong ones of questions."""
    clean = table(spark, d, "passages").select("text", "lang")
    mostly = table(spark, d, "documents").select("text", language_name(F.col("lang")).alias("lang"))
    asked = table(spark, d, "qa_items").select(F.col("question").alias("text"), language_name(F.col("query_lang")).alias("lang"))
    return fit_filters(clean.unionByName(mostly).unionByName(asked))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    items = unique_items(spark, d, "question", "query_lang").withColumnRenamed("question", "text")
    return detect_segments(items, language_filters(spark, d), keep=("query_lang",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    named = language_name(F.col("query_lang"))
    wrong = (F.col("seg_no") > 0) | named.isNull() | (named != F.col("lang"))
    return p2_segments(spark, d).where(F.col("lang").isin("en", "hi", "hinglish", "mr", "bn") & wrong).select("id", "seg_no", "lang")


# 3. Broken prompt and response pairs


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The answers to check: all answer_gold and the recorded answer_gold_hi of answerable items."""
    items = unique_items(spark, d, "question", "answer_gold", "answer_gold_hi", "passage_lang", "answerable").where("answerable")
    gold = items.select("id", F.lit("answer_gold").alias("answer_field"), "question", F.col("answer_gold").alias("answer"), language_name(F.col("passage_lang")).alias("lang"))
    hindi = items.where("answer_gold_hi <> ''").select("id", F.lit("answer_gold_hi").alias("answer_field"), "question", F.col("answer_gold_hi").alias("answer"), F.lit("hi").alias("lang"))
    return gold.unionByName(hindi)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return PairChecker(language_filters(spark, d)).check(p3_pairs(spark, d))


# 4. Same or near-same records across splits


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return unique_items(spark, d, "question", "split", "source").select("id", F.col("question").alias("text"), "split", "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = SplitOverlap().pairs(_questions(spark, d))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return SplitOverlap().report(_questions(spark, d))


# 5. Sentence boundaries across languages and scripts


def unique_passages(spark: SparkSession, d: str) -> DataFrame:
    """passages, a repeated one once."""
    t = table(spark, d, "passages").where("passage_id is not null")
    return t.groupBy("passage_id").agg(F.max(F.struct("doc_id", "lang", "text")).alias("v")).select("passage_id", "v.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    passages = cut(unique_passages(spark, d))
    return sentence_units(passages, train(passages))


# 6. One ranking from several differently-scaled scores


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return normal_score_ranking(table(spark, d, "runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_ranking(spark, d).where("position = 1").select("query_id", "passage_id")


# 7. Sentence alignment in bilingual documents


def p7_units(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of English (side 0) and Hindi (side 1) documents, by stem."""
    docs = table(spark, d, "source_docs").where("doc_id is not null").groupBy("doc_id").agg(F.max(language_name(F.col("lang"))).alias("named"))
    unique = cut(unique_passages(spark, d))
    passages = unique.join(docs, "doc_id", "left").withColumn("language", F.coalesce("named", "lang")).where("language in ('en', 'hi')")
    units = sentence_units(passages.select("passage_id", "text"), train(unique), with_text=True)
    stems = passages.select("passage_id", F.regexp_replace("doc_id", "-[A-Za-z]+$", "").alias("stem"), F.when(F.col("language") == "en", 0).otherwise(1).alias("side"))
    return units.join(stems, "passage_id")


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    return align(p7_units(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return align(p7_units(spark, d), omissions=False).select(F.col("passage_id").alias("en_passage_id"), F.col("start_pos").alias("en_start_pos"), F.col("other_passage_id").alias("hi_passage_id"), F.col("other_start_pos").alias("hi_start_pos"))


# 8. Encoding of the whole corpus with a public tokenizer


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), offsets=True)


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode(p8_ids(spark, d))


# 9. Mixing sources to target weights


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return SourceMixer().mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return SourceMixer().mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    return SourceMixer().schedule(table(spark, d, "documents"), table(spark, d, "mix_targets"))


# 10. Per-document text quality statistics


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return document_statistics(table(spark, d, "documents"), lang=language_name(F.col("lang")))


def p10_verdicts(spark: SparkSession, d: str) -> DataFrame:
    stats = cut(p10_statistics(spark, d))
    return verdicts(stats, sketches(stats))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_verdicts(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and name not in ("p1_votes", "p3_pairs", "p7_units")}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
