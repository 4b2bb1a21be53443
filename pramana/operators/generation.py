"""Making questions: checks of candidates, questions without an answer, and candidates from a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.functions import text as T
from pramana.functions.translit import romanize_question
from pramana.operators import replies as R
from pramana.operators.dataset import CLASS_QUOTAS, QUOTAS, SEED, round_robin
from pramana.operators.topk import hash_order
from pramana.session import cut

# Traces of a prompt that a model repeats, and sections whose passages come close to a question they don't answer.
LEAKS = ["नियम", "Rules:", "अनुच्छेद के शब्द", "passage states", "{scheme}"]
NEAR_SECTIONS = ["eligib", "benefit", "feature", "criteria", "implement", "objective", "पात्रता", "लाभ", "उद्देश्य", "विशेषता"]

#: Questions of each class without an answer, languages in turns; {scheme} is the name of a scheme.
STEMS = {
    "out-of-scope": [("Which bus goes to the airport after midnight?", "en"), ("कल बारिश होगी या नहीं?", "hi"), ("Mobile ka recharge kaise karte hain?", "hinglish")],
    "near-miss": [("Which officer's phone number is given for {scheme}?", "en"), ("{scheme} का कार्यालय शनिवार को कितने बजे बंद होता है?", "hi"), ("{scheme} ka form kis rang ka hota hai?", "hinglish")],
    "false-premise": [("Why was {scheme} closed for farmers last month?", "en"), ("{scheme} में विदेशी नागरिकों को दोगुनी राशि क्यों मिलती है?", "hi"), ("{scheme} mein car kyon di jati hai?", "hinglish")],
    "under-specified": [("How much is it?", "en"), ("यह कब तक है?", "hi"), ("Kitna milega?", "hinglish")],
}


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([a-zA-Zऀ-ॿ]+)"), F.lit(1)), F.lower))


def check_translation(source: Column, result: Column, to: Column) -> Column:
    """Why a translation can't be taken: too_short, wrong_script or unchanged; null if it can."""
    ratio = T.letter_devanagari_ratio(T.strip(result))
    wrong = (to == "hi") & (ratio < 0.5) | (to == "en") & (ratio > 0.1)
    return F.when(F.coalesce(F.length(result), F.lit(0)) < 6, "too_short").when(wrong, "wrong_script").when(T.strip(result) == T.strip(source), "unchanged")


def check_romanization(result: Column) -> Column:
    """Why a romanized question can't be taken: too_short, wrong_script or translated (no Hindi function word); null if it can."""
    hindi = F.exists(_tokens(result), lambda w: w.isin(T.UNAMBIGUOUS_MARKERS))
    return F.when(F.coalesce(F.length(result), F.lit(0)) < 6, "too_short").when(T.letter_devanagari_ratio(result) > 0.2, "wrong_script").when(~hindi, "translated")


def check_base(question: Column, answer: Column, passage: Column, lang: Column) -> Column:
    """Why a candidate can't be taken: question_short, wrong_script, prompt_leak, answer_empty or answer_unrelated; null if it can."""
    q = T.strip(F.coalesce(question, F.lit("")))
    ratio = T.letter_devanagari_ratio(q)
    wrong = (lang == "hi") & (ratio < 0.5) | (lang == "en") & (ratio > 0.1)
    leak = F.lit(False)
    for s in LEAKS:
        leak = leak | F.contains(q, F.lit(s))
    a = _tokens(answer)
    unrelated = (F.size(a) > 0) & ~F.arrays_overlap(a, _tokens(passage))
    return F.when(F.length(q) < 10, "question_short").when(wrong, "wrong_script").when(leak, "prompt_leak").when(T.strip(F.coalesce(answer, F.lit(""))) == "", "answer_empty").when(unrelated, "answer_unrelated")


def build_unanswerable(passages: DataFrame, titles: DataFrame, *, quotas: list[tuple[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """``id, question, query_lang, script, unanswerable_class, scheme, distractor`` of questions that no passage answers, to be verified.

    ``passages`` (passage_id, scheme, lang, section_path), ``titles`` (scheme, lang, title). Stems go round until a class has its
    quota; schemes come in a random order, from the start for each class. distractor: a passage of the scheme in the stem's
    language (any, if there is none), of a section that comes near such questions if there is one.
    """
    spark = passages.sparkSession
    rows, most = [], 0
    for name, quota in quotas or CLASS_QUOTAS:
        place = 0
        for i in range(quota):
            stem, lang = STEMS[name][i % len(STEMS[name])]
            named = "{scheme}" in stem
            rows.append((f"un-{name}-{i:03d}", name, stem, lang, place if named else None))
            place += named
        most = max(most, place)
    asked = spark.createDataFrame(rows, "id string, unanswerable_class string, stem string, query_lang string, place int")
    names = titles.where("title is not null and scheme is not null").groupBy("scheme").agg(F.max(F.when(F.col("lang") == "en", F.col("title"))).alias("en"), F.max(F.when(F.col("lang") == "hi", F.col("title"))).alias("hi"))
    # Only as many schemes as questions with a name can use.
    some = cut(names.where("en is not null or hi is not null").orderBy(hash_order(F.col("scheme"), seed), "scheme").limit(most))
    listed = some.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(hash_order(F.col("scheme"), seed), "scheme")) - 1)
    count = max(1, some.count())
    x = asked.join(F.broadcast(listed), F.col("place") % count == F.col("n"), "left").withColumn("name_lang", F.when(F.col("query_lang") == "hi", "hi").otherwise("en"))
    name = F.coalesce(F.when(F.col("name_lang") == "hi", F.col("hi")).otherwise(F.col("en")), "en", "hi")
    question = F.when(F.col("place").isNull(), F.col("stem")).otherwise(F.replace("stem", F.lit("{scheme}"), name))
    near = F.lit(False)
    for s in NEAR_SECTIONS:
        near = near | F.contains(F.lower(F.coalesce("section_path", F.lit(""))), F.lit(s))
    own = passages.join(F.broadcast(some.select("scheme")), "scheme", "left_semi").select("scheme", F.col("lang").alias("p_lang"), near.alias("near"), "passage_id", hash_order(F.col("passage_id"), seed).alias("h"))
    best = own.groupBy("scheme", "p_lang").agg(F.min(F.struct((~F.col("near")).alias("far"), "h", "passage_id")).alias("b"))
    pick = x.where("place is not null").select("id", "scheme", "name_lang").join(best, "scheme").groupBy("id").agg(F.min(F.struct((F.col("p_lang") != F.col("name_lang")).alias("other"), "b")).getField("b").getField("passage_id").alias("distractor"))
    return x.where("place is null or scheme is not null").join(pick, "id", "left").select("id", question.alias("question"), "query_lang", F.when(F.col("query_lang") == "hi", "deva").otherwise("latin").alias("script"), "unanswerable_class", F.coalesce("scheme", F.lit("")).alias("scheme"), "distractor")


Complete = Callable[[DataFrame], DataFrame]


def candidates(passages: DataFrame, complete: Complete, *, quotas: list[tuple[str, str, int]] | None = None, exclude: DataFrame | None = None, least_words: int = 70, seed: int = SEED) -> DataFrame:
    """``id, question, query_lang, passage_lang, answer_gold, passage_id`` of questions that ``complete`` makes of passages (passage_id, scheme, lang, section_path, text).

    ``complete`` turns prompts (key, prompt) into replies (key, reply), such as ReplyCache.complete. For each cell three times its quota of
    passages, none used before, is tried; questions that pass the checks are taken in order until the quota is full. A question in another language than its
    passage is translated; a romanized one is Hindi in Latin letters.
    """
    spark: SparkSession = passages.sparkSession
    used = (exclude.select("passage_id") if exclude is not None else passages.select("passage_id").limit(0))
    done: list[DataFrame] = []
    ask = lambda df, prompt: df.join(complete(df.select(F.col("passage_id").alias("key"), prompt.alias("prompt"))).select(F.col("key").alias("passage_id"), "reply"), "passage_id")
    to = lambda lang: F.concat(F.lit(f"Translate to {'Hindi' if lang == 'hi' else 'English'}. Reply with JSON only: {{\"question\": \"...\"}}\n\nQuestion: "), "question")
    for query_lang, passage_lang, quota in quotas or QUOTAS:
        free = passages.where((F.col("lang") == passage_lang) & (T.count_tokens(F.col("text")) >= least_words)).join(used, "passage_id", "left_anti")
        pool = cut(round_robin(free, "scheme", "passage_id", 3 * quota, seed=seed, first=F.when(F.col("text").rlike("[0-9०-९]"), 0).otherwise(1)))
        base = F.concat(F.lit("Write one question that the passage answers, with its answer. Reply with JSON only: {\"question\": \"...\", \"answer\": \"...\", \"kind\": \"fact\"}\n\nPassage ("), F.replace("scheme", F.lit("-"), F.lit(" ")), F.lit("): "), F.substring("text", 1, 1100))
        x = ask(pool, base).withColumn("r", R.parse_reply(F.col("reply"))).where("r is not null").withColumns({"question": F.col("r.question"), "answer": F.col("r.answer")}).drop("r", "reply")
        x = cut(x.where(check_base(F.col("question"), F.col("answer"), F.col("text"), F.lit(passage_lang)).isNull()))
        wanted = "hi" if query_lang == "hinglish" else query_lang
        if wanted != passage_lang:
            y = ask(x, to(wanted)).withColumn("new", R.parse_translation(F.col("reply"))).drop("reply")
            x = cut(y.where(F.col("new").isNotNull() & check_translation(F.col("question"), F.col("new"), F.lit(wanted)).isNull()).withColumn("question", F.col("new")).drop("new"))
        if query_lang == "hinglish":
            y = x.withColumn("new", romanize_question(F.col("question")))
            x = y.where(F.col("new").isNotNull() & check_romanization(F.col("new")).isNull()).withColumn("question", F.col("new")).drop("new")
        own = cut(round_robin(x.where(F.length("question") >= 8), "scheme", "passage_id", quota, seed=seed, first=F.when(F.col("text").rlike("[0-9०-९]"), 0).otherwise(1)))
        used = used.unionByName(own.select("passage_id"))
        done.append(own.select(F.concat(F.lit(f"qa-{query_lang}-{passage_lang}-"), F.replace("passage_id", F.lit("#"), F.lit("-"))).alias("id"), "question", F.lit(query_lang).alias("query_lang"), F.lit(passage_lang).alias("passage_lang"), F.col("answer").alias("answer_gold"), "passage_id"))
    if not done:
        return spark.createDataFrame([], "id string, question string, query_lang string, passage_lang string, answer_gold string, passage_id string")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
