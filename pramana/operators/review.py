"""Mechanical review of question sets, notes of reviewers, and cases of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.functions import text as T
from pramana.operators.corpus import jaccard
from pramana.session import cut

# Words that point at a passage, words no answer ends with, bounds, and verdicts of reviewers.
DEICTIC = r"\b(according to (the|this) (passage|text|article|document)|(the|this) passage|(the|this) text|mentioned (above|here|in the)|the above|given (passage|text)|passage (ke|me|mein|men) |is passage)\b|गद्यांश|अनुच्छेद के अनुसार|इस पाठ|उपरोक्त"
DANGLING = ["the", "a", "an", "and", "or", "of", "to", "with", "for", "in", "by", "के", "की", "का", "और"]
VERBOSE, SUPPORTED, HIGH_OVERLAP = 25, 0.6, 0.6
VERDICTS = ["accept", "fix", "relabel-unanswerable", "relabel-answerable", "reject", "unsure"]
EXPECTED = {"en": "en", "hi": "hi", "hinglish": "hi-en"}
CATEGORIES = ["code-mixing", "transliteration-variation", "named-entity", "amount", "date", "ambiguity", "near-duplicate-schemes", "cross-lingual-gap", "long-tail-scheme", "short-query"]


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_ऀ-ॿ]+)"), F.lit(1))


def truncated(answer: Column) -> Column:
    """Why an answer looks cut off (parentheses, quotation, dangling), else null."""
    count = lambda ch: F.length(answer) - F.length(F.replace(answer, F.lit(ch), F.lit("")))
    last = F.lower(F.regexp_extract(F.regexp_replace(answer, r"[ .,;:।]+$", ""), r"(\S+)$", 1))
    return F.when(count("(") != count(")"), "parentheses").when(count('"') % 2 == 1, "quotation").when(last.isin(DANGLING), "dangling")


def review(items: DataFrame, passages: DataFrame) -> DataFrame:
    """``id, finding`` of ``items`` (id, question, query_lang, answerable, gold_passage_ids, answer_gold, answer_gold_hi) with ``passages`` (passage_id, lang, text).

    placeholder, not-standalone, language-mismatch, inconsistent, missing-hindi, answer-unsupported, answer-truncated,
    answer-verbose, high-overlap, duplicate. The last seven but inconsistent and duplicate are of answerable items with evidence only.
    """
    gold = F.coalesce("gold_passage_ids", F.array().cast("array<string>"))
    x = items.withColumns({"gold": gold, "a": F.coalesce("answer_gold", F.lit("")), "b": F.coalesce("answer_gold_hi", F.lit("")), "qw": words(F.col("question"))})
    x = cut(x.withColumn("key", F.md5(F.array_join("qw", " "))))
    cited = x.select("id", F.posexplode("gold").alias("pos", "passage_id")).join(passages.select("passage_id", "lang", F.coalesce("text", F.lit("")).alias("text")), "passage_id")
    evidence = cited.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]), " ").alias("text"), F.max(F.col("lang") == "hi").alias("hindi"), F.count(F.lit(1)).alias("there"))
    # Copies of a question are counted before they are joined.
    again = x.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    y = x.join(evidence, "id", "left").join(again.withColumn("again", F.lit(True)), "key", "left")
    y = y.withColumns({"text": F.coalesce("text", F.lit("")), "hindi": F.coalesce("hindi", F.lit(False)), "there": F.coalesce("there", F.lit(0)), "lang": T.classify_language(F.col("question"))["lang"]})
    y = y.withColumns({"ew": F.array_distinct(words(F.col("text"))), "qt": T.tokenize(F.col("question")), "et": T.tokenize(F.col("text"))})
    want = F.create_map(*[F.lit(v) for kv in EXPECTED.items() for v in kv])[F.col("query_lang")]
    judged = F.col("answerable") & (F.size("gold") > 0)
    cover = lambda c: F.when(F.size(words(c)) > 0, F.size(F.filter(words(c), lambda w: F.array_contains(F.col("ew"), w))) / F.greatest(F.size(words(c)), F.lit(1))).otherwise(0.0)
    given = lambda c: F.trim(c) != ""
    best = F.greatest(F.when(given(F.col("a")), cover(F.col("a"))).otherwise(0.0), F.when(given(F.col("b")), cover(F.col("b"))).otherwise(0.0))
    both = F.concat("a", F.lit(" "), "b")
    same_script = ((F.coalesce("query_lang", F.lit("")) == "hi") == F.col("hindi")) & (F.coalesce("query_lang", F.lit("")) != "hinglish")
    tests = {
        "placeholder": F.size("qw") <= 2,
        "not-standalone": F.coalesce("question", F.lit("")).rlike("(?iu)" + DEICTIC),
        "language-mismatch": want.isNotNull() & (want != F.col("lang")),
        "inconsistent": F.when(F.col("answerable"), (F.size("gold") == 0) | (F.col("there") < F.size("gold"))).otherwise((F.size("gold") > 0) | (F.col("a") != "")),
        "missing-hindi": judged & F.col("hindi") & both.rlike("[A-Za-z]{2,}") & ~both.rlike("[ऀ-ॿ]"),
        "answer-unsupported": judged & (best < SUPPORTED),
        "answer-truncated": judged & F.coalesce(F.when(given(F.col("a")), truncated(F.col("a"))), F.when(given(F.col("b")), truncated(F.col("b")))).isNotNull(),
        "answer-verbose": judged & (F.size(words(F.col("a"))) > VERBOSE),
        "high-overlap": judged & same_script & (jaccard(F.array_distinct("qt"), F.array_distinct("et")) >= HIGH_OVERLAP),
        "duplicate": F.coalesce("again", F.lit(False)),
    }
    return y.select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))).alias("finding"))


def merge_notes(items: DataFrame, findings: DataFrame, notes: DataFrame, *, reviewed_by: str) -> DataFrame:
    """``id, rules, verdict, issues, reviewed_by``: each item's findings and the note on it, if any; a verdict that isn't one of VERDICTS is an error when read."""
    rules = findings.groupBy("id").agg(F.array_sort(F.collect_set("finding")).alias("rules"))
    known = F.when(F.col("verdict").isin(VERDICTS), F.col("verdict")).when(F.col("noted"), F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("null")), F.lit(" of "), "id")))
    x = items.select("id").join(rules, "id", "left").join(notes.select("id", "verdict", "issues", F.lit(True).alias("noted")), "id", "left")
    return x.select("id", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), known.cast("string").alias("verdict"), "issues", F.when(F.col("noted"), reviewed_by).alias("reviewed_by"))


def take_suggestions(items: DataFrame, notes: DataFrame) -> DataFrame:
    """``items`` with the question and answers that ``notes`` (id, suggested_question, suggested_answer, suggested_answer_hi) suggest, and which fields ``changed``."""
    of = {"question": "suggested_question", "answer_gold": "suggested_answer", "answer_gold_hi": "suggested_answer_hi"}
    x = items.join(notes.select("id", *[F.nullif(F.trim(s), F.lit("")).alias(f"__{f}") for f, s in of.items()]), "id", "left")
    differs = {f: F.col(f"__{f}").isNotNull() & ~F.col(f"__{f}").eqNullSafe(F.col(f)) for f in of}
    changed = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in differs.items()]))
    return x.withColumn("changed", changed).withColumns({f: F.coalesce(f"__{f}", f) for f in of}).drop(*[f"__{f}" for f in of])


def is_rejected(notes: Column) -> Column:
    return F.coalesce(notes, F.lit("")).startswith("REJECTED")


def progress(items: DataFrame) -> DataFrame:
    """One row ``total, verified, rejected, remaining`` of items (verified, notes)."""
    s = items.agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified"), F.count_if(is_rejected(F.col("notes"))).alias("rejected"))
    return s.withColumn("remaining", F.col("total") - F.col("verified") - F.col("rejected"))


def unknown_fields(records: DataFrame) -> DataFrame:
    """``field, items, first``: names that a scan put aside in ``unknown_fields``, how many records have them and the smallest id of these."""
    return records.select("id", F.explode(F.map_keys("unknown_fields")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first"))


def error_cases(failures: DataFrame, tags: DataFrame, *, per_category: int = 2) -> DataFrame:
    """``category, id, place``: of each category the failures with the highest confidence that no earlier category took.

    ``failures`` (id, confidence), ``tags`` (id, category). Per category only as many as could be taken in spite of all earlier
    categories are looked at, so that a bounded number of rows is chosen from in turn.
    """
    most = per_category * len(CATEGORIES)
    w = Window.partitionBy("category").orderBy(F.col("confidence").desc(), "id")
    best = tags.where(F.col("category").isin(CATEGORIES)).join(failures, "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("category", "id", "r").collect()
    taken: set[str] = set()
    out: list[tuple[str, str, int]] = []
    for category in CATEGORIES:
        free = [r["id"] for r in sorted((r for r in best if r["category"] == category), key=lambda r: r["r"]) if r["id"] not in taken][:per_category]
        taken.update(free)
        out += [(category, i, n + 1) for n, i in enumerate(free)]
    return tags.sparkSession.createDataFrame(out, "category string, id string, place int")


def diagnosis(gold_rank: Column, hit: tuple[Column, Column], gold: tuple[Column, Column]) -> Column:
    """What went wrong: where the gold passage stands, and how the best hit (scheme, language) differs from it."""
    where = F.when(gold_rank.isNull(), "gold not returned").otherwise(F.concat(F.lit("gold at rank "), gold_rank.cast("string")))
    how = F.when(hit[0].isNull() | gold[0].isNull(), "").when(hit[0] != gold[0], "; best hit of another scheme").when(hit[1] != gold[1], "; best hit in another language").otherwise("; best hit of the same scheme, another section")
    return F.concat(where, how)
