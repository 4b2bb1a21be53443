"""Building and checking question sets: samples, splits, coverage, probes, reviews and merges.

Samples are drawn by hash order (operators.topk.hash_order) instead of a generator: the same rows on any engine and in any
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.functions import text as T
from pramana.operators.corpus import jaccard
from pramana.operators.running import running_start
from pramana.operators.topk import hash_order

SEED = 20260922
# Questions wanted by language of question and evidence, unanswerable ones by class, and endings that show a cut.
QUOTAS = [("en", "en", 70), ("hi", "hi", 60), ("en", "hi", 45), ("hi", "en", 45), ("hinglish", "en", 55), ("hinglish", "hi", 45)]
CLASS_QUOTAS = [("out-of-scope", 25), ("near-miss", 30), ("false-premise", 15), ("under-specified", 10)]
DATE = r"\b(19|20)\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|january|february|march|april|may|june|july|august|september|october|november|december|तिथि|वर्ष|माह|दिनांक"
ENTITY = r"(^|[^\p{L}\p{N}_])([A-Z]{2,}|Yojana|Abhiyan|Mission|Scheme|अभियान|मिशन)([^\p{L}\p{N}_]|$)|(^|[^\p{L}\p{N}_])योजना[\p{L}\p{N}_]"
ALIKE_SECTIONS = ["eligibility", "benefits", "features", "पात्रता", "लाभ"]


def _numbered(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """``df`` with ``rn``: each row's place, from 1, in the random order of its group; a group is numbered in 1024 parts, so that no task sorts all of it."""
    x = df.withColumns({"__g": F.to_json(F.struct(*group), {"ignoreNullFields": "false"}), "__h": hash_order(F.col(key), seed), "__one": F.lit(1)}).withColumn("__part", F.shiftright("__h", 50))
    return running_start(x, "__g", ["__h", key], "__one", "__part", "__place").withColumn("rn", F.col("__place") + 1).drop("__g", "__h", "__one", "__part", "__place")


def round_robin(df: DataFrame, group: str, key: str, n: int, *, seed: int = SEED, first: Column | None = None) -> DataFrame:
    """``n`` rows taken from the groups in turns, each group's by ``first``, then at random; each task keeps n rows of a group."""
    order = [*([] if first is None else [first]), hash_order(F.col(key), seed), key]
    x = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)
    return x.orderBy("rn", hash_order(F.col(group), seed), group).limit(n).drop("rn")


def stratified_split(df: DataFrame, strata: list[str], key: str, size: int, *, seed: int = SEED) -> DataFrame:
    """``df`` with ``part``: dev for just ``size`` rows, shared out to the strata by largest remainders, else test."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    share = F.col("n") * float(size) / F.col("total")
    counts = counts.withColumns({"base": F.floor(F.round(share, 9)), "rest": F.round(share - F.floor(F.round(share, 9)), 9)})
    # One row a stratum: few.
    spare = F.lit(size) - F.sum("base").over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.col("rest").desc(), *strata)
    quota = counts.withColumn("quota", F.col("base") + (F.row_number().over(order) <= spare).cast("int")).select(*strata, "quota")
    x = _numbered(df, strata, key, seed)
    same = [F.col(f"x.{s}").eqNullSafe(F.col(f"q.{s}")) for s in strata]
    joined = x.alias("x").join(F.broadcast(quota.alias("q")), same)
    return joined.select("x.*", F.when(F.col("rn") <= F.col("quota"), "dev").otherwise("test").alias("part")).drop("rn")


def sample_by_class(df: DataFrame, group: str, key: str, fraction: float, *, seed: int = SEED) -> DataFrame:
    """At least one row of each class and about ``fraction`` of it, rounded half to even."""
    sizes = df.groupBy(F.col(group).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    x = _numbered(df, [group], key, seed).join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("__c")))
    return x.where(F.col("rn") <= F.greatest(F.lit(1), F.bround(F.round(F.col("__n") * fraction, 9), 0))).drop("rn", "__n", "__c")


def shared_out(df: DataFrame, group: str, key: str, n: int, *, seed: int = SEED) -> DataFrame:
    """About ``n`` rows shared out to the classes by their sizes: of each at least one, rounded half to even, and all if it has fewer."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__c"))
    total = sizes.agg(F.sum("__c")).first()[0] or 1
    x = _numbered(df, [group], key, seed).join(F.broadcast(sizes).withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")))
    return x.where(F.col("rn") <= F.greatest(F.lit(1), F.bround(F.round(F.col("__c") * F.lit(float(n) / total), 9), 0))).drop("rn", "__c", "__g")


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the terms of two columns of tokens."""
    return jaccard(F.array_distinct(a), F.array_distinct(b))


def normalized_question(c: Column) -> Column:
    return F.array_join(T.answer_tokens(c), " ")


def duplicate_questions(items: DataFrame) -> DataFrame:
    """``norm_hash, n, first_id`` of questions (id, question) that more than one item asks, in the form for comparison."""
    x = items.select("id", F.md5(normalized_question(F.col("question"))).alias("norm_hash"))
    return x.groupBy("norm_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def error_categories(items: DataFrame, gold: DataFrame, sizes: DataFrame) -> DataFrame:
    """``id, category`` of every category of an item (id, question, query_lang, passage_lang, scheme); ``gold`` (id, schemes, sections), ``sizes`` (scheme, n)."""
    x = items.withColumn("c", T.classify_language(F.col("question"))).join(gold, "id", "left").join(sizes, "scheme", "left").withColumn("amounts", T.canonical_amounts(F.coalesce("question", F.lit(""))))
    words = T.count_tokens(F.col("question"))
    dated = F.col("question").rlike("(?iu)" + DATE)
    near = (F.size("schemes") == 1) & F.arrays_overlap("sections", F.array(*map(F.lit, ALIKE_SECTIONS)))
    tests = {
        "code-mixing": F.col("c.query_type") == "Code-Mixed",
        "transliteration-variation": (F.col("c.query_type") == "Code-Mixed") & (F.col("c.script") == "latin"),
        "cross-lingual-gap": (F.coalesce("passage_lang", F.lit("")) != "") & ~F.col("query_lang").eqNullSafe(F.col("passage_lang")),
        "named-entity": F.col("question").rlike(ENTITY),
        "amount": F.size("amounts") > 0,
        "date": dated,
        "short-query": words <= 5,
        "ambiguity": words <= 5,
        "long-tail-scheme": (F.coalesce("scheme", F.lit("")) != "") & (F.coalesce("n", F.lit(0)) <= 6),
        "near-duplicate-schemes": near,
    }
    tags = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return x.withColumn("tags", tags).select("id", F.explode(F.when(F.size("tags") == 0, F.array(F.lit("ambiguity"))).otherwise(F.col("tags"))).alias("category"))


def merge_dedupe_renumber(sources: DataFrame, keys: Column, cell: list[str], *, prefix: int = 8) -> DataFrame:
    """``sources`` (id, source_rank, ...) without items whose ``keys`` an earlier source, or an earlier id, has; with ``new_id``, numbered within the cell.

    Of each key the first is kept by partial minima. A cell is numbered in parts by source and the first ``prefix`` characters of the id.
    """
    x = sources.withColumn("merge_key", keys)
    first = x.groupBy(F.col("merge_key").alias("__k")).agg(F.min(F.struct("source_rank", "id")).alias("__first"))
    kept = x.join(first, F.col("merge_key").eqNullSafe(F.col("__k"))).where("source_rank = __first.source_rank and id = __first.id")
    named = F.concat_ws("-", *[F.coalesce(F.col(c), F.lit("none")) for c in cell])
    kept = kept.withColumns({"__cell": named, "__one": F.lit(1), "__part": F.concat(F.format_string("%09d|", "source_rank"), F.substring("id", 1, prefix))})
    numbered = running_start(kept, "__cell", ["source_rank", "id"], "__one", "__part", "__place")
    return numbered.withColumn("new_id", F.concat_ws("-", "__cell", F.format_string("%03d", "__place"))).drop("merge_key", "__k", "__first", "__cell", "__one", "__part", "__place")


def coverage(items: DataFrame) -> DataFrame:
    """``cell, target, have``: items wanted and had, answerable ones by languages of question and evidence, the others by class."""
    spark = items.sparkSession
    want = spark.createDataFrame([(f"{q}->{p}", n) for q, p, n in QUOTAS] + [(c, n) for c, n in CLASS_QUOTAS], "cell string, target long")
    cell = F.when(F.col("answerable"), F.concat_ws("->", F.coalesce("query_lang", F.lit("")), F.coalesce("passage_lang", F.lit("")))).otherwise(F.coalesce("unanswerable_class", F.lit("unclassified")))
    have = items.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("have"))
    return want.join(have, "cell", "left").select("cell", "target", F.coalesce("have", F.lit(0)).alias("have"))
