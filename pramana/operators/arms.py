"""Question answering with different evidence (arms), its scores, and where errors come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.operators import answers as Q
from pramana.operators import replies as R
from pramana.operators.serving import resolve_citation

# From which support on an answer counts as supported or entailed.
SUPPORTED, ENTAILED = 0.6, 0.5


@dataclass(frozen=True)
class Arm:
    """evidence: none, found (by a ranked list) or gold."""

    key: str
    label: str
    evidence: str


ARMS = {a.key: a for a in (Arm("A", "closed-book", "none"), Arm("B", "RAG dense", "found"), Arm("C", "RAG hybrid", "found"), Arm("D", "oracle", "gold"))}


def contexts(arm: Arm, items: DataFrame, passages: DataFrame, found: DataFrame | None = None, *, k: int = 5) -> DataFrame:
    """``id, context``: the passages (array of pid) each item (id, gold) gets; ``passages`` (pid), ``found`` (id, pid, rank).

    An item whose gold passages aren't there is left out of a gold arm: without evidence it would be a closed-book item.
    """
    if arm.evidence == "none":
        return items.select("id", F.array().cast("array<string>").alias("context"))
    if arm.evidence == "gold":
        hits = items.select("id", F.posexplode("gold").alias("rank", "pid"))
    elif found is None:
        raise ValueError(f"arm {arm.key} needs a ranked list")
    else:
        hits = found.where(F.col("rank") <= k).select("id", "rank", "pid")
    listed = hits.join(passages.select("pid"), "pid", "left_semi").groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pid"))), lambda x: x["pid"]), 1, k).alias("context"))
    if arm.evidence == "gold":
        return items.select("id").join(listed, "id")
    return items.select("id").join(listed, "id", "left").select("id", F.coalesce("context", F.array().cast("array<string>")).alias("context"))


def generations(arm: Arm, contexts_: DataFrame, replies: DataFrame) -> DataFrame:
    """``id, arm, context, answerable, answer, citation, confidence`` for ``contexts_`` (id, context) and ``replies`` (id, reply).

    A reply that can't be parsed, or none, is an abstention without an answer; it isn't left out.
    """
    a = F.col("a")
    says = F.coalesce(a["answerable"] & (a["answer"] != ""), F.lit(False))
    x = contexts_.join(replies, "id", "left").withColumn("a", R.parse_answer(F.col("reply")))
    return x.select("id", F.lit(arm.key).alias("arm"), "context", says.alias("answerable"), F.when(says, a["answer"]).when(a.isNull(), "").otherwise(R.REFUSAL).alias("answer"), F.coalesce(a["citation"], F.lit("")).alias("citation"), F.coalesce(a["confidence"], F.lit(0.0)).alias("confidence"))


def extractive_complete(prompts: DataFrame, passages: DataFrame) -> DataFrame:
    """``key, reply`` for ``prompts`` (key, prompt): the best sentence of the prompt's own passages (pid, text), as a model would reply; without passages an abstention."""
    asked = prompts.select("key", R.parse_prompt(F.col("prompt")).alias("p")).select("key", "p.question", "p.ids")
    hits = asked.select(F.col("key").alias("qid"), F.posexplode("ids").alias("pos", "pid")).join(passages.select("pid", "text"), "pid").select("qid", "pid", (F.col("pos") + 1).alias("rank"), "text")
    said = Q.extractive(asked.select(F.col("key").alias("qid"), "question"), hits)
    reply = F.to_json(F.struct((F.trim("answer") != "").alias("answerable"), "answer", F.col("pid").alias("citation"), F.round("confidence", 3).alias("confidence")))
    none = F.to_json(F.struct(F.lit(False).alias("answerable"), F.lit(R.REFUSAL).alias("answer"), F.lit("").alias("citation"), F.lit(0.0).alias("confidence")))
    return asked.select("key").join(said.select(F.col("qid").alias("key"), reply.alias("reply")), "key", "left").select("key", F.coalesce("reply", none).alias("reply"))


def best_over_golds(score, golds: Column) -> Column:
    """The best ``score`` (a function of one gold) over the golds that aren't empty; 0 if there are none."""
    real = F.filter(golds, lambda g: g.isNotNull() & (g != ""))
    return F.coalesce(F.array_max(F.transform(real, lambda g: score(g).cast("double"))), F.lit(0.0))


def score(gens: DataFrame, items: DataFrame, passages: DataFrame, entailments: DataFrame | None = None) -> DataFrame:
    """Per generation: ``id, arm, abstained, em, f1, cited, cited_found, support, entailment``.

    ``items`` (id, answer_gold, answer_gold_hi, gold), ``passages`` (pid, text), ``entailments`` (id, arm, entailment). The evidence is the
    cited passage if it is there, else the context, else the gold passages. em and f1 are the best over both golds; an
    abstention predicts the empty answer, has support 0 and no entailment.
    """
    words = items.select("id", "gold", *[T.answer_tokens(F.col(c)).alias(f"{c}_w") for c in ("answer_gold", "answer_gold_hi")], *[T.amount_key(F.col(c)).alias(f"{c}_k") for c in ("answer_gold", "answer_gold_hi")], F.coalesce(F.col("answer_gold") != "", F.lit(False)).alias("answer_gold_is"), F.coalesce(F.col("answer_gold_hi") != "", F.lit(False)).alias("answer_gold_hi_is"))
    x = gens.join(words, "id").withColumn("said", F.when(F.col("answerable"), F.col("answer")).otherwise(""))
    x = x.withColumns({"p": T.answer_tokens(F.col("said")), "pk": T.amount_key(F.col("said")), "cite": resolve_citation(F.col("citation"), F.col("context"))})
    both = F.array(*[F.struct(F.col(f"{c}_is").alias("there"), F.col(f"{c}_w").alias("w"), F.col(f"{c}_k").alias("k")) for c in ("answer_gold", "answer_gold_hi")])
    real = F.filter(both, lambda g: g["there"])
    em = F.coalesce(F.array_max(F.transform(real, lambda g: ((F.array_join(F.col("p"), " ") == F.array_join(g["w"], " ")) | F.coalesce(F.col("pk") == g["k"], F.lit(False))).cast("double"))), F.lit(0.0))
    f1 = F.coalesce(F.array_max(F.transform(real, lambda g: Q.token_f1(F.col("p"), g["w"]))), F.lit(0.0))
    x = x.withColumns({"em": em, "f1": F.round(f1, 6)})
    there = passages.select(F.col("pid").alias("cite"), F.lit(True).alias("cited_found"))
    x = x.join(there, "cite", "left").withColumn("cited_found", F.coalesce("cited_found", F.lit(False)))
    evidence = F.when(F.col("cited_found"), F.array("cite")).when(F.size("context") > 0, F.col("context")).otherwise(F.col("gold"))
    answered = x.where("answerable")
    texts = answered.select("id", "arm", F.posexplode(evidence).alias("pos", "pid")).join(passages.select("pid", "text"), "pid").groupBy("id", "arm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda e: e["text"]), " ").alias("evidence"))
    support = answered.select("id", "arm", "answer").join(texts, ["id", "arm"], "left").select("id", "arm", F.round(Q.rouge_l_precision(F.col("answer"), F.coalesce("evidence", F.lit(""))), 6).alias("support"))
    x = x.join(support, ["id", "arm"], "left")
    x = x.join(entailments, ["id", "arm"], "left") if entailments is not None else x.withColumn("entailment", F.lit(None).cast("double"))
    return x.select("id", "arm", (~F.col("answerable")).alias("abstained"), "em", "f1", (F.col("cite") != "").alias("cited"), "cited_found", F.coalesce("support", F.lit(0.0)).alias("support"), F.when(F.col("answerable"), F.col("entailment")).alias("entailment"))


def report(outcomes: DataFrame, *by: str) -> DataFrame:
    """By arm (and further columns): n, em, f1, abstention, and over answered items support rates; rates of nothing are null where that tells something else than 0."""
    said = ~F.col("abstained")
    rate = lambda c, of: F.round(F.avg(F.when(of, c.cast("double"))), 6)
    supported = F.col("support") >= SUPPORTED
    entailed = F.col("entailment") >= ENTAILED
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return outcomes.groupBy("arm", *by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg(F.col("abstained").cast("double")), 6).alias("abstention"),
        zero(rate(supported, said)).alias("supported"), F.round(1 - zero(F.avg(F.when(said, supported.cast("double")))), 6).alias("unsupported"), rate(entailed, said & F.col("entailment").isNotNull()).alias("entailed"), zero(rate(F.col("cited"), said)).alias("citation"),
        rate(~F.col("cited_found"), said & F.col("cited")).alias("fabricated"), zero(rate(F.col("support"), said)).alias("mean_support"), F.count_if(said & F.col("entailment").isNotNull() & (supported != entailed)).alias("disagreements"),
    )


def decomposition(outcomes: DataFrame, *, system: str = "C", ceiling: str = "D") -> DataFrame:
    """One row ``n, dropped, system_f1, ceiling_f1, retrieval_error, generation_error``, paired over the items both arms have."""
    f1 = outcomes.where(F.col("arm").isin(system, ceiling)).groupBy("id").agg(F.max(F.when(F.col("arm") == system, F.col("f1"))).alias("c"), F.max(F.when(F.col("arm") == ceiling, F.col("f1"))).alias("d"))
    shared = F.col("c").isNotNull() & F.col("d").isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(shared, F.col(c))), F.lit(0.0))
    return f1.agg(F.count_if(shared).alias("n"), F.count_if(F.col("c").isNotNull() & F.col("d").isNull()).alias("dropped"), F.round(mean("c"), 6).alias("system_f1"), F.round(mean("d"), 6).alias("ceiling_f1"), F.round(mean("d") - mean("c"), 6).alias("retrieval_error"), F.round(1 - mean("d"), 6).alias("generation_error"))
