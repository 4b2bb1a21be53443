"""Signals of whether a question is answerable from what was found, thresholds fitted to them, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.operators.running import counted

FEATURES = ("max_score", "margin", "mean_top_k", "n_candidates", "spread", "scheme_agreement")


def features(hits: DataFrame, schemes: DataFrame, *, k: int = 5) -> DataFrame:
    """``qid`` and FEATURES of ``hits`` (qid, pid, score, rank): of the k best, but n_candidates counts all; ``schemes`` (pid, scheme).

    scheme_agreement is the share of the commonest scheme among the k best; margin is the best score where it stands alone.
    """
    best = hits.where((F.col("rank") <= k) & F.col("score").isNotNull()).join(schemes, "pid", "left")
    modal = best.groupBy("qid", "scheme").agg(F.count(F.lit(1)).alias("c")).groupBy("qid").agg(F.max("c").alias("modal"))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    top = best.groupBy("qid").agg(at(1).alias("s1"), at(2).alias("s2"), F.min("score").alias("last"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    total = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"))
    x = top.join(modal, "qid").join(total, "qid")
    return x.select(
        "qid", F.round("s1", 6).alias("max_score"), F.round(F.col("s1") - F.coalesce("s2", F.lit(0.0)), 6).alias("margin"), F.round("mean", 6).alias("mean_top_k"), "n_candidates",
        F.round(F.col("s1") - F.col("last"), 6).alias("spread"), F.round(F.col("modal") / F.col("n"), 6).alias("scheme_agreement"),
    )


def confusion(pred: Column, gold: Column) -> list[Column]:
    """Counts with UNANSWERABLE as positive: tp, fp, fn, tn; ``pred`` and ``gold`` are true for answerable."""
    return [F.count_if(~pred & ~gold).alias("tp"), F.count_if(~pred & gold).alias("fp"), F.count_if(pred & ~gold).alias("fn"), F.count_if(pred & gold).alias("tn")]


def rates(counts: DataFrame) -> DataFrame:
    """``counts`` with accuracy, precision, recall and f1; 0 where nothing is to divide by."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return counts.withColumns({"accuracy": safe(tp + tn, tp + fp + fn + tn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)})


def sweep(scored: DataFrame, *, grid: int = 40, first: int = 0) -> DataFrame:
    """For tau = first/grid ... 1 the confusion of ``scored`` (score in [0, 1], answerable), predicted answerable from tau up.

    Scores are counted by the grid step they reach, so each row is read once, not once a step.
    """
    step = F.floor(F.round(F.col("score") * grid, 9)).cast("int")
    by_step = scored.groupBy(F.least(step, F.lit(grid)).alias("s")).agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u"))
    at = by_step.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(grid))))
    below = F.col("s") < F.col("t")
    sums = at.groupBy("t").agg(*[F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).cast("bigint").alias(a) for a, c, n in (("tp", below, "u"), ("fp", below, "a"), ("fn", ~below, "u"), ("tn", ~below, "a"))])
    return rates(sums).withColumn("tau", F.col("t") / float(grid)).drop("t")


def fit_cut(scored: DataFrame, *, grid: int = 40) -> DataFrame:
    """One row ``tau, f1`` for ``scored`` (score, answerable): the lowest of the cuts 0, 1/grid, ... 1 with the best f1 of UNANSWERABLE.

    A score below 0 is an abstention: unanswerable at any cut.
    """
    return sweep(scored, grid=grid).agg(F.max_by(F.struct("tau", "f1"), F.struct("f1", -F.col("tau"))).alias("b")).select("b.tau", "b.f1")


def fit_threshold(scored: DataFrame, *, grid: int = 40) -> DataFrame:
    """One row ``scale, tau, f1`` for ``scored`` (raw, answerable): scale is the largest raw score, tau the lowest of the best f1 of UNANSWERABLE."""
    scale = scored.agg(F.greatest(F.max("raw"), F.lit(1e-12)).alias("scale"))
    x = scored.crossJoin(F.broadcast(scale)).select(scaled(F.col("raw"), F.col("scale")).alias("score"), "answerable")
    return scale.crossJoin(fit_cut(x, grid=grid)).select(F.round("scale", 6).alias("scale"), "tau", "f1")


def scaled(raw: Column, scale: Column) -> Column:
    return F.least(F.greatest(raw / scale, F.lit(0.0)), F.lit(1.0))


def self_report(answerable: Column, confidence: Column) -> Column:
    """What a generator says of its own answer, as a score: its confidence within 0 and 1, below 0 if it abstained."""
    return F.when(F.coalesce(answerable, F.lit(False)), F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(-1.0)


def entailment(value: Column, abstained: Column) -> Column:
    """How far the evidence entails the answer, as a score: below 0 without an answer or a verdict."""
    return F.when(abstained | value.isNull(), -1.0).otherwise(value)


#: What the combined signal is fitted on: retrieval, then the generator's own word, entailment and the answer's length.
COMBINED = ("max_score", "margin", "mean_top_k", "spread", "scheme_agreement", "generator_answerable", "generator_confidence", "entailment", "answer_length")


def combined(features_: DataFrame, generated: DataFrame) -> DataFrame:
    """``qid`` and COMBINED of retrieval features and ``generated`` (qid, answerable, confidence, entailment, answer); lengths count up to 60 words."""
    said = generated.select(
        "qid", F.coalesce(F.col("answerable"), F.lit(True)).cast("double").alias("generator_answerable"), F.coalesce("confidence", F.lit(0.0)).alias("generator_confidence"), F.coalesce("entailment", F.lit(0.0)).alias("entailment"),
        (F.least(T.count_tokens(F.col("answer")), F.lit(60)) / 60.0).alias("answer_length"),
    )
    return features_.join(said, "qid").select("qid", *COMBINED)


def auc(scored: DataFrame, *, group: str) -> DataFrame:
    """``group, auc, n`` of ``scored`` (group, score, positive) by mid-ranks; 0.5 where a class is empty.

    Equal scores are counted first and ranked as counts, in parts of the range (see operators.running).
    """
    counts = counted(scored, group, "score", F.count_if("positive").alias("p"))
    sums = counts.withColumn("mid", F.col("before") + (F.col("c") + 1) / 2.0).groupBy(group).agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("np"), F.sum("c").alias("n"))
    np_, nn = F.col("np"), F.col("n") - F.col("np")
    value = F.when((np_ == 0) | (nn == 0), 0.5).otherwise((F.col("r") - np_ * (np_ + 1) / 2) / F.greatest(np_ * nn, F.lit(1)))
    return sums.select(group, F.round(value, 6).alias("auc"), F.col("n").cast("bigint").alias("n"))


def fit_calibrated(train: DataFrame, columns: list[str], *, c: float = 0.5, grid: int = 40):
    """L2 logistic regression on standardized columns with balanced class weights, and the lowest best tau for f1 of UNANSWERABLE.

    ``train``: the columns and ``answerable``. Returns (weights by column, intercept, means, deviations, tau); None where a class
    is missing or there are fewer than 4 rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    one = train.agg(F.count(F.lit(1)).alias("n"), F.count_if("answerable").alias("p"), *[F.avg(x).alias(f"m_{x}") for x in columns], *[F.stddev_pop(x).alias(f"s_{x}") for x in columns]).first()
    n, p = one["n"], one["p"]
    if n < 4 or p in (0, n):
        return None
    means = {x: one[f"m_{x}"] for x in columns}
    sds = {x: one[f"s_{x}"] if one[f"s_{x}"] >= 1e-9 else 1.0 for x in columns}
    z = train.select(*[((F.col(x) - means[x]) / sds[x]).alias(x) for x in columns], F.col("answerable").cast("double").alias("label"), F.when(F.col("answerable"), n / (2.0 * p)).otherwise(n / (2.0 * (n - p))).alias("w"))
    model = LogisticRegression(standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * n), weightCol="w", maxIter=2000, tol=1e-10).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(z))
    weights = dict(zip(columns, (float(v) for v in model.coefficients)))
    scored = train.select(calibrated_score(weights, float(model.intercept), means, sds).alias("score"), "answerable")
    best = sweep(scored, grid=grid, first=1).where("tau < 1").agg(F.max_by("tau", F.struct("f1", -F.col("tau"))).alias("tau")).first()["tau"]
    return weights, float(model.intercept), means, sds, best


def calibrated_score(weights: dict[str, float], intercept: float, means: dict[str, float], sds: dict[str, float]) -> Column:
    """Probability of answerable; the logit is kept within 30."""
    z = F.lit(intercept)
    for x, w in weights.items():
        z = z + F.lit(w) * (F.col(x) - means[x]) / sds[x]
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """One row ``n, agreement, kappa`` of ``pairs`` (a, b booleans); where chance agrees fully kappa is 1 if all agree, else 0."""
    s = pairs.where("a is not null and b is not null").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(pe >= 1 - 1e-12, F.when(F.col("po") >= 1 - 1e-12, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / F.greatest(1 - pe, F.lit(1e-12)))
    return s.select("n", F.round("po", 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))
