"""Queries of answerability, answers and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.operators import answerability as A
from pramana.operators import answers as Q
from pramana.operators.running import medians
from pramana.plans import sqltext as S
from pramana.plans.base import ITEMS, PASSAGES, RANKED, items, passages, ranked_runs
from pramana.session import cut, table


def _hits(spark: SparkSession, d: str, method: str | None = None) -> DataFrame:
    r = ranked_runs(spark, d)
    if method:
        r = r.where(F.col("method_name") == method)
    return r.select("method_name", F.col("query_id").alias("qid"), F.col("passage_id").alias("pid"), "score", "rank")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select(F.col("id").alias("qid"), "answerable", "unanswerable_class", F.lower(F.trim("split")).alias("split"), "query_lang", "scheme")


def _features(spark: SparkSession, d: str, method: str = "bm25") -> DataFrame:
    return A.features(_hits(spark, d, method), passages(spark, d).select(F.col("passage_id").alias("pid"), "scheme"))


def answerability_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


def _labelled(spark: SparkSession, d: str, split: str) -> DataFrame:
    """Features and labels of a split: signals are fitted to dev and judged on test."""
    return _features(spark, d).join(_labels(spark, d).where(F.col("split") == split), "qid")


def threshold_fit(spark: SparkSession, d: str) -> DataFrame:
    return A.fit_threshold(_labelled(spark, d, "dev").select(F.col("max_score").alias("raw"), "answerable"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The test split with ``score`` on dev's scale and ``pred`` by dev's threshold."""
    fit = _labelled(spark, d, "dev").select(F.col("max_score").alias("raw"), "answerable")
    x = _labelled(spark, d, "test").crossJoin(F.broadcast(A.fit_threshold(fit)))
    x = x.withColumn("score", A.scaled(F.col("max_score"), F.col("scale")))
    return x.withColumn("pred", F.round("score", 9) >= F.col("tau"))


def tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = A.sweep(_judged(spark, d), grid=20)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return s.select("tau", "precision", "recall", "f1", F.round((F.col("tp") + F.col("fp")) / n, 6).alias("abstention"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.rates(_judged(spark, d).agg(*A.confusion(F.col("pred"), F.col("answerable"))))


def recall_by_class(spark: SparkSession, d: str) -> DataFrame:
    x = _judged(spark, d).where("not answerable")
    return x.groupBy("unanswerable_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((~F.col("pred")).cast("double")), 6).alias("recall"))


def abstention_by_query_type(spark: SparkSession, d: str) -> DataFrame:
    """Share of questions refused, and of answerable ones refused, by query type."""
    kinds = items(spark, d).select(F.col("id").alias("qid"), T.classify_language(F.col("question"))["query_type"].alias("query_type"))
    x = _judged(spark, d).join(kinds, "qid").withColumn("refused", (~F.col("pred")).cast("double"))
    return x.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("refused"), 6).alias("abstention"), F.round(F.coalesce(F.avg(F.when(F.col("answerable"), F.col("refused"))), F.lit(0.0)), 6).alias("over_abstention"))


def auc_midrank(spark: SparkSession, d: str) -> DataFrame:
    """For each method how well its best score tells answerable questions."""
    best = _hits(spark, d).groupBy("method_name", "qid").agg(F.round(F.max("score"), 9).alias("score")).join(_labels(spark, d).select("qid", F.col("answerable").alias("positive")), "qid")
    return A.auc(best, group="method_name")


def feature_separation(spark: SparkSession, d: str) -> DataFrame:
    """For each feature its medians by label and its AUC, over the test split."""
    names = [f for f in A.FEATURES if f != "n_candidates"]
    long = cut(_labelled(spark, d, "test").select("answerable", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("score")) for n in names])).alias("x")).select("answerable", "x.feature", "x.score"))
    of = lambda label, name: medians(long.where(F.col("answerable") == label), "feature", "score", name)
    both = of(True, "a").join(of(False, "u"), "feature").select("feature", F.round("a", 6).alias("median_answerable"), F.round("u", 6).alias("median_unanswerable"))
    return both.join(A.auc(long.withColumnRenamed("answerable", "positive"), group="feature"), "feature").select("feature", "median_answerable", "median_unanswerable", "auc")


def separation_across_methods(spark: SparkSession, d: str) -> DataFrame:
    """For each method the medians of its best scores by label, and the best f1 of UNANSWERABLE at a cut of twenty."""
    best = _hits(spark, d).groupBy("method_name", "qid").agg(F.round(F.max("score"), 9).alias("score")).join(_labels(spark, d).select("qid", "answerable"), "qid").where("score is not null")
    best = cut(best)
    tops = best.groupBy("method_name").agg(F.max("score").alias("top"))
    x = best.join(F.broadcast(tops), "method_name").withColumn("scaled", A.scaled(F.col("score"), F.greatest("top", F.lit(1e-12))))
    step = F.least(F.floor(F.round(F.col("scaled") * 20, 9)).cast("int"), F.lit(20))
    by = x.groupBy("method_name", step.alias("s")).agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(20))))
    below = F.col("s") < F.col("t")
    sums = by.groupBy("method_name", "t").agg(F.sum(F.when(below, F.col("u")).otherwise(0)).alias("tp"), F.sum(F.when(below, F.col("a")).otherwise(0)).alias("fp"), F.sum(F.when(~below, F.col("u")).otherwise(0)).alias("fn"))
    f1 = F.round(F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)), 6)
    top = sums.withColumn("f1", f1).groupBy("method_name").agg(F.max_by(F.struct("f1", F.col("t")), F.struct("f1", -F.col("t"))).alias("b"))
    of = lambda label, name: medians(best.where(F.col("answerable") == label), "method_name", "score", name)
    return of(True, "a").join(of(False, "u"), "method_name").join(top, "method_name").select("method_name", F.round("a", 6).alias("median_answerable"), F.round("u", 6).alias("median_unanswerable"), F.col("b.f1").alias("best_f1"), (F.col("b.t") / 20.0).alias("tau"))


def calibrated_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = A.fit_calibrated(_labelled(spark, d, "dev"), [f for f in A.FEATURES if f != "n_candidates"])
    rows = [] if fitted is None else [(x, round(w, 4)) for x, w in fitted[0].items()] + [("intercept", round(fitted[1], 4)), ("tau", fitted[4])]
    return spark.createDataFrame(rows, "feature string, weight double")


# Weights, means and deviations to score with, so that a score can be told without a fit.
GIVEN = {"max_score": (0.8, 20.0, 6.0), "margin": (0.4, 1.5, 2.0), "mean_top_k": (-0.3, 16.0, 5.0), "spread": (0.2, 5.0, 3.0), "scheme_agreement": (0.6, 0.6, 0.25)}


def calibrated_score(spark: SparkSession, d: str) -> DataFrame:
    """The probability of answerable of the test split, by given weights."""
    score = A.calibrated_score({k: v[0] for k, v in GIVEN.items()}, 0.1, {k: v[1] for k, v in GIVEN.items()}, {k: v[2] for k, v in GIVEN.items()})
    return _labelled(spark, d, "test").select("qid", F.round(score, 6).alias("probability"))


def calibrated_report(spark: SparkSession, d: str) -> DataFrame:
    """The signal fitted to dev and judged on test: f1 of UNANSWERABLE and AUC."""
    names = [f for f in A.FEATURES if f != "n_candidates"]
    fitted = A.fit_calibrated(_labelled(spark, d, "dev"), names)
    x = _labelled(spark, d, "test").withColumn("probability", F.lit(1.0) if fitted is None else A.calibrated_score(*fitted[:4]))
    counts = A.rates(x.agg(*A.confusion(F.col("probability") >= (0.0 if fitted is None else fitted[4]), F.col("answerable"))))
    ranked = A.auc(x.select(F.lit("test").alias("part"), F.round("probability", 9).alias("score"), F.col("answerable").alias("positive")), group="part")
    return counts.crossJoin(ranked).select("n", "precision", "recall", "f1", "auc")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """What the extractive generator says of each question, and the best dense score in the place of an entailment."""
    hits = _hits(spark, d, "script_aware").where("rank <= 5").join(passages(spark, d).select(F.col("passage_id").alias("pid"), "text"), "pid")
    said = Q.extractive(items(spark, d).select(F.col("id").alias("qid"), "question"), hits)
    dense = _hits(spark, d, "dense").groupBy("qid").agg(F.round(F.max("score"), 9).alias("entailment"))
    return said.join(dense, "qid", "left").select("qid", (F.col("confidence") > 0.15).alias("said"), "confidence", "entailment", "answer")


def selfreport_fit(spark: SparkSession, d: str) -> DataFrame:
    x = _generated(spark, d).join(_labels(spark, d).where("split = 'dev'"), "qid")
    return A.fit_cut(x.select(A.self_report(F.col("said"), F.col("confidence")).alias("score"), "answerable"), grid=20)


def entailment_fit(spark: SparkSession, d: str) -> DataFrame:
    x = _generated(spark, d).join(_labels(spark, d).where("split = 'dev'"), "qid")
    return A.fit_cut(x.select(A.entailment(F.col("entailment"), ~F.col("said")).alias("score"), "answerable"))


def combined_features(spark: SparkSession, d: str) -> DataFrame:
    g = _generated(spark, d).withColumnRenamed("said", "answerable")
    return A.combined(_features(spark, d), g).select("qid", *[F.round(c, 6).alias(c) for c in A.COMBINED])


def second_pass_agreement(spark: SparkSession, d: str) -> DataFrame:
    """First-pass labels against the last second-pass label of each question."""
    second = table(spark, d, "second_pass").where("answerable is not null").groupBy("id").agg(F.max(F.struct("labelled_at", "label_id", "answerable")).getField("answerable").alias("b"))
    return A.cohens_kappa(items(spark, d).select("id", F.col("answerable").alias("a")).join(second, "id"))


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """answer_gold against answer_gold_hi where both are given."""
    x = items(spark, d).where("answer_gold <> '' and answer_gold_hi <> ''")
    return x.select("id", Q.exact_match(F.col("answer_gold"), F.col("answer_gold_hi")).alias("em"))


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d).where("answer_gold is not null and answer_gold_hi is not null")
    x = x.select("id", T.answer_tokens(F.col("answer_gold")).alias("p"), T.answer_tokens(F.col("answer_gold_hi")).alias("g"))
    return x.select("id", F.round(Q.token_f1(F.col("p"), F.col("g")), 6).alias("f1"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the text of each gold passage."""
    x = items(spark, d).where("answerable and answer_gold <> ''").select("id", "answer_gold", "passage_lang", F.explode("gold_passage_ids").alias("passage_id"))
    return x.join(passages(spark, d).select("passage_id", "text"), "passage_id")


def rouge_l_precision(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("id", "passage_id", F.round(Q.rouge_l_precision(F.col("answer_gold"), F.col("text")), 6).alias("support"))


def grounding_by_arm(spark: SparkSession, d: str) -> DataFrame:
    """By language of the evidence: share of answers with support of at least 0.6, mean support, share abstained."""
    best = _evidence(spark, d).groupBy("id").agg(F.max(Q.rouge_l_precision(F.col("answer_gold"), F.col("text"))).alias("support"))
    x = items(spark, d).where("answerable").select("id", "passage_lang", (F.coalesce("answer_gold", F.lit("")) == "").alias("abstained")).join(best, "id", "left")
    return x.groupBy(F.col("passage_lang").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("abstained").cast("double")), 6).alias("abstention"), F.round(F.avg(F.when(F.col("support").isNotNull(), (F.col("support") >= 0.6).cast("double"))), 6).alias("supported"), F.round(F.avg("support"), 6).alias("mean_support"))


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    """The best sentence of the passages the script-aware runs found."""
    hits = _hits(spark, d, "script_aware").where("rank <= 5").join(passages(spark, d).select(F.col("passage_id").alias("pid"), "text"), "pid")
    asked = items(spark, d).select(F.col("id").alias("qid"), "question")
    return Q.extractive(asked, hits).select("qid", "pid", F.md5("answer").alias("answer"), "confidence")


def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d, "script_aware").where("rank <= 5").join(passages(spark, d).withColumnRenamed("passage_id", "pid"), "pid")
    return Q.prompts(items(spark, d).select(F.col("id").alias("qid"), "question"), hits).select("qid", F.substring(F.sha2(F.concat(F.lit("m\u0000\u0000"), F.col("prompt")), 256), 1, 16).alias("prompt_hash"), F.length("prompt").cast("bigint").alias("n_chars"))


def answer_batch(spark: SparkSession, d: str) -> DataFrame:
    """Gates before an answer: refuse without hits, under tau, or with a lexical best score under the floor."""
    return Q.gates(_hits(spark, d, "dense"), _hits(spark, d, "bm25"), tau=0.83, bm25_floor=12.0)


QUERIES = [answerability_features, threshold_fit, tau_sweep, confusion_matrix, recall_by_class, abstention_by_query_type, auc_midrank, feature_separation, separation_across_methods, calibrated_fit, calibrated_score, calibrated_report, selfreport_fit, entailment_fit, combined_features, second_pass_agreement, exact_match, token_f1, rouge_l_precision, grounding_by_arm, extractive_answer, build_prompt, answer_batch]

_H = f"h AS (SELECT query_id qid, passage_id pid, method_name m, score, rank FROM {RANKED})"
_F = f"""{_H}, b AS (SELECT h.*, scheme FROM h LEFT JOIN {PASSAGES} p ON p.passage_id = h.pid WHERE m = 'bm25' AND rank <= 5 AND score IS NOT NULL),
md AS (SELECT qid, max(c) modal FROM (SELECT qid, scheme, count(*) c FROM b GROUP BY qid, scheme) GROUP BY qid),
f AS (SELECT qid, round(max(score) FILTER (rank = 1), 6) max_score, round(max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0.0), 6) margin, round(avg(score), 6) mean_top_k,
  (SELECT count(*) FROM h WHERE h.qid = b.qid AND m = 'bm25') n_candidates, round(max(score) FILTER (rank = 1) - min(score), 6) spread, round(any_value(modal) / CAST(count(*) AS DOUBLE), 6) scheme_agreement FROM b JOIN md USING (qid) GROUP BY qid),
lb AS (SELECT f.*, answerable, unanswerable_class, lower(trim(split)) part FROM f JOIN {ITEMS} i ON i.id = f.qid), dv AS (SELECT *, least(greatest(max_score / greatest(max(max_score) OVER (), 1e-12), 0.0), 1.0) score FROM lb WHERE part = 'dev')"""
_X = ", x AS (SELECT *, round(score, 9) >= tau AS pred FROM (SELECT lb.*, tau, least(greatest(max_score / scale, 0.0), 1.0) score FROM lb, (SELECT round((SELECT greatest(max(max_score), 1e-12) FROM dv), 6) scale, tau FROM {sweep} ORDER BY f1 DESC, tau LIMIT 1) WHERE part = 'test'))"


def _rates(a: str = "tp", b: str = "fp", c: str = "fn", e: str = "tn") -> str:
    safe = lambda p, q: f"round(CASE WHEN {q} > 0 THEN CAST({p} AS DOUBLE) / ({q}) ELSE 0.0 END, 6)"
    return f"{safe(f'({a} + {e})', f'{a} + {b} + {c} + {e}')} AS accuracy, {safe(a, f'{a} + {b}')} AS precision, {safe(a, f'{a} + {c}')} AS recall, {safe(f'(2 * {a})', f'2 * {a} + {b} + {c}')} AS f1"


def _sweep(grid: int, source: str = "x") -> str:
    return f"(SELECT *, {_rates()}, t / {float(grid)} tau FROM (SELECT t, count(*) FILTER (s < t AND NOT answerable) tp, count(*) FILTER (s < t AND answerable) fp, count(*) FILTER (s >= t AND NOT answerable) fn, count(*) FILTER (s >= t AND answerable) tn FROM (SELECT least(CAST(floor(round(score * {grid}, 9)) AS INT), {grid}) s, answerable FROM {source}), (SELECT unnest(generate_series(0, {grid})) t) GROUP BY t))"


def _auc(source: str, group: str) -> str:
    return f"""(SELECT {group}, round(CASE WHEN np = 0 OR n = np THEN 0.5 ELSE (r - np * (np + 1) / 2.0) / (CAST(np AS DOUBLE) * (n - np)) END, 6) auc, CAST(n AS BIGINT) n FROM (
  SELECT {group}, sum(mid) FILTER (positive) r, count(*) FILTER (positive) np, count(*) n FROM (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY score) + (count(*) OVER (PARTITION BY {group}, score) - 1) / 2.0 mid FROM {source} WHERE score IS NOT NULL) GROUP BY {group}))"""


_LONG = "(SELECT answerable, answerable positive, feature, score FROM (UNPIVOT (SELECT answerable, max_score, margin, mean_top_k, spread, scheme_agreement FROM x) ON max_score, margin, mean_top_k, spread, scheme_agreement INTO NAME feature VALUE score))"
_EV = f"(SELECT id, answer_gold, passage_id, text FROM (SELECT id, answer_gold, unnest(gold_passage_ids) passage_id FROM {ITEMS} WHERE answerable AND answer_gold <> '') JOIN {PASSAGES} USING (passage_id))"

_FX = _F + _X.format(sweep=_sweep(40, "dv"))
_GN = """gh AS (SELECT query_id qid, passage_id pid, rank FROM RANKED WHERE method_name = 'script_aware' AND rank <= 5 AND passage_id IN (SELECT passage_id FROM passages)), EXTRACT,
gd AS (SELECT ex.qid, ex.confidence > 0.15 said, ex.confidence, answer, entailment, answerable, lower(trim(split)) part FROM ex JOIN ITEMS i ON i.id = ex.qid LEFT JOIN (SELECT query_id qid, round(max(score), 9) entailment FROM RANKED WHERE method_name = 'dense' GROUP BY 1) USING (qid))"""


def _generated_sql() -> str:
    from pramana.plans.pipeline import _extract

    return _GN.replace("EXTRACT", _extract("gh", ITEMS)).replace("RANKED", RANKED).replace("ITEMS", ITEMS)


def _cut_sql(source: str, grid: int) -> str:
    return f"SELECT tau, f1 FROM {_sweep(grid, source)} ORDER BY f1 DESC, tau LIMIT 1"


_Z = " + ".join(f"CAST({w} AS DOUBLE) * ({n} - CAST({m} AS DOUBLE)) / CAST({v} AS DOUBLE)" for n, (w, m, v) in GIVEN.items())
ORACLES = {
    "answerability_features": f"WITH {_F} SELECT * FROM f",
    "threshold_fit": f"WITH {_F} SELECT round((SELECT max(max_score) FROM dv), 6) AS scale, tau, f1 FROM {_sweep(40, 'dv')} ORDER BY f1 DESC, tau LIMIT 1",
    "tau_sweep": f"WITH {_FX} SELECT tau, precision, recall, f1, round((tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS abstention FROM {_sweep(20)}",
    "confusion_matrix": f"WITH {_FX} SELECT *, {_rates()} FROM (SELECT count(*) FILTER (NOT pred AND NOT answerable) tp, count(*) FILTER (NOT pred AND answerable) fp, count(*) FILTER (pred AND NOT answerable) fn, count(*) FILTER (pred AND answerable) tn FROM x)",
    "recall_by_class": f"WITH {_FX} SELECT unanswerable_class, count(*) AS n, round(avg(CAST(NOT pred AS INT)), 6) AS recall FROM x WHERE NOT answerable GROUP BY 1",
    "abstention_by_query_type": f"WITH {_FX} SELECT query_type, count(*) AS n, round(avg(CAST(NOT pred AS INT)), 6) AS abstention, round(coalesce(avg(CAST(NOT pred AS INT)) FILTER (answerable), 0.0), 6) AS over_abstention FROM x JOIN (SELECT id qid, {S.QUERY_TYPE.format(k='k')} query_type FROM (SELECT id, {S.language_kind('question')} k FROM {ITEMS})) USING (qid) GROUP BY 1",
    "auc_midrank": f"WITH {_H}, z AS (SELECT m method_name, qid, round(max(score), 9) score, any_value(answerable) positive FROM h JOIN {ITEMS} i ON i.id = h.qid GROUP BY 1, 2) SELECT method_name, auc, n FROM {_auc('z', 'method_name')}",
    "feature_separation": f"WITH {_FX}, lg AS (SELECT * FROM {_LONG}) SELECT feature, round(median(score) FILTER (answerable), 6) AS median_answerable, round(median(score) FILTER (NOT answerable), 6) AS median_unanswerable, any_value(auc) AS auc FROM lg JOIN {_auc('lg', 'feature')} USING (feature) GROUP BY feature",
    "separation_across_methods": f"""WITH {_H}, z AS (SELECT m method_name, qid, round(max(score), 9) score, any_value(answerable) answerable FROM h JOIN {ITEMS} i ON i.id = h.qid GROUP BY 1, 2), y AS (SELECT * FROM z WHERE score IS NOT NULL),
w AS (SELECT *, least(CAST(floor(round(least(greatest(score / greatest(max(score) OVER (PARTITION BY method_name), 1e-12), 0.0), 1.0) * 20, 9)) AS INT), 20) s FROM y),
c AS (SELECT method_name, t, count(*) FILTER (s < t AND NOT answerable) tp, count(*) FILTER (s < t AND answerable) fp, count(*) FILTER (s >= t AND NOT answerable) fn FROM w, (SELECT unnest(generate_series(0, 20)) t) GROUP BY 1, 2),
b AS (SELECT method_name, t, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) f1 FROM c QUALIFY row_number() OVER (PARTITION BY method_name ORDER BY round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) DESC, t) = 1)
SELECT method_name, round(median(score) FILTER (answerable), 6) AS median_answerable, round(median(score) FILTER (NOT answerable), 6) AS median_unanswerable, any_value(f1) AS best_f1, any_value(t) / 20.0 AS tau FROM y JOIN b USING (method_name) GROUP BY method_name""",
    "calibrated_score": f"WITH {_F} SELECT qid, round(1 / (1 + exp(-least(greatest(CAST(0.1 AS DOUBLE) + {_Z}, -30.0), 30.0))), 6) AS probability FROM lb WHERE part = 'test'",
    "second_pass_agreement": f"""WITH s AS (SELECT id, answerable b FROM second_pass WHERE answerable IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY labelled_at DESC, label_id DESC) = 1),
p AS (SELECT i.answerable a, b FROM {ITEMS} i JOIN s USING (id)), t AS (SELECT count(*) n, avg(CAST(a = b AS INT)) po, avg(CAST(a AS INT)) pa, avg(CAST(b AS INT)) pb FROM p)
SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM t""",
    "exact_match": f"SELECT id, a = b OR coalesce(ka = kb, false) AS em FROM (SELECT id, {S.normalize_answer('answer_gold')} a, {S.normalize_answer('answer_gold_hi')} b, {S.amount_key('answer_gold')} ka, {S.amount_key('answer_gold_hi')} kb FROM {ITEMS} WHERE answer_gold <> '' AND answer_gold_hi <> '')",
    "token_f1": f"""WITH t AS (SELECT id, {S.answer_tokens('answer_gold')} a, {S.answer_tokens('answer_gold_hi')} b FROM {ITEMS} WHERE answer_gold IS NOT NULL AND answer_gold_hi IS NOT NULL),
o AS (SELECT id, sum(least(ca, cb)) n FROM (SELECT id, w, count(*) ca FROM (SELECT id, unnest(a) w FROM t) GROUP BY 1, 2) JOIN (SELECT id, w, count(*) cb FROM (SELECT id, unnest(b) w FROM t) GROUP BY 1, 2) USING (id, w) GROUP BY id)
SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(len(a) = len(b) AS INT) ELSE 2.0 * coalesce(n, 0) / (len(a) + len(b)) END, 6) AS f1 FROM t LEFT JOIN o USING (id)""",
    "build_prompt": f"""WITH {_H}, c AS (SELECT qid, string_agg('[' || rank || '] id=' || pid || ' (' || scheme || ', ' || coalesce(nullif(section_path, ''), 'lead') || ')' || chr(10) || left(coalesce(text, ''), 900), chr(10) || chr(10) ORDER BY rank) ctx FROM h JOIN {PASSAGES} p ON p.passage_id = h.pid WHERE m = 'script_aware' AND rank <= 5 GROUP BY qid),
pr AS (SELECT qid, 'Answer from the passages only.' || chr(10) || chr(10) || 'Passages:' || chr(10) || ctx || chr(10) || chr(10) || 'Question: ' || question || chr(10) prompt FROM c JOIN {ITEMS} i ON i.id = qid)
SELECT qid, substr(sha256('m' || chr(0) || chr(0) || prompt), 1, 16) AS prompt_hash, length(prompt) AS n_chars FROM pr""",
    "answer_batch": f"""WITH {_H}, t AS (SELECT qid, max(score) FILTER (rank = 1) top, max(score) FILTER (rank = 2) nxt FROM h WHERE m = 'dense' GROUP BY qid), l AS (SELECT qid, max(score) lex FROM h WHERE m = 'bm25' GROUP BY qid)
SELECT qid, CASE WHEN lex < 12.0 THEN 'below_floor' WHEN top < 0.83 THEN 'below_tau' ELSE 'answer' END AS decision, round(top, 6) AS top_score, round(top - coalesce(nxt, 0.0), 6) AS margin,
  round(CASE WHEN lex < 12.0 OR top < 0.83 THEN 1 - least(top, 1.0) ELSE least(greatest(top, 0.0), 1.0) END, 6) AS confidence FROM t JOIN l USING (qid)""",
}


def _late() -> dict[str, str]:
    """SQL that needs that of the pipeline."""
    g = _generated_sql()
    own = "CASE WHEN said THEN least(greatest(confidence, 0.0), 1.0) ELSE -1.0 END"
    return {
        "selfreport_fit": f"WITH {g}, sr AS (SELECT {own} score, answerable FROM gd WHERE part = 'dev') {_cut_sql('sr', 20)}",
        "entailment_fit": f"WITH {g}, sr AS (SELECT CASE WHEN NOT said OR entailment IS NULL THEN -1.0 ELSE entailment END score, answerable FROM gd WHERE part = 'dev') {_cut_sql('sr', 40)}",
        "combined_features": f"WITH {_F}, {g} SELECT qid, f.max_score, f.margin, f.mean_top_k, f.spread, f.scheme_agreement, CAST(said AS DOUBLE) AS generator_answerable, round(confidence, 6) AS generator_confidence, round(coalesce(entailment, 0.0), 6) AS entailment, round(least({S.count_tokens('answer')}, 60) / 60.0, 6) AS answer_length FROM f JOIN gd USING (qid)",
        "extractive_answer": f"WITH {g} SELECT qid, pid, md5(answer) AS answer, confidence FROM ex",
    }
