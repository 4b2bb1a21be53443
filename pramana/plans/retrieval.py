"""Queries of dense retrieval, fusion, retrieval metrics and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.operators import dense as D
from pramana.operators import fusion, metrics
from pramana.operators.topk import hash_order_sql
from pramana.plans import sqltext as S
from pramana.plans.base import ITEMS, PASSAGES, RANKED, items, passages, ranked_runs
from pramana.session import table


def _list(spark: SparkSession, d: str, method: str) -> DataFrame:
    return ranked_runs(spark, d).where(F.col("method_name") == method).select(F.col("query_id").alias("qid"), F.col("passage_id").alias("pid"), "score", "rank")


def _scripts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = passages(spark, d).select(F.col("passage_id").alias("pid"), F.when(F.col("lang") == "hi", "deva").otherwise("latin").alias("script"))
    q = items(spark, d).select(F.col("id").alias("qid"), T.classify_language(F.col("question"))["script"].alias("script"))
    return p, q


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v"))
    return D.dense_topk(e.where("pid % 100 = 0").withColumnRenamed("pid", "qid"), e)


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", D.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in (0, 31, 63)])


def hash_encode(spark: SparkSession, d: str) -> DataFrame:
    return D.hash_encode(passages(spark, d))


def masked_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double"))).alias("s"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i <= F.col("vec_id") % 4).cast("int")).alias("m"))
    v = e.select("vec_id", D.masked_mean(F.col("s"), F.col("m")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(15)), 6).alias("last"))


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return D.corpus_fingerprint(passages(spark, d))


def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal(_list(spark, d, "bm25"), _list(spark, d, "dense"))


def fuse_rrf_many(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_many(ranked_runs(spark, d).select(F.col("query_id").alias("qid"), F.col("passage_id").alias("pid"), "rank"))


def fuse_weighted_minmax(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted(_list(spark, d, "bm25"), _list(spark, d, "dense"))


def fuse_weighted_zscore(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted(_list(spark, d, "bm25"), _list(spark, d, "dense"), how="zscore")


def fuse_rrf_script_aware(spark: SparkSession, d: str) -> DataFrame:
    return fusion.script_aware(_list(spark, d, "bm25"), _list(spark, d, "dense"), *_scripts(spark, d))


def fuse_rrf_observed_votes(spark: SparkSession, d: str) -> DataFrame:
    return fusion.script_aware(_list(spark, d, "bm25"), _list(spark, d, "dense"), *_scripts(spark, d), count_observed_votes=True)


def fusion_example(spark: SparkSession, d: str) -> DataFrame:
    """The script-aware ranking with each list's part in it."""
    return fusion.explained(_list(spark, d, "bm25"), _list(spark, d, "dense"), *_scripts(spark, d))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where("answerable").select(F.col("id").alias("qid"), F.col("gold_passage_ids").alias("gold"))


def retrieval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    runs = ranked_runs(spark, d).select(F.col("method_name").alias("system"), F.col("query_id").alias("qid"), F.col("passage_id").alias("pid"), "rank")
    return metrics.outcomes(runs, _gold(spark, d))


def retrieval_by_slice(spark: SparkSession, d: str) -> DataFrame:
    keys = items(spark, d).select(F.col("id").alias("qid"), metrics.slice_key(F.col("query_lang"), F.col("passage_lang"), F.col("answerable")).alias("slice_key"), metrics.language_group(F.col("query_lang"), F.col("passage_lang")).alias("language_group"))
    return metrics.by_slice(retrieval_outcomes(spark, d).join(keys, "qid"), ["recall_5", "rr", "ndcg_10"])


def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall at 5 of weighted fusion for alpha 0, 0.1, ..., 1."""
    lexical, dense, gold = _list(spark, d, "bm25"), _list(spark, d, "dense"), _gold(spark, d)
    both = fusion._both(fusion.normalized(lexical), fusion.normalized(dense), "norm").withColumn("tenth", F.explode(F.sequence(F.lit(0), F.lit(10))))
    a = F.col("tenth") / 10.0
    scored = both.withColumn("score", F.round(a * F.coalesce("lex_norm", F.lit(0.0)) + (1 - a) * F.coalesce("dense_norm", F.lit(0.0)), 9)).withColumn("q", F.col("qid")).withColumn("qid", F.concat_ws("@", "qid", "tenth"))
    top = fusion._ranked(scored, 5).withColumn("tenth", F.substring_index("qid", "@", -1).cast("int")).withColumn("qid", F.substring_index("qid", "@", 1))
    out = metrics.outcomes(top.withColumn("system", F.col("tenth").cast("string")), gold, ks=(5,))
    return out.groupBy("system").agg(F.round(F.avg("recall_5"), 6).alias("recall_5"), F.count(F.lit(1)).alias("n")).select((F.col("system").cast("int") / 10.0).alias("alpha"), "recall_5", "n")


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    values = retrieval_outcomes(spark, d).select("system", "qid", F.col("recall_5").alias("value"))
    return metrics.bootstrap_interval(values)


def paired_randomization(spark: SparkSession, d: str) -> DataFrame:
    o = retrieval_outcomes(spark, d)
    one = lambda s: o.where(F.col("system") == s).select("qid", F.col("recall_5").alias("value"))
    return metrics.paired_randomization(one("dense"), one("bm25"))


def score_skew(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted skewness of each method's scores."""
    g = ranked_runs(spark, d).where("score is not null").groupBy("method_name").agg(F.skewness("score").alias("g"), F.count(F.lit(1)).alias("n"))
    return g.select("method_name", "n", F.round(F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1.0)) / (F.col("n") - 2), 4).alias("skew"))


def observed_vote_fires(spark: SparkSession, d: str) -> DataFrame:
    """How many lexical hits are in another script than their question, by the question's script."""
    p, q = _scripts(spark, d)
    hits = _list(spark, d, "bm25").join(p.withColumnRenamed("script", "p"), "pid", "left").join(q.withColumnRenamed("script", "q"), "qid")
    across = ~F.col("q").isin("mixed", "unknown") & (F.coalesce("p", F.lit("unknown")) != F.col("q"))
    return hits.groupBy("q").agg(F.count(F.lit(1)).alias("hits"), F.count_if(across).alias("fires")).withColumnRenamed("q", "script")


QUERIES = [dense_topk, l2_normalize, hash_encode, masked_mean_pool, corpus_fingerprint, fuse_rrf, fuse_rrf_many, fuse_weighted_minmax, fuse_weighted_zscore, fuse_rrf_script_aware, fuse_rrf_observed_votes, fusion_example, retrieval_outcomes, retrieval_by_slice, alpha_sweep, bootstrap_ci, paired_randomization, score_skew, observed_vote_fires]

_R = f"r AS (SELECT query_id qid, passage_id pid, method_name m, score, rank FROM {RANKED})"


def _norm(m: str, how: str) -> str:
    if how == "minmax":
        value = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0.5 ELSE (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-300) END"
    else:
        value = "CASE WHEN coalesce(stddev_samp(score) OVER w, 0) < 1e-12 THEN 0.0 ELSE (score - avg(score) OVER w) / greatest(coalesce(stddev_samp(score) OVER w, 0), 1e-300) END"
    return f"(SELECT qid, pid, rank, {value} AS norm FROM r WHERE m = '{m}' WINDOW w AS (PARTITION BY qid))"


_JOIN = "(SELECT coalesce(l.qid, e.qid) qid, coalesce(l.pid, e.pid) pid, l.rank lr, e.rank er, l.norm ln, e.norm en FROM {l} l FULL OUTER JOIN {e} e ON l.qid = e.qid AND l.pid = e.pid)"
_PLAIN = "(SELECT qid, pid, rank, NULL norm FROM r WHERE m = '{m}')"
_VOTES = "(coalesce(1.0 / (60 + lr), 0.0) + coalesce(1.0 / (60 + er), 0.0))"
_BEST = "SELECT qid, pid, score, rank FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lr NULLS LAST, er NULLS LAST, pid) rank FROM s) WHERE rank <= 10"


def _weighted(how: str) -> str:
    both = _JOIN.format(l=_norm("bm25", how), e=_norm("dense", how))
    return f"WITH {_R}, s AS (SELECT *, round(0.4 * coalesce(ln, 0.0) + (1 - CAST(0.4 AS DOUBLE)) * coalesce(en, 0.0), 9) score FROM {both}) {_BEST}"


_PAIR = _JOIN.format(l=_PLAIN.format(m="bm25"), e=_PLAIN.format(m="dense"))
_QS = f"(SELECT id qid, {S.QUERY_SCRIPT.format(k='k')} q FROM (SELECT id, {S.language_kind('question')} k FROM {ITEMS}))"
_PS = f"(SELECT passage_id pid, CASE WHEN lang = 'hi' THEN 'deva' ELSE 'latin' END p FROM {PASSAGES})"


def _aware(observed: bool) -> str:
    could = "coalesce(q, 'unknown') IN ('mixed', 'unknown') OR coalesce(p, 'unknown') = coalesce(q, 'unknown')" + (" OR lr IS NOT NULL" if observed else "")
    return f"WITH {_R}, s AS (SELECT x.*, round({_VOTES} * 2 / (CASE WHEN {could} THEN 2 ELSE 1 END), 9) score FROM {_PAIR} x LEFT JOIN {_PS} USING (pid) LEFT JOIN {_QS} USING (qid)) {_BEST}"


def _outcomes(ks=(1, 3, 5, 10)) -> str:
    cols = []
    for k in ks:
        hits = f"len(list_filter(list_slice(found, 1, {k}), lambda p: list_contains(gold, p)))"
        cols += [f"CAST({hits} > 0 AS DOUBLE) AS hit_{k}", f"round(len(list_intersect(list_distinct(list_slice(found, 1, {k})), gold)) / CAST(len(list_distinct(gold)) AS DOUBLE), 6) AS recall_{k}", f"round({hits} / {k}.0, 6) AS precision_{k}"]
    return f"""(SELECT system, qid, {', '.join(cols)},
  round(coalesce(1.0 / list_min(list_filter(list_transform(generate_series(1, len(found)), lambda i: CASE WHEN list_contains(gold, found[i]) THEN i END), lambda i: i IS NOT NULL)), 0.0), 6) AS rr,
  round(list_sum(list_transform(generate_series(1, least(len(found), 10)), lambda i: CASE WHEN list_contains(gold, found[i]) THEN 1 / log2(i + 1) ELSE 0.0 END)) / list_sum(list_transform(generate_series(1, least(len(gold), 10)), lambda i: 1 / log2(i + 1))), 6) AS ndcg_10
 FROM (SELECT method_name system, query_id qid, list(passage_id ORDER BY rank, passage_id) found FROM {RANKED} GROUP BY ALL) JOIN (SELECT id qid, gold_passage_ids gold FROM {ITEMS} WHERE answerable AND len(gold_passage_ids) > 0) USING (qid))"""


_SEED = hash_order_sql("qid", metrics.SEED)


def _mixed(seed: str) -> str:
    """The 53 random bits of metrics.random_bits, as UBIGINT, for a seed and a {{step}}."""
    two = "18446744073709551616"
    z = f"((CAST({seed} AS HUGEINT) + CAST({{step}} + 1 AS HUGEINT) * 11400714819323198485) % {two})"
    for shift, by in ((30, 13787848793156543929), (27, 10723151780598845931)):
        u = f"CAST({z} AS UBIGINT)"
        z = f"((CAST(xor({u}, {u} >> {shift}) AS HUGEINT) % 4294967296 * {by} + CAST(xor({u}, {u} >> {shift}) AS HUGEINT) // 4294967296 * {by} % 4294967296 * 4294967296) % {two})"
    u = f"CAST({z} AS UBIGINT)"
    return f"(xor({u}, {u} >> 31) >> 11)"


_BITS = _mixed("h")

ORACLES = {
    "dense_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings),
s AS (SELECT a.vec_id qid, b.vec_id pid, round(list_cosine_similarity(a.v, b.v), 6) score FROM e a, e b WHERE a.vec_id % 100 = 0)
SELECT qid, pid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) rank FROM s) WHERE rank <= 10""",
    "l2_normalize": "SELECT vec_id, round(v[1] / n, 6) AS v0, round(v[32] / n, 6) AS v31, round(v[64] / n, 6) AS v63 FROM (SELECT vec_id, v, CASE WHEN sqrt(list_sum(list_transform(v, lambda x: x * x))) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(v, lambda x: x * x))) END n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings))",
    "hash_encode": f"""WITH t AS (SELECT pid, term, count(*) tf, CAST(('0x' || substr(md5(term), 1, 15)) AS BIGINT) h FROM (SELECT passage_id pid, unnest({S.tokenize('text')}) term FROM {PASSAGES}) GROUP BY pid, term),
s AS (SELECT pid, h % 64 bucket, round(sum((1 + ln(tf)) * CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END), 9) w FROM t GROUP BY pid, h % 64)
SELECT pid, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY pid)), 6) AS value FROM s WHERE w <> 0""",
    "masked_mean_pool": """SELECT vec_id, round(list_sum(list_transform(generate_series(0, vec_id % 4), lambda i: CAST(embedding[i * 16 + 1] AS DOUBLE))) / (vec_id % 4 + 1), 6) AS first,
  round(list_sum(list_transform(generate_series(0, vec_id % 4), lambda i: CAST(embedding[i * 16 + 16] AS DOUBLE))) / (vec_id % 4 + 1), 6) AS last FROM embeddings""",
    "corpus_fingerprint": f"""WITH e AS (SELECT sha256(passage_id || chr(0) || coalesce(text, '') || chr(1)) h FROM {PASSAGES}), x AS (SELECT {', '.join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {15 * i + 1}, 15)) AS BIGINT)), 0) AS VARCHAR) s{i}" for i in range(4))}, count(*) n FROM e)
SELECT sha256(s0 || '|' || s1 || '|' || s2 || '|' || s3 || '|' || n) AS fingerprint, n FROM x""",
    "fuse_rrf": f"WITH {_R}, s AS (SELECT *, round({_VOTES}, 9) score FROM {_PAIR}) {_BEST}",
    "fuse_rrf_many": f"WITH {_R}, s AS (SELECT qid, pid, round(sum(1.0 / (60 + rank)), 9) score, min(rank) lr, 0 er FROM r GROUP BY qid, pid) {_BEST}",
    "fuse_weighted_minmax": _weighted("minmax"),
    "fuse_weighted_zscore": _weighted("zscore"),
    "fuse_rrf_script_aware": _aware(False),
    "fuse_rrf_observed_votes": _aware(True),
    "fusion_example": f"""WITH {_R}, s AS (SELECT x.*, CASE WHEN coalesce(q, 'unknown') IN ('mixed', 'unknown') OR coalesce(p, 'unknown') = coalesce(q, 'unknown') THEN 2 ELSE 1 END lists, round({_VOTES} * 2 / (CASE WHEN coalesce(q, 'unknown') IN ('mixed', 'unknown') OR coalesce(p, 'unknown') = coalesce(q, 'unknown') THEN 2 ELSE 1 END), 9) score FROM {_PAIR} x LEFT JOIN {_PS} USING (pid) LEFT JOIN {_QS} USING (qid))
SELECT qid, pid, rank, score, coalesce(lr, 0) AS lexical_rank, coalesce(er, 0) AS dense_rank, round(coalesce(1.0 / (60 + lr), 0.0), 9) AS lexical_vote, round(coalesce(1.0 / (60 + er), 0.0), 9) AS dense_vote, CAST(lists AS BIGINT) AS lists FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lr NULLS LAST, er NULLS LAST, pid) rank FROM s) WHERE rank <= 10""",
    "retrieval_outcomes": f"SELECT * FROM {_outcomes()}",
    "retrieval_by_slice": f"""WITH x AS (SELECT system, o.recall_5, o.rr, o.ndcg_10,
  (CASE query_lang WHEN 'en' THEN 'EN' WHEN 'hi' THEN 'HI' WHEN 'hinglish' THEN 'Hing' ELSE '?' END) || '->' || CASE WHEN answerable THEN upper(coalesce(passage_lang, '')) ELSE 'UNANS' END slice_key,
  CASE WHEN query_lang = 'hinglish' THEN 'code-mixed' WHEN coalesce(passage_lang, '') = '' THEN 'unknown' WHEN query_lang = passage_lang THEN 'monolingual' ELSE 'cross-lingual' END language_group
  FROM {_outcomes()} o JOIN {ITEMS} i ON i.id = o.qid)
SELECT system, coalesce(slice_key, language_group, 'all') AS slice, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(rr), 6) AS rr, round(avg(ndcg_10), 6) AS ndcg_10
FROM x GROUP BY GROUPING SETS ((system, slice_key), (system, language_group), (system))""",
    "alpha_sweep": f"""WITH {_R}, b AS (SELECT * FROM {_JOIN.format(l=_norm('bm25', 'minmax'), e=_norm('dense', 'minmax'))}),
s AS (SELECT qid, pid, lr, er, t, round(t / 10.0 * coalesce(ln, 0.0) + (1 - t / 10.0) * coalesce(en, 0.0), 9) score FROM b, (SELECT CAST(unnest(generate_series(0, 10)) AS DOUBLE) t)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, t ORDER BY score DESC, lr NULLS LAST, er NULLS LAST, pid) rank FROM s) WHERE rank <= 5),
o AS (SELECT t, qid, round(count(*) FILTER (list_contains(gold_passage_ids, pid)) / CAST(any_value(len(list_distinct(gold_passage_ids))) AS DOUBLE), 6) recall FROM top JOIN {ITEMS} i ON i.id = qid WHERE answerable AND len(gold_passage_ids) > 0 GROUP BY t, qid)
SELECT t / 10.0 AS alpha, round(avg(recall), 6) AS recall_5, count(*) AS n FROM o GROUP BY t""",
    "bootstrap_ci": f"""WITH v AS (SELECT system, recall_5 AS val, {_SEED} AS h FROM {_outcomes()}), u AS (SELECT system, val, rep, {_BITS.format(step='rep')} AS bits FROM v, (SELECT unnest(generate_series(0, 999)) rep)),
t AS (SELECT system, val, rep, {' + '.join(f'CAST(bits >= {int(p * (1 << 53))} AS INT)' for p in metrics.POISSON)} AS times FROM u),
m AS (SELECT system, rep, round(sum(val * times) / greatest(sum(times), 1.0), 9) m FROM t GROUP BY system, rep), e AS (SELECT system, list(m ORDER BY m) ms FROM m GROUP BY system)
SELECT system, round(avg(val), 6) AS mean, round(any_value(ms)[25], 6) AS lo, round(any_value(ms)[976], 6) AS hi, count(*) AS n FROM v JOIN e USING (system) GROUP BY system""",
    "paired_randomization": f"""WITH o AS (SELECT * FROM {_outcomes()}), d AS (SELECT a.qid, a.recall_5 - b.recall_5 d FROM o a JOIN o b USING (qid) WHERE a.system = 'dense' AND b.system = 'bm25'),
st AS (SELECT count(*) n, avg(d) observed FROM d), u AS (SELECT d, w, {_BITS.format(step='w')} AS bits FROM (SELECT d, {_SEED} AS h FROM d WHERE d <> 0), (SELECT unnest(generate_series(0, 199)) w)),
sums AS (SELECT w, i, sum(d * CASE WHEN (bits >> i) & 1 = 0 THEN 1 ELSE -1 END) s FROM (SELECT d, w, CAST(bits AS BIGINT) bits, CAST(unnest(generate_series(0, 49)) AS INT) i FROM u) GROUP BY w, i)
SELECT any_value(n) AS n, round(any_value(observed), 6) AS difference, round((count(*) FILTER (abs(s / n) >= abs(observed) - 1e-12) + 1) / 10001.0, 6) AS p_value FROM sums, st""",
    "score_skew": f"SELECT method_name, count(*) AS n, round(skewness(score), 4) AS skew FROM {RANKED} WHERE score IS NOT NULL GROUP BY method_name",
    "observed_vote_fires": f"""WITH {_R} SELECT q AS script, count(*) AS hits, count(*) FILTER (q NOT IN ('mixed', 'unknown') AND coalesce(p, 'unknown') <> q) AS fires
FROM (SELECT * FROM r WHERE m = 'bm25') LEFT JOIN {_PS} USING (pid) JOIN {_QS} USING (qid) GROUP BY q""",
}
