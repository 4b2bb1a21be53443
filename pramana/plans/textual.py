"""Queries of normalization, script, language, tokenization and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.operators.lexical import LexicalIndex, amount_tokens
from pramana.plans import sqltext as S
from pramana.plans.base import ITEMS, PASSAGES, QUESTIONS, items, passages, questions
from pramana.session import table


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


def canonical_amounts(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).select("passage_id", F.array_join(T.canonical_amounts(F.coalesce("text", F.lit(""))), "|").alias("amounts"))


def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = passages(spark, d).select("passage_id", T.split_sentences(F.col("text")).alias("s"))
    return t.select("passage_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "~")).alias("digest"))


def script_of(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", T.script_of(F.col("question")).alias("script"))


def langid_classify(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", T.classify_language(F.col("question")).alias("c")).select("id", "c.query_type", "c.script", "c.lang", F.round("c.ratio", 6).alias("ratio"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    t = passages(spark, d).select("passage_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("passage_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", "|").alias("terms"))


def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", T.normalize_answer(F.col("answer_gold")).alias("answer"))


def integrity_validate(spark: SparkSession, d: str) -> DataFrame:
    """Checks of Hindi passages."""
    x = passages(spark, d).where("lang = 'hi'").select("passage_id", T.integrity(F.col("text")).alias("i"))
    return x.select("passage_id", "i.n_chars", "i.ratio", "i.matra_rate", "i.virama_rate", "i.stopword_rate", F.array_join("i.failures", "|").alias("failures"))


def integrity_other(spark: SparkSession, d: str) -> DataFrame:
    """Checks of passages in other languages, of which no Hindi is expected."""
    x = passages(spark, d).where("lang <> 'hi'").select("passage_id", T.integrity(F.col("text"), expect_hindi=False).alias("i"))
    return x.select("passage_id", "i.n_chars", F.array_join("i.failures", "|").alias("failures"))


def misplaced_matras(spark: SparkSession, d: str) -> DataFrame:
    """Where vowel signs stand wrong in documents."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(T.misplaced_matra_places(F.col("text"))).alias("p"))
    return x.select("doc_id", F.col("p.pos").cast("bigint").alias("pos"), F.md5("p.near").alias("near"))


def marker_hits(spark: SparkSession, d: str) -> DataFrame:
    """Words of questions that tell their language: of romanized Hindi, of both, of English."""
    c = T.classify_language(F.col("question"))
    return items(spark, d).select("id", c["hindi_hits"].alias("hindi"), c["ambiguous_hits"].alias("ambiguous"), c["english_hits"].alias("english"), T.is_code_mixed(F.col("question")).alias("code_mixed"))


def lexical_postings(spark: SparkSession, d: str) -> DataFrame:
    return LexicalIndex(passages(spark, d)).terms.select("pid", "term", "tf", F.col("len").cast("bigint").alias("len"))


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return LexicalIndex(passages(spark, d)).df


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return LexicalIndex(passages(spark, d)).bm25(items(spark, d))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return LexicalIndex(passages(spark, d)).tfidf(questions(spark, d))


def bm25_amount_tokens(spark: SparkSession, d: str) -> DataFrame:
    return LexicalIndex(passages(spark, d), extra_tokens=amount_tokens).bm25(items(spark, d), extra_tokens=amount_tokens)


QUERIES = [normalize_text, canonical_amounts, split_sentences, script_of, langid_classify, tokenize_terms, normalize_answer, integrity_validate, integrity_other, misplaced_matras, marker_hits, lexical_postings, term_df, bm25_topk, tfidf_topk, bm25_amount_tokens]


def _index(tokens_of, questions: str = QUESTIONS) -> str:
    return f"""
docs AS (SELECT passage_id pid, {tokens_of('text')} tokens FROM {PASSAGES}),
terms AS (SELECT pid, term, count(*) tf, any_value(len) len FROM (SELECT pid, len(tokens) len, unnest(tokens) term FROM docs) GROUP BY pid, term),
dfs AS (SELECT term, count(*) df FROM terms GROUP BY term),
stats AS (SELECT count(*) n, avg(len(tokens)) avg_len FROM docs),
asked AS (SELECT id qid, term, count(*) qtf FROM (SELECT id, unnest({tokens_of('question')}) term FROM {questions}) GROUP BY id, term)"""


_TOP = "SELECT qid, pid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) rank FROM scores WHERE score > 0) WHERE rank <= 10"


def _bm25(tokens_of) -> str:
    return f"""WITH {_index(tokens_of, ITEMS)},
scores AS (SELECT qid, pid, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) score
  FROM asked JOIN terms USING (term) JOIN dfs USING (term), stats GROUP BY qid, pid) {_TOP}"""


_AMT = lambda x: f"list_concat({S.tokenize(x)}, list_transform({S.canonical_amounts(f'coalesce({x}, chr(32))')}, lambda a: 'amt' || a))"
_T = S.normalize_unicode("coalesce(text, '')")
_KIND = "(SELECT id, {0} k, {1} ratio FROM {2})".format(S.language_kind("question"), S.letter_devanagari_ratio(S.strip("coalesce(question, '')")), ITEMS)

ORACLES = {
    "normalize_text": f"SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, {S.normalize_text('text')} t FROM documents)",
    "canonical_amounts": f"SELECT passage_id, array_to_string({S.canonical_amounts("coalesce(text, '')")}, '|') AS amounts FROM {PASSAGES}",
    "split_sentences": f"SELECT passage_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '~')) AS digest FROM (SELECT passage_id, {S.split_sentences('text')} s FROM {PASSAGES})",
    "script_of": f"SELECT id, {S.script_of('question')} AS script FROM {ITEMS}",
    "langid_classify": f"SELECT id, {S.QUERY_TYPE.format(k='k')} AS query_type, {S.QUERY_SCRIPT.format(k='k')} AS script, {S.QUERY_LANG.format(k='k')} AS lang, round(ratio, 6) AS ratio FROM {_KIND}",
    "tokenize_terms": f"SELECT passage_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, '|') AS terms FROM (SELECT passage_id, {S.tokenize('text')} t FROM {PASSAGES})",
    "normalize_answer": f"SELECT id, {S.normalize_answer('answer_gold')} AS answer FROM {ITEMS}",
    "integrity_validate": f"""
WITH x AS (SELECT passage_id, {_T} t FROM {PASSAGES} WHERE lang = 'hi'),
y AS (SELECT passage_id, CAST({S.count('t', f'[{S.SPACE}]')} AS BIGINT) n_chars, round({S.devanagari_ratio('t')}, 6) ratio,
  round(len(list_filter(generate_series(1, length(t)), lambda i: regexp_matches(substr(t, i, 1), '[\\x{{093A}}-\\x{{094C}}]') AND NOT (i > 1 AND regexp_matches(substr(t, i - 1, 1), '[\\x{{0915}}-\\x{{0939}}\\x{{0958}}-\\x{{095F}}\\x{{093A}}-\\x{{094C}}]')))) / CAST(greatest(length({S.sub('t', f'[^{S.DEVA}]')}), 1) AS DOUBLE), 6) matra_rate,
  round(len(list_filter({S.hindi_words('t')}, lambda w: ends_with(w, '्'))) / CAST(greatest(len({S.hindi_words('t')}), 1) AS DOUBLE), 6) virama_rate,
  round({S.stopword_rate('t')}, 6) stopword_rate, len({S.hindi_words('t')}) words, length(t) - length(replace(t, '�', '')) replaced FROM x)
SELECT passage_id, n_chars, ratio, matra_rate, virama_rate, stopword_rate, array_to_string(list_filter([CASE WHEN n_chars < 40 THEN 'too_short' END, CASE WHEN replaced > 0 THEN 'replacement_chars' END,
  CASE WHEN ratio < 0.45 THEN 'low_devanagari_ratio' END, CASE WHEN matra_rate > 0.005 THEN 'misplaced_matras' END, CASE WHEN virama_rate > 0.02 THEN 'dangling_viramas' END,
  CASE WHEN stopword_rate < 0.05 AND words >= 20 THEN 'low_stopword_rate' END], lambda f: f IS NOT NULL), '|') AS failures FROM y""",
    "integrity_other": f"""SELECT passage_id, n_chars, array_to_string(list_filter([CASE WHEN n_chars < 40 THEN 'too_short' END, CASE WHEN contains(t, chr(65533)) THEN 'replacement_chars' END], lambda f: f IS NOT NULL), '|') AS failures FROM (SELECT passage_id, t, CAST({S.count('t', f'[{S.SPACE}]')} AS BIGINT) n_chars FROM (SELECT passage_id, {_T} t FROM {PASSAGES} WHERE lang <> 'hi'))""",
    "misplaced_matras": """SELECT doc_id, i - 1 AS pos, md5(substr(text, greatest(i - 6, 1), i + 6 - greatest(i - 6, 1) + 1)) AS near FROM (SELECT doc_id, text, unnest(generate_series(1, length(text))) i FROM documents WHERE regexp_matches(text, '[\\x{093A}-\\x{094C}]')) WHERE regexp_matches(substr(text, i, 1), '[\\x{093A}-\\x{094C}]') AND NOT (i > 1 AND regexp_matches(substr(text, i - 1, 1), '[\\x{0915}-\\x{0939}\\x{0958}-\\x{095F}\\x{093A}-\\x{094C}]'))""",
    "marker_hits": f"""SELECT id, len(list_filter(w, lambda x: list_contains({S.words(T.UNAMBIGUOUS_MARKERS)}, x))) AS hindi, len(list_filter(w, lambda x: list_contains({S.words(T.AMBIGUOUS_MARKERS)}, x))) AS ambiguous, len(list_filter(w, lambda x: list_contains({S.words(T.ENGLISH_MARKERS)}, x))) AS english, k IN ('mixed', 'roman') AS code_mixed
FROM (SELECT id, {S.language_kind('question')} k, list_transform(regexp_extract_all({S.strip("coalesce(question, '')")}, {S.q(f'[a-zA-Z{S.DEVA}]+')}), lambda w: lower(w)) w FROM {ITEMS})""",
    "lexical_postings": f"WITH {_index(S.tokenize)} SELECT pid, term, tf, CAST(len AS BIGINT) AS len FROM terms",
    "term_df": f"WITH {_index(S.tokenize)} SELECT term, df FROM dfs",
    "bm25_topk": _bm25(S.tokenize),
    "bm25_amount_tokens": _bm25(_AMT),
    "tfidf_topk": f"""WITH {_index(S.tokenize)},
q AS (SELECT qid, term, (1 + ln(qtf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) qw FROM asked LEFT JOIN dfs USING (term), stats),
dv AS (SELECT pid, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) dw FROM terms JOIN dfs USING (term), stats),
qn AS (SELECT qid, sqrt(sum(qw * qw)) qnorm FROM q GROUP BY qid), dn AS (SELECT pid, sqrt(sum(dw * dw)) dnorm FROM dv GROUP BY pid),
scores AS (SELECT qid, pid, round(dot / (qnorm * dnorm), 6) score FROM (SELECT qid, pid, sum(qw * dw) dot FROM q JOIN dv USING (term) GROUP BY qid, pid) JOIN qn USING (qid) JOIN dn USING (pid)) {_TOP}""",
}
