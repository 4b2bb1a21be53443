"""Queries of building and checking question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.functions import translit as L
from pramana.functions.translit import romanize_question
from pramana.operators import dataset as D
from pramana.operators import generation as G
from pramana.operators import review as V
from pramana.operators.answers import rouge_l_precision
from pramana.operators.running import medians
from pramana.operators.topk import hash_order, hash_order_sql
from pramana.plans import sqltext as S
from pramana.plans.base import ITEMS, PASSAGES, RANKED, items, passages, ranked_runs
from pramana.session import cut, table


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    """60 English passages of at least 70 words, schemes in turns, those with digits first."""
    x = passages(spark, d).where((F.col("lang") == "en") & (T.count_tokens(F.col("text")) >= 70))
    return D.round_robin(x, "scheme", "passage_id", 60, first=F.when(F.col("text").rlike("[0-9]"), 0).otherwise(1)).select("passage_id", "scheme")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d).where("verified").where(~V.is_rejected(F.col("notes"))).select("id", "query_lang", "answerable", "scheme")
    return D.stratified_split(x, ["query_lang", "answerable", "scheme"], "id", 120).select("id", "part")


def stratified_by_class(spark: SparkSession, d: str) -> DataFrame:
    """60 items, answerable ones and each class of the others by their shares."""
    x = items(spark, d).select("id", F.when(F.col("answerable"), "answerable").otherwise(F.coalesce("unanswerable_class", F.lit("other"))).alias("class"))
    return D.shared_out(x, "class", "id", 60)


def second_pass_sample(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d).where("verified").where(~V.is_rejected(F.col("notes"))).select("id", F.when(F.col("answerable"), "answerable").otherwise(F.coalesce("unanswerable_class", F.lit("other"))).alias("class"))
    return D.sample_by_class(x, "class", "id", 0.15)


def enriched_sample(spark: SparkSession, d: str) -> DataFrame:
    """All unanswerable items of the test split and as many answerable ones as make three times their number."""
    x = items(spark, d).where(F.lower(F.trim("split")) == "test").select("id", "answerable")
    n = x.where("not answerable").count()
    fill = x.where("answerable").orderBy(hash_order(F.col("id"), D.SEED), "id").limit(2 * n)
    return x.where("not answerable").unionByName(fill)


def coverage_vs_target(spark: SparkSession, d: str) -> DataFrame:
    """Items wanted and had: by languages of question and evidence, unanswerable ones by class; rejected ones don't count."""
    return D.coverage(items(spark, d).where(~V.is_rejected(F.col("notes"))))


def duplicate_questions(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_questions(items(spark, d))


def probe_fragment(spark: SparkSession, d: str) -> DataFrame:
    """Ten words in a row of every passage of at least 30 words, from a place chosen by hash."""
    w = F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")
    x = passages(spark, d).withColumn("w", w).where("size(w) >= 30")
    start = (hash_order(F.col("passage_id"), D.SEED) % (F.size("w") - 9)).cast("int") + 1
    return x.select("passage_id", F.array_join(F.slice("w", start, 10), " ").alias("question"))


def probe_entity(spark: SparkSession, d: str) -> DataFrame:
    """A question for each scheme, language and section, and how many passages answer it."""
    leaf = F.element_at(F.split("section_path", " > "), -1)
    x = passages(spark, d).where("section_path is not null and section_path <> 'Introduction'").withColumn("leaf", leaf)
    return x.groupBy("scheme", "lang", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("passage_id").alias("first")).select(F.concat("scheme", F.lit(": "), "leaf", F.lit("?")).alias("question"), "lang", "n", "first")


def probe_crosslang(spark: SparkSession, d: str) -> DataFrame:
    """For each English passage how many Hindi ones of its scheme are gold for it."""
    p = passages(spark, d)
    hindi = p.where("lang = 'hi'").groupBy("scheme").agg(F.count(F.lit(1)).alias("gold"))
    return p.where("lang = 'en'").select("passage_id", "scheme").join(hindi, "scheme").select("passage_id", "gold")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d).where("answerable").select("id", "query_lang", "passage_lang", T.tokenize(F.col("question")).alias("q"), F.explode("gold_passage_ids").alias("passage_id"))
    p = passages(spark, d).select("passage_id", T.tokenize(F.col("text")).alias("p"))
    return x.join(p, "passage_id").select("id", "passage_id", "query_lang", "passage_lang", F.round(D.token_overlap(F.col("q"), F.col("p")), 6).alias("overlap"))


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("id", "passage_id", "overlap")


def leakage_by_cell(spark: SparkSession, d: str) -> DataFrame:
    """By languages of question and evidence how much of the evidence stands in the question, and in how many it is over 0.2."""
    x = cut(_overlaps(spark, d).withColumn("cell", F.concat_ws(">", F.coalesce("query_lang", F.lit("?")), F.coalesce("passage_lang", F.lit("?")))))
    g = x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overlap"), 5).alias("mean"), F.max("overlap").alias("max"), F.count_if(F.col("overlap") > 0.2).alias("high"))
    return g.join(medians(x, "cell", "overlap"), "cell").select("cell", "n", "mean", F.round("median", 6).alias("median"), "max", "high")


def merge_dedupe_renumber(spark: SparkSession, d: str) -> DataFrame:
    """The sources of the items as files in order of precedence, merged by their sorted gold ids."""
    x = items(spark, d).where("answerable").select("id", "query_lang", "passage_lang", "gold_passage_ids", F.when(F.col("source") == "hand", 0).when(F.col("source") == "bootstrapped", 1).otherwise(2).alias("source_rank"))
    return D.merge_dedupe_renumber(x, F.array_join(F.array_sort("gold_passage_ids"), "|"), ["query_lang", "passage_lang"]).select("id", "new_id")


def blind_view(spark: SparkSession, d: str) -> DataFrame:
    """Five passages to judge a question by: its gold ones, then those found, shuffled."""
    found = ranked_runs(spark, d).where("method_name = 'script_aware' and rank <= 5").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda x: x["passage_id"]).alias("found"))
    x = items(spark, d).join(found, F.col("id") == F.col("query_id"))
    five = F.slice(F.array_distinct(F.concat("gold_passage_ids", "found")), 1, 5)
    shuffled = F.transform(F.array_sort(F.transform(five, lambda p: F.struct(F.md5(F.concat_ws("|", F.lit(str(D.SEED)), F.col("id"), p)).alias("h"), p.alias("p")))), lambda s: s["p"])
    return x.select("id", F.array_join(shuffled, ",").alias("evidence"))


def answer_provenance(spark: SparkSession, d: str) -> DataFrame:
    """How gold answers come from their evidence: verbatim, near (0.8 of their words in order), rewrite or no_evidence."""
    x = items(spark, d).where("answerable and answer_gold <> ''").select("id", "answer_gold", F.explode_outer("gold_passage_ids").alias("passage_id"))
    y = x.join(passages(spark, d).select("passage_id", "text"), "passage_id", "left").withColumns({"a": T.normalize_answer(F.col("answer_gold")), "t": T.normalize_answer(F.col("text")), "r": rouge_l_precision(F.col("answer_gold"), F.col("text"))})
    g = y.groupBy("id").agg(F.max(F.col("text").isNotNull()).alias("there"), F.max(F.coalesce(F.contains("t", "a"), F.lit(False))).alias("verbatim"), F.max("r").alias("r"))
    kind = F.when(~F.col("there"), "no_evidence").when(F.col("verbatim"), "verbatim").when(F.col("r") >= 0.8, "near").otherwise("rewrite")
    return g.groupBy(kind.alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


def error_categories(spark: SparkSession, d: str) -> DataFrame:
    i, p = items(spark, d), passages(spark, d)
    gold = i.select("id", F.explode("gold_passage_ids").alias("passage_id")).join(p.select("passage_id", F.col("scheme").alias("s"), F.lower(F.element_at(F.split(F.coalesce("section_path", F.lit("")), " > "), -1)).alias("leaf")), "passage_id").groupBy("id").agg(F.collect_set("s").alias("schemes"), F.collect_set("leaf").alias("sections"))
    sizes = p.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"))
    return D.error_categories(i.select("id", "question", "query_lang", "passage_lang", "scheme"), gold, sizes)


def recovery_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of the answerable questions whose gold the lexical list misses at 5, how many each other list has."""
    hits = ranked_runs(spark, d).where("rank <= 5").join(items(spark, d).where("answerable").select(F.col("id").alias("query_id"), "gold_passage_ids"), "query_id")
    x = hits.groupBy("query_id", "method_name").agg(F.max(F.array_contains("gold_passage_ids", F.col("passage_id"))).alias("hit"))
    lost = x.where("method_name = 'bm25' and not hit").select("query_id")
    return x.where("method_name <> 'bm25'").join(lost, "query_id").groupBy("method_name").agg(F.count(F.lit(1)).alias("lost"), F.count_if("hit").alias("recovered"))


def verification_label(spark: SparkSession, d: str) -> DataFrame:
    """By split: items, verified ones, and by whom."""
    model = F.lower(F.coalesce("annotator", F.lit(""))).startswith("model:")
    g = items(spark, d).groupBy(F.coalesce(F.lower(F.trim("split")), F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified"), F.count_if(F.col("verified") & model).alias("by_model"))
    label = F.when(F.col("verified") == 0, "UNVERIFIED").when(F.col("verified") < F.col("n"), "partly verified").when(F.col("by_model") == F.col("n"), "verified by a model").when(F.col("by_model") == 0, "verified by a person").otherwise("verified by persons and models")
    return g.withColumn("label", label)


def review_findings(spark: SparkSession, d: str) -> DataFrame:
    """Mechanical findings on items, ten kinds."""
    return V.review(items(spark, d).select("id", "question", "query_lang", "answerable", "gold_passage_ids", "answer_gold", "answer_gold_hi"), passages(spark, d))


def error_cases(spark: SparkSession, d: str) -> DataFrame:
    """Failures of the lexical list to tell of, two a category, with what went wrong."""
    listed = ranked_runs(spark, d).where("method_name = 'bm25'").select(F.col("query_id").alias("id"), F.col("passage_id").alias("pid"), "score", "rank")
    gold = items(spark, d).where("answerable and size(gold_passage_ids) > 0").select("id", "gold_passage_ids")
    at = listed.join(gold, "id").groupBy("id").agg(F.min(F.when(F.array_contains("gold_passage_ids", F.col("pid")), F.col("rank"))).alias("gold_rank"), F.max(F.when(F.col("rank") == 1, F.coalesce("score", F.lit(0.0)))).alias("confidence"), F.max(F.when(F.col("rank") == 1, F.col("pid"))).alias("hit"), F.first(F.get("gold_passage_ids", F.lit(0))).alias("gold"))
    failed = cut(at.where("gold_rank is null or gold_rank > 5"))
    cases = V.error_cases(failed.select("id", "confidence"), error_categories(spark, d))
    p = passages(spark, d).select("passage_id", "scheme", "lang")
    side = lambda n: p.select(F.col("passage_id").alias(n), F.col("scheme").alias(f"{n}_scheme"), F.col("lang").alias(f"{n}_lang"))
    x = F.broadcast(cases).join(failed, "id").join(side("hit"), "hit", "left").join(side("gold"), "gold", "left")
    why = V.diagnosis(F.col("gold_rank"), (F.col("hit_scheme"), F.col("hit_lang")), (F.col("gold_scheme"), F.col("gold_lang")))
    return x.select("category", "id", F.col("place").cast("bigint").alias("place"), F.round("confidence", 6).alias("confidence"), F.coalesce("gold_rank", F.lit(0)).cast("bigint").alias("gold_rank"), why.alias("diagnosis"))


def annotation_progress(spark: SparkSession, d: str) -> DataFrame:
    return V.progress(items(spark, d))


def reviewed_items(spark: SparkSession, d: str) -> DataFrame:
    """Findings with notes on every tenth item, and what a note suggests taken over."""
    i = items(spark, d)
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    notes = i.where(n % 10 == 0).select("id", F.when(n % 20 == 0, "fix").otherwise("accept").alias("verdict"), F.array(F.lit("wording")).alias("issues"), F.when(n % 20 == 0, F.concat(F.lit(" "), F.trim("question"), F.lit(" (checked) "))).alias("suggested_question"), F.lit("").alias("suggested_answer"), F.lit(None).cast("string").alias("suggested_answer_hi"))
    merged = V.merge_notes(i, review_findings(spark, d), notes, reviewed_by="reader")
    taken = V.take_suggestions(i.select("id", "question", "answer_gold", "answer_gold_hi"), notes)
    return merged.join(taken, "id").select("id", F.array_join("rules", ",").alias("rules"), "verdict", "reviewed_by", F.array_join("changed", ",").alias("changed"), F.md5("question").alias("question"))


def check_translation(spark: SparkSession, d: str) -> DataFrame:
    """The Hindi gold answers as translations of the others."""
    x = items(spark, d).where("answer_gold is not null and answer_gold_hi is not null")
    return x.select("id", G.check_translation(F.col("answer_gold"), F.col("answer_gold_hi"), F.lit("hi")).alias("reason"))


def check_base(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers as candidates made of their first gold passage."""
    x = items(spark, d).where("answerable").select("id", "question", "answer_gold", F.get("gold_passage_ids", F.lit(0)).alias("passage_id")).join(passages(spark, d), "passage_id")
    return x.select("id", G.check_base(F.col("question"), F.col("answer_gold"), F.col("text"), F.col("lang")).alias("reason"))


def romanize_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions with Devanagari in Latin letters, and why a romanization can't be taken."""
    x = items(spark, d).select("id", romanize_question(F.col("question")).alias("roman")).where("roman is not null")
    return x.select("id", F.md5("roman").alias("roman"), G.check_romanization(F.col("roman")).alias("reason"))


def build_unanswerable(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "schemes")
    titles = t.select("scheme", F.lit("en").alias("lang"), F.col("title_en").alias("title")).unionByName(t.select("scheme", F.lit("hi").alias("lang"), F.col("title_hi").alias("title")))
    return G.build_unanswerable(passages(spark, d), titles)


def title_map(spark: SparkSession, d: str) -> DataFrame:
    """The title of each scheme and language, of the document retrieved last."""
    x = table(spark, d, "source_docs").where("title is not null and trim(title) <> ''").withColumn("lang", F.regexp_extract("doc_id", "-([a-z]+)$", 1))
    return x.groupBy("scheme", "lang").agg(F.max(F.struct("retrieved_at", "doc_id", "title")).getField("title").alias("title"))


QUERIES = [round_robin_sample, stratified_split, stratified_by_class, second_pass_sample, enriched_sample, coverage_vs_target, duplicate_questions, probe_fragment, probe_entity, probe_crosslang, token_overlap, leakage_by_cell, merge_dedupe_renumber, blind_view, answer_provenance, error_categories, recovery_summary, verification_label, review_findings, error_cases, annotation_progress, reviewed_items, check_translation, check_base, romanize_questions, build_unanswerable, title_map]

_H = lambda key: hash_order_sql(key, D.SEED)
_BY_CLASS = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {h}, id) rn, count(*) OVER (PARTITION BY {g}) n FROM ({src})) WHERE rn <= greatest(1, round_even(round(n * {f}, 9), 0))"
_OV = f"""(SELECT id, passage_id, query_lang, passage_lang, round(CASE WHEN len(list_distinct(list_concat(q, p))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(q), list_distinct(p))) / CAST(len(list_distinct(list_concat(q, p))) AS DOUBLE) END, 6) overlap
 FROM (SELECT id, query_lang, passage_lang, {S.tokenize('question')} q, unnest(gold_passage_ids) passage_id FROM {ITEMS} WHERE answerable) JOIN (SELECT passage_id, {S.tokenize('text')} p FROM {PASSAGES}) USING (passage_id))"""

_W = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_{S.DEVA}]+')"
_LW = lambda x: f"list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z{S.DEVA}]+'), lambda w: lower(w)))"
_COVER = lambda w: f"CASE WHEN len({w}) > 0 THEN len(list_filter({w}, lambda t: list_contains(ew, t))) / CAST(len({w}) AS DOUBLE) ELSE 0.0 END"
_COUNT = lambda a, ch: f"(length({a}) - length(replace({a}, {S.q(ch)}, '')))"
_CUT = lambda a: f"({_COUNT(a, '(')} <> {_COUNT(a, ')')} OR {_COUNT(a, chr(34))} % 2 = 1 OR lower(regexp_extract(regexp_replace({a}, '[ .,;:।]+$', ''), '([^\\s]+)$', 1)) IN ({', '.join(map(S.q, V.DANGLING))}))"


def _roman(x: str) -> str:
    """The steps of functions.translit.to_roman."""
    t = x
    for i, base in enumerate("कखगजडढफय"):
        t = f"replace({t}, {S.q(chr(0x958 + i))}, {S.q(base + L.NUKTA)})"
    kept = sorted(L.KEPT)
    for i, w in enumerate(kept):
        t = f"regexp_replace({t}, {S.q(f'(^|[^{S.DEVA}]){w}([^{S.DEVA}]|$)')}, {S.q(chr(92) + '1' + chr(0xE000 + i) + chr(92) + '2')}, 'g')"
    t = f"regexp_replace({t}, {S.q(f'([क-ह]{L.NUKTA}?)')}, {S.q(chr(92) + '1' + L.INHERENT)}, 'g')"
    t = f"regexp_replace({t}, {S.q(L.INHERENT + '([' + chr(0x93E) + '-' + chr(0x94D) + '])')}, {S.q(chr(92) + '1')}, 'g')"
    for of in (L.DOTTED, L.CONSONANTS, L.SIGNS, L.VOWELS, L.MARKS, {L.VIRAMA: "", L.NUKTA: "", L.INHERENT: "a"}, {c: str(i) for i, c in enumerate("०१२३४५६७८९")}):
        for a, b in of.items():
            t = f"replace({t}, {S.q(a)}, {S.q(b)})"
    t = f"lower(replace(regexp_replace({t}, '([A-Za-z]{{2,}})a([^A-Za-z]|$)', {S.q(chr(92) + '1' + chr(92) + '2')}, 'g'), 'M', 'n'))"
    for i, w in enumerate(kept):
        t = f"replace({t}, {S.q(chr(0xE000 + i))}, {S.q(L.KEPT[w])})"
    return t


ORACLES = {
    "round_robin_sample": f"SELECT passage_id, scheme FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY CASE WHEN regexp_matches(text, '[0-9]') THEN 0 ELSE 1 END, {_H('passage_id')}, passage_id) rn FROM {PASSAGES} WHERE lang = 'en' AND {S.count_tokens('text')} >= 70) ORDER BY rn, {_H('scheme')}, scheme LIMIT 60",
    "stratified_split": f"""WITH x AS (SELECT id, query_lang, answerable, scheme FROM {ITEMS} WHERE verified AND NOT starts_with(coalesce(notes, ''), 'REJECTED')), c AS (SELECT query_lang, answerable, scheme, count(*) n, count(*) * CAST(120 AS DOUBLE) / (SELECT count(*) FROM x) sh FROM x GROUP BY 1, 2, 3),
b AS (SELECT *, floor(round(CAST(sh AS DOUBLE), 9)) base, round(CAST(sh AS DOUBLE) - floor(round(CAST(sh AS DOUBLE), 9)), 9) rest FROM c),
qt AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, query_lang NULLS FIRST, answerable, scheme NULLS FIRST) <= 120 - sum(base) OVER () THEN 1 ELSE 0 END quota FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_lang, answerable, scheme ORDER BY {_H('id')}, id) rn FROM x)
SELECT id, CASE WHEN rn <= quota THEN 'dev' ELSE 'test' END AS part FROM r JOIN qt ON r.query_lang IS NOT DISTINCT FROM qt.query_lang AND r.answerable = qt.answerable AND r.scheme IS NOT DISTINCT FROM qt.scheme""",
    "stratified_by_class": f"SELECT id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_H('id')}, id) rn, count(*) OVER (PARTITION BY class) n, count(*) OVER () al FROM (SELECT id, CASE WHEN answerable THEN 'answerable' ELSE coalesce(unanswerable_class, 'other') END class FROM {ITEMS})) WHERE rn <= greatest(1, round_even(round(n * (CAST(60 AS DOUBLE) / al), 9), 0))",
    "second_pass_sample": _BY_CLASS.format(cols="id, class", g="class", h=_H("id"), src=f"SELECT id, CASE WHEN answerable THEN 'answerable' ELSE coalesce(unanswerable_class, 'other') END class FROM {ITEMS} WHERE verified AND NOT starts_with(coalesce(notes, ''), 'REJECTED')", f=0.15),
    "enriched_sample": f"WITH x AS (SELECT id, answerable FROM {ITEMS} WHERE lower(trim(split)) = 'test') SELECT * FROM x WHERE NOT answerable UNION ALL (SELECT * FROM x WHERE answerable QUALIFY row_number() OVER (ORDER BY {_H('id')}, id) <= (SELECT 2 * count(*) FROM x WHERE NOT answerable))",
    "coverage_vs_target": f"""WITH i AS (SELECT * FROM {ITEMS} WHERE NOT starts_with(coalesce(notes, ''), 'REJECTED'))
SELECT q || '->' || p AS cell, CAST(t AS BIGINT) AS target, (SELECT count(*) FROM i WHERE answerable AND query_lang = q AND passage_lang = p) AS have FROM (VALUES {', '.join(str(x) for x in D.QUOTAS)}) v(q, p, t)
UNION ALL SELECT c AS cell, CAST(t AS BIGINT) AS target, (SELECT count(*) FROM i WHERE NOT answerable AND unanswerable_class = c) AS have FROM (VALUES {', '.join(str(x) for x in D.CLASS_QUOTAS)}) v(c, t)""",
    "duplicate_questions": f"SELECT norm_hash, count(*) AS n, min(id) AS first_id FROM (SELECT id, md5({S.normalize_answer('question')}) norm_hash FROM {ITEMS}) GROUP BY 1 HAVING count(*) > 1",
    "probe_fragment": f"SELECT passage_id, array_to_string(w[{_H('passage_id')} % (len(w) - 9) + 1 : {_H('passage_id')} % (len(w) - 9) + 10], ' ') AS question FROM (SELECT passage_id, list_filter(regexp_split_to_array(text, {S.q(f'[{S.SPACE}]+')}), lambda x: x <> '') w FROM {PASSAGES} WHERE text IS NOT NULL) WHERE len(w) >= 30",
    "probe_entity": f"SELECT scheme || ': ' || leaf || '?' AS question, lang, count(*) AS n, min(passage_id) AS first FROM (SELECT *, string_split(section_path, ' > ')[-1] leaf FROM {PASSAGES} WHERE section_path IS NOT NULL AND section_path <> 'Introduction') GROUP BY scheme, lang, leaf",
    "probe_crosslang": f"SELECT passage_id, gold FROM {PASSAGES} JOIN (SELECT scheme, count(*) gold FROM {PASSAGES} WHERE lang = 'hi' GROUP BY scheme) USING (scheme) WHERE lang = 'en'",
    "token_overlap": f"SELECT id, passage_id, overlap FROM {_OV}",
    "leakage_by_cell": f"SELECT coalesce(query_lang, '?') || '>' || coalesce(passage_lang, '?') AS cell, count(*) AS n, round(avg(overlap), 5) AS mean, round(median(overlap), 6) AS median, max(overlap) AS max, count(*) FILTER (overlap > 0.2) AS high FROM {_OV} GROUP BY 1",
    "merge_dedupe_renumber": f"""WITH x AS (SELECT id, query_lang, passage_lang, CASE source WHEN 'hand' THEN 0 WHEN 'bootstrapped' THEN 1 ELSE 2 END sr, array_to_string(list_sort(gold_passage_ids), '|') k FROM {ITEMS} WHERE answerable),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY sr, id) = 1)
SELECT id, coalesce(query_lang, 'none') || '-' || coalesce(passage_lang, 'none') || '-' || format('{{:03d}}', row_number() OVER (PARTITION BY query_lang, passage_lang ORDER BY sr, id) - 1) AS new_id FROM y""",
    "probe_count": "",
    "error_categories": f"""WITH k AS (SELECT id, {S.language_kind('question')} k FROM {ITEMS}), pp AS (SELECT passage_id, scheme s, lower(string_split(coalesce(section_path, ''), ' > ')[-1]) leaf FROM {PASSAGES}),
g AS (SELECT id, list(DISTINCT s) schemes, list(DISTINCT leaf) sections FROM (SELECT id, unnest(gold_passage_ids) passage_id FROM {ITEMS}) JOIN pp USING (passage_id) GROUP BY id), sz AS (SELECT scheme, count(*) n FROM {PASSAGES} GROUP BY scheme),
t AS (SELECT i.id, [CASE WHEN k IN ('mixed', 'roman') THEN 'code-mixing' END, CASE WHEN k = 'roman' THEN 'transliteration-variation' END, CASE WHEN coalesce(passage_lang, '') <> '' AND query_lang IS DISTINCT FROM passage_lang THEN 'cross-lingual-gap' END,
 CASE WHEN regexp_matches(question, {S.q(D.ENTITY)}) THEN 'named-entity' END, CASE WHEN len({S.canonical_amounts("coalesce(question, '')")}) > 0 THEN 'amount' END,
 CASE WHEN regexp_matches(question, '(?i)\\b(19|20)\\d{{2}}\\b|\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b|january|february|march|april|may|june|july|august|september|october|november|december|तिथि|वर्ष|माह|दिनांक') THEN 'date' END,
 CASE WHEN {S.count_tokens('question')} <= 5 THEN 'short-query' END, CASE WHEN {S.count_tokens('question')} <= 5 THEN 'ambiguity' END, CASE WHEN coalesce(i.scheme, '') <> '' AND coalesce(n, 0) <= 6 THEN 'long-tail-scheme' END,
 CASE WHEN len(schemes) = 1 AND len(list_intersect(sections, ['eligibility', 'benefits', 'features', 'पात्रता', 'लाभ'])) > 0 THEN 'near-duplicate-schemes' END] tags FROM {ITEMS} i JOIN k USING (id) LEFT JOIN g USING (id) LEFT JOIN sz USING (scheme))
SELECT id, unnest(CASE WHEN len(list_filter(tags, lambda x: x IS NOT NULL)) = 0 THEN ['ambiguity'] ELSE list_filter(tags, lambda x: x IS NOT NULL) END) AS category FROM t""",
    "recovery_summary": None,
    "verification_label": f"""WITH g AS (SELECT coalesce(lower(trim(split)), 'none') split, count(*) n, count(*) FILTER (verified) verified, count(*) FILTER (verified AND starts_with(lower(coalesce(annotator, '')), 'model:')) by_model FROM {ITEMS} GROUP BY 1)
SELECT *, CASE WHEN verified = 0 THEN 'UNVERIFIED' WHEN verified < n THEN 'partly verified' WHEN by_model = n THEN 'verified by a model' WHEN by_model = 0 THEN 'verified by a person' ELSE 'verified by persons and models' END AS label FROM g""",
    "review_findings": f"""WITH x AS (SELECT id, question, query_lang, answerable, coalesce(gold_passage_ids, []) gold, coalesce(answer_gold, '') a, coalesce(answer_gold_hi, '') b, {_W('question')} qw, {S.QUERY_LANG.format(k=f"({S.language_kind('question')})")} got FROM {ITEMS}),
ev AS (SELECT id, string_agg(coalesce(text, ''), ' ' ORDER BY pos) text, bool_or(lang = 'hi') hindi, count(*) there FROM (SELECT id, generate_subscripts(gold, 1) pos, unnest(gold) passage_id FROM x) JOIN {PASSAGES} USING (passage_id) GROUP BY id),
y AS (SELECT x.*, coalesce(text, '') text, coalesce(hindi, false) hindi, coalesce(there, 0) there, count(*) OVER (PARTITION BY array_to_string(qw, ' ')) times, list_distinct({_W("coalesce(text, '')")}) ew, {_W('a')} aw, {_W('b')} bw, answerable AND len(gold) > 0 judged, CASE query_lang WHEN 'en' THEN 'en' WHEN 'hi' THEN 'hi' WHEN 'hinglish' THEN 'hi-en' END want, list_distinct({S.tokenize('question')}) qt, list_distinct({S.tokenize("coalesce(text, '')")}) et FROM x LEFT JOIN ev USING (id))
SELECT id, unnest(list_filter([CASE WHEN len(qw) <= 2 THEN 'placeholder' END, CASE WHEN regexp_matches(question, {S.q('(?i)' + V.DEICTIC)}) THEN 'not-standalone' END, CASE WHEN want <> got THEN 'language-mismatch' END,
 CASE WHEN (answerable AND (len(gold) = 0 OR there < len(gold))) OR (NOT answerable AND (len(gold) > 0 OR a <> '')) THEN 'inconsistent' END,
 CASE WHEN judged AND hindi AND regexp_matches(a || ' ' || b, '[A-Za-z]{{2,}}') AND NOT regexp_matches(a || ' ' || b, '[{S.DEVA}]') THEN 'missing-hindi' END,
 CASE WHEN judged AND greatest(CASE WHEN trim(a) <> '' THEN {_COVER('aw')} ELSE 0.0 END, CASE WHEN trim(b) <> '' THEN {_COVER('bw')} ELSE 0.0 END) < 0.6 THEN 'answer-unsupported' END,
 CASE WHEN judged AND (trim(a) <> '' AND {_CUT('a')} OR trim(b) <> '' AND {_CUT('b')}) THEN 'answer-truncated' END, CASE WHEN judged AND len(aw) > 25 THEN 'answer-verbose' END,
 CASE WHEN judged AND (coalesce(query_lang, '') = 'hi') = hindi AND coalesce(query_lang, '') <> 'hinglish' AND CASE WHEN len(list_distinct(list_concat(qt, et))) = 0 THEN 1.0 ELSE len(list_intersect(qt, et)) / CAST(len(list_distinct(list_concat(qt, et))) AS DOUBLE) END >= 0.6 THEN 'high-overlap' END,
 CASE WHEN times > 1 THEN 'duplicate' END], lambda f: f IS NOT NULL)) AS finding FROM y""",
    "annotation_progress": f"SELECT *, total - verified - rejected AS remaining FROM (SELECT count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (starts_with(coalesce(notes, ''), 'REJECTED')) AS rejected FROM {ITEMS})",
    "check_translation": f"SELECT id, CASE WHEN length(answer_gold_hi) < 6 THEN 'too_short' WHEN {S.letter_devanagari_ratio(S.strip('answer_gold_hi'))} < 0.5 THEN 'wrong_script' WHEN {S.strip('answer_gold_hi')} = {S.strip('answer_gold')} THEN 'unchanged' END AS reason FROM {ITEMS} WHERE answer_gold IS NOT NULL AND answer_gold_hi IS NOT NULL",
    "check_base": f"""WITH x AS (SELECT id, {S.strip("coalesce(question, '')")} q, answer_gold a, text, lang FROM (SELECT id, question, answer_gold, gold_passage_ids[1] passage_id FROM {ITEMS} WHERE answerable) JOIN {PASSAGES} USING (passage_id))
SELECT id, CASE WHEN length(q) < 10 THEN 'question_short' WHEN (lang = 'hi' AND {S.letter_devanagari_ratio('q')} < 0.5) OR (lang = 'en' AND {S.letter_devanagari_ratio('q')} > 0.1) THEN 'wrong_script' WHEN {' OR '.join(f'contains(q, {S.q(x)})' for x in G.LEAKS)} THEN 'prompt_leak'
 WHEN {S.strip("coalesce(a, '')")} = '' THEN 'answer_empty' WHEN len({_LW('a')}) > 0 AND len(list_intersect({_LW('a')}, {_LW('text')})) = 0 THEN 'answer_unrelated' END AS reason FROM x""",
    "romanize_questions": f"SELECT id, md5(r) AS roman, CASE WHEN length(r) < 6 THEN 'too_short' WHEN {S.letter_devanagari_ratio('r')} > 0.2 THEN 'wrong_script' WHEN len(list_intersect({_LW('r')}, {S.words(T.UNAMBIGUOUS_MARKERS)})) = 0 THEN 'translated' END AS reason FROM (SELECT id, {_roman('question')} r FROM {ITEMS} WHERE regexp_matches(question, '[{S.DEVA}]')) WHERE trim(r) <> ''",
    "title_map": "SELECT scheme, lang, title FROM (SELECT scheme, regexp_extract(doc_id, '-([a-z]+)$', 1) lang, title, row_number() OVER (PARTITION BY scheme, regexp_extract(doc_id, '-([a-z]+)$', 1) ORDER BY retrieved_at DESC NULLS LAST, doc_id DESC, title DESC) r FROM source_docs WHERE title IS NOT NULL AND trim(title) <> '') WHERE r = 1",
    "blind_view": f"""WITH c AS (SELECT i.id, p, min(n) n FROM (SELECT id, unnest(gold_passage_ids) p, generate_subscripts(gold_passage_ids, 1) n FROM {ITEMS} UNION ALL SELECT query_id, passage_id, 1000 + rank FROM {RANKED} WHERE method_name = 'script_aware' AND rank <= 5) i WHERE id IN (SELECT query_id FROM {RANKED} WHERE method_name = 'script_aware') AND id IN (SELECT id FROM qa_items) GROUP BY 1, 2),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) <= 5) SELECT id, string_agg(p, ',' ORDER BY md5('{D.SEED}|' || id || '|' || p)) AS evidence FROM f GROUP BY id""",
    "build_unanswerable": f"""WITH q AS (SELECT * FROM (VALUES {', '.join(str((n, c)) for n, c in D.CLASS_QUOTAS)}) v(class, quota)), st AS (SELECT * FROM (VALUES {', '.join(f"({S.q(c)}, {i}, {len(v)}, {S.q(t)}, {S.q(l)})" for c, v in G.STEMS.items() for i, (t, l) in enumerate(v))}) v(class, k, m, stem, ql)),
a AS (SELECT 'un-' || q.class || '-' || format('{{:03d}}', i) id, q.class class, stem, ql, CASE WHEN contains(stem, '{{scheme}}') THEN count(*) FILTER (contains(stem, '{{scheme}}')) OVER (PARTITION BY q.class ORDER BY i) - 1 END place FROM (SELECT class, unnest(generate_series(0, quota - 1)) i FROM q) q JOIN st ON st.class = q.class AND st.k = i % m),
nm AS (SELECT *, row_number() OVER (ORDER BY {hash_order_sql('scheme', D.SEED)}, scheme) - 1 n FROM schemes WHERE title_en IS NOT NULL OR title_hi IS NOT NULL QUALIFY row_number() OVER (ORDER BY {hash_order_sql('scheme', D.SEED)}, scheme) <= (SELECT max(place) + 1 FROM a)),
x AS (SELECT a.*, scheme, CASE WHEN ql = 'hi' THEN 'hi' ELSE 'en' END nl, coalesce(CASE WHEN ql = 'hi' THEN title_hi ELSE title_en END, title_en, title_hi) name FROM a LEFT JOIN nm ON place % (SELECT count(*) FROM nm) = n),
pk AS (SELECT x.id, passage_id, row_number() OVER (PARTITION BY x.id ORDER BY lang <> nl, NOT ({' OR '.join(f"contains(lower(coalesce(section_path, '')), {S.q(h)})" for h in G.NEAR_SECTIONS)}), {hash_order_sql('passage_id', D.SEED)}, passage_id) r FROM x JOIN {PASSAGES} p ON p.scheme = x.scheme WHERE place IS NOT NULL)
SELECT x.id, CASE WHEN place IS NULL THEN stem ELSE replace(stem, '{{scheme}}', name) END AS question, ql AS query_lang, CASE WHEN ql = 'hi' THEN 'deva' ELSE 'latin' END AS script, class AS unanswerable_class, CASE WHEN place IS NULL THEN '' ELSE scheme END AS scheme, pk.passage_id AS distractor FROM x LEFT JOIN pk ON pk.id = x.id AND r = 1""",
}
ORACLES["recovery_summary"] = """WITH r AS (SELECT query_id, passage_id, method_name, row_number() OVER (PARTITION BY query_id, method_name ORDER BY round(score, 9) DESC NULLS LAST, passage_id) rank FROM (SELECT DISTINCT query_id, passage_id, method_name, coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, component_scores[method_name]) score FROM runs)),
x AS (SELECT query_id, method_name, bool_or(list_contains(gold_passage_ids, passage_id)) hit FROM r JOIN (SELECT DISTINCT id, answerable, gold_passage_ids FROM qa_items) i ON i.id = r.query_id WHERE rank <= 5 AND answerable GROUP BY 1, 2)
SELECT method_name, count(*) AS lost, count(*) FILTER (hit) AS recovered FROM x WHERE method_name <> 'bm25' AND query_id IN (SELECT query_id FROM x WHERE method_name = 'bm25' AND NOT hit) GROUP BY method_name"""
del ORACLES["probe_count"]


def _cases() -> str:
    parts, before = [], []
    for i, c in enumerate(V.CATEGORIES):
        free = "".join(f" AND id NOT IN (SELECT id FROM c{j})" for j in before)
        parts.append(f"c{i} AS (SELECT {S.q(c)} category, id, row_number() OVER (ORDER BY confidence DESC, id) place FROM tg JOIN fl USING (id) WHERE category = {S.q(c)}{free} QUALIFY row_number() OVER (ORDER BY confidence DESC, id) <= 2)")
        before.append(i)
    return f"""WITH r AS (SELECT * FROM {RANKED} WHERE method_name = 'bm25'), tg AS ({ORACLES['error_categories']}),
ats AS (SELECT query_id id, min(rank) FILTER (list_contains(gold_passage_ids, passage_id)) gold_rank, max(coalesce(score, 0.0)) FILTER (rank = 1) confidence, max(passage_id) FILTER (rank = 1) hit, any_value(gold_passage_ids[1]) gold FROM r JOIN {ITEMS} i ON i.id = query_id WHERE answerable AND len(gold_passage_ids) > 0 GROUP BY query_id),
fl AS (SELECT * FROM ats WHERE gold_rank IS NULL OR gold_rank > 5), {', '.join(parts)}, al AS ({' UNION ALL '.join(f'SELECT * FROM c{i}' for i in before)})
SELECT category, al.id, place, round(confidence, 6) AS confidence, coalesce(gold_rank, 0) AS gold_rank, CASE WHEN gold_rank IS NULL THEN 'gold not returned' ELSE 'gold at rank ' || gold_rank END || CASE WHEN h.scheme IS NULL OR g.scheme IS NULL THEN '' WHEN h.scheme <> g.scheme THEN '; best hit of another scheme' WHEN h.lang <> g.lang THEN '; best hit in another language' ELSE '; best hit of the same scheme, another section' END AS diagnosis
FROM al JOIN fl USING (id) LEFT JOIN {PASSAGES} h ON h.passage_id = hit LEFT JOIN {PASSAGES} g ON g.passage_id = gold"""


ORACLES["error_cases"] = _cases()


def _late() -> dict[str, str]:
    from pramana.plans.pipeline import lcs_support

    pairs = f"(SELECT id || '/' || passage_id AS key, {S.answer_tokens('answer_gold')} a, {S.answer_tokens('text')} b FROM (SELECT id, answer_gold, unnest(gold_passage_ids) passage_id FROM {ITEMS} WHERE answerable AND answer_gold <> '') JOIN {PASSAGES} USING (passage_id))"
    ev = f"(SELECT id, passage_lang, answer_gold, unnest(CASE WHEN len(gold_passage_ids) = 0 THEN [NULL] ELSE coalesce(gold_passage_ids, [NULL]) END) passage_id FROM {ITEMS} WHERE answerable AND answer_gold <> '')"
    rules = f"SELECT id, string_agg(DISTINCT finding, ',' ORDER BY finding) rules FROM ({ORACLES['review_findings']}) GROUP BY id"
    n = "CAST(regexp_extract(i.id, '([0-9]+)$', 1) AS BIGINT)"
    return {
        "rouge_l_precision": f"WITH {lcs_support(pairs)} SELECT split_part(key, '/', 1) AS id, substr(key, length(split_part(key, '/', 1)) + 2) AS passage_id, r AS support FROM rg",
        "grounding_by_arm": f"""WITH {lcs_support(pairs)}, b AS (SELECT split_part(key, '/', 1) id, max(r) support FROM rg GROUP BY 1) SELECT passage_lang AS arm, count(*) AS n, round(avg(CAST(coalesce(answer_gold, '') = '' AS INT)), 6) AS abstention, round(avg(CAST(support >= 0.6 AS INT)), 6) AS supported, round(avg(support), 6) AS mean_support
FROM (SELECT id, passage_lang, answer_gold FROM {ITEMS} WHERE answerable) LEFT JOIN b USING (id) GROUP BY passage_lang""",
        "answer_provenance": f"""WITH {lcs_support(pairs)}, y AS (SELECT e.id, bool_or(p.passage_id IS NOT NULL AND p.text IS NOT NULL) there, bool_or(coalesce(contains({S.normalize_answer('p.text')}, {S.normalize_answer('e.answer_gold')}) AND p.passage_id IS NOT NULL, false)) verbatim, max(r) r FROM {ev} e LEFT JOIN {PASSAGES} p USING (passage_id) LEFT JOIN rg ON rg.key = e.id || '/' || e.passage_id GROUP BY e.id)
SELECT CASE WHEN NOT there THEN 'no_evidence' WHEN verbatim THEN 'verbatim' WHEN r >= 0.8 THEN 'near' ELSE 'rewrite' END AS provenance, count(*) AS n FROM y GROUP BY 1""",
        "reviewed_items": f"""WITH rl AS ({rules}) SELECT i.id, coalesce(rules, '') AS rules, CASE WHEN {n} % 20 = 0 THEN 'fix' WHEN {n} % 10 = 0 THEN 'accept' END AS verdict, CASE WHEN {n} % 10 = 0 THEN 'reader' END AS reviewed_by, CASE WHEN {n} % 20 = 0 AND question IS NOT NULL THEN 'question' ELSE '' END AS changed, md5(CASE WHEN {n} % 20 = 0 THEN trim(question) || ' (checked)' ELSE question END) AS question FROM {ITEMS} i LEFT JOIN rl ON rl.id = i.id""",
    }
