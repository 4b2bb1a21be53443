"""Queries of segmentation, corpus checks, serving and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.operators import corpus as C
from pramana.operators import replies as R
from pramana.operators.dense import REGISTRY
from pramana.operators import serving as V
from pramana.plans import sqltext as S
from pramana.plans.base import ITEMS, PASSAGES, items, passages
from pramana.session import table
from pramana.sources.jsonl import parse_lines


def split_sections(spark: SparkSession, d: str) -> DataFrame:
    s = C.split_sections(table(spark, d, "documents"))
    return s.select("doc_id", "pos", F.col("level").cast("bigint").alias("level"), "path", F.md5("body").alias("digest"))


def pack_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.split_sentences(T.normalize_text(F.col("text"))).alias("s")).select("doc_id", C.pack(F.col("s")).alias("packs"))
    return t.select("doc_id", F.posexplode("packs").alias("pack_no", "pack")).select("doc_id", "pack_no", F.size("pack").alias("n_sentences"), F.md5(F.array_join("pack", " ")).alias("digest"))


def segment_documents_v1(spark: SparkSession, d: str) -> DataFrame:
    return C.segment_documents(table(spark, d, "documents"), version=1).select("doc_id", "passage_no", "section_path", "token_count", F.md5("text").alias("digest"))


def segment_documents_v2(spark: SparkSession, d: str) -> DataFrame:
    return C.segment_documents(table(spark, d, "documents"), version=2).select("doc_id", "passage_no", "section_path", "token_count", F.md5("text").alias("digest"))


def align_spans(spark: SparkSession, d: str) -> DataFrame:
    """Segmented passages found again in their documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    own = C.segment_documents(docs).select("passage_id", "doc_id", "text")
    return C.align_spans(own, docs).select("passage_id", "start", "end", "coverage", F.md5("text_raw").alias("text_raw"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A text for each document of passages: their raw texts in order, each passage under a heading of its section."""
    p = _whole_passages(spark, d)
    part = F.concat(F.lit("== "), F.coalesce(F.nullif(F.trim("section_path"), F.lit("")), F.lit("lead")), F.lit(" ==\n"), F.coalesce("text_raw", F.lit("")))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def _whole_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").groupBy("passage_id").agg(*[F.max(c).alias(c) for c in ("doc_id", "text", "text_raw", "section_path", "token_count", "char_span")])


def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Ten checks of the passages as they are stored, repeated rows included, against texts made of them."""
    return C.audit(table(spark, d, "passages"), _sources(spark, d))


def repair_spans(spark: SparkSession, d: str) -> DataFrame:
    """The places of passages in texts made of them."""
    x = C.repair_spans(_whole_passages(spark, d).select("passage_id", "doc_id", "text", "text_raw", "char_span"), _sources(spark, d))
    return x.select("passage_id", F.col("char_span")[0].alias("start"), F.col("char_span")[1].alias("end"), F.md5("text_raw").alias("text_raw"))


def reanchored_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with the citations of another segmentation."""
    x = C.apply_reanchor(items(spark, d).select("id", "gold_passage_ids", "verified", "notes"), reanchor_citations(spark, d), version=2)
    return x.select("id", F.array_join("gold_passage_ids", ",").alias("gold"), "verified", "notes")


def reanchor_citations(spark: SparkSession, d: str) -> DataFrame:
    """Gold citations, were the passages of each document renumbered and joined by twos."""
    old = passages(spark, d)
    half = F.floor(F.regexp_extract("passage_id", r"#p(\d+)$", 1).cast("int") / 2)
    new = old.where("text is not null").groupBy("doc_id", half.alias("no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "text"))), lambda x: x["text"]), " ").alias("text")).select(F.format_string("%s#p%04d", "doc_id", F.col("no").cast("int")).alias("passage_id"), "doc_id", "text")
    cited = items(spark, d).where("answerable").select("id", "answer_gold", F.explode("gold_passage_ids").alias("passage_id")).select("id", "passage_id", F.col("answer_gold").alias("answer"))
    return C.reanchor(cited, old, new)


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """By language: passages, schemes and quartiles of words, the quartile being the value at index n div 4 and so on."""
    x = passages(spark, d).withColumn("n", T.count_tokens(F.col("text")))
    g = x.groupBy("lang").agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("scheme").alias("schemes"))
    # Counted by value, so that no task holds a language's passages.
    from pyspark.sql.window import Window

    c = x.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("lang").orderBy("n"))).join(g.select("lang", "passages"), "lang")
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(F.col("passages") * k / 4), F.col("n"))).alias(f"q{k}")
    return g.join(c.groupBy("lang").agg(at(1), at(2), at(3)), "lang").select("lang", "passages", "schemes", "q1", "q2", "q3")


def paired_source_filter(spark: SparkSession, d: str) -> DataFrame:
    """Stems that have a document in English and in Hindi."""
    lang = F.lower(F.substring("lang", 1, 2))
    x = table(spark, d, "source_docs").select(F.regexp_replace("doc_id", "-[a-z]+$", "").alias("stem"), F.when(F.col("lang").isNull(), F.regexp_extract("doc_id", "-([a-z]+)$", 1)).otherwise(lang).alias("lang"))
    return x.where("lang in ('en', 'hi')").groupBy("stem").agg(F.countDistinct("lang").alias("langs")).where("langs = 2").select("stem")


#: Requests that say one thing wrong each, or are right, by number.
REQUESTS = [
    '{"query": "a b", "method": "bm25", "k": 3}', '{"query": "  "}', '["query"]', '{"query": "a", "method": "hybrid-script"}', '{"query": "a", "method": "hybrid-rrf", "k": 99}', '{"query": "a", "k": "x"}',
    '{"query": "a", "k": -4, "bm25_floor": 2.5}', '{"query": "a", "generator": "other"}', '{"query": "a", "generator": "extractive", "bm25_floor": "y"}', '{"question": "a"}', "null", '{"query": "',
]


def validate_request(spark: SparkSession, d: str) -> DataFrame:
    """Requests made for the events, one kind of each after the other; of the last kind the query is as long as the event's number has it, up to 600."""
    n = (F.col("event_id") % (len(REQUESTS) + 1)).cast("int")
    long = F.concat(F.lit('{"query": "'), F.repeat(F.lit("q"), (F.col("event_id") % 600 + 1).cast("int")), F.lit('"}'))
    x = table(spark, d, "events").select("event_id", F.coalesce(F.get(F.array(*map(F.lit, REQUESTS)), n), long).alias("payload"))
    return x.select("event_id", V.validate_request(F.col("payload"), ["extractive"]).alias("r")).select("event_id", F.col("r.status").cast("bigint").alias("status"), "r.error", F.col("r.k").cast("bigint").alias("k"))


def resolve_citation(spark: SparkSession, d: str) -> DataFrame:
    """Citations of gold passages as written in four ways."""
    x = items(spark, d).where("size(gold_passage_ids) > 0").select("id", "gold_passage_ids", (F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 4).alias("way"))
    first = F.get("gold_passage_ids", F.lit(0))
    raw = F.when(F.col("way") == 0, F.concat(F.lit("[id="), first, F.lit("]"))).when(F.col("way") == 1, F.lit("[1]")).when(F.col("way") == 2, F.concat(first, F.lit(" (scheme, lead)"))).otherwise(F.concat(F.lit("ID: "), first, F.lit(",")))
    return x.select("id", V.resolve_citation(raw, F.col("gold_passage_ids")).alias("passage_id"))


def extract_json_object(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", F.concat(F.lit("reply: "), F.coalesce("props", F.lit("")), F.lit(" end }")).alias("reply"))
    return x.select("event_id", V.extract_json_object("reply").alias("object"))


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("visitor"), "ts")
    return V.rate_limit(x, V.Limits(per_minute=2, per_day=20))


def hosted_budget(spark: SparkSession, d: str) -> DataFrame:
    """Decisions where every third request goes to a hosted model, whose budget is one for all."""
    x = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("visitor"), "ts", (F.col("event_id") % 3 == 0).alias("hosted"))
    return V.rate_limit(x, V.Limits(per_minute=2, per_day=20, hosted_per_day=15), hosted="hosted")


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Under which names encoders' vectors are kept, with both kinds of pooling."""
    x = spark.createDataFrame([(e.name, e.kind == "mlm", p, e.key(p)) for e in REGISTRY.values() for p in ("mean", "cls")], "name string, is_mlm boolean, pooling string, own string")
    return x.select("name", "pooling", R.cache_key(F.col("name"), F.col("pooling"), F.col("is_mlm")).alias("key"), "own")


def pool_states(spark: SparkSession, d: str) -> DataFrame:
    """The first of four states cut from each vector."""
    from pramana.operators.dense import pool

    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double"))).alias("s"), F.array(*[F.lit(1)] * 4).alias("m"))
    return e.select("vec_id", F.round(F.get(pool(F.col("s"), F.col("m"), "cls"), F.lit(7)), 6).alias("v7"))


def scan_jsonl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """The schemes as JSON lines with comments, blank lines and an extra field, read back."""
    t = table(spark, d, "schemes")
    lines = t.select(F.to_json(F.struct("scheme", "title_en", F.length("title_hi").alias("n_hi"))).alias("value")).unionByName(t.select(F.lit("// note").alias("value"))).unionByName(t.select(F.lit("   ").alias("value")))
    return parse_lines(lines, "scheme string, title_en string, category string").select("scheme", "title_en", "category", F.col("unknown_fields")["n_hi"].alias("n_hi"))


QUERIES = [split_sections, pack_sentences, segment_documents_v1, segment_documents_v2, align_spans, corpus_audit, repair_spans, reanchor_citations, reanchored_items, corpus_stats, paired_source_filter, validate_request, resolve_citation, extract_json_object, rate_limit_decisions, hosted_budget, cache_keys, pool_states, scan_jsonl_tolerant]

_N = S.count_tokens("text")
_SET = lambda x: f"list_distinct(list_filter(regexp_split_to_array({x}, '[{S.SPACE}]+'), lambda w: w <> ''))"
_LIMITED = """RECURSIVE e AS (SELECT event_id request_id, user_id visitor, epoch(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) n FROM events),
r AS (SELECT visitor, CAST(0 AS BIGINT) n, CAST([] AS DOUBLE[]) acc, CAST(NULL AS BIGINT) request_id, '' decision FROM e WHERE n = 1
 UNION ALL SELECT visitor, n, CASE WHEN d = 'ok' THEN list_append(live, t) ELSE live END, request_id, d FROM (SELECT *, CASE WHEN len(list_filter(live, lambda a: t - a < 60)) >= 2 THEN 'minute' WHEN len(live) >= 20 THEN 'day' ELSE 'ok' END d FROM (
  SELECT e.*, list_filter(acc, lambda a: e.t - a <= 86400) live FROM r JOIN e ON e.visitor IS NOT DISTINCT FROM r.visitor AND e.n = r.n + 1)))"""
_AW = lambda x: f"list_distinct({S.answer_tokens(x)})"
_RE = f"""pp AS (SELECT passage_id, doc_id, text, CAST(regexp_extract(passage_id, '#p([0-9]+)$', 1) AS INT) // 2 no FROM {PASSAGES}),
nn AS (SELECT format('{{}}#p{{:04d}}', doc_id, no) new_id, doc_id, string_agg(text, ' ' ORDER BY passage_id) nt FROM pp WHERE text IS NOT NULL GROUP BY doc_id, no), nw AS (SELECT *, {_AW('nt')} nw FROM nn),
ct AS (SELECT id, passage_id, {_AW('answer_gold')} aw FROM (SELECT id, answer_gold, unnest(gold_passage_ids) passage_id FROM {ITEMS} WHERE answerable)), ow AS (SELECT passage_id, doc_id, text ot, {_AW('text')} ow FROM {PASSAGES}),
cx AS (SELECT ct.id, ct.passage_id, new_id, coalesce(ot = nt, false) same, round(coalesce(CASE WHEN len(ow) > 0 THEN len(list_intersect(ow, nw)) / CAST(len(ow) AS DOUBLE) ELSE 0.0 END, 0.0), 12) c, aw, nw FROM ct JOIN ow USING (passage_id) LEFT JOIN nw ON nw.doc_id = ow.doc_id),
cy AS (SELECT *, c >= 0.2 AND len(aw) > 0 AND coalesce(len(list_intersect(aw, nw)) / CAST(greatest(len(aw), 1) AS DOUBLE), 0.0) >= 0.8 carries FROM cx),
cg AS (SELECT id, passage_id, bool_or(same AND new_id = passage_id) kept, min(new_id) FILTER (same) moved, max(round(c, 9)) best, arg_min(new_id, struct_pack(m := -round(c, 9), n := new_id)) top, count(*) FILTER (carries) carriers, min(new_id) FILTER (carries) carrier FROM cy GROUP BY id, passage_id),
st AS (SELECT *, CASE WHEN coalesce(kept, false) THEN 'unchanged' WHEN moved IS NOT NULL THEN 'moved' WHEN best >= 0.9 THEN 'contained' WHEN carriers = 1 THEN 'split-answer' ELSE 'review' END status FROM cg),
rs AS (SELECT id, passage_id, status, CASE status WHEN 'moved' THEN moved WHEN 'contained' THEN top WHEN 'split-answer' THEN carrier ELSE passage_id END new_id FROM st)"""
ORACLES = {
    "corpus_audit": f"""WITH w AS (SELECT passage_id, max(doc_id) doc_id, max(text_raw) text_raw, max(section_path) section_path FROM passages GROUP BY passage_id),
so AS (SELECT doc_id, string_agg('== ' || coalesce(nullif(trim(section_path), ''), 'lead') || ' ==' || chr(10) || coalesce(text_raw, ''), chr(10) || chr(10) ORDER BY passage_id) src FROM w GROUP BY doc_id),
x AS (SELECT row_number() OVER () rn, passage_id, p.doc_id, count(*) OVER (PARTITION BY passage_id) copies, coalesce(text, '') text, coalesce(p.text_raw, '') raw, token_count, coalesce(char_span[1], 0) a, coalesce(char_span[2], 0) b, src FROM passages p LEFT JOIN so USING (doc_id)),
y AS (SELECT *, {S.count_tokens('text')} n, {_SET(S.normalize_text("substr(src, a + 1, greatest(b - a, 0))"))} rec, {_SET('text')} tw FROM x),
sec AS (SELECT doc_id, {_SET(S.normalize_text('body'))} v FROM (SELECT doc_id, {S.strip("regexp_extract(part, '(?s)^[^' || chr(2) || ']*' || chr(2) || '(.*)$', 1)")} body FROM (SELECT doc_id, unnest(string_split(regexp_replace(src, '(?m)^== *([^=\n]+?) *==[ \t\r]*$', chr(1) || '\1' || chr(2), 'g'), chr(1))) part FROM so) WHERE part <> '' AND NOT list_contains({S.words(C.SKIPPED)}, lower(trim(regexp_extract(part, '^([^' || chr(2) || ']*)' || chr(2), 1))))) WHERE body <> ''),
sg AS (SELECT rn, coalesce(max(CASE WHEN v IS NULL THEN NULL WHEN len(tw) = 0 THEN 1.0 ELSE len(list_intersect(tw, v)) / CAST(len(tw) AS DOUBLE) END), 1.0) held FROM y LEFT JOIN sec USING (doc_id) WHERE src IS NOT NULL GROUP BY rn),
z AS (SELECT unnest(['unique_ids', 'nonempty_text', 'token_count_accurate', 'within_max_tokens', 'source_present', 'span_present', 'span_recovers_text']) check_name,
 unnest([copies = 1, {S.strip('text')} <> '' AND {S.strip('raw')} <> '', coalesce(token_count = n, false), n <= 240, src IS NOT NULL, CASE WHEN src IS NOT NULL THEN a <> 0 OR b <> 0 END,
  CASE WHEN src IS NOT NULL AND (a <> 0 OR b <> 0) THEN CASE WHEN len(list_distinct(list_concat(rec, tw))) = 0 THEN 1.0 ELSE len(list_intersect(rec, tw)) / CAST(len(list_distinct(list_concat(rec, tw))) AS DOUBLE) END >= 0.95 END]) ok FROM y
 UNION ALL SELECT 'single_section', held >= 0.98 FROM sg UNION ALL SELECT 'raw_preserves_source', count(*) FILTER (raw <> '' AND {S.normalize_text('raw')} = raw) / CAST(count(*) AS DOUBLE) <= 0.9 FROM y HAVING count(*) >= 20)
SELECT check_name, count(*) AS n, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE), 6) AS rate FROM z WHERE ok IS NOT NULL GROUP BY check_name""",
    "pack_sentences": f"""WITH RECURSIVE s AS (SELECT doc_id, generate_subscripts(l, 1) i, unnest(l) s FROM (SELECT doc_id, {S.split_sentences(S.normalize_text('text'))} l FROM documents)), w AS (SELECT doc_id, i, s, {S.count_tokens('s')} n FROM s),
r AS (SELECT doc_id, CAST(0 AS BIGINT) i, CAST(-1 AS BIGINT) pack, CAST(0 AS BIGINT) pk, CAST(0 AS BIGINT) size, false opened FROM w WHERE i = 1
 UNION ALL SELECT doc_id, i, pack, CASE WHEN size >= 170 THEN pack + 1 ELSE pack END, CASE WHEN size >= 170 THEN 0 ELSE size END, size < 170 FROM (
  SELECT r.doc_id, w.i, CASE WHEN opened AND size + n > 240 THEN pk + 1 ELSE pk END pack, CASE WHEN opened AND size + n > 240 THEN n ELSE size + n END size FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1))
SELECT doc_id, CAST(pack AS INT) AS pack_no, CAST(count(*) AS INT) AS n_sentences, md5(string_agg(s, ' ' ORDER BY w.i)) AS digest FROM r JOIN w USING (doc_id, i) GROUP BY doc_id, pack""",
    "rate_limit_decisions": f"""WITH {_LIMITED} SELECT request_id, visitor, decision FROM r WHERE n > 0""",
    "hosted_budget": """WITH RECURSIVE e AS (SELECT event_id request_id, user_id visitor, epoch(ts) t, event_id % 3 = 0 hosted, row_number() OVER (ORDER BY epoch(ts), event_id) n FROM events),
b AS (SELECT floor(t / 3600) h, count(*) c FROM e WHERE hosted GROUP BY 1), tight AS (SELECT coalesce(max(c), 0) > 15 x FROM (SELECT g, sum(c) c FROM (SELECT c, unnest(generate_series(CAST(h AS BIGINT), CAST(h AS BIGINT) + 24)) g FROM b) GROUP BY g)),
v AS (SELECT *, row_number() OVER (PARTITION BY visitor ORDER BY t, request_id) k FROM e),
r AS (SELECT CAST(0 AS BIGINT) n, CAST([] AS STRUCT(v BIGINT, t DOUBLE)[]) acc, CAST([] AS DOUBLE[]) used, CAST(NULL AS BIGINT) request_id, CAST(NULL AS BIGINT) visitor, '' decision
 UNION ALL SELECT n, CASE WHEN d = 'ok' THEN list_append(live, struct_pack(v := visitor, t := t)) ELSE live END, CASE WHEN d = 'ok' AND hosted THEN list_append(lu, t) ELSE lu END, request_id, visitor, d FROM (
  SELECT *, CASE WHEN len(list_filter(live, lambda a: a.v = visitor AND t - a.t < 60)) >= 2 THEN 'minute' WHEN len(list_filter(live, lambda a: a.v = visitor)) >= 20 THEN 'day' WHEN hosted AND (SELECT x FROM tight) AND len(lu) >= 15 THEN 'budget' ELSE 'ok' END d FROM (
   SELECT e.*, list_filter(acc, lambda a: e.t - a.t <= 86400) live, list_filter(used, lambda a: e.t - a <= 86400) lu FROM r JOIN e ON e.n = r.n + 1)))
SELECT request_id, visitor, decision FROM r WHERE n > 0""",
    "extract_json_object": "SELECT event_id, CASE WHEN starts_with(ltrim(props), '{') AND json_valid(props) THEN trim(props) END AS object FROM events",
    "cache_keys": "SELECT name, pooling, key, key AS own FROM (SELECT name, pooling, replace(name, '/', '__') || CASE WHEN mlm THEN '.' || pooling ELSE '' END AS key FROM (VALUES " + ", ".join(f"('{e.name}', {'true' if e.kind == 'mlm' else 'false'})" for e in REGISTRY.values()) + ") v(name, mlm), (VALUES ('mean'), ('cls')) p(pooling))",
    "pool_states": "SELECT vec_id, round(CAST(embedding[8] AS DOUBLE), 6) AS v7 FROM embeddings",
    "reanchor_citations": f"WITH {_RE} SELECT id, passage_id, status, new_id FROM rs",
    "reanchored_items": f"""WITH {_RE}, g AS (SELECT id, max(list_position(['unchanged', 'moved', 'contained', 'split-answer', 'review'], status)) worst FROM rs GROUP BY id),
ng AS (SELECT id, string_agg(p, ',' ORDER BY n) gold FROM (SELECT c.id, coalesce(new_id, c.passage_id) p, min(n) n FROM (SELECT id, generate_subscripts(gold_passage_ids, 1) n, unnest(gold_passage_ids) passage_id FROM {ITEMS}) c LEFT JOIN rs ON rs.id = c.id AND rs.passage_id = c.passage_id GROUP BY 1, 2) GROUP BY id)
SELECT i.id, CASE WHEN coalesce(worst, 1) > 1 THEN ng.gold ELSE array_to_string(gold_passage_ids, ',') END AS gold, verified AND coalesce(worst, 1) = 1 AS verified, CASE WHEN coalesce(worst, 1) > 1 THEN CASE WHEN coalesce(notes, '') = '' THEN '' ELSE notes || '; ' END || 'reanchored to segmentation v2: ' || ['unchanged', 'moved', 'contained', 'split-answer', 'review'][worst] ELSE notes END AS notes
FROM {ITEMS} i LEFT JOIN g ON g.id = i.id LEFT JOIN ng ON ng.id = i.id""",
    "corpus_stats": f"""WITH x AS (SELECT lang, scheme, {_N} n FROM {PASSAGES}), g AS (SELECT lang, count(*) passages, count(DISTINCT scheme) schemes, list(n ORDER BY n) ns FROM x GROUP BY lang)
SELECT lang, passages, schemes, ns[passages // 4 + 1] AS q1, ns[passages * 2 // 4 + 1] AS q2, ns[passages * 3 // 4 + 1] AS q3 FROM g""",
    "paired_source_filter": "SELECT stem FROM (SELECT regexp_replace(doc_id, '-[a-z]+$', '') stem, CASE WHEN lang IS NULL THEN regexp_extract(doc_id, '-([a-z]+)$', 1) ELSE lower(substr(lang, 1, 2)) END lang FROM source_docs) WHERE lang IN ('en', 'hi') GROUP BY stem HAVING count(DISTINCT lang) = 2",
    "validate_request": f"""SELECT event_id, CASE WHEN n IN (0, 4, 6) OR (n = 12 AND event_id % 600 < 500) THEN 200 ELSE 400 END AS status,
 CASE WHEN n IN (2, 10, 11) THEN 'expected a JSON object' WHEN n IN (1, 9) THEN 'query is empty' WHEN n = 12 AND event_id % 600 >= 500 THEN 'query is too long' WHEN n = 3 THEN 'unknown method' WHEN n IN (5, 8) THEN 'bm25_floor and k must be numbers' WHEN n = 7 THEN 'unknown generator' END AS error,
 CASE n WHEN 0 THEN 3 WHEN 4 THEN 10 WHEN 6 THEN 1 ELSE 5 END AS k FROM (SELECT event_id, event_id % {len(REQUESTS) + 1} n FROM events)""",
    "resolve_citation": f"SELECT id, gold_passage_ids[1] AS passage_id FROM {ITEMS} WHERE len(gold_passage_ids) > 0",
    "scan_jsonl_tolerant": "SELECT scheme, title_en, CAST(NULL AS VARCHAR) AS category, CAST(length(title_hi) AS VARCHAR) AS n_hi FROM schemes",
    "split_sections": f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(list_zip(generate_series(0, 9999)[:len(l)], l)) z FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(?m)^(==)[ \\t]*([^=\\n]+?)[ \\t]*==[ \\t\\r]*$', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) l FROM documents)),
c AS (SELECT doc_id, CAST(z[1] AS BIGINT) pos, z[2] part FROM p),
s AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'Introduction' ELSE {S.strip("regexp_extract(part, '(?s)' || chr(2) || '(.*?)' || chr(3), 1)")} END path, {S.strip("CASE WHEN pos = 0 THEN part ELSE regexp_extract(part, '(?s)' || chr(3) || '(.*)$', 1) END")} body FROM c)
SELECT doc_id, pos, CAST(1 AS BIGINT) AS level, path, md5(body) AS digest FROM s WHERE body <> '' AND (pos = 0 OR lower(path) NOT IN ({', '.join(map(S.q, C.SKIPPED))}))""",
}
