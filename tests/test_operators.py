"""Operators of the core on small tables."""

import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from pramana.operators import answerability, answers, corpus, dataset, dense, fusion, metrics, serving
from pramana.operators.lexical import LexicalIndex
from pramana.session import cut, frequent, lookup
from pramana.sources.jsonl import malformed, parse_lines, read_jsonl, write_jsonl
from pramana.streaming.limiter import rate_limit_stream


def runs(spark, rows):
    return spark.createDataFrame(rows, "qid string, pid string, score double, rank bigint")


def test_lexical_ranks_and_ties(spark):
    docs = spark.createDataFrame([("a", "scholarship income ceiling"), ("b", "scholarship income ceiling"), ("c", "hostel register"), ("d", None), ("e", "")], "passage_id string, text string")
    asked = spark.createDataFrame([("q", "income ceiling income"), ("none", "zebra"), ("null", None)], "id string, question string")
    got = LexicalIndex(docs).bm25(asked, 5).orderBy("rank").collect()
    assert [(r["qid"], r["pid"], r["rank"]) for r in got] == [("q", "a", 1), ("q", "b", 2)]
    assert {r["pid"] for r in LexicalIndex(docs).tfidf(asked).collect()} == {"a", "b"}


def test_lexical_empty_tables(spark):
    none = spark.createDataFrame([], "passage_id string, text string")
    asked = spark.createDataFrame([("q", "x y")], "id string, question string")
    assert LexicalIndex(none).bm25(asked).count() == 0


def test_fusion_of_scripts(spark):
    lexical = runs(spark, [("q", "en1", 9.0, 1), ("q", "en2", 8.0, 2)])
    found = runs(spark, [("q", "hi1", 0.9, 1), ("q", "en1", 0.8, 2)])
    scripts = spark.createDataFrame([("en1", "latin"), ("en2", "latin"), ("hi1", "deva")], "pid string, script string")
    top = lambda df: df.where("rank = 1").first()["pid"]
    latin, mixed = (spark.createDataFrame([("q", s)], "qid string, script string") for s in ("latin", "mixed"))
    assert top(fusion.reciprocal(lexical, found)) == "en1"
    assert top(fusion.script_aware(lexical, found, scripts, latin)) in ("hi1", "en1")
    plain, same = (df.orderBy("rank").select("pid").collect() for df in (fusion.reciprocal(lexical, found), fusion.script_aware(lexical, found, scripts, mixed)))
    assert plain == same


def test_weighted_norms(spark):
    lexical = runs(spark, [("q", "p1", 30.0, 1), ("q", "p2", 4.0, 2), ("q", "p3", 3.0, 3)])
    found = runs(spark, [("q", "p2", 0.90, 1), ("q", "p3", 0.88, 2), ("q", "p4", 0.86, 3)])
    tops = {how: fusion.weighted(lexical, found, alpha=0.5, how=how).where("rank = 1").first()["pid"] for how in ("minmax", "zscore")}
    assert tops["minmax"] != tops["zscore"]
    flat = runs(spark, [("q", x, 7.0, i) for i, x in enumerate("abc", 1)])
    assert {r["norm"] for r in fusion.normalized(flat).collect()} == {0.5}
    assert {r["norm"] for r in fusion.normalized(flat, "zscore").collect()} == {0.0}


def test_outcomes(spark):
    r = spark.createDataFrame([("s", "q", p, i) for i, p in enumerate("xaybz", 1)], "system string, qid string, pid string, rank bigint")
    gold = spark.createDataFrame([("q", ["a", "b"]), ("none", [])], "qid string, gold array<string>")
    o = metrics.outcomes(r, gold, ks=(1, 2, 4)).first()
    assert (o["hit_1"], o["hit_2"], o["recall_2"], o["recall_4"], o["precision_4"], o["rr"]) == (0, 1, 0.5, 1.0, 0.5, 0.5)
    assert 0 < o["ndcg_10"] < 1


def test_paired_test(spark):
    a = spark.createDataFrame([(str(i), 1.0) for i in range(12)], "qid string, value double")
    b = spark.createDataFrame([(str(i), 0.0) for i in range(12)], "qid string, value double")
    assert metrics.paired_randomization(a, b, trials=500).first()["p_value"] < 0.05
    assert metrics.paired_randomization(a, a, trials=100).first()["p_value"] == 1.0


def test_bootstrap_covers_mean(spark):
    v = spark.createDataFrame([("s", str(i), float(i % 2)) for i in range(40)], "system string, qid string, value double")
    r = metrics.bootstrap_interval(v, resamples=200).first()
    assert r["lo"] < r["mean"] < r["hi"]


def test_dense(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [0.0, 0.0]), (10, None)], "pid long, v array<double>")
    q = spark.createDataFrame([(0, [4.0, 1.0])], "qid long, v array<double>")
    got = dense.dense_topk(q, v, 2).orderBy("rank").collect()
    assert [r["pid"] for r in got] == [4, 3] and got[0]["score"] == 1.0
    assert dense.dense_topk(q.limit(0), v, 2).count() == 0


def test_vector_cache(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0])], "pid string, v array<double>")
    dense.save_vectors(v, str(tmp_path), "one")
    assert dense.load_vectors(spark, str(tmp_path), "one").count() == 1
    with pytest.raises(dense.CacheMismatch):
        dense.load_vectors(spark, str(tmp_path), "two")


def test_features_and_thresholds(spark):
    hits = runs(spark, [("q", p, s, i) for i, (p, s) in enumerate(zip("abcd", (0.9, 0.3, 0.2, 0.1)), 1)])
    schemes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "pid string, scheme string")
    f = answerability.features(hits, schemes).first()
    assert (f["max_score"], f["scheme_agreement"], f["n_candidates"]) == (0.9, 0.75, 4) and math.isclose(f["margin"], 0.6)
    x = spark.createDataFrame([(4.0, True), (3.0, True), (1.0, False), (0.5, False)], "raw double, answerable boolean")
    t = answerability.fit_threshold(x).first()
    assert t["f1"] == 1.0 and t["scale"] == 4.0 and 0.25 < t["tau"] <= 0.75


def test_auc_and_kappa(spark):
    x = spark.createDataFrame([("m", 1.0, True), ("m", 1.0, False), ("m", 2.0, True), ("m", 0.0, False)], "g string, score double, positive boolean")
    assert answerability.auc(x, group="g").first()["auc"] == 0.875
    pairs = spark.createDataFrame([(True, True), (False, False), (None, True)], "a boolean, b boolean")
    assert answerability.cohens_kappa(pairs).first()["kappa"] == 1.0


@pytest.mark.parametrize("a,b,f1", [("hostel hostel hostel", "hostel", 0.5), ("", "", 1.0), ("", "x", 0.0), (None, "x", 0.0)])
def test_f1(spark, a, b, f1):
    from pramana.functions import text as T

    x = spark.createDataFrame([(a, b)], "a string, b string").select(T.answer_tokens(F.col("a")).alias("a"), T.answer_tokens(F.col("b")).alias("b"))
    assert x.select(answers.token_f1(F.col("a"), F.col("b")).alias("f")).first()["f"] == f1


def test_rouge(spark):
    x = spark.createDataFrame([("a cat sat here", "cat never sat down here"), ("", "x"), (None, None), ("one two three", "three two one")], "a string, b string")
    got = x.select(answers.rouge_l_precision(F.col("a"), F.col("b")).alias("r")).collect()
    assert [round(r["r"], 4) for r in got] == [1.0, 0.0, 0.0, 0.3333]


def test_lcs_against_the_table():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j + 1], row[j] + 1 if x == y else 0) for j, y in enumerate(b)]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        assert answers._lcs(a, b) == row[-1]


def test_sections_and_segments(spark):
    text = "Lead words here.\n== A ==\nbody a\n=== B ===\nbody b\n== References ==\nskip\n== C ==\n\n== D ==\nlast"
    docs = spark.createDataFrame([("d", text), ("n", None)], "doc_id string, text string")
    assert [(r["path"], r["body"]) for r in corpus.split_sections(docs).orderBy("pos").collect()] == [("Introduction", "Lead words here."), ("A", "body a"), ("A > B", "body b"), ("D", "last")]
    long = spark.createDataFrame([("d", " ".join(f"Word{i} " + "x " * 28 + "end." for i in range(20)))], "doc_id string, text string")
    for version in (1, 2):
        p = corpus.segment_documents(long, version=version).orderBy("passage_no").collect()
        assert len(p) > 1 and all(r["token_count"] <= 310 for r in p) and [r["passage_no"] for r in p] == list(range(len(p)))
    spans = corpus.align_spans(corpus.segment_documents(long).select(F.col("passage_no").cast("string").alias("passage_id"), "doc_id", "text"), long).collect()
    assert spans and all(r["coverage"] >= 0.9 and r["start"] < r["end"] for r in spans)
    twice = spark.createDataFrame([("d", "The fee is due. Other words stand here. The fee is due. The end is near.")], "doc_id string, text string")
    own = spark.createDataFrame([("p0", "d", "The fee is due. Other words stand here."), ("p1", "d", "The fee is due. The end is near.")], "passage_id string, doc_id string, text string")
    at = {r["passage_id"]: (r["start"], r["text_raw"]) for r in corpus.align_spans(own, twice).collect()}
    assert at == {"p0": (0, "The fee is due. Other words stand here."), "p1": (40, "The fee is due. The end is near.")}
    fixed = corpus.repair_spans(own.withColumns({"text_raw": F.lit("x"), "char_span": F.array(F.lit(0), F.lit(0))}), twice.where("doc_id = 'none'")).collect()
    assert all(r["char_span"] == [0, 0] and r["text_raw"] == "x" for r in fixed)
    gone = corpus.align_spans(spark.createDataFrame([("p", "d", "quite other words")], "passage_id string, doc_id string, text string"), long).first()
    assert gone["start"] is None


def test_reanchor(spark):
    old = spark.createDataFrame([("d#p0", "d", "alpha beta gamma"), ("d#p1", "d", "delta epsilon"), ("d#p2", "d", "zeta eta theta iota")], "passage_id string, doc_id string, text string")
    new = spark.createDataFrame([("d#p0", "d", "alpha beta gamma"), ("d#p3", "d", "delta epsilon"), ("d#p4", "d", "zeta eta more"), ("d#p5", "d", "theta iota")], "passage_id string, doc_id string, text string")
    cited = spark.createDataFrame([("1", "d#p0", "x"), ("2", "d#p1", "x"), ("3", "d#p2", "theta iota"), ("4", "d#p2", "none")], "id string, passage_id string, answer string")
    got = {r["id"]: (r["status"], r["new_id"]) for r in corpus.reanchor(cited, old, new).collect()}
    assert got == {"1": ("unchanged", "d#p0"), "2": ("moved", "d#p3"), "3": ("split-answer", "d#p5"), "4": ("review", "d#p2")}


def test_split_is_exact(spark):
    x = spark.createDataFrame([(str(i), "a" if i % 3 else None) for i in range(31)], "id string, g string")
    got = dataset.stratified_split(x, ["g"], "id", 10)
    assert got.count() == 31 and got.where("part = 'dev'").count() == 10


def test_requests_and_citations(spark):
    x = spark.createDataFrame([("nonsense",), ('{"query": ""}',), ('{"query": "q", "k": 99}',), ('{"query": "q", "method": "?"}',), ('{"query": "q", "k": "x"}',), (None,)], "p string")
    got = x.select(serving.validate_request(F.col("p"), ["extractive"]).alias("r")).collect()
    assert [(r["r"]["status"], r["r"]["k"]) for r in got][2] == (200, 10) and [r["r"]["status"] for r in got] == [400, 400, 200, 400, 400, 400]
    c = spark.createDataFrame([("[id=a#p1]",), ("[2]",), ("a#p1 (scheme, lead)",), ("[9]",), (None,)], "raw string")
    ids = F.array(F.lit("a#p1"), F.lit("b#p2"))
    assert [r["x"] for r in c.select(serving.resolve_citation(F.col("raw"), ids).alias("x")).collect()] == ["a#p1", "b#p2", "a#p1", "9", ""]


def test_json_objects(spark):
    x = spark.createDataFrame([('so {"a": "}{", "b": {"c": 1}} end',), ("none",), (None,), ("{broken",)], "t string")
    assert [r["o"] for r in x.select(serving.extract_json_object("t").alias("o")).collect()] == ['{"a": "}{", "b": {"c": 1}}', None, None, None]


def test_jsonl(spark, tmp_path):
    lines = spark.createDataFrame([('{"id": "1", "more": 2}',), ("",), ("// remark",), ('{"id": "2", "n": 5}',)], "value string")
    got = parse_lines(lines, "id string, n int").orderBy("id").collect()
    assert [(r["id"], r["n"], r["unknown_fields"]) for r in got] == [("1", None, {"more": "2"}), ("2", 5, {})]
    with pytest.raises(Exception, match="no JSON object: .*oops"):
        parse_lines(spark.createDataFrame([("oops",)], "value string"), "id string").collect()
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n\noops\n')
    assert [(r["line_no"], r["line"]) for r in malformed(spark, str(tmp_path / "bad.jsonl")).collect()] == [(3, "oops")]
    with pytest.raises(Exception, match="bad.jsonl oops"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    assert read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string", strict=False).count() == 1
    assert read_jsonl(spark, str(tmp_path / "missing"), "id string").count() == 0
    assert write_jsonl(parse_lines(lines, "id string"), str(tmp_path / "out")) == 2
    assert read_jsonl(spark, str(tmp_path / "out"), "id string").count() == 2


def test_rate_limiter(spark):
    limits = serving.Limits(per_minute=2, per_day=3)
    times, accepted = [0, 1, 2, 61, 62, 86402], []
    want = [limits.decide(accepted, float(t)) for t in times]
    assert want == ["ok", "ok", "minute", "ok", "day", "ok"]
    x = spark.createDataFrame([(i, "v", t) for i, t in enumerate(times)], "request_id int, visitor string, t long").select("request_id", "visitor", F.timestamp_seconds("t").alias("ts"))
    assert [r["decision"] for r in serving.rate_limit(x, limits).orderBy("request_id").collect()] == want


def test_rate_limiter_stream(spark, tmp_path):
    times = [0, 1, 2, 61]
    x = spark.createDataFrame([(i, "v", t) for i, t in enumerate(times)], "request_id int, visitor string, t long").select("request_id", "visitor", F.timestamp_seconds("t").alias("ts"))
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    limited = rate_limit_stream(stream, serving.Limits(per_minute=2, per_day=9))
    # Time-outs by the clock keep such a query going, so the test waits for its rows, not for its end.
    q = limited.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.sql("select * from limited").count() < len(times):
            time.sleep(0.5)
    finally:
        q.stop()
    assert [r["decision"] for r in spark.sql("select * from limited order by request_id").collect()] == ["ok", "ok", "minute", "ok"]


def test_cut_survives(spark):
    assert cut(spark.range(10)).where("id > 4").count() == 5


def test_hosted_budget_is_one_for_all(spark):
    rows = [(i, f"v{i}", i * 10, i != 1) for i in range(5)]
    x = spark.createDataFrame(rows, "request_id int, visitor string, t long, hosted boolean").select("request_id", "visitor", F.timestamp_seconds("t").alias("ts"), "hosted")
    decide = lambda cap: [r["decision"] for r in serving.rate_limit(x, serving.Limits(hosted_per_day=cap), hosted="hosted").orderBy("request_id").collect()]
    assert decide(2) == ["ok", "ok", "ok", "budget", "budget"] and decide(9) == ["ok"] * 5
    assert serving.Limits.from_settings({"per_minute": "7", "per_day": "many"}).__dict__ == {"per_minute": 7, "per_day": 300, "hosted_per_day": 1000}


def test_lexical_store(spark, tmp_path):
    docs = spark.createDataFrame([("a", "river bridge toll"), ("b", "river ferry"), ("c", None)], "passage_id string, text string")
    asked = spark.createDataFrame([("q", "toll of the river bridge")], "id string, question string")
    index = LexicalIndex(docs)
    index.save(str(tmp_path / "index"))
    kept = LexicalIndex.load(spark, str(tmp_path / "index"))
    assert kept.bm25(asked).collect() == index.bm25(asked).collect() and kept.tfidf(asked).collect() == index.tfidf(asked).collect()


def test_vectors_are_kept_with_their_corpus(spark, tmp_path):
    docs = spark.createDataFrame([("a", "river bridge toll"), ("b", "river ferry"), ("c", "")], "passage_id string, text string")
    spec = dense.encoder("hash-64")
    first = dense.build_vectors(docs, str(tmp_path), spec)
    assert first.count() == 3 and dense.build_vectors(docs, str(tmp_path), spec).count() == 3
    more = docs.unionByName(spark.createDataFrame([("d", "toll")], docs.schema))
    assert dense.build_vectors(more, str(tmp_path), spec).count() == 4
    with pytest.raises(KeyError):
        dense.encoder("none")
    with pytest.raises(RuntimeError):
        dense.build_vectors(docs, str(tmp_path), dense.encoder("sentence-transformers/LaBSE"))

    class Lengths:
        def encode(self, texts):
            return [[len(t), 1.0] for t in texts]

    v = dense.encode(docs, Lengths(), dense.encoder("intfloat/multilingual-e5-base"), pid="passage_id", text="text").orderBy("pid").collect()
    assert round(v[2]["v"][0] / v[2]["v"][1]) == len("passage: ")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_dense_blocks_agree_with_all_at_once(spark, k):
    rng = random.Random(k)
    rows = [(f"p{i:03d}", [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(90)]
    x = spark.createDataFrame(rows, "pid string, v array<double>")
    asked = x.limit(7).withColumnRenamed("pid", "qid")
    whole = dense.dense_topk(asked, x, k).orderBy("qid", "rank").collect()
    assert dense.dense_topk(asked, x, k, cells=2048, max_query_rows=3).orderBy("qid", "rank").collect() == whole
    assert all(r["rank"] <= k for r in whole) and len(whole) == 7 * min(k, 90)


def test_medians_and_running_sums(spark):
    from pramana.operators.running import medians

    rng = random.Random(1)
    rows = [(g, rng.randint(0, 30) / 7.0) for g, n in (("a", 101), ("b", 40), ("c", 1)) for _ in range(n)]
    got = {r["g"]: r["median"] for r in medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert all(abs(got[g] - statistics.median(v for h, v in rows if h == g)) < 1e-9 for g in "abc")


def test_resampling(spark):
    x = spark.createDataFrame([("s", f"q{i}", float(i % 2)) for i in range(200)], "system string, qid string, value double")
    r = metrics.bootstrap_interval(x).first()
    assert r["mean"] == 0.5 and 0.40 < r["lo"] < 0.46 and 0.54 < r["hi"] < 0.60
    a, b = (spark.createDataFrame([(f"q{i}", float(v(i))) for i in range(60)], "qid string, value double") for v in (lambda i: 1, lambda i: i % 2))
    assert metrics.paired_randomization(a, b).first()["p_value"] == round(1 / 10001, 6)
    assert metrics.paired_randomization(a, a).first()["p_value"] == 1.0


def test_lookup_with_hot_keys(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k")).unionByName(spark.createDataFrame([(9999, None)], "id long, k string"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int")
    hot = frequent(left, "k", 10)
    assert [r["k"] for r in hot.collect()] == ["hot"]
    assert sorted(lookup(left, right, "k", hot).select("id", "v").collect()) == sorted(left.join(right, "k").select("id", "v").collect())
    outer = lookup(left, right, "k", hot, "left")
    assert outer.count() == left.count() and outer.where("v = 1").count() == left.where("k = 'hot'").count()
    assert frequent(left.limit(0), "k", 10).count() == 0


def test_places_in_random_order(spark):
    x = spark.createDataFrame([(f"i{n:04d}", None if n % 5 == 0 else "ab"[n % 2]) for n in range(500)], "id string, g string")
    got = dataset._numbered(x, ["g"], "id", 1)
    assert {(r["g"], r["n"], r["m"], r["d"]) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.max("rn").alias("m"), F.countDistinct("rn").alias("d")).collect()} == {(None, 100, 100, 100), ("a", 200, 200, 200), ("b", 200, 200, 200)}
