"""From questions to answers, arms, replies, reviews and generated questions, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from pramana.operators import answerability, arms, corpus, dense, generation, pipeline, replies, review
from pramana.operators.lexical import LexicalIndex


@pytest.fixture
def passages(spark):
    rows = [
        ("r#p0", "r", "river", "en", "Tolls", "The ferry toll is Rs. 40 for each boat. Children cross free."), ("r#p1", "r", "river", "hi", "Tolls", "नाव का शुल्क 40 रुपये है। बच्चे मुफ़्त जाते हैं।"),
        ("b#p0", "b", "bridge", "en", "", "The bridge opens at six and closes at ten."), ("b#p1", "b", "bridge", "en", "Notes", None),
    ]
    return spark.createDataFrame(rows, "passage_id string, doc_id string, scheme string, lang string, section_path string, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([("q1", "How much is the ferry toll?"), ("q2", "When does the bridge open?"), ("q3", "zebra"), ("q4", None)], "id string, question string")


def tools(passages, **more):
    vectors = dense.hash_vectors(passages)
    return pipeline.Retrievers(LexicalIndex(passages), vectors, lambda q: dense.hash_vectors(q, pid="id", text="question").withColumnRenamed("pid", "qid"), **more)


def test_methods(spark, passages, asked):
    r = tools(passages, scripts=pipeline.passage_scripts(passages))
    for method in pipeline.METHODS:
        top = {x["qid"]: x["pid"] for x in pipeline.retrieve(asked, r, method=method).where("rank = 1").collect()}
        assert top["q1"] == "r#p0" and top["q2"] == "b#p0", method
    lexical = pipeline.Retrievers(r.lexical)
    assert pipeline.retrieve(asked, lexical).collect() == r.lexical.bm25(asked, 5).collect()
    plain = pipeline.retrieve(asked, pipeline.Retrievers(r.lexical, r.vectors, r.encode)).collect()
    assert plain == pipeline.retrieve(asked, r, method="hybrid-rrf").collect()
    with pytest.raises(ValueError):
        pipeline.retrieve(asked, r, method="none")
    with pytest.raises(RuntimeError):
        pipeline.retrieve(asked, lexical, method="dense")
    with pytest.raises(RuntimeError):
        pipeline.retrieve(asked, pipeline.Retrievers(), method="bm25")


def test_answers_and_refusals(spark, passages, asked):
    r = pipeline.Retrievers(LexicalIndex(passages))
    got = {x["qid"]: x for x in pipeline.answer(asked, passages, r).collect()}
    assert got["q1"]["answerability"] == "ANSWERABLE" and "Rs. 40" in got["q1"]["answer"] and got["q1"]["citations"][0]["passage_id"] == "r#p0" and got["q1"]["answer_lang"] == "en"
    assert got["q3"]["answerability"] == got["q4"]["answerability"] == "UNANSWERABLE" and got["q3"]["answer"] == replies.REFUSAL and got["q3"]["citations"] is None and got["q3"]["confidence"] == 1.0
    floor = {x["qid"]: x for x in pipeline.answer(asked, passages, r, bm25_floor=1e6).collect()}
    assert all(x["answerability"] == "UNANSWERABLE" for x in floor.values()) and floor["q1"]["retrieval"]["bm25_top"] > 0 and floor["q1"]["citations"]
    assert pipeline.answer(asked, passages, r, tau=1e6).where("answerability = 'ANSWERABLE'").count() == 0
    assert pipeline.answer(asked.limit(0), passages, r).count() == 0


@pytest.mark.parametrize(
    "reply,says,answer",
    [
        ('x {"answer": " six ", "citation": "b#p0", "confidence": 0.5} y', True, "six"), ('{"answerable": false, "answer": "six"}', False, None), ('{"answerable": "false", "answer": "six"}', True, "six"), ('{"answerable": 0, "answer": "six"}', False, None),
        ('{"answerable": null, "answer": "six"}', False, None), ('{"answerable": [], "answer": "six"}', False, None), ('{"answer": ""}', False, None), ("no object", False, None), ('{"answer": ', False, None), (None, False, None), ('{"answer": "' + replies.REFUSAL.upper() + '"}', False, None),
    ],
)
def test_grounding(spark, reply, says, answer):
    g = spark.createDataFrame([(reply,)], "r string").select(replies.grounded(F.col("r"), F.array(F.lit("b#p0"), F.lit("r#p0"))).alias("g")).first()["g"]
    assert g["answerable"] == says and g["answer"] == (answer or replies.REFUSAL)


def test_reply_forms(spark):
    x = spark.createDataFrame([('{"question": "Who rows?", "answer": "Ina"}',), ('{"answer": "Ina"}',), ("English: Who rows?\nmore",), ('"Who rows?"',), ("  ",), (None,)], "r string")
    assert [r["p"] and (r["p"]["question"], r["p"]["kind"]) for r in x.select(replies.parse_reply(F.col("r")).alias("p")).collect()] == [("Who rows?", "fact")] + [None] * 5
    assert [r["t"] for r in x.select(replies.parse_translation(F.col("r")).alias("t")).collect()] == ["Who rows?", '{"answer": "Ina"}', "Who rows?", "Who rows?", None, None]
    p = spark.createDataFrame([("[1] id=a#p1 (s, lead)\ntext\n\n[2] id=b#p2 (s, x)\ntext\n\nQuestion: Who rows? \n",)], "p string").select(replies.parse_prompt(F.col("p")).alias("p")).first()["p"]
    assert (p["question"], p["ids"]) == ("Who rows?", ["a#p1", "b#p2"])
    n = spark.range(1).select(replies.nli_label(F.lit(0.3), F.lit(0.3), F.lit(0.2)).alias("a"), replies.slugify(F.lit("x/y:z")).alias("s")).first()
    assert (n["a"], n["s"]) == ("entailment", "x__y_z")


def test_replies_are_asked_for_once(spark, tmp_path):
    class Echo:
        name = "echo"

        def complete(self, prompts):
            with open(tmp_path / "asked", "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            return [p.upper() for p in prompts]

    cache = replies.ReplyCache(str(tmp_path / "kept"))
    first = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k1", "a")], "key string, prompt string")
    assert {(r["key"], r["reply"]) for r in cache.complete(first, Echo()).collect()} == {("k1", "A"), ("k2", "B")}
    more = spark.createDataFrame([("k2", "b"), ("k3", "c")], "key string, prompt string")
    assert {(r["key"], r["reply"]) for r in cache.complete(more, Echo()).collect()} == {("k2", "B"), ("k3", "C")}
    assert sorted((tmp_path / "asked").read_text().split()) == ["a", "b", "c"]


def test_arms(spark, passages):
    items = spark.createDataFrame([("i1", "Rs. 40", None, ["r#p0"]), ("i2", "at six", "", ["gone#p0"]), ("i3", None, None, None)], "id string, answer_gold string, answer_gold_hi string, gold array<string>").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    p = passages.select(F.col("passage_id").alias("pid"), "text")
    found = spark.createDataFrame([("i1", "b#p0", 1), ("i1", "r#p0", 2), ("i2", "b#p0", 1)], "id string, pid string, rank int")
    gold = arms.contexts(arms.ARMS["D"], items, p)
    assert {(r["id"], tuple(r["context"])) for r in gold.collect()} == {("i1", ("r#p0",))}
    c = arms.contexts(arms.ARMS["C"], items, p, found)
    assert {(r["id"], tuple(r["context"])) for r in c.collect()} == {("i1", ("b#p0", "r#p0")), ("i2", ("b#p0",)), ("i3", ())}
    with pytest.raises(ValueError):
        arms.contexts(arms.ARMS["B"], items, p)
    said = spark.createDataFrame([("i1", json.dumps({"answer": "Rs 40", "citation": "[2]"})), ("i2", json.dumps({"answer": "at seven", "citation": "made#up"}))], "id string, reply string")
    g = arms.generations(arms.ARMS["C"], c, said).unionByName(arms.generations(arms.ARMS["D"], gold, spark.createDataFrame([("i1", json.dumps({"answer": "40 rupees", "citation": "r#p0"}))], "id string, reply string")))
    s = {(r["id"], r["arm"]): r for r in arms.score(g, items, p).collect()}
    assert s["i1", "C"]["em"] == 1.0 and s["i1", "C"]["cited_found"] and not s["i2", "C"]["cited_found"] and s["i2", "C"]["cited"] and s["i3", "C"]["abstained"] and s["i3", "C"]["f1"] == 0.0
    rep = {r["arm"]: r for r in arms.report(arms.score(g, items, p)).collect()}
    assert rep["C"]["n"] == 3 and rep["C"]["fabricated"] == 0.5 and rep["C"]["entailed"] is None and rep["D"]["fabricated"] == 0.0
    d = arms.decomposition(arms.score(g, items, p)).first()
    assert (d["n"], d["dropped"], d["system_f1"]) == (1, 2, 1.0) and abs(d["retrieval_error"] + d["generation_error"]) < 1e-9


def test_best_over_golds(spark):
    x = spark.createDataFrame([(["", None, "aa", "a"],), ([],), (None,)], "g array<string>").select(arms.best_over_golds(F.length, F.col("g")).alias("b"))
    assert [r["b"] for r in x.collect()] == [2.0, 0.0, 0.0]


def test_signals(spark):
    x = spark.createDataFrame([(True, 0.9, True), (True, 0.2, False), (False, 1.0, False), (None, None, False)], "said boolean, confidence double, answerable boolean")
    fit = answerability.fit_cut(x.select(answerability.self_report(F.col("said"), F.col("confidence")).alias("score"), "answerable"), grid=20).first()
    assert (fit["tau"], fit["f1"]) == (0.25, 1.0)
    y = spark.createDataFrame([(0.8, False, True), (None, False, False), (0.9, True, False)], "e double, abstained boolean, answerable boolean")
    assert answerability.fit_cut(y.select(answerability.entailment(F.col("e"), F.col("abstained")).alias("score"), "answerable")).first()["f1"] == 1.0


def test_review(spark, passages):
    rows = [
        ("a", "Toll?", "en", True, ["r#p0"], "Rs. 40 for each boat", None), ("b", "What does this passage say of the toll?", "en", True, ["r#p1"], "forty rupees (", None), ("c", "What does THIS passage say of the toll!", "hi", False, ["r#p0"], "", None), ("d", None, None, True, None, None, None),
        ("e", "The bridge opens at six and closes at ten", "en", True, ["b#p0"], "it opens at six and", None),
    ]
    x = spark.createDataFrame(rows, "id string, question string, query_lang string, answerable boolean, gold_passage_ids array<string>, answer_gold string, answer_gold_hi string")
    got: dict[str, set] = {}
    for r in review.review(x, passages).collect():
        got.setdefault(r["id"], set()).add(r["finding"])
    assert got == {"a": {"placeholder"}, "b": {"not-standalone", "missing-hindi", "answer-unsupported", "answer-truncated", "duplicate"}, "c": {"not-standalone", "language-mismatch", "inconsistent", "duplicate"}, "d": {"placeholder", "inconsistent"}, "e": {"answer-truncated", "high-overlap"}}
    notes = spark.createDataFrame([("a", "fix", ["short"], "What is the toll?", " ", None)], "id string, verdict string, issues array<string>, suggested_question string, suggested_answer string, suggested_answer_hi string")
    merged = {r["id"]: r for r in review.merge_notes(x, review.review(x, passages), notes, reviewed_by="ina").collect()}
    assert (merged["a"]["verdict"], merged["a"]["reviewed_by"]) == ("fix", "ina") and merged["b"]["verdict"] is None
    with pytest.raises(Exception, match="unknown verdict"):
        review.merge_notes(x, review.review(x, passages), notes.withColumn("verdict", F.lit("maybe")), reviewed_by="ina").collect()
    taken = {r["id"]: r for r in review.take_suggestions(x, notes).collect()}
    assert taken["a"]["question"] == "What is the toll?" and taken["a"]["changed"] == ["question"] and taken["e"]["changed"] == []
    p = review.progress(spark.createDataFrame([(True, None), (False, "REJECTED: no"), (False, "")], "verified boolean, notes string")).first()
    assert (p["total"], p["verified"], p["rejected"], p["remaining"]) == (3, 1, 1, 1)


def test_error_cases_take_each_failure_once(spark):
    failures = spark.createDataFrame([(f"f{i}", float(i)) for i in range(6)], "id string, confidence double")
    tags = spark.createDataFrame([(f"f{i}", c) for i in range(6) for c in ("code-mixing", "amount")] + [("other", "date")], "id string, category string")
    got = [(r["category"], r["id"], r["place"]) for r in review.error_cases(failures, tags).collect()]
    assert got == [("code-mixing", "f5", 1), ("code-mixing", "f4", 2), ("amount", "f3", 1), ("amount", "f2", 2)]


def test_generated_questions(spark):
    text = "नाव का शुल्क चालीस रुपये है " * 20
    p = spark.createDataFrame([(f"d{i}#p0", f"s{i % 2}", lang, "Tolls", text if lang == "hi" else "the ferry toll is forty rupees and boats wait " * 10) for i in range(8) for lang in ("en", "hi")], "passage_id string, scheme string, lang string, section_path string, text string").withColumn("passage_id", F.concat("passage_id", F.lit("-"), "lang"))

    def complete(prompts):
        made = F.when(F.col("prompt").startswith("Translate to Hindi"), '{"question": "नाव का शुल्क कितना है और कब तक"}').when(F.col("prompt").contains("शुल्क"), '{"question": "नाव का शुल्क कितना होता है", "answer": "चालीस रुपये"}').otherwise('{"question": "What is the ferry toll?", "answer": "forty rupees"}')
        return prompts.select("key", made.alias("reply"))

    got = generation.candidates(p, complete, quotas=[("en", "en", 2), ("hi", "en", 2), ("hinglish", "hi", 3)]).collect()
    assert sorted((r["query_lang"], r["passage_lang"]) for r in got) == [("en", "en")] * 2 + [("hi", "en")] * 2 + [("hinglish", "hi")] * 3
    assert len({r["passage_id"] for r in got}) == 7 and all(r["question"].isascii() for r in got if r["query_lang"] == "hinglish")


def test_unanswerable(spark, passages):
    titles = spark.createDataFrame([("river", "en", "River Ferry"), ("river", "hi", "नदी नाव"), ("bridge", "en", "Old Bridge")], "scheme string, lang string, title string")
    got = generation.build_unanswerable(passages, titles, quotas=[("out-of-scope", 3), ("near-miss", 4)]).collect()
    assert len(got) == 7 and all((r["scheme"] == "") == (r["unanswerable_class"] == "out-of-scope") for r in got) and all(r["distractor"] for r in got if r["scheme"]) and not any("{scheme}" in r["question"] for r in got)


def test_reanchored_items(spark):
    items = spark.createDataFrame([("i", ["a", "b", "a"], True, None), ("j", ["c"], True, "seen")], "id string, gold_passage_ids array<string>, verified boolean, notes string")
    changes = spark.createDataFrame([("i", "a", "moved", "n"), ("i", "b", "contained", "n"), ("j", "c", "unchanged", "c")], "id string, passage_id string, status string, new_id string")
    got = {r["id"]: (r["gold_passage_ids"], r["verified"], r["notes"]) for r in corpus.apply_reanchor(items, changes, version=3).collect()}
    assert got == {"i": (["n"], False, "reanchored to segmentation v3: contained"), "j": (["c"], True, "seen")}


def test_server(spark, passages):
    import threading
    import urllib.request
    from http.server import ThreadingHTTPServer

    from pramana import server
    from pramana.operators.serving import Limits

    system = server.load_system(passages)
    assert system.notes and system.ask('{"query": "How much is the ferry toll?"}')[1]["answerability"] == "ANSWERABLE"
    assert system.ask('{"query": ""}')[0] == 400 and system.ask('{"query": "toll", "generator": "x"}')[0] == 400
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), server.make_handler(system, "/nonexistent", gate=server.Gate(Limits(per_minute=1))))
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{httpd.server_port}"
        assert json.load(urllib.request.urlopen(at + "/api/health"))["ok"]
        ask = lambda: urllib.request.urlopen(urllib.request.Request(at + "/api/ask", data=b'{"query": "ferry toll"}'))
        assert json.load(ask())["citations"]
        for call, code in ((ask, 429), (lambda: urllib.request.urlopen(at + "/../etc/passwd"), 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                call()
            assert e.value.code == code
    finally:
        httpd.shutdown()


def test_chat_completions_ask_again(monkeypatch):
    import io
    import urllib.error

    from pramana.sources import providers

    calls = []

    def open_url(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 429, "busy", {"Retry-After": "3"}, None)
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": " six "}}]}).encode())

    waits = []
    monkeypatch.setattr(providers.urllib.request, "urlopen", open_url)
    monkeypatch.setattr(providers.time, "sleep", waits.append)
    assert providers.ChatCompletions(base_url="http://x/", model="m", api_key="k").complete(["When?"]) == ["six"]
    assert calls == ["http://x/chat/completions"] * 2 and waits == [3.0]
    with pytest.raises(providers.ProviderError):
        providers.ChatCompletions(base_url="http://x", model="m", api_key="")
    assert providers.CrossEncoderNLI("none").score([("", "x")]) == [(0.0, 1.0, 0.0)]


def test_sources(spark, tmp_path):
    import io

    from pramana.sources import pairs, reports

    tries = []

    def open_url(address, timeout):
        tries.append(address)
        return io.BytesIO(b"no json" if len(tries) < 3 else b'{"ok": 1}')

    waits = []
    assert pairs.get_json("http://x", {"a": "b"}, open_url=open_url, sleep=waits.append) == {"ok": 1} and waits == [0.75, 1.5]
    schemes = spark.createDataFrame([("s1", "A", "c"), ("s2", "B", "c"), ("s3", "C", "c")], "scheme string, en_title string, category string")
    pages = spark.createDataFrame([("A", "A1", "अ"), ("B", "B", None), ("C", None, None)], "asked string, title string, other_title string")
    resolved, missing, unpaired = pairs.resolve_pairs(schemes, pages)
    assert [r["title"] for r in resolved.collect()] == ["A1"] and [r["scheme"] for r in missing.collect()] == ["s3"] and [r["scheme"] for r in unpaired.collect()] == ["s2"]
    docs = spark.createDataFrame([("s1", "en", "x" * 500), ("s1", "hi", "y" * 600), ("s2", "en", "x" * 900), ("s2", "hi", "short")], "scheme string, lang string, text string")
    assert {r["scheme"] for r in pairs.keep_pairs(docs).collect()} == {"s1"}
    said = []
    stages = reports.run_all(str(tmp_path / "out"), {"docs": lambda: docs.groupBy("scheme").count().orderBy("scheme"), "bad": lambda: docs.select("none")}, said.append)
    assert stages[0].lines == 5 and stages[1].skipped and (tmp_path / "out" / "report-docs.txt").read_text() == "\n".join(said) + "\n"
    (tmp_path / "a.json").write_text('{"n": 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert [(r["file"], r["n"]) for r in reports.read_json_documents(spark, str(tmp_path), "n int").collect()] == [("a.json", 1)]
    assert reports.read_json_documents(spark, str(tmp_path / "none"), "n int").count() == 0
    one = reports.content_hash(docs, ["scheme", "lang"])
    assert reports.content_hash(docs.repartition(7), ["scheme", "lang"]) == one != reports.content_hash(docs.limit(3), ["scheme", "lang"])


def test_entailments_are_scored_once(spark, tmp_path):
    class Words:
        name = "words"

        def score(self, pairs):
            with open(tmp_path / "scored", "a") as f:
                f.write("x" * len(pairs))
            return [(float(h in p), 0.5, 0.0) for p, h in pairs]

    x = spark.createDataFrame([(1, "the boat is red", "red"), (2, "the boat is red", "blue"), (3, "the boat is red", "red"), (4, None, "red")], "n int, premise string, hypothesis string")
    cache = replies.ReplyCache(str(tmp_path / "nli"))
    for _ in range(2):
        assert [(r["n"], r["label"]) for r in replies.entailments(x, cache, Words()).orderBy("n").collect()] == [(1, "entailment"), (2, "neutral"), (3, "entailment"), (4, "neutral")]
    assert (tmp_path / "scored").read_text() == "xxx"
