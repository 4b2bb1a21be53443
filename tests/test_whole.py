"""Searches ask every question, and find the same as a plain computation."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pramana.operators import dense, lexical, pipeline
from pramana.operators.lexical import LexicalIndex
from pramana.operators.postings import B, K1
from pramana.plans import registry
from pramana.plans.base import items

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_amount_tokens", "retrieve_hybrid", "retrieve_weighted", "answer_query"])
def test_every_question_is_asked(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    asked = {r["id"] for r in items(spark, DATA).select("id").collect()}
    assert {r["qid"] for r in registry.queries()[name](spark, DATA).select("qid").collect()} == asked


def test_amount_ablation_counts_every_question(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    gold = items(spark, DATA).where("answerable and size(gold_passage_ids) > 0").count()
    assert {r["n"] for r in registry.queries()["amount_ablation"](spark, DATA).where("slice = 'all'").collect()} == {gold}


def _plain(texts, questions, k):
    """BM25 of every pair."""
    docs = {p: t.split() for p, t in texts}
    average = sum(map(len, docs.values())) / len(docs)
    out = []
    for q, text in questions:
        found = []
        for p, words in docs.items():
            s = 0.0
            for w in set(text.split()):
                df = sum(w in x for x in docs.values())
                if tf := words.count(w):
                    s += max(np.log((len(docs) - df + 0.5) / (df + 0.5) + 1), 1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
            if round(s, 6) > 0:
                found.append((-round(s, 6), p))
        out += [(q, p, -s, r) for r, (s, p) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("most", [32_000_000, 3000])
def test_bm25_is_exact(spark, monkeypatch, most):
    """Words from very rare to everywhere, documents alike (ties), all postings at once and in parts."""
    monkeypatch.setattr(lexical, "MAX_SENT", most)
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.zipf(1.3)) % 300 + 10}"
    texts = [(f"p{i:04}", " ".join(word() for _ in range(rng.integers(1, 25)))) for i in range(700)]
    texts += [(f"r{i:04}", texts[i % 40][1]) for i in range(200)] + [("empty", "")]
    questions = [(f"q{i:03}", " ".join(word() for _ in range(rng.integers(1, 9)))) for i in range(120)] + [("none", "unheard"), ("blank", "")]
    index = LexicalIndex(spark.createDataFrame(texts, "passage_id string, text string").repartition(3))
    got = [tuple(r) for r in index.bm25(spark.createDataFrame(questions, "id string, question string"), 7).orderBy("qid", "rank").collect()]
    want = sorted(_plain(texts, questions, 7), key=lambda r: (r[0], r[3]))
    assert len(index._parts) == (1 if most > 3000 else 3)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)


def test_bm25_exchanges_nothing(spark):
    """Scores of pairs of a question and a document were exchanged, more than a disk holds."""
    docs = spark.createDataFrame([("a", "wheat loan"), ("b", "loan")], "passage_id string, text string")
    asked = spark.range(50).select(F.concat(F.lit("q"), "id").alias("id"), F.lit("wheat loan").alias("question"))
    found = LexicalIndex(docs).bm25(asked)
    assert found.count() == 100 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_null_ids_and_texts(spark):
    docs = spark.createDataFrame([("b", "wheat"), (None, "wheat"), ("c", None)], "passage_id string, text string")
    asked = spark.createDataFrame([("q", "wheat"), ("n", None)], "id string, question string")
    assert [(r["pid"], r["rank"]) for r in LexicalIndex(docs).bm25(asked).orderBy("rank").collect()] == [(None, 1), ("b", 2)]


@pytest.mark.parametrize("method", ["hybrid", "hybrid-rrf", "hybrid-weighted"])
def test_lists_made_in_tasks(spark, method):
    """Both lists and their fusion in one pass are those made as tables, with ties, other scripts, and questions without words."""
    rng = np.random.default_rng(9)
    word = lambda: ["w", "क"][int(rng.integers(2))] + str(int(rng.zipf(1.5)) % 60)
    rows = [(f"p{i:03}", None if i == 7 else " ".join(word() for _ in range(rng.integers(0, 12))), ["en", "hi"][i % 2]) for i in range(150)]
    p = spark.createDataFrame([*rows, *[(f"r{i:03}", rows[i][1], rows[i][2]) for i in range(30)]], "passage_id string, text string, lang string")
    asked = spark.createDataFrame([(f"q{i:02}", " ".join(word() for _ in range(rng.integers(1, 6)))) for i in range(40)] + [("none", "unheard"), ("null", None), ("blank", "")], "id string, question string")
    encode = lambda q: dense.hash_vectors(q, pid="id", text="question").withColumnRenamed("pid", "qid")
    found = []
    for hashed in (True, False):
        r = pipeline.Retrievers(LexicalIndex(p), dense.hash_vectors(p), encode, pipeline.passage_scripts(p), hashed=hashed)
        x = pipeline.retrieve(asked, r, method=method, candidates=20)
        assert ("Join" not in x._jdf.queryExecution().executedPlan().toString()) == hashed
        found.append([tuple(t) for t in x.orderBy("qid", "rank").collect()])
    assert [(a, b, d) for a, b, _, d in found[0]] == [(a, b, d) for a, b, _, d in found[1]]
    assert np.allclose([t[2] for t in found[0]], [t[2] for t in found[1]], atol=1e-9)
