"""The llm operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pramana.llm import alignment, consensus, encoding, language, mixing, overlap, pairs, quality, rank_fusion, registry, sentences


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


# 1


def votes(spark, data):
    return spark.createDataFrame(data, "id string, annotator string, label int")


def test_consensus_outvotes_spammers(spark):
    rng = random.Random(1)
    truth = {f"i{i}": rng.randint(0, 1) for i in range(120)}
    data = []
    for i, t in truth.items():
        data += [(i, f"good{a}", t if rng.random() < 0.93 else 1 - t) for a in range(3)] + [(i, f"bad{a}", rng.randint(0, 1)) for a in range(4)] + [(i, "liar", 1 - t)]
    items, annotators = consensus.MinimaxConsensus().fit(votes(spark, data))
    got = {r["id"]: r["label"] for r in items.collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 112
    rel = {r["annotator"]: r["reliability"] for r in annotators.collect()}
    assert rel["good0"] > 0.85 > 0.7 > rel["bad0"] and rel["liar"] < 0.3
    joined, _ = consensus.MinimaxConsensus(max_driver_annotators=2, passes=3).fit(votes(spark, data[:400]))
    sent, _ = consensus.MinimaxConsensus(passes=3).fit(votes(spark, data[:400]))
    assert {(r["id"], r["label"]) for r in joined.collect()} == {(r["id"], r["label"]) for r in sent.collect()}


def test_consensus_edges(spark):
    items, annotators = consensus.MinimaxConsensus().fit(votes(spark, []))
    assert items.count() == 0 and annotators.count() == 0
    items, _ = consensus.MinimaxConsensus().fit(votes(spark, [("x", "a", 1), ("y", "a", 0), ("y", "b", 1)]))
    assert {r["id"]: r["agreement"] for r in items.collect()} == {"x": None, "y": 0.0}


def test_latest_votes_and_names(spark):
    names = spark.createDataFrame([("ann_01 ",), ("human:ANN-01",), ("model:PASS-A",), ("model:pass-a (blind)",), (" ",), (None,)], "n string")
    assert [r["k"] for r in names.select(consensus.annotator_key(F.col("n")).alias("k")).collect()] == ["ann-01", "ann-01", "model:pass-a", "model:pass-a", None, None]
    x = spark.createDataFrame([("i", "a", 1, 5, 1), ("i", "a", 0, 9, 2), ("i", "a", None, 11, 3), ("i", "b", 1, None, None), (None, "a", 1, 1, 1), ("i", None, 1, 1, 1)], "id string, annotator string, label int, t long, seq long")
    assert rows(consensus.latest_votes(x.withColumn("at", F.timestamp_seconds("t"))), "annotator") == [("i", "a", 0), ("i", "b", 1)]


# 2


@pytest.fixture(scope="module")
def filters(spark):
    english = ["the school of the village is open for all children", "what is the name of the office in this town", "payments are made by the bank within ten days", "no fee is due from the families below the line"]
    hindi = ["गांव का विद्यालय सभी बच्चों के लिए खुला है", "इस नगर में कार्यालय का नाम क्या है", "भुगतान बैंक द्वारा दस दिनों में किया जाता है", "परिवारों से कोई शुल्क नहीं लिया जाता है"]
    roman = ["gaon ka school sabhi bachcho ke liye khula hai", "is nagar mein office ka naam kya hai", "bhugtan bank se das din mein kiya jata hai", "parivaro se koi shulk nahi liya jata hai"]
    bengali = ["গ্রামের বিদ্যালয় সব শিশুর জন্য খোলা", "এই শহরে অফিসের নাম কি"]
    data = [(t, lang) for lang, ts in (("en", english), ("hi", hindi), ("hinglish", roman), ("bn", bengali)) for t in ts] + [("the bank is in the town", "hi"), (None, "en"), ("", "en")]
    return language.fit_filters(spark.createDataFrame(data, "text string, lang string"), bits=16)


def test_languages(spark, filters):
    got = [x[0] for x in filters.detect(["the name of the village school", "गांव का नाम क्या है", "gaon ka naam kya hai", "গ্রামের নাম কি", "गांव का school कहां है", "12 -- ?", "", None])]
    assert got == ["en", "hi", "hinglish", "bn", "hinglish", None, None, None]


def test_segments(spark, filters):
    x = spark.createDataFrame([("a", "What is the name of the school? गांव का नाम क्या है? इस नगर में कार्यालय है।", 1), ("b", None, 2), ("c", "the school of the village " * 5000, 3), ("a", "the bank", 4)], "id string, text string, lang int")
    got = language.detect_segments(x, filters)
    assert [r[:3] for r in rows(got.where("id = 'a' and seg_no > 0"), "seg_no")] == [("a", 1, "en"), ("a", 2, "hi")]
    assert [r[1:4] for r in rows(got.where("id = 'b'"))] == [(0, None, 0.0)] and rows(got.where("id = 'c'"))[0][2] == "en"
    assert language.detect_segments(x.limit(0), filters).count() == 0


def test_language_names(spark):
    x = spark.createDataFrame([("EN",), ("hi-IN",), (" hinglish ",), ("hi-en",), ("und",), ("?",), ("",), (None,), ("as",)], "l string")
    assert [r["n"] for r in x.select(language.language_name(F.col("l")).alias("n")).collect()] == ["en", "hi", "hinglish", "hinglish", None, None, None, None, "other"]


# 3


def test_pair_rules():
    q = "Which office pays Rs. 3,500 in Kepur since 2001?"
    assert pairs.is_copy(q, "A: which office pays rs 3,500 in kepur since 2001") and not pairs.is_copy(q, "the block office") and not pairs.is_copy(None, None)
    assert all(map(pairs.is_empty, [None, "", " \n", "—", "N/A", "nil", "[]", "​", "null"])) and not pairs.is_empty("no") and not pairs.is_empty("5")
    refused = ["Sorry - the evidence does not say.", "I'm sorry, but I can't answer this.", "Cannot be determined from the given context.", "उपलब्ध दस्तावेज़ों में पर्याप्त जानकारी नहीं है।", "क्षमा करें, मैं उत्तर नहीं दे सकता।"]
    fine = ["The bank is unable to charge a fee.", "Applicants who hold a licence cannot apply again.", "No fee is due from families.", "शुल्क माफ़ी की सूचना नहीं पहुंची।"]
    assert all(map(pairs.is_refusal, refused)) and not any(map(pairs.is_refusal, fine))


def test_pairs(spark, filters):
    whole = [f"the bank is open within {i} days of the town order." for i in range(30)]
    data = [(f"w{i}", "f", "what is the name", t, "en") for i, t in enumerate(whole)]
    data += [("cut", "f", "q", "the bank is open within 77 days of the", "en"), ("nostop", "f", "q", "the bank is open within 5 days of the town order", "en"), ("lang", "f", "q", "गांव का नाम क्या है", "en"), ("null", "f", None, None, None), ("comma", "f", "q", "the bank is open within,", "en")]
    got = pairs.PairChecker(filters).check(spark.createDataFrame(data, "id string, answer_field string, question string, answer string, lang string").withColumn("broken", F.lit(1)))
    assert {(r["id"], r["defect"]) for r in got.collect()} == {("cut", "truncated"), ("lang", "wrong_language"), ("null", "empty"), ("comma", "truncated")}


def test_prefix_weights_against_brute_force(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))) for _ in range(80)})
    weights = {k: rng.randint(1, 5) for k in keys}
    asked = sorted({k[: rng.randint(1, len(k))] for k in keys} | {"zz"})
    got = pairs.prefix_weights(spark.createDataFrame(list(weights.items()), "s string, n long"), spark.createDataFrame([(a,) for a in asked], "q string"))
    assert {r["q"]: r["longer"] for r in got.collect()} == {a: sum(w for k, w in weights.items() if k.startswith(a) and k != a) for a in asked}


# 4


def test_overlap(spark):
    base = [(f"n{i}", f"What was paid in 20{i:02d} to the families of Kepur?", "train", "s") for i in range(20)]
    data = base + [
        ("t", "Which office pays Rs. 3,500 to families in Kepur?", "Train ", "s"), ("e1", "which office pays ₹3500/- to the families in KEPUR", "dev", "x"), ("e2", "Q3. Please tell me, in Kepur which ofifce pays Rs 3,500 to families?", "TEST", "x"),
        ("e3", "Which office pays Rs. 4,500 to families in Kepur?", "test", "x"), ("e4", "Which office pays Rs. 3,500 to families in Kepur?", None, "x"), ("e5", None, "dev", "x"), ("e6", "", "dev", None),
    ] + [(f"p{i}", "the office said so", "train", "s") for i in range(3)]
    x = spark.createDataFrame(data, "id string, text string, split string, source string")
    got = overlap.SplitOverlap().pairs(x)
    assert {(r["train_id"], r["eval_id"]) for r in got.collect()} == {("t", "e1"), ("t", "e2")}
    report = {(r["split"], r["source"]): (r["items"], r["overlapping"], r["near"]) for r in overlap.SplitOverlap().report(x).collect()}
    assert report[("dev", "x")] == (2, 1, 1) and report[("test", "x")][1:] == (1, 1) and report[("dev", None)] == (1, 0, 0)
    assert overlap.SplitOverlap().pairs(x.limit(0)).count() == 0


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Does the centre pay the state?", "Does the state pay the centre?", False),
        ("Does the state government pay the district council?", "Does the district council pay the state government?", False),
        ("moved from Agra to Delhi", "moved from Delhi to Agra", False),
        ("Under the plan of 2004, who pays the fee in Kepur?", "Who pays the fee in Kepur under the plan of 2004?", True),
        ("After 2004, is the fee waived by Rovi Nidhi for poor weavers in Kepur?", "Is the fee waived for poor weavers in Kepur by Rovi Nidhi after 2004?", True),
    ],
)
def test_clauses_may_move_but_not_change_parts(spark, a, b, same):
    tokens = [overlap.canonical_tokens(t) for t in (a, b)]
    assert overlap.same_clauses(*tokens) == same
    x = spark.createDataFrame([("a", a, "train", "s"), ("b", b, "dev", "s")], "id string, text string, split string, source string")
    assert overlap.SplitOverlap().pairs(x).count() == same


def test_many_slips_and_copies(spark):
    """A slip seen three times beside twenty right words; six slips in one record; hundreds of copies on both sides."""
    words = "sanctioned committee district allowance monthly beneficiary".split()
    text = " ".join(words) + " of Kepur"
    slips = " ".join(w[:2] + w[3:] for w in words) + " of Kepur"
    other = [(f"o{i}", f"{w} number {i}", None, "s") for i in range(20) for w in words]
    rare = [(f"r{i}", f"sanctoned number 7{i}", None, "s") for i in range(3)]
    data = [(f"t{i}", text, "train", "s") for i in range(150)] + [(f"e{i}", text.upper(), "test", "x") for i in range(50)] + [("far", slips, "dev", "y"), ("one", text.replace("sanctioned", "sanctoned"), "dev", "y")]
    x = spark.createDataFrame(data + other + rare, "id string, text string, split string, source string")
    got = overlap.SplitOverlap().pairs(x)
    assert {(r["split"], r["exact"], r["count"]) for r in got.groupBy("split", "exact").count().collect()} == {("test", True, 150 * 50), ("dev", False, 300)}
    report = {r["split"]: (r["items"], r["overlapping"], r["same"], r["near"], r["pairs"]) for r in overlap.SplitOverlap().report(x).collect()}
    assert report == {"test": (50, 50, 50, 0, 7500), "dev": (2, 2, 0, 2, 300)}


@pytest.mark.parametrize("a,b,slip", [("before", "bfeore", True), ("share", "shere", True), ("yearly", "yearrly", True), ("suta", "sunta", True), ("cat", "cat", False), ("cat", "dog", False), ("ab", "ba", True), ("abcd", "abdcx", False)])
def test_one_slip(a, b, slip):
    assert overlap.one_slip(a, b) is slip and overlap.one_slip(b, a) is slip


# 5


@pytest.fixture(scope="module")
def model(spark):
    lines = []
    for i, c in enumerate("ABCDEFGHJKLM" * 4):
        own = [f"Dr. {c}. Fibari led the committee in {1980 + i}.", f"Rs. {i},250 is paid by the Govt. office.", "Does it help?", "The rule holds.", "It may ask for a card, etc."]
        lines.append(" ".join(own[i % 5 :] + own[: i % 5]))
    lines += [f"रु. {i},000 से ऊपर के ऋण पर ब्याज लगता है। डॉ. ल. शोकारी ने समिति बनाई। क्या यह सही है?" for i in range(40)]
    return sentences.train(spark.createDataFrame([(t,) for t in lines], "text string"))


def test_units(model):
    text = "Dr. B. Fibari led the committee in 1999. Rs. 7,250 is paid by the Govt. office.The rule holds.\n- first item\n• second item. more\n\nDoes it help? The rule\nholds; it does."
    assert [u for _, u in model.split(text)] == ["Dr. B. Fibari led the committee in 1999.", "Rs. 7,250 is paid by the Govt. office.", "The rule holds.", "first item", "second item. more", "Does it help?", "The rule\nholds; it does."]
    assert all(text[s : s + len(u)] == u for s, u in model.split(text))
    assert [u for _, u in model.split("डॉ. ल. शोकारी ने समिति बनाई। रु. 5,000 से ऊपर ब्याज लगता है।")] == ["डॉ. ल. शोकारी ने समिति बनाई।", "रु. 5,000 से ऊपर ब्याज लगता है।"]
    assert [u for _, u in model.split("是否需要？主任说「名单将公布。」随后离开。第4.4条规定。")] == ["是否需要？", "主任说「名单将公布。」随后离开。", "第4.4条规定。"]
    assert model.starts(None) == model.starts("  \n ") == model.starts("---") == [] and len(model.starts("a b. " * 20000)) >= 1


def test_units_of_all_texts(spark):
    word = F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    m = sentences.train(spark.range(20_500).select(word.alias("text")))
    assert len(m.ends) == 20_501  # and one for all other words


def test_units_table(spark, model):
    x = spark.createDataFrame([("p", "One holds. Two holds.", 1), ("p", "One holds. Two holds.", 2), ("n", None, 3)], "passage_id string, text string, start_pos int")
    assert [r[1] for r in rows(sentences.sentence_units(x, model).where("passage_id = 'p'"), "start_pos")].count(0) == 2
    assert sentences.sentence_units(x.limit(0), model).count() == 0 and sentences.train(x.limit(0)).starts("A b. C d.") != []


# 6


def test_ranking(spark):
    data = [("q", f"p{i}", m, s * (6 - i), i, {}) for i in range(1, 6) for m, s in (("big", 1e6), ("small", 1e-6), ("third", 1.0))]
    data += [("q", "odd", "big", 1e12, None, {}), ("q", "p1", "big", 5e6, 1, {}), ("q", "p9", "map", None, None, {"map": 3.0}), ("q", "nan", "third", float("nan"), 6, {}), ("none", "x", "big", None, None, {}), (None, "x", "big", 1.0, 1, {})]
    x = spark.createDataFrame(data, "query_id string, passage_id string, method_name string, score double, rank_no int, component_scores map<string,double>").withColumn("loaded_at", F.current_timestamp()).withColumn("fused", F.lit(1))
    got = rank_fusion.normal_score_ranking(x)
    assert got.where("position = 1").first()["passage_id"] == "p1" and got.count() == 8
    assert rank_fusion.normal_score_ranking(x.limit(0)).count() == 0
    tied = spark.createDataFrame([("q", p, "m", 1.0, None, None) for p in "ba"], x.drop("loaded_at", "fused").schema).withColumn("loaded_at", F.current_timestamp())
    assert [r[1] for r in rows(rank_fusion.normal_score_ranking(tied), "position")] == ["a", "b"]


# 7


def test_alignment(spark):
    facts = [(f"The audit of {1990 + i} traced {100 + i} accounts in {n}pur.", f"{1990 + i} की लेखा परीक्षा में {d}पुर में {100 + i} खाते मिले।") for i, (n, d) in enumerate([("Kana", "काना"), ("Mora", "मोरा"), ("Tele", "तेले"), ("Sami", "सामि"), ("Rulu", "रुलु")])]
    units = []
    for stem in ("a", "b"):
        for i, (e, h) in enumerate(facts):
            units.append((stem, 0, f"{stem}-en", i * 100, e))
            if not (stem == "a" and i == 0):
                units.append((stem, 1, f"{stem}-hi", (4 - i) * 100, h))
    units += [("only", 0, "only-en", 0, "Alone here 12."), ("a", 1, "a-hi", 900, "...")]
    got = alignment.align(spark.createDataFrame(units, "stem string, side int, passage_id string, start_pos int, unit string")).collect()
    links = {(r["stem"], r["start_pos"], r["other_start_pos"]) for r in got if r["kind"] != "omission"}
    assert links == {(s, i * 100, (4 - i) * 100) for s in "ab" for i in range(5)} - {("a", 0, 400)}
    left_out = {(r["passage_id"], r["start_pos"], r["other_passage_id"], r["other_start_pos"]) for r in got if r["kind"] == "omission"}
    assert left_out == {("a-en", 0, None, None), ("only-en", 0, None, None), (None, None, "a-hi", 900)}
    assert {r["kind"] for r in got} == {"match", "omission"}


def test_groups_of_links():
    links = [(0, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 3, 1.0), (4, 4, 1.0), (4, 5, 1.0), (5, 5, 1.0)]
    assert alignment.groups(6, 6, links) == ["match", "split", "split", "merge", "merge", "both", "both", "both"]


def test_alignment_of_a_long_document():
    """More units than one block, in another order: each finds its own."""
    n = 1200
    rows = lambda which, order: [{"passage_id": which, "start_pos": i, "words": [f"w{i}"], "numbers": [str(10_000 + i)], "bones": []} for i in order]
    aligner = alignment.TransportAligner()
    left, right = aligner.sides((rows("a", range(n)), rows("b", reversed(range(n)))), None)
    assert {(i, j) for i, j, _ in aligner.links(left, right)} == {(i, n - 1 - i) for i in range(n)} == set(aligner.anchors(left, right))


def test_skeletons():
    assert alignment.skeleton("लुबानगर") == alignment.skeleton("lubanagar") == "lbngr" and alignment.skeleton("मोबागांव") == alignment.skeleton("mobagaon")


# 8


def test_encoding_round_trip(spark):
    texts = ["plain words", "देवनागरी 😀", "", None, "<|endoftext|> x", "a" * 50_000, "\r\n\t"]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("other"))
    got = encoding.encode(x)
    ids = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert ids[2] == ids[3] == [] and 50256 not in ids[4]
    assert {r["doc_id"]: r["text"] for r in encoding.decode(got).collect()} == {i: t or "" for i, t in enumerate(texts)}
    spans = encoding.encode(x, offsets=True).where("doc_id = 0").first()
    assert [texts[0][a:b] for a, b in zip(spans["starts"], spans["ends"])] == ["plain", " words"]
    d = encoding.Decoder()
    assert "".join([*[d.feed([i]) for i in ids[1]], d.feed([], True)]) == texts[1]
    assert {r["doc_id"]: r["n_tokens"] for r in encoding.token_counts(x, keep=["doc_id"]).collect()} == {i: len(v) for i, v in ids.items()}


# 9


def test_mix(spark):
    docs = [(i, f"words number {i} of the first kind " * 3, "a") for i in range(200)] + [(1000 + i, f"other {i} text here " * 3, "b") for i in range(30)] + [(2000, "words number 0 of the first kind " * 3, "b"), (2001, None, "a"), (2002, "", "a"), (2003, "left out", None), (2004, "no target", "c")]
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2), ("gone", 0.2, 2), ("null", None, 1)], "source string, target_share double, max_repeats int")
    x = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(0))
    used, shares = mixing.SourceMixer(block_tokens=32, rows_a_bucket=20).mix(x, targets)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["a"]["reached_share"] - 0.5) < 0.05 and s["b"]["most_repeats"] <= 2 and s["gone"]["reached_share"] == 0.0
    assert used.count() == used.select("doc_id").distinct().count() and used.where("doc_id in (2000, 2001, 2002, 2003, 2004)").count() == 0
    empty, _ = mixing.SourceMixer().mix(x.limit(0), targets)
    assert empty.count() == 0


# 10


def test_quality(spark):
    prose = "The office is open for all families in the town, and payments are made by the bank within ten days of the order. "
    data = [(i, prose * (1 + i % 3), "en") for i in range(60)] + [
        (100, "- Kepur\n- health card\n- ration card\n- Mora, help centre\n- auto drivers", "en"), (101, "Town | Group | Year\nKepur | drivers | 1999\nMora | girls | 2001\nTele | staff | 2003", None),
        (102, "var a=function(e){return e[2]||0x1f;};\nvar b=function(e){return e[3]||0x2f;};", "en"), (103, "click here " * 40, "en"), (104, "ÃÂ¤ÂÃÂ¤Â" * 20, "en"), (105, None, "en"), (106, "  ", "en"), (107, "Short prose is fine.", "en"), (108, "town card; help centre; auto drivers; land record; health card; school girls; bank passbook", "en"),
        (109, "District: A\nYear: 1\nDistrict: B\nYear: 2\nDistrict: C\nYear: 3", "en"), (110, prose + "\n- one item\n- another item", "en"), (111, prose * 2000, "en"),
    ]
    x = spark.createDataFrame(data, "doc_id long, text string, label string").withColumn("n_words", F.lit(1))
    stats = quality.document_statistics(x, lang=F.col("label"))
    got = {r["doc_id"]: r["kind"] for r in quality.verdicts(stats, quality.sketches(stats), least=10).collect()}
    assert {k: v for k, v in got.items() if v != "prose"} == {100: "list", 101: "table", 102: "junk", 103: "junk", 104: "junk", 108: "list", 109: "table"}
    none = quality.document_statistics(x.limit(0), lang=F.col("label"))
    assert quality.verdicts(none, quality.sketches(none)).count() == 0


def test_quality_of_skewed_input(spark):
    prose = "The office is open for all families in the town, and payments are made by the bank within ten days of the order. "
    table = "Town | Group | Year\nKepur | drivers | 1999\nMora | girls | 2001\nTele | staff | 2003"
    x = spark.createDataFrame([(i, table if i % 3 == 0 else prose * (1 + i % 4), "en") for i in range(150)], "doc_id long, text string, label string")
    stats = quality.document_statistics(x, lang=F.col("label"))
    got = {r["doc_id"]: r["kind"] for r in quality.verdicts(stats, quality.sketches(stats)).collect()}
    assert got == {i: "prose" if i % 3 else "table" for i in range(150)}


def test_tails_do_not_switch_with_the_count(spark):
    def z(n):
        data = [(i, "en", 0.01 * (i % 9)) for i in range(400)] + [(1000 + i, "hi", 0.5 + 0.02 * (i % 9)) for i in range(n)]
        zeros = [F.lit(0.0).alias(s) for s in quality.STATISTICS if s not in ("symbol_ratio", "n_words", "n_lines")]
        stats = spark.createDataFrame(data, "doc_id long, lang string, symbol_ratio double").select("*", F.lit(9.0).alias("n_words"), F.lit(1.0).alias("n_lines"), *zeros)
        return quality.verdicts(stats, quality.sketches(stats)).where("doc_id = 1008").first()["z_symbol_ratio"]

    assert abs(z(99) - z(100)) < 0.2


def test_quantile_sketches_have_a_bound_and_merge():
    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(4, 3, 300_000))
    whole, halves, again = (quality.Kll(s) for s in ("whole", "halves", "whole"))
    for part in np.array_split(x, 60):
        whole.add(part)
        again.add(part)
    for i in (0, 1):
        half = quality.Kll(f"half {i}")
        for part in np.array_split(x[i::2], 7):
            half.add(part)
        for level, items in enumerate(half.levels):
            halves.add(items, level)
    assert all((a == b).all() for a, b in zip(whole.levels, again.levels, strict=True))
    ranks = np.sort(x)
    for sketch in (whole, halves):
        assert sum(len(v) << i for i, v in enumerate(sketch.levels)) == len(x) and sum(map(len, sketch.levels)) < 3 * 2048 + 100
        weighted = [(v, np.full(len(v), 2.0**i)) for i, v in enumerate(sketch.levels)]
        for q in (0.01, 0.05, 0.3, 0.5, 0.7, 0.95, 0.99):
            assert abs(np.searchsorted(ranks, quality._quantiles(weighted, (q,))[0]) / len(x) - q) < 0.004


def test_sketches_of_all_statistics(spark):
    def table(first, n):
        size = [F.col("i").cast("double").alias("n_words"), (F.col("i") % 9 / 10_000).alias("symbol_ratio")]
        zeros = [F.lit(0.0).alias(s) for s in quality.STATISTICS if s not in ("n_words", "symbol_ratio")]
        return spark.range(first, first + n).withColumnRenamed("id", "i").select(F.when(F.col("i") % 4 == 0, "hi").otherwise("en").alias("lang"), *size, *zeros)

    def quantiles(sketch, statistic):
        own = [(np.array(r["items"]), np.full(len(r["items"]), 2.0 ** r["level"])) for r in sketch.where(f"lang = 'en' and statistic = '{statistic}'").collect()]
        return sum(w.sum() for _, w in own), quality._quantiles(own, (0.1, 0.5, 0.9))

    sketch = quality.sketches(table(1, 40_000))
    assert {r["statistic"] for r in sketch.select("statistic").distinct().collect()} == set(quality.STATISTICS)
    assert sketch.groupBy("lang", "statistic", "level").count().where("count > 1").count() == 0
    both = quality.merged(quality.sketches(table(1, 15_000)).union(quality.sketches(table(15_001, 25_000))))
    for s in (sketch, both):
        n, found = quantiles(s, "n_words")
        assert n == 30_000 and all(abs(v - q) < 200 for v, q in zip(found, (4000, 20_000, 36_000)))
    # Values closer to each other than a bin of the unit range.
    assert {round(r[1 + 2 * list(quality.TAILS).index("symbol_ratio")], 9) for r in quality.references(sketch)} == {0.0002}
    small = table(1, 900)
    assert rows(quality.sketches(small.repartition(3)).selectExpr("lang", "statistic", "level", "array_sort(items)"), "lang", "statistic") == rows(quality.sketches(small.coalesce(1)).selectExpr("lang", "statistic", "level", "array_sort(items)"), "lang", "statistic")


def test_registry():
    names = set(registry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} | {"p8_ids", "p9_mix"} <= names and set(registry.oracle_sql()) <= names


def test_short_and_ideographic_stretches_stay():
    parts = language.stretches("这是一个测试句子。 What is the fee for this school?")
    assert [w for _, w in parts] == ["这是一个测试句子。", "What is the fee for this school?"]
    parts = language.stretches("Who pays the fee? Kyun. The office pays the fee.")
    assert "".join(w.replace(" ", "") for _, w in parts) == "Whopaysthefee?Kyun.Theofficepaysthefee."
    assert language.Grams(["\U00020000\U00020001"]).letters[0, 4] == 2


def test_mixing_points_do_not_overflow(spark):
    first = 4_000_000_000_000
    got = [r["u"] for r in mixing.points(spark, 3, first).orderBy("i").collect()]
    assert got == [i * 2783377641436327 % (1 << 52) for i in range(first, first + 3)]


def test_mixing_schedule_and_shares(spark):
    docs = spark.createDataFrame([(i, f"words of the office number {i} and more of them", "a" if i % 3 else "b") for i in range(600)] + [(9000 + i, "words of the office number 1 and more of them", "c") for i in range(20)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 3), ("none", 0.5, 1)], "source string, target_share double, max_repeats int")
    used, shares = mixing.SourceMixer().mix(docs, targets)
    reached = {r["source"]: (r["reached_share"], r["most_repeats"]) for r in shares.collect()}
    assert abs(reached["b"][0] - 0.7) < 0.01 and reached["b"][1] == 3 and reached["c"] == (0.0, 0) and reached["none"] == (0.0, 0)
    rows = mixing.SourceMixer().schedule(docs, targets)
    assert rows.groupBy("doc_id").count().join(used, "doc_id").where("count <> repeats").count() == 0 and rows.count() == used.groupBy().sum("repeats").first()[0]
    half = rows.orderBy("slot").limit(rows.count() // 2).where("source = 'b'").count() / (rows.count() // 2)
    assert abs(half - 0.7) < 0.03
    small = mixing.SourceMixer().mix(docs.limit(6), targets)[0]
    assert small.count() > 0


def test_unpunctuated_text_is_divided_by_the_words(spark):
    """Text without marks, short blocks and blocks with a mark elsewhere too; scripts with and without spaces."""
    subjects = ["The village council", "The nodal bank", "Each family", "A widow", "The labour bureau", "Every weaver"]
    verbs = ["pays the fee", "keeps the record", "receives the grant", "sends the form", "asks for a receipt"]
    en = [f"{s} {v} in {y}" for s in subjects for v in verbs for y in (2001, 2004)]
    zh = [f"{s}{v}" for s in ("该计划", "申请人", "村委会", "每个家庭") for v in ("应提交材料", "领取补助", "支付费用", "保存记录")]
    rng = random.Random(3)
    texts = [". ".join(rng.sample(en, 5)) + "." for _ in range(200)] + ["。".join(rng.sample(zh, 4)) + "。" for _ in range(200)]
    model = sentences.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    hit = want = wrong = 0
    for own, sep in ((en, " "), (zh, "")):
        for mark in ("", "."):
            for k in range(40):
                parts = rng.sample(own, 4)
                if mark:
                    parts[0] += "." if sep else "。"
                text = sep.join(parts)
                starts = [sum(len(p) + len(sep) for p in parts[:i]) for i in range(4)]
                got = model.starts(text)
                hit, want, wrong = hit + len(set(got) & set(starts)), want + 4, wrong + len(set(got) - set(starts))
    assert hit >= 0.9 * want and wrong <= 0.05 * want
    assert model.starts(texts[0]) == [0] + [i + 2 for i, c in enumerate(texts[0][:-1]) if c == "."]
    long = 'He wrote "' + "the fee is due. " * 60 + '" and left. Then he came back.'
    assert len(model.starts(long)) == 2


def test_slips_of_slips(spark):
    """Two slips of one word, a slip that gives a small word, and one whose likeliest correction is another word."""
    common = [(f"c{i}", t, None, "s") for i in range(9) for t in (f"rehne wale {i}", f"under tahat {i}", f"sent dene {i} dene", f"dene dene {i}0")]
    pairs = [("rene wale boats", "rhene wale boats"), ("under that ferry", "under tahat ferry"), ("boat rene toll", "boat rehne toll")]
    rows = [x for i, (a, b) in enumerate(pairs) for x in ((f"t{i}", a, "train", "s"), (f"e{i}", b, "test", "s"))]
    x = spark.createDataFrame(common + rows + [("t9", "under dene river", "train", "s"), ("e9", "under rehne river", "test", "s")], "id string, text string, split string, source string")
    assert {(r["train_id"], r["eval_id"]) for r in overlap.SplitOverlap().pairs(x).collect()} == {(f"t{i}", f"e{i}") for i in range(3)}


def test_a_block_with_a_closing_mark_is_punctuated():
    ends, right = {"hai": 0.9, "": 0.05}, {("kya", "lower"): 6.0}
    model = sentences.HiddenEventModel({}, {}, right, {}, ends, 0.05)
    text = "jis ghar ke paas naav hai kya use bhi dena hoga"
    assert len(model.starts(text)) == 2 and len(model.starts(text + "?")) == 1


def test_empty_tables_everywhere(spark):
    none = spark.createDataFrame([], "passage_id string, text string")
    model = sentences.train(none)
    assert model.starts("Boats leave. They row.") and sentences.sentence_units(none, model).count() == 0
    units = spark.createDataFrame([], "stem string, side int, passage_id string, start_pos int, unit string")
    assert alignment.align(units).count() == 0
    blank = spark.createDataFrame([("s", 0, "p", 0, "..."), ("s", 1, "q", 0, "!")], units.schema)
    assert {r["kind"] for r in alignment.align(blank).collect()} == {"omission"}
    labelled = spark.createDataFrame([], "text string, lang string")
    filters = language.fit_filters(labelled, bits=12)
    assert filters.detect(["boat", "नाव", None, ""])[2] == (None, 0.0)
    asked = spark.createDataFrame([], "id string, answer_field string, question string, answer string, lang string")
    assert pairs.PairChecker(filters).check(asked).count() == 0
    one = spark.createDataFrame([("i", "answer_gold", None, None, None), ("j", "answer_gold", None, "Yes", None)], asked.schema)
    assert [(r["id"], r["defect"]) for r in pairs.PairChecker(filters).check(one).collect()] == [("i", "empty")]
    votes = spark.createDataFrame([], "id string, annotator string, label int")
    items, annotators = consensus.MinimaxConsensus().fit(votes)
    assert items.count() == 0 and annotators.count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.SourceMixer().schedule(docs, targets).count() == 0
    assert overlap.SplitOverlap().report(spark.createDataFrame([(None, None, "train", None)], "id string, text string, split string, source string")).count() == 0


def test_consensus_with_many_annotators_agrees(spark):
    """The joined plan, with one annotator of a third of all votes, gives the labels of the collected one."""
    rng = random.Random(5)
    votes = [(f"i{i}", a, int((i % 2) ^ (rng.random() < err))) for i in range(120) for a, err in (("hot", 0.1), (f"a{i % 7}", 0.2), (f"b{i % 5}", 0.3))]
    x = spark.createDataFrame(votes, "id string, annotator string, label int")
    few = {r["id"]: r["label"] for r in consensus.MinimaxConsensus(passes=3).fit(x)[0].collect()}
    many = {r["id"]: r["label"] for r in consensus.MinimaxConsensus(passes=3, max_driver_annotators=2).fit(x)[0].collect()}
    assert few == many
