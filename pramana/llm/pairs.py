"""Defective question and answer pairs: empty, copied, refused, in another language or broken off."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pramana.llm.language import LanguageFilters
from pramana.llm.overlap import _CURRENCY, _SMALL, canonical_tokens, fold
from pramana.session import cut, frequent, lookup

PLACEHOLDERS = frozenset(
    map(
        fold,
        ["nil", "n/a", "na", "n.a", "n.a.", "null", "none", "nan", "nothing", "blank", "empty", "tbd", "tba", "todo", "undefined", "xxx", "no answer", "not applicable", "not available"]
        + ["कुछ नहीं", "लागू नहीं", "शून्य", "रिक्त", "खाली", "उपलब्ध नहीं", "अनुपलब्ध", "काही नाही", "কিছু না"],
    )
)

_SAYS = r"(?:contain|mention|say|state|provide|specify|include|give|have|answer|address|indicate|tell|cover)"
_TEXT = r"(?:text|passage|document|context|evidence|source|excerpt|information|material|record|article|corpus|snippet)s?"
_KNOWN = r"(?:information|answer|evidence|mention|data|details?|detail|context|basis)"
#: On folded text. Each needs what it is about, so that a rule's "cannot apply" or "unable to charge" is no refusal.
_REFUSALS = [
    r"^\W*(?:(?:i am|i'm|im|we are|we're)\s+)?(?:very |so |really )?(?:sorry|afraid)\b",
    r"\b(?:apologi[sz]e|apologies)\b",
    r"\bas an? (?:\w+ )?(?:ai|assistant|language model|chatbot|bot)\b",
    r"\b(?:i|we) (?:can(?:no|')?t|can not|cannot|could not|couldn't|am unable|are unable|am not able|are not able|do not|don't|won't|will not) (?:\w+ )?(?:answer|help|assist|provide|determine|find|know|have|say|tell|comply|respond|give|confirm)\b",
    r"\bunable to (?:\w+ )?(?:answer|help|assist|determine|respond|comply|find (?:an|the|any) (?:answer|information))\b",
    r"\b(?:can(?:no|')?t|cannot|can not|could not) be (?:\w+ )?(?:determined|answered|established|inferred)\b",
    rf"\binsufficient {_KNOWN}\b|\bnot enough {_KNOWN}\b",
    rf"\b{_TEXT} (?:does|do|did)(?: not|n't) (?:\w+ )?{_SAYS}\b",
    rf"\bno (?:\w+ )?{_KNOWN} (?:\w+ )?(?:could|can|was|is|were|are|has|found|available|provided|given)\b",
    rf"\b{_KNOWN} (?:is|was|are) (?:not|n't|un)\s?(?:available|provided|found|given|mentioned|stated|present)\b",
    r"(?:क्षमा|माफ|माफी)\s+(?:कीजिए|कीजिये|करें|करे|करना|कर|चाहता|चाहते|चाहती)|खेद (?:है|के साथ)",
    r"(?:जानकारी|सूचना|उत्तर|जवाब|प्रमाण|साक्ष्य|उल्लेख|विवरण)\s+(?:\S+\s+)?नहीं\s+(?:है|हैं|मिली|मिला|मिले|मिल|दी गई|दे|दिया गया|पाया)",
    r"(?:उत्तर|जवाब)\s+(?:\S+\s+)?नहीं\s+(?:दे|किया जा|दिया जा|निकाला जा|मिल)",
    r"(?:नहीं|नही)\s+(?:बताया|दिया|लिखा)\s+गया\s+है|(?:उत्तर|जवाब)\s+देने\s+में\s+असमर्थ|पर्याप्त\s+(?:जानकारी|सूचना|प्रमाण|साक्ष्य)\s+नहीं",
    r"\b(?:maaf|maf|kshama|sorry)\s+(?:kijiye|kariye|karen|karein|kare|karna)\b|\b(?:jaankari|jankari|uttar|jawab|javab|soochna)\s+(?:\w+\s+)?nah[ii]n?\s+(?:hai|hain|mili|mila|de|di)\b",
    r"(?:माहिती|उत्तर)\s+(?:\S+\s+)?(?:नाही|देऊ शकत नाही)|क्षमस्व|माफ करा|(?:তথ্য|উত্তর)\s+(?:\S+\s+)?(?:নেই|দিতে পারছি না|পাওয়া যায়নি)|দুঃখিত",
]
_REFUSAL = regex.compile("|".join(f"(?:{p})" for p in _REFUSALS))

_LETTERS = regex.compile(r"[\p{L}\p{N}]")
_NUMBER = regex.compile(r"\d[\d.,/]*")
_STOP = regex.compile(r"[.?!।॥|。！？]+[\"'”’)\]]*\s*$")
_CUT = regex.compile(r"(?:\.\.+|…|[,;:(\[{–—]|(?<=\s)-)\s*$")
_MONTHS = frozenset(
    map(
        fold,
        "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec जनवरी फरवरी फ़रवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर सितम्बर अक्टूबर अक्तूबर नवंबर नवम्बर दिसंबर दिसम्बर".split(),
    )
)


#: Words that open something and so end no answer.
DANGLING = frozenset(
    map(
        fold,
        "the a an of and or nor but with than to is are was were be who whom which that whose because if when while for from by at on into per i.e e.g cf approx यानी यानि अर्थात और तथा एवं या कि जो जिन्हें जिनके जिनकी जिसके क्योंकि यदि अगर".split(),
    )
)
#: Words at the end of an answer that are looked for elsewhere, and words of a run that is sorted for it.
TAIL, RUN = 3, 6


def is_empty(answer: str | None) -> bool:
    """Nothing said: null, blank, marks only, or a placeholder."""
    t = fold(answer or "").strip().strip("[](){}<>\"'*_- ")
    return not _LETTERS.search(t) or t.rstrip(".।") in PLACEHOLDERS or t in PLACEHOLDERS


def is_copy(question: str | None, answer: str | None) -> bool:
    """The answer has the question's words and little else, whatever the case, marks or a heading such as "Answer:"."""
    a = {w for w in canonical_tokens(answer) if w not in _SMALL} - {"question", "answer", "ans", "उत्तर", "प्रश्न", "jawab", "sawal"}
    if len(a) < 3:
        return False
    q = {w for w in canonical_tokens(question) if w not in _SMALL}
    common = len(q & a)
    return common >= 3 and common >= 0.8 * len(a) and common >= 0.7 * len(q)


def is_refusal(answer: str | None) -> bool:
    return bool(_REFUSAL.search(regex.sub(r"\s+", " ", fold(answer or "")).replace("’", "'")))


def fits_any_language(answer: str) -> bool:
    """Only numbers, amounts and dates."""
    return all(w[0].isdigit() or w in _MONTHS or w in _CURRENCY for w in canonical_tokens(answer))


def masked(answer: str, known: set[str] | frozenset[str]) -> tuple[str, str, bool, bool]:
    """(form, form with the last word as it is, stopped, cut off).

    In the form numbers are # and words not in ``known`` are @; marks at the end and brackets are off. stopped: it ends with
    a closing mark; cut off: with a comma, an opening bracket, dots or a dash, or with a bracket not closed.
    """
    t = fold(answer).strip()
    cut_off = bool(_CUT.search(t)) or t.count("(") > t.count(")")
    stopped = bool(_STOP.search(t)) and not cut_off
    t = regex.sub(r"/-", "", t)
    words = [w for w in regex.sub(r"[()\[\]{}\"“”']", " ", t).split()]
    while words and not (last := regex.sub(r"[\s.?!।॥|。！？…,;:–—-]+$", "", words[-1])):
        words.pop()
    if words:
        words[-1] = last
    # A mark beside a word isn't its own, so that "1992, and" and "1992" agree.
    words = [_NUMBER.sub("#", w).rstrip(",;:.") if i < len(words) - 1 else _NUMBER.sub("#", w) for i, w in enumerate(words)]
    words = [w for w in words if w]
    if not words:
        return "", "", stopped, cut_off
    form = [w if "#" in w or w in known else "@" for w in words]
    cut_off = cut_off or not stopped and len(words) > 1 and words[-1] in DANGLING
    return " ".join(form), " ".join([*form[:-1], words[-1]]), stopped, cut_off


def words_of(answer: str) -> list[str]:
    t = regex.sub(r"[()\[\]{}\"“”']", " ", fold(answer).replace("/-", ""))
    return [w for w in (regex.sub(r"[\s.?!।॥|。！？…,;:–—-]+$", "", w) for w in t.split()) if w and not _NUMBER.search(w)]


TOP = "\U0010ffff"


def prefix_weights(keys: DataFrame, queries: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``q, longer`` and ``extra``: the weight of the keys that start with the text q and go on, and the columns ``extra`` (long) of the key q itself, 0 if there is none.

    ``keys``: (s, n, extra), each s once; ``queries``: (q), distinct. All keys, and the first and last place a query's extensions
    can have, are sorted together by range partitions; extensions are the neighbours after a query that have all of it as their
    common prefix. Weights are added up within partitions, over the sums of the partitions before. Nothing but one sum a
    partition goes to the driver.
    """
    zero = F.lit(0).cast("long")
    own = [F.col(c).cast("long").alias(c) for c in extra]
    none = [zero.alias(c) for c in extra]
    rows = keys.select("s", F.lit(0).alias("kind"), F.col("n").cast("long").alias("n"), *own).unionByName(queries.select(F.explode(F.array(F.struct(F.col("q").alias("s"), F.lit(1).alias("kind")), F.struct(F.concat("q", F.lit(TOP)).alias("s"), F.lit(2).alias("kind")))).alias("v")).select("v.*", zero.alias("n"), *none))
    ordered = cut(rows.repartitionByRange("s").sortWithinPartitions("s", "kind")).withColumn("part", F.spark_partition_id())
    sums = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p] = total
        total += sums[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        carry, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if carry is None:
                carry = before[b.column(b.num_columns - 1)[0].as_py()]
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            # The row before is there once more: it is not counted again.
            n = b.column(2).to_numpy(zero_copy_only=False).copy()
            if last is not None:
                n[0] = 0
            at = carry + np.cumsum(n)
            carry = int(at[-1])
            kind = b.column(1).to_numpy(zero_copy_only=False)
            pick = np.flatnonzero(kind > 0)
            pick = pick[pick > 0] if last is not None else pick
            last = b.slice(b.num_rows - 1)
            s, k = b.column(0), kind[pick]
            prior = np.maximum(pick - 1, 0)
            own = (k == 1) & (pick > 0) & (kind[prior] == 0) & pc.equal(s.take(pa.array(prior)), s.take(pa.array(pick))).to_numpy(zero_copy_only=False).astype(bool)
            names = s.take(pa.array(pick)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] if j == 2 else x for x, j in zip(names, k)], pa.string()), pa.array(np.where(k == 2, at[pick], -at[pick])), *[pa.array(np.where(own, b.column(3 + i).to_numpy(zero_copy_only=False)[prior], 0)) for i in range(len(extra))]], ["q", "w", *extra])

    found = ordered.select("s", "kind", "n", *extra, "part").mapInArrow(run, "q string, w long" + "".join(f", {c} long" for c in extra))
    return found.groupBy("q").agg(F.sum("w").alias("longer"), *[F.sum(c).alias(c) for c in extra])


class PairChecker:
    """One defect, or none, of each answer.

    In this order: empty, copy, refusal, wrong_language, truncated. An answer is truncated if sorting all answers (numbers and
    rare words masked) shows it as a shortened version: others go on after it, and either it ends with a cut mark, an open
    bracket or a word that opens something, or none stops there with a closing mark and it isn't a phrase often given whole, less than ``whole``
    times as often as what goes on. Where no answer starts with all of it, its last ``TAIL`` words are looked for in the same way
    among the sorted runs of words of all answers, for one with a cut mark also its last two words or one. Where the lengths of unstopped answers have a spike, a length
    limit, ``whole_at_limit`` is the bound. A spike holds a thousandth of them at least, five times as many as the lengths around
    on average, and more than these would by chance. A word is rare below ``rare`` of all answers plus two, so that there are at most (words an answer) / rare known words.
    """

    def __init__(self, filters: LanguageFilters, *, rare: float = 0.001, whole: float = 0.15, whole_at_limit: float = 0.5, sure: float = 0.55):
        self.filters, self.rare, self.whole, self.whole_at_limit, self.sure = filters, rare, whole, whole_at_limit, sure

    def truncated(self, answers: DataFrame) -> DataFrame:
        """``answer, way`` of each distinct text of ``answers`` (answer) that breaks off; way is how it was found: answers or runs that go on, with or without a cut mark."""
        texts = answers.where("answer is not null and answer <> ''").groupBy("answer").agg(F.count(F.lit(1)).alias("n"))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(set(words_of(t))) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["answer", "n", "words"])

        worded = cut(texts.mapInArrow(split, "answer string, n long, words array<string>"))
        least = self.rare * worded.count() + 2
        known = frozenset(r["w"] for r in worded.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= least).collect())

        def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [masked(t, known) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([g[i] for g in got]) for i in range(4)]], ["answer", "n", "form", "raw", "stopped", "cut_off"])

        forms = cut(worded.select("answer", "n").mapInArrow(mask, "answer string, n long, form string, raw string, stopped boolean, cut_off boolean").where("form <> ''"))
        keys = cut(forms.groupBy("form").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stopped"), F.col("n")).otherwise(0)).alias("stops"), F.sum(F.when(~F.col("stopped") & ~F.col("cut_off"), F.col("n")).otherwise(0)).alias("bare")))
        open_ended = forms.where("not stopped")
        # From here on rows are the different masked answers; a raw has one form.
        raws = cut(open_ended.groupBy("form", "raw", "cut_off").agg(F.sum("n").alias("n")))
        asked = raws.select(F.explode(F.array("form", "raw")).alias("q")).distinct()
        longer = cut(prefix_weights(keys.select(F.col("form").alias("s"), "n", "stops", "bare"), asked, ("stops", "bare")))
        x = raws.where("form = raw").join(longer.select(F.col("q").alias("raw"), F.col("longer").alias("longest"), "stops", "bare"), "raw")
        other = raws.where("form <> raw").join(longer.select(F.col("q").alias("raw"), F.col("longer").alias("l2")), "raw")
        other = lookup(other, longer.select(F.col("q").alias("form"), F.col("longer").alias("l1"), "stops", "bare"), "form", frequent(raws.where("form <> raw"), "form", 1000))
        both = ["form", "raw", "cut_off", "longest", "stops", "bare"]
        x = cut(x.select(*both).unionByName(other.withColumn("longest", F.greatest("l1", "l2")).select(*both)))
        goes_on = x.where("longest > 0 and (cut_off or stops = 0)").select("form", "raw", "cut_off", F.when(F.col("cut_off"), 0.0).otherwise(F.col("bare") / F.col("longest")).alias("share"), F.lit("answers").alias("way"))
        by_tail = self._by_tail(keys, x.where("longest = 0 and (cut_off or stops = 0)").select("form", "raw", "cut_off"))
        found = goes_on.where(F.col("share") <= self.whole_at_limit).unionByName(by_tail.where(F.col("share") <= self.whole))
        found = cut(found.groupBy("raw", "cut_off").agg(F.min(F.struct("share", "way")).alias("v")).select("raw", "cut_off", "v.*"))
        # Lengths at which unstopped answers pile up; a thousand at most, as each holds a thousandth.
        lengths = cut(open_ended.groupBy(F.length("answer").alias("len")).agg(F.sum("n").alias("c")))
        total = lengths.agg(F.sum("c")).first()[0] or 0
        around = lengths.select("c", F.explode(F.sequence(F.col("len") - 5, F.col("len") + 5)).alias("len")).groupBy("len").agg((F.sum("c") / 11).alias("mean"))
        spikes = lengths.where(F.col("c") * 1000 >= total).join(around, "len").where("c >= 5 * mean and c - mean >= 6 * sqrt(mean + 1)").select(F.col("len").alias("spike"))
        hot = frequent(open_ended, "raw", 1000)
        x = lookup(open_ended.withColumnRenamed("cut_off", "cut_here").select("answer", "raw", "cut_here"), found.groupBy("raw").pivot("cut_off", [True, False]).agg(F.first(F.struct("share", "way"))), "raw", hot)
        x = x.withColumn("v", F.when(F.col("cut_here"), F.col("true")).otherwise(F.col("false"))).where("v is not null").join(F.broadcast(spikes), F.length("answer") == F.col("spike"), "left")
        return x.where(F.col("v.share") <= F.when(F.col("spike").isNotNull(), self.whole_at_limit).otherwise(self.whole)).select("answer", F.concat("v.way", F.when(F.col("cut_here"), ", cut mark").otherwise("")).alias("way"))

    def _by_tail(self, keys: DataFrame, rest: DataFrame) -> DataFrame:
        """``form, raw, cut_off, share, way`` of those of ``rest`` whose last words go on elsewhere and end no answer."""
        words = F.split("form", " ")
        runs = keys.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, RUN), " "))).alias("s")).groupBy("s").agg(F.sum("n").alias("n"))
        last = lambda c, k: F.array_join(F.slice(F.split(c, " "), -k, k), " ")
        ends = keys.where(F.size(words) >= TAIL).groupBy(last("form", TAIL).alias("t")).agg(F.sum("stops").alias("t_stops"), F.sum("bare").alias("t_bare"))
        # Without a cut mark a run must be a part of the answer only; with one its last word alone may tell.
        lengths = F.when(F.col("cut_off"), F.sequence(F.lit(1), F.least(F.lit(TAIL), F.size(words)))).otherwise(F.when(F.size(words) > TAIL, F.array(F.lit(TAIL))).otherwise(F.array().cast("array<int>")))
        tails = cut(rest.select("form", "raw", "cut_off", F.explode(lengths).alias("k")).select("form", "raw", "cut_off", "k", F.explode(F.array(last("form", F.col("k")), last("raw", F.col("k")))).alias("t")).distinct())
        longer = prefix_weights(runs, tails.select(F.col("t").alias("q")).distinct())
        info = cut(longer.where("longer > 0").withColumnRenamed("q", "t").join(ends, "t", "left"))
        x = lookup(tails, info, "t", frequent(tails, "t", 1000))
        x = x.groupBy("form", "raw", "cut_off").agg(F.max("longer").alias("longest"), F.sum(F.when(F.col("t") == last("form", F.col("k")), F.col("t_stops"))).alias("t_stops"), F.sum(F.when(F.col("t") == last("form", F.col("k")), F.col("t_bare"))).alias("t_bare"))
        x = x.where(F.col("cut_off") | (F.coalesce("t_stops", F.lit(0)) == 0))
        return x.select("form", "raw", "cut_off", F.when(F.col("cut_off"), 0.0).otherwise(F.coalesce("t_bare", F.lit(0)) / F.col("longest")).alias("share"), F.lit("runs").alias("way"))

    def check(self, pairs: DataFrame) -> DataFrame:
        """``id, answer_field, defect`` of the defective ones of ``pairs`` (id, answer_field, question, answer, lang).

        lang: the language the answer must have, null if unknown. Null answers are empty; leave out those that are no case.
        Repeated rows give repeated results.
        """
        kind = dict(pairs.dtypes)["id"]
        pairs = cut(pairs.select("id", "answer_field", "question", "answer", "lang"))
        broken = self.truncated(pairs.select("answer")).select("answer", F.lit(True).alias("broken")).distinct()
        marked = lookup(pairs.where("answer <> ''"), broken, "answer", frequent(pairs.where("answer <> ''"), "answer", 1000), "left").unionByName(pairs.where("answer is null or answer = ''").withColumn("broken", F.lit(False)))
        marked = marked.select("id", "answer_field", "question", "answer", "lang", F.coalesce("broken", F.lit(False)).alias("broken"))
        sent = pairs.sparkSession.sparkContext.broadcast(self.filters.table)
        sure = self.sure

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = LanguageFilters(sent.value)
            for b in batches:
                questions, answers, langs, cut_off = (b.column(i).to_pylist() for i in range(2, 6))
                found: list[str | None] = []
                for q, a in zip(questions, answers):
                    found.append("empty" if is_empty(a) else "copy" if is_copy(q, a) else "refusal" if is_refusal(a) else None)
                rest = [i for i, d in enumerate(found) if d is None]
                for i, (lang, p) in zip(rest, filters.detect([answers[i] for i in rest])):
                    want = langs[i]
                    if want and lang and lang != want and (p >= sure or {lang, want} & {"bn", "zh"} or (lang in ("en", "hinglish")) != (want == "en")) and not fits_any_language(answers[i]):
                        found[i] = "wrong_language"
                    elif cut_off[i]:
                        found[i] = "truncated"
                keep = pa.array([i for i, d in enumerate(found) if d], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array([d for d in found if d], pa.string())], ["id", "answer_field", "defect"])

        return marked.mapInArrow(run, f"id {kind}, answer_field string, defect string")
