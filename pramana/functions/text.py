"""Normalization, script, language and tokenization of Hindi, English and mixed text, as Column expressions.

Only composition to NFC has no built-in function and is an Arrow UDF; all else stays in the JVM. Null text counts as empty
where a function says so; elsewhere null gives null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters, patterns and word lists that results depend on.
ZERO_WIDTH = "​‌‍﻿"
DEVANAGARI_DIGITS = "०१२३४५६७८९"
DASHES = "‐‑‒–—―"
QUOTES = ("‘’“”", "''\"\"")
DEVA = r"ऀ-ॿ"
AMOUNT = r"(?iu)(?:(?:Rs\.?|INR|₹|रु\.?|रुपये|रुपए)\s*)?(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*/-)?(?:\s*(lakh|lakhs|lac|crore|crores|लाख|करोड़))?"
ABBREVIATIONS = "rs no sr jr dr mr mrs ms smt shri st vs etc viz approx govt deptt dept ltd pvt i.e e.g fig vol pp ch sec art cl".split()
HINDI_STOPWORDS_CORE = (
    "के का की को में से है हैं था थे थी और या पर यह वह ये वे एक लिए किया कर करने हो होता होती होने गया गई इस उस जो कि तो ही नहीं भी तक साथ बाद पहले अपने सकता सकते सभी कोई कुछ जब तब यदि अगर द्वारा रूप प्रकार आदि अथवा एवं तथा हुए हुई"
).split()
HINDI_STOPWORDS = HINDI_STOPWORDS_CORE + "जाता जाती जाते किसी वाले वाली वाला रहा रहे रही बहुत अधिक कम लेकिन अपना अपनी".split()
ENGLISH_STOPWORDS = (
    "a an the and or but if then than of for to in on at by with from as is are was were be been being do does did have has had will would shall should can could may might must this that these those it its he she they them their there here "
    "what which who whom whose when where why how not no nor so such own same too very s t just don now under over again further once"
).split()
HINDI_SUFFIXES = "ाओं ियों ाएँ ाएं ओं ुओं ियाँ ियां ाई ाओ ाएii ेंगे ेगा ेगी ों ें ाँ ां ीय ता ते ती ना ने नी ा ि ी ो े ू ु".split()
ENGLISH_SUFFIXES = "ations ation ments ment ness ing ies es s".split()
UNAMBIGUOUS_MARKERS = (
    "kya kyaa kyu kyun kyon kaise kaisa kaisi kab kahan kahaan kaun kaunsa kitna kitni kitne kitnaa hai hain haii hota hoti hote hona hoga hogi honge tha thi ka ki ke ko se mein mai liye pe tak bhi aur nahi nahin chahiye sakta sakte sakti "
    "milega milta milti wala wali wale apna apni apne mera meri mere tera teri aapka aapki uska uski iska iski jis jab agar yadi lekin magar kuch koi sab sabhi yeh woh bataye batao karna karne kare karta karti diya dena deta milne jaruri zaruri jarurat zarurat kaunse kisi kisne"
).split()
AMBIGUOUS_MARKERS = "the is to us me hi na ya par lie tab wo ye jo so".split()
ENGLISH_MARKERS = (
    "the a an is are was were what which who whom whose when where why how of for to in on at by with from and or not do does did can could should would will shall have has had be been being i you he she it we they this that these those my your his her its our their there here if then than"
).split()
POSTPOSITIONS = ["के लिए", "के साथ", "के बाद", "के अनुसार", "के अंतर्गत", "के द्वारा"]
DANGLING_ABBREVIATION = "\u0001"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_unicode(c: Column) -> Column:
    return F.translate(nfc(c), ZERO_WIDTH, "")


def normalize_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, "0123456789")


def normalize_punctuation(c: Column) -> Column:
    """Dashes, quotes and the no-break space in their plain forms, soft hyphens gone, an ellipsis as three dots."""
    plain = F.translate(c, DASHES + QUOTES[0] + " ­", "-" * len(DASHES) + QUOTES[1] + " ")
    return F.replace(plain, F.lit("…"), F.lit("..."))


def normalize_whitespace(c: Column, join_softwrap: bool = True) -> Column:
    """Single spaces, at most one blank line in a row, no space at the ends of lines; a line broken within a sentence is joined."""
    t = F.regexp_replace(c, r"[ \t ]+", " ")
    if join_softwrap:
        t = F.regexp_replace(t, r"(?<=[^\n.;:।])\n(?=[a-z" + DEVA + "])", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    lines = F.transform(F.split(t, "\n"), strip)
    return strip(F.array_join(lines, "\n"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")


def normalize_text(c: Column, join_softwrap: bool = True) -> Column:
    """All of the above, in this order; null is empty."""
    return normalize_whitespace(normalize_punctuation(normalize_digits(normalize_unicode(F.coalesce(c, F.lit(""))))), join_softwrap)


def canonical_amounts(c: Column, composed: bool = False) -> Column:
    """Every number of at least 100, as an integer string: commas, currency marks, lakh and crore resolved. ``composed``: the text is in NFC."""
    t = normalize_digits(F.translate(c, ZERO_WIDTH, "") if composed else normalize_unicode(c))
    numbers = F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(1))
    units = F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(2))
    factor = lambda u: F.when(F.lower(u).isin("lakh", "lakhs", "lac", "लाख"), 1e5).when(F.lower(u).isin("crore", "crores", "करोड़"), 1e7).otherwise(1.0)
    values = F.transform(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda x: F.replace(x["n"], F.lit(","), F.lit("")).cast("double") * factor(x["u"]))
    return F.transform(F.filter(values, lambda v: v >= 100), lambda v: F.floor(v).cast("string"))


def split_sentences(c: Column, protect_abbreviations: bool = True) -> Column:
    """Sentences end at a stop, question or exclamation mark or (double) danda before white space, but not after an abbreviation."""
    t = F.coalesce(c, F.lit(""))
    if protect_abbreviations:
        known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
        t = F.regexp_replace(t, r"(?iU)(?<![\p{L}\p{N}_.])(" + known + r")\.\s", "$1" + DANGLING_ABBREVIATION)
    parts = F.split(t, r"(?U)(?<=[.!?।॥])\s+")
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit(DANGLING_ABBREVIATION), F.lit(". ")))), lambda p: p != "")


def count_tokens(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _count(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")).cast("double")


def devanagari_ratio(c: Column) -> Column:
    """Share of Devanagari among the characters that are no white space."""
    return _share(_count(c, rf"[^{DEVA}]"), _count(c, r"(?U)\s"))


def letter_devanagari_ratio(c: Column) -> Column:
    """Share of Devanagari among the letters; vowel signs are no letters."""
    return _share(_count(c, rf"[^{DEVA}]|\P{{L}}"), _count(c, r"\P{L}"))


def hindi_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"([{DEVA}]+)"), F.lit(1))


def misplaced_matras(c: Column) -> Column:
    """Vowel signs that follow neither a consonant nor a sign."""
    return F.regexp_count(c, F.lit(r"(?<![क-हक़-य़ऺ-ौ])[ऺ-ौ]"))


def misplaced_matra_places(c: Column) -> Column:
    """Array of ``pos`` (from 0) and ``near``, six characters to both sides, of vowel signs that follow neither a consonant nor a sign."""
    at = lambda i: F.substring(c, i, F.lit(1))
    wrong = lambda i: at(i).rlike("[\u093a-\u094c]") & ((i == 1) | ~at(i - 1).rlike("[\u0915-\u0939\u0958-\u095f\u093a-\u094c]"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), wrong)
    return F.transform(places, lambda i: F.struct((i - 1).alias("pos"), F.substring(c, F.greatest(i - 6, F.lit(1)), i + 6 - F.greatest(i - 6, F.lit(1)) + 1).alias("near")))


def integrity(c: Column, *, expect_hindi: bool = True) -> Column:
    """Struct ``n_chars, ratio, matra_rate, virama_rate, stopword_rate, failures`` of a text: what is wrong with it, as far as characters and words tell.

    too_short, replacement_chars; of Hindi also low_devanagari_ratio, misplaced_matras, dangling_viramas and, from 20 words on, low_stopword_rate.
    """
    t = normalize_unicode(F.coalesce(c, F.lit("")))
    n, words = F.length(F.regexp_replace(t, r"(?U)\s", "")), F.size(hindi_words(t))
    deva = F.greatest(F.length(F.regexp_replace(t, rf"[^{DEVA}]|(?U)\s", "")), F.lit(1))
    ratio, matra = F.round(devanagari_ratio(t), 6), F.round(misplaced_matras(t) / deva, 6)
    virama, stop = F.round(final_viramas(t) / F.greatest(words, F.lit(1)), 6), F.round(stopword_rate(t), 6)
    checks = {"too_short": n < 40, "replacement_chars": F.contains(t, F.lit("\ufffd"))}
    if expect_hindi:
        checks |= {"low_devanagari_ratio": ratio < 0.45, "misplaced_matras": matra > 0.005, "dangling_viramas": virama > 0.02, "low_stopword_rate": (stop < 0.05) & (words >= 20)}
    failures = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]))
    return F.struct(n.cast("bigint").alias("n_chars"), ratio.alias("ratio"), matra.alias("matra_rate"), virama.alias("virama_rate"), stop.alias("stopword_rate"), failures.alias("failures"))


def final_viramas(c: Column) -> Column:
    return F.size(F.filter(hindi_words(c), lambda w: F.endswith(w, F.lit("्"))))


def stopword_rate(c: Column) -> Column:
    words = hindi_words(c)
    return _share(F.size(F.filter(words, lambda w: w.isin(HINDI_STOPWORDS_CORE))).cast("double"), F.size(words).cast("double"))


def script_of(c: Column) -> Column:
    """deva, latin, mixed or unknown, by the shares among letters and digits; a script under 0.15 is incidental."""
    alnum = F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    n = F.length(alnum)
    deva, latin = _count(alnum, rf"[^{DEVA}]") / F.greatest(n, F.lit(1)), _count(alnum, "[^A-Za-z]") / F.greatest(n, F.lit(1))
    return (
        F.when(n == 0, "unknown")
        .when((deva >= 0.6) & (latin < 0.15), "deva")
        .when((latin >= 0.6) & (deva < 0.15), "latin")
        .when((deva == 0) & (latin > 0), "latin")
        .when((latin == 0) & (deva > 0), "deva")
        .otherwise("mixed")
    )


def classify_language(c: Column) -> Column:
    """Struct of ``query_type`` (English, Indic, Code-Mixed), ``script``, ``lang``, ``ratio`` and counts of marker words."""
    t = strip(F.coalesce(c, F.lit("")))
    ratio = letter_devanagari_ratio(t)
    words = F.transform(F.regexp_extract_all(t, F.lit(rf"([a-zA-Z{DEVA}]+)"), F.lit(1)), F.lower)
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    hindi, ambiguous, english = hits(UNAMBIGUOUS_MARKERS), hits(AMBIGUOUS_MARKERS), hits(ENGLISH_MARKERS)
    has_deva, has_latin = t.rlike(f"[{DEVA}]"), t.rlike("[A-Za-z]")
    kind = F.when(t == "", "empty").when(ratio >= 0.6, "indic").when(has_deva & has_latin, "mixed").when(has_deva, "indic").when(hindi >= 1, "roman").otherwise("english")
    pick = lambda **of: F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), kind)
    return F.struct(
        pick(empty="English", indic="Indic", mixed="Code-Mixed", roman="Code-Mixed", english="English").alias("query_type"),
        pick(empty="unknown", indic="deva", mixed="mixed", roman="latin", english="latin").alias("script"),
        pick(empty="en", indic="hi", mixed="hi-en", roman="hi-en", english="en").alias("lang"),
        ratio.alias("ratio"), hindi.cast("bigint").alias("hindi_hits"), ambiguous.cast("bigint").alias("ambiguous_hits"), english.cast("bigint").alias("english_hits"),
    )


def is_code_mixed(c: Column) -> Column:
    return classify_language(c)["query_type"] == "Code-Mixed"


def _stem_hindi(w: Column) -> Column:
    out = F.when(F.lit(False), w)
    for s in HINDI_SUFFIXES:
        out = out.when(F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def _stem_english(w: Column) -> Column:
    out = F.when(F.lit(False), w)
    for s in ENGLISH_SUFFIXES:
        stem = F.substring(w, F.lit(1), F.length(w) - len(s))
        out = out.when(F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= 4), F.concat(stem, F.lit("y")) if s == "ies" else stem)
    return out.otherwise(w)


def tokenize(c: Column, *, stem: bool = True, drop_stopwords: bool = True) -> Column:
    """Terms of mixed text, each by its own script's rules: Latin ones in lower case without single letters, stop words out, light stems."""
    raw = F.regexp_extract_all(normalize_text(c, join_softwrap=False), F.lit(rf"([a-zA-Z0-9]+|[{DEVA}]+)"), F.lit(1))
    words = F.transform(raw, F.lower)
    hindi = lambda w: w.rlike(f"^[{DEVA}]")
    if drop_stopwords:
        words = F.filter(words, lambda w: ~w.isin(HINDI_STOPWORDS + ENGLISH_STOPWORDS))
    words = F.filter(words, lambda w: hindi(w) | (F.length(w) > 1) | w.rlike("^[0-9]$"))
    return F.transform(words, lambda w: F.when(hindi(w), _stem_hindi(w)).otherwise(_stem_english(w))) if stem else words


def normalize_answer(c: Column) -> Column:
    """An answer in the form in which answers are compared: joined postpositions parted, marks and English articles out, lower case."""
    t = normalize_digits(normalize_unicode(F.coalesce(c, F.lit(""))))
    for p in POSTPOSITIONS:
        t = F.replace(t, F.lit(p.replace(" ", "")), F.lit(p))
    t = F.translate(t, "।॥", "  ")
    t = F.lower(F.regexp_replace(t, rf"(?U)[^\p{{L}}\p{{N}}_\s{DEVA}]", " "))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))
    return F.array_join(words, " ")


def answer_tokens(c: Column) -> Column:
    n = normalize_answer(c)
    return F.filter(F.split(n, " "), lambda w: w != "")


def amount_key(c: Column) -> Column:
    """The amount of an answer that is one amount and at most four words, else null."""
    amounts = canonical_amounts(F.coalesce(c, F.lit("")))
    return F.when((F.size(amounts) == 1) & (F.size(answer_tokens(c)) <= 4), F.get(amounts, F.lit(0)))
