"""Devanagari in Latin letters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sounds of the letters; long vowels and sounds of the roof of the mouth are capitals until the end.
VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", "a A i I u U R e ai o au o e".split()))
SIGNS = dict(zip("\u093e\u093f\u0940\u0941\u0942\u0943\u0947\u0948\u094b\u094c\u0949\u0945", "A i I u U R e ai o au o e".split()))
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "k kh g gh n ch Ch j jh n T Th D Dh N t th d dh n p ph b bh m y r l L v sh Sh s h".split()))
NUKTA = "\u093c"
DOTTED = {c + NUKTA: r for c, r in zip("कखगजडढफय", "q kh g z D Dh f y".split())}
MARKS = {"ं": "M", "ँ": "M", "ः": "H", "ऽ": "", "।": ".", "॥": ".", "ॐ": "om"}
# Loanwords that are written as in English, and names that keep their last vowel.
KEPT = {"योजना": "yojana", "स्कीम": "scheme", "अकाउंट": "account", "बैंक": "bank", "कार्ड": "card", "ऑनलाइन": "online", "फॉर्म": "form", "वेबसाइट": "website", "पोर्टल": "portal", "सब्सिडी": "subsidy", "बीमा": "bima"}
VIRAMA, INHERENT = "\u094d", "\u0001"


def has_devanagari(c: Column) -> Column:
    return c.rlike("[ऀ-ॿ]")


def to_roman(c: Column, *, naturalize: bool = True) -> Column:
    """The text in Latin letters. ``naturalize``: as people write, in lower case, without a word's last unspoken vowel, known loanwords in their own spelling."""
    t = c
    for i, base in enumerate("कखगजडढफय"):
        t = F.replace(t, F.lit(chr(0x958 + i)), F.lit(base + NUKTA))
    kept = sorted(KEPT) if naturalize else []
    for i, w in enumerate(kept):
        t = F.regexp_replace(t, f"(^|[^ऀ-ॿ]){w}([^ऀ-ॿ]|$)", f"$1{chr(0xE000 + i)}$2")
    # A consonant has its vowel unless a sign or the virama follows.
    t = F.regexp_replace(t, f"([क-ह]{NUKTA}?)", "$1" + INHERENT)
    t = F.regexp_replace(t, f"{INHERENT}([\u093e-\u094d])", "$1")
    for table in (DOTTED, CONSONANTS, SIGNS, VOWELS, MARKS, {VIRAMA: "", NUKTA: "", INHERENT: "a"}, {d: str(i) for i, d in enumerate("०१२३४५६७८९")}):
        for a, b in table.items():
            t = F.replace(t, F.lit(a), F.lit(b))
    if not naturalize:
        return t
    t = F.regexp_replace(t, "([A-Za-z]{2,})a([^A-Za-z]|$)", "$1$2")
    t = F.lower(F.replace(t, F.lit("M"), F.lit("n")))
    for i, w in enumerate(kept):
        t = F.replace(t, F.lit(chr(0xE000 + i)), F.lit(KEPT[w]))
    return t


def romanize_question(c: Column) -> Column:
    """The question in Latin letters; null where nothing is to be changed or nothing is left."""
    roman = to_roman(c)
    return F.when(has_devanagari(c) & (F.trim(roman) != ""), roman)
