"""DuckDB expressions equal to the functions of pramana.functions.text; each takes and gives a SQL expression."""

from __future__ import annotations

from pramana.functions import text as T

DEVA = r"\x{0900}-\x{097F}"
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
GUARD, CUT = "chr(1)", "chr(2)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws: list[str]) -> str:
    return "[" + ", ".join(map(q, ws)) + "]"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^[{SPACE}\x{{1C}}-\x{{1F}}]+|[{SPACE}\x{{1C}}-\x{{1F}}]+$")


def normalize_unicode(x: str) -> str:
    return f"translate(nfc_normalize({x}), {q(T.ZERO_WIDTH)}, '')"


def normalize_digits(x: str) -> str:
    return f"translate({x}, {q(T.DEVANAGARI_DIGITS)}, '0123456789')"


def normalize_punctuation(x: str) -> str:
    plain = f"translate({x}, {q(T.DASHES + T.QUOTES[0] + chr(0xA0) + chr(0xAD))}, {q('-' * len(T.DASHES) + T.QUOTES[1] + ' ')})"
    return f"replace({plain}, '…', '...')"


def normalize_whitespace(x: str, join_softwrap: bool = True) -> str:
    t = sub(x, r"[ \t\x{A0}]+", " ")
    if join_softwrap:
        for _ in range(2):
            t = sub(t, rf"([^\n.;:।])\n([a-z{DEVA}])", r"\1 \2")
    t = sub(t, r"\n{3,}", "\n\n")
    return strip(f"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: {strip('l')}), chr(10))")


def normalize_text(x: str, join_softwrap: bool = True) -> str:
    return normalize_whitespace(normalize_punctuation(normalize_digits(normalize_unicode(f"coalesce({x}, '')"))), join_softwrap)


def canonical_amounts(x: str) -> str:
    t, p = normalize_digits(normalize_unicode(x)), q(T.AMOUNT.replace("(?iu)", "(?i)"))
    factor = "CASE WHEN lower(u) IN ('lakh','lakhs','lac','लाख') THEN 1e5 WHEN lower(u) IN ('crore','crores','करोड़') THEN 1e7 ELSE 1.0 END"
    pairs = f"list_zip(regexp_extract_all({t}, {p}, 1), regexp_extract_all({t}, {p}, 2))"
    value = f"CAST(replace(z[1], ',', '') AS DOUBLE) * ({factor.replace('lower(u)', 'lower(coalesce(z[2], chr(32)))')})"
    return f"list_transform(list_filter(list_transform({pairs}, lambda z: {value}), lambda v: v >= 100), lambda v: CAST(CAST(floor(v) AS BIGINT) AS VARCHAR))"


def split_sentences(x: str) -> str:
    known = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
    t = f"coalesce({x}, '')"
    for _ in range(3):
        t = f"regexp_replace({t}, {q(rf'(?i)(^|[^\p{{L}}\p{{N}}_.])({known})\.[{SPACE}]')}, '\\1\\2' || {GUARD}, 'g')"
    parts = f"string_split(regexp_replace({t}, {q(rf'([.!?।॥])[{SPACE}]+')}, '\\1' || {CUT}, 'g'), {CUT})"
    part = strip(f"replace(p, {GUARD}, '. ')")
    return f"list_filter(list_transform({parts}, lambda p: {part}), lambda p: p <> '')"


def count_tokens(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array(coalesce({x}, ''), {q(f'[{SPACE}]+')}), lambda w: w <> '')) AS BIGINT)"


def count(x: str, pattern: str) -> str:
    return f"CAST(length({sub(x, pattern)}) AS DOUBLE)"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"


def devanagari_ratio(x: str) -> str:
    return share(count(x, f"[^{DEVA}]"), count(x, f"[{SPACE}]"))


def letter_devanagari_ratio(x: str) -> str:
    return share(count(x, rf"[^{DEVA}]|\P{{L}}"), count(x, r"\P{L}"))


def hindi_words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(f'[{DEVA}]+')})"


def stopword_rate(x: str) -> str:
    return share(f"CAST(len(list_filter({hindi_words(x)}, lambda w: list_contains({words(T.HINDI_STOPWORDS_CORE)}, w))) AS DOUBLE)", f"CAST(len({hindi_words(x)}) AS DOUBLE)")


def script_of(x: str) -> str:
    alnum = sub(x, r"[^\p{L}\p{N}]")
    n = f"greatest(length({alnum}), 1)"
    d, lat = f"({count(alnum, f'[^{DEVA}]')} / {n})", f"({count(alnum, '[^A-Za-z]')} / {n})"
    return (
        f"CASE WHEN length({alnum}) = 0 THEN 'unknown' WHEN {d} >= 0.6 AND {lat} < 0.15 THEN 'deva' WHEN {lat} >= 0.6 AND {d} < 0.15 THEN 'latin' "
        f"WHEN {d} = 0 AND {lat} > 0 THEN 'latin' WHEN {lat} = 0 AND {d} > 0 THEN 'deva' ELSE 'mixed' END"
    )


def language_kind(x: str) -> str:
    """empty, indic, mixed, roman or english."""
    t = strip(f"coalesce({x}, '')")
    ws = f"list_transform(regexp_extract_all({t}, {q(f'[a-zA-Z{DEVA}]+')}), lambda w: lower(w))"
    return (
        f"CASE WHEN {t} = '' THEN 'empty' WHEN {letter_devanagari_ratio(t)} >= 0.6 THEN 'indic' WHEN regexp_matches({t}, {q(f'[{DEVA}]')}) AND regexp_matches({t}, '[A-Za-z]') THEN 'mixed' "
        f"WHEN regexp_matches({t}, {q(f'[{DEVA}]')}) THEN 'indic' WHEN len(list_filter({ws}, lambda w: list_contains({words(T.UNAMBIGUOUS_MARKERS)}, w))) >= 1 THEN 'roman' ELSE 'english' END"
    )


QUERY_TYPE = "CASE {k} WHEN 'indic' THEN 'Indic' WHEN 'mixed' THEN 'Code-Mixed' WHEN 'roman' THEN 'Code-Mixed' ELSE 'English' END"
QUERY_SCRIPT = "CASE {k} WHEN 'empty' THEN 'unknown' WHEN 'indic' THEN 'deva' WHEN 'mixed' THEN 'mixed' ELSE 'latin' END"
QUERY_LANG = "CASE {k} WHEN 'indic' THEN 'hi' WHEN 'mixed' THEN 'hi-en' WHEN 'roman' THEN 'hi-en' ELSE 'en' END"


def _stem(w: str) -> str:
    hindi = " ".join(f"WHEN ends_with({w}, {q(s)}) AND length({w}) - {len(s)} >= 3 THEN left({w}, length({w}) - {len(s)})" for s in T.HINDI_SUFFIXES)
    english = " ".join(f"WHEN ends_with({w}, {q(s)}) AND length({w}) - {len(s)} >= 4 THEN left({w}, length({w}) - {len(s)})" + (" || 'y'" if s == "ies" else "") for s in T.ENGLISH_SUFFIXES)
    return f"CASE WHEN regexp_matches({w}, {q(f'^[{DEVA}]')}) THEN (CASE {hindi} ELSE {w} END) ELSE (CASE {english} ELSE {w} END) END"


def tokenize(x: str) -> str:
    raw = f"list_transform(regexp_extract_all({normalize_text(x, join_softwrap=False)}, {q(f'[a-zA-Z0-9]+|[{DEVA}]+')}), lambda w: lower(w))"
    kept = f"list_filter({raw}, lambda w: NOT list_contains({words(T.HINDI_STOPWORDS + T.ENGLISH_STOPWORDS)}, w) AND (regexp_matches(w, {q(f'^[{DEVA}]')}) OR length(w) > 1 OR regexp_matches(w, '^[0-9]$')))"
    return f"list_transform({kept}, lambda w: {_stem('w')})"


def normalize_answer(x: str) -> str:
    t = normalize_digits(normalize_unicode(f"coalesce({x}, '')"))
    for p in T.POSTPOSITIONS:
        t = f"replace({t}, {q(p.replace(' ', ''))}, {q(p)})"
    t = f"lower({sub(f'translate({t}, {q('।॥')}, {q('  ')})', rf'[^\p{{L}}\p{{N}}_{SPACE}{DEVA}]', ' ')})"
    return f"array_to_string(list_filter(regexp_split_to_array({t}, {q(f'[{SPACE}]+')}), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the')), ' ')"


def answer_tokens(x: str) -> str:
    return f"list_filter(string_split({normalize_answer(x)}, ' '), lambda w: w <> '')"


def amount_key(x: str) -> str:
    a = canonical_amounts(f"coalesce({x}, '')")
    return f"CASE WHEN len({a}) = 1 AND len({answer_tokens(x)}) <= 4 THEN ({a})[1] END"
