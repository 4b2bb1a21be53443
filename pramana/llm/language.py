"""Languages of documents and of their one-language stretches, by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.llm.overlap import fold
from pramana.session import cut

#: Bit i of a mask is LANGUAGES[i].
LANGUAGES = ("en", "hi", "hinglish", "mr", "bn", "zh")
SCRIPTS = ("latin", "deva", "beng", "han")
_SCRIPT_OF_LANGUAGE = {"en": "latin", "hinglish": "latin", "hi": "deva", "mr": "deva", "bn": "beng", "zh": "han"}
_FALLBACK = {"latin": "en", "deva": "hi", "beng": "bn", "han": "zh"}
SIZES = (3, 4, 5)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_HASHES = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))

_CODES = {
    "en": "en", "eng": "en", "english": "en",
    "hi": "hi", "hin": "hi", "hindi": "hi",
    "mr": "mr", "mar": "mr", "marathi": "mr",
    "bn": "bn", "ben": "bn", "bengali": "bn", "bangla": "bn",
    "zh": "zh", "zho": "zh", "chi": "zh", "chinese": "zh",
    "hinglish": "hinglish", "hi-en": "hinglish", "en-hi": "hinglish", "hi-latn": "hinglish", "hin-latn": "hinglish",
}


def language_name(label: Column) -> Column:
    """The language a label names, whatever its spelling or region: one of LANGUAGES, ``other`` for another one, null for none."""
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"\s+", " "))), "_", "-")
    codes = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    known = F.coalesce(codes[s], codes[F.split(s, "[- ]")[0]])
    return F.when(known.isNotNull(), known).when(s.isin("", "n/a", "na", "und", "unknown", "none", "null", "nil", "mul", "zxx", "xx", "other") | ~s.rlike(r"\p{L}"), None).when(s.isNotNull(), F.lit("other"))


def runs_of(texts: list[str | None], chars: int = 300_000) -> Iterator[tuple[int, list[str | None]]]:
    """(position of the first, texts) of runs of about so many characters, to bound memory; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point of the basic plane: 0 no letter, else 1 + index of its script, 5 another script."""
    table = np.zeros(65536, np.uint8)
    for c in range(65536):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM":
            table[c] = 1 if c < 0x250 or 0x1E00 <= c < 0x1F00 else 2 if 0x900 <= c < 0x980 else 3 if 0x980 <= c < 0xA00 else 4 if 0x4E00 <= c < 0xA000 or 0x3400 <= c < 0x4DC0 else 5
    return table


def _kinds(code: np.ndarray) -> np.ndarray:
    """The class of each code point, as in _classes; ideographs outside the basic plane are Han, other letters there another script."""
    kind = np.where(code < 65536, _classes()[np.minimum(code, 65535)], 0)
    far = np.flatnonzero(code >= 65536)
    if len(far):
        of = {c: 4 if 0x20000 <= c < 0x34000 else 5 if unicodedata.category(chr(c))[0] in "LM" else 0 for c in np.unique(code[far]).tolist()}
        kind[far] = [of[c] for c in code[far].tolist()]
    return kind


class Grams:
    """Hashed n-grams of the folded letters of some texts; all other characters are one space.

    value: hash of each n-gram; owner: its text; script: its script's class, 0 where it mixes scripts; letters: (texts, 6)
    letters by class.
    """

    def __init__(self, texts: list[str | None]):
        codes, owner = [], []
        for i, t in enumerate(texts):
            c = np.frombuffer((" " + fold(t or "") + " ").encode("utf-32-le", "replace"), np.uint32)
            codes.append(c)
            owner.append(np.full(len(c), i, np.int64))
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        text = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        kind = _kinds(code)
        self.letters = np.bincount(text * 6 + kind, minlength=6 * len(texts)).reshape(-1, 6).astype(np.int64)
        space = kind == 0
        keep = ~space | np.r_[True, ~space[:-1]] | (np.diff(text, prepend=-1) != 0)
        code, text, kind = np.where(space, 32, code)[keep].astype(np.uint64), text[keep], kind[keep]
        values, owners, scripts = [], [], []
        for n in SIZES:
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            low, high = np.full(m, 9, np.uint8), np.zeros(m, np.uint8)
            for j in range(n):
                h = (h ^ code[j : j + m]) * _PRIME
                h ^= h >> np.uint64(29)
                k = kind[j : j + m]
                low, high = np.where(k > 0, np.minimum(low, k), low), np.maximum(high, k)
            ok = (text[:m] == text[n - 1 :]) & (high > 0) & (kind[1 : 1 + m] > 0)
            values.append(h[ok])
            owners.append(text[:m][ok])
            scripts.append(np.where(low == high, high, 0)[ok])
        self.value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.script = np.concatenate(scripts) if scripts else np.zeros(0, np.uint8)


_ABBREVIATIONS = frozenset(map(fold, "rs re no nos dr mr mrs ms st sec art cl fig approx etc vs cf govt dept inr q रु डॉ सं नं क्र श्री पं q प्र ডা ড নং".split()))
_BREAK = regex.compile(r"(?<=[?!।॥？！。])[\"'”’)\]]*\s*(?=\S)|(?<=\.)[\"'”’)\]]*\s+(?=\S)|\s+[/|•]\s+|\s*\n\s*\n\s*")
_LAST_WORD = regex.compile(r"([\p{L}\p{M}]+)\.[\"'”’)\]]*\s*$")


_UNIT = regex.compile(r"\p{Han}|[\p{L}\p{M}--\p{Han}]+", regex.V1)


def stretches(text: str | None) -> list[tuple[str, str]]:
    """(what tells the language, whole) of the sentences of a short text; an abbreviation's stop ends none.

    A sentence of a single word, a cut-off opening or numbering goes with the next one, at the end with the last one, whose words tell
    the language. Where there are only such parts the whole text is one. Ideographs are words each.
    """
    out: list[str] = []
    at = 0
    t = text or ""
    for m in _BREAK.finditer(t):
        part = t[at : m.start()]
        last = _LAST_WORD.search(part)
        if last and (fold(last[1]) in _ABBREVIATIONS or (len(last[1]) == 1 and last[1].isalpha())):
            continue
        out.append(t[at : m.end()])
        at = m.end()
    out.append(t[at:])
    got: list[tuple[str, str]] = []
    before = ""
    for part in out:
        if len(_UNIT.findall(part)) > 1:
            got.append((part.strip(), before + part))
            before = ""
        else:
            before += part
    if not got:
        return [(t, t)]
    got[-1] = (got[-1][0], got[-1][1] + before)
    return [(core, whole.strip()) for core, whole in got]


_LATIN_WORD = regex.compile(r"[A-Za-z]{2,}")


class LanguageFilters:
    """n-gram filters: position h of the table holds the bits of the languages that may contain an n-gram of hash h.

    An n-gram is of a language if the share of the language's training texts that have it is at least ``ratio`` of its
    largest share in any language; so mislabelled training texts don't spoil a filter. All languages of an n-gram come from
    the AND of three positions. The share of a text's n-grams that a language's filter has, less the filter's rate of false
    positives, is the language's score; only n-grams of the text's main script count. Hindi with Latin words that English or
    romanized Hindi knows is hinglish. Without any known n-gram the script decides.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        fill = np.array([np.mean((table >> i) & 1) for i in range(len(LANGUAGES))])
        self.false = fill ** len(_HASHES)

    @staticmethod
    def positions(value: np.ndarray, bits: int) -> list[np.ndarray]:
        return [((value * a) >> np.uint64(64 - bits)).astype(np.int64) for a in _HASHES]

    def masks(self, value: np.ndarray) -> np.ndarray:
        bits = int(np.log2(len(self.table)))
        a, b, c = self.positions(value, bits)
        return self.table[a] & self.table[b] & self.table[c]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected shares, and each text's main script (index into SCRIPTS, -1 for none)."""
        return self._scores(Grams(texts), len(texts))

    def _scores(self, g: Grams, n: int) -> tuple[np.ndarray, np.ndarray]:
        letters = g.letters[:, 1:5]
        # Latin words stand in texts of other scripts rather than the other way round: those need a quarter only.
        weight = letters * np.array([1, 3, 3, 3])
        main = np.where(letters.sum(1) > 0, weight.argmax(1), -1)
        use = g.script == main[g.owner] + 1
        owner, mask = g.owner[use], self.masks(g.value[use])
        total = np.bincount(owner, minlength=n).astype(float)
        out = np.zeros((n, len(LANGUAGES)))
        for i, name in enumerate(LANGUAGES):
            hit = np.bincount(owner, weights=(mask >> i) & 1, minlength=n)
            share = (hit / np.maximum(total, 1) - self.false[i]) / (1 - self.false[i])
            fits = np.array([s >= 0 and SCRIPTS[s] == _SCRIPT_OF_LANGUAGE[name] for s in main], bool)
            out[:, i] = np.where(fits, np.maximum(share, 0), 0)
        return out, main

    def detect(self, texts: list[str | None], grams: Grams | None = None) -> list[tuple[str | None, float]]:
        """Language and confidence of each text taken as in one language; (None, 0) without letters. ``grams``: those of the texts, if at hand."""
        score, main = self._scores(grams or Grams(texts), len(texts))
        best = score.argmax(1)
        found: list[tuple[str | None, float]] = []
        for i, t in enumerate(texts):
            if main[i] < 0:
                found.append((None, 0.0))
                continue
            top = score[i, best[i]]
            lang = LANGUAGES[best[i]] if top > 0 else _FALLBACK[SCRIPTS[main[i]]]
            rest = np.delete(score[i], best[i]).max()
            sure = float((top - rest) / top) if top > 0 else 0.0
            found.append((lang, round(0.5 + sure / 2, 6)))
        for i in self._woven(texts, [i for i, f in enumerate(found) if f[0] == "hi"]):
            found[i] = ("hinglish", found[i][1])
        return found

    def _woven(self, texts: list[str | None], among: list[int]) -> list[int]:
        """Which of the texts ``among`` have a Latin word that English or romanized Hindi knows; capitalized words are names unless all words are."""
        words, owner = [], []
        for i in among:
            own = _LATIN_WORD.findall(texts[i] or "")
            cased = any(w != w.upper() and w != w.lower() for w in own)
            own = [w for w in own if fold(w) not in _ABBREVIATIONS and not (cased and w[0].isupper())]
            words += own
            owner += [i] * len(own)
        if not words:
            return []
        g = Grams(words)
        known = np.bincount(g.owner, weights=(self.masks(g.value) & 5) > 0, minlength=len(words)) / np.maximum(np.bincount(g.owner, minlength=len(words)), 1)
        return sorted({o for o, k in zip(owner, known) if k >= 0.5})

    def segment(self, texts: list[str | None]) -> list[list[tuple[str | None, float, str]]]:
        """Of each text the (language, confidence, text) of its longest stretches in one language, in reading order."""
        parts = [stretches(t) for t in texts]
        found = iter(self.detect([core for own in parts for core, _ in own]))
        all_out: list[list[tuple[str | None, float, str]]] = []
        for own in parts:
            out: list[tuple[str | None, float, str]] = []
            for _, part in own:
                lang, sure = next(found)
                if out and (lang is None or out[-1][0] is None or out[-1][0] == lang):
                    was = out[-1]
                    out[-1] = (was[0] or lang, min(was[1], sure) if was[0] and lang else max(was[1], sure), was[2] + " " + part)
                else:
                    out.append((lang, sure, part))
            all_out.append(out)
        return all_out


def fit_filters(labelled: DataFrame, *, bits: int = 21, max_texts: int = 4000, ratio: float = 0.6, second_ratio: float = 0.4, rounds: int = 2, least: int = 1) -> LanguageFilters:
    """Filters from ``labelled`` (text, lang), whose labels may be partly wrong.

    At most ``max_texts`` different texts a language are used, those of the smallest hashes: the documented bound of the sample. Only
    hashes below a bound that leaves about four times as many, from an approximate count of the different texts, are exchanged to choose
    them; so no task gets more, however many texts a language has. A text whose letters are for the most part not of its language's script is
    left out. A second round leaves out texts the first one finds in another language. The table has 2**bits bytes, whatever the data.
    """
    some = labelled.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = some.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row for each of LANGUAGES
    bounds = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(min((1 << 63) - 1, int(4 * max_texts / max(r["n"], 1) * (1 << 64)) - (1 << 63))))]
    few = some.where(F.col("h") <= F.create_map(*bounds)[F.col("lang")]) if bounds else some
    first = Window.partitionBy("lang").orderBy("h")
    # At most max_texts rows for each of LANGUAGES.
    chosen = few.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_texts).select("lang", "h")
    sample = cut(few.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang").repartition(8, "text"))
    filters: LanguageFilters | None = None
    for step in range(rounds):
        filters = _count(sample, filters, bits, second_ratio if step else ratio, least)
    assert filters is not None
    return filters


def _count(sample: DataFrame, before: LanguageFilters | None, bits: int, ratio: float, least: int) -> LanguageFilters:
    n = len(LANGUAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n, np.int64)
        parts_v, parts_c = [], []
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array([LANGUAGES.index(x) for x in b.column(1).to_pylist()], np.int64)
            if not texts:
                continue
            g = Grams(texts)
            own = g.letters[np.arange(len(texts)), [SCRIPTS.index(_SCRIPT_OF_LANGUAGE[LANGUAGES[x]]) + 1 for x in langs]]
            fits = (own > 0) & (own > 0.8 * g.letters[:, 1:].sum(1))
            if before is not None:
                fits &= [f[0] == LANGUAGES[x] for f, x in zip(before.detect(texts, g), langs)]
            seen += np.bincount(langs[fits], minlength=n)
            keep = fits[g.owner]
            value, owner = g.value[keep], g.owner[keep]
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            once = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])][: len(value)]
            value, owner = value[once], owner[once]
            starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]][: len(value)])
            at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(value)]))
            counts = np.bincount(at * n + langs[owner], minlength=len(starts) * n).reshape(-1, n).astype(float)
            value = value[starts]
            parts_v.append(value)
            parts_c.append(counts)
        value = np.concatenate([*parts_v, np.zeros(1, np.uint64)])
        counts = np.concatenate([*parts_c, seen[None].astype(float)])  # the row of hash 0 counts the texts
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *[pa.array(counts[:, i]) for i in range(n)]], ["v", *[f"c{i}" for i in range(n)]])

    cols = [f"c{i}" for i in range(n)]
    sums = cut(sample.mapInArrow(run, "v long, " + ", ".join(f"{c} double" for c in cols)).groupBy("v").agg(*[F.sum(c).alias(c) for c in cols]))
    totals = sums.where("v = 0").select(*cols).first()
    shares = [F.col(c) / float(max(totals[c], 1)) if totals else F.lit(0.0) for c in cols]
    top = F.greatest(*shares)
    mask = sum((F.when((s >= F.lit(ratio) * top) & (F.col(c) >= least), 1 << i).otherwise(0) for i, (s, c) in enumerate(zip(shares, cols))), F.lit(0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, m = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for p in LanguageFilters.positions(value, bits):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(m.astype(np.int32))], ["p", "m"])

    placed = sums.where("v <> 0").select("v", mask.alias("m")).where("m > 0").mapInArrow(place, "p long, m int").groupBy("p").agg(F.bit_or("m").alias("m"))
    got = placed.toPandas()  # at most 2**bits rows
    table = np.zeros(1 << bits, np.uint8)
    table[got["p"].to_numpy()] = got["m"].to_numpy()
    return LanguageFilters(table)


def detect_segments(df: DataFrame, filters: LanguageFilters, *, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, seg_no, lang, confidence, segment`` and the columns ``keep``: one row per longest one-language stretch; ``seg_no`` 0 if there is just one, else 1, 2, ...

    Texts without letters, null and empty ones have one row with a null language and confidence 0.
    """
    kinds = dict(df.dtypes)
    sent = df.sparkSession.sparkContext.broadcast(filters.table)  # 2**bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = LanguageFilters(sent.value)
        for b in batches:
            rows = []
            texts = b.column(1).to_pylist()
            for first, run_of in runs_of(texts):
                for i, segs in enumerate(f.segment(run_of), first):
                    rows += [(i, k + (len(segs) > 1), *s) for k, s in enumerate(segs)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.string())] + [b.column(2 + i).take(at) for i in range(len(keep))],
                [id_col, "seg_no", "lang", "confidence", "segment", *keep],
            )

    return df.select(id_col, text_col, *keep).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, seg_no int, lang string, confidence double, segment string" + "".join(f", `{c}` {kinds[c]}" for c in keep))
