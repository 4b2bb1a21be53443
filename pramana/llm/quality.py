"""Text quality statistics per document, their tails per language, and a verdict of prose, list, table or junk."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.llm.overlap import fold, remembered

#: Words of grammar that hold sentences together. Articles and the joints of noun phrases are left out: list items have them too.
GRAMMAR = frozenset(
    map(
        fold,
        """is are was were be been being am do does did has have had will would shall should can could may might must not no in on at to for by with from that this these those it they he she we you who which what when where why how
        if than then but or so as there here within under about after before since until during each every all any some more most only also still between into over above below through because while whose them their his her our your per twice
        में से को ने पर है हैं हो था थे थी थीं हुआ हुई हुए गया गई गए जाता जाती जाते किया की करते करता करती करने कर दिया दी दिए देता देती देते लिया लिए होता होती होते नहीं न तक भी ही तो यह वह ये वे इस उस इन उन जो जिस जिन जिन्हें क्या कौन कब कहां क्यों कैसे यदि और तथा या कि लेकिन परंतु क्योंकि साथ बाद पहले भीतर अंतर्गत अनुसार द्वारा हेतु रहा रही रहे सकता सकती सकते चाहिए मिले मिलता मिलती मिलते हर प्रति बहुत
        mein me se ko ne par pe hai hain ho tha thi hua hui hue gaya gayi gaye jata jati jaata jaati jaate kiya kar karte karta karti diya di diye deta dete liya liye hota hoti hote nahi nahin na tak bhi hi toh yeh ye woh wo is us jo kya kaun kab kahan kyon kaise agar aur ya ki lekin kyunki saath baad pehle andar hisaab milta milte milti rahe raha rahi sakta sakte sakti chahiye har bahut wale wali
        आहे आहेत होते होता होती झाली झाला झाले नाही मध्ये ला ना ने च्या येथे साठी आणि किंवा जर तर हे ही तो ती ते करावा मिळतात
        হয় হয়েছে ছিল করা করে করতে নেই না এই সেই ও এবং বা যদি জন্য মধ্যে থেকে দিতে হবে যায় পায়""".split(),
    )
) - frozenset(map(fold, ["की", "ki"]))

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*")
_ITEM = regex.compile(r"\s*(?:[-*•–—▪◦‣·●○■□>+]+|\(?(?:\d{1,3}|[ivxlIVXL]{1,5}|\p{L}\p{M}?)[.)]|\[[ xX]?\])\s+")
_FIELD = regex.compile(r"^\s*[^\s:|;][^:|;.!?।]{0,24}:\s*\S[^:।]{0,40}$")
_MARKS = frozenset(".,;:!?'\"()-–—/&%।॥₹$€£|•·*=_“”‘’…[]+@#°​‌‍")
_HEX = regex.compile(r"^(?=.*\d)(?=.*[a-f])[0-9a-f]{8,}$|^0x[0-9a-f]+|^[A-Za-z0-9+/=]{40,}$")
_CODE = regex.compile(r"[{}]|\bfunction\s*\(|=>|\|\||&&|==|</?\w+[^>]{0,80}/?>|[)\]']\s*;\s*$|\b(?:var|let|const|return|import|def|class|null|void|int|printf?|console)\b")
_VOWEL = regex.compile(r"[aeiouy]")
_BROKEN = regex.compile(r"[\u0080-\u009f�]|[ÃÂâàáÅÐÑ][\u0080-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")

STATISTICS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "n_lines", "words_a_line", "closed_lines", "common_words", "top_phrase", "list_share", "table_share", "junk_share", "prose_share")
#: The statistics whose tails count against prose, and on which side.
TAILS = {"common_words": -1, "symbol_ratio": 1, "top_phrase": 1, "list_share": 1, "table_share": 1, "junk_share": 1, "prose_share": -1}


_ODD = regex.compile(r"[[\p{S}\p{P}\p{C}]--[" + regex.escape("".join(sorted(_MARKS))).replace(r"\ ", " ") + r"\s]]", regex.V1)
_SYMBOL = regex.compile(r"[\p{S}\p{P}\p{C}--\s]", regex.V1)
_DIGIT = regex.compile(r"\p{Nd}")
_BREAKS = regex.compile(r"[;·•|,\n]|\s/\s|\s[-–—]\s|(?<=\p{L}\p{M}*)\.(?=\s|$)|\s\(?(?:\d{1,3}|[a-z])[.)]\s")
_HEADING = regex.compile(r"\s*=+[^=]+=+\s*|\s*#+\s.*")


_DIGEST = regex.compile(r"(?<!\S)(?:[0-9a-f]{8,}(?!\S)|0x[0-9a-f]|[A-Za-z0-9+/=]{40,}(?!\S))")
_LETTERS = regex.compile(r"\p{L}{2,}")
_WIDE = regex.compile(r"\s{2,}")
_COMMA = regex.compile(r",(?!\s|\d\d)")


@remembered
def _look(word: str) -> tuple[int, int, int]:
    """Is the word one of grammar, a Latin one of three letters or more, and such a one without vowels?"""
    latin = len(word) >= 3 and word.isascii()
    return word in GRAMMAR, latin, latin and not _VOWEL.search(word)


class _Line:
    """A line, its folded words, how many are words of grammar, Latin and without vowels, and its characters other than white space."""

    __slots__ = ("text", "words", "grammar", "latin", "mute", "solid", "length")

    def __init__(self, text: str):
        self.text = text
        self.words = _WORD.findall(fold(text))
        looks = [_look(w) for w in self.words]
        self.grammar, self.latin, self.mute = (sum(x) for x in zip(*looks)) if looks else (0, 0, 0)
        self.solid = len("".join(text.split()))
        self.length = sum(map(len, self.words))


@lru_cache(maxsize=100_000)
def _sort(c: str) -> tuple[bool, bool, bool, bool]:
    """Is the character a symbol, a digit, an odd one, and one that a broken encoding may have?"""
    return bool(_SYMBOL.match(c)), bool(_DIGIT.match(c)), bool(_ODD.match(c)), c in _LEADS or "\u0080" <= c <= "\u009f"


_LEADS = frozenset("\ufffdÃÂâàáÅÐÑ")


class _Signs:
    """Which signs of junk the whole text has at all, so that its lines need not be searched for the others."""

    __slots__ = ("odd", "broken", "digest", "code", "symbols", "digits")

    def __init__(self, text: str):
        self.symbols = self.digits = 0
        self.odd = broken = False
        for c, n in Counter(text).items():
            symbol, digit, odd, lead = _sort(c)
            self.symbols += n * symbol
            self.digits += n * digit
            self.odd |= odd
            broken |= lead
        self.broken = broken and bool(_BROKEN.search(text))
        self.digest, self.code = bool(_DIGEST.search(text)), bool(_CODE.search(text))


def _fields(line: str) -> int:
    """Fields of a line if it looks like a row of a table, else 0."""
    s = line.strip()
    best = 0
    for mark, parts in (("|", s.strip("|").split("|")), ("\t", s.split("\t")), ("  ", _WIDE.split(s)), (";", s.split(";")), (",", _COMMA.split(s) if "," in s else [])):
        if mark not in s or len(parts) < 3:
            continue
        parts = [p.strip() for p in parts]
        if sum(bool(p) for p in parts) >= 0.6 * len(parts) and max(len(p.split()) for p in parts) <= 7:
            best = max(best, len(parts))
    return best


def _is_junk(block: str, lines: list[_Line], signs: _Signs) -> bool:
    """No language: symbols, broken encoding, code, digests, or words that can't be spoken."""
    solid = sum(x.solid for x in lines)
    if not solid:
        return False
    if signs.odd and len(_ODD.findall(block)) > 0.06 * solid or signs.broken and len(_BROKEN.findall(block)) > 0.03 * solid:
        return True
    if signs.digest:
        tokens = block.split()
        if sum(len(t) >= 8 and bool(_HEX.match(t)) for t in tokens) > 0.4 * len(tokens):
            return True
    words = sum(len(x.words) for x in lines)
    if signs.code and sum(x.grammar for x in lines) < 0.1 * max(words, 1) and len(_CODE.findall(block)) > 0.02 * solid:
        return True
    latin = sum(x.latin for x in lines)
    if latin >= 5 and sum(x.mute for x in lines) > 0.4 * latin:
        return True
    return solid > 20 and sum(x.length for x in lines) < 0.2 * solid and not _LETTERS.search(block)


def _shares(lines: list[_Line], signs: _Signs) -> Counter:
    """Characters other than white space by what the part of the text that has them looks like."""
    size: Counter = Counter()
    plain: list[_Line] = []
    fields = {i for i, x in enumerate(lines) if len(x.words) <= 9 and _FIELD.match(x.text)}
    keys = Counter(lines[i].text.split(":")[0].strip() for i in fields)
    records = {k for k, n in keys.items() if n >= 2} if len(fields) >= 3 else set()

    def block(own: list[_Line]) -> None:
        if not own:
            return
        text = "\n".join(x.text for x in own)
        words = [w for x in own for w in x.words]
        grammar, n = sum(x.grammar for x in own), sum(x.solid for x in own)
        if _is_junk(text, own, signs):
            size["junk"] += n
        elif len(words) < 6:
            size["short"] += n
        else:
            items = [len(_WORD.findall(x)) for x in _BREAKS.split(text)]
            items = [k for k in items if k]
            brief = sum(k <= 5 for k in items) / max(1, len(items))
            if grammar < 0.06 * len(words) and (len(items) >= 4 and brief >= 0.7 or len(own) >= 3 and len(words) <= 6 * len(own)):
                size["list"] += n
            elif grammar < 0.02 * len(words) and len(words) >= 40:
                size["junk"] += n
            else:
                size["prose"] += n

    def flush() -> None:
        # Runs of brief lines without grammar are lists of their own, whatever stands before and after.
        own, rest, at = list(plain), [], 0
        plain.clear()
        while at < len(own):
            end = at
            while end < len(own) and len(own[end].words) <= 6 and own[end].grammar * 6 <= len(own[end].words):
                end += 1
            run = own[at:end]
            if len(run) >= 4 and sum(x.grammar for x in run) < 0.06 * sum(len(x.words) for x in run):
                block(rest)
                rest = []
                block(run)
            else:
                rest += own[at : max(end, at + 1)]
            at = max(end, at + 1)
        block(rest)

    columns = [_fields(x.text) for x in lines]
    for i, x in enumerate(lines):
        if not x.solid:
            flush()
            continue
        near = [columns[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(lines) and columns[j]]
        item = _ITEM.match(x.text)
        if x.solid > 12 and _is_junk(x.text, [x], signs):
            flush()
            size["junk"] += x.solid
        elif i in fields and x.text.split(":")[0].strip() in records:
            flush()
            size["table"] += x.solid
        elif columns[i] >= 3 and columns[i] in near and not item and x.grammar < 0.12 * max(len(x.words), 1):
            flush()
            size["table"] += x.solid
        elif item:
            flush()
            size["list" if len(x.words) <= 9 and x.grammar < 0.12 * max(len(x.words), 1) else "prose"] += x.solid
        elif _HEADING.fullmatch(x.text):
            flush()
            size["short"] += x.solid
        else:
            plain.append(x)
    flush()
    return size


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one text. A text without characters other than white space has zeros."""
    t = unicodedata.normalize("NFC", text or "")
    lines = [_Line(x) for x in t.splitlines()]
    solid = sum(x.solid for x in lines)
    if not solid:
        return [float(len(text or ""))] + [0.0] * (len(STATISTICS) - 1)
    words = [w for x in lines for w in x.words]
    full = [x for x in lines if x.solid]
    phrases = Counter(zip(words, words[1:], words[2:]))
    # Of the words, the share that the most frequent run of three covers.
    most = max(phrases.values(), default=0)
    top = 3 * most / len(words) if most > 2 else 0.0
    signs = _Signs(t)
    size = _shares(lines, signs)
    total = max(sum(size.values()), 1)
    return [
        float(len(text or "")),
        float(len(words)),
        sum(x.length for x in lines) / max(len(words), 1),
        signs.symbols / solid,
        signs.digits / solid,
        float(len(full)),
        len(words) / len(full),
        sum(x.text.rstrip(" \t\"'”’)")[-1:] in tuple(".?!।॥|。！？") for x in full) / len(full),
        sum(x.grammar for x in lines) / max(len(words), 1),
        min(top, 1.0),
        size["list"] / total,
        size["table"] / total,
        size["junk"] / total,
        (size["prose"] + size["short"]) / total,
    ]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang: Column) -> DataFrame:
    """``id_col, lang`` and the STATISTICS of each row; null and blank texts have zeros."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(len(STATISTICS))]], [id_col, "lang", *STATISTICS])

    return docs.select(id_col, F.coalesce(lang, F.lit("und")).alias("lang"), text_col).mapInArrow(run, f"`{id_col}` {kind}, lang string, " + ", ".join(f"{s} double" for s in STATISTICS))


class Kll:
    """A KLL quantile sketch. An item of level i stands for 2**i values; together the items stand for all values that were added.

    Up to ``k`` values are kept as they are, about 3 * k items at most. When there are too many, every other item of the lowest full level,
    in order of size, goes up a level; a coin says whether the even or the odd ones, so errors of ranks cancel out. The coins
    come from ``seed``: the same values in the same order give the same sketch.
    """

    def __init__(self, seed: str, k: int = 2048):
        self.k, self.coins, self.levels = k, Random(seed), [np.empty(0)]

    def add(self, items: np.ndarray, level: int = 0) -> None:
        """Add values or, level by level, the items of another sketch."""
        while len(self.levels) <= level:
            self.levels.append(np.empty(0))
        self.levels[level] = np.concatenate([self.levels[level], items[~np.isnan(items)]])
        while sum(map(len, self.levels)) > sum(room := self._room()):
            at = next(i for i, x in enumerate(self.levels) if len(x) > room[i])
            x = np.sort(self.levels[at])
            odd = len(x) % 2
            if at + 1 == len(self.levels):
                self.levels.append(np.empty(0))
            self.levels[at + 1] = np.concatenate([self.levels[at + 1], x[odd + self.coins.getrandbits(1) :: 2]])
            self.levels[at] = x[:odd]

    def _room(self) -> list[int]:
        return [max(8, math.ceil(self.k * (2 / 3) ** i)) for i in range(len(self.levels) - 1, -1, -1)]


def sketches(stats: DataFrame, *, k: int = 2048) -> DataFrame:
    """``lang, statistic, level, items``: a KLL sketch of each of STATISTICS over the texts with words of each language.

    Each task makes sketches of its own rows, then those of a language and statistic are merged one by one, so a task holds a sketch's
    items, not the rows. Sketches of other tables are merged by ``merged``. The same partitions give the same sketches; up to
    ``k`` texts a language a sketch is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), {}
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                for s in STATISTICS:
                    if (lang, s) not in own:
                        own[lang, s] = Kll(f"{part} {lang} {s}", k)
                    own[lang, s].add(b.column(s).to_numpy(zero_copy_only=False)[codes == i])
        for (lang, s), sketch in own.items():
            yield _levels(lang, s, sketch, part)

    texts = stats.where("n_words > 0").select("lang", *[F.col(s).cast("double").alias(s) for s in STATISTICS])
    return merged(texts.mapInArrow(run, _SKETCH + ", part int"), k=k)


_SKETCH = "lang string, statistic string, level int, items array<double>"


def _levels(lang: str, statistic: str, sketch: Kll, *part: int) -> pa.RecordBatch:
    """The levels of a sketch as rows."""
    n = len(sketch.levels)
    rows = [pa.array([lang] * n, pa.string()), pa.array([statistic] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(sketch.levels, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(rows + [pa.array([p] * n, pa.int32()) for p in part], ["lang", "statistic", "level", "items", "part"][: 4 + len(part)])


def merged(sketch: DataFrame, *, k: int = 2048) -> DataFrame:
    """``lang, statistic, level, items``: one sketch a language and statistic out of the ``sketch`` rows of any number of tables, in order of ``part`` if it is there."""
    order = [c for c in ("lang", "statistic", "part", "level", "items") if c in sketch.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for b in batches:
            for lang, s, level, items in zip(b.column("lang").to_pylist(), b.column("statistic").to_pylist(), b.column("level").to_pylist(), b.column("items")):
                if (lang, s) != key:
                    if own:
                        yield _levels(*key, own)
                    key, own = (lang, s), Kll(f"{lang} {s}", k)
                own.add(items.values.to_numpy(zero_copy_only=False), level)
        if own:
            yield _levels(*key, own)

    return sketch.repartition("lang", "statistic").sortWithinPartitions(*order).mapInArrow(run, _SKETCH)


def references(sketch: DataFrame, *, least: int = 100) -> list[tuple]:
    """(language, location and spread of each of TAILS) of each language, and of texts in no language of the sketch as None.

    Both come from the good half of the distribution only: where much counts against prose, the 30 % quantile and its distance from the
    5 % quantile, else the 70 % and the 95 % one. So texts that are no prose don't shift or widen them even if they are more than half of all.
    A language's sketch is merged with that of all, scaled to ``least`` texts, so few texts of a language count little.
    The items of the sketches, which don't grow with the data, are collected.
    """
    own: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in sorted(sketch.where(F.col("statistic").isin(*TAILS)).collect(), key=lambda r: (r["lang"], r["statistic"], r["level"])):
        items = np.array(r["items"])
        own.setdefault((r["lang"], r["statistic"]), []).append((items, np.full(len(items), 2.0 ** r["level"])))
    langs = sorted({x for x, _ in own})
    out = []
    for lang in [*langs, None]:
        row: list = [lang]
        for s, side in TAILS.items():
            every = [x for y in langs for x in own.get((y, s), [])]
            scale = least / max(sum(w.sum() for _, w in every), 1)
            both = own.get((lang, s), []) + [(x, w * scale) for x, w in every]
            near, far = _quantiles(both, (0.3, 0.05) if side > 0 else (0.7, 0.95))
            row += [near, abs(near - far) / 1.12]  # the distance of these quantiles in a normal distribution
        out.append(tuple(row))
    return out


def _quantiles(sketch: list[tuple[np.ndarray, np.ndarray]], shares: tuple[float, ...]) -> list[float]:
    """The least item up to which each of ``shares`` of the weights lies; 0 without items."""
    items, weights = (np.concatenate([np.empty(0), *x]) for x in (zip(*sketch) if sketch else ((), ())))
    if not len(items):
        return [0.0] * len(shares)
    order = np.argsort(items, kind="stable")
    upto = np.cumsum(weights[order])
    return [float(items[order][min(np.searchsorted(upto, q * upto[-1]), len(items) - 1)]) for q in shares]


def verdicts(stats: DataFrame, sketch: DataFrame, *, id_col: str = "doc_id", least: int = 100, z: float = 3.0, floor: float = 0.02) -> DataFrame:
    """``id_col, lang, kind, tails`` and each tail statistic's robust z-score as ``z_...``.

    A score is the distance from the language's location in units of its spread (see ``references``), ``floor`` at least; for the share of
    common words, of which a short text has few by chance, the error of a share of so many words is added. tails: the statistics
    beyond ``z`` on the bad side. A text without tails is prose. A text with tails is list, table or junk, whichever of these shares is farthest out in its
    tail, if the check of its own parts confirms that they are the most of the text, or junk if one phrase makes up half of it. Null and blank texts are prose.
    """
    rows = references(sketch, least=least)
    spark = stats.sparkSession
    # One row a language: as many as language_name() knows.
    table = spark.createDataFrame(rows, "of string, " + ", ".join(f"m_{s} double, s_{s} double" for s in TAILS))
    known = stats.withColumn("of", F.when(F.col("lang").isin(*[r[0] for r in rows if r[0] is not None]), F.col("lang")))
    x = known.join(F.broadcast(table), known["of"].eqNullSafe(table["of"]))
    for s, side in TAILS.items():
        spread = F.greatest(F.col(f"s_{s}"), F.lit(floor))
        if s == "common_words":
            p = F.greatest(F.col(f"m_{s}"), F.lit(0.01))
            spread = F.sqrt(spread * spread + p * (1 - p) / F.greatest("n_words", F.lit(1)))
        x = x.withColumn(f"z_{s}", F.round((F.col(s) - F.col(f"m_{s}")) / spread, 4))
    x = x.withColumn("tails", F.array_compact(F.array(*[F.when(F.col(f"z_{s}") * side > z, F.lit(s)) for s, side in TAILS.items()])))
    most = F.greatest("z_list_share", "z_table_share", "z_junk_share")
    confirmed = F.col("prose_share") < 0.5
    phrase = F.array_contains("tails", "top_phrase") & (F.col("top_phrase") > 0.5) & (F.col("n_words") >= 9)
    kind = (
        F.when((F.col("n_lines") == 0) | (F.size("tails") == 0), "prose")
        .when(phrase & (F.col("table_share") < 0.5), "junk")
        .when(~confirmed | (most <= z), "prose")
        .when(most == F.col("z_junk_share"), "junk")
        .when(most == F.col("z_table_share"), "table")
        .otherwise("list")
    )
    return x.select(id_col, "lang", kind.alias("kind"), "tails", *[f"z_{s}" for s in TAILS])
