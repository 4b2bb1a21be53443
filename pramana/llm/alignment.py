"""Alignment of the sentence units of documents in two languages, by entropic optimal transport with null masses."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.llm.overlap import fold, remembered
from pramana.session import cut

_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_TOKEN = regex.compile(r"\d+(?:[,.]\d+)*|[\p{L}\p{M}]+")
# The sound of each Devanagari consonant, in classes that English spelling keeps apart from each other.
_SOUNDS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "k k g g n c c j j n t t d d n t t d d n p f b b m . r l l . s s s .".split()))
_LATIN = [("ksh", "ks"), ("sh", "s"), ("chh", "c"), ("ch", "c"), ("ph", "f"), ("ck", "k"), ("tion", "sn"), ("x", "ks"), ("q", "k"), ("c", "k"), ("z", "j")]


_SOFT, _TWICE = regex.compile("[aeiouywvh]"), regex.compile(r"(.)\1+")


@remembered
def skeleton(word: str) -> str:
    """The consonants a word sounds with, alike in Latin and Devanagari spelling; vowels, glides and breath are left out."""
    w = word
    if any("ऀ" <= c <= "ॿ" for c in w):
        w = w.replace("ढ़", "r").replace("ड़", "d")
        w = "".join("n" if c == "ं" else c if c in "rd" else _SOUNDS.get(c, "") for c in w).replace(".", "")
    else:
        for a, b in _LATIN:
            w = w.replace(a, b)
        w = _SOFT.sub("", w)
    return _TWICE.sub(r"\1", w)


def tokens(unit: str) -> tuple[list[str], list[str], list[str]]:
    """(words, numbers, skeletons) of a unit, each in one form."""
    t = fold(unit)
    found = _TOKEN.findall(t)
    words = [w for w in found if not w[0].isdigit()]
    numbers = [w.replace(",", "").rstrip(".") for w in found if w[0].isdigit()]
    # Folding drops the dot below, which the skeleton needs.
    bones = {skeleton(w.casefold()) for w in _LETTERS.findall(unit)}
    return words, numbers, sorted(b for b in bones if len(b) >= 3)


def sinkhorn(i: np.ndarray, j: np.ndarray, cost: np.ndarray, a: np.ndarray, b: np.ndarray, null: float, epsilon: float, rounds: int) -> np.ndarray:
    """The plan at the places (i, j) of ``cost`` between masses a and b, where any mass may stay unmatched at cost ``null``: a null row and column take it up. Other places carry none."""
    n, m = len(a), len(b)
    # The null row and column, with the corner between them at cost 0, are further places.
    skip = math.exp(-null / epsilon)
    row = np.concatenate([i, np.arange(n), np.full(m, n), [n]])
    col = np.concatenate([j, np.full(n, m), np.arange(m), [m]])
    k = np.concatenate([np.exp(-cost / epsilon), np.full(n + m, skip), [1.0]])
    a, b = np.append(a, b.sum()), np.append(b, a.sum())
    u, v = np.ones(n + 1), np.ones(m + 1)
    for step in range(rounds):
        was = u
        u = a / np.bincount(row, k * v[col], n + 1)
        v = b / np.bincount(col, k * u[row], m + 1)
        if step % 5 == 4 and np.abs(u / was - 1).max() < 1e-3:
            break
    return u[i] * k[: len(i)] * v[j]


#: Rows of units compared at once; bounds memory for documents of any length.
_ROWS = 512


class Side:
    """The units of one document in arrays: features as (unit, number of the feature, weight), of which each unit's vector is made."""

    def __init__(self, keys: list[tuple[str, int]], sizes: list[int], unit: np.ndarray, feature: np.ndarray, weight: np.ndarray, numbers: list[frozenset[str]]):
        self.keys, self.sizes, self.numbers = keys, np.array(sizes, float), numbers
        n = len(keys)
        norm = np.sqrt(np.bincount(unit, weight * weight, n))
        order = np.argsort(unit, kind="stable")
        self.unit, self.feature, self.weight = unit[order], feature[order], (weight / np.maximum(norm[unit], 1e-12))[order]
        self.first = np.searchsorted(self.unit, np.arange(n + 1))

    def __len__(self) -> int:
        return len(self.keys)

    def block(self, start: int, stop: int, known: np.ndarray) -> np.ndarray:
        """Dense vectors of the units start .. stop over the features ``known`` (sorted)."""
        part = slice(self.first[start], self.first[min(stop, len(self))])
        at = np.minimum(np.searchsorted(known, self.feature[part]), max(len(known) - 1, 0))
        out = np.zeros((min(stop, len(self)) - start, len(known)))
        if len(known):
            ok = known[at] == self.feature[part]
            out[self.unit[part][ok] - start, at[ok]] = self.weight[part][ok]
        return out

    def features(self, start: int, stop: int) -> np.ndarray:
        return np.unique(self.feature[self.first[start] : self.first[min(stop, len(self))]])


class TransportAligner:
    """Pairs of units of two documents that say the same in whole or in part.

    A unit's vector has its words weighted by rarity (the second language's through a lexicon), its numbers and the sounds of
    its words. The cost of a pair is 1 - cosine, beyond that of no match where both have numbers and none in common; pairs with a cosine below
    ``least`` carry no mass. Masses are lengths relative to the language's mean. Units are linked where at least ``share`` of the smaller one's mass
    goes from one to the other. The groups that links make are matches, merges, splits or both; a unit in no group is an
    omission. Order doesn't count. Vectors are compared in blocks, so memory grows with the likely pairs only.
    """

    def __init__(self, *, null: float = 0.62, epsilon: float = 0.04, rounds: int = 200, share: float = 0.25, least: float = 0.3, number_weight: float = 3.0, sound_weight: float = 1.5, clash: float = 1.0):
        self.null, self.epsilon, self.rounds, self.share, self.least = null, epsilon, rounds, share, least
        self.number_weight, self.sound_weight, self.clash = number_weight, sound_weight, clash

    def sides(self, rows: tuple[list[dict], list[dict]], vocabulary: Vocabulary | None) -> tuple[Side, Side]:
        """The units of both sides, with the features of their words if there is a vocabulary."""
        seen = [Counter(b for r in side for b in r["bones"]) for side in rows]
        names: dict[str, int] = {}
        out = []
        for which, side in enumerate(rows):
            unit, feature, weight = [], [], []
            own, count = [], np.zeros(len(side), np.int64)
            for i, r in enumerate(side):
                for x in set(r["numbers"]):
                    unit.append(i)
                    feature.append(names.setdefault("n" + x, len(names)))
                    weight.append(self.number_weight * (1.0 if len(x) > 1 else 0.5))
                for x in r["bones"]:
                    # A sound that only one side has says nothing, one that many units have says little.
                    if seen[1 - which][x]:
                        unit.append(i)
                        feature.append(names.setdefault("s" + x, len(names)))
                        weight.append(self.sound_weight / math.sqrt(max(seen[0][x], seen[1][x])))
                if vocabulary:
                    known = [x for x in map(vocabulary[which].number.get, set(r["words"])) if x is not None]
                    own += known
                    count[i] = len(known)
            u, f, w = np.array(unit, np.int64), -1 - np.array(feature, np.int64), np.array(weight, float)
            if own:
                # Several words may stand for one feature: their weights add up.
                wu, wf, ww = vocabulary[which].features(np.array(own), np.repeat(np.arange(len(side)), count))
                order = np.lexsort((wf, wu))
                wu, wf, ww = wu[order], wf[order], ww[order]
                starts = np.flatnonzero(np.r_[True, (wu[1:] != wu[:-1]) | (wf[1:] != wf[:-1])])
                u, f, w = np.concatenate([u, wu[starts]]), np.concatenate([f, wf[starts]]), np.concatenate([w, np.add.reduceat(ww, starts)])
            out.append(Side([(r["passage_id"], r["start_pos"]) for r in side], [len(r["words"]) + len(r["numbers"]) for r in side], u, f, w, [frozenset(r["numbers"]) for r in side]))
        return out[0], out[1]

    def likely(self, left: Side, right: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, cosine) of the pairs with a cosine of ``least`` at least and not only unlike numbers."""
        found = []
        for s in range(0, len(left), _ROWS):
            fs = left.features(s, s + _ROWS)
            for t in range(0, len(right), _ROWS):
                known = np.intersect1d(fs, right.features(t, t + _ROWS), assume_unique=True)
                cos = left.block(s, s + _ROWS, known) @ right.block(t, t + _ROWS, known).T
                i, j = np.nonzero(cos >= self.least)
                found.append((i + s, j + t, cos[i, j]))
        i, j, cos = (np.concatenate(x) for x in zip(*found))
        apart = np.fromiter((bool(left.numbers[x]) and bool(right.numbers[y]) and left.numbers[x].isdisjoint(right.numbers[y]) for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
        return i, j, cos - self.clash * apart

    def links(self, left: Side, right: Side) -> list[tuple[int, int, float]]:
        if not len(left) or not len(right):
            return []
        i, j, cos = self.likely(left, right)
        a, b = (np.maximum(0.3, x.sizes / max(1e-9, x.sizes.mean())) for x in (left, right))
        plan = sinkhorn(i, j, 1 - cos, a, b, self.null, self.epsilon, self.rounds)
        weight = plan / np.minimum(a[i], b[j])
        keep = weight >= self.share
        return list(zip(i[keep].tolist(), j[keep].tolist(), weight[keep].tolist()))

    def anchors(self, left: Side, right: Side) -> list[tuple[int, int]]:
        """Pairs that are each other's best by numbers and sounds alone."""
        if not len(left) or not len(right):
            return []
        i, j, cos = self.likely(left, right)
        order = np.lexsort((j, -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        best = np.full(len(left), -1)
        firsts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        best[i[firsts]] = j[firsts]
        order = np.lexsort((i, -cos, j))
        k, m = j[order], i[order]
        back = np.full(len(right), -1)
        firsts2 = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        back[k[firsts2]] = m[firsts2]
        return [(x, y) for x, y, c in zip(i[firsts].tolist(), j[firsts].tolist(), cos[firsts].tolist()) if back[y] == x and c > 0.35]


def groups(n: int, m: int, links: list[tuple[int, int, float]]) -> list[str]:
    """The kind of each link: match, split (one unit of the first side), merge (one of the second) or both."""
    parent = list(range(n + m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j, _ in links:
        parent[root(i)] = root(n + j)
    linked = {i for i, _, _ in links}, {n + j for _, j, _ in links}
    count = [Counter(root(x) for x in side) for side in linked]
    kinds = []
    for i, _, _ in links:
        a, b = count[0][root(i)], count[1][root(i)]
        kinds.append("match" if a == b == 1 else "split" if a == 1 else "merge" if b == 1 else "both")
    return kinds


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple[list[dict], list[dict]]]]:
    """(stem, units of both sides) of one document pair after the other, of rows sorted by ``stem``."""
    stem, own = None, ([], [])
    for b in batches:
        for r in b.to_pylist():
            if r["stem"] != stem:
                if own[0] or own[1]:
                    yield stem, own
                stem, own = r["stem"], ([], [])
            own[r["side"]].append(r)
    if own[0] or own[1]:
        yield stem, own


class Words:
    """What each word of a language stands for: its number n, and features and weights from first[n] on to first[n + 1]."""

    def __init__(self, listed: dict[str, list[tuple[int, float]]]):
        self.number = {w: n for n, w in enumerate(listed)}
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in listed.values()], dtype=np.int64)])
        self.feature = np.array([f for x in listed.values() for f, _ in x], np.int64)
        self.weight = np.array([w for x in listed.values() for _, w in x], float)

    def features(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, feature, weight) of all features of the words."""
        n = self.first[words + 1] - self.first[words]
        at = np.repeat(self.first[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(owner, n), self.feature[at], self.weight[at]


Vocabulary = tuple[Words, Words]


def tokenized(units: DataFrame) -> DataFrame:
    """``stem, side, passage_id, start_pos, words, numbers, bones`` of ``units`` (stem, side, passage_id, start_pos, unit); side 0 or 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [tokens(t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], *[pa.array([g[i] for g in got], pa.list_(pa.string())) for i in range(3)]], ["stem", "side", "passage_id", "start_pos", "words", "numbers", "bones"])

    return units.select("stem", "side", "passage_id", "start_pos", "unit").mapInArrow(run, "stem string, side int, passage_id string, start_pos int, words array<string>, numbers array<string>, bones array<string>")


def learn_lexicon(pairs: DataFrame, *, least: int = 2, dice: float = 0.08, width: int = 6) -> DataFrame:
    """``h, e, p``: for each word of the second language its ``width`` best partners by Dice's coefficient, from ``pairs`` (e, h, n) with single counts as (e, null, n), (null, h, n).

    p are the coefficients scaled to sum to 1.
    """
    sums = cut(pairs.groupBy("e", "h").agg(F.sum("n").alias("n")))
    both = sums.where(f"e is not null and h is not null and n >= {least}")
    ce, ch = sums.where("h is null").select("e", F.col("n").alias("ne")), sums.where("e is null").select("h", F.col("n").alias("nh"))
    scored = both.join(ce, "e").join(ch, "h").withColumn("d", 2 * F.col("n") / (F.col("ne") + F.col("nh"))).where(f"d >= {dice}")
    of_h = Window.partitionBy("h")
    top = scored.withColumn("r", F.row_number().over(of_h.orderBy(F.col("d").desc(), "e"))).where(f"r <= {width}")
    return top.select("h", "e", (F.col("d") / F.sum("d").over(of_h)).alias("p"))


def _cooccurrences(ordered: DataFrame, aligner: TransportAligner, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            e, h, n = [k[0] for k in counts], [k[1] for k in counts], list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(h, pa.string()), pa.array(n, pa.int64())], ["e", "h", "n"])

        for _, rows in _grouped(batches):
            sides = aligner.sides(rows, sent.value if sent else None)
            found = [(i, j) for i, j, w in aligner.links(*sides) if w > 0.5] if sent else aligner.anchors(*sides)
            for i, j in found:
                e, h = set(rows[0][i]["words"]), set(rows[1][j]["words"])
                counts.update((x, y) for x in e for y in h)
                counts.update((x, None) for x in e)
                counts.update((None, y) for y in h)
            if len(counts) > 200_000:
                yield out()
        yield out()

    return ordered.mapInArrow(run, "e string, h string, n long")


def align(units: DataFrame, aligner: TransportAligner | None = None, *, rate: float = 1e-6, omissions: bool = True) -> DataFrame:
    """``stem, passage_id, start_pos, other_passage_id, other_start_pos, share, kind`` of linked units of ``units`` (stem, side, passage_id, start_pos, unit).

    kind: match, split, merge or both, by the group of units the link is in; with ``omissions`` also omission, for a unit without link,
    whose columns of the other side are null. The lexicon is learned from all documents: first from pairs that agree by numbers
    and sounds, then from the links found with that lexicon. It holds the words that make up ``rate`` of their language's words at least, so
    it has at most 1 / rate words a language, whatever the data, and goes along with the tasks; rarer words tell by their sounds. A stem with units on one
    side only has omissions only, as have units without words and numbers. Repeated units link each. Stems are spread by
    hash; the units of one pair of documents are one task's, compared in blocks.
    """
    aligner = aligner or TransportAligner()
    spark = units.sparkSession
    tok = cut(tokenized(units).repartition("stem").sortWithinPartitions("stem", "side", "passage_id", "start_pos"))
    words = cut(tok.select("side", F.explode(F.array_distinct("words")).alias("w")).groupBy("side", "w").agg(F.count(F.lit(1)).alias("n")))
    totals = {r["side"]: r["n"] for r in words.groupBy("side").agg(F.sum("n").alias("n")).collect()}
    known = words.where(F.col("n") >= rate * F.when(F.col("side") == 0, totals.get(0, 0)).otherwise(totals.get(1, 0)))
    n = max(tok.where("side = 0").count(), 1)
    rarity = {w: (i, math.log((n + 1) / c)) for i, (w, c) in enumerate(known.where("side = 0").select("w", "n").orderBy("w").toArrow().to_pandas().itertuples(index=False))}
    second = known.where("side = 1").select(F.col("w").alias("h"))
    sent = None
    for _ in range(2):
        lexicon = learn_lexicon(_cooccurrences(tok, aligner, sent)).join(second, "h", "left_semi").toArrow().to_pandas()
        sent = spark.sparkContext.broadcast(_vocabulary(lexicon, rarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stem, rows in _grouped(batches):
            left, right = aligner.sides(rows, sent.value)
            found = aligner.links(left, right)
            got = [(stem, *left.keys[i], *right.keys[j], round(w, 6), k) for (i, j, w), k in zip(found, groups(len(left), len(right), found))]
            if omissions:
                linked = {i for i, _, _ in found}, {j for _, j, _ in found}
                got += [(stem, *key, None, None, None, "omission") for i, key in enumerate(left.keys) if i not in linked[0]]
                got += [(stem, None, None, *key, None, "omission") for j, key in enumerate(right.keys) if j not in linked[1]]
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], ["stem", "passage_id", "start_pos", "other_passage_id", "other_start_pos", "share", "kind"])

    return tok.mapInArrow(run, "stem string, passage_id string, start_pos int, other_passage_id string, other_start_pos int, share double, kind string")


def _vocabulary(lexicon, rarity: dict[str, tuple[int, float]]) -> Vocabulary:
    """A word of the first language stands for itself, one of the second for its partners, by rarity."""
    listed: dict[str, list[tuple[int, float]]] = {}
    for h, e, p in lexicon[["h", "e", "p"]].itertuples(index=False):
        if e in rarity:
            listed.setdefault(h, []).append((rarity[e][0], p * rarity[e][1]))
    return Words({w: [x] for w, x in rarity.items()}), Words(listed)
