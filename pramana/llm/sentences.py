"""Sentence units of texts in any script, by a hidden-event language model."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pramana.llm.overlap import fold, remembered
from pramana.session import cut

BULLET = regex.compile(r"[ \t ]*[-*•–—▪◦‣·●○■□]+[ \t ]+")
_ENDS = ".?!।॥|。！？｡…؟۔"
_CLOSE = "\"'”’)]}»」』】）"
_OPEN = "\"'“‘([{«「『【（"
_PAIRS = {"“": "”", "‘": "’", "(": ")", "[": "]", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", '"': '"'}
_OPENING = regex.compile("[" + regex.escape("".join(_PAIRS)) + "]")
#: A unit is a run without white space; it ends after closing marks too where a letter, a digit or an opening mark follows at once.
_UNIT = regex.compile(rf"[{regex.escape('.?!।॥|…؟۔')}。！？｡]+[{regex.escape(_CLOSE)}]*|(?:(?![.?!।॥|…؟۔。！？｡\s])\X)+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.,:/'’-][\p{L}\p{M}\p{N}]+)*")
_FINAL = regex.compile(rf"([{regex.escape(_ENDS)}]+)[{regex.escape(_CLOSE)}]*$")
_MARKED = regex.compile(rf"[{regex.escape(_ENDS)}]")
_RUN = regex.compile(r"\S+")
_NO_END, _NO_START = ",;:-–—/", _CLOSE + ",;:-–—/&+"
_SAYS = regex.compile(r"[\p{L}\p{N}]")
#: Finds the last word before a place.
_BACK = regex.compile(_WORD.pattern, regex.REVERSE)
_SOLID = regex.compile(r"\S")
_TAIL = regex.compile(r"\S", regex.REVERSE)
#: A single letter of a script with case; elsewhere single letters are words too.
_INITIAL = regex.compile(r"[\p{Lu}\p{Ll}]\p{M}*")
_HAN = regex.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Thai}|\p{Lao}|\p{Khmer}|\p{Myanmar}")
#: What stands between two places where a sentence may end without a mark: a word, or one character of a script without spaces.
_STEP = regex.compile(rf"(?:{_HAN.pattern})\p{{M}}*|(?:(?!{_HAN.pattern})\S)+")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is it a bullet line) of the stretches that a blank line or a bullet line ends; without bullet marks and outer white space."""
    start, end, at = -1, -1, 0
    for line in text.splitlines(keepends=True):
        stripped = line.strip()
        bullet = BULLET.match(line)
        if (not stripped or bullet) and start >= 0:
            yield start, end, False
            start = -1
        if bullet and line[bullet.end() :].strip():
            first = at + bullet.end() + len(line[bullet.end() :]) - len(line[bullet.end() :].lstrip())
            yield first, at + len(line.rstrip()), True
        elif stripped and not (bullet and not line[bullet.end() :].strip()):
            if start < 0:
                start = at + len(line) - len(line.lstrip())
            end = at + len(line.rstrip())
        at += len(line)
    if start >= 0:
        yield start, end, False


class Gap:
    """A place where a sentence may end: ``at`` is the start of what follows; left and right are what the model sees."""

    __slots__ = ("at", "left", "mark", "right", "shape", "units")

    def __init__(self, at: int, left: str, mark: str, right: str, shape: str, units: int):
        self.at, self.left, self.mark, self.right, self.shape, self.units = at, left, mark, right, shape, units


@remembered
def _left_word(w: str) -> str:
    if not w[-1].isdigit():  # a missing space joins sentences
        w = w.rpartition(".")[2] or w
    if w[-1].isdigit():
        return "<num>"
    if _HAN.match(w[-1]):  # two characters where there are two
        return w[-2:] if len(w) > 1 and _HAN.match(w[-2]) else w[-1]
    return "<ini>" if _INITIAL.fullmatch(w) else fold(w)


def _left(block: str, end: int) -> str:
    """The last word of ``block`` before ``end``."""
    m = _BACK.search(block, 0, end)
    return _left_word(m[0]) if m else "<none>"


@remembered
def _right_word(w: str, quoted: bool, stop: bool) -> tuple[str, str]:
    if w[0].isdigit():
        return "<num>", "num"
    if _HAN.match(w):
        return w[:2] if len(w) > 1 and _HAN.match(w[1]) else w[0], "quote" if quoted else "caseless"
    shape = "quote" if quoted else "upper" if w[0].isupper() else "lower" if w[0].islower() else "caseless"
    return ("<ini>" if stop and _INITIAL.fullmatch(w) else fold(w)), shape


def _right(block: str, at: int) -> tuple[str, str]:
    """(word, shape) of what stands at ``at``."""
    first = at
    while at < len(block) and block[at] in _OPEN:
        at += 1
    if _HAN.match(block, at):  # of a run without spaces two characters tell
        return _right_word(block[at : at + 2], at > first, False)
    m = _WORD.match(block, at)
    return _right_word(m[0], at > first, block[m.end() : m.end() + 1] == ".") if m else ("<other>", "other")


def _closed(block: str) -> list[tuple[int, int]]:
    """(start, end) of quotations and brackets that are closed again in the block, the outermost ones."""
    spans: list[tuple[int, int]] = []
    never: set[str] = set()
    at = 0
    for m in _OPENING.finditer(block):
        c = m[0]
        # An apostrophe-like mark inside a word opens nothing.
        if m.start() < at or _PAIRS[c] in never or (c == '"' and m.start() and block[m.start() - 1].isalnum()):
            continue
        close = block.find(_PAIRS[c], m.end())
        if close < 0:
            never.add(_PAIRS[c])
        else:
            spans.append((m.start(), close))
            at = close + 1
    return spans


def gaps(text: str, start: int, end: int, unmarked: bool = False) -> list[Gap]:
    """The places in a block where a sentence may end: after a closing mark, outside quotation marks and brackets that are closed again in the block.

    With ``unmarked`` also those between any two words, or characters of a script without spaces, without a mark: there ``mark`` is empty.
    """
    block = text[start:end]
    spans = _closed(block)
    out: list[Gap] = []
    units, k, stretch = 0, 0, 0
    for m in _UNIT.finditer(block):
        if m[0][0] not in _ENDS:
            units += max(1, len(_HAN.findall(m[0])))
            continue
        e = m.end()
        while k < len(spans) and spans[k][1] < m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.start() and m.end() - 1 < spans[k][1]:
            continue
        follows = _SOLID.search(block, e)
        if not follows:
            break
        at = follows.start()
        nxt = block[at]
        if nxt in _ENDS or nxt in ",;:)]}" or nxt in "”’」』）】":
            continue
        mark = m[0].rstrip(_CLOSE)[-1:] or "."
        if at == e and mark in ".|…" and (nxt.isdigit() and block[m.start() - 1 : m.start()].isdigit() or not (nxt.isalpha() or nxt in _OPEN)):
            continue
        if mark == "|":
            before = _TAIL.search(block, 0, m.start())
            if not before or not regex.match(r"[\p{Devanagari}\p{Bengali}\p{N})\"”]", before[0]):
                continue
        right, shape = _right(block, at)
        kind = {"|": "।", "॥": "।", "．": ".", "｡": "。"}.get(mark, mark) + ("q" if m[0][-1] in _CLOSE else "") + ("_" if at == e else "")
        if unmarked:
            out += _between(block, start, stretch, m.start(), spans)
        out.append(Gap(start + at, _left(block, m.start()), kind, right, shape, units))
        units, stretch = 0, at
    if unmarked:
        out += _between(block, start, stretch, len(block), spans)
    return out


@remembered
def _token(t: str) -> tuple[bool, bool, str, str, str] | None:
    """Of a run of characters without white space: (may a sentence begin with it, and one end with it, its left side, right side and shape); None without letters and digits."""
    if not _SAYS.search(t):
        return None
    last = _BACK.search(t)
    return t[0] not in _NO_START, t[-1] not in _NO_END, _left_word(last[0]) if last else "<none>", *_right(t, 0)


def _between(block: str, start: int, first: int, last: int, spans: list[tuple[int, int]]) -> list[Gap]:
    """The gaps between the words from ``first`` to ``last``, none of which ends with a mark."""
    out: list[Gap] = []
    k = end = 0
    before = None
    han = _HAN.search(block, first, last) is not None
    for m in (_STEP if han else _RUN).finditer(block, first, last):
        info = _token(m[0])
        if info is None:
            continue
        at = m.start()
        while k < len(spans) and spans[k][1] < at:
            k += 1
        inside = k < len(spans) and spans[k][0] < at
        if before is not None and not inside and before[1] and info[0]:
            right, shape = _right(block, at) if han else info[3:]
            out.append(Gap(start + at, _left_step(block, step, end) if han else before[2], "", right, shape, 1))
        before, end, step = info, m.end(), m[0]
    return out


def _left_step(block: str, step: str, end: int) -> str:
    """What a step that ends at ``end`` is as a left side."""
    if _HAN.match(step):
        return _left_word(block[max(0, end - 2) : end])
    return _left_word(w[0]) if (w := _BACK.search(step)) else "<none>"


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


class HiddenEventModel:
    """P(event | left word and mark), and how much likelier the right word is after an event than inside a sentence.

    event: by (left, mark), by_mark for unseen left words; right: log ratios by (word, shape), shapes for unseen words; ends:
    the share of a word's occurrences that end a sentence, for gaps without marks; short: weight of a sentence of one unit;
    bare: the prior that a stretch between marks is written without marks, in a block without any mark and in one with marks.
    """

    def __init__(self, event: dict[tuple[str, str], float], by_mark: dict[str, float], right: dict[tuple[str, str], float], shapes: dict[str, float], ends: dict[str, float], short: float, bare: tuple[float, float] = (0.05, 0.00002)):
        self.event, self.by_mark, self.right, self.shapes, self.ends, self.short, self.bare = event, by_mark, right, shapes, ends, short, bare
        self._known: dict[tuple[str, str, str, str], float] = {}

    def odds(self, g: Gap) -> float:
        """Odds of an event at the gap; each pair of sides is looked up once."""
        key = (g.left, g.mark, g.right, g.shape)
        known = self._known.get(key)
        if known is None:
            if len(self._known) > 500_000:
                self._known.clear()
            known = self._known[key] = math.exp(max(-30.0, min(30.0, self.log_odds(g))))
        return known

    def log_odds(self, g: Gap) -> float:
        """Log odds of an event at the gap for what stands on both sides of it."""
        if g.mark:
            p = self.event.get((g.left, g.mark))
            if p is None:
                p = self.by_mark.get(g.mark, 0.3 if "q" in g.mark else self.by_mark.get(g.mark[:1], 0.5 if g.mark[0] == "." else 0.95))
        else:
            p = self.ends.get(g.left, self.ends.get("", 1e-3))
        right = self.right.get((g.right, g.shape))
        if right is None:
            right = self.shapes.get(g.shape, 0.0)
        # A strong mark tells more than the word after it: words must not outvote it.
        bound = 3.0 if "q" in g.mark else 6.0 if g.mark[:1] in (".", "") else 2.0
        return _logit(p) + max(-bound, min(bound, right))

    def _chain(self, found: list[Gap]) -> tuple[list[float], float]:
        """(posterior of an event at each gap, log of the sum over all ways to place events, of weight 0 for none), by forward-backward over
        the chain in which events after a single unit are rare."""
        n = len(found)
        odds = [self.odds(g) for g in found]
        stay = [self.short if g.units <= 1 else 1.0 for g in found]
        # state: was there an event at the gap before? a: forward sums for (none, event), scaled.
        forward: list[tuple[float, float]] = []
        a0, a1, total = 0.0, 1.0, 0.0
        for o, s in zip(odds, stay):
            b0 = a0 + a1
            b1 = a0 * o + a1 * o * s
            z = b0 + b1
            a0, a1 = b0 / z, b1 / z
            total += math.log(z)
            forward.append((a0, a1))
        c0 = c1 = 1.0
        post = [0.0] * n
        for i in range(n - 1, -1, -1):
            f0, f1 = forward[i]
            post[i] = f1 * c1 / (f0 * c0 + f1 * c1)
            o, s = odds[i], stay[i]
            d0, d1 = c0 + o * c1, c0 + o * s * c1
            z = d0 + d1
            c0, c1 = d0 / z, d1 / z
        return post, total

    def boundaries(self, found: list[Gap], closed: bool = False) -> list[tuple[Gap, float]]:
        """Each gap's posterior of an event. closed: the block ends with a mark.

        Gaps at marks are one chain. The gaps of a stretch between marks are another, whose posterior is that of the stretch being written
        without marks at all times that of an event if it is: the more the words look like several sentences, the surer is the former.
        """
        marked = [g for g in found if g.mark]
        out = list(zip(marked, self._chain(marked)[0])) if marked else []
        prior = self.bare[closed or bool(marked)]
        stretch: list[Gap] = []
        for g in [*found, None]:
            if g is not None and not g.mark:
                stretch.append(g)
            elif stretch:
                post, total = self._chain(stretch)
                # The odds that marks are left out: of the prior and of all ways to place events against none.
                x = _logit(prior) + total
                bare = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
                out += [(b, p * bare) for b, p in zip(stretch, post)]
                stretch = []
        return sorted(out, key=lambda v: v[0].at)

    def starts(self, text: str | None) -> list[int]:
        """Where the units of the text start, in code points."""
        out: list[int] = []
        for start, end, bullet in blocks(text or ""):
            # Marks alone are no unit.
            if not _SAYS.search(text, start, end):
                continue
            out.append(start)
            if not bullet:
                out += [g.at for g, p in self.boundaries(gaps(text, start, end, unmarked=True), _FINAL.search(text, start, end) is not None) if p > 0.5]
        return out

    def split(self, text: str | None) -> list[tuple[int, str]]:
        """(start, unit) of each unit, outer white space off."""
        at = self.starts(text)
        if not at:
            return []
        stops = {s: e for s, e, _ in blocks(text)}
        ends = sorted(stops.values())
        out = []
        for i, s in enumerate(at):
            stop = next(e for e in ends if e > s)
            if i + 1 < len(at):
                stop = min(stop, at[i + 1])
            out.append((s, text[s:stop].rstrip()))
        return out


def train(texts: DataFrame, *, text_col: str = "text", rounds: int = 6, rate: float = 1e-6) -> HiddenEventModel:
    """The model of all unlabelled texts; fold repeated rows before, as each counts.

    Ends and starts of blocks are sure events and words inside a run without a closing mark are sure non-events; the gaps after
    a mark between are hidden and counted by expectation maximization. A left side first has an event as often as block ends
    show it to end a sentence, so abbreviations start out with none. Counting is one pass with partial sums. Words below ``rate`` of
    a kind of counts are counted together as rare ones, so that the driver and the model have at most 1 / rate rows of each kind, whatever the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counts() -> pa.RecordBatch:
            keys = list(zip(*seen)) or [()] * 5
            return pa.RecordBatch.from_arrays([*[pa.array(k, pa.string()) for k in keys], pa.array(seen.values(), pa.int64())], ["kind", "a", "b", "c", "d", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for start, end, bullet in blocks(t):
                    block = t[start:end]
                    seen[("start", *_right(block, 0), "", "")] += 1
                    m = _FINAL.search(block)
                    last = _left(block, m.start() if m else len(block))
                    if m:
                        seen["end", last, {"|": "।", "॥": "।"}.get(m[1][-1], m[1][-1]) + ("q" if block[-1] in _CLOSE else ""), "", ""] += 1
                    seen["stop", last, "", "", ""] += 1
                    if not bullet:
                        seen.update(("gap", g.left, g.mark, g.right, g.shape) for g in gaps(t, start, end))
                    before = None
                    if _HAN.search(block):
                        for w in _STEP.finditer(block):
                            if before is not None and not _MARKED.search(block, before.start(), w.end()):
                                seen[("inside", *_right(block, w.start()), "", "")] += 1
                                seen["word", _left_step(block, before[0], before.end()), "", "", ""] += 1
                            before = w
                        continue
                    for w in _WORD.finditer(block):
                        if before is not None and not _MARKED.search(block, before.end(), w.start()):
                            quoted = w.start() > 0 and block[w.start() - 1] in _OPEN
                            seen[("inside", *_right_word(w[0], quoted, block[w.end() : w.end() + 1] == "."), "", "")] += 1
                            seen["word", _left_word(before[0]), "", "", ""] += 1
                        before = w
                if len(seen) > 200_000:  # a task's memory doesn't grow with its texts
                    yield counts()
                    seen.clear()
        if seen:
            yield counts()

    keys = ["kind", "a", "b", "c", "d"]
    real = texts.where(F.col(text_col).isNotNull() & (F.trim(text_col) != "")).select(F.col(text_col).alias("t"))
    sums = cut(real.mapInArrow(run, "kind string, a string, b string, c string, d string, n long").groupBy(*keys).agg(F.sum("n").alias("n")))
    least = {r["kind"]: r["n"] * rate for r in sums.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    rare = F.lit(False)
    for kind, bound in least.items():
        rare |= (F.col("kind") == kind) & (F.col("n") < bound)
    named = [F.when(rare, "<rare>").otherwise(F.col("a")).alias("a"), "b", F.when(rare & (F.col("kind") == "gap"), "<rare>").otherwise(F.col("c")).alias("c"), "d"]
    counted = sums.select("kind", *named, "n").groupBy(*keys).agg(F.sum("n").alias("n")).toArrow()
    start: dict[tuple[str, str], float] = {}
    inside: dict[tuple[str, str], float] = {}
    end: dict[tuple[str, str], float] = {}
    stop: dict[str, float] = {}
    word: dict[str, float] = {}
    hidden: list[tuple[str, str, str, str, int]] = []
    for r in (r for b in counted.to_batches(max_chunksize=10_000) for r in b.to_pylist()):
        if r["kind"] == "start":
            start[r["a"], r["b"]] = r["n"]
        elif r["kind"] == "inside":
            inside[r["a"], r["b"]] = r["n"]
        elif r["kind"] == "end":
            end[r["a"], r["b"]] = r["n"]
        elif r["kind"] == "stop":
            stop[r["a"]] = r["n"]
        elif r["kind"] == "word":
            word[r["a"]] = r["n"]
        else:
            hidden.append((r["a"], r["b"], r["c"], r["d"], r["n"]))
    # In one order, so that sums don't depend on partitions.
    return _maximize(start, inside, end, stop, word, sorted(hidden), rounds)


def _maximize(start, inside, end, stop, word, hidden, rounds: int) -> HiddenEventModel:
    left: dict[tuple[str, str], float] = {}
    for a, mark, _, _, n in hidden:
        left[a, mark] = left.get((a, mark), 0) + n
    ends, total = sum(end.values()), sum(left.values())
    rate = max(ends / max(ends + 0.7 * total, 1), 0.02)  # of all events, the share that ends a block
    closing: dict[str, float] = {}
    for (a, _), v in end.items():
        closing[a] = closing.get(a, 0) + v
    event: dict[tuple[str, str], float] = {}
    for (a, mark), n in left.items():
        weak = mark[0] == "." or "q" in mark
        base = (0.3 if "q" in mark else 0.9 if closing.get(a) else 0.6) if weak else 0.97
        want = min(end.get((a, mark.rstrip("_")), 0) * (1 / rate - 1), n)
        event[a, mark] = (want + base) / (n + 1) if weak else max((want + base) / (n + 1), base)
    prior = dict(event)
    right: dict[tuple[str, str], float] = {}
    shapes: dict[str, float] = {}
    by_mark: dict[str, float] = {}
    post: dict[int, float] = {}
    for _ in range(rounds):
        begins = {k: float(v) for k, v in start.items()}
        goes = {k: float(v) for k, v in inside.items()}
        for i, (a, mark, word_right, shape, n) in enumerate(hidden):
            p, key = post.get(i, event[a, mark]), (word_right, shape)
            begins[key] = begins.get(key, 0) + p * n
            goes[key] = goes.get(key, 0) + (1 - p) * n
        by_shape: dict[str, list[float]] = {}
        for counts, j in ((begins, 0), (goes, 1)):
            for (_, s), v in counts.items():
                by_shape.setdefault(s, [0.0, 0.0])[j] += v
        nb, ng = sum(v[0] for v in by_shape.values()), sum(v[1] for v in by_shape.values())
        share = (nb + 0.5) / (nb + ng + 1)
        of_shape = {s: (v[0] + 5 * share) / (v[0] + v[1] + 5) for s, v in by_shape.items()}
        shapes = {s: _logit(v) - _logit(share) for s, v in of_shape.items()}
        # A rare word counts as its shape does.
        right = {k: _logit((begins.get(k, 0) + 5 * of_shape[k[1]]) / (begins.get(k, 0) + goes.get(k, 0) + 5)) - _logit(share) for k in begins.keys() | goes.keys()}
        model = HiddenEventModel(event, by_mark, right, shapes, {}, 0.05)
        sums: dict[tuple[str, str], float] = {}
        marks: dict[str, list[float]] = {}
        for i, (a, mark, word_right, shape, n) in enumerate(hidden):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.log_odds(Gap(0, a, mark, word_right, shape, 2))))))
            post[i] = p
            sums[a, mark] = sums.get((a, mark), 0) + p * n
            m = marks.setdefault(mark, [0.0, 0.0])
            m[0] += p * n
            m[1] += n
        # What often stands before a mark and never ends a block is an abbreviation, or a quotation within a sentence.
        event = {k: prior[k] if left[k] >= 20 and not closing.get(k[0]) and (k[1][0] == "." or "q" in k[1]) else (sums[k] + 4 * (1 + left[k]) * prior[k]) / (left[k] + 4 * (1 + left[k])) for k in left}
        by_mark = {m: v[0] / v[1] for m, v in marks.items()}
    # Of all occurrences of a word, the share that ends a sentence; of a rare word as of all words together.
    final, times = dict(stop), {w: n + word.get(w, 0) for w, n in stop.items()} | {w: n for w, n in word.items() if w not in stop}
    for (a, mark), v in sums.items() if hidden and rounds else ():
        final[a] = final.get(a, 0) + v
        times[a] = times.get(a, 0) + left[a, mark]
    base = (sum(final.values()) + 0.01) / (sum(times.values()) + 1)
    finals = {w: (final.get(w, 0) + 2 * base) / (n + 2) for w, n in times.items()} | {"": base}
    return HiddenEventModel(event, by_mark, right, shapes, finals, 0.05)


def sentence_units(df: DataFrame, model: HiddenEventModel, *, id_col: str = "passage_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id_col, start_pos`` (and ``unit``) of each sentence unit; texts that are null, blank or without letters and digits have none."""
    kind = dict(df.dtypes)[id_col]
    parts = {k: v for k, v in model.__dict__.items() if k[0] != "_"}
    sent = df.sparkSession.sparkContext.broadcast(parts)  # as many rows as train() bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = HiddenEventModel(**sent.value)
        for b in batches:
            at, starts, units = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if with_text:
                    for s, u in m.split(t):
                        at.append(i)
                        starts.append(s)
                        units.append(u)
                else:
                    got = m.starts(t)
                    at += [i] * len(got)
                    starts += got
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(units, pa.string())] if with_text else []), [id_col, "start_pos", "unit"][: 2 + with_text])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start_pos int" + ", unit string" * with_text)
