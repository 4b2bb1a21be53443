"""Same or near-same records across splits, by hashes of canonical records."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.session import cut, frequent, lookup

SMALL_WORDS = frozenset(
    """a an the of in on at to for by with from and or as is are was were be been am do does did has have had all each that this these those it its his her their there any
    में के की का को से ने पर है हैं हो था थे थी तक ही भी तो और या एक यह वह इस उस इन उन कि जो सभी सब
    mein me main ke ki ka ko se ne par pe hai hain ho tha thi the tak hi bhi toh to aur ya ek yeh ye woh wo is us jo sabhi sab
    च्या चा ची चे ला ना ते तो ती आणि व आहे
    এর ও এই সেই এবং কি""".split()
)
COURTESY = frozenset(
    """please plz pls kindly clarify tell me us sir madam thanks thank you hello hi dear bhai bhaiya i we want wish would like know could let ask q qn ques question sawal prashn
    mujhe hame humein janna jaanna chahta chahti chahte hoon hun hu ji मुझे हमें जानना चाहता चाहती चाहते हूं भाई भैया पूछना नमस्कार
    kripya kripaya bataiye batayen bataye bataen batao zara कृपया बताएं बताएँ बताइए बताइये बताओ ज़रा जी महोदय प्रश्न सवाल धन्यवाद नमस्ते कृपा
    अनुग्रह करून सांगा অনুগ্রহ বলুন প্রশ্ন""".split()
)
CURRENCY = frozenset("rs re inr rupee rupees rupaye rupay rupaya rupaiya rupye रु रू रुपये रुपए रुपया रूपये रूपए टाका রুপি টাকা".split())
SCALES = {"lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "लाख": 10**5, "লাখ": 10**5, "crore": 10**7, "crores": 10**7, "करोड": 10**7, "কোটি": 10**7, "thousand": 1000, "hazar": 1000, "hazaar": 1000, "हजार": 1000, "হাজার": 1000}

_NUMBERING = regex.compile(r"^\W*(?:(?:q|que|ques|question|no|sr|प्रश्न|सवाल)\W*)?[(\[]?(?:\d{1,3}|[ivx]{1,4}|\p{L}\p{M}?)\s*[.):\]]\s*(?=\D)")
_TOKEN = regex.compile(r"\d+(?:[,٬']\d+)*(?:\.\d+)?|[\p{L}\p{M}]+")
_DROP = regex.compile(r"[\p{Cf}̀-़়ͯ]")


_OTHER_DIGIT = regex.compile(r"(?![0-9])\p{Nd}")


def remembered(f):
    """``f`` of a word, remembered for 200,000 words; long ones are not kept, so that memory has a bound."""
    known = lru_cache(maxsize=200_000)(f)

    @wraps(f)
    def of(word: str, *more):
        return known(word, *more) if len(word) <= 64 else f(word, *more)

    return of


def fold(text: str) -> str:
    """Case, compatibility forms, accents, nuktas, zero-width characters and the script of digits folded away."""
    if text.isascii():
        return text.lower()
    t = _DROP.sub("", unicodedata.normalize("NFKD", text).casefold()).replace("ँ", "ं")
    return _OTHER_DIGIT.sub(lambda m: str(unicodedata.digit(m[0])), t)


def _folded(words: frozenset[str]) -> frozenset[str]:
    return frozenset(map(fold, words))


_SMALL, _COURTESY, _CURRENCY, _SCALES = _folded(SMALL_WORDS), _folded(COURTESY), _folded(CURRENCY), {fold(k): v for k, v in SCALES.items()}


def canonical_tokens(text: str | None) -> list[str]:
    """The words and numbers of a text in one form, small words still in: currency marks, courtesy and numbering go, amounts become plain numbers."""
    t = _NUMBERING.sub("", fold(text or ""))
    out: list[str] = []
    for w in _TOKEN.findall(t):
        if w[0].isdigit():
            whole, _, part = w.replace(",", "").replace("'", "").partition(".")
            out.append(whole.lstrip("0") + (f".{part.rstrip('0')}" if part.strip("0") else "") or "0")
        elif w in _SCALES and out and out[-1][0].isdigit():
            out[-1] = f"{float(out[-1]) * _SCALES[w]:.0f}"
        elif w not in _CURRENCY and w not in _COURTESY:
            out.append(w)
    return out


def strict_key(tokens: list[str]) -> str:
    """Hash of the words and numbers in their order, small words included."""
    return hashlib.md5(" ".join(tokens).encode()).hexdigest()


def kept_tokens(tokens: list[str]) -> list[str]:
    """The words without small words; where only small words are left they count."""
    return [w for w in tokens if w not in _SMALL] or tokens


def bag_key(words: list[str]) -> int:
    """A number for a bag of words. It finds candidates only: what it joins is compared afterwards."""
    return int.from_bytes(hashlib.md5(" ".join(sorted(words)).encode()).digest()[:8], "big", signed=True)


def one_slip(a: str, b: str) -> bool:
    """Do the words differ by one inserted, left-out, other or swapped neighbouring character?"""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


#: Small words that tell the part a word plays: those before it, and those after it.
_BEFORE = frozenset("of in on at to for by with from".split())
_AFTER = _folded(frozenset("में के की का को से ने पर तक mein me main ke ki ka ko se ne par pe tak च्या चा ची चे ला ना এর".split()))


def _marked(tokens: list[str]) -> list[tuple[str, str]]:
    """The words without small words, each with the small words beside it that tell its part."""
    out = []
    for i, w in enumerate(tokens):
        if w in _SMALL:
            continue
        before = tokens[i - 1] if i and tokens[i - 1] in _BEFORE else ""
        after = tokens[i + 1] if i + 1 < len(tokens) and tokens[i + 1] in _AFTER else ""
        out.append((w, before + "|" + after))
    return out


def same_clauses(a: list[str], b: list[str]) -> bool:
    """Have two records of the same words their clauses in another order at most, or do words change their parts?

    The second record is cut into the longest runs of words that stand in the first one too. Two runs may change places unless they are
    single words without a mark of their part. Of more runs all but two must have a mark: a preposition before or a
    postposition after them. Of the words' marks two at most may differ, and not be exchanged: "from A to B" is not "from B to A"; with
    "does A pay B" three runs without marks change places.
    """
    x, y = _marked(a), _marked(b)
    p, q = [w for w, _ in x], [w for w, _ in y]
    if p == q:
        return True
    if len(p) != len(q):
        return False
    gone, come = Counter(x) - Counter(y), Counter(y) - Counter(x)
    if sum(gone.values()) > 2 or sum(gone.values()) == 2 and Counter(m for _, m in gone) == Counter(m for _, m in come):
        return False
    while p and p[0] == q[0]:
        del p[0], q[0], x[0]
    while p and p[-1] == q[-1]:
        del p[-1], q[-1], x[-1]
    free, runs, at = set(range(len(p))), [], 0
    while at < len(q):
        best, first = 0, -1
        for i in free:
            n = 0
            while at + n < len(q) and i + n in free and p[i + n] == q[at + n]:
                n += 1
            if n > best or n == best and n and i < first:
                best, first = n, i
        if not best:
            return False
        free -= set(range(first, first + best))
        runs.append((first, best))
        at += best
    bare = [n for i, n in runs if x[i][1].startswith("|") and x[i + n - 1][1].endswith("|")]
    return len(bare) <= 2 and (len(runs) > 2 or len(p) > 2 or not bare)


def split_name(split: Column) -> Column:
    """train, dev or test however it is written, else null."""
    s = F.lower(F.trim(F.regexp_replace(split, r"[\s_\-]+", " ")))
    return F.when(s.isin("train", "training", "trn"), "train").when(s.isin("dev", "val", "valid", "validation", "development"), "dev").when(s.isin("test", "tst", "testing"), "test")


class SplitOverlap:
    """Training and evaluation records that are the same but for their form.

    A record's words and plain numbers, without currency marks, courtesy and numbering, in their order are its variant: its
    hash joins records that are the *same*. *Near* are different variants with the same words but for small words, the order
    of clauses (``same_clauses``) and slips: two words are slips of one another if they differ by one slip and one of them
    is so much rarer that ``ratio`` times its count is at most the other's plus one, whatever the size of the corpus. Numbers are
    never slips, nor are words of fewer than ``min_length`` letters.

    Words are compared with all words by their one-character deletions. Candidates have a hash in common: of the bag of words in which
    each slip is replaced by its most frequent right word, or of that bag with one word, in each place in turn, as it stands or replaced by
    another of its right words. So any number of words may have slips whose likeliest correction is right, and one any slip. All
    further work is on variants: copies count once, and are written out as pairs of records at the very end, hot variants in ``salts`` parts. The
    orders in which the same words stand are few.
    """

    def __init__(self, *, ratio: float = 4.0, min_length: int = 3, salts: int = 64):
        self.ratio, self.min_length, self.salts = ratio, min_length, salts

    def members(self, records: DataFrame) -> DataFrame:
        """``id, split, source, v, tokens`` of ``records`` (id, text, split, source): v is the variant. Null and wordless texts have none."""
        kinds = dict(records.dtypes)

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [canonical_tokens(t) for t in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array([strict_key(t) if t else None for t in got], pa.string()), pa.array(got, pa.list_(pa.string()))], ["id", "split", "source", "v", "tokens"])

        rows = records.where("id is not null").select("id", split_name(F.col("split")).alias("split"), "source", "text")
        return rows.mapInArrow(tokens, f"id {kinds['id']}, split string, source {kinds['source']}, v string, tokens array<string>").where("v is not null")

    def vocabulary(self, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(slips, words): ``w, rights``, the words that w may be a slip of, the most frequent first, and ``w, n`` of all words long enough."""
        words = variants.select(F.explode(F.array_distinct("tokens")).alias("w")).where((F.length("w") >= self.min_length) & ~F.col("w").rlike(r"^\d")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        words = cut(words)
        less = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, F.length("w"))))
        near = words.select("w", "n", F.explode(F.array_distinct(F.concat(F.array("w"), less))).alias("d"))
        both = near.join(near.select(F.col("w").alias("v"), F.col("n").alias("m"), "d"), "d").where((F.col("m") > F.col("n")) & (F.col("m") + 1 >= self.ratio * F.col("n"))).select("w", "v", "m").distinct()

        def slips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([one_slip(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

        pairs = both.mapInArrow(slips, "w string, v string, m long")
        listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("o"), "v"))), lambda x: x["v"])
        return pairs.groupBy("w").agg(listed.alias("rights")), words

    def links(self, variants: DataFrame) -> DataFrame:
        """``train_v, eval_v`` of different near variants of ``variants`` (v, tokens, in_train, in_eval)."""
        slips, words = self.vocabulary(variants)
        total = variants.count()
        single = variants.select("v", F.explode(F.array_distinct("tokens")).alias("w"))
        # A word that a thousandth of all records have is hot; there are at most 1000 times the words of a record.
        hit = lookup(single, cut(slips), "w", words.where(F.col("n") * 1000 > total).select("w"))
        hit = hit.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("w", "rights"))).alias("slips"))
        known = cut(variants.join(hit, "v", "left"))

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                for v, tokens, slipped in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    of = dict(slipped or ())
                    mended = [of[w][0] if w in of else w for w in tokens]
                    rows.append((v, bag_key(kept_tokens(mended)), None, None))
                    for i, w in enumerate(tokens):
                        for r in (w, *of[w][1:]) if w in of else ():
                            rows.append((v, bag_key(kept_tokens([*mended[:i], r, *mended[i + 1 :]])), w, r))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["v", "key", "w", "r"])

        keyed = cut(known.select("v", "tokens", "slips").mapInArrow(keys, "v string, key long, w string, r string").join(variants.select("v", "in_train", "in_eval"), "v"))
        train = keyed.where("in_train").select("key", F.col("v").alias("train_v"), F.col("w").alias("tw"), F.col("r").alias("tr"))
        rest = keyed.where("in_eval").select("key", F.col("v").alias("eval_v"), F.col("w").alias("ew"), F.col("r").alias("er"))
        both = train.join(rest, "key").where("train_v <> eval_v").select("train_v", "eval_v", "tw", "tr", "ew", "er").distinct()
        side = known.select("v", "tokens", "slips")
        a, b = (side.select(F.col("v").alias(f"{x}_v"), F.col("tokens").alias(f"{x}_tokens"), F.col("slips").alias(f"{x}_slips")) for x in ("train", "eval"))

        def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for r in batch.to_pylist():
                    seen = []
                    for x, w, to in (("train", r["tw"], r["tr"]), ("eval", r["ew"], r["er"])):
                        of = dict(r[f"{x}_slips"] or ())
                        seen.append([to if t == w else of[t][0] if t in of else t for t in r[f"{x}_tokens"]])
                    keep.append(sorted(kept_tokens(seen[0])) == sorted(kept_tokens(seen[1])) and same_clauses(*seen))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        wide = both.join(a, "train_v").join(b, "eval_v").select("train_v", "eval_v", "tw", "tr", "ew", "er", "train_tokens", "eval_tokens", "train_slips", "eval_slips")
        return wide.mapInArrow(agree, "train_v string, eval_v string").distinct()

    def classes(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members, links): ``id, split, source, v`` and ``train_v, eval_v, exact``, each pair of variants that overlap once, a variant with itself too."""
        rows = cut(self.members(records))
        variants = cut(rows.groupBy("v").agg(F.first("tokens").alias("tokens"), F.coalesce(F.max(F.col("split") == "train"), F.lit(False)).alias("in_train"), F.coalesce(F.max(F.col("split") != "train"), F.lit(False)).alias("in_eval")))
        own = variants.where("in_train and in_eval").select(F.col("v").alias("train_v"), F.col("v").alias("eval_v"), F.lit(True).alias("exact"))
        return rows.where("split is not null").select("id", "split", "source", "v"), cut(own.unionByName(self.links(variants).withColumn("exact", F.lit(False))))

    def pairs(self, records: DataFrame) -> DataFrame:
        """``train_id, eval_id, split, source, exact`` for ``records`` (id, text, split, source), each pair of records once.

        exact: the canonical records agree. Records without id or split take no part in pairs but their words count; ids should
        be unique. Empty tables give no pairs.
        """
        members, links = self.classes(records)
        salt = F.pmod(F.xxhash64("id"), F.lit(self.salts)).cast("int")
        # At most 1000 variants have a thousandth of the records each.
        hot = F.broadcast(frequent(members, "v", 1000).withColumn("hot", F.lit(True)))
        every = F.sequence(F.lit(0), F.lit(self.salts - 1))
        one = F.array(F.lit(0))
        train = members.where("split = 'train'").join(hot, "v", "left").select(F.col("v").alias("train_v"), F.col("id").alias("train_id"), F.when(F.col("hot"), salt).otherwise(0).alias("salt"))
        spread = links.join(hot.withColumnRenamed("v", "train_v"), "train_v", "left").select("train_v", "eval_v", "exact", F.explode(F.when(F.col("hot"), every).otherwise(one)).alias("salt"))
        half = train.join(spread, ["train_v", "salt"]).select("train_id", "eval_v", "exact")
        half = half.join(hot.withColumnRenamed("v", "eval_v"), "eval_v", "left").select("train_id", "eval_v", "exact", F.when(F.col("hot"), F.pmod(F.xxhash64("train_id"), F.lit(self.salts)).cast("int")).otherwise(0).alias("salt"))
        rest = members.where("split <> 'train'").join(hot, "v", "left").select(F.col("v").alias("eval_v"), F.col("id").alias("eval_id"), "split", "source", F.explode(F.when(F.col("hot"), every).otherwise(one)).alias("salt"))
        return half.join(rest, ["eval_v", "salt"]).select("train_id", "eval_id", "split", "source", "exact")

    def report(self, records: DataFrame) -> DataFrame:
        """Per evaluation split and source: ``split, source, items, overlapping, same, near, pairs``; same and near count the items.

        Counted by variants: no pair of records is written out.
        """
        members, links = self.classes(records)
        partners = members.where("split = 'train'").groupBy(F.col("v").alias("train_v")).agg(F.count(F.lit(1)).alias("n"))
        of = links.join(partners, "train_v").groupBy(F.col("eval_v").alias("v")).agg(F.sum("n").alias("partners"), F.max("exact").alias("exact"))
        items = members.where("split <> 'train'").groupBy("v", "split", "source").agg(F.count(F.lit(1)).alias("c")).join(of, "v", "left")
        none = records.where("id is not null").select("id", split_name(F.col("split")).alias("split"), "source").where("split in ('dev', 'test')").groupBy("split", "source").agg(F.count(F.lit(1)).alias("items"))
        some = items.groupBy("split", "source").agg(
            F.sum(F.when(F.col("partners").isNotNull(), F.col("c")).otherwise(0)).alias("overlapping"), F.sum(F.when(F.col("exact"), F.col("c")).otherwise(0)).alias("same"), F.sum(F.when(~F.col("exact"), F.col("c")).otherwise(0)).alias("near"), F.sum(F.coalesce(F.col("partners") * F.col("c"), F.lit(0))).alias("pairs")
        ).select(F.col("split").alias("s2"), F.col("source").alias("c2"), "overlapping", "same", "near", "pairs")
        joined = none.join(some, F.col("split").eqNullSafe(F.col("s2")) & F.col("source").eqNullSafe(F.col("c2")), "left")
        return joined.select("split", "source", "items", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("overlapping", "same", "near", "pairs")])
