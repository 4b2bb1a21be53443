"""Mixing sources to target shares of the tokens, with capped repeats, by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm.encoding import DEFAULT_TOKENIZER, token_counts
from pramana.operators.running import running_start
from pramana.session import cut, frequent, lookup

#: Points have so many bits: a slot's is that of its number times the golden ratio's fraction, without overflow and without repeats.
BITS = 52
_STEP = 2783377641436327  # fixed value: the fraction of the golden ratio in BITS bits
_HALF = 1 << BITS // 2
#: Where more sources than this are given, they are joined by exchange instead of being sent along.
MAX_SENT = 100_000
_BINS = 12


def points(spark: SparkSession, slots: int, first: int = 0) -> DataFrame:
    """``i, u``: the point of each slot from ``first`` on, of BITS bits. Products of halves only, so that no number of slots overflows."""
    i, high, low = F.col("id"), _STEP // _HALF, _STEP % _HALF
    # i * step modulo 2**BITS, with i = i1 * 2**26 + i0 and the step likewise.
    upper = (i % _HALF * high + F.shiftright(i, BITS // 2) % _HALF * low) % _HALF * _HALF
    return spark.range(first, first + slots).select(i.alias("i"), ((upper + i % _HALF * low) % (1 << BITS)).alias("u"))


class SourceMixer:
    """Draw texts of sources so that each source has its target share of the tokens.

    A text is one however often it stands in the table: exact repeats count as the text of the smallest id. Sources
    without texts, and sources without a target, take no part; the other targets are scaled to sum to 1. The mix is as
    large as the caps allow (``max_tokens`` at most): the largest total for which no source needs more than ``max_repeats``
    passes over its texts.

    The total is cut into slots of ``block_tokens`` (fewer where that would make less than a thousand slots). Slot i stands at
    frac(i * golden ratio); the cumulative weights turn that into a source, so that any stretch of slots has nearly the target
    shares. A source's texts, shuffled by a hash and repeated pass after pass, are one stream of tokens that is cut into blocks of equally many; its
    r-th slot takes block r: the texts whose middle lies in it. Texts are never cut, so a source's share is its target but for
    half a text and the discrepancy of the points.
    """

    def __init__(self, *, block_tokens: int = 256, max_tokens: int | None = None, seed: int = 42, tokenizer: str = DEFAULT_TOKENIZER, rows_a_bucket: int = 20_000):
        self.block, self.max_tokens, self.seed, self.tokenizer, self.rows = block_tokens, max_tokens, seed, tokenizer, rows_a_bucket

    @staticmethod
    def _join(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
        """``rows`` with the columns of their source; a source may hold most rows."""
        return rows.join(F.broadcast(sources), "source") if few else lookup(rows, sources, "source", frequent(rows, "source", 1000))

    def _plan(self, docs: DataFrame, targets: DataFrame) -> None:
        self.spark = docs.sparkSession
        goal = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        self.goal = goal = cut(goal)
        self.few = few = goal.count() <= MAX_SENT
        named = docs.where("source is not null and text is not null and text <> ''").select("doc_id", "source", "text")
        # Copies and sources without a target are out before any text is encoded.
        one = self._join(named, goal.select("source"), few).groupBy(F.md5("text").alias("key")).agg(F.min(F.struct("doc_id", "source", "text")).alias("v")).select("v.*")
        texts = token_counts(one, keep=["doc_id", "source"], tokenizer=self.tokenizer).where("n_tokens > 0")
        self.texts = texts = cut(texts.withColumn("h", F.xxhash64(F.lit(self.seed), "doc_id")))

        self.have = have = cut(texts.groupBy("source").agg(F.sum("n_tokens").alias("usable"), F.count(F.lit(1)).alias("n")))
        plan = goal.join(have, "source")
        sums = plan.agg(F.sum("target_share").alias("share"), F.min(F.col("max_repeats") * F.col("usable") / F.col("target_share")).alias("t"), F.sum("n").alias("n")).first()
        share, self.n = sums["share"] or 1.0, sums["n"] or 0
        size = int((sums["t"] or 0) * share)
        if self.max_tokens:
            size = min(size, self.max_tokens)
        self.block_used = max(1, min(self.block, size // 1000))
        slots = size // self.block_used
        weight = F.round(F.col("target_share") / share * (1 << BITS)).cast("long")
        plan = plan.withColumns({"weight": weight, "all": F.lit(1), "part": F.pmod(F.xxhash64("source"), F.lit(64))})
        plan = running_start(plan, "all", ["source"], "weight", "part", "lo").withColumn("hi", F.col("lo") + F.col("weight"))
        plan = cut(plan.select("source", "max_repeats", "usable", "lo", "hi"))
        # A source lies in the bins its interval touches: as many rows as sources and bins together.
        wide = 1 << (BITS - _BINS)
        bins = plan.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))).alias("bin"))
        at = points(self.spark, slots).withColumn("bin", F.floor(F.col("u") / wide))
        self.placed = at.join(F.broadcast(bins) if few else bins, "bin").where("u >= lo and u < hi").select("i", "source")
        counts = self.placed.groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
        self.plan = cut(plan.join(counts, "source").select("source", "usable", F.least(F.col("slots") * self.block_used, F.col("max_repeats") * F.col("usable")).alias("tokens")))

        parts = max(1, self.n // self.rows)
        # The top bits of the hash: as unsigned, in order.
        ordered = texts.withColumn("part", F.floor((F.col("h") / float(1 << 63) + 1) / 2 * parts))
        started = running_start(ordered, "source", ["h", "doc_id"], "n_tokens", "part", "start")
        middle = F.col("start") + F.col("n_tokens") / 2
        used = self._join(started, self.plan, few).withColumn("repeats", F.ceil((F.col("tokens") - middle) / F.col("usable")).cast("long"))
        self.used = cut(used.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats", middle.alias("middle"), "usable"))

    def mix(self, docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(texts, shares) for ``docs`` (doc_id, text, source) and ``targets`` (source, target_share, max_repeats).

        texts: ``doc_id, source, n_tokens, repeats``, the texts that are used and how often. shares: one row per source of
        either table: ``source, target_share, max_repeats, usable_tokens, used_texts, used_tokens, reached_share,
        most_repeats``. Null sources, null, empty and tokenless texts are not used; a null or non-positive target or cap is
        no target. The text of several sources with a target belongs to that of its smallest id. Empty tables give an empty mix.
        """
        self._plan(docs, targets)
        reached = cut(self.used.groupBy("source").agg(F.count(F.lit(1)).alias("used_texts"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats")))
        whole = reached.agg(F.sum("used_tokens")).first()[0] or 1
        listed = docs.where("source is not null").select("source").distinct()
        shares = self.goal.join(listed, "source", "full_outer").join(self.have.select("source", F.col("usable").alias("usable_tokens")), "source", "left").join(reached, "source", "left")
        zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("usable_tokens", "used_texts", "used_tokens")]
        shares = shares.select("source", "target_share", "max_repeats", *zero, F.round(F.coalesce(F.col("used_tokens") / whole, F.lit(0.0)), 6).alias("reached_share"), F.coalesce("most_repeats", F.lit(0)).cast("bigint").alias("most_repeats"))
        return self.used.select("doc_id", "source", "n_tokens", "repeats"), shares

    def schedule(self, docs: DataFrame, targets: DataFrame) -> DataFrame:
        """``slot, doc_id, source, pass, n_tokens``: each use of a text with the slot it stands in; any stretch of slots has nearly the target shares."""
        self._plan(docs, targets)
        slot = self.placed.withColumns({"one": F.lit(1), "part": F.floor(F.col("i") / self.rows)})
        ranked = running_start(slot, "source", ["i"], "one", "part", "r").select("source", "r", F.col("i").alias("slot"))
        uses = self.used.select("doc_id", "source", "n_tokens", "middle", "usable", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("pass"))
        uses = uses.withColumn("r", F.floor((F.col("pass") * F.col("usable") + F.col("middle")) / self.block_used))
        return uses.join(ranked, ["source", "r"]).select("slot", "doc_id", "source", "pass", "n_tokens")
