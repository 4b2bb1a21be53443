"""Consensus labels, agreement and annotator reliability from several annotators' labels, by minimax conditional entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.session import cut, frequent, lookup


def annotator_key(name: Column) -> Column:
    """One spelling of an annotator's name: case, spaces, underscores, a remark in parentheses and ``human:`` don't matter; blank is null."""
    key = F.lower(F.regexp_replace(name, r"\([^)]*\)", " "))
    key = F.regexp_replace(key, r"^\s*human\s*:", "")
    key = F.regexp_replace(F.regexp_replace(key, r"[^\p{L}\p{N}:]+", "-"), "^-+|-+$", "")
    return F.when(key != "", key)


def latest_votes(labels: DataFrame) -> DataFrame:
    """The last non-null label of each annotator for each item.

    ``labels``: ``id, annotator, label (int), at (timestamp), seq (long)``. Rows without id, annotator or label are no
    votes; a null ``at`` is older than any other; ``seq``, then the larger label decide between equal times. Repeats
    fold into one row before the exchange.
    """
    votes = labels.where("id is not null and annotator is not null and label is not null")
    return votes.groupBy("id", "annotator").agg(F.max(F.struct(F.coalesce(F.col("at").cast("double"), F.lit(-1e18)), F.coalesce("seq", F.lit(-1)), "label")).getField("label").alias("label"))


def _tilt(counts: np.ndarray, grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """One damped Newton step of a tilting parameter."""
    return np.clip(counts + (grad - ridge * counts) / (2 * hess + ridge), -8, 8)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _solve(item: np.ndarray, sigma: np.ndarray, x: np.ndarray, n: int, k: int, beta: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the items of a batch and the probabilities of each vote's labels, with the annotators' tilts held.

    item: the item of each vote; sigma: (votes, k, k), its annotator's tilt; x: its label.
    """
    tau = np.zeros((n, k, k))
    votes = np.arange(len(item))
    p = _softmax(sigma)
    for step in range(rounds + 1):
        logq = np.zeros((n, k))
        np.add.at(logq, item, np.log(np.maximum(p[votes, :, x], 1e-12)))
        q = _softmax(logq)
        if step == rounds:
            return q, p
        qv = q[item]
        grad, hess = np.zeros_like(tau), np.zeros_like(tau)
        seen = -p * qv[:, :, None]
        seen[votes, :, x] += qv
        np.add.at(grad, item, seen)
        np.add.at(hess, item, qv[:, :, None] * p * (1 - p))
        tau = _tilt(tau, grad, hess, beta)
        p = _softmax(sigma + tau[item])
    raise AssertionError


class MinimaxConsensus:
    """Minimax conditional entropy with annotator and item tilts.

    The label ``x`` that annotator i gives item j of true label c has probability softmax(sigma_i[c] + tau_j[c])[x]. Block
    coordinate ascent on the regularised dual: a pass over the items solves each item's posterior and tilt with the
    annotators' tilts held, and gathers the gradient for a Newton step of the latter. The first pass takes vote shares for
    posteriors. Items are rows of arrays, of one vote an annotator at most; an annotator has k*k numbers.

    classes: number of labels, 0 .. classes-1. alpha, beta: ridge of annotator and item tilts. passes: most passes.
    max_driver_annotators: up to so many annotators their tilts go along with the tasks; beyond, they are joined to the votes.
    """

    def __init__(self, classes: int = 2, *, alpha: float = 1.0, beta: float = 8.0, rounds: int = 3, passes: int = 10, tolerance: float = 0.02, max_driver_annotators: int = 100_000):
        self.k, self.alpha, self.beta, self.rounds, self.passes, self.tolerance, self.max_driver = classes, alpha, beta, rounds, passes, tolerance, max_driver_annotators

    def _attach(self, items: DataFrame, tilts: np.ndarray | DataFrame, hot: DataFrame | None) -> tuple[DataFrame, np.ndarray | None]:
        """Items with a column ``tilts`` per vote where the annotators are too many to send along."""
        if isinstance(tilts, np.ndarray):
            return items, tilts
        votes = items.select("id", F.explode(F.arrays_zip("ann", "x")).alias("v")).select("id", "v.ann", "v.x")
        votes = lookup(votes, tilts, "ann", hot)
        return votes.groupBy("id").agg(F.collect_list("ann").alias("ann"), F.collect_list("x").alias("x"), F.flatten(F.collect_list("tilt")).alias("tilts")), None

    def _batches(self, batches: Iterator[pa.RecordBatch], tilts: np.ndarray | None, first: bool):
        k = self.k
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            lists = b.column("ann")
            item = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            ann, x = lists.flatten().to_numpy(zero_copy_only=False), b.column("x").flatten().to_numpy(zero_copy_only=False)
            sigma = tilts[ann] if tilts is not None else b.column("tilts").flatten().to_numpy(zero_copy_only=False).reshape(-1, k, k)
            if first:
                shares = np.zeros((n, k))
                np.add.at(shares, (item, x), 1.0)
                yield b, item, ann, x, shares / np.maximum(shares.sum(1, keepdims=True), 1), _softmax(sigma)
            else:
                yield b, item, ann, x, *_solve(item, sigma, x, n, k, self.beta, self.rounds)

    def fit(self, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(items, annotators) of ``votes`` (id, annotator, label).

        items: ``id, label, confidence, n_votes, agreement``, agreement the share of pairs of its votes that agree (null for
        one vote). Equal posteriors go to the smaller label. annotators: ``annotator, n_votes, reliability, tilt, converged``,
        reliability the expected share of right labels; converged: did no tilt move by ``tolerance`` in the last pass, else
        ``passes`` ended the fit. No votes give empty tables.
        """
        k, spark = self.k, votes.sparkSession
        votes, hot = cut(votes), None
        names = votes.groupBy("annotator").count()
        few = names.limit(self.max_driver + 1).count() <= self.max_driver
        if few:
            listed = sorted(r["annotator"] for r in names.collect())
            names = spark.createDataFrame([(a, i) for i, a in enumerate(listed)], "annotator string, ann int")
            tilts: np.ndarray | DataFrame = np.zeros((len(listed), k, k))
        else:
            names = cut(names.select("annotator", F.xxhash64("annotator").alias("ann")))
            hot = frequent(votes.select(F.xxhash64("annotator").alias("ann")), "ann", 1000)
            tilts = names.select("ann", F.array_repeat(F.lit(0.0), k * k).alias("tilt"))
        index = F.broadcast(names) if few else names
        items = cut(votes.join(index, "annotator").groupBy("id").agg(F.collect_list("ann").alias("ann"), F.collect_list(F.col("label").cast("int")).alias("x")))
        for step in range(self.passes):
            moved = self._sums(items, tilts, hot, first=step == 0)
            if few:
                got = moved.collect()
                new = np.array(tilts)
                for r in got:
                    new[r["ann"]] = _tilt(new[r["ann"]], np.array(r["grad"]).reshape(k, k), np.array(r["hess"]).reshape(k, k), self.alpha)
                change = float(np.abs(new - tilts).max()) if new.size else 0.0
                tilts = new
            else:
                before = tilts
                step_of = F.transform(F.arrays_zip("tilt", "grad", "hess"), lambda v: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), v["tilt"] + (v["grad"] - self.alpha * v["tilt"]) / (2 * v["hess"] + self.alpha))))
                tilts = cut(before.join(moved, "ann").select("ann", step_of.alias("tilt")))
                both = before.select("ann", F.col("tilt").alias("was")).join(tilts, "ann")
                change = both.select(F.max(F.array_max(F.zip_with("was", "tilt", lambda a, b: F.abs(a - b))))).first()[0] or 0.0
            if step and change < self.tolerance:
                break
        self.steps, self.converged = step + 1, change < self.tolerance
        return self._labels(items, tilts, hot), self._reliability(items, tilts, hot, names, few).withColumn("converged", F.lit(self.converged))

    def _sums(self, items: DataFrame, tilts, hot: DataFrame | None, first: bool) -> DataFrame:
        attached, sent = self._attach(items, tilts, hot)
        k = self.k

        def run(batches):
            got: dict[int, np.ndarray] = {}
            for _, item, ann, x, q, p in self._batches(batches, sent, first):
                qv = q[item]
                grad = -p * qv[:, :, None]
                grad[np.arange(len(x)), :, x] += qv
                both = np.stack([grad, qv[:, :, None] * p * (1 - p)], 1).reshape(len(x), -1)
                which, at = np.unique(ann, return_inverse=True)
                sums = np.zeros((len(which), both.shape[1]))
                np.add.at(sums, at, both)
                for a, s in zip(which.tolist(), sums):
                    got[a] = got.get(a, 0) + s
            flat = np.array(list(got.values())).reshape(len(got), 2 * k * k)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(flat), pa.list_(pa.float64()))], ["ann", "v"])

        parts = attached.mapInArrow(run, "ann long, v array<double>")
        wide = parts.select("ann", *[F.col("v")[i].alias(f"v{i}") for i in range(2 * k * k)]).groupBy("ann").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(2 * k * k)])
        return wide.select("ann", F.array(*[f"v{i}" for i in range(k * k)]).alias("grad"), F.array(*[f"v{i}" for i in range(k * k, 2 * k * k)]).alias("hess"))

    def _labels(self, items: DataFrame, tilts, hot: DataFrame | None) -> DataFrame:
        attached, sent = self._attach(items, tilts, hot)

        def run(batches):
            for b, item, _, x, q, _p in self._batches(batches, sent, False):
                counts = np.zeros(q.shape)
                np.add.at(counts, (item, x), 1.0)
                n = counts.sum(1)
                agree = np.where(n > 1, (counts * (counts - 1)).sum(1) / np.maximum(n * (n - 1), 1), np.nan)
                best = (q > q.max(1, keepdims=True) - 1e-9).argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(best, pa.int32()), pa.array(q[np.arange(len(best)), best]), pa.array(n.astype("int64")), pa.array(agree, from_pandas=True)], ["id", "label", "confidence", "n_votes", "agreement"]
                )

        kind = dict(items.dtypes)["id"]
        return attached.mapInArrow(run, f"id {kind}, label int, confidence double, n_votes long, agreement double")

    def _reliability(self, items: DataFrame, tilts, hot: DataFrame | None, names: DataFrame, few: bool) -> DataFrame:
        attached, sent = self._attach(items, tilts, hot)

        def run(batches):
            for _, item, ann, x, q, _p in self._batches(batches, sent, False):
                which, at = np.unique(ann, return_inverse=True)
                right, n = np.zeros(len(which)), np.zeros(len(which), "int64")
                np.add.at(right, at, q[item, x])
                np.add.at(n, at, 1)
                yield pa.RecordBatch.from_arrays([pa.array(which.astype("int64")), pa.array(right), pa.array(n)], ["ann", "right", "n"])

        sums = attached.mapInArrow(run, "ann long, right double, n long").groupBy("ann").agg(F.sum("n").alias("n_votes"), F.round(F.sum("right") / F.sum("n"), 6).alias("reliability"))
        if few:
            tilts = names.sparkSession.createDataFrame([(i, t.ravel().tolist()) for i, t in enumerate(tilts)], "ann int, tilt array<double>")
        return names.join(tilts, "ann").join(sums, "ann").select("annotator", "n_votes", "reliability", F.transform("tilt", lambda t: F.round(t, 4)).alias("tilt"))


def krippendorff_alpha(votes: DataFrame) -> DataFrame:
    """Nominal Krippendorff's alpha over items with two or more votes: ``n_items, n_votes, observed, expected, alpha``.

    observed and expected are shares of disagreeing pairs; alpha is null where nothing could disagree.
    """
    by_item = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("c"))
    items = by_item.groupBy("id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n > 1")
    total = items.agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").cast("bigint").alias("n_votes"), F.sum((F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)).alias("unlike"))
    labels = by_item.join(items.select("id"), "id", "left_semi").groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("csq"))
    n = F.col("n_votes")
    expected = (n * n - F.col("csq")) / (n * (n - 1))
    return total.crossJoin(labels).select(
        "n_items", "n_votes", F.round(F.col("unlike") / n, 6).alias("observed"), F.round(expected, 6).alias("expected"),
        F.when(expected > 0, F.round(1 - F.col("unlike") / n / expected, 6)).alias("alpha"),
    )
