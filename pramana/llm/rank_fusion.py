"""One ranking from several differently-scaled scores, by normal scores of within-list percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of ``p`` in (0, 1), in built-in arithmetic (relative error below 1.2e-9)."""
    q = p - F.lit(0.5)
    r = q * q
    middle = _poly(r, _A) * q / _poly(r, (*_B, 1.0))
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    return (
        F.when(p < _LOW, _poly(low, _C) / _poly(low, (*_D, 1.0)))
        .when(p > 1 - _LOW, -_poly(high, _C) / _poly(high, (*_D, 1.0)))
        .otherwise(middle)
    )


def _finite(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def normal_score_ranking(
    runs: DataFrame,
    *,
    query: str = "query_id",
    item: str = "passage_id",
    method: str = "method_name",
    score: str = "score",
    rank: str = "rank_no",
    parts: str | None = "component_scores",
    loaded: str = "loaded_at",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Combine the lists of all methods into one ranking per query.

    In each list a score becomes its percentile among all the items any list of the query holds, ties averaged; the items
    a list lacks tie at its bottom. The percentile's normal score is averaged over the query's methods with ``weights``
    (1 for a method without one). Only order within a list counts, so neither range nor outliers of a scale matter.

    A null or NaN score is taken from ``parts[method]``, failing that from ``rank``, failing that the item counts as absent
    from the list. Rows without query, item or method are left out; of repeated rows the last loaded counts; equal means go
    by item id. An empty table gives an empty ranking. All steps share one exchange on the query; a list is a top-k list.

    Returns ``query_id, passage_id, fused, n_methods, position`` under the given names of query and item.
    """
    own = _finite(F.col(score))
    if parts:
        own = F.coalesce(own, _finite(F.col(parts)[F.col(method)]))
    x = runs.select(
        F.col(query).alias("q"), F.col(item).alias("i"), F.col(method).alias("m"), own.alias("s"), F.col(rank).cast("double").alias("k"), F.col(loaded).alias("at")
    ).where("q is not null and i is not null and m is not null and (s is not null or k is not null)")
    x = x.repartition("q").groupBy("q", "m", "i").agg(F.max(F.struct("at", "s", "k")).alias("v")).select("q", "m", "i", "v.s", "v.k")

    lists = Window.partitionBy("q", "m")
    by_query = Window.partitionBy("q")
    x = x.withColumns({"len": F.count(F.lit(1)).over(lists), "scored": F.count("s").over(lists), "pos": F.rank().over(lists.orderBy(F.col("s").desc_nulls_last())), "peers": F.count(F.lit(1)).over(Window.partitionBy("q", "m", "s"))})
    x = x.withColumn("r", F.when(F.col("s").isNotNull(), F.col("pos") + (F.col("peers") - 1) / 2).otherwise(F.least(F.col("k"), F.col("len").cast("double"))))
    x = x.withColumn("d", F.dense_rank().over(by_query.orderBy("i"))).withColumn("n", F.max("d").over(by_query))
    w = F.lit(1.0)
    if weights:
        known = F.create_map(*[F.lit(v) for kv in weights.items() for v in (kv[0], float(kv[1]))])
        w = F.coalesce(known[F.col("m")], F.lit(1.0))
    n = F.col("n").cast("double")
    absent = F.when(F.col("len") < F.col("n"), inverse_normal((n - (F.col("len") + n + 1) / 2 + 0.5) / n)).otherwise(0.0)
    x = x.withColumns({"w": w, "za": absent, "z": inverse_normal((n - F.col("r") + 0.5) / n)})
    x = x.withColumns({"base": F.sum(F.col("w") * F.col("za") / F.col("len")).over(by_query), "total": F.sum(F.col("w") / F.col("len")).over(by_query)})
    fused = x.groupBy("q", "i").agg(
        F.round((F.first("base") + F.sum(F.col("w") * (F.col("z") - F.col("za")))) / F.first("total"), 9).alias("fused"), F.count(F.lit(1)).alias("n_methods")
    )
    ranked = fused.withColumn("position", F.row_number().over(by_query.orderBy(F.col("fused").desc(), "i")).cast("bigint"))
    return ranked.select(F.col("q").alias(query), F.col("i").alias(item), "fused", "n_methods", "position")
