"""The rate limiter and question scoring over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pramana.operators.serving import Limits


def rate_limit_stream(requests: DataFrame, limits: Limits | None = None, *, idle_ms: int = 86_400_000) -> DataFrame:
    """As operators.serving.rate_limit for a stream (request_id, visitor, ts): each visitor's accepted times are kept as state.

    State of a visitor without requests for ``idle_ms`` is dropped; requests within a batch are taken in order of time, one
    that comes in a later batch after later ones is judged at its own time.
    """
    limits = limits or Limits()
    kinds = dict(requests.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "request_id"])
        decisions = [limits.decide(accepted, t) for t in rows["t"]]
        state.update((accepted,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"request_id": rows["request_id"], "visitor": key[0], "decision": decisions})

    x = requests.select("request_id", "visitor", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return x.groupBy("visitor").applyInPandasWithState(run, f"request_id {kinds['request_id']}, visitor {kinds['visitor']}, decision string", "accepted array<double>", "append", "ProcessingTimeTimeout")


def score_stream(questions: DataFrame, index, sink, *, k: int = 10, checkpoint: str | None = None):
    """Score each micro-batch of a stream of questions (id, question) against a lexical index; ``sink(DataFrame, batch_id)`` gets the ranking."""
    writer = questions.writeStream.foreachBatch(lambda batch, n: sink(index.bm25(batch, k=k), n))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
