"""Prompts and model replies as columns: parsing, grounding, and replies that are asked for only once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.operators.serving import extract_json_object

# The refusal, and labels that may stand before a translation.
REFUSAL = "Insufficient information available in the provided documents."
LABELS = ["JSON:", "Hindi:", "English:", "Translation:", "Answer:"]


def slugify(model: Column) -> Column:
    """A model's name as part of a path."""
    return F.replace(F.replace(model, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


def cache_key(model: Column, pooling: Column, is_mlm: Column) -> Column:
    """Under which name a model's vectors are kept: with the pooling where the model itself has none."""
    return F.when(is_mlm, F.concat_ws(".", slugify(model), pooling)).otherwise(slugify(model))


def prompt_hash(prompt: Column, model: Column, params: Column) -> Column:
    """16 hex digits for a prompt to a model with parameters."""
    return F.substring(F.sha2(F.concat(model, F.lit("\u0000"), params, F.lit("\u0000"), prompt), 256), 1, 16)


def pair_key(premise: Column, hypothesis: Column) -> Column:
    """16 hex digits for a pair of texts whose entailment is asked for."""
    return F.substring(F.sha2(F.concat(premise, F.lit("\u0000"), hypothesis), 256), 1, 16)


def nli_label(entailment: Column, neutral: Column, contradiction: Column) -> Column:
    """The likeliest verdict; of equals the first in this order."""
    top = F.greatest(entailment, neutral, contradiction)
    return F.when(entailment == top, "entailment").when(neutral == top, "neutral").otherwise("contradiction")


def parse_prompt(prompt: Column) -> Column:
    """Struct ``question`` and ``ids``: what a prompt asks, and the ids of its passages in their order."""
    question = F.trim(F.regexp_extract(prompt, r"(?m)^Question:\s*(.+)$", 1))
    return F.struct(question.alias("question"), F.regexp_extract_all(prompt, F.lit(r"(?m)^\[\d+\]\s+id=(\S+)"), F.lit(1)).alias("ids"))


def _text(v: Column, name: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def _true(v: Column, name: str) -> Column:
    """Is a member of a JSON object true, a number other than 0, or a text, list or object with something in it? Missing counts as true."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    text = F.try_variant_get(v, f"$.{name}", "string")
    return (
        F.when(kind.isNull(), True)
        .when(kind == "VOID", False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(F.try_variant_get(v, f"$.{name}", "variant")).isin("[]", "{}"))
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )


def parse_answer(reply: Column) -> Column:
    """Struct ``answerable``, ``answer``, ``citation``, ``confidence`` of the first JSON object of a reply; null where there is none.

    answerable is what the object says, true if it says nothing; text outside the object doesn't matter.
    """
    v = F.try_parse_json(extract_json_object(reply))
    members = F.struct(_true(v, "answerable").alias("answerable"), _text(v, "answer").alias("answer"), _text(v, "citation").alias("citation"), F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0)).alias("confidence"))
    return F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), members)


def parse_reply(reply: Column) -> Column:
    """Struct ``question``, ``answer``, ``kind`` (fact if not given) of a reply that is one JSON object; null without a question."""
    v = F.try_parse_json(F.trim(reply))
    kind = _text(v, "kind")
    got = F.struct(_text(v, "question").alias("question"), _text(v, "answer").alias("answer"), F.when(kind == "", "fact").otherwise(kind).alias("kind"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & (_text(v, "question") != ""), got)


def parse_translation(reply: Column) -> Column:
    """The translation in a reply: the question of its JSON object, else its first line without labels and quotation marks; null if nothing is left."""
    t = F.trim(reply)
    for label in LABELS:
        t = F.regexp_replace(t, rf"^{label}\s*", "")
    line = F.trim(F.regexp_replace(F.trim(F.substring_index(F.regexp_replace(t, r"\r\n?", "\n"), "\n", 1)), '^"+|"+$', ""))
    return F.coalesce(parse_reply(extract_json_object(reply))["question"], F.when(line != "", line))


def grounded(reply: Column, context: Column) -> Column:
    """Struct ``answerable``, ``answer``, ``citation``, ``confidence``, ``explanation`` of a reply to a prompt with the passages ``context``.

    Refused are replies without an object, ones that say so, empty answers and the words of the refusal itself. A citation that isn't
    one of the passages becomes the first of them.
    """
    a = parse_answer(reply)
    bare = lambda c: F.lower(F.regexp_replace(c, r"\.+$", ""))
    says = a["answerable"] & (a["answer"] != "") & (bare(a["answer"]) != bare(F.lit(REFUSAL)))
    cited = F.array_contains(context, a["citation"])
    first = F.when(cited, a["citation"]).otherwise(F.get(context, F.lit(0)))
    why = F.when(a.isNull(), "The reply holds no JSON object.").when(~says, "The reply says that the passages hold no answer.").when(cited, F.concat(F.lit("From "), first)).otherwise(F.concat(F.lit("From "), first, F.lit(", which the reply doesn't cite")))
    return F.struct(
        F.coalesce(says, F.lit(False)).alias("answerable"), F.when(F.coalesce(says, F.lit(False)), a["answer"]).otherwise(REFUSAL).alias("answer"), F.when(a.isNotNull(), first).alias("citation"),
        F.coalesce(a["confidence"], F.lit(0.0)).alias("confidence"), why.alias("explanation"),
    )


class Provider(Protocol):
    """Answers prompts. It is sent to the tasks, so it opens models and connections on first use."""

    name: str

    def complete(self, prompts: list[str]) -> list[str]: ...


class ReplyCache:
    """A Parquet folder of replies by ``key``. Each prompt is asked for once; of repeated keys the last written counts."""

    def __init__(self, path: str):
        self.path = path

    def rows(self, spark: SparkSession) -> DataFrame:
        """``key, reply`` of all kept replies; none where nothing was kept yet."""
        try:
            kept = spark.read.schema("key string, reply string, written timestamp").parquet(self.path)
        except Exception as e:  # noqa: BLE001 - a folder that isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "key string, reply string")
        return kept.groupBy("key").agg(F.max_by("reply", "written").alias("reply"))

    def complete(self, prompts: DataFrame, provider: Provider, batch: int = 16) -> DataFrame:
        """``key, reply`` for ``prompts`` (key, prompt): kept ones, and new ones after they were written."""
        spark = prompts.sparkSession
        once = prompts.where("key is not null").groupBy("key").agg(F.first("prompt").alias("prompt"))
        new = once.join(self.rows(spark).select("key"), "key", "left_anti")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, batch):
                    part = b.slice(i, batch)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(provider.complete(part.column(1).to_pylist()), pa.string())], ["key", "reply"])

        new.mapInArrow(ask, "key string, reply string").withColumn("written", F.current_timestamp()).write.mode("append").parquet(self.path)
        return prompts.select("key").distinct().join(self.rows(spark), "key")


class PairScorer(Protocol):
    """Scores pairs of texts: entailment, neutral, contradiction."""

    name: str

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]: ...


class _AsProvider:
    """A scorer as a provider of replies: a prompt is a pair as JSON, a reply its three numbers."""

    def __init__(self, scorer: PairScorer):
        self.scorer, self.name = scorer, scorer.name

    def complete(self, prompts: list[str]) -> list[str]:
        return [json.dumps(list(x)) for x in self.scorer.score([tuple(json.loads(p)) for p in prompts])]


def entailments(pairs: DataFrame, cache: ReplyCache, scorer: PairScorer) -> DataFrame:
    """``pairs`` (premise, hypothesis, ...) with ``entailment, neutral, contradiction, label``; each different pair is scored once and kept."""
    x = pairs.withColumn("__key", pair_key(F.coalesce("premise", F.lit("")), F.coalesce("hypothesis", F.lit(""))))
    prompts = x.select(F.col("__key").alias("key"), F.to_json(F.array(F.coalesce("premise", F.lit("")), F.coalesce("hypothesis", F.lit("")))).alias("prompt"))
    got = cache.complete(prompts, _AsProvider(scorer)).select(F.col("key").alias("__key"), F.from_json("reply", "array<double>").alias("__v"))
    v = lambda i: F.get("__v", F.lit(i))
    return x.join(got, "__key").withColumns({"entailment": v(0), "neutral": v(1), "contradiction": v(2), "label": nli_label(v(0), v(1), v(2))}).drop("__key", "__v")
