"""Reports as text files, folders of JSON documents, and fingerprints of records."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_lines(df: DataFrame, title: str, *, most: int = 1000) -> list[str]:
    """A small result as lines of aligned columns; more than ``most`` rows are an error, as a report isn't the place for them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    cells = [df.columns] + [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    wide = [max(map(len, c)) for c in zip(*cells)]
    return [title, "-" * 78, *["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in cells]]


def write_report(path: str, lines: Iterable[str], say: Callable[[str], None] | None = None) -> int:
    """Write lines to a file and, the same, to ``say``; returns their number."""
    lines = list(lines)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(x + "\n" for x in lines)
    for x in lines if say else ():
        say(x)
    return len(lines)


@dataclass
class Stage:
    """What became of a report: its lines and path, or why there is none."""

    name: str
    path: str = ""
    lines: int = 0
    skipped: str = ""


def run_all(folder: str, stages: dict[str, Callable[[], DataFrame]], say: Callable[[str], None] | None = None) -> list[Stage]:
    """Write a report of each stage's result. A stage that fails is skipped with its reason; the others go on."""
    out = []
    for name, make in stages.items():
        path = os.path.join(folder, f"report-{name}.txt")
        try:
            out.append(Stage(name, path, write_report(path, table_lines(make(), name), say)))
        except Exception as e:  # noqa: BLE001 - whatever a stage runs into is its reason
            out.append(Stage(name, skipped=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]))
    return out


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file`` and the fields of ``schema`` of each JSON document of a folder, in the order of names; unreadable ones are left out. A folder without documents is an empty table."""
    try:
        texts = spark.read.text(f"{path}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    except Exception as e:  # noqa: BLE001 - a folder without documents
        if "PATH_NOT_FOUND" not in str(e):
            raise
        texts = spark.createDataFrame([], "file string, value string")
    parsed = texts.withColumn("ok", F.try_parse_json("value").isNotNull()).select("file", "ok", F.from_json("value", schema).alias("r"))
    return parsed.where("ok and r is not null").select("file", "r.*").orderBy("file")


def content_hash(records: DataFrame, key: list[Column | str]) -> str:
    """A fingerprint of records in the order of a key that tells them apart: the same for the same records, whatever their partitions.

    Each record's SHA-256, as JSON with sorted keys under its place's key, gives four numbers of 60 bits that are added up exactly.
    """
    text = F.concat(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), F.lit("\u0000"), F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}))
    h = F.sha2(text, 256)
    part = lambda i: F.conv(F.substring(h, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = records.agg(*[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", "s0", "s1", "s2", "s3", "n"), 256)).first()[0]
