"""JSON lines with a fixed schema: tolerant reading, exact writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_lines(lines: DataFrame, schema: StructType | str, *, strict: bool = True, col: str = "value", source: str | None = None) -> DataFrame:
    """The records of ``lines`` with the fields of ``schema``, and ``unknown_fields`` (name to JSON text) for all others.

    Blank lines and lines that start with // are skipped, missing fields are null. A line that is no object is an error with its
    text and the column ``source`` (such as its file) while the records are read if ``strict``, without a pass of its own; else it is left out.
    """
    kept = lines.select(F.col(col).alias("line"), (F.col(source) if source else F.lit("")).alias("source")).where((F.trim("line") != "") & ~F.ltrim("line").startswith("//"))
    x = kept.select("line", "source", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"), F.from_json("line", "map<string,string>").alias("m")).withColumn("ok", F.coalesce(F.ltrim("line").startswith("{") & F.col("m").isNotNull(), F.lit(False)))
    if strict:
        x = x.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), "source", F.lit(" "), F.substring("line", 1, 200))).cast("boolean")))
    known = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()
    return x.where("ok").select("r.*", F.map_filter("m", lambda k, v: ~k.isin(known)).alias("unknown_fields"))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of the lines at ``path`` that are no JSON objects."""
    files = [r["f"] for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
    out = None
    for f in files:
        numbered = spark.sparkContext.textFile(f).zipWithIndex().toDF("line string, n long").select(F.lit(f).alias("file"), (F.col("n") + 1).alias("line_no"), "line")
        out = numbered if out is None else out.unionByName(numbered)
    if out is None:
        return spark.createDataFrame([], "file string, line_no long, line string")
    bad = ~F.coalesce(F.ltrim("line").startswith("{") & F.from_json("line", "map<string,string>").isNotNull(), F.lit(False))
    return out.where((F.trim("line") != "") & ~F.ltrim("line").startswith("//") & bad)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, *, strict: bool = True) -> DataFrame:
    """Records of the files at ``path``; a missing path is an empty table."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return parse_lines(spark.createDataFrame([], "value string"), schema, strict=strict)
    return parse_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), schema, strict=strict, source="file")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write one object a line, nulls left out; returns the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_texts(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``path``/{doc_id}.txt for those of ``docs`` that have one."""
    files = spark.read.text(f"{path}/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))
    return docs.select("doc_id").distinct().join(files, "doc_id")
