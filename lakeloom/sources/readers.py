"""Reading corpora and record files, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GOLD = "id string, lang string, question string, reference_answer string, source_doc_id string, source_spans array<struct<doc_id:string,char_start:int,char_end:int,text:string>>, provenance string, verified boolean, split string"


def read_corpus(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """``doc_id, text, raw_hash`` of all .txt and .md files under a folder, and their governance from a manifest.

    ``doc_id`` is the path below ``root``.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}")
    base = root.rstrip("/").removeprefix("file://") + "/"
    docs = files.select(F.substring_index(F.url_decode(F.col("_metadata.file_path")), base, -1).alias("doc_id"), F.col("value").alias("text")).withColumn("raw_hash", F.sha2("text", 256))
    return docs if manifest is None else docs.join(manifest, "doc_id", "left")


def read_records(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines; ``strict`` fails on a bad line, else bad lines are kept in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType(list(full)).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)


def read_fenced(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold JSON: an array, one object, or either inside a fenced block of prose."""
    whole = spark.read.text(path, wholetext=True).select(F.coalesce(F.nullif(F.regexp_extract("value", r"```(?:json)?\s*\n([\s\S]*?)```", 1), F.lit("")), F.col("value")).alias("v"))
    body = F.trim(F.regexp_replace("v", r"^\s+|\s+$", ""))
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return whole.select(F.explode(F.from_json(listed, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, nulls written out."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
