"""Bundles of tables published as a whole: stores, graphs, runs; and an append-only event log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_META = "meta.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(tables: dict[str, DataFrame], base: str, meta: dict | None = None) -> str:
    """Write the tables as the next generation under ``base`` and return its path.

    They are written to a staging folder with their meta data last; one rename publishes them, so a reader sees all or nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    base = base.rstrip("/")
    staging = f"{base}/.staging-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    fs, root = _fs(spark, base)
    number = 1 + max([int(x.getPath().getName()[4:]) for x in fs.listStatus(root) if x.getPath().getName().startswith("gen-")], default=0)
    _, at = _fs(spark, f"{staging}/{_META}")
    out = fs.create(at)
    out.write(bytearray(json.dumps({"tables": sorted(tables), **(meta or {})}).encode()))
    out.close()
    final = f"{base}/gen-{number:08d}"
    if not fs.rename(_fs(spark, staging)[1], _fs(spark, final)[1]):
        raise OSError(f"{final} could not be published")
    return final


def latest(spark: SparkSession, base: str) -> str:
    """The newest generation under ``base`` that has its meta data; staging folders are ignored."""
    fs, root = _fs(spark, base.rstrip("/"))
    names = sorted(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().startswith("gen-"))
    for name in reversed(names):
        if fs.exists(_fs(spark, f"{base.rstrip('/')}/{name}/{_META}")[1]):
            return f"{base.rstrip('/')}/{name}"
    raise FileNotFoundError(f"nothing is published under {base}")


def load(spark: SparkSession, base: str, expect: dict | None = None) -> dict[str, DataFrame]:
    """The tables of the newest generation. Meta data that differ from what is expected, such as a tokenizer's version, are refused."""
    at = latest(spark, base)
    meta = json.loads(spark.read.text(f"{at}/{_META}", wholetext=True).first()[0])
    for k, v in (expect or {}).items():
        if meta.get(k) != v:
            raise ValueError(f"{k} is {meta.get(k)!r}, not {v!r}")
    return {name: spark.read.parquet(f"{at}/{name}") for name in meta["tables"]}


def append_events(events: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    events.write.mode("append").option("ignoreNullFields", False).json(path)


def fold_events(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of every key. Rows without a key are skipped."""
    rest = [c for c in events.columns if c != key]
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e")).select(key, "_e.*")


def squad_items(records: DataFrame, lang: str = "uk", provenance: str = "public-reused") -> DataFrame:
    """Gold items of SQuAD records (title, paragraphs of context and qas of id, question, answers of text and answer_start).

    The first answer that is not empty and stands in its context is the answer, where the record says or else where it first stands;
    questions without one are left out.
    """
    p = records.select("title", F.explode("paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    good = F.filter("q.answers", lambda a: (F.length(a["text"]) > 0) & F.position(a["text"], F.col("context")).cast("boolean"))
    rows = p.select("title", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"), F.get(good, F.lit(0)).alias("a")).where("a is not null")
    said = F.substring("context", F.col("a.answer_start") + 1, F.length("a.text")) == F.col("a.text")
    start = F.when(said, F.col("a.answer_start")).otherwise(F.position(F.col("a.text"), F.col("context")) - 1)
    return rows.select("id", F.lit(lang).alias("lang"), "question", F.col("a.text").alias("reference_answer"), F.col("title").alias("source_doc_id"), start.alias("char_start"), (start + F.length("a.text")).alias("char_end"), F.lit(provenance).alias("provenance"))


def map_sources(rows: DataFrame, keys: list[str], mapping: DataFrame, names: list[str], target: str) -> DataFrame:
    """``rows`` with ``target`` from the first of ``keys`` that the mapping knows under the name beside it (id, url, title); else null."""
    out = rows
    for i, (k, n) in enumerate(zip(keys, names)):
        one = mapping.where(F.col(n).isNotNull()).groupBy(F.col(n).alias(f"_k{i}")).agg(F.min(target).alias(f"_t{i}"))
        out = out.join(one, out[k] == one[f"_k{i}"], "left").drop(f"_k{i}")
    return out.withColumn(target, F.coalesce(*[F.col(f"_t{i}") for i in range(len(keys))])).drop(*[f"_t{i}" for i in range(len(keys))])
