"""Windowed aggregation as a stream over a table of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..staging import shared_dir


def _is_folder(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def windowed_counts(spark: SparkSession, path: str, ts: str, width: str, key: str, value: str, late: str = "7 days", files_at_once: int = 1000) -> DataFrame:
    """``start`` (as text), ``key, n, total`` per window, computed by a stream over the files of ``path`` until all are read.

    Windows whose end the watermark has passed leave the state; rows that come more than ``late`` after the latest row of an
    earlier batch are dropped. A batch writes the windows it changed, under its number in the shared folder beside the stream's
    checkpoint, so that a restarted stream goes on and a repeated batch overwrites itself; the last batch of a window holds.
    """
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    folder, glob = (path, "*.parquet") if _is_folder(spark, path) else path.rsplit("/", 1)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))  # an event time has an instant; the session's zone is the table's
    counted = rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    flat = counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), key, "n", F.round("total", 4).alias("total"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/result/batch={epoch}")

    query = flat.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.schema(StructType([*flat.schema.fields, StructField("epoch", IntegerType())])).parquet(f"{out}/result")
    return last.groupBy("start", key).agg(F.max_by(F.struct("n", "total"), "epoch").alias("r")).select("start", key, "r.n", "r.total")
