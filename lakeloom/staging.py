"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A staged table cuts the lineage and survives the loss of executors, since it is an ordinary Parquet
table in shared storage. Unlike ``DataFrame.checkpoint`` it is columnar and compressed, so reading a
few of its columns is cheap. A machine-local folder is used only where the setting is absent and Spark
runs in local mode, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_created: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set(_SETTING, found)
        _created.append((spark, found))
    return found.rstrip("/")


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back from there.

    With ``release``, the shuffle files of the write are deleted as soon as it is done. Else they stay until
    the driver happens to collect its garbage, so that those of several writes may lie on disk at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release and before is None:
            spark.conf.unset(_RELEASE)
        elif release:
            spark.conf.set(_RELEASE, before)
    _created.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clear() -> None:
    """Delete the staged tables of this process; no frame that reads them may be used afterwards."""
    while _created:
        spark, path = _created.pop()
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
            pass
