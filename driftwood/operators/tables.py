"""Tables that a long computation writes on its way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files are deleted when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder, but only if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: tables on the way need a folder that driver and executors share")
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = tempfile.mkdtemp(prefix="driftwood-")
    return _local[name]


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def placed(df: DataFrame, form: str) -> str:
    """Where df lies, written in a form of Spark's; it goes when the application ends.

    What the writing shuffled goes with its end, as nothing reads it again; else a computation of many steps would keep the files of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.format(form).save(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table, read back: its lineage is cut, and lost executors lose nothing. It goes by dropped(), or when the application ends."""
    spark = df.sparkSession
    path = placed(df, "parquet")
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        deleted(df.sparkSession, df.written_to)


def deleted(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)
