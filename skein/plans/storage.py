"""Tables in the shared folder that cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a session whose master is this machine may leave it unset and gets a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        named = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="skein-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skein-{uuid.uuid4().hex[:16]}-{label}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and no partitioning is claimed."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def save_counting(df: DataFrame, label: str, what: Column) -> tuple[DataFrame, int]:
    """:func:`save`, and the number of rows for which ``what`` is true, counted in the same job."""
    seen = Observation()
    out = save(df.observe(seen, F.count_if(what).alias("n"), F.count(F.lit(1)).alias("rows")), label)
    return out, seen.get["n"]


def in_session(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A table made by :func:`save`, read in another session."""
    out = spark.read.schema(table.schema).parquet(table._skein_path)
    out._skein_path = table._skein_path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_skein_path", None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
