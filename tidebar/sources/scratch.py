"""Tables that are worked out once and read again, in the folder that all machines share: spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go. Where spark.checkpoint.dir is unset, a temporary folder of this machine serves a local master, and any other is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError(f"spark.checkpoint.dir is not set; on {context.master} it must name a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint: cuts lineage, survives lost executors, and is cleared by Spark (where spark.cleaner.referenceTracking.cleanCheckpoints is set) when nothing refers to it any longer."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Paths of prepared tables, and their schemas.
_KEPT: dict[tuple[str, ...], str] = {}
_SCHEMAS: dict[str, StructType] = {}


def prepared(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """What make derives from source, as a Parquet table that is written once in this application: partitioned by by, and sorted by time inside months (which are dealt out one by one, so that a hot symbol is many tasks), so that later scans prune partitions, columns and row groups. Anew if it is gone."""
    key = (spark.sparkContext.applicationId, name, source)
    path = _KEPT.get(key)
    if path is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return _read(spark, path)
    df = make()
    path = f"{shared_folder(spark)}/tidebar-{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:
        df.repartition(by, F.date_trunc("month", F.col("ts").cast("timestamp"))).sortWithinPartitions(by, "ts").write.partitionBy(by).parquet(path)
    _KEPT[key] = path
    _SCHEMAS[path] = df.schema
    return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = _SCHEMAS[path]
    return spark.read.schema(schema).parquet(path).select(*schema.names)
