"""Written intermediate tables, size-checked broadcasts and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast, as counted rows times the width of their columns; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes that a value takes: numbers with their share of a hash table, and what texts of this package's tables are at most.
_WIDTH, _TEXT_WIDTH = 8, 96


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of this machine serves a local master, and any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all machines share")
        base = getattr(spark.sparkContext, "_tidebar_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext._tidebar_scratch = base
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path there, with its scheme, so that tasks that open files themselves find the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidebar-{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Paths of the tables written inside the innermost open scope of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession, keep: list[DataFrame] | None = None) -> Iterator[list[str]]:
    """Tables written inside are deleted at its end, but for those that were added to keep: use it where only these are read later. Without keep all stay, and their paths are given."""
    outer, paths = _SCOPE.get(), []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)
        if keep is not None:
            kept = {df._tidebar_path for df in keep}
            delete(spark, [p for p in paths if p not in kept])
            paths[:] = [p for p in paths if p in kept]
        if outer is not None:
            outer += paths


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Settings under which tables are written: shuffle files go at a query's end, as the table is what is read from then on; and
#: batches sent to Python are of bounded size, whatever the texts.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _settings(spark):
        df.write.parquet(path)
    paths = _SCOPE.get()
    if paths is not None:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidebar_path = path
    return out


def width(df: DataFrame) -> int:
    """Bytes of a row in a broadcast table: of its columns, and of the table's own pointers."""
    return 8 + sum(_WIDTH if f.dataType.simpleString() in ("bigint", "int", "double", "boolean", "date", "timestamp") else _TEXT_WIDTH for f in df.schema.fields)


def small(df: DataFrame, most: int = BROADCAST_BYTES, beside: Column | None = None) -> DataFrame:
    """df (already written, of few columns, texts of which are keys or names) with a broadcast hint where its counted rows are within the bound; else as it is, to be shuffled. beside: bytes of a row's arrays, which are summed."""
    if beside is None:
        return F.broadcast(df) if df.count() * width(df) <= most else df
    n, more = df.agg(F.count("*"), F.coalesce(F.sum(beside), F.lit(0))).first()
    return F.broadcast(df) if n * width(df) + more <= most else df


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """How many partitions keep each at about rows_each, and no fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
