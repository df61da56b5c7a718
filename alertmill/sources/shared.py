"""Tables in the folder that the driver and all executors share, to cut lineages and to keep state."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of such a table: bounds what a writing task holds.
ROW_GROUP = 32 << 20
#: Paths written inside scratch().
_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a folder of our own on a single machine, as in tests; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder, which outlives lost executors. Inside scratch() it is deleted at the end."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As written(), with all rows of a key in one of P buckets (P: shuffle partitions), which Spark knows of: groups, windows and joins by the key read it without a shuffle."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path, parts = f"{shared_folder(spark)}/{table}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    rows = df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    rows.bucketBy(parts, key).option("path", path).saveAsTable(table)
    return spark.table(table)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For jobs that write their results themselves: deletes the tables that written() made inside, once they are not read any more."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
