"""Tables that cut a plan's lineage and outlive an executor."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets one below its warehouse; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared").rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def changed(spark: SparkSession, path: str) -> int:
    """When a file or folder was last written."""
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


#: Whether Spark removes the files of a query's shuffles when the query ends, and not only when the driver happens to collect garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: the table holds the rows, and nothing reads its shuffles again."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of df, written to the shared folder and read back, and where they are, for remove()."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt by keys as kept_by() deals them, so that it need not deal them again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kept_by(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, str, str]:
    """As kept(), bucketed by keys, a file a bucket, with order within it: what joins on just these keys is dealt to the buckets
    and the table itself is not dealt out again. Also the table's name, for forget()."""
    spark, name = df.sparkSession, f"subgrove_{uuid.uuid4().hex}"
    path, n = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with cleaned(spark):
        dealt(df, keys).write.format("parquet").bucketBy(n, *keys).sortBy(*order).option("path", path).saveAsTable(name)
    return spark.table(name), path, name


def forget(spark: SparkSession, name: str) -> None:
    """Takes the name of a bucketed table out of the catalog."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


#: Rows up to which a table from the driver is sent to every task; beyond, Spark decides.
SENT = 50_000


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver (what patterns need) as a table to be joined to larger ones."""
    kind = StructType.fromDDL(schema)
    out = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], to_arrow_schema(kind)), kind)
    return F.broadcast(out) if len(rows) <= SENT else out


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a written table, so that what refers to them refers to a scan."""
    return kept(df)[0]
