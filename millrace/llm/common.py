"""What the operators share: reading tables and passing stages through the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from millrace.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python where rows hold whole texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH_BYTES in this session, for queries whose rows are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_open_scopes: list[list[str]] = []


def stored(df: DataFrame, what: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and lost executors don't matter.
    Inside scratch() the table goes with it, unless keep is set. codec: of the Parquet files, else the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    if _open_scopes and not keep:
        _open_scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that stored() wrote in it."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs whose results are written and that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, name)
