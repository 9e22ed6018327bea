"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: list[str] = []
#: Bounds of an Arrow batch whose rows carry whole texts; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves a session on one machine (``local[...]``, as in tests); on a cluster
    each executor would write to a disk of its own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _LOCAL_SHARED:
            _LOCAL_SHARED.append(tempfile.mkdtemp(prefix="factloom-"))
        folder = _LOCAL_SHARED[0]
    return folder


@contextlib.contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Within, the session has these settings (dots written as __); afterwards what it had before."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written_tables(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> contextlib.AbstractContextManager[None]:
    """Within, Arrow batches hold ``rows`` rows and some ``size`` bytes at most, and Spark deletes a query's shuffle files when
    the query ends, not when the driver next collects its garbage."""
    return settings(
        spark,
        spark__sql__execution__arrow__maxRecordsPerBatch=str(rows),
        spark__sql__execution__arrow__maxBytesPerBatch=str(size),
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
    )


def materialize(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` as a table written in the shared folder: its lineage ends here, and losing an executor loses none of it.

    Python functions in ``df`` get batches of at most ``rows`` rows and BATCH_BYTES bytes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom-{uuid.uuid4().hex}"
    with written_tables(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_share(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, or all if there are fewer: those whose key's hash falls in a share of its range.

    What a later limit() takes from each task is then bounded over all tasks together.
    """
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
