"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir


BATCH_BYTES = 8 << 20
#: Keys (tens of bytes each) up to so many are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read by Spark alone (the folder may be in any store Spark knows)."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Whole texts may be long: batches for Python workers hold BATCH_BYTES at most (a smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, None)).strip().lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors
    see. The JVM deletes it when the session's process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table: later jobs
    read files that outlive any executor instead of computing the rows again."""
    path = f"{shared_folder(df.sparkSession, tag)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` characters together, 256 texts at most."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit or i - begin >= 255:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def without(docs: DataFrame, gone: DataFrame, by_text: bool = False) -> DataFrame:
    """The rows of ``docs`` whose doc_id (and text, if ``by_text``: ``gone`` then has its hash as
    ``key``) is not in ``gone``; all columns stay as they are."""
    gone = stored(gone.select(F.col("doc_id").alias("gone_id"), *([F.col("key").alias("gone_key")] if by_text else [])).distinct(), "gone")
    n = gone.count()
    match = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"])
    if by_text:
        match = match & (F.xxhash64(docs["text"]) == gone["gone_key"])
    return docs.join(F.broadcast(gone) if n <= BROADCAST_KEYS else gone, match, "left_anti")
