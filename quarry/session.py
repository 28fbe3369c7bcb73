"""Session construction and lineage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every quarry job relies on. AQE re-plans joins from measured sizes
# and splits skewed shuffle partitions; UTC keeps timestamp_ntz comparisons
# stable against the DuckDB oracle.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry") -> SparkSession:
    """Return (or create) a session configured for quarry.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submitter. Only a local session gets a memory setting here, and a scratch
    checkpoint directory when it needs one and none is configured.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if (master or "").startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Where none is configured, a local session
    gets a scratch folder (removed when the process ends); any other master is refused, as
    its executors could not see the driver's own folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


#: For checkpoints in a folder of a local file system: Hadoop's plain one. Its default one writes a second file of checksums, and for
#: each of both starts a process to set its mode; until that runs its program it has the executor's whole memory, which then counts twice.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_local_files, _local_files_held = threading.Lock(), {"users": 0, "before": {}}


@contextmanager
def local_files(spark: SparkSession) -> Iterator[None]:
    """``LOCAL_FILES`` hold while any thread is in here; then what held before."""
    conf, held = spark.sparkContext._jsc.hadoopConfiguration(), _local_files_held
    with _local_files:
        if not held["users"]:
            held["before"] = {k: conf.get(k) for k in LOCAL_FILES}
            for k, v in LOCAL_FILES.items():
                conf.set(k, v)
        held["users"] += 1
    try:
        yield
    finally:
        with _local_files:
            held["users"] -= 1
            for k, v in ({} if held["users"] else held["before"]).items():
                conf.unset(k) if v is None else conf.set(k, v)


def materialize(df: DataFrame, reliable: bool = True) -> DataFrame:
    """Cut lineage before a frame is reused by several actions.

    ``reliable=True`` writes a checkpoint into the shared checkpoint directory
    (survives executor loss); otherwise the frame is persisted memory-and-disk,
    which is only safe when a recomputation yields the same rows.
    """
    if reliable:
        ensure_checkpoint_dir(df.sparkSession)
        with local_files(df.sparkSession):
            return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def on_disk(df: DataFrame) -> DataFrame:
    """Rows that a few steps read until the next frame is there, which then takes ``unpersist()``: in Spark's cache on the executors'
    disks, by column and compressed, without files of Hadoop's. A lost part is computed again, so
    this is for rows that come out the same again."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()  # in one job, before several stages ask for it side by side
    return df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import its functions; done
    once for each Spark context (a submitter may have sent it already, which does no harm)."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quarry-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._quarry_shipped = True
