"""Session set-up and the shared work folder."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import importlib.util
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

CLUSTER_CONF = {
    # Runtime re-planning: broadcast only below a measured size, split skewed join
    # partitions, merge small shuffle partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Column expressions here are long; do not record a Python stack for each part of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shuffle_conf(input_bytes: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle settings for jobs over ``input_bytes``: enough partitions that one fits in a
    task's memory; AQE merges those that turn out small."""
    partitions = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def build_session(master: str | None = None, app_name: str = "tuneframe", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local session without that setting falls back to a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tuneframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_folders: list[str] = []


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; concurrent runs never meet."""
    folder = f"{shared_folder(spark)}/tuneframe/{name}-{uuid.uuid4().hex}"
    _folders.append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession):
    """Remove the run folders that are made inside, when it ends. Results have to be written or read before.

    A local session's own temporary folder goes with the process; a cluster's shared folder keeps what
    was made outside of this.
    """
    start = len(_folders)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _folders[start:]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        del _folders[start:]


def written(df, name: str):
    """Cut lineage through a written table in the shared folder and read it back."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files of steps that are done stay on the executors' disks until it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(held: int = 0) -> None:
    """Return this process's freed memory to the system, which the allocators keep otherwise; nothing is done where the process
    is known to hold less than ``held`` bytes."""
    if held and os.path.exists("/proc/self/statm"):
        with open("/proc/self/statm") as now:
            if int(now.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") < held:
                return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run):
    """A function for ``mapInArrow`` that gives freed memory back when its task ends: workers wait for the next task beside an
    executor that needs room for steps without Python."""

    @functools.wraps(run)
    def ending(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return ending


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers when it is run from a checkout.

    Not needed where it is installed on the executors or passed with ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, "_tuneframe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(importlib.util.find_spec("tuneframe").origin))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tuneframe"), "zip", root, "tuneframe")
    context.addPyFile(archive)
    context._tuneframe_shipped = True
