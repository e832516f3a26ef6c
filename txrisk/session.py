"""Session factory and the shared work folder.

``materialize`` is the only place where lineage is cut. It writes a table to the
folder named by ``spark.checkpoint.dir`` and reads it back, so the data survives
the loss of executors, later readers prune its columns, and Catalyst knows its
true size when it decides whether a join side may be broadcast.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from threading import Lock
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Report texts are long expressions; beyond this size HotSpot would interpret
    # a fused stage, so Spark is told to generate split functions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    name: str = "txrisk",
    master: str | None = None,
    driver_memory: str | None = None,
    log_level: str = "WARN",
    **extra: str,
) -> SparkSession:
    """Create or get a session. Shuffle sizes are left to adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in {**_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder of ``spark.checkpoint.dir``. A session on one machine that sets none
    uses a folder inside its warehouse. On a cluster there must be one: a default warehouse
    is a folder of the driver's machine, which executors do not see.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/txrisk/{label}-{uuid.uuid4().hex}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING, _BEFORE, _LOCK = Counter(), {}, Lock()


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a finished query of the session leaves no shuffled files; several threads may be inside."""
    key = spark._jsparkSession.hashCode()
    with _LOCK:
        if not _WRITING[key]:
            _BEFORE[key] = spark.conf.get(_FREE, "false")
            spark.conf.set(_FREE, "true")
        _WRITING[key] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[key] -= 1
            if not _WRITING[key]:
                spark.conf.set(_FREE, _BEFORE.pop(key))


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the work folder and return the written table. What the write shuffled goes with it."""
    spark = df.sparkSession
    target = path or new_path(spark, label)
    with _freed(spark):
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


_SHIPPED: WeakSet = WeakSet()


def ship_modules(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for a Spark context, from the work folder.

    A job started with ``--py-files`` has it already; then this does no harm.
    """
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    top, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    target = new_path(spark, "modules") + ".zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(target)
    _SHIPPED.add(context)
