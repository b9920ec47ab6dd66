"""Spark session construction and shared-folder settings."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # numpy inside tasks does many small products; threads only slow them down
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "quarry", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that
    Python functions find it whatever path the workers start with."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quarry-package-"), "quarry_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts and index tables, read
    from ``spark.checkpoint.dir``.

    Only where that is unset and the session is local (one machine, as in
    tests) a fresh folder is created and set; on a cluster it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``)."""
    return master == "local" or master.startswith("local[")


def table_path(spark: SparkSession, *parts: str) -> str:
    return os.path.join(shared_dir(spark), *parts)


def stage_root(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return table_path(spark, "stages", spark.sparkContext.applicationId)


BATCH_BYTES = 8 << 20    # a few thousand documents with their terms
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, most: int | None):
    """In jobs that run inside, Spark hands Python batches of ``most`` bytes at
    most (64 MB otherwise, which a task holds several times); None: as set."""
    was = spark.conf.get(BATCH_KEY, None)
    if most:
        spark.conf.set(BATCH_KEY, str(most))
    try:
        yield
    finally:
        if most:
            spark.conf.set(BATCH_KEY, was) if was else spark.conf.unset(BATCH_KEY)


def materialize(df, label: str, batch_bytes: int | None = None, **options):
    """Write ``df`` once as parquet under the shared folder and return the
    re-read table: the lineage is cut and the data survives executor loss
    (one job, unlike an eager checkpoint, which recomputes the last stage to
    write it). ``batch_bytes``: see :func:`batches_of`; ``options`` are the writer's. :func:`clear_stages` removes the
    tables of an application."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(stage_root(spark), f"{label}-{uuid.uuid4().hex}")
    with batches_of(spark, batch_bytes):
        df.write.mode("overwrite").options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Remove the intermediate tables and scratch folders of this application
    from the shared folder. Results that still read them must have been
    written or collected before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(conf).delete(path, True)
