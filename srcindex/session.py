"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "srcindex") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be a shared file
    system. Only when it is unset on a local master (tests) a private folder is
    created and registered, so later calls agree on it; elsewhere this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} can read and write")
        root = tempfile.mkdtemp(prefix="srcindex-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique location under the checkpoint root for written stages."""
    return f"{checkpoint_root(spark)}/srcindex/{label}-{uuid.uuid4().hex[:12]}"


def local_dir(path: str) -> str | None:
    """Return the POSIX path behind ``path`` if it is on a mounted file system."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
        return path
    if "://" in path:
        return None
    return os.path.abspath(path)


def spread(df, *keys: str, min_partitions: int | None = None):
    """Hash-partition ``df`` on ``keys`` when it has fewer partitions than cores.

    Small single-row-group inputs otherwise run CPU-heavy steps (tokenizing,
    hashing, parsing) in one task. Inputs already split wider than the
    cluster's parallelism are returned untouched, so at scale this is a no-op.
    """
    sc = df.sparkSession.sparkContext
    target = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


def stage(df, label: str = "stage", how: str = "parquet"):
    """Cut lineage where a costly intermediate feeds several branches.

    ``how="parquet"`` (default) writes a table under the shared checkpoint
    folder and reads it back: later branches read only the columns they use
    and the planner sees real statistics. ``how="checkpoint"`` uses a
    reliable RDD checkpoint in the same folder. Either way, lost executors
    re-read files instead of recomputing the lineage.
    """
    spark = df.sparkSession
    if how == "checkpoint":
        checkpoint_root(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Most bytes that Spark hands a Python worker at once, beside a single longer row. Else a batch is 10,000 rows,
#: which whole texts make 60 MB and more, held by the JVM and by the worker.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Make ``srcindex`` importable in every executor's Python workers, and bound the batches they get.

    A session's own bound on batches (``ARROW_BYTES``) stays.

    UDTFs, Arrow kernels and the data source are pickled by reference to this
    package; executors need it on their path whatever the driver's working
    directory. The package's ``.py`` files are zipped once per application and
    handed to ``SparkContext.addPyFile``, which serves them to the executors.
    """
    import zipfile

    import srcindex

    if spark.conf.get(ARROW_BYTES[0], None) is None:
        spark.conf.set(*ARROW_BYTES)
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(srcindex.__file__))
    base = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="srcindex-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _SHIPPED.add(app)
