"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

# Settings every job of the engine relies on.  AQE re-plans joins from runtime
# sizes and splits skewed shuffle partitions; UTC keeps date/hour derivations
# independent of the machine; Arrow is the transport for the pandas kernels.
_ENGINE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of unreferenced data are removed by the context cleaner.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    app: str = "sendero",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _ENGINE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``sendero`` importable in the Python workers of this application
    (what ``--py-files`` does): the package is zipped once on the driver and
    added with ``addPyFile``, so tasks find it whatever the executors have
    installed and whatever the driver's working directory is."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    with _SHIP_LOCK:
        if app in _SHIPPED:
            return
        import zipfile

        import sendero

        pkg = os.path.dirname(os.path.abspath(sendero.__file__))
        root = os.path.dirname(pkg)
        target = os.path.join(tempfile.mkdtemp(prefix="sendero-pkg-"), "sendero.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, _, files in os.walk(pkg):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(dirpath, name)
                        z.write(full, os.path.relpath(full, root))
        try:
            sc.addPyFile(target)
        except Exception as exc:  # noqa: BLE001
            # Already registered for this application (e.g. by another copy of
            # this module): the workers can import the package either way.
            if "already registered" not in str(exc):
                raise
        _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment to a shared file system and is
    only read here.  When it is unset a private folder is made, for a local
    master alone: on a cluster each executor would write to its own disk.
    """
    ship_package(spark)
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="sendero-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table location under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def write_all(tables: dict) -> dict:
    """``write_once`` for several tables, side by side: small jobs share the
    cluster instead of waiting for one another."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max(len(tables), 1)) as pool:
        jobs = {name: pool.submit(write_once, df, name) for name, df in tables.items()}
        return {name: job.result() for name, job in jobs.items()}


def spread(df):
    """A written table over all task slots: one with fewer partitions than
    slots (so a small one) is dealt out anew, a larger one stays as it is."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def write_once(df, name: str):
    """Write a derived table to the shared folder and read it back, so that
    every consumer reads the columns it needs instead of planning it anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def drop_written(df) -> None:
    """Delete a table of ``write_once`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
