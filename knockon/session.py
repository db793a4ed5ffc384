"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: stage
boundaries are Parquet tables and checkpoints in the shared folder named by
``spark.checkpoint.dir``.  Only a local master may do without that setting; a
cluster without it is an error.
"""

from __future__ import annotations

import os
import shutil
import site
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Spark setting: an execution's shuffle files are removed when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark setting: stages whose generated method is larger run by operator.  The JVM does not compile methods
#: beyond 8,000 bytes of bytecode; a stage with one is interpreted for every row.
METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def get_spark(app: str = "knockon", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE (coalescing + skew-join splitting) and no UI server."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(METHOD_LIMIT, COMPILED_BYTES)
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster checkpoint folder; set a local one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="knockon-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ensure_compiled(spark: SparkSession) -> None:
    """Sessions made elsewhere get ``METHOD_LIMIT`` too, unless they set one of their own."""
    if not spark.sparkContext.getConf().contains(METHOD_LIMIT):
        spark.conf.set(METHOD_LIMIT, COMPILED_BYTES)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/knockon-tables/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage", row_group: int | None = None):
    """Cut lineage: write a Parquet table into the shared folder and read it back.

    For stage boundaries that several branches or passes read.  Later readers
    prune columns and push filters down, and lost executors reread files.  The
    shuffle files of the write go when it has ended: nothing reads them again.
    ``row_group``: bytes of a row group, which writers and readers hold in memory as a
    whole; by default Parquet's 128 MB.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    try:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        (df.write if row_group is None else df.write.option("parquet.block.size", str(row_group))).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed.

    Python steps import it there; Spark serves the archive to every executor.
    """
    base = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="knockon-pkg-"), "knockon"), "zip",
                                  base, "knockon")
    spark.sparkContext.addPyFile(archive)


_shipped: set[str] = set()


def ship_once(spark: SparkSession) -> None:
    """``ship_package`` once per application, unless Python workers find the package where it is.

    They look in the installed packages, in PYTHONPATH, and (on a local master) in
    the folder that the driver was started in.
    """
    base = os.path.realpath(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    if spark.sparkContext.master.startswith("local["):
        known.append(os.getcwd())
    app = spark.sparkContext.applicationId
    if app not in _shipped and base not in {os.path.realpath(p) for p in known if p}:
        ship_package(spark)
    _shipped.add(app)
