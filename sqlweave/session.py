"""Spark session defaults and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "sqlweave",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for these jobs; an existing active session is reused.

    AQE is on so join strategy, partition coalescing and skew splitting are
    decided from runtime statistics. The UI is off (no server is opened).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("SQLWEAVE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SQLWEAVE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder and is used
    as is. Only a local-mode session without the setting (tests, the bench) gets
    a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for cluster runs")
    path = tempfile.mkdtemp(prefix="sqlweave-ckpt-")
    sc.setCheckpointDir(path)
    return path


FEW_ROWS, MANY_ROWS = 64, 100_000  # of a partition of a checkpoint: worth a task; the most where there are many


def materialize(df, label: str = "t"):
    """Cut lineage with a reliable checkpoint, computing the plan only once.

    An eager ``checkpoint()`` of an uncached plan computes it twice (one pass
    to count, one to write). Here the rows are written to the shared folder first and
    the checkpoint is made from that; a cache instead would keep a partition per
    shuffle task, each of which ran twice. The copy survives
    executor loss; ``label`` only names the call site. Small tables are held
    in as few partitions as their rows need.
    """
    held = write_table(df, label)
    rows, tasks = held.count(), df.sparkSession.sparkContext.defaultParallelism
    # a few rows in as many partitions as a shuffle has would cost every reader that many tasks
    parts = max(1, min(tasks, -(-rows // FEW_ROWS)), -(-rows // MANY_ROWS))
    out = held.coalesce(parts).checkpoint(eager=True)
    drop_table(held)
    return out


def scratch_path(spark: SparkSession, label: str = "t") -> str:
    """A fresh folder name under ``spark.checkpoint.dir`` (shared by driver and executors)."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sqlweave/{label}-{uuid.uuid4().hex}"


def write_table(df, label: str = "t"):
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage like a checkpoint, computes the plan once, keeps column
    pruning for the readers, and survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_table(df) -> None:
    """Delete the files behind a table made by ``write_table`` once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (for Arrow functions).

    Without it a worker can import the package only where the driver's path
    happens to be set on every machine.
    """
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="sqlweave-pkg-"), "sqlweave_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("sqlweave", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
