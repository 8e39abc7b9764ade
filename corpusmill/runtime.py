"""Session-level helpers: table loading, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast once its size has been measured.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Bytes of a table that may be spread over the cores before costly work.
WIDE_BYTES = 1 << 30


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, once a session, also where it is not installed on the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusmill-src-")) / "corpusmill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(str(archive))
    sc._corpusmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """One of the test tables as a DataFrame.

    With ``wide`` a table whose scan has fewer tasks than there are cores, as a single small file has, is spread over
    all of them before costly work on its rows; a scan with enough tasks, and any table of more than ``WIDE_BYTES``, is
    left as it is, so what this shuffles is bounded on any cluster.
    """
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if wide:
        cores = spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size <= WIDE_BYTES and df.rdd.getNumPartitions() * 2 <= cores:
            return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only.

    A cluster session without the setting is an error: a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        path = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a durable lineage cut.

    The result survives lost executors and is columnar, so later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if not hasattr(sc, "_corpusmill_written"):
        sc._corpusmill_written = []
        atexit.register(_discard_at_end, spark)
    sc._corpusmill_written.append(path)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_written(spark: SparkSession) -> None:
    """Delete the tables written so far, once the results that read them are saved; also done when Python ends."""
    sc = spark.sparkContext
    paths = getattr(sc, "_corpusmill_written", [])
    if sc._jsc is None:  # the session has ended before
        return
    while paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _discard_at_end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        discard_written(spark)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured ``rows`` times ``row_bytes`` stay under ``limit``."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def default_parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, never below the cores at hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, 1)


def local_session(cpus: int | str = "*", app: str = "corpusmill") -> SparkSession:
    """A local session with the settings the tests and the bench use, the package shipped to its workers."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    ship_package(spark)
    return spark
