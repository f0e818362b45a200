"""Session helpers: building a local session and shipping this package to executors."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = 8, name: str = "litsieve", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors once per application.

    Arrow functions are pickled by reference, so each Python worker has to be able to import the package. The archive is
    a few hundred kB and travels by Spark's own file distribution.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="litsieve-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(Path(root.name) / source.relative_to(root)))
    spark.sparkContext.addPyFile(path)  # copied to where executors fetch it from
    atexit.register(Path(path).unlink, missing_ok=True)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="litsieve-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/litsieve-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any of Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file; False if it is there already. Of several drivers that try, one succeeds where the store can tell."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = system.create(at, False)
    except Py4JJavaError as error:
        if system.exists(at):
            return False
        raise error
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished rounds: it does so when the driver has collected the frames they belong to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and outlives executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._litsieve_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table made by write_table once nothing reads it any more."""
    remove(df.sparkSession, df._litsieve_path)
