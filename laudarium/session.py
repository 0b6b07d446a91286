"""Session set-up and the few helpers that touch shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "laudarium", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where it is unset, as in tests, a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="laudarium-")
        spark.sparkContext.setCheckpointDir(folder) if not found.isDefined() else None
    return folder.rstrip("/")


_made: list[str] = []


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that written() made in this process; call it when their results have been saved."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing is written to yet; drop_written() deletes it."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each context.

    A local session whose workers find it anyway (the current folder or PYTHONPATH holds it) is left alone.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_laudarium_shipped", False):
        return
    context._laudarium_shipped = True
    seen = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if context.master.startswith("local[") and package.parent in seen or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="laudarium-")) / "laudarium.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
