"""Small helpers that the rest of the package builds on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    A local session without one gets a temporary folder, removed at the end; on a cluster that is an error, as each machine
    would write to its own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lexivec-")
        atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), True)
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, deleted when the driver ends: what rounds of a loop build on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexivec/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table as read, dealt out to all cores where its files have fewer parts than there are: for what is dear per row.

    Large tables have more parts than cores, and stay as they are; streams do too. scan: a plain read, as its plan is asked
    for its parts.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever the driver found it. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexivec_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexivec-ship-")) / "lexivec_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._lexivec_shipped = True
