"""Session helpers: a tuned local session for tests, and the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqdrift")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables, below the folder the cluster names.

    `spark.checkpoint.dir` names storage that all executors reach and that outlives them. Only where
    it is unset, as in local tests, a temporary folder stands in, and the session remembers it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("seqdrift.localDir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="seqdrift-")
        spark.conf.set("seqdrift.localDir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, purpose: str, by: str | None = None, **options: str) -> DataFrame:
    """Writes a result to the shared folder and reads it back.

    For small results that several later steps use: they are computed once, survive lost executors, keep
    their values in every use, and Spark knows their size when it plans joins.
    `options` go to the writer.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    writer = df.write.options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_together(*results: tuple[DataFrame, str]) -> list[DataFrame]:
    """`settled` for several independent results, as jobs that run side by side."""
    with ThreadPoolExecutor(max_workers=len(results)) as pool:
        return list(pool.map(lambda r: settled(*r), results))


def shipped(spark: SparkSession) -> None:
    """Hands this package to the executors' Python, once a session, where the job was not submitted with it."""
    context = spark.sparkContext
    if getattr(context, "_seqdrift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="seqdrift-code-")) / "seqdrift.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._seqdrift_shipped = True
