"""Session helpers: table loading, shared checkpoints and shipping the package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session takes a temporary one; on a cluster, whose
    executors wouldn't see the driver's, that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark context, so that nothing need be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrylight_shipped", False):
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quarrylight-")), "quarrylight.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, names in os.walk(ROOT):
            for x in names:
                if x.endswith(".py"):
                    path = os.path.join(d, x)
                    z.write(path, os.path.relpath(path, os.path.dirname(ROOT)))
    sc.addPyFile(target)
    sc._quarrylight_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if a small input came in fewer. A large one is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
