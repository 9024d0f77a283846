"""Sessions, and tables written to the folder all executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folio")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs in this one process, as in tests, a temporary folder, which is then set. Any cluster, a local one too, must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="folio-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written_path(df: DataFrame, name: str = "step") -> str:
    """Where df was written, in the shared folder."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and survives the loss of executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, name))


#: Tables written by this process, by the application they belong to.
_WRITTEN: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> int:
    """Deletes what written() has made so far; results that still read it must be done. Returns how many tables there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def replaced(df: DataFrame, new: DataFrame) -> DataFrame:
    """new, once nothing reads df any more, a table that written() made: df is deleted, and the shuffles that nothing refers to are given up, so rounds don't pile up on the disks."""
    spark = new.sparkSession
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    old = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    gone = [p for p in known if os.path.basename(p) in old]
    _WRITTEN[spark.sparkContext.applicationId] = [p for p in known if p not in gone]
    _delete(spark, gone)
    tidied(spark)
    return new


def tidied(spark: SparkSession) -> None:
    """Gives up the shuffles that nothing refers to any more; waits, for a short time, until the cleaner is through with those it has found."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    known = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    left, same = known.size(), 0
    for _ in range(20):
        time.sleep(0.1)
        before, left = left, known.size()
        same = same + 1 if left == before else 0
        if same == 3:
            break


def importable(spark: SparkSession) -> SparkSession:
    """The session, its Python workers told where this package lies, whatever folder they start in. Elsewhere than on shared disks, give it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
