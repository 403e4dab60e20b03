"""The session, tables, and the shared folder in which jobs cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The temporary folder of each local application that was given none; the setting itself can't be changed while an application runs.
_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can reach; where it is unset, a temporary one on a local master, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN_FOLDERS:
            own = tempfile.mkdtemp(prefix="tidewell-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN_FOLDERS[context.applicationId] = f"file://{own}"
        folder = _OWN_FOLDERS[context.applicationId]
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later steps survive lost executors.

    The files stay until the folder is cleaned, because lazily evaluated results may still read them; a folder of one's own goes at exit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
