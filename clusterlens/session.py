"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Settings that change results (time zone) or let Spark re-plan; safe on a shared session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local(cores: int | str = 8, app: str = "clusterlens") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str | None:
    """Folder all executors reach, as the session names it; local sessions without one get a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and spark.sparkContext.master.startswith("local"):
        root = _local_folder()
    return root


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="clusterlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _run_folder(spark: SparkSession) -> str:
    root = shared_folder(spark)
    if root is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.rstrip('/')}/clusterlens/{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write an expensive intermediate once to the shared folder and read it back.

    Operators that look at their input several times then scan a pruned columnar table instead of
    parsing raw text again, and a lost executor costs no recomputation. All tables of a run lie in one
    folder named after the application; `clear_staged` removes it. A cluster session must name the folder.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A name below the folder of this run, for files in a form of their own; `clear_staged` removes them too."""
    return f"{_run_folder(spark)}/{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all tables this application has staged, once no result is read from them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
