"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

WORK_DIR_SETTING = "spark.checkpoint.dir"
#: Work folders by application, until they are released.
_MADE: dict[str, list[str]] = {}


def local_session(
    name: str = "leaselake", cores: str = "8", shuffle_partitions: int = 8, work_dir: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder
    if work_dir:
        builder = builder.config(WORK_DIR_SETTING, work_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared folder the session names, never used twice.

    Without ``spark.checkpoint.dir`` the folder lies in the warehouse, which is shared too.
    """
    shared = spark.conf.get(WORK_DIR_SETTING, None) or spark.sparkContext.getConf().get(WORK_DIR_SETTING)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    folder = f"{shared.rstrip('/')}/leaselake-{purpose}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def release_work(spark: SparkSession) -> int:
    """Delete the work folders this process made for the session's application; their number.

    Tables read from them are gone afterwards, so call it when all results are written.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once and read back: cuts the lineage, and later readers skip the work."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
