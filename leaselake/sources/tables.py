"""Versioned Parquet tables, ordered views, JSON round trip (S13-S16, M1-M3 sink)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leaselake.operators.brackets import latest_version

VERSION_PREFIX = "v="


def _path(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions of a table, ascending; a version without its marker is ignored."""
    path, fs = _path(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith(VERSION_PREFIX) and _finished(spark, f"{root}/{name}"):
            found.append(int(name[len(VERSION_PREFIX):]))
    return sorted(found)


def _finished(spark: SparkSession, folder: str) -> bool:
    marker, fs = _path(spark, f"{folder}/_SUCCESS")
    return fs.exists(marker)


def save_version(df: DataFrame, root: str, version: int | None = None, partition_by: list[str] | None = None) -> int:
    """Write a table as a new version, so that it may be computed from the last one.

    A failed write leaves no marker and is never read; the next try writes over it.
    """
    spark = df.sparkSession
    if version is None:
        done = versions(spark, root)
        version = (done[-1] if done else 0) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{VERSION_PREFIX}{version}")
    return version


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The given or the newest finished version; None when there is none yet."""
    if version is None:
        done = versions(spark, root)
        if not done:
            return None
        version = done[-1]
    return spark.read.parquet(f"{root}/{VERSION_PREFIX}{version}")


# ---- ordered views ------------------------------------------------------------------
def portfolio_view(portfolio: DataFrame) -> DataFrame:
    """S13, Q3f: companies by lower-cased name, the key as tiebreak."""
    return portfolio.orderBy(F.lower("razao_social"), "cnpj")


def tax_version(brackets: DataFrame, version: str | None = None) -> DataFrame:
    """Brackets of one version, or of the latest, in order."""
    rows = latest_version(brackets) if version is None else brackets.where(F.col("version") == version)
    return rows.orderBy("lo")


def tax_versions(brackets: DataFrame) -> DataFrame:
    """All versions, ascending."""
    return brackets.orderBy("version", "lo")


def history_view(history: DataFrame) -> DataFrame:
    """Newest first, the hash as tiebreak."""
    return history.orderBy(F.desc("processed_at"), "file_hash")


def save_history(history: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 16 << 20) -> None:
    """A history for lookups by hash: files by ranges of the hash, sorted, with Bloom filters.

    Bounds of a row group rule out most groups and its Bloom filter nearly all that remain, so a lookup reads
    the footers and about one group. Hashes are random, so ranges are of even size.
    """
    spark = history.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    history.repartitionByRange(files, "file_hash").sortWithinPartitions("file_hash").write.option(
        "parquet.bloom.filter.enabled#file_hash", "true"
    ).option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", row_group_bytes).parquet(path)


def history_by_hash(history: DataFrame, file_hash: str) -> DataFrame:
    """Point lookup; the filter reaches the Parquet scan."""
    return history.where(F.col("file_hash") == file_hash)


# ---- JSON (S16) -----------------------------------------------------------------------
def _json_schema(schema: StructType) -> StructType:
    """The same record with decimals as text, so that no digit is lost."""
    text = schema.json()
    import json
    import re

    return StructType.fromJson(json.loads(re.sub(r'"decimal\(\d+,\d+\)"', '"string"', text)))


def record_to_json(df: DataFrame, columns: list[str]) -> Column:
    """Record as JSON text: decimals as text, dates in ISO form, nulls kept."""
    schema = _json_schema(df.select(*columns).schema)
    fields = [
        F.col(c).cast(schema[c].dataType).alias(c) if schema[c].dataType != df.schema[c].dataType else F.col(c)
        for c in columns
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def record_from_json(col: Column, schema: StructType) -> Column:
    """Typed record from the JSON text of ``record_to_json``."""
    return F.from_json(col, _json_schema(schema)).cast(schema)
