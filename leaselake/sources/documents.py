"""Document tables from folders and file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake.operators.skew import lookup_join

# Thresholds, methods and messages of the ingest.
NATIVE_MIN_CHARS = 20
OCR_MIN_CONFIDENCE = 60.0
NATIVE, OCR = "nativo", "ocr"
FILE_NOT_FOUND = "Arquivo não encontrado."
UNSUPPORTED = "Extensão de arquivo não suportada."
UNREADABLE = "Falha no OCR: sem texto"
NOT_UTF8 = "Erro inesperado na extração: o texto não está em UTF-8."
DEFAULT_EXTENSIONS = ("txt",)
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _glob(extensions: tuple[str, ...]) -> str:
    """Case-insensitive file-name glob for the extensions."""
    forms = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*.{" + ",".join(forms) + "}"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def content_hash(content: Column) -> Column:
    """S3: sha-256 hex of the bytes."""
    return F.sha2(content, 256)


def list_files(
    spark: SparkSession, folder: str | list[str], recursive: bool = False, **options: str
) -> DataFrame:
    """The files of folders as ``binaryFile`` rows; as many tasks list them as the session runs a few times over.

    Spark's own number is a task for each folder, up to 10,000, which costs far more than the listing.
    """
    tasks = str(4 * max(spark.sparkContext.defaultParallelism, 8))
    before = spark.conf.get(LISTING_TASKS, None)
    spark.conf.set(LISTING_TASKS, tasks)
    try:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        return reader.options(**options).load(folder)
    finally:
        if before is None:
            spark.conf.unset(LISTING_TASKS)
        else:
            spark.conf.set(LISTING_TASKS, before)


def _documents(raw: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    return raw.select(
        "path",
        name.alias("file_name"),
        F.lower(name).alias("order_key"),
        content_hash(F.col("content")).alias("hash"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    ).withColumn("error", F.when(F.col("text").isNull(), F.lit(NOT_UTF8)))


def scan_documents(
    spark: SparkSession,
    folder: str | list[str],
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS,
    recursive: bool = False,
) -> DataFrame:
    """Supported files of a folder or of several, not their sub-folders unless ``recursive``.

    A missing folder raises. A file that is not UTF-8 has ``error`` instead of text; the
    others go on. ``order_key`` (then ``path``) is the processing order.
    """
    return _documents(list_files(spark, folder, recursive, pathGlobFilter=_glob(extensions)))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def scan_listed(
    spark: SparkSession,
    requested: DataFrame,
    folders: str | list[str],
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS,
    recursive: bool = False,
) -> DataFrame:
    """The requested paths (column ``path``), each with its text or its error.

    ``folders`` are the ones the paths lie in; with ``recursive``, sub-folders too.
    """
    found = scan_documents(spark, folders, extensions, recursive).select(
        _plain(F.col("path")).alias("_plain"), "hash", "text", F.col("error").alias("_unreadable")
    )
    present = list_files(spark, folders, recursive).select(
        _plain(F.col("path")).alias("_plain"), F.lit(True).alias("_present")
    )
    wanted = requested.select("path").withColumn("_plain", _plain(F.col("path")))
    joined = lookup_join(
        lookup_join(wanted, present, ["_plain"], ["path"]), found, ["_plain"], ["path"]
    )
    error = (
        F.when(F.col("_present").isNull(), F.lit(FILE_NOT_FOUND))
        .when(~extension(F.col("path")).isin(*extensions), F.lit(UNSUPPORTED))
        .otherwise(F.col("_unreadable"))
    )
    name = file_name(F.col("path"))
    return joined.select(
        "path", name.alias("file_name"), F.lower(name).alias("order_key"), "hash", "text",
        error.alias("error"),
    )


def route_text(
    df: DataFrame, native: str = "text", fallback: str | None = None, min_chars: int = NATIVE_MIN_CHARS
) -> DataFrame:
    """Native text when long enough, else the fallback text, else an error row."""
    enough = F.length(F.coalesce(F.col(native), F.lit(""))) >= min_chars
    other = F.col(fallback) if fallback else F.lit(None).cast("string")
    return df.select(
        *[c for c in df.columns if c not in (native, fallback)],
        F.when(enough, F.col(native)).otherwise(other).alias("text"),
        F.when(enough, F.lit(NATIVE)).when(other.isNotNull(), F.lit(OCR)).alias("method"),
        F.when(~enough & other.isNull(), F.lit(UNREADABLE)).alias("error"),
    )


def word_confidence(words: DataFrame, id_col: str, limit: float = OCR_MIN_CONFIDENCE) -> DataFrame:
    """Mean confidence per document; a low or missing mean flags the document.

    Negative confidences mark layout rows without a word and do not count.
    """
    usable = F.when(F.col("confidence") >= 0, F.col("confidence"))
    mean = F.avg(usable)
    return words.groupBy(id_col).agg(
        mean.alias("mean_confidence"),
        F.coalesce(mean < limit, F.lit(True)).alias("low_confidence"),
    )
