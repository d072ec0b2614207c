"""Structured Streaming jobs over arriving contracts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leaselake.operators.buckets import change_buckets, create_buckets, read_buckets
from leaselake.operators.dedup import dedup_by_content
from leaselake.operators.linkage import BY_KEY, link_entities, prepared_candidates
from leaselake.operators.maintain import hash_id
from leaselake.operators.skew import broadcast_if_small
from leaselake.plans.contracts import analyse
from leaselake.session import stored
from leaselake.sources.documents import _documents, _glob
from leaselake.sources.tables import read_version, versions

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hashes after the last fold up to this number are broadcast (some 100 bytes each).
FOLDED_BROADCAST_ROWS = 500_000
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(
    spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt",), files_per_batch: int = 1000
) -> DataFrame:
    """Arriving files of a folder as documents."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("pathGlobFilter", _glob(extensions))
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return _documents(raw)


def history_batch(documents: DataFrame, processed_at: Column, ref_date: date | str | None = None) -> DataFrame:
    """History records of a batch of documents: first per content hash, extracted."""
    first = dedup_by_content(documents, "hash", ["order_key", "path"]).where(
        F.col("status") == "processed"
    )
    contracts = analyse(first.select("file_name", "hash", "text"), "text", ref_date)
    inside = [c for c in contracts.columns if c not in ("file_name", "hash", "contract_needs_review")]
    return contracts.select(
        hash_id(F.col("hash")).alias("id"),
        "file_name",
        F.col("hash").alias("file_hash"),
        processed_at.alias("processed_at"),
        F.col("contract_needs_review").alias("needs_review"),
        F.lit(False).alias("file_missing"),
        F.struct(*inside).alias("contract"),
    )


def _last_of(rows: DataFrame) -> DataFrame:
    """Of every content hash, the record of the last batch."""
    fields = [c for c in rows.columns if c not in ("file_hash", "batch")]
    return rows.groupBy("file_hash").agg(F.max_by(F.struct(*fields), "batch").alias("_last")).select("file_hash", "_last.*")


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The history as of now: of every content hash, the record of the last batch."""
    return _last_of(spark.read.parquet(root))


# ---- history in two levels: buckets of the hash below, batches not yet folded into them above --------------
def _folded(spark: SparkSession, base: str) -> int | None:
    """Number of the last batch folded into a base, None before the first fold."""
    try:
        marks = spark.read.parquet(f"{base}/folded")
    except AnalysisException:  # no fold has finished yet
        return None
    return marks.agg(F.max("batch")).first()[0]


def _after(spark: SparkSession, root: str, folded: int | None) -> DataFrame:
    """Records of the batches after one; the folders of the others are not read."""
    rows = spark.read.parquet(root)
    return rows if folded is None else rows.where(F.col("batch") > folded)


def fold_history(spark: SparkSession, root: str, base: str, buckets: int) -> list[int]:
    """Fold the batches written since the last fold into the base; the numbers of the buckets written.

    May be run between any batches of a running stream, one fold at a time; the stream goes on writing to
    ``root``. Only buckets that the new records fall into are read and written. The batch up to which the
    base goes is noted when its buckets are in place, so a fold that broke off is simply done again: its
    batches still count as new, and their records win over the same ones in the base. ``buckets`` is
    the same number each time. Batches folded long ago may be deleted, but not the last one.
    """
    folded = _folded(spark, base)
    top = spark.read.parquet(root).agg(F.max("batch")).first()[0]
    if top is None or top == folded:
        return []
    news = stored(_last_of(_after(spark, root, folded).where(F.col("batch") <= top)), "folded")
    if folded is None:
        create_buckets(news, f"{base}/buckets", "file_hash", buckets, mode="overwrite")
        touched = list(range(buckets))
    else:
        touched = change_buckets(
            spark, f"{base}/buckets", "file_hash", buckets, news,
            lambda rows: rows.join(news, "file_hash", "left_anti").unionByName(news.select(*rows.columns)),
        )
    spark.range(1).select(F.lit(top).cast("long").alias("batch")).write.mode("append").parquet(f"{base}/folded")
    return touched


def read_folded_history(spark: SparkSession, root: str, base: str) -> DataFrame:
    """``read_history`` over a folded one: only records after the last fold are grouped.

    The base holds one record for each hash and is passed through; it is shuffled only where the hashes after the
    last fold are too many to be broadcast.
    """
    folded = _folded(spark, base)
    news = _last_of(_after(spark, root, folded))
    if folded is None:
        return news
    rows = read_buckets(spark, f"{base}/buckets", "file_hash")
    news = stored(news, "after-the-fold")
    replaced = broadcast_if_small(news.select("file_hash"), FOLDED_BROADCAST_ROWS)
    return rows.join(replaced, "file_hash", "left_anti").unionByName(news.select(*rows.columns))


def compact_history(spark: SparkSession, root: str, new_root: str) -> int:
    """Write the history as of now to a new folder as one batch; the number of that batch.

    Records lie there by ranges of their hash. The stream goes on with the new folder and its
    old checkpoint: later batches have higher numbers, so they win as before.
    """
    last = spark.read.parquet(root).agg(F.max("batch")).first()[0]
    read_history(spark, root).repartitionByRange("file_hash").sortWithinPartitions("file_hash").write.parquet(
        f"{new_root}/batch={last}"
    )
    return last


def stream_ingest(
    documents: DataFrame,
    history_root: str,
    checkpoint: str,
    ref_date: date | str | None = None,
    processed_at: Column | None = None,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Extract arriving files and upsert them into the history by hash.

    A batch writes only its own records, to the folder of its number, so history
    already stored is not rewritten and a repeated batch replaces itself. The id
    comes from the hash, so a file that arrives again keeps it; ``read_history``
    shows the last record of each. ``after_batch`` is called with the number of each
    batch when its records are written, for example to fold them (``fold_history``).
    """
    stamp = F.current_timestamp() if processed_at is None else processed_at

    def store(batch: DataFrame, batch_id: int) -> None:
        records = history_batch(batch, stamp, ref_date)
        records.write.mode("overwrite").parquet(f"{history_root}/batch={batch_id}")
        if after_batch is not None:
            after_batch(batch_id)

    return (
        documents.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB instead of the memory of executors.

    A query takes its settings when it starts, and a checkpoint keeps the store it began with.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def stream_dedup(stream: DataFrame, hash_col: str, order: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """R2: the first event of each hash, however late it or its copies come.

    The earliest event of each hash by ``order`` (columns that tell events apart) is the state of a streaming
    aggregation. A batch looks up its own hashes in it, so it costs what it holds, whatever came before.
    Every event gets the time of its batch; the earliest event of a hash is written when it carries
    the time of the batch being run, which is so for a new hash and for an event earlier than
    the one written, a correction. ``first_events`` reads the corrected state. No event is dropped for being
    late; a repeated batch gets its old time and state, and replaces its folder. An event that comes again unchanged is
    not written again. The null hash is a hash. The state grows with the distinct hashes and
    is split by hash; the number of its parts is that of shuffle partitions when the checkpoint begins.
    """
    others = [c for c in stream.columns if c not in (hash_col, *order)]
    place = F.struct(*order, "_arrived")
    first = (
        stream.withColumn("_arrived", F.current_timestamp())
        .groupBy(hash_col)
        .agg(F.min_by(F.struct(*order, *others, "_arrived"), place).alias("_first"))
        .where(F.col("_first._arrived") == F.current_timestamp())
        .select(hash_col, "_first.*")
        .drop("_arrived")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _state_on_disk(stream.sparkSession):
        return (
            first.writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def first_events(spark: SparkSession, out: str, hash_col: str, order: list[str]) -> DataFrame:
    """The first event of each hash, corrections taken in."""
    rows = spark.read.parquet(out).drop("batch")
    fields = [c for c in rows.columns if c != hash_col]
    return rows.groupBy(hash_col).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_first")).select(hash_col, "_first.*")


# ---- linkage against a portfolio that changes -------------------------------------------------
NAMES = ("razao_social", "aliases", "nomes_fantasia")
LINK = ("cnpj", "status", "method", "score")


def current_links(spark: SparkSession, out: str, id_col: str = "contract_id") -> DataFrame:
    """The last link of each contract, with the portfolio version it was made with."""
    rows = spark.read.parquet(out)
    fields = [c for c in rows.columns if c not in (id_col, "batch")]
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*fields), "batch").alias("_last")).select(id_col, "_last.*")


def _changed_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """``cnpj`` of companies of ``old`` that ``new`` does not hold at the same place under the same names."""
    same = lambda df: df.select("cnpj", F.sha2(F.to_json(F.struct("portfolio_seq", *NAMES)), 256).alias("_names"))
    return same(old).join(same(new), ["cnpj", "_names"], "left_anti").select("cnpj")


def relink(links: DataFrame, old: DataFrame, new: DataFrame, id_col: str, name: str, document: str) -> DataFrame:
    """Links that another portfolio version changes, as ``link_entities`` on all of it would give them.

    Contracts whose company is gone or has other names, and those whose best candidate lies in the review
    band, are linked anew. All others without a key match are compared only with companies that are
    new or renamed, and take one that is better, or as good and earlier in the portfolio.
    """
    lost, fresh = _changed_companies(old, new), _changed_companies(new, old)
    links = stored(links.join(lost.withColumn("_lost", F.lit(True)), "cnpj", "left"), "earlier-links")
    in_doubt = F.col("_lost").isNotNull() | (F.col("cnpj").isNull() & (F.coalesce("score", F.lit(0.0)) > 0))
    again = link_entities(links.where(in_doubt), new, id_col, name, document).select(id_col, *LINK)
    rest = links.where(~in_doubt & ~F.col("method").eqNullSafe(BY_KEY))
    place = new.select("cnpj", F.col("portfolio_seq").alias("_seq"))
    held = rest.join(place, "cnpj", "left").select(id_col, F.col("score").alias("_score"), F.col("_seq").alias("_held"))
    found = link_entities(rest, new.join(fresh, "cnpj", "left_semi"), id_col, name, document).join(place, "cnpj", "left")
    found = found.join(held, id_col)
    before = F.coalesce("_score", F.lit(-1.0))
    better = (F.col("method") == BY_KEY) | (F.col("score") > before) | (
        (F.col("score") == before) & (F.col("_seq") < F.col("_held"))
    )
    news = again.unionByName(found.where(better).select(id_col, *LINK))
    was = links.select(id_col, name, document, *[F.col(c).alias(f"_{c}") for c in LINK])
    differs = ~(F.col("cnpj").eqNullSafe(F.col("_cnpj")) & F.col("method").eqNullSafe(F.col("_method")) & F.col("score").eqNullSafe(F.col("_score")))
    return news.join(was, id_col).where(differs).select(id_col, name, document, *LINK)


def stream_link_versions(
    contracts: DataFrame,
    portfolio_root: str,
    out: str,
    checkpoint: str,
    id_col: str = "contract_id",
    name: str = "tenant_name",
    document: str = "tenant_document",
) -> StreamingQuery:
    """R3 with a portfolio that changes: each batch takes the newest finished version (``save_version``).

    When that is another than the last batch had, contracts of earlier batches whose link it changes are
    written once more with the new version; ``current_links`` shows the last link of each. A
    contract comes once; its id tells contracts apart. A repeated batch replaces itself. A batch reads the
    earlier links only when the version changed, apart from their version numbers.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = versions(spark, portfolio_root)[-1]
        portfolio = read_version(spark, portfolio_root, version)
        links = link_entities(batch, portfolio, id_col, name, document).select(id_col, name, document, *LINK)
        if batch_id:
            earlier = spark.read.parquet(out).where(F.col("batch") < batch_id)
            last = earlier.agg(F.max_by("portfolio_version", F.struct("batch", "portfolio_version"))).first()[0]
            if last is not None and last != version:
                fields = [name, document, *LINK]
                rows = earlier.groupBy(id_col).agg(F.max_by(F.struct(*fields), "batch").alias("_last")).select(id_col, "_last.*")
                links = links.unionByName(relink(rows, read_version(spark, portfolio_root, last), portfolio, id_col, name, document))
        links.withColumn("portfolio_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        contracts.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_link(
    contracts: DataFrame, portfolio: DataFrame, out: str, checkpoint: str, id_col: str = "contract_id",
) -> StreamingQuery:
    """Link arriving contracts to the portfolio; one output folder per batch.

    The portfolio is that of the start; its names are prepared once for all batches.
    """
    candidates = prepared_candidates(portfolio)

    def store(batch: DataFrame, batch_id: int) -> None:
        links = link_entities(batch, portfolio, id_col, candidates=candidates)
        links.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        contracts.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
