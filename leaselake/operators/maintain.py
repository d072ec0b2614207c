"""Batch changes of stored tables (M1-M6)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaselake.functions.keys import normalise_key
from leaselake.functions.parsing import as_date, clean_list, next_adjustment
from leaselake.functions.text import strip_ws
from leaselake.operators.skew import running_last
from leaselake.plans import lease_ptbr as R

# Reject messages.
KEY_EXISTS = "Empresa com CNPJ %s já cadastrada."
KEY_MISSING = "Empresa com CNPJ %s não encontrada."
NAME_MISSING = "Razão Social: String should have at least 1 character"
SEGMENT_CHANGES = 100_000


def upsert(
    base: DataFrame, changes: DataFrame, key: str, order: list[str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """M1-M3: insert or overwrite by key; one row per key whatever the batch holds.

    Of several changes of a key the last by ``order`` wins, except in the ``keep``
    columns: those stay as stored, or as the first change of a new key gave them.
    Columns that only the base has keep their value; new rows get null there. Order
    columns that the base does not have are dropped.
    """
    if not order:
        raise ValueError("an order of the changes is needed: a key may come more than once")
    values = [c for c in changes.columns if c != key and (c in base.columns or c not in order)]
    last = [c for c in values if c not in keep]
    first = [c for c in values if c in keep]
    position = F.struct(*order)
    reduced = changes.groupBy(key).agg(
        F.max_by(F.struct(*last), position).alias("_last"),
        *([F.min_by(F.struct(*first), position).alias("_first")] if first else []),
    )
    changes = reduced.select(key, "_last.*", *(["_first.*"] if first else []))
    b, c = base.alias("b"), changes.withColumn("_new", F.lit(True)).alias("c")
    joined = b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer")
    changed, stored = F.col("c._new").isNotNull(), F.col(f"b.{key}").isNotNull()

    def merged(name: str) -> Column:
        if name == key:
            return F.coalesce(f"b.{key}", f"c.{key}")
        if name not in changes.columns:
            return F.col(f"b.{name}")
        take_new = changed & ~stored if name in keep else changed
        return F.when(take_new, F.col(f"c.{name}")).otherwise(F.col(f"b.{name}"))

    names = base.columns + [n for n in changes.columns if n not in base.columns]
    return joined.select(
        *[(merged(n) if n in base.columns else F.col(f"c.{n}")).alias(n) for n in names]
    )


def hash_id(file_hash: Column) -> Column:
    """Stable record id from the content hash, in uuid form."""
    h = F.substring(F.sha2(file_hash, 256), 1, 32)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in cuts])


def upsert_history(history: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """M2: refresh a stored file by hash, keeping its id, or add it with a new id."""
    return upsert(history, batch.withColumn("id", hash_id(F.col("file_hash"))), "file_hash", order, ("id",))


def upsert_portfolio(portfolio: DataFrame, imported: DataFrame, order: list[str] | None = None) -> DataFrame:
    """M1: re-import overwrites names and activity; ``created_at`` and order number survive.

    Imported rows follow their order number unless told otherwise.
    """
    return upsert(portfolio, imported, "cnpj", order or ["portfolio_seq"], ("created_at", "portfolio_seq"))


def upsert_brackets(tables: DataFrame, changes: DataFrame) -> DataFrame:
    """M3: a version that comes in replaces the stored version as a whole."""
    incoming = changes.select("version").distinct()
    return tables.join(incoming, "version", "left_anti").unionByName(changes)


# ---- change sets (M4) ---------------------------------------------------------------------
FIELDS = ("razao_social", "aliases", "nomes_fantasia", "ativo")


def judge_changes(
    base: DataFrame, changes: DataFrame, segment_size: int = SEGMENT_CHANGES
) -> DataFrame:
    """Each change with its key in canonical form, and the reason it is refused.

    ``changes``: seq (unique order), op (insert, edit, remove), cnpj, and the fields,
    null meaning keep. A change is judged against the state the earlier changes of
    the same key leave behind.
    """
    canonical = changes.withColumn("_key", normalise_key(F.col("cnpj"))).withColumn(
        "_bad_key", F.col("_key.reason")
    ).withColumn("cnpj", F.col("_key.value")).drop("_key")
    blank = F.col("razao_social").isNotNull() & (strip_ws(F.col("razao_social")) == "")
    no_name = F.col("razao_social").isNull() & (F.col("op") == "insert")
    wrong = F.coalesce(
        F.concat(F.lit("CNPJ: "), F.col("_bad_key")),
        F.when((F.col("op") != "remove") & (blank | no_name), F.lit(NAME_MISSING)),
    )
    sound = canonical.withColumn("_wrong", wrong).drop("_bad_key")
    sets = F.when(
        F.col("_wrong").isNull(), F.when(F.col("op") == "insert", True).when(F.col("op") == "remove", False)
    )
    segment = F.floor(F.col("seq") / segment_size)
    stored = base.select("cnpj", F.lit(True).alias("_stored"))
    judged = running_last(
        sound.where(F.col("cnpj").isNotNull()), "cnpj", "seq", sets, segment, "_state", stored, "_stored"
    ).withColumn("_exists", F.coalesce("_state", F.lit(False)))
    reason = F.coalesce(
        F.col("_wrong"),
        F.when((F.col("op") == "insert") & F.col("_exists"), F.format_string(KEY_EXISTS, "cnpj")),
        F.when((F.col("op") == "edit") & ~F.col("_exists"), F.format_string(KEY_MISSING, "cnpj")),
    )
    good = judged.withColumn("reason", reason).withColumn(
        "effective", F.col("reason").isNull() & ~((F.col("op") == "remove") & ~F.col("_exists"))
    )
    bad = sound.where(F.col("cnpj").isNull()).select(
        *changes.columns, F.col("_wrong").alias("reason"), F.lit(False).alias("effective")
    )
    return good.select(*changes.columns, "reason", "effective").unionByName(bad)


def apply_changes(
    base: DataFrame, judged: DataFrame, created_at: Column | None = None, top: Column | None = None
) -> DataFrame:
    """M4: the table after all effective changes, by one grouping and one join.

    The last insert or remove of a key starts its final state; each field then takes
    the last value given since, else the stored one. An inserted company, also one
    removed before, is created at ``created_at`` (now, unless told otherwise) and is
    numbered after all stored ones, in the order of the changes; ``top`` is the last
    stored number, for callers whose ``base`` is a part of the table.
    """
    stamp = F.current_timestamp() if created_at is None else created_at
    given = F.col("op") != "remove"
    cleaned = {
        "razao_social": strip_ws(F.col("razao_social")),
        "aliases": F.when(F.col("aliases").isNotNull(), clean_list(F.col("aliases"))),
        "nomes_fantasia": F.when(F.col("nomes_fantasia").isNotNull(), clean_list(F.col("nomes_fantasia"))),
        "ativo": F.col("ativo"),
    }
    last = lambda f: F.max(
        F.when(given & F.col(f).isNotNull(), F.struct(F.col("seq").alias("seq"), cleaned[f].alias("value")))
    )
    state = judged.where("effective").groupBy(F.col("cnpj").alias("_key")).agg(
        F.max(F.when(F.col("op") != "edit", F.struct("seq", "op"))).alias("_reset"), *[last(f).alias(f"_{f}") for f in FIELDS]
    )
    if top is None and "portfolio_seq" in base.columns:
        top = base.agg(F.coalesce(F.max("portfolio_seq"), F.lit(0)).alias("n")).scalar()
    elif top is None:
        top = F.lit(0)
    joined = base.join(state, F.col("cnpj") == F.col("_key"), "full_outer")
    fresh = F.coalesce(F.col("_reset.op") == "insert", F.lit(False))
    empty = F.array().cast("array<string>")
    defaults = {"aliases": empty, "nomes_fantasia": empty, "ativo": F.lit(True), "razao_social": F.lit(None)}

    def value(name: str) -> Column:
        if name == "cnpj":
            return F.coalesce("cnpj", "_key")
        if name in FIELDS:
            # Of a key's values the last is given after the reset or not at all.
            current = F.when(
                F.col("_reset").isNull() | (F.col(f"_{name}.seq") >= F.col("_reset.seq")), F.col(f"_{name}.value")
            )
            return F.when(fresh, F.coalesce(current, defaults[name])).otherwise(F.coalesce(current, name))
        new = {"origem_import": F.lit("manual"), "portfolio_seq": top + F.col("_reset.seq"), "created_at": stamp}.get(name)
        return F.when(fresh, new).otherwise(F.col(name)) if new is not None else F.col(name)

    kept = joined.where(F.col("_reset").isNull() | (F.col("_reset.op") != "remove"))
    return kept.select(*[value(c).alias(c) for c in base.columns])


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """M5: the table without the keys, and a one-row count of what was deleted."""
    wanted = keys.select(key).distinct()
    kept = base.join(wanted, key, "left_anti")
    deleted = base.join(wanted, key, "left_semi").agg(F.count("*").alias("deleted"))
    return kept, deleted


def truncate(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: the empty table, and a one-row count of what was deleted."""
    return base.where(F.lit(False)), base.agg(F.count("*").alias("deleted"))


# ---- aging dates (M6) ------------------------------------------------------------------------
def refresh_dates(
    contracts: DataFrame,
    ref_date: date | str | Column,
    next_col: str = "adjustment_next",
    start_col: str = "start_date",
    period_col: str = "adjustment_period_months",
    origin: Column | None = None,
) -> DataFrame:
    """M6: recompute next-adjustment dates that were calculated and have aged.

    Dates read from the text, rows without a start date and dates that are already
    right stay. ``refreshed`` marks the changed rows; provenance is not touched.
    """
    if origin is None:
        origin = F.try_element_at("provenance", F.lit("reajuste_proximo"))["origin"]
    period = F.coalesce(F.nullif(F.col(period_col), F.lit(0)), F.lit(R.DEFAULT_PERIOD))
    current = F.when(
        origin == R.BY_CALCULATION, next_adjustment(F.col(start_col), period, as_date(ref_date))
    )
    staged = contracts.withColumn("_next", current).withColumn(
        "refreshed",
        F.col("_next").isNotNull() & ~F.col("_next").eqNullSafe(F.col(next_col)),
    )
    return staged.withColumn(
        next_col, F.when(F.col("refreshed"), F.col("_next")).otherwise(F.col(next_col))
    ).drop("_next")


def refreshed_count(refreshed: DataFrame) -> DataFrame:
    return refreshed.agg(F.count_if("refreshed").alias("refreshed"))
