"""Linking contracts to portfolio companies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaselake.functions.keys import key_value
from leaselake.functions.labels import pending_message
from leaselake.functions.text import null_if_empty, strip_ws
from leaselake.operators.skew import broadcast_if_small, lookup_join, running_total
from leaselake.session import stored

# Statuses, methods, default threshold.
FOUND, NOT_FOUND = "ENCONTRADO", "NAO_ENCONTRADO"
BY_KEY, BY_NAME, BY_NONE = "cnpj", "fuzzy", "nenhum"
KEY_SCORE = 100.0
DEFAULT_THRESHOLD = 85.0
#: Lower end of the band that is shown for manual review; below it a name has no candidate.
DEFAULT_FLOOR = 80.0

#: Names and candidates of a cell each, names compared at a time, and names of one company that keep their own place.
CELL, ROWS, NAMES = 4096, 256, 1 << 20

Similarity = Callable[[Column, Column], Column]
Pairs = Callable[[DataFrame, DataFrame], DataFrame]


# ---- similarity (J3) ---------------------------------------------------------------
def compare_key(col: Column) -> Column:
    """Text that is compared: lower case, no punctuation, words sorted."""
    plain = F.lower(F.regexp_replace(col, r"(?U)\W", " "))
    return F.btrim(F.array_join(F.array_sort(F.split(plain, " ")), " "))


#: Pairs whose common part is measured at a time.
PAIRS = 1 << 16


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of the texts as one row each, zero padded."""
    width = max((len(t) for t in texts), default=0)
    flat = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "replace")
    return np.frombuffer(flat, dtype=np.uint32).reshape(len(texts), width)


class Texts:
    """Texts with the places of each of their characters as bits, for measuring common parts."""

    def __init__(self, texts: list[str], others: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.other_sizes = np.array([len(t) for t in others], dtype=np.int64)
        own, other = _codes(texts), _codes(others)
        alphabet = np.unique(own) if own.size else np.zeros(1, np.uint32)
        self.words = max(1, -(-own.shape[1] // 64))
        # The last column of the alphabet is for characters that no text has.
        self.bits = np.zeros((self.words, len(texts), len(alphabet) + 1), dtype=np.uint64)
        slots = np.searchsorted(alphabet, own)
        for i in range(own.shape[1]):
            rows = np.flatnonzero(self.sizes > i)
            self.bits[i // 64, rows, slots[rows, i]] |= np.uint64(1 << i % 64)
        slots = np.searchsorted(alphabet, other).clip(max=len(alphabet) - 1)
        self.slots = np.where(alphabet[slots] == other, slots, len(alphabet))
        self.slots[np.arange(other.shape[1])[None, :] >= self.other_sizes[:, None]] = len(alphabet)

    def common(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Longest common subsequence of the pairs, by a bit for each character; sums carry from word to word."""
        state = np.full((self.words, len(rows)), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(int(self.other_sizes[others].max(initial=0))):
            slot = self.slots[others, i]
            carry = np.zeros(len(rows), dtype=np.uint64)
            for word in range(self.words):
                held = state[word]
                hit = held & self.bits[word, rows, slot]
                plus = held + hit
                total = plus + carry
                if self.words > 1:
                    carry = ((plus < held) | (total < plus)).astype(np.uint64)
                state[word] = total | (held - hit)
        # What lies behind a text's end stays set, so each zero bit is a common character.
        return 64 * self.words - np.bitwise_count(state).sum(axis=0, dtype=np.int64)

    def scores(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Similarity 0-100: one minus the share of characters outside the common part."""
        out = np.zeros(len(rows))
        for at in range(0, len(rows), PAIRS):
            r, o = rows[at : at + PAIRS], others[at : at + PAIRS]
            total = self.sizes[r] + self.other_sizes[o]
            apart = total - 2 * self.common(r, o)
            out[at : at + PAIRS] = np.where(total > 0, (1.0 - apart / np.maximum(total, 1)) * 100.0, 100.0)
        return out


def _pair_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    place, texts = pd.factorize(a.to_numpy())
    other, others = pd.factorize(b.to_numpy())
    return pd.Series(Texts(list(texts), list(others)).scores(place, other))


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two compare keys, in Arrow batches."""
    return F.pandas_udf(_pair_scores, T.DoubleType())(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """Alternative measure inside the JVM: one minus edit distance over length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(
        (F.lit(1.0) - F.levenshtein(a, b) / longest) * 100.0
    )


# ---- candidate names ----------------------------------------------------------------
def candidate_names(portfolio: DataFrame, key: str = "cnpj") -> DataFrame:
    """Every comparable name of every company, in tie-break order (seq, pos)."""
    empty = F.array().cast("array<string>")
    names = F.concat(
        F.array("razao_social"),
        F.coalesce("aliases", empty),
        F.coalesce("nomes_fantasia", empty),
    )
    return portfolio.select(
        F.col("portfolio_seq").alias("seq"),
        F.col(key).alias("key"),
        F.posexplode(names).alias("pos", "candidate"),
    )


def _unique(names: DataFrame) -> DataFrame:
    """Distinct compare keys of the candidates; the first owner in order stands for all.

    ``rank`` grows with the owner's place (seq, pos), missing ones last.
    """
    last = F.lit((1 << 63) - 1)
    return (
        names.groupBy(compare_key(F.col("candidate")).alias("b"))
        .agg(F.min(F.struct("seq", "pos", "key")).alias("owner"))
        .withColumn("rank", F.coalesce(F.col("owner.seq") * NAMES + F.least(F.col("owner.pos"), F.lit(NAMES - 1)), last))
    )


# ---- pairs that can reach the lower limit (J2) -------------------------------------------
def _apart(total: Column, floor: float) -> Column:
    """Most characters two texts of this total length may differ by."""
    return F.floor(total * F.lit(1.0 - floor / 100.0) + F.lit(1e-9)).cast("int")


def _bits(texts: pd.Series) -> pd.DataFrame:
    """Two words with a bit for each of the first four letters of each of 32 kinds.

    The number of bits that differ is never above the number of characters by which
    two texts differ, so it refuses a pair without comparing the texts.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.bincount(owner * 32 + codes % 32, minlength=len(texts) * 32).reshape(len(texts), 2, 16)
    held = (np.uint64(1) << np.minimum(counts, 4).astype(np.uint64)) - np.uint64(1)
    words = (held << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
    return pd.DataFrame({"low": words[:, 0], "high": words[:, 1]})


def _letter_bits(text: Column) -> list[Column]:
    words = F.pandas_udf(_bits, "low long, high long")(text)
    return [words["low"], words["high"]]


def _cell(floor: float, count: bool):
    """Best candidate of each name of a cell, or how many pairs were met and measured."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"a": [], "score": [], "b": []}
        met = measured = 0
        if left.num_rows and right.num_rows:
            a, b = left.column("a").to_pylist(), right.column("b").to_pylist()
            texts = Texts(a, b)
            words = [(left.column(f"a{i}").to_numpy(), right.column(f"b{i}").to_numpy()) for i in (0, 1)]
            total = texts.sizes[:, None] + texts.other_sizes[None, :]
            allowed = np.floor(total * (1.0 - floor / 100.0) + 1e-9).astype(np.int64)
            rank = right.column("rank").to_numpy()
            for at in range(0, len(a), ROWS):
                part = slice(at, at + ROWS)
                differ = sum(np.bitwise_count((x[part, None] ^ y[None, :]).view(np.uint64)).astype(np.int64) for x, y in words)
                longer = np.abs(texts.sizes[part, None] - texts.other_sizes[None, :])
                rows, others = np.nonzero(np.maximum(differ, longer) <= allowed[part])
                rows += at
                met, measured = met + differ.size, measured + len(rows)
                scores = texts.scores(rows, others)
                # The best of each name; of equally good candidates the first in portfolio order.
                order = np.lexsort((rank[others], -scores, rows))
                rows, others, scores = rows[order], others[order], scores[order]
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else rows
                first = first[scores[first] >= floor]
                found["a"] += [a[i] for i in rows[first].tolist()]
                found["score"] += scores[first].tolist()
                found["b"] += [b[j] for j in others[first].tolist()]
        if count:
            return pa.table({"met": pa.array([met], pa.int64()), "measured": pa.array([measured], pa.int64())})
        return pa.table({"a": pa.array(found["a"], pa.string()), "score": pa.array(found["score"], pa.float64()), "b": pa.array(found["b"], pa.string())})

    return run


def _blocks(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their letter bits and ``block``, about CELL neighbours in the order of length and bits; and the blocks.

    Bits of a letter fill up from its first place, so the common bits of a block are the least number of each letter
    in its texts and all its bits together the greatest.
    """
    bits = [f"{text}{i}" for i in (0, 1)]
    filed = rows.select(*rows.columns, *[w.alias(n) for n, w in zip(bits, _letter_bits(F.col(text)))], F.length(text).alias("size"), F.lit(1).alias("one"))
    placed = running_total(filed, ["size", *bits, text], "one", "place")
    block = F.floor(F.col("place") / CELL).alias("block")
    placed = stored(placed.select(*rows.columns, *bits, "size", block), "blocks")
    summary = placed.groupBy("block").agg(
        F.count("*").alias("rows"), F.min("size").alias("low"), F.max("size").alias("high"),
        *[f(n).alias(f"{kind}{i}") for i, n in enumerate(bits) for kind, f in (("least", F.bit_and), ("most", F.bit_or))],
    )
    return placed.drop("size"), summary


def _near(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    """Pairs of blocks, with ``near``: whether a text of one and a text of the other may reach the lower limit."""
    named = lambda blocks, side: blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns])
    c = F.col
    beyond = lambda x, y, i: F.bit_count(c(f"{x}_least{i}").bitwiseAND(F.bitwise_not(c(f"{y}_most{i}"))))
    letters = beyond("a", "b", 0) + beyond("a", "b", 1) + beyond("b", "a", 0) + beyond("b", "a", 1)
    differ = F.greatest(letters, c("a_low") - c("b_high"), c("b_low") - c("a_high"))
    return named(a, "a").crossJoin(named(b, "b")).withColumn("near", differ <= _apart(c("a_high") + c("b_high"), floor))


def _met(left: DataFrame, right: DataFrame, floor: float, count: bool = False) -> DataFrame:
    """Cells of names and candidates that may reach the lower limit, each compared in one task.

    Both sides are cut into blocks of about CELL texts that are alike in length and letters, whatever is frequent among
    them. A cell is a block of names with a block of candidates; it is refused as a whole, before any row moves, where
    their lengths or their least and greatest numbers of each letter lie too far apart. Inside a cell, two words of
    letter bits refuse most pairs, and only the rest is measured; one row per name leaves a cell. ``left`` has the
    column a, ``right`` has b and ``rank``, their order in the portfolio; names and candidates are distinct and not empty.
    """
    (names, of_names), (filed, of_filed) = _blocks(left, "a"), _blocks(right, "b")
    cells = stored(_near(of_names, of_filed, floor), "cells")
    met = broadcast_if_small(cells.where("near").select("a_block", "b_block"))
    sought = names.withColumnRenamed("block", "a_block").join(met, "a_block")
    offered = filed.withColumnRenamed("block", "b_block").join(met, "b_block")
    cell = ["a_block", "b_block"]
    schema = "met long, measured long" if count else "a string, score double, b string"
    compared = sought.groupBy(*cell).cogroup(offered.groupBy(*cell)).applyInArrow(_cell(floor, count), schema)
    if not count:
        return compared
    return compared.unionByName(cells.where(~F.col("near")).select((F.col("a_rows") * F.col("b_rows")).alias("met"), F.lit(0).cast("long").alias("measured")))


def measured_pairs(left: DataFrame, right: DataFrame, floor: float) -> tuple[int, int]:
    """Pairs of names and candidates in all cells, refused ones too, and those of them whose common part is measured."""
    met, measured = _met(left, right, floor, True).agg(F.sum("met"), F.sum("measured")).first()
    return met or 0, measured or 0


def _best(pairs: DataFrame) -> DataFrame:
    """Best candidate per name; equal scores go to the lowest (seq, pos)."""
    ranked = F.struct(
        F.col("score"),
        (-F.col("owner.seq")).alias("_seq"),
        (-F.col("owner.pos")).alias("_pos"),
        F.col("owner.key").alias("key"),
    )
    return pairs.groupBy("a").agg(F.max(ranked).alias("_best")).select(
        "a", F.col("_best.score").alias("score"), F.col("_best.key").alias("key")
    )


def prepared_candidates(portfolio: DataFrame) -> DataFrame:
    """Distinct compare keys of all company names, stored; a stream links all its batches to one."""
    return stored(_unique(candidate_names(portfolio)), "candidates")


def best_names(
    names: DataFrame, portfolio: DataFrame, floor: float = DEFAULT_FLOOR, candidates: DataFrame | None = None
) -> DataFrame:
    """Best candidate of each distinct compare key ``a`` of ``names``, at or above ``floor``.

    Candidate and score are exact; a name that no candidate reaches the floor for is absent.
    """
    # Both sides are read several times below; storing the distinct compare keys once
    # keeps the contracts and the key computation out of every one of those reads.
    names = stored(names.select("a"), "names")
    candidates = prepared_candidates(portfolio) if candidates is None else candidates
    equal = names.join(candidates.withColumnRenamed("b", "a"), "a").select(
        "a", F.lit(KEY_SCORE).alias("score"), F.col("owner.key").alias("key")
    )
    rest = stored(names.where(F.col("a") != "").join(candidates.select(F.col("b").alias("a")), "a", "left_anti"), "open-names")
    best = _met(rest, candidates.where(F.col("b") != ""), floor).join(candidates, "b")
    return equal.unionByName(_best(best))


def best_by(names: DataFrame, portfolio: DataFrame, similarity: Similarity, pairs: Pairs, floor: float) -> DataFrame:
    """The same with the caller's measure on raw names.

    ``pairs`` takes the distinct raw names (column a) and candidate names (b, owner)
    and gives the pairs to compare with all three columns: only the caller knows which
    pairs its measure can raise to the floor.
    """
    candidates = candidate_names(portfolio).where(F.col("candidate").isNotNull()).groupBy(F.col("candidate").alias("b")).agg(
        F.min(F.struct("seq", "pos", "key")).alias("owner")
    )
    met = pairs(names.select("a"), candidates).withColumn("score", similarity(F.col("a"), F.col("b")))
    return _best(met.where(F.col("score") >= floor))


# ---- the link decision (J1, J2, J8) ---------------------------------------------------------
def link_by_key(contracts: DataFrame, portfolio: DataFrame, id_col: str, document: str) -> DataFrame:
    """Add ``key`` of the company with the tenant's usable 14-digit document."""
    keyed = contracts.withColumn("_key", key_value(null_if_empty(F.col(document))))
    companies = portfolio.select(F.col("cnpj").alias("_key"), F.col("cnpj").alias("key"))
    return lookup_join(keyed, companies, ["_key"], [id_col]).drop("_key")


def link_entities(
    contracts: DataFrame,
    portfolio: DataFrame,
    id_col: str = "contract_id",
    name: str = "tenant_name",
    document: str = "tenant_document",
    threshold: float = DEFAULT_THRESHOLD,
    floor: float = DEFAULT_FLOOR,
    similarity: Similarity | None = None,
    pairs: Pairs | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """One row per contract with cnpj, status, method and score.

    The exact key decides first; only contracts it leaves open are compared by name,
    and each distinct name once. Inactive companies take part. A contract whose best
    candidate lies from ``floor`` up to the threshold keeps that score for review; below
    the floor it has no candidate and the score is null, without a name it is 0. A
    measure of the caller's own needs the pairs to compare as well (``best_by``).
    ``candidates`` are the portfolio's names if they are prepared already.
    """
    if (similarity is None) != (pairs is None):
        raise ValueError("give similarity and pairs together")
    floor = min(floor, threshold)
    keyed = stored(link_by_key(contracts.select(id_col, name, document), portfolio, id_col, document), "keyed")
    by_key = keyed.where(F.col("key").isNotNull()).select(
        id_col, name, document, F.col("key").alias("cnpj"),
        F.lit(BY_KEY).alias("method"), F.lit(KEY_SCORE).alias("score"),
    )
    named = strip_ws(F.coalesce(F.col(name), F.lit(""))) != ""
    compared = compare_key(F.col(name)) if similarity is None else F.col(name)
    open_rows = keyed.where(F.col("key").isNull()).drop("key").withColumn("a", F.when(named, compared))
    names = open_rows.where(F.col("a").isNotNull()).select("a").distinct()
    best = best_names(names, portfolio, floor, candidates) if similarity is None else best_by(names, portfolio, similarity, pairs, floor)
    hit = F.col("score") >= threshold
    by_name = lookup_join(open_rows, best, ["a"], [id_col]).select(
        id_col, name, document,
        F.when(hit, F.col("key")).alias("cnpj"),
        F.when(hit, F.lit(BY_NAME)).otherwise(F.lit(BY_NONE)).alias("method"),
        F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.col("score")).alias("score"),
    )
    return by_key.unionByName(by_name).withColumn(
        "status", F.when(F.col("cnpj").isNotNull(), F.lit(FOUND)).otherwise(F.lit(NOT_FOUND))
    )


# ---- coverage of the portfolio (J4, J5, A3, A4) -----------------------------------------------
def company_status(links: DataFrame, portfolio: DataFrame) -> DataFrame:
    """A3: one row per company: contracts, and the best match (key before name)."""
    best = F.max(F.struct((F.col("method") == BY_KEY).alias("by_key"), "score", "method"))
    matched = links.where(F.col("cnpj").isNotNull()).groupBy("cnpj").agg(
        F.count("*").alias("contracts"), best.alias("_best")
    )
    has = F.col("contracts").isNotNull()
    return portfolio.join(matched, "cnpj", "left").select(
        "portfolio_seq", "cnpj", "razao_social",
        F.when(has, F.lit(FOUND)).otherwise(F.lit(NOT_FOUND)).alias("status"),
        F.coalesce("_best.method", F.lit(BY_NONE)).alias("method"),
        F.coalesce("_best.score", F.lit(0.0)).alias("score"),
        F.coalesce("contracts", F.lit(0)).alias("contracts"),
    )


def pendencies(links: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Companies without a contract, with the exact message."""
    matched = links.where(F.col("cnpj").isNotNull()).select("cnpj").distinct()
    return portfolio.join(matched, "cnpj", "left_anti").select(
        "portfolio_seq", "cnpj", pending_message(F.col("razao_social"), F.col("cnpj")).alias("message")
    )


def orphans(links: DataFrame) -> DataFrame:
    """Contracts without a company, with the best score of the review band (null below it)."""
    return links.where(F.col("cnpj").isNull()).drop("cnpj", "status", "method").withColumnRenamed(
        "score", "best_score"
    )


def compliance_totals(links: DataFrame, portfolio: DataFrame) -> DataFrame:
    """A4: one row: companies, contracts, companies found, companies pending."""
    companies = company_status(links, portfolio).agg(
        F.count("*").alias("companies"),
        F.count_if(F.col("status") == FOUND).alias("found"),
        F.count_if(F.col("status") == NOT_FOUND).alias("pending"),
    )
    contracts = links.agg(F.count("*").alias("contracts")).scalar()
    return companies.select("companies", contracts.alias("contracts"), "found", "pending")
