"""Mixing sources to target weights: budgets down a domain-language-source tree, and token prefixes of epochs.

A budget of tokens falls from the root to domains, languages and sources by weight. No node gets more than
its documents give over the allowed epochs; what a node cannot use goes to its siblings by weight, and only
what all siblings together cannot use has been kept from their parent, i.e. went to the parent's siblings.
A leaf then reads its documents in a seeded order, anew for each epoch, up to its budget. Everything is
DataFrame operations on integers; budgets add up exactly.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaselake.operators.skew import broadcast_if_small
from leaselake.session import stored

SEED = 20_250_708
LEVELS = ("domain", "lang", "source")
DEFAULT_WEIGHT = 1
#: Hexadecimal digits of the seeded order key by which a leaf's documents are summed before single ones are looked at.
SLICE_DIGITS = 3
#: A last slice with more rows is cut by further digits, down to single keys.
SLICE_ROWS = 10_000
_WIDE = "decimal(38,0)"


def token_count(text: Column) -> Column:
    """Words of a text, the unit of all budgets; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Deal ``parent_budget`` to the nodes of each parent by ``weight`` (1 or more), none above its ``capacity``.

    Nodes are taken by capacity per weight, smallest first. A node whose fair part of what is left reaches
    its capacity is filled; from the first that is not filled on, the rest is dealt by weight, rounded so
    that it adds up. The parent's budget is at most the sum of the capacities.
    """
    by_fill = W.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight"), "node")
    before, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*parent)
    upto = by_fill.rowsBetween(W.unboundedPreceding, W.currentRow)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = (
        nodes.withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("short", (wide("capacity") * wide("weights") > wide("weight") * wide("left")).cast("int"))
        .withColumn("open", F.max("short").over(upto))
        .withColumn("rest", F.max(F.when(F.col("open") == 1, F.col("left"))).over(everything))
        .withColumn("open_weight", F.col("weight") * F.col("open"))
        .withColumn("open_upto", F.sum("open_weight").over(upto))
        .withColumn("open_weights", F.sum("open_weight").over(everything))
    )
    part = "cast(cast({} as decimal(38,0)) * cast(rest as decimal(38,0)) div open_weights as bigint)"
    dealt = F.expr(f"{part.format('open_upto')} - {part.format('open_upto - open_weight')}")
    return ranked.withColumn("budget", F.when(F.col("open") == 1, dealt).otherwise(F.col("capacity")))


def _same(left: list[str], right: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def leaf_budgets(supply: DataFrame, weights: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """``budget`` and ``tokens`` of every leaf (domain, lang, source) with tokens.

    ``supply`` has the leaf columns and ``tokens``. ``weights`` has the path columns of a node, null below
    it, and an integer ``weight``; a node named twice takes the larger one, a node not named DEFAULT_WEIGHT,
    and nothing is taken from below a node of weight 0. The total is ``percent`` of all tokens, or what the
    epochs give if that is less. A null domain, lang or source is a node of its own and cannot be named.
    """
    leaves = supply.where(F.col("tokens") > 0).withColumn("capacity", F.col("tokens") * max_epochs)
    for depth, name in enumerate(LEVELS):
        path, below = list(LEVELS[: depth + 1]), LEVELS[depth + 1 :]
        own = functools.reduce(lambda a, b: a & b, [F.col(c).isNull() for c in below], F.col(name).isNotNull())
        named = weights.where(own).groupBy(*[F.col(c).alias(f"of_{c}") for c in path]).agg(F.max("weight").alias("named"))
        leaves = leaves.join(named, _same(path, [f"of_{c}" for c in path]), "left").select(
            *[c for c in leaves.columns], F.coalesce(F.col("named").cast("long"), F.lit(DEFAULT_WEIGHT)).alias(f"{name}_weight")
        )
    leaves = stored(leaves.where(functools.reduce(lambda a, b: a & b, [F.col(f"{c}_weight") > 0 for c in LEVELS])), "leaves")
    given = None
    for depth, name in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(
            F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), F.max(f"{name}_weight").alias("weight"),
            F.coalesce(F.first(name), F.lit("")).alias("node"),
        )
        if given is None:
            everything = W.partitionBy()  # the domains
            target = F.expr("tokens_of_all * {percent} div 100".format(percent=int(percent)))
            nodes = nodes.withColumn("tokens_of_all", F.sum("tokens").over(everything)).withColumn(
                "parent_budget", F.least(target, F.sum("capacity").over(everything))
            )
        else:
            above = given.select(*[F.col(c).alias(f"of_{c}") for c in parent], F.col("budget").alias("parent_budget"))
            nodes = nodes.join(above, _same(parent, [f"of_{c}" for c in parent]))
        given = _share(nodes, parent).select(*path, "tokens", "budget")
    return given


def order_key(seed: int, epoch: Column, key: str) -> Column:
    """Place of a document in the seeded order of an epoch, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(key).cast("string")).cast("binary"))


#: Columns that ``select`` adds, with their names.
ADDED = {"domain": "domain", "epoch": "epoch", "n_tokens": "n_tokens", "taken": "taken"}


def select(docs: DataFrame, weights: DataFrame, percent: int, max_epochs: int, domain: Column, key: str = "doc_id", tokens: Column | None = None, seed: int = SEED, added: dict[str, str] | None = ADDED) -> DataFrame:
    """The documents each leaf reads, once per epoch, with ``domain``, ``epoch``, ``n_tokens`` and ``taken``.

    A leaf's budget is spent on whole epochs first; in the last one its documents are read in the order of
    ``order_key`` (ties by number of tokens) until the budget is used, the last document in part: ``taken``
    is the number of its first words that count. Documents without tokens are never read. All columns of
    ``docs`` are kept, except ones with the names of the added ones; ``added`` None adds none.

    Sums by leaf and slice of the order decide for whole slices at once; only the one slice of each leaf in
    which the budget ends is ordered, so a leaf with most of all documents is not gathered anywhere, and
    rows move only in those slices.
    """
    added = added or {}
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added.values()]).alias("row"),
        F.col(key).alias("key"), domain.alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source"),
        (token_count(F.col("text")) if tokens is None else tokens).cast("long").alias("n_tokens"),
    )
    narrow = stored(rows.drop("row").where(F.col("n_tokens") > 0), "supply")
    supply = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = stored(
        leaf_budgets(supply, weights, percent, max_epochs).select(
            *[F.col(c).alias(f"of_{c}") for c in LEVELS],
            F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"),
        ),
        "budgets",
    )
    leaf = [f"of_{c}" for c in LEVELS]

    def placed(df: DataFrame, plan: DataFrame) -> DataFrame:
        """Rows with the plan of their leaf; ``slice`` is as much of the place as the plan's last slice has."""
        joined = df.join(broadcast_if_small(plan), _same(list(LEVELS), leaf))
        return joined.withColumn("place", order_key(seed, F.col("epochs"), "key")).withColumn(
            "slice", F.expr("left(place, length(last))")
        )

    # The slice in which a budget ends is cut again until it is small; a key's md5 has 32 digits.
    ends = budgets.where(F.col("rest") > 0).select(*leaf, "epochs", F.lit("").alias("last"), F.col("rest").alias("room"))
    for digits in range(SLICE_DIGITS, 32 + SLICE_DIGITS, SLICE_DIGITS):
        inside_last = placed(narrow, ends).where(F.col("slice") == F.col("last"))
        ends = stored(_last_slices(inside_last, leaf, digits), "ends")
        if (ends.agg(F.max("rows")).first()[0] or 0) <= SLICE_ROWS:
            break
    plan = budgets.select(*leaf, "epochs").join(
        broadcast_if_small(ends.select(*[F.col(c).alias(f"end_{c}") for c in leaf], "last", "room")), _same(leaf, [f"end_{c}" for c in leaf]), "left"
    ).select(*leaf, "epochs", "last", "room")
    whole = placed(rows.where(F.col("n_tokens") > 0), plan)
    out = ["row", "domain", "n_tokens"]
    # Whole epochs, and the slices of the last epoch that lie before the one in which the budget ends.
    reads = F.col("epochs") + F.coalesce((F.col("slice") < F.col("last")).cast("long"), F.lit(0))
    full = whole.withColumn("reads", reads).where(F.col("reads") > 0).select(
        *out, F.explode(F.sequence(F.lit(0).cast("long"), F.col("reads") - 1)).alias("epoch"), F.col("n_tokens").alias("taken")
    )
    before = F.coalesce(
        F.sum("n_tokens").over(W.partitionBy(*leaf).orderBy("place", "n_tokens", "tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    # Rows of one key and size go by a hash of all they hold, so a retry reads the same ones.
    ending = whole.where(F.col("slice") == F.col("last")).withColumn("tie", F.xxhash64(F.to_json("row"))).withColumn("taken", F.least(F.col("n_tokens"), F.col("room") - before)).where(
        F.col("taken") > 0
    ).select(*out, F.col("epochs").alias("epoch"), "taken")
    return full.unionByName(ending).select("row.*", *[F.col(c).alias(name) for c, name in added.items()])


def _last_slices(rows: DataFrame, leaf: list[str], digits: int) -> DataFrame:
    """Of each leaf the slice of so many digits of the place in which ``room`` ends, the room left in it and its rows.

    Sums are added up by all digits but the last two, and then inside, so that no leaf's slices all meet in one task.
    """
    sums = rows.groupBy(*leaf, F.substring("place", 1, digits).alias("cut")).agg(
        F.sum("n_tokens").alias("held"), F.count("*").alias("rows"), F.first("room").alias("room"), F.first("epochs").alias("epochs")
    ).withColumn("digit", F.substring("cut", 1, max(1, digits - 2)))
    earlier = W.partitionBy(*leaf).orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
    by_digit = sums.groupBy(*leaf, "digit").agg(F.sum("held").alias("digit_held")).withColumn(
        "before", F.coalesce(F.sum("digit_held").over(earlier), F.lit(0))
    ).select(*[F.col(c).alias(f"digit_{c}") for c in [*leaf, "digit"]], "before")
    inside = W.partitionBy(*leaf, "digit").orderBy("cut").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("before") + F.sum("held").over(inside)
    return (
        sums.join(by_digit, _same([*leaf, "digit"], [f"digit_{c}" for c in [*leaf, "digit"]]))
        .withColumn("upto", upto).where((F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("held") < F.col("room")))
        .select(*leaf, "epochs", F.col("cut").alias("last"), (F.col("room") - F.col("upto") + F.col("held")).alias("room"), "rows")
    )


def _share_sql(name: str, source: str, parent: list[str]) -> str:
    """The dealing of one level in DuckDB SQL: CTE ``name`` with ``budget`` from nodes in ``source``."""
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    fill = f"{by}ORDER BY capacity::DOUBLE / weight, node ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""{name}_a AS (
  SELECT *, parent_budget - coalesce(sum(capacity) OVER ({fill} 1 PRECEDING), 0) AS lft,
    sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({fill} 1 PRECEDING), 0) AS weights FROM {source}
), {name}_b AS (
  SELECT *, max(CASE WHEN capacity::HUGEINT * weights > weight::HUGEINT * lft THEN 1 ELSE 0 END) OVER ({fill} CURRENT ROW) AS opn FROM {name}_a
), {name}_c AS (
  SELECT *, max(CASE WHEN opn = 1 THEN lft END) OVER ({by}) AS rest, sum(weight * opn) OVER ({fill} CURRENT ROW) AS upto,
    sum(weight * opn) OVER ({by}) AS total FROM {name}_b
), {name} AS (
  SELECT *, CASE WHEN opn = 1 THEN (upto::HUGEINT * rest) // total - ((upto - weight)::HUGEINT * rest) // total ELSE capacity END AS budget
  FROM {name}_c
)"""


def oracle(domain_sql: str, weights: list[tuple], percent: int, max_epochs: int, seed: int = SEED) -> str:
    """``select`` over table documents in DuckDB SQL, with every leaf ordered as a whole."""
    values = ", ".join("({}, {}, {}, {})".format(*("NULL" if v is None else repr(v) for v in row)) for row in weights)
    weight = lambda on: f"coalesce((SELECT max(weight) FROM w WHERE {on}), {DEFAULT_WEIGHT})"
    return f"""
WITH d AS (
  SELECT *, {domain_sql} AS domain FROM (
    SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents
  )
), w(domain, lang, source, weight) AS (VALUES {values}),
leaf AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, {max_epochs} * sum(n_tokens) AS capacity FROM d WHERE n_tokens > 0 GROUP BY ALL
), leaves AS (
  SELECT *, {weight("w.domain = leaf.domain AND w.lang IS NULL AND w.source IS NULL")} AS w1,
    {weight("w.domain = leaf.domain AND w.lang = leaf.lang AND w.source IS NULL")} AS w2,
    {weight("w.domain = leaf.domain AND w.lang = leaf.lang AND w.source = leaf.source")} AS w3 FROM leaf
), n1 AS (
  SELECT domain, coalesce(domain, '') AS node, sum(capacity) AS capacity, max(w1) AS weight,
    least(sum(sum(tokens)) OVER () * {percent} // 100, sum(sum(capacity)) OVER ()) AS parent_budget FROM leaves GROUP BY domain
), {_share_sql("s1", "n1", [])}, n2 AS (
  SELECT l.domain, l.lang, coalesce(l.lang, '') AS node, sum(l.capacity) AS capacity, max(w2) AS weight, any_value(s1.budget) AS parent_budget
  FROM leaves l JOIN s1 ON l.domain IS NOT DISTINCT FROM s1.domain GROUP BY l.domain, l.lang
), {_share_sql("s2", "n2", ["domain"])}, n3 AS (
  SELECT l.domain, l.lang, l.source, coalesce(l.source, '') AS node, l.capacity, w3 AS weight, s2.budget AS parent_budget, l.tokens
  FROM leaves l JOIN s2 ON l.domain IS NOT DISTINCT FROM s2.domain AND l.lang IS NOT DISTINCT FROM s2.lang
), {_share_sql("s3", "n3", ["domain", "lang"])}, reads AS (
  SELECT d.doc_id, d.domain, d.lang, d.source, d.n_tokens, unnest(range(0, {max_epochs})) AS epoch, s3.budget, s3.tokens
  FROM d JOIN s3 ON d.domain IS NOT DISTINCT FROM s3.domain AND d.lang IS NOT DISTINCT FROM s3.lang AND d.source IS NOT DISTINCT FROM s3.source
  WHERE d.n_tokens > 0
), placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (
    PARTITION BY domain, lang, source, epoch ORDER BY md5('{seed}:' || epoch || ':' || doc_id), n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM reads
)
SELECT doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, budget - before)::BIGINT AS taken FROM placed WHERE budget > before
"""
