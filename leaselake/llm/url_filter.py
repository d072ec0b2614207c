"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule decides, and judge those that none does. Such a URL mostly has suffixes
that no rule ever decided, so the fit sees half of all suffixes, by a hash of the suffix, as such ones too: without
their own share of blocked URLs. From which probability on a URL is blocked is taken from URLs of rules that a fit
did not see: each rule is left out in turn, and the limit is the one at which the left-out URLs come out best.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaselake.operators.skew import broadcast_if_small
from leaselake.session import stored

ALLOW, BLOCK = "allow", "block"
SEED = 20_250_710
TREES = 12
DEPTH = 4
#: Trees and folds of rules for the limit; rules beyond the folds share one.
LIMIT_TREES, LIMIT_FOLDS = 6, 6
#: Ranges of scores that are added up before the scores inside.
RANGES = 1024
#: Rows that a suffix without any counts as having, at the overall share of blocked ones.
PRIOR_ROWS = 10.0
#: Rows of a task of the fit, about; there are 4 tasks at least.
FIT_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("top", "site", "section")

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of the longest rule (verdict, host, path) that fits a URL: ``rule`` and ``verdict``, else null.

    A rule fits its host and all subdomains where the path starts with the rule's. Of equally long rules
    the first in the list wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of_host, of_path in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        out = F.when(fits, F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _suffix(name: str) -> Column:
    """Keys of the suffix statistics: last label, last two labels, those and the first step of the path."""
    labels = F.split("host", r"\.")
    site = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    return {
        "top": F.element_at(labels, -1), "site": site,
        "section": F.concat_ws("/", site, F.regexp_extract("path", r"^/?([^/]*)", 1)),
    }[name]


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text).cast("double")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    terms = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(size > 0, -F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def _lexical(url: Column) -> dict[str, Column]:
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    host, path = F.col("host"), F.col("path")
    length = F.length(url)
    return {
        "length": length, "host_length": F.length(host), "path_length": F.length(path),
        "depth": count(path, "/"), "labels": count(host, r"\."), "hyphens": count(host, "-"),
        "digits": F.when(length > 0, count(url, "[0-9]") / length).otherwise(0.0),
        "host_digits": count(host, "[0-9]"), "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.when(F.contains(url, F.lit("?")), 1 + count(url, "[&;]")).otherwise(0),
    }


def _fit(labelled: DataFrame, names: list[str], trees: int):
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(labelled)
    return GBTClassifier(labelCol="label", maxIter=trees, maxDepth=DEPTH, seed=SEED).fit(vectors)


def _scored(rows: DataFrame, names: list[str], model) -> DataFrame:
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def best_limit(scored: list[tuple[float, float]]) -> float:
    """The score from which on to block, for (score, label) pairs: the best mean share of right allowed and right
    blocked ones, in the middle of the gap; of equally good ones the largest. Above all scores where one label is missing."""
    blocked = sum(label for _, label in scored)
    if not 0 < blocked < len(scored):
        return 0.5
    ordered = sorted(scored)
    best, limit, passed, allowed = -1.0, 0.5, 0.0, 0
    for i, (score, label) in enumerate(ordered):
        if i and score > ordered[i - 1][0]:
            quality = (blocked - passed) / blocked + allowed / (len(scored) - blocked)
            if quality >= best:
                best, limit = quality, (score + ordered[i - 1][0]) / 2
        passed, allowed = passed + label, allowed + (label == 0)
    return limit


def limit_of(scored: DataFrame) -> float:
    """``best_limit`` of the rows of a table (score, label).

    Rows are added up by score, scores by range, and then inside each range, so that not all meet in one task.
    """
    points = stored(scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("b")), "scores")
    points = points.withColumn("range", F.floor(F.col("score") * RANGES))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # at most RANGES + 1 rows
    ranges = points.groupBy("range").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("score").alias("top")).select(
        "range", F.sum("n").over(earlier).alias("n_before"), F.sum("b").over(earlier).alias("b_before"), F.max("top").over(earlier).alias("below"),
    )
    n, blocked = points.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return 0.5
    inside = W.partitionBy("range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.col(f"{c}_before"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0))
    cuts = points.join(F.broadcast(ranges), "range").select(
        "score", upto("n").alias("n"), upto("b").alias("passed"), F.coalesce(F.max("score").over(inside), "below").alias("below")
    ).where(F.col("below").isNotNull())
    quality = (blocked - F.col("passed")) / blocked + (F.col("n") - F.col("passed")) / (n - blocked)
    best = cuts.agg(F.max(F.struct(quality.alias("quality"), ((F.col("score") + F.col("below")) / 2).alias("limit")))["limit"]).first()[0]
    return 0.5 if best is None else best


def held_out(labelled: DataFrame, names: list[str], hidden: dict[str, Column]) -> DataFrame | None:
    """``rule``, ``score`` and ``label`` of labelled URLs under trees that did not see their rule; None without any such fit.

    Of the only rule of a verdict the URLs are left out half by half. ``hidden`` are the suffix statistics of
    a suffix never decided, as which those of left-out URLs count.
    """
    of_rule = {r.rule: r.label for r in labelled.select("rule", "label").distinct().collect()}
    alone = [r for r, label in of_rule.items() if list(of_rule.values()).count(label) == 1]
    others = sorted(set(of_rule) - set(alone))
    half = F.pmod("draw", F.lit(2))
    folds = [F.col("rule").isin(others[i::LIMIT_FOLDS]) for i in range(min(LIMIT_FOLDS, len(others)))]
    folds += [(F.col("rule") == r) & (half == side) for r in sorted(alone) for side in (0, 1)]
    out = None
    for left in folds:
        rows, seen = labelled.where(left), labelled.where(~left)
        if rows.isEmpty() or len({r.label for r in seen.select("label").distinct().collect()}) < 2:
            continue
        scored = _scored(rows.withColumns(hidden), names, _fit(seen, names, LIMIT_TREES)).select("rule", "score", "label")
        out = scored if out is None else out.unionByName(scored)
    return out


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict of every row.

    Suffix statistics (share of blocked URLs and log count among all rows that a rule decides) are reduced
    per suffix and joined back: broadcast when counted as few, else by a join that adaptive execution can
    split. A suffix whose URLs all fall under one rule says no more than the rule and counts as never decided,
    and so does half of the others of each kind in the fit, by a seeded hash. Null URLs and URLs without ``://`` have empty host and path and are judged by the trees. Where
    the rules decide no URL, or only one way, there is nothing to learn, and the rest is judged that way
    (allowed without any). Repeated rows stay repeated.
    """
    host, path = parts(F.col(url))
    lexical = _lexical(F.coalesce(F.col("url"), F.lit("")))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select(
        "key", "host", "path", "found", F.xxhash64("url", "key", F.lit(SEED)).alias("draw"),
        *[c.cast("double").alias(n) for n, c in lexical.items()], *[_suffix(n).alias(n) for n in SUFFIXES],
    )
    rows = rows.withColumn("label", F.when(F.col("found").isNotNull(), (F.col("found.verdict") == BLOCK).cast("double")))
    rows = stored(rows, "urls")
    total, blocked = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    plain = rows.select("key", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    if not total or blocked in (0.0, float(total)):
        judged = plain.withColumn("verdict", F.coalesce("verdict", F.lit(BLOCK if total and blocked else ALLOW)))
        return judged.withColumnRenamed("key", key)
    names = list(lexical)
    for name in SUFFIXES:
        counted = rows.where(F.col("label").isNotNull()).groupBy(name).agg(
            F.count("*").alias("n"), F.sum("label").alias("b"), F.min("found.rule").alias("low"), F.max("found.rule").alias("high")
        ).where("low < high")
        share = (F.col("b") + PRIOR_ROWS * blocked / total) / (F.col("n") + PRIOR_ROWS)
        counted = stored(counted.select(name, share.alias(f"{name}_share"), F.log1p("n").alias(f"{name}_rows")), "suffixes")
        rows = rows.join(broadcast_if_small(counted), name, "left").fillna(
            {f"{name}_share": blocked / total, f"{name}_rows": 0.0}
        )
        names += [f"{name}_share", f"{name}_rows"]
    labelled = rows.where(F.col("label").isNotNull()).withColumn("rule", F.col("found.rule"))
    unseen = {f"{n}_share": F.lit(blocked / total) for n in SUFFIXES} | {f"{n}_rows": F.lit(0.0) for n in SUFFIXES}
    half = {
        c: F.when(F.pmod(F.xxhash64(c.rpartition("_")[0], F.lit(SEED)), F.lit(2)) == 0, v).otherwise(F.col(c)) for c, v in unseen.items()
    }
    # Rows are dealt by the seeded hash, so that fits do not depend on how the table's files lie.
    labelled = stored(labelled.select("draw", "key", "rule", "label", *SUFFIXES, *names).orderBy("draw", "key"), "url-ordered")
    labelled = stored(labelled.repartition(max(4, total // FIT_ROWS)), "url-labelled")
    trees = _fit(labelled.withColumns(half), names, TREES)
    left_out = held_out(stored(labelled.orderBy("draw", "key").withColumns(half), "url-limit"), names, unseen)
    limit = 0.5 if left_out is None else limit_of(left_out)
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= limit, BLOCK).otherwise(ALLOW))
    return _scored(rows, names, trees).select(
        F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict")
    )
