"""Hard negatives by exact integer scores from Kronecker-packed products.

Components become integers. The same component of several candidates is raised by a bias, so that none is
negative, and put into separate fields of one wide integer; so are the anchor's components, one by one.
The wide integer times an anchor's component is all these products at once, and the sum over components
holds each candidate's score in its field. Fields are wide enough for the largest sum, so none runs over
into the next, and what the biases added is taken off again. Python integers have any width, so scores are
exact for all finite components.

Anchors are the stated query set. Blocks of anchors meet blocks of candidates, each of a bounded number of
rows, so no task holds more than one block of each, whatever keys or labels repeat.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaselake.llm.common import fresh
from leaselake.session import stored

SCALE = 256
#: Rows of a block of anchors, of candidates, and candidates in one wide integer.
ANCHORS, CANDIDATES, PACKED = 512, 4096, 256
_LONG = 1 << 63


def components(vectors: list[list[float]], scale: int = SCALE) -> list[list[int]]:
    """floor(scale * x) of each component, exact for any finite x whose product is finite."""
    out = []
    for vector in vectors:
        scaled = [scale * float(x) for x in vector]
        out.append([math.floor(v) if math.isfinite(v) else int(x) * scale for v, x in zip(scaled, vector)])
    return out


class Packed:
    """Candidates with their components side by side in wide integers, one integer for each component."""

    def __init__(self, rows: list[list[int]], size: int, largest: int) -> None:
        """``size`` components each (missing ones are zero), anchors' components up to ``largest``."""
        self.size, self.rows = size, len(rows)
        self.bias = max((abs(v) for row in rows for v in row), default=0)
        self.anchor_bias = largest
        bits = (4 * self.bias * largest * max(size, 1) + 1).bit_length()
        #: Bytes of a field, a machine word where one is enough.
        self.width = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 64) * 8
        shifted = [[(row[d] if d < len(row) else 0) + self.bias for row in rows] for d in range(size)]
        if self.width <= 8:
            self.wide = [int.from_bytes(np.array(s, dtype=f"<u{self.width}").tobytes(), "little") for s in shifted]
        else:
            self.wide = [int.from_bytes(b"".join(v.to_bytes(self.width, "little") for v in s), "little") for s in shifted]
        # A score plus what the biases add: sum (a + A)(c + B) = sum ac + B sum (a + A) + A sum (c + B) - size AB.
        self.raised = [sum(s[i] for s in shifted) for i in range(len(rows))]
        if self.width <= 8:
            self.raised = np.array(self.raised, dtype=np.int64)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner product with each candidate: int64 where fields are machine words, else Python integers."""
        shifted = [(anchor[d] if d < len(anchor) else 0) + self.anchor_bias for d in range(self.size)]
        total = 0
        for a, wide in zip(shifted, self.wide):
            total += a * wide
        raw = total.to_bytes(self.width * self.rows, "little")
        less = self.bias * sum(shifted) - self.size * self.bias * self.anchor_bias
        if self.width <= 8:
            fields = np.frombuffer(raw, dtype=f"<u{self.width}").astype(np.int64)
            return fields - (less + self.anchor_bias * self.raised)
        fields = [int.from_bytes(raw[i : i + self.width], "little") for i in range(0, len(raw), self.width)]
        return np.array([f - less - self.anchor_bias * r for f, r in zip(fields, self.raised)] or [], dtype=object)


def score_table(anchors: list[list[int]], candidates: list[list[int]]) -> np.ndarray:
    """Scores of each anchor (row) with each candidate (column)."""
    size = max((len(v) for v in [*anchors, *candidates]), default=0)
    largest = max((abs(v) for row in anchors for v in row), default=0)
    parts = []
    for at in range(0, len(candidates), PACKED):
        packed = Packed(candidates[at : at + PACKED], size, largest)
        parts.append([packed.scores(a) for a in anchors])
    if not parts or not anchors:
        return np.zeros((len(anchors), len(candidates)), dtype=np.int64)
    return np.concatenate([np.array(p, dtype=p[0].dtype) for p in parts], axis=1)


def _columns(table: pa.Table, *names: str) -> list[list]:
    """Columns as lists; a side without rows comes without columns."""
    return [table.column(n).to_pylist() if table.num_rows else [] for n in names]


# Scores travel as text, since no column type holds whole numbers of every length.


def _positives(count: int, scale: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        a_row, a_key, a_label, a_vector = _columns(anchors, "row", "key", "label", "vector")
        c_row, c_key, c_label, c_vector = _columns(candidates, "c_row", "c_key", "c_label", "c_vector")
        found: dict[str, list] = {"anchor": [], "place": [], "positive": [], "positive_score": []}
        labels = np.array(c_label, dtype=object)
        for label in set(a_label):
            mine = [i for i, own in enumerate(a_label) if own == label]
            same = np.flatnonzero(labels == label).tolist()
            if not same:
                continue
            table = score_table(components([a_vector[i] for i in mine], scale), components([c_vector[j] for j in same], scale))
            keys = np.array([c_key[j] for j in same], dtype=np.int64)
            for i, scores in zip(mine, table):
                best = np.lexsort((keys, -scores))[: count + 1].tolist()
                chosen = [j for j in best if c_row[same[j]] != a_row[i]][:count]
                found["anchor"] += [a_row[i]] * len(chosen)
                found["place"] += [c_row[same[j]] for j in chosen]
                found["positive"] += [c_key[same[j]] for j in chosen]
                found["positive_score"] += [str(scores[j]) for j in chosen]
        return pa.table({k: pa.array(v, pa.string() if k == "positive_score" else pa.int64()) for k, v in found.items()})

    return run


def _negatives(count: int, low: int, high: int, scale: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        a_row, a_label, a_vector, wanted = _columns(anchors, "row", "label", "vector", "wanted")
        c_row, c_key, c_label, c_vector = _columns(candidates, "c_row", "c_key", "c_label", "c_vector")
        table = score_table(components(a_vector, scale), components(c_vector, scale))
        keys, labels = np.array(c_key, dtype=np.int64), np.array(c_label, dtype=object)
        found: dict[str, list] = {"anchor": [], "positive_score": [], "place": [], "negative": [], "negative_score": []}
        for i, scores in enumerate(table):
            other = np.flatnonzero(labels != a_label[i])
            order = other[np.lexsort((keys[other], -scores[other]))]
            falling = scores[order]
            for p in sorted({int(w) for w in wanted[i]}):
                # 100 n <= high p and 100 n >= low p, for whole numbers n.
                most, least = high * p // 100, -(-low * p // 100)
                start = int(np.searchsorted(-falling, -most, side="left"))
                for j in order[start : start + count].tolist():
                    if scores[j] < least:
                        break
                    found["anchor"].append(a_row[i])
                    found["positive_score"].append(str(p))
                    found["place"].append(c_row[j])
                    found["negative"].append(c_key[j])
                    found["negative_score"].append(str(scores[j]))
        texts = ("positive_score", "negative_score")
        return pa.table({k: pa.array(v, pa.string() if k in texts else pa.int64()) for k, v in found.items()})

    return run


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _number(name: str) -> Column:
    """A score in text as a long; one beyond the range is its end."""
    value = F.col(name)
    end = F.when(value.startswith("-"), F.lit(-_LONG)).otherwise(F.lit(_LONG - 1))
    return F.coalesce(F.expr(f"try_cast({name} AS bigint)"), end)


def _higher(name: str) -> list[Column]:
    """Order by falling value of whole numbers of any length, held as text."""
    minus, value = F.col(name).startswith("-"), F.ltrim(F.col(name), F.lit("-"))
    size = F.length(value)
    return [minus.asc(), F.when(minus, -size).otherwise(size).desc(), F.when(~minus, value).desc_nulls_last(), F.when(minus, value).asc()]


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id (long), rank (int), negative_id, positive_score, negative_score (long).

    Components become floor(scale * x); a score is the inner product of two rows. Higher scores come first,
    ties by smaller key. The positives of an anchor are its first rows of the same label other than itself;
    the negatives of a pair the first rows of other labels from ``low`` to ``high`` percent of the pair's
    score. Rows with a null key, label or vector, or a null or not finite component, take no part. Repeated
    rows are rows of their own. Where vectors differ in length, missing components count as zero. Pairs
    without negatives have no row. A score too large for a long is given as the nearest long, and compared exactly.
    Other columns are ignored.
    """
    own = "anchor_row"
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    anchor, = fresh(rows, "is_anchor")
    sound = sound.withColumn(anchor, F.coalesce(is_anchor, F.lit(False)))
    table = stored(sound.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"), F.col(anchor).alias("anchor"),
    ), "vectors")
    total, queries = table.agg(F.count("*"), F.count_if("anchor")).first()
    blocks, cells = max(1, -(-queries // ANCHORS)), max(1, -(-total // CANDIDATES))
    part = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    # Every block of anchors meets every block of candidates: the query set against all rows.
    # Both sides of a cogroup come from one table, so this one's columns need names of their own.
    candidates = table.select(
        *[F.col(c).alias(f"c_{c}") for c in ("row", "key", "label", "vector")], F.pmod(F.xxhash64("row", F.lit(1)), F.lit(cells)).alias("cell"),
        _numbers(blocks).alias("block"),
    ).groupBy("block", "cell")

    def spread(anchors: DataFrame):
        return anchors.withColumn("cell", _numbers(cells)).groupBy("block", "cell")

    anchors = table.where("anchor").select("row", "key", "label", "vector", part)
    near = spread(anchors).cogroup(candidates).applyInArrow(
        _positives(positives, scale), "anchor long, place long, positive long, positive_score string"
    )
    first = W.partitionBy("anchor").orderBy(*_higher("positive_score"), "positive", "place")
    pairs = stored(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives), "positives")
    wanted = pairs.groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted")).withColumnRenamed("anchor", own)
    asked = spread(anchors.join(wanted, F.col("row") == F.col(own)).select("row", "label", "vector", "wanted", "block"))
    hard = asked.cogroup(candidates).applyInArrow(
        _negatives(negatives, low, high, scale), "anchor long, positive_score string, place long, negative long, negative_score string"
    )
    first = W.partitionBy("anchor", "positive_score").orderBy(*_higher("negative_score"), "negative", "place")
    ranked = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    named = table.where("anchor").select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    return pairs.join(ranked, ["anchor", "positive_score"]).join(named, "anchor").select(
        "anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"),
        _number("positive_score").alias("positive_score"), _number("negative_score").alias("negative_score"),
    )


#: The same for embeddings, anchors divisible by 50 and labels moved on where vec_id is divisible by 7.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label AS alabel, b.rid AS brid, b.vec_id AS other, b.label AS blabel,
         CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0
), p AS (
  SELECT arid, anchor_id, alabel, other AS positive_id, brid, score AS positive_score FROM s WHERE alabel = blabel
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, other, brid) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.arid, p.brid ORDER BY s.score DESC, s.other, s.brid) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.arid = p.arid AND s.blabel <> p.alabel
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.arid, p.brid ORDER BY s.score DESC, s.other, s.brid) <= 3
"""
