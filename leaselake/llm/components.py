"""Connected components of a link table by alternating stars, in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaselake.session import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step. Links go from the larger to the smaller end (``a`` > ``b``).

    Large star: each node sends its larger neighbours to the least of itself and its neighbours. Small
    star: each node sends itself and its smaller neighbours to the least of them. Nodes are reduced to
    their least neighbour first, so a node of high degree is never gathered.
    """
    if large:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = links
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = ends.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that has a link.

    ``links`` has two long columns; direction, repeats and self-links do not matter, rows with a null are
    ignored. Rounds go on until the links no longer change, a number of them that grows with the logarithm
    of the number of nodes. The driver sees two sums per round.
    """
    a, b = links.columns
    links = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    ).distinct()
    links = stored(links, "links")
    state = None
    while True:
        links = stored(_star(_star(links, True), False), "links")
        mixed = F.xxhash64("a", "b")
        now = links.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
