"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per vertex and a join, so a vertex with very many neighbours is never
gathered in one task.  Each round's edges are written to the shared folder, which cuts the
lineage.  Only two numbers per round (edge count and a checksum) go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any type with an order to (v, root): the smallest vertex of each edge vertex's component.

    Roots themselves are not listed.  Self-loops, repeated edges and nulls are ignored.
    """
    down = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    work = materialize(edges.where("u <> v").select(*down).distinct(), "edges")
    before = _mark(work)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").select(*down).distinct(), "edges"
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        work = materialize(small.where("u <> v").distinct(), "edges")
        after = _mark(work)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return work.select(F.col("u").alias("v"), F.col("v").alias("root"))
