"""Connected components of an edge table, by alternating large-star and small-star rounds.

Edges with a null end link nothing and are left out, as are loops; repeated
edges count once; ties cannot arise, as each node takes the least of a set; no
edges give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


#: Parts that a node's edges are dealt to; the side that is joined, one row a node, is repeated as often.
SALTS = 4


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges joined with the row of their u, a hub's edges in SALTS parts."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "part"]).drop("part")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _met(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, is tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _met(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u but the least of its component, v; ``edges`` has columns u and v of one ordered type.

    Minima are aggregated on the map side before rows meet, and a hub's edges
    are salted.  Each round is a written table; the one before it is deleted.
    Nothing of the graph reaches the driver but a count and a checksum.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        before, edges = edges, written(_small(_large(edges)), "edges")
        dropped(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges
