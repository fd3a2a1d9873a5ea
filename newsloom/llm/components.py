"""Connected components of an edge table, as rounds of joins and aggregations over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) of longs to (id, component): each id that has an edge, and the smallest id it reaches.

    Alternates the two star operations of Kiveris et al. (Connected Components in MapReduce and
    Beyond, 2014): each id's larger neighbours, then its smaller ones, are linked to the smallest
    neighbour. A round only aggregates minima, so a hub is no hot task. Rows with null, or with
    a = b, are ignored; an empty table gives an empty one.
    """
    link = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(most):
        # larger neighbours of u, and u itself, link to the smallest of u and its neighbours
        both = link.union(link.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u")).where("u <> v").distinct()
        # smaller neighbours of u link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
        link = written(small, "edges")
        state = link.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    own = link.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return own.union(link.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
