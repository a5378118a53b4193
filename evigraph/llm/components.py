"""Connected components of an edge table, by rounds of joins; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, label) for every end of an edge; the label is the least id of its component.

    Alternating large-star and small-star steps: each point links its larger neighbours, then its smaller ones, to the least of
    them, until no edge changes. A number of rounds that grows with the logarithm of the component's size suffices. Empty edges give no row.
    """
    links = materialise(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links = materialise(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        after = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()
