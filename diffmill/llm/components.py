"""Connected components of a link table, by star contraction.

Each round hangs the larger neighbours of a node, then its smaller ones, under the
smallest of them. Rounds grow with the logarithm of the component's size. A node with many
links costs one minimum, which is formed before the shuffle, and a join that adaptive
execution splits. The links stay on the executors.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.sources.staging import Step


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links`` (``a, b``): the smallest node that it
    reaches. Links to itself and repeated links do no harm."""
    a, b = F.col("a"), F.col("b")
    step = Step("links")
    edges = step.replace(
        links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _state(edges)
    while True:
        # a round needs the one before it alone, which then goes
        edges = step.replace(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
