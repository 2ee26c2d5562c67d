"""Connected components over an edge table, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _ranked(node: Column) -> Column:
    """Nodes in an order that has nothing to do with their numbers, so that no long run of neighbours is in order."""
    return F.struct(F.xxhash64(node).alias("h"), node.alias("n"))


def components(edges: DataFrame, smallest: bool = True) -> DataFrame:
    """``edges`` (a, b longs) -> (node, comp): the smallest node of each component, or with ``smallest`` off any one.

    Every round hooks each node to its first neighbour in a hashed order, follows that
    hook twice, and contracts the edges; at most half of the nodes that still have an edge
    survive as local minima, so rounds grow with the logarithm of the input.  Null
    ends and loops are ignored; repeated edges count once.  An empty table gives an
    empty result.  All sums of a hot node are combined before the shuffle.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = cut(e.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    n = 2 * e.count()  # neither nodes nor edges grow beyond it
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    label = cut(nodes.select("node", F.col("node").alias("comp")), "labels", n)
    while not e.isEmpty():
        both = e.union(e.select("b", "a")).toDF("v", "u")
        hook = both.groupBy("v").agg(F.least(_ranked(F.col("v")), F.min(_ranked(F.col("u"))))["n"].alias("p"))
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
        hook = cut(hook.join(up, "p").select("v", F.col("q").alias("p")), "hooks", n)
        to = lambda df, col: df.join(hook.withColumnsRenamed({"v": col, "p": f"new_{col}"}), col, "left").withColumn(col, F.coalesce(f"new_{col}", col)).drop(f"new_{col}")
        old_label, old_e = label, e
        label = cut(to(label, "comp").select("node", "comp"), "labels", n)
        e = cut(to(to(e, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", n)
        drop(old_label, old_e, hook)
    drop(e)
    if smallest:
        low = label.groupBy("comp").agg(F.min("node").alias("low"))
        label = label.join(low, "comp").select("node", F.col("low").alias("comp"))
    return label
