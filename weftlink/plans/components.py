"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``v, root``: for each vertex of the edges ``a, b`` the smallest vertex it is connected with.

    First every vertex becomes one row with its smaller neighbours, as a list: it hangs on the smallest of them, and
    the others are tied to that one. Members of a large group name the same few smaller neighbours, so these ties, made
    distinct, are few however large the group is; only they and the vertices among them go through the rounds. The
    vertices that hang on them get their roots by a join of one row each.

    Edges may repeat and be given in either direction. A vertex whose only edge is one to itself is its own root; an
    edge with a null end is no edge. A vertex's distinct smaller neighbours must fit a row.
    """
    edges = edges.filter("a is not null and b is not null")
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("below"))
    stars = cut_lineage(
        pairs.groupBy("v").agg(F.collect_set("below").alias("below")).select("v", "below", F.array_min("below").alias("least"))
    )
    ties = stars.select(F.explode("below").alias("a"), F.col("least").alias("b")).distinct()
    inner = ties.select(F.col("a").alias("v")).union(ties.select(F.col("b").alias("v"))).distinct()
    # a vertex that others hang on keeps what it hangs on itself
    own = stars.join(inner, "v", "left_semi").select(F.col("v").alias("a"), F.col("least").alias("b"))
    roots = _rounds(cut_lineage(ties.union(own).distinct()))
    hung = stars.join(inner, "v", "left_anti").select("v", F.col("least").alias("on"))
    return roots.union(hung.join(roots.withColumnRenamed("v", "on"), "on").select("v", "root"))


def _rounds(edges: DataFrame) -> DataFrame:
    """``v, root`` by rounds: the smallest root among the neighbours, then the root of that root.

    The number of rounds grows with the logarithm of a component's width. Rounds are written, none is held on the driver.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    least = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    roots = cut_lineage(ends.join(least, "v", "left").select("v", F.coalesce("root", "v").alias("root")))
    while True:
        near = both.join(roots.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "v", "left").select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("v").alias("root"), F.col("root").alias("further"))
        new = cut_lineage(lower.join(jump, "root", "left").select("v", "was", F.least("root", F.coalesce("further", "root")).alias("root")))
        moved = new.filter("root != was").limit(1).count()
        roots = new.select("v", "root")
        if not moved:
            return roots
