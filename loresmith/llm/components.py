"""Connected components by repeated contraction: every round maps each node to the neighbour of lowest random rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); nodes are connected if and only if their roots are equal.

    Ranks are new hashes in each round, so chains shrink by a constant part per round whatever their ids.  Minima are
    combined before the shuffle; the mapping is written, so a node with very many edges is split by adaptive execution.
    Loops and repeated edges do no harm; empty edges give an empty result.
    """
    spark = edges.sparkSession
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, roots, turn = written(ordered, "edges"), None, 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "near")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("to"))
        nearest = both.groupBy("node").agg(F.min(rank("near")).alias("best"))
        moved = written(nearest.select("node", F.least("best", rank("node"))["to"].alias("to")), "moves")
        ends = left.join(moved.toDF("a", "ma"), "a").join(moved.toDF("b", "mb"), "b")
        left = ends.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a <> b").distinct()
        left = written(left, "edges")
        if roots is None:
            roots = moved.toDF("node", "root")
        else:
            roots = roots.join(moved.toDF("root", "to"), "root", "left")
            roots = written(roots.select("node", F.coalesce("to", "root").alias("root")), "roots")
        turn += 1
    return spark.createDataFrame([], "node long, root long") if roots is None else roots
