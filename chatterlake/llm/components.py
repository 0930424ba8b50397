"""Connected components of a graph given as a table of edges."""

from pyspark.sql import functions as F

from ..sources.storage import delete_path, write_table

MAX_ROUNDS = 60


def _smaller(edges):
    """Edges as (u, v) with u > v, without loops and repeats."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges, a, b):
    """`node`, `component` (smallest node reachable) for every node of an edge.

    Alternates the large-star and small-star steps: every node points its larger, then its
    smaller neighbours at its smallest one, until nothing changes. Each round is written to the
    shared folder, so lineage stays short and a lost executor costs little. A node with very
    many neighbours is only ever met in aggregates, which fold it per task first, and in joins of
    written tables that no aggregate shares a stage with, which adaptive execution can split.
    """
    spark = edges.sparkSession
    current, path = write_table(_smaller(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    mark = _mark(current)
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, large_path = write_table(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), "large")
        best, best_path = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "best")
        small = large.join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(best.select("u", F.col("m").alias("v")))
        after, after_path = write_table(_smaller(small), "edges")
        for used in (path, least_path, large_path, best_path):
            delete_path(spark, used)
        current, path, before, mark = after, after_path, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("Components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.join(current.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))


def _mark(edges):
    """Number of edges and a sum of their hashes; equal for equal sets of edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
    return row["n"], row["h"]
