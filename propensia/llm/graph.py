"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from propensia.session import stage


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """One star step over arcs (u, v), every arc with u as its centre.

    Large star: neighbours above u are hung on the smallest of u and its neighbours.
    Small star: u and its (smaller) neighbours are hung on the smallest of them.
    The minima are a written table, so both sides of the join are exchanged and a hub's arcs can be split.
    """
    least = stage(arcs.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = arcs.join(least, "u")
    if large:
        hung = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has the columns a and b of one orderable type. Loops, repeated and reversed edges are fine; an
    edge with a null end is none. Returns node and component (the smallest node reachable). Rounds go on until
    the edges no longer change; each is written to the shared folder, so a lost executor costs one round at most.
    Raises if ``most_rounds`` do not suffice (rounds grow with the logarithm of a component's size).
    """
    spark = edges.sparkSession
    now = stage(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after = stage(_star(both, True), "large")
        now = stage(_star(after.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "small")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
