"""Connected components of an edge table, without bringing edges or labels to the driver.

Each round every node is merged into the least of itself and its neighbours, and the
edges are carried over to what is left. Least is by the node itself in the first round,
which ends stars around their least node, and by a hash that is new in each later round:
so a node is kept with a chance of about one half whatever the edges look like, and rounds
and all tables shrink as the logarithm of the nodes, on long chains, too. What a node was
merged into is written in each round, and put together backwards.

A node with very many edges, and a component of very many nodes, are met by partial minima
and by joins that deal a large group to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import cut
from weft.llm.skew import join_groups


def merges(edges: DataFrame, a: str = "a", b: str = "b") -> list[DataFrame]:
    """Of each round (u, s): nodes that still have edges, and what they are merged into."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    left, steps = cut(one.union(one.select("v", "u")).distinct()), []
    while not left.isEmpty():
        met = left.groupBy("u").agg(F.min(_place("v", len(steps))).alias("low"), F.count("*").alias("n"))
        step = cut(met.select("u", F.least("low", _place("u", len(steps)))["x"].alias("s"), "n"))
        steps.append(step.select("u", "s"))
        half = join_groups(left, step.withColumnRenamed("s", "su"), ["u"], "n", ["v"]).select("su", "v")
        ends = step.select(F.col("u").alias("v"), F.col("s").alias("sv"), "n")
        left = cut(join_groups(half, ends, ["v"], "n", ["su"]).select(F.col("su").alias("u"), F.col("sv").alias("v")).where("u <> v").distinct())
    return steps


def _place(node: str, k: int) -> Column:
    return F.struct((F.xxhash64(node, F.lit(k)) if k else F.lit(0).cast("long")).alias("h"), F.col(node).alias("x"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the label is the least node of the component. Nodes without an edge are left out.

    Null ends and loops are ignored, edges may be repeated, and an empty table gives an empty one.
    """
    steps = merges(edges, a, b)
    if not steps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("label")).limit(0)
    into = steps[-1].withColumnRenamed("s", "rep")
    for step in reversed(steps[:-1]):
        of = into.select(F.col("u").alias("m"), "rep")
        groups = step.groupBy("s").agg(F.count("*").alias("n")).join(of, F.col("s") == F.col("m"), "left").select("s", "n", F.coalesce("rep", "s").alias("rep"))
        into = cut(join_groups(step, cut(groups), ["s"], "n", ["u"]).select("u", "rep"))
    least = cut(into.groupBy("rep").agg(F.min("u").alias("label"), F.count("*").alias("n")))
    return cut(join_groups(into, least, ["rep"], "n", ["u"]).select(F.col("u").alias("node"), "label"))
