"""Problem 4: pairwise matches consolidated into groups by deterministic Borůvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.session import Scratch, table


def boruvka(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, group_id) of every node that has an edge to another one; group_id is the smallest node of the group.

    ``edges`` has long columns a and b in any order, with repeats, nulls and loops; nulls and loops link nothing.
    In each round every component selects its smallest outgoing edge under the order (smaller end, larger end), which
    leaves no cycle but two components that choose each other; the smaller of those becomes a root.  Trees collapse by
    pointer doubling; the edges are relabelled and deduplicated until none is left.  Each round at least halves the
    components that still have edges, so there are at most log2(n) rounds, and edges only become fewer.  Minimum
    and deduplication combine before they shuffle; hot keys in the joins are left to Spark's adaptive skew join.
    Every round ends in a written table, none in the driver's memory.
    """
    scratch = scratch.fresh()
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = scratch.put("edges", e)
    members = None  # (node, root): each node with the component that it has been merged into
    while not e.isEmpty():
        both = e.select(F.col("a").alias("c"), F.col("b").alias("n")).unionByName(e.select(F.col("b").alias("c"), F.col("a").alias("n")))
        chosen = both.groupBy("c").agg(F.min(F.struct(F.least("c", "n").alias("lo"), F.greatest("c", "n").alias("hi"))).alias("e"))
        hooks = scratch.put("hooks", chosen.select("c", F.when(F.col("c") == F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("p")))
        back = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        tree = scratch.put("tree", hooks.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        moving = True
        while moving:
            up = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            tree = scratch.put("tree", tree.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moving = not tree.where("moved").isEmpty()
            tree = tree.select("c", "p")
        step = tree.select(F.col("c").alias("root"), "p")
        if members is None:
            members = scratch.put("members", step.select(F.col("root").alias("node"), F.col("p").alias("root")))
        else:
            members = scratch.put("members", members.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        ra, rb = tree.select(F.col("c").alias("a"), F.col("p").alias("ra")), tree.select(F.col("c").alias("b"), F.col("p").alias("rb"))
        e = scratch.put("edges", e.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    scratch.drop("edges", "hooks", "tree")
    if members is None:
        return scratch.spark.createDataFrame([], "node long, group_id long")
    firsts = members.groupBy("root").agg(F.min("node").alias("group_id"))
    return members.join(firsts, "root").select("node", "group_id")


def resolved_matches(matches: DataFrame, topics: DataFrame) -> DataFrame:
    """(a, b): the topics that each row of matches names, rows with a side that names no topic left out.

    A side names a topic by its id or, where the id is null, by its exact label.
    """
    t = topics.select("id", "label")
    keys = t.where("id is not null").select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("k"), "id").unionByName(t.where("label is not null").select(F.concat(F.lit("l"), F.col("label")).alias("k"), "id"))
    side = lambda n: F.coalesce(F.concat(F.lit("i"), F.col(f"topic{n}_id").cast("string")), F.concat(F.lit("l"), F.col(f"topic{n}_label")))
    m = matches.select(side(1).alias("k1"), side(2).alias("k2")).where("k1 is not null and k2 is not null and k1 <> k2").distinct()
    m = m.join(keys.select(F.col("k").alias("k1"), F.col("id").alias("a")), "k1")
    return m.join(keys.select(F.col("k").alias("k2"), F.col("id").alias("b")), "k2").select("a", "b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = resolved_matches(table(spark, sf_dir, "topic_matches"), table(spark, sf_dir, "topics"))
    return boruvka(edges, Scratch(spark)).select("group_id", F.col("node").alias("topic_id"))


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": """WITH RECURSIVE e AS (SELECT coalesce(a.id, x.id) a, coalesce(b.id, y.id) b FROM topic_matches m LEFT JOIN topics a ON a.id = m.topic1_id LEFT JOIN topics x ON m.topic1_id IS NULL AND x.label = m.topic1_label
LEFT JOIN topics b ON b.id = m.topic2_id LEFT JOIN topics y ON m.topic2_id IS NULL AND y.label = m.topic2_label),
u AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
r AS (SELECT a node, a reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT min(reach) AS group_id, node AS topic_id FROM r GROUP BY node"""
}
