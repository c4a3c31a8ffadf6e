"""Graphs as edges (src, dst, weight, type), src < dst, and vertices (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.session import Scratch


def merged_edges(*by_priority: DataFrame) -> DataFrame:
    """The edges of several graphs, each pair once: of several, that of the earlier graph."""
    u = None
    for i, e in enumerate(by_priority):
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "type").withColumn("p", F.lit(i))
        u = e if u is None else u.unionByName(e)
    g = u.groupBy("src", "dst").agg(F.min(F.struct("p", (-F.col("weight")).alias("w"), "type")).alias("m"))
    return g.select("src", "dst", (-F.col("m.w")).alias("weight"), F.col("m.type").alias("type"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight)."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return vertices.select(F.col("id").alias("node")).join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge (src, dst).

    Minimum labels with shortcuts, each round written to the shared folder; logarithmically many rounds on chains.
    """
    scratch = scratch.fresh()
    e = edges.select("src", "dst").where("src <> dst")
    both = scratch.put("cc_edges", e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = scratch.put("cc_labels", both.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct())
    while True:
        low = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("low"))
        step = scratch.put("cc_step", labels.join(low, F.col("node") == F.col("src")).select("node", "component", F.least("component", "low").alias("new")))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        labels = scratch.put("cc_labels", step.join(up, "new").select("node", F.col("up").alias("component"), (F.col("up") < F.col("component")).alias("moved")))
        done = labels.where("moved").isEmpty()
        labels = labels.select("node", "component")
        if done:
            return labels


def graph_stats(vertices: DataFrame, edges: DataFrame, component: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, mean degree, edges by type."""
    v = vertices.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("type") == "cooccurrence").alias("cooccurrence_edges"), F.count_if(F.col("type") != "cooccurrence").alias("embedding_edges"))
    c = component.agg(F.count(F.lit(1)).alias("touched"), F.count_distinct("component").alias("c"))
    one = v.join(e).join(c)  # one row each
    return one.select("nodes", "edges", "cooccurrence_edges", "embedding_edges", (F.col("c") + F.col("nodes") - F.col("touched")).alias("components"), F.round(2 * F.col("edges") / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0)), 9).alias("density"), F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("mean_degree"))


def related(edges: DataFrame, topics: DataFrame, label: str, limit: int = 10) -> DataFrame:
    """(id, label, weight): the strongest neighbours of the topic of that label, else of the most frequent topic whose
    label contains it."""
    rank = F.when(F.lower("label") == label.lower(), 0).otherwise(1)
    start = topics.where(F.lower("label").contains(label.lower())).orderBy(rank, F.desc("occ"), "id").limit(1).select(F.col("id").alias("node"))
    n = both_ways(edges).join(F.broadcast(start), "node")
    return n.join(topics.select(F.col("id").alias("other"), "label"), "other").orderBy(F.desc("weight"), "other").limit(limit).select(F.col("other").alias("id"), "label", "weight")


def disparity_backbone(edges: DataFrame, alpha: float) -> DataFrame:
    """Edges significant at either end: its only edge, or (1 - share of strength)^(degree - 1) < alpha."""
    w = Window.partitionBy("node")
    b = both_ways(edges).select("*", F.count(F.lit(1)).over(w).alias("k"), F.sum("weight").over(w).alias("s"))
    ok = (F.col("k") <= 1) | ((F.col("s") > 0) & (F.pow(1 - F.col("weight") / F.nullif("s", F.lit(0.0)), F.col("k") - 1) < alpha))
    return b.where(ok).select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst"), "weight").distinct()


def participation(vertices: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, participation, internal): 1 - sum of squared shares of neighbours by community, and the own share."""
    m = membership.select("node", "community")
    n = both_ways(edges).join(m.select(F.col("node").alias("other"), F.col("community").alias("c")), "other").groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"))
    n = n.join(m, "node").groupBy("node").agg(F.sum("k").alias("t"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.sum(F.when(F.col("c") == F.col("community"), F.col("k")).otherwise(0)).alias("own"))
    p = vertices.select(F.col("id").alias("node")).join(n, "node", "left")
    return p.select("node", F.coalesce(1 - F.col("sq") / (F.col("t") * F.col("t")), F.lit(0.0)).alias("participation"), F.coalesce(F.col("own") / F.col("t"), F.lit(1.0)).alias("internal"))


def hub_diagnosis(degree: DataFrame) -> DataFrame:
    """One row: least, median, mean, 95th, 99th percentile and greatest degree."""
    q = lambda p, n: F.percentile("degree", F.lit(p)).cast("long").alias(n)
    return degree.agg(F.min("degree").alias("least"), q(0.5, "median"), F.round(F.avg("degree"), 6).alias("mean"), q(0.95, "p95"), q(0.99, "p99"), F.max("degree").alias("most"))


# Labels that join what has nothing in common.
GENERIC_LABELS = [
    "relationships", "technology", "society", "culture", "history", "nature", "life", "death", "love", "war",
    "family", "work", "home", "money", "power", "time", "people", "world", "change", "future", "past", "furniture",
    "food", "travel", "art", "music", "communication", "education", "health", "science", "problem", "solution",
    "idea", "concept", "experience",
]


def top_hubs(degree: DataFrame, topics: DataFrame, n: int = 20) -> DataFrame:
    """(node, label, degree) of the n topics of most neighbours."""
    return degree.join(topics.select(F.col("id").alias("node"), "label"), "node").orderBy(F.desc("degree"), "node").limit(n).select("node", "label", "degree")


def hubs(degree: DataFrame, topics: DataFrame, quantile: float = 0.95, labels: list[str] | None = None, method: str = "both") -> DataFrame:
    """(node): topics of a degree strictly above the quantile ('degree'), with a generic label ('generic'), or either."""
    cut = degree.agg(F.percentile("degree", F.lit(quantile)).alias("cut"))
    d = degree.join(topics.select(F.col("id").alias("node"), "label"), "node").withColumn("cut", cut.scalar())
    many, generic = F.col("degree") > F.col("cut"), F.lower("label").isin(labels or GENERIC_LABELS)
    return d.where({"degree": many, "generic": generic, "both": many | generic}[method]).select("node")


def hub_memberships(edges: DataFrame, hub: DataFrame, primary: DataFrame, most: int = 5, least_weight: float = 3.0) -> DataFrame:
    """(node, community, strength, is_primary): for each hub the communities of its neighbours by summed weight.

    The ``most`` heaviest are taken first and then those under ``least_weight`` dropped; strength is the share of the
    weight to all communities.
    """
    n = both_ways(edges).join(hub, "node").join(primary.where("community >= 0").select(F.col("node").alias("other"), "community"), "other")
    g = n.groupBy("node", "community").agg(F.sum("weight").alias("w"))
    w = Window.partitionBy("node")
    g = g.select("*", F.sum("w").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("w"), "community")).alias("rn")).where((F.col("rn") <= most) & (F.col("w") >= least_weight))
    own = primary.select("node", F.col("community").alias("own"))
    return g.join(own, "node", "left").select("node", "community", (F.col("w") / F.col("total")).alias("strength"), F.coalesce(F.col("community") == F.col("own"), F.lit(False)).alias("is_primary"))


def modal_neighbour(edges: DataFrame, hub: DataFrame, primary: DataFrame) -> DataFrame:
    """(node, community): the most frequent community among each hub's neighbours that are no hubs, -1 without any."""
    n = both_ways(edges).join(hub, "node").join(hub.select(F.col("node").alias("other")), "other", "left_anti").join(primary.select(F.col("node").alias("other"), "community"), "other")
    g = n.groupBy("node", "community").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("node").orderBy(F.desc("k"), "community")
    top = g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("node", "community")
    return hub.join(top, "node", "left").select("node", F.coalesce("community", F.lit(-1).cast("long")).alias("community"))
