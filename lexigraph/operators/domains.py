"""Clusters grouped into domains, and their map."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.scoring import hsl_hex
from lexigraph.operators import community, graph, similarity, tables
from lexigraph.session import Scratch


def centroids(topics: DataFrame, vectors: DataFrame, top: int = 15, least: int = 3, min_label: int = 4) -> DataFrame:
    """(id, v): for each cluster the mean of its ``top`` most frequent topics, weighted by log(1 + occurrences), of length 1.

    Topics with short labels are left out, an occurrence of 0 counts as 1; clusters of fewer than ``least`` such topics
    have no centroid.
    """
    t = topics.where((F.col("cluster_id") >= 0) & (F.length("label") >= min_label)).join(vectors, "id").withColumn("o", F.greatest(F.coalesce("occ", F.lit(0)), F.lit(1)))
    w = Window.partitionBy("cluster_id")
    t = t.withColumn("rn", F.row_number().over(w.orderBy(F.desc("o"), "id"))).where(F.col("rn") <= top)
    t = t.select("cluster_id", "v", F.log1p(F.col("o").cast("double")).alias("w"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") >= least)
    d = t.select("cluster_id", "w", F.posexplode("v").alias("i", "x")).groupBy("cluster_id", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    g = d.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a"))
    return g.select(F.col("cluster_id").alias("id"), F.transform("a", lambda e: e["x"] / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("v"))


def cluster_graph(cents: DataFrame, k: int = 8, least: float = 0.3, alpha: float | None = None) -> DataFrame:
    """(src, dst, weight, type) of each cluster's nearest clusters, on request only the significant edges."""
    n = similarity.nearest(cents, k, least)
    e = n.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.round("cosine", 9).alias("weight")).distinct()
    if alpha is not None:
        e = graph.disparity_backbone(e, alpha)
    return e.select("src", "dst", "weight", F.lit("similarity").alias("type"))


def kmeans(cents: DataFrame, n: int, seeds: int = 10, seed: int = 42) -> DataFrame:
    """(id, domain) by k-means, the best of several seeds by cost; no more domains than there are clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = cents.select("id", array_to_vector("v").alias("features")).cache()
    try:
        k = min(n, x.count())
        if k < 2:
            return cents.select("id", F.lit(0).alias("domain"))
        models = [KMeans(k=k, seed=seed + i).fit(x) for i in range(seeds)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        x.unpersist()
    return best.transform(x).select("id", F.col("prediction").alias("domain"))


def reassigned_outliers(membership: DataFrame, edges: DataFrame, most: float = 0.7, least_internal: float = 0.3) -> DataFrame:
    """(node, community) after clusters spread over many domains went to that of their heaviest neighbours, in order
    of their participation; one after the other, as each move counts for the next, in one task.  More than
    MOST_CLUSTERS clusters are an error."""
    if membership.count() > MOST_CLUSTERS:
        raise ValueError("too many clusters to reassign in one task")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {int(a): int(c) for a, c in zip(pdf["node"], pdf["community"])}
        near = {int(a): [(int(o), float(w)) for o, w in zip(os, ws)] for a, os, ws in zip(pdf["node"], pdf["others"], pdf["weights"])}

        def shares(a):
            k: dict[int, int] = {}
            for o, _ in near[a]:
                if o in of:
                    k[of[o]] = k.get(of[o], 0) + 1
            return k

        def spread(a):
            k, t = shares(a), max(1, len(near[a]))
            return 1 - sum((x / t) ** 2 for x in k.values()) if near[a] else 0.0

        first = {a: (spread(a), shares(a).get(of[a], 0) / len(near[a]) if near[a] else 1.0) for a in of}
        for a in sorted(of, key=lambda a: (-first[a][0], a)):
            if first[a][0] > most and first[a][1] < least_internal:
                w: dict[int, float] = {}
                for o, x in near[a]:
                    if o in of:
                        w[of[o]] = w.get(of[o], 0.0) + x
                if w:
                    of[a] = max(sorted(w), key=lambda c: w[c])
        return pd.DataFrame({"node": list(of), "community": list(of.values())})

    n = graph.both_ways(edges).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("other", "weight"))).alias("e"))
    rows = membership.join(n, "node", "left").select("node", "community", F.coalesce(F.col("e.other"), F.array().cast("array<long>")).alias("others"), F.coalesce(F.col("e.weight"), F.array().cast("array<double>")).alias("weights"))
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: task(pdf), "node long, community long")


def super_clusters(cents: DataFrame, scratch: Scratch, resolution: float = 0.1, k: int = 8, least: float = 0.3) -> DataFrame:
    """(id, domain) by Leiden on the graph of clusters, outliers reassigned; clusters without an edge stand alone."""
    scratch = scratch.fresh()
    c = scratch.put("centroids", cents)
    e = scratch.put("cluster_edges", cluster_graph(c, k, least))
    m = community.communities(e, scratch, resolution)
    m = reassigned_outliers(scratch.put("domains", m), e)
    alone = c.select(F.col("id").alias("node")).join(m.select("node"), "node", "left_anti").select("node", (-1 - F.col("node")).alias("community"))
    all_ = scratch.put("super", m.unionByName(alone))
    order = tables.numbered(all_.select("community").distinct(), "domain", [F.col("community")], scratch)
    return all_.join(order, "community").select(F.col("node").alias("id"), F.col("domain").cast("int").alias("domain"))


MOST_CLUSTERS = 1_000_000  # of a graph of clusters that one task reassigns


def apply_labels(domain_of: DataFrame, labels: DataFrame, topics: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(domains, members): domains given the same label become one, numbered from 0 by how many clusters they hold.

    ``labels`` (domain, label) must name every domain, else it is an error.  domains (id, label, clusters, topics, ids),
    members (cluster_id, domain_id).
    """
    unnamed = domain_of.select("domain").distinct().join(labels.where("label is not null").select("domain"), "domain", "left_anti")
    missing = [r.domain for r in unnamed.orderBy("domain").limit(20).collect()]
    if missing:
        raise ValueError(f"domains without a label: {missing}")
    size = topics.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("topics"))
    c = domain_of.join(labels, "domain").join(size.withColumnRenamed("cluster_id", "id"), "id", "left")
    g = c.groupBy("label").agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("topics"), F.lit(0)).alias("topics"), F.array_sort(F.collect_list("id")).alias("ids"))
    d = scratch.put("labelled_domains", tables.numbered(g, "domain_id", [F.desc("clusters"), F.col("label")], scratch, 0))
    members = d.select(F.explode("ids").alias("cluster_id"), "domain_id")
    return d.select(F.col("domain_id").alias("id"), "label", "clusters", "topics", "ids"), members


def regenerate(topics: DataFrame, vectors: DataFrame, scratch: Scratch, n: int = 25, method: str = "kmeans", resolution: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(domains, members) made anew from the clusters: centroids, super-clusters, labels by their topics; see
    ``apply_labels``."""
    c = scratch.put("domain_centroids", centroids(topics, vectors))
    d = scratch.put("super_clusters", kmeans(c, n) if method == "kmeans" else super_clusters(c, scratch, resolution))
    l = domain_labels(topics, d).select("domain", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("domain "), "domain")).alias("label"))
    return apply_labels(d, l, topics, scratch)


def domain_labels(topics: DataFrame, domain_of: DataFrame, n: int = 3, min_label: int = 4) -> DataFrame:
    """(domain, label, clusters): labelled by the ``n`` most frequent topics of its clusters."""
    t = topics.where(F.length("label") >= min_label).join(domain_of.select(F.col("id").alias("cluster_id"), "domain"), "cluster_id")
    s = t.groupBy("domain", "label").agg(F.sum("occ").alias("s")).withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("s"), "label"))).where(F.col("rn") <= n)
    l = s.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("rn", "label"))).alias("a")).select("domain", F.array_join(F.col("a.label"), " / ").alias("label"))
    return domain_of.groupBy("domain").agg(F.count(F.lit(1)).alias("clusters")).join(l, "domain", "left")


def split_domain(cents: DataFrame, domain_of: DataFrame, domain: int, parts: int) -> DataFrame:
    """(id, domain) with one domain divided by k-means; its parts are numbered after the last one."""
    inside = cents.join(domain_of.where(F.col("domain") == domain).select("id"), "id")
    last = domain_of.agg(F.max("domain")).first()[0]
    p = kmeans(inside, parts).select("id", F.when(F.col("domain") == 0, domain).otherwise(F.col("domain") + last).alias("part"))
    return domain_of.join(p, "id", "left").select("id", F.coalesce("part", "domain").alias("domain"))


def universe(cents: DataFrame, domain_of: DataFrame) -> DataFrame:
    """(id, domain, x, y, z, colour): the clusters in three dimensions (principal components in place of a manifold
    projection), each axis scaled to -1..1, coloured by the place of their domain's mean centroid on the first component of these."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    c = cents.select("id", array_to_vector("v").alias("f"))
    p = PCA(k=3, inputCol="f", outputCol="p").fit(c).transform(c).select("id", vector_to_array("p").alias("p"))
    w = Window.partitionBy(F.lit(0))  # one row for each cluster
    scaled = lambda i: F.coalesce(-1 + 2 * (F.col("p")[i] - F.min(F.col("p")[i]).over(w)) / F.nullif(F.max(F.col("p")[i]).over(w) - F.min(F.col("p")[i]).over(w), F.lit(0.0)), F.lit(0.0))
    s = p.select("id", scaled(0).alias("x"), scaled(1).alias("y"), scaled(2).alias("z")).join(domain_of, "id", "left")
    dims = cents.select(F.posexplode("v").alias("i", "x"), "id").join(domain_of, "id").groupBy("domain", "i").agg(F.avg("x").alias("x"))
    mean = dims.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v")).select("domain", array_to_vector("v").alias("f"))
    d = (PCA(k=1, inputCol="f", outputCol="p").fit(mean).transform(mean).select("domain", vector_to_array("p")[0].alias("m")) if mean.limit(2).count() > 1 else mean.select("domain", F.lit(0.0).alias("m"))).where("domain is not null")
    place = F.coalesce((F.col("m") - F.min("m").over(w)) / F.nullif(F.max("m").over(w) - F.min("m").over(w), F.lit(0.0)), F.lit(0.5))
    colours = d.select("domain", hsl_hex(330 * place).alias("colour"))
    return s.join(colours, "domain", "left").select("id", F.coalesce("domain", F.lit(-1)).alias("domain"), "x", "y", "z", F.coalesce("colour", F.lit("#888888")).alias("colour"))
