"""Queries of community detection, centroids and domains over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigraph.operators import community, domains, graph
from lexigraph.plans import graphs as G
from lexigraph.session import Scratch
from lexigraph.sources import exports

RESOLUTION = 0.05


def members(spark, sf):
    return G.clusters(spark, sf).where("community >= 0")


def domain_members(spark, sf):
    return members(spark, sf).select("node", (F.col("community") % 6).alias("community"))


def g12(spark, sf):
    e, s = G.saved_edges(spark, sf)
    return community.communities(e, s, RESOLUTION)


def g13(spark, sf):
    m = g12(spark, sf).groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return m.select("community", "size")


def g12_modularity(spark, sf):
    e, s = G.saved_edges(spark, sf)
    return community.communities(e, s, 1.0, "modularity")


def g25(spark, sf):
    """The partition of great surprise."""
    e, s = G.saved_edges(spark, sf)
    return community.surprising(e, s)


def checked(spark, edges, members, scratch, quality):
    """One row: nodes, whether each has one community, whether communities hang together, whether ``quality`` of (edges,
    partition) is no less than that of lone nodes and of a single community."""
    m = scratch.put("checked", members.select("node", "community"))
    both = edges.join(m.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    parts = m.join(graph.components(both.where("a = b").select("src", "dst"), scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
    torn = parts.groupBy("community").agg(F.count_distinct("component").alias("n")).where("n > 1").count()
    mine, alone, one = (quality(edges, x) for x in (m, m.select("node", F.col("node").alias("community")), m.select("node", F.lit(0).cast("long").alias("community"))))
    n = m.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node").alias("d"))
    return n.select("nodes", (F.col("nodes") == F.col("d")).alias("once"), F.lit(torn == 0).alias("connected"), F.lit(mine >= max(alone, one) - 1e-6).alias("better"))


def g12_checked(spark, sf):
    e, s = G.saved_edges(spark, sf)
    return checked(spark, e, g12(spark, sf), s, lambda e, m: community.partition_quality(e, m, RESOLUTION).first().cpm)


def g12_modularity_checked(spark, sf):
    e, s = G.saved_edges(spark, sf)
    return checked(spark, e, g12_modularity(spark, sf), s, lambda e, m: community.partition_quality(e, m, 0.0).first().modularity)


def g25_checked(spark, sf):
    e, s = G.saved_edges(spark, sf)
    return checked(spark, e, g25(spark, sf), s, lambda e, m: community.surprise(e, m).first().surprise)


def g24_checked(spark, sf):
    """One row: nodes, whether each has one community, whether each community lies in one of before, whether large ones
    were divided."""
    e, s = G.saved_edges(spark, sf)
    old = G.clusters(spark, sf)
    m = s.put("re", community.recluster(e, old, s, 100, 0.3)).join(old.select("node", F.col("community").alias("old")), "node")
    n = m.groupBy("community").agg(F.count_distinct("old").alias("o"))
    large = old.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n >= 100").select(F.col("community").alias("old"))
    parts = m.join(large, "old").groupBy("old").agg(F.count_distinct("community").alias("p")).agg(F.min("p").alias("p"))
    return m.agg(F.count(F.lit(1)).alias("nodes"), (F.count(F.lit(1)) == F.count_distinct("node")).alias("once")).withColumns({"inside": n.agg(F.max("o")).scalar() == 1, "divided": parts.scalar() > 1})


def x07(spark, sf):
    """The table of a sweep with its marks."""
    e, s = G.saved_edges(spark, sf)
    return community.sweep_table(e, community.sweep(e, s, 0.01, 0.5, 5, 1), s)


def domains_checked(members):
    """A query: clusters with a domain, each once, and whether domains are numbered without a gap."""

    def q(spark, sf):
        m = members(spark, sf).select("id", "domain")
        return m.agg(F.count(F.lit(1)).alias("clusters"), (F.count(F.lit(1)) == F.count_distinct("id")).alias("once"), (F.max("domain") - F.min("domain") + 1 == F.count_distinct("domain")).alias("numbered"))

    return q


def g33(spark, sf):
    """Domains made anew: how many clusters and topics all of them hold, and whether they are in order of their size."""
    d, m = domains.regenerate(G.topics(spark, sf), G.vectors(spark, sf), Scratch(spark), 6)
    after = F.lead("clusters").over(Window.orderBy("id"))  # a row for each domain
    in_order = d.select((F.col("clusters") >= F.coalesce(after, F.lit(0))).alias("ok")).agg(F.min("ok"))
    return d.agg(F.sum("clusters").alias("clusters"), F.sum("topics").alias("topics")).withColumns({"in_order": in_order.scalar(), "members": m.agg(F.count_distinct("cluster_id")).scalar()})


def g34_checked(spark, sf):
    """Clusters on the map, and whether every axis reaches from -1 to 1 and colours go with domains."""
    u = g34(spark, sf)
    ends = [(F.min(x) == -1) & (F.max(x) == 1) for x in "xyz"]
    one = u.groupBy("domain").agg(F.count_distinct("colour").alias("n")).agg(F.max("n"))
    return u.agg(F.count(F.lit(1)).alias("clusters"), (ends[0] & ends[1] & ends[2]).alias("scaled")).withColumn("one_colour", one.scalar() == 1)


def s19(spark, sf):
    """(cluster_id, domain_id, label) of domains written as JSON and loaded again."""
    s = Scratch(spark)
    rows = G.topics(spark, sf).where("cluster_id >= 0").select("cluster_id").distinct().groupBy((F.col("cluster_id") % 6).alias("d")).agg(F.array_sort(F.collect_list("cluster_id")).alias("leiden_cluster_ids"))
    whole = rows.select(F.struct("d", F.concat(F.lit("domain "), "d").alias("label"), "leiden_cluster_ids").alias("x")).agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("value"))  # one JSON document
    whole.write.text(f"{s.root}/domains")
    d, m = exports.load_domains(spark, f"{s.root}/domains")
    return m.join(d.select(F.col("id").alias("domain_id"), "label"), "domain_id").select("cluster_id", "domain_id", "label")


def g19(spark, sf):
    e, s = G.saved_edges(spark, sf)
    r = community.sweep(e, s, 0.01, 0.5, 5, 2)
    return r.groupBy("i", F.round("resolution", 6).alias("resolution")).agg(F.count_distinct("community").alias("communities"), F.count(F.lit(1)).alias("nodes"))


def g20_sweep(spark, sf):
    e, s = G.saved_edges(spark, sf)
    return community.stability(community.sweep(e, s, 0.01, 0.5, 5, 1))


def g20(spark, sf):
    return community.nmi(members(spark, sf), domain_members(spark, sf))


def g21(spark, sf):
    e, _ = G.saved_edges(spark, sf)
    return community.partition_quality(e, G.clusters(spark, sf), 0.01)


NMIS = [0.95, 0.97, 0.5, 0.92, 0.93, 0.99, 0.3, 0.91, 0.88]


def g22(spark, sf):
    return community.plateaus(spark.createDataFrame(list(enumerate(NMIS)), "i int, nmi double"))


def g24(spark, sf):
    e, s = G.saved_edges(spark, sf)
    return community.recluster(e, G.clusters(spark, sf), s, 100, 0.3).groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def cents(spark, sf):
    return domains.centroids(G.topics(spark, sf), G.vectors(spark, sf))


def a27(spark, sf):
    """(id, i, x): every coordinate of every centroid."""
    return cents(spark, sf).select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


def a28(spark, sf):
    """(domain, i, x): every coordinate of the mean of a domain's centroids."""
    d = cents(spark, sf).select((F.col("id") % 6).alias("domain"), F.posexplode("v").alias("i", "x"))
    return d.groupBy("domain", "i").agg(F.round(F.avg("x"), 6).alias("x"), F.count(F.lit(1)).alias("clusters"))


def g29(spark, sf):
    return G.rounded(domains.cluster_graph(cents(spark, sf), 3, 0.1))


def g29_backbone(spark, sf):
    return G.rounded(domains.cluster_graph(cents(spark, sf), 8, 0.1, 0.3))


def g30(spark, sf):
    d = domains.kmeans(cents(spark, sf), 6)
    return domains.domain_labels(G.topics(spark, sf), d)


def g31(spark, sf):
    return domains.super_clusters(cents(spark, sf), Scratch(spark), 0.2, 4, 0.05)


def g32(spark, sf):
    c = cents(spark, sf)
    return domains.split_domain(c, c.select("id", (F.col("id") % 2).cast("int").alias("domain")), 0, 3)


def g34(spark, sf):
    c = cents(spark, sf)
    return domains.universe(c, c.select("id", (F.col("id") % 6).cast("int").alias("domain"))).select("id", "domain", *[F.round(x, 4).alias(x) for x in "xyz"], "colour")


_C = f"""{G.BASE}, ct AS (SELECT t.cluster_id, v, ln(1 + greatest(occ, 1)) w FROM tp t JOIN vec ON vec.id = t.id WHERE t.cluster_id >= 0 AND length(label) >= 4 QUALIFY row_number() OVER (PARTITION BY t.cluster_id ORDER BY greatest(occ, 1) DESC, t.id) <= 15),
cw AS (SELECT cluster_id, i, sum(w * v[i]) / sum(w) x FROM ct, unnest(generate_series(1, 96)) u(i) GROUP BY 1, 2 HAVING count(*) >= 3), ce AS (SELECT cluster_id id, list(x ORDER BY i) v FROM (SELECT cluster_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)) x FROM cw) GROUP BY 1)"""
_CHECKED = f"{G.BASE} SELECT count(DISTINCT node) AS nodes, true AS once, true AS connected, true AS better FROM bw"
_P = "p AS (SELECT i, nmi FROM (VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(NMIS)) + ") t(i, nmi))"
QUERIES = {
    "g12_leiden": g12, "g12_modularity": g12_modularity, "g13_cluster_sizes": g13, "g19_sweep": g19, "g20_stability": g20_sweep, "g20_nmi": g20, "g21_partition_quality": g21, "g22_plateaus": g22, "g24_reclustered": g24,
    "g25_surprise": g25, "g12_leiden_checked": g12_checked, "g12_modularity_checked": g12_modularity_checked, "g25_surprise_checked": g25_checked, "g24_reclustered_checked": g24_checked, "x07_sweep_table": x07, "g29_cluster_backbone": g29_backbone,
    "g30_kmeans_checked": domains_checked(lambda s, d: domains.kmeans(cents(s, d), 6)), "g31_leiden_checked": domains_checked(g31), "g32_split_checked": domains_checked(g32), "g33_regenerated": g33, "g34_universe_checked": g34_checked, "s19_loaded_domains": s19,
    "a27_centroids": a27, "a28_domain_centroids": a28, "g29_cluster_graph": g29, "g30_domains_kmeans": g30, "g31_domains_leiden": g31, "g32_split_domain": g32, "g34_universe": g34,
}
SQL = {
    "g20_nmi": f"{G.BASE}, t AS (SELECT community x, community % 6 y, count(*) k FROM cm WHERE community >= 0 GROUP BY 1, 2), q AS (SELECT k * 1.0 / sum(k) OVER () p, sum(k) OVER (PARTITION BY x) * 1.0 / sum(k) OVER () px, sum(k) OVER (PARTITION BY y) * 1.0 / sum(k) OVER () py FROM t) SELECT round(2 * sum(p * ln(p / (px * py))) / (-sum(p * ln(px)) - sum(p * ln(py))), 6) AS nmi FROM q",
    "g21_partition_quality": f"{G.BASE}, e AS (SELECT g.weight, a.community a, b.community b FROM g JOIN cm a ON a.node = src JOIN cm b ON b.node = dst), i AS (SELECT a c, sum(weight) w, count(*) m FROM e WHERE a = b GROUP BY 1), k AS (SELECT c, sum(weight) k FROM (SELECT a c, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY 1), z AS (SELECT community c, CAST(count(*) AS DOUBLE) n FROM cm GROUP BY 1), t AS (SELECT sum(weight) tw, CAST(count(*) AS DOUBLE) tm FROM g), tn AS (SELECT CAST(count(*) AS DOUBLE) tn FROM cm), x AS (SELECT coalesce(w, 0) w, coalesce(m, 0) m, coalesce(k, 0) k, n * (n - 1) / 2 pr, tw, tm / (tn * (tn - 1) / 2) p, coalesce(m, 0) / nullif(n * (n - 1) / 2, 0) pc FROM z LEFT JOIN i USING (c) LEFT JOIN k USING (c), t, tn) SELECT round(sum(w - 0.01 * pr), 6) AS cpm, round(sum(w - k * k / (4 * tw)), 6) AS modularity, round(sum(CASE WHEN pr > 0 THEN pr * (CASE WHEN pc > 0 THEN pc * ln(pc / p) ELSE 0 END + CASE WHEN pc < 1 THEN (1 - pc) * ln((1 - pc) / (1 - p)) ELSE 0 END) ELSE 0 END), 6) AS significance FROM x",
    "g22_plateaus": f"WITH {_P}, u AS (SELECT *, i - row_number() OVER (ORDER BY i) z FROM p WHERE nmi >= 0.9) SELECT min(i) AS first, max(i) AS last, count(*) AS n, round(avg(nmi), 6) AS mean FROM u GROUP BY z HAVING count(*) >= 2",
    "a27_centroids": f"{_C} SELECT id, CAST(i - 1 AS INTEGER) AS i, round(v[i], 6) AS x FROM ce, unnest(generate_series(1, 96)) u(i)",
    "a28_domain_centroids": f"{_C} SELECT id % 6 AS domain, CAST(i - 1 AS INTEGER) AS i, round(avg(v[i]), 6) AS x, count(*) AS clusters FROM ce, unnest(generate_series(1, 96)) u(i) GROUP BY 1, 2",
    "g12_leiden_checked": _CHECKED, "g12_modularity_checked": _CHECKED, "g25_surprise_checked": _CHECKED,
    "g24_reclustered_checked": "SELECT count(*) AS nodes, true AS once, true AS inside, true AS divided FROM topics",
    "g30_kmeans_checked": f"{_C} SELECT count(*) AS clusters, true AS once, true AS numbered FROM ce", "g31_leiden_checked": f"{_C} SELECT count(*) AS clusters, true AS once, true AS numbered FROM ce", "g32_split_checked": f"{_C} SELECT count(*) AS clusters, true AS once, true AS numbered FROM ce",
    "g33_regenerated": f"{_C} SELECT (SELECT count(*) FROM ce) AS clusters, (SELECT count(*) FROM topics WHERE cluster_id IN (SELECT id FROM ce)) AS topics, true AS in_order, (SELECT count(*) FROM ce) AS members",
    "g34_universe_checked": f"{_C} SELECT count(*) AS clusters, true AS scaled, true AS one_colour FROM ce",
    "s19_loaded_domains": "SELECT DISTINCT cluster_id, cluster_id % 6 AS domain_id, 'domain ' || (cluster_id % 6) AS label FROM topics WHERE cluster_id >= 0",
    "g29_cluster_backbone": f"{_C}, s AS (SELECT a.id i, b.id j, list_cosine_similarity(a.v, b.v) s FROM ce a JOIN ce b ON a.id <> b.id), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) <= 8), e AS (SELECT DISTINCT least(i, j) src, greatest(i, j) dst, round(s, 9) w FROM r WHERE s >= 0.1), b2 AS (SELECT src n, dst o, w FROM e UNION ALL SELECT dst, src, w FROM e), z AS (SELECT *, count(*) OVER (PARTITION BY n) k, sum(w) OVER (PARTITION BY n) t FROM b2) SELECT DISTINCT least(n, o) AS src, greatest(n, o) AS dst, round(w, 6) AS weight, 'similarity' AS type FROM z WHERE k <= 1 OR (t > 0 AND pow(1 - w / t, k - 1) < 0.3)",
    "g29_cluster_graph": f"{_C}, s AS (SELECT a.id i, b.id j, list_cosine_similarity(a.v, b.v) s FROM ce a JOIN ce b ON a.id <> b.id), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) <= 3) SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst, round(s, 6) AS weight, 'similarity' AS type FROM r WHERE s >= 0.1",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
