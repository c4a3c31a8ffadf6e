"""Queries of the vector and graph operators over the test tables, with their SQL.

The communities used where an operator needs some are topics.cluster_id as delivered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import scoring
from lexigraph.functions import vectors as V
from lexigraph.operators import cooccurrence, dedup, graph, similarity, tables
from lexigraph.plans.relational import DUCK, model
from lexigraph.session import Scratch, table

DIM = 96
KNN, KNN_LEAST, COOC_LEAST, PMI_LEAST = 10, 0.65, 5, 0.0
FULL, DEDUP, SURE, ALPHA = 0.5, 0.85, 0.95, 0.05


def links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_topic_links").select("chunk_id", "topic_id").dropna().distinct()


def topics(spark: SparkSession, sf: str) -> DataFrame:
    o = links(spark, sf).groupBy("topic_id").agg(F.count(F.lit(1)).alias("occ"))
    t = table(spark, sf, "topics").select("id", "label", "cluster_id")
    return t.join(o, t.id == o.topic_id, "left").select("id", "label", "cluster_id", F.coalesce("occ", F.lit(0)).cast("long").alias("occ"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").where(V.usable(F.col("embedding"), DIM)).select("id", F.col("embedding").alias("v"))


def g01(spark, sf):
    p = cooccurrence.cooccurrences(links(spark, sf), table(spark, sf, "chunks"), 2)
    return p.withColumn("pmi", F.round("pmi", 6))


def cooc_edges(spark, sf, boost=False):
    return cooccurrence.cooccurrence_edges(cooccurrence.cooccurrences(links(spark, sf), table(spark, sf, "chunks") if boost else None, COOC_LEAST), COOC_LEAST, PMI_LEAST, boost)


def knn_edges(spark, sf):
    n = similarity.nearest(vectors(spark, sf), KNN, KNN_LEAST)
    return n.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.greatest(F.round("cosine", 9), F.lit(0.1)).alias("weight"), F.lit("embedding_knn").alias("type")).distinct()


def g02(spark, sf):
    e = similarity.similar_pairs(vectors(spark, sf), FULL).select(F.col("id1").alias("src"), F.col("id2").alias("dst"), F.col("cosine").alias("weight"), F.lit("embedding").alias("type"))
    return rounded(graph.merged_edges(e, cooc_edges(spark, sf)))


def g04_edges(spark, sf):
    return graph.merged_edges(cooc_edges(spark, sf, True), knn_edges(spark, sf))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ["weight"]})


def vertices(spark, sf):
    return table(spark, sf, "topics").select("id")


def clusters(spark, sf):
    return table(spark, sf, "topics").select(F.col("id").alias("node"), F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("community"))


_saved: dict[tuple, DataFrame] = {}


def saved_edges(spark, sf) -> tuple[DataFrame, Scratch]:
    """The graph of co-occurrences and nearest neighbours, written once for a session and state of its tables."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    state = [p(f"{sf}/{t}.parquet") for t in ("topics", "chunks", "chunk_topic_links")]
    key = (spark.sparkContext.applicationId, sf, *(x.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(x).getModificationTime() for x in state))
    s = Scratch(spark)
    if key not in _saved:
        _saved[key] = s.put("graph", g04_edges(spark, sf))
    return _saved[key], s


def g05(spark, sf):
    e, s = saved_edges(spark, sf)
    return graph.graph_stats(vertices(spark, sf), e, graph.components(e, s))


def g06(spark, sf):
    return rounded(graph.related(saved_edges(spark, sf)[0], topics(spark, sf), "memory and loss"))


def g07(spark, sf):
    return graph.hub_diagnosis(graph.degrees(vertices(spark, sf), saved_edges(spark, sf)[0]))


def g07_top(spark, sf):
    """The twenty topics of most neighbours."""
    d = graph.degrees(vertices(spark, sf), saved_edges(spark, sf)[0])
    return graph.top_hubs(d, topics(spark, sf), 20)


def g08_by(method):
    return lambda spark, sf: graph.hubs(graph.degrees(vertices(spark, sf), saved_edges(spark, sf)[0]), topics(spark, sf), method=method)


def hub_nodes(spark, sf, e):
    return graph.hubs(graph.degrees(vertices(spark, sf), e), topics(spark, sf))


def g08(spark, sf):
    return hub_nodes(spark, sf, saved_edges(spark, sf)[0])


def g09(spark, sf):
    e, s = saved_edges(spark, sf)
    return graph.modal_neighbour(e, s.put("hubs", hub_nodes(spark, sf, e)), clusters(spark, sf))


def g10(spark, sf):
    e, s = saved_edges(spark, sf)
    return rounded(graph.hub_memberships(e, s.put("hubs", hub_nodes(spark, sf, e)), clusters(spark, sf)), "strength")


def g14(spark, sf):
    e = similarity.similar_pairs(vectors(spark, sf), DEDUP)
    return graph.components(e.select(F.col("id1").alias("src"), F.col("id2").alias("dst")), Scratch(spark))


def topic_books(spark, sf):
    return links(spark, sf).join(table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "book_id"), "chunk_id").select("topic_id", "book_id").distinct()


def g15(spark, sf):
    return dedup.duplicate_groups(vectors(spark, sf), topics(spark, sf), topic_books(spark, sf), Scratch(spark), DEDUP, SURE)


def g17(spark, sf):
    return dedup.merge_groups(links(spark, sf), g15(spark, sf))


def g18(spark, sf):
    return dedup.merge_preview(g15(spark, sf), topics(spark, sf))


def g27(spark, sf):
    return rounded(graph.disparity_backbone(saved_edges(spark, sf)[0], ALPHA))


def g28(spark, sf):
    return rounded(graph.participation(vertices(spark, sf), saved_edges(spark, sf)[0], clusters(spark, sf)), "participation", "internal")


def j05(spark, sf):
    return similarity.similar_pairs(vectors(spark, sf), FULL).withColumn("cosine", F.round("cosine", 6))


def j06(spark, sf):
    return similarity.nearest(vectors(spark, sf), KNN).select("id", "other", F.round("cosine", 6).alias("cosine"), "place")


def query_vector(spark, sf) -> list[float]:
    return vectors(spark, sf).orderBy("id").first().v


def q03(spark, sf):
    """The topics most similar to the first usable one."""
    n = similarity.search(vectors(spark, sf), query_vector(spark, sf), 20)
    return n.join(topics(spark, sf).select("id", "label"), "id").select("id", "label", F.round("similarity", 6).alias("similarity"))


def near_topics(spark, sf, k):
    """(topic_id, label, cluster_id, similarity) of the k topics most similar to the query."""
    n = similarity.search(vectors(spark, sf), query_vector(spark, sf), k).select(F.col("id").alias("topic_id"), "similarity")
    return topics(spark, sf).select(F.col("id").alias("topic_id"), "label", "cluster_id").join(F.broadcast(n), "topic_id")


def q02(spark, sf):
    """Books by the similarity of the nearest topic they hold, of three times as many topics as books wanted."""
    n = near_topics(spark, sf, 60)
    b = topic_books(spark, sf).join(F.broadcast(n), "topic_id").groupBy("book_id").agg(F.greatest(F.lit(0.0), F.round(F.max("similarity"), 3)).alias("score"))
    b = b.join(table(spark, sf, "books").select(F.col("id").alias("book_id"), "title", "author"), "book_id")
    return b.orderBy(F.desc("score"), "book_id").limit(20)


def q04(spark, sf):
    """Books by the number of topics they hold of the 50 most similar to the query, with those topics."""
    n = near_topics(spark, sf, 50)
    b = topic_books(spark, sf).join(F.broadcast(n), "topic_id").groupBy("book_id").agg(F.count(F.lit(1)).alias("matches"), F.round(F.max("similarity"), 6).alias("relevance"), F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("labels"))
    return b.orderBy(F.desc("matches"), "book_id").limit(20)


def q05(spark, sf):
    """Clusters by the topics they hold of the 100 most similar to the query, with the best of them."""
    n = near_topics(spark, sf, 100).where("cluster_id >= 0")
    return n.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("matches"), F.round(F.max("similarity"), 6).alias("best"), F.max_by("label", F.struct(F.round("similarity", 12), -F.col("topic_id"))).alias("best_topic"))


def q12(spark, sf):
    """The topics that most often occur with one."""
    t = topics(spark, sf).where("label = 'memory and loss'").select("id")
    return cooccurrence.occurring_with(links(spark, sf), t).withColumn("pmi", F.round("pmi", 6))


def e08(spark, sf):
    """The topics most similar to the first one, by the stored index of all vectors."""
    path = Scratch(spark).root
    similarity.write_index(vectors(spark, sf), f"{path}/index", 256)
    n = similarity.search_index(spark, f"{path}/index", query_vector(spark, sf), 20)
    return n.select("id", F.round("similarity", 6).alias("similarity"))


def m02(spark, sf):
    return vectors(spark, sf).select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.normalized(F.col("v"))[0], 6).alias("x"))


def m08(spark, sf):
    return clusters(spark, sf).select("community").where("community >= 0").distinct().select("community", scoring.hsl_hex(F.col("community") * 7.0 % 330).alias("colour"))


def m09(spark, sf):
    c = clusters(spark, sf).where("community >= 0").groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return c.select("community", F.round(scoring.sphere_scale(F.col("n"), c.agg(F.max("n")).scalar()), 6).alias("scale"))


def authors(spark, sf):
    return table(spark, sf, "books").select("id", F.explode(F.split("author", r"\s*(?:&|;| and )\s*")).alias("name")).where("name <> ''")


def s15(spark, sf):
    return tables.dimension(authors(spark, sf), "name", Scratch(spark))


def s15_bridge(spark, sf):
    """(book_id, author_id): the authors of every book."""
    a = authors(spark, sf).withColumnRenamed("id", "book_id")
    return tables.bridge(a, "book_id", "name", tables.dimension(a, "name", Scratch(spark))).withColumnRenamed("id", "author_id")


def s22(spark, sf):
    """(id, themes): the themes of every book, saved anew for even ids; none is an empty list."""
    b = table(spark, sf, "books").select("id", "series", "publisher")
    old = b.where("series is not null").select("id", F.to_json(F.array("series")).alias("themes"))
    new = b.where("id % 2 = 0 and publisher is not null").select("id", F.to_json(F.array(F.lower("publisher"))).alias("themes"))
    return tables.themes_of(b.select("id"), tables.last_wins(old, new, ["id"])).select("id", F.array_join("themes", "; ").alias("themes"))


def s20(spark, sf):
    """Chunks of one book replaced by new ones."""
    c = table(spark, sf, "chunks").select("id", "book_id", "chunk_index", "word_count")
    new = c.where("book_id = 1 AND chunk_index < 5").withColumn("word_count", F.lit(7).cast("long"))
    return tables.replace_group(c, new, ["book_id"])


def s23(spark, sf):
    """Counts of pairs upserted: the later run wins."""
    p = cooccurrence.cooccurrences(links(spark, sf), None, 3).select("topic1_id", "topic2_id", "count")
    return tables.last_wins(p, p.where("topic1_id % 2 = 0").withColumn("count", F.col("count") + 100), ["topic1_id", "topic2_id"])


def s24(spark, sf):
    """Labels gained from raw topics, first wins."""
    t = table(spark, sf, "topics").select("label")
    raw = table(spark, sf, "chunk_topics").select(F.trim("topic").alias("label")).where("label <> ''")
    return tables.first_wins(t, raw, ["label"])


def a30(spark, sf):
    """How well the topics of even and odd ids cover each other."""
    v = vectors(spark, sf)
    return rounded(similarity.set_overlap(v.where("id % 2 = 0"), v.where("id % 2 = 1")), "precision", "recall", "f1")


_U = "CAST(embedding AS DOUBLE[]) v FROM topics WHERE len(embedding) = 96 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
BASE = f"""{model(DUCK)}, vec AS (SELECT id, {_U}), n AS (SELECT count(DISTINCT chunk_id) n FROM lk), o AS (SELECT topic_id t, count(*) k FROM lk GROUP BY 1),
pc AS (SELECT a.topic_id a, b.topic_id b, count(*) c FROM lk a JOIN lk b ON a.chunk_id = b.chunk_id AND a.topic_id < b.topic_id GROUP BY 1, 2),
pm AS (SELECT a, b, c, ln(CAST(c AS DOUBLE) * n / (x.k * y.k)) pmi FROM pc JOIN o x ON x.t = a JOIN o y ON y.t = b CROSS JOIN n),
tb AS (SELECT DISTINCT topic_id, book_id FROM bt), bc AS (SELECT a, b, count(*) bc FROM pm JOIN tb x ON x.topic_id = a JOIN tb y ON y.topic_id = b AND y.book_id = x.book_id WHERE c >= 2 GROUP BY 1, 2),
sim AS MATERIALIZED (SELECT a.id i, b.id j, list_cosine_similarity(a.v, b.v) s FROM vec a JOIN vec b ON a.id <> b.id),
knn AS (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) place FROM sim),
ec AS MATERIALIZED (SELECT a src, b dst, greatest(CASE WHEN pmi <> 0 THEN pmi ELSE ln(c + 1) END, 0.1) w, greatest(CASE WHEN pmi <> 0 THEN pmi ELSE ln(c + 1) END * (1 + ln(1 + coalesce(bc, 0))), 0.1) wb FROM pm LEFT JOIN bc USING (a, b) WHERE c >= {COOC_LEAST} AND pmi >= {PMI_LEAST}),
ek AS (SELECT DISTINCT least(i, j) src, greatest(i, j) dst, greatest(round(s, 9), 0.1) w FROM knn WHERE place <= {KNN} AND s >= {KNN_LEAST}),
g AS MATERIALIZED (SELECT src, dst, wb weight, 'cooccurrence' AS type FROM ec UNION ALL SELECT src, dst, max(w), 'embedding_knn' FROM ek WHERE NOT EXISTS (SELECT 1 FROM ec WHERE ec.src = ek.src AND ec.dst = ek.dst) GROUP BY 1, 2),
bw AS (SELECT src node, dst other, weight FROM g UNION ALL SELECT dst, src, weight FROM g), dg AS (SELECT t.id node, count(other) degree FROM topics t LEFT JOIN bw ON bw.node = t.id GROUP BY 1),
hub AS (SELECT node FROM dg JOIN topics t ON t.id = node WHERE degree > (SELECT quantile_cont(degree, 0.95) FROM dg) OR lower(label) IN ({', '.join(repr(x) for x in graph.GENERIC_LABELS)})),
cm AS (SELECT id node, coalesce(cluster_id, -1) community FROM topics)
"""
# Components: labels fall until none falls further, a row kept for each node.
_CC = "r(node, reach) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.a, min(r.reach) FROM r JOIN u ON u.b = r.node JOIN recurring.r c ON c.node = u.a WHERE r.reach < c.reach GROUP BY u.a)"
_DUP = f"""{BASE.replace('WITH lk', 'WITH RECURSIVE lk', 1)}, e AS (SELECT i a, j b FROM sim WHERE s >= {DEDUP} AND (s >= {SURE} OR EXISTS (SELECT 1 FROM tb x JOIN tb y ON x.book_id = y.book_id WHERE x.topic_id = i AND y.topic_id = j))), u AS (SELECT a, b FROM e), {_CC},
cp AS (SELECT node, min(reach) component FROM r GROUP BY 1), dp AS (SELECT node topic_id, first_value(node) OVER (PARTITION BY component ORDER BY occ DESC, node) canonical_id FROM cp JOIN tp ON tp.id = node)"""
_QV = "(SELECT v FROM vec ORDER BY id LIMIT 1)"
_TOP = f"top AS (SELECT id, s FROM (SELECT id, list_cosine_similarity(v, {_QV}) s FROM vec) ORDER BY round(s, 12) DESC, id LIMIT %d)"

QUERIES = {
    "g01_cooccurrence": g01, "g02_full_graph": g02, "g03_cooccurrence_graph": lambda s, d: rounded(cooc_edges(s, d)), "g04_knn_graph": lambda s, d: rounded(g04_edges(s, d)), "g05_graph_stats": g05, "g06_related_topics": g06,
    "g07_hub_diagnosis": g07, "g08_hubs": g08, "g09_hub_assignment": g09, "g10_hub_memberships": g10, "g14_components": g14, "g15_duplicate_groups": g15, "g17_merged_links": g17, "g18_merge_preview": g18, "g27_backbone": g27, "g28_participation": g28,
    "g07_top_hubs": g07_top, "g08_hubs_by_degree": g08_by("degree"), "g08_hubs_by_label": g08_by("generic"), "q02_semantic_search": q02, "e08_vector_index": e08, "s15_author_bridge": s15_bridge, "s22_book_themes": s22,
    "j05_similar_pairs": j05, "j06_nearest_neighbours": j06, "q03_semantic_topics": q03, "q04_semantic_books": q04, "q05_theme_search": q05, "q12_cooccurring_topics": q12, "m02_normalized": m02, "m08_colours": m08, "m09_sphere_scale": m09,
    "a30_set_overlap": a30, "s15_author_dimension": s15, "s20_replaced_chunks": s20, "s23_upserted_pairs": s23, "s24_labels_first_wins": s24,
}
SQL = {
    "g01_cooccurrence": f"{BASE} SELECT a AS topic1_id, b AS topic2_id, c AS count, round(pmi, 6) AS pmi, coalesce(bc, 0) AS book_count FROM pm LEFT JOIN bc USING (a, b) WHERE c >= 2",
    "g02_full_graph": f"{BASE} SELECT i AS src, j AS dst, round(s, 6) AS weight, 'embedding' AS type FROM sim WHERE i < j AND s >= {FULL} UNION ALL SELECT src, dst, round(w, 6), 'cooccurrence' FROM ec WHERE NOT EXISTS (SELECT 1 FROM sim WHERE i = src AND j = dst AND s >= {FULL})",
    "g03_cooccurrence_graph": f"{BASE} SELECT src, dst, round(w, 6) AS weight, 'cooccurrence' AS type FROM ec",
    "g04_knn_graph": f"{BASE} SELECT src, dst, round(weight, 6) AS weight, type FROM g",
    "g05_graph_stats": f"{BASE.replace('WITH lk', 'WITH RECURSIVE lk', 1)}, u AS (SELECT node a, other b FROM bw), {_CC}, cp AS (SELECT node, min(reach) c FROM r GROUP BY 1), x AS (SELECT count(*) e, count(*) FILTER (type = 'cooccurrence') ce FROM g), nn AS (SELECT count(*) n FROM topics), k AS (SELECT count(*) t, count(DISTINCT c) c FROM cp) SELECT n AS nodes, e AS edges, ce AS cooccurrence_edges, e - ce AS embedding_edges, c + n - t AS components, round(2.0 * e / (n * (n - 1)), 9) AS density, round(CAST(2 * e AS DOUBLE) / n, 6) AS mean_degree FROM x, nn, k",
    "g06_related_topics": f"{BASE}, st AS (SELECT id FROM tp WHERE lower(label) LIKE '%memory and loss%' ORDER BY CASE WHEN lower(label) = 'memory and loss' THEN 0 ELSE 1 END, occ DESC, id LIMIT 1) SELECT t.id, t.label, round(weight, 6) AS weight FROM bw JOIN st ON st.id = node JOIN tp t ON t.id = other ORDER BY bw.weight DESC, other LIMIT 10",
    "g07_hub_diagnosis": f"{BASE} SELECT min(degree) AS least, CAST(floor(quantile_cont(degree, 0.5)) AS BIGINT) AS median, round(avg(degree), 6) AS mean, CAST(floor(quantile_cont(degree, 0.95)) AS BIGINT) AS p95, CAST(floor(quantile_cont(degree, 0.99)) AS BIGINT) AS p99, max(degree) AS most FROM dg",
    "g08_hubs": f"{BASE} SELECT node FROM hub",
    "g09_hub_assignment": f"{BASE}, x AS (SELECT h.node, community, count(*) k FROM hub h JOIN bw USING (node) JOIN cm ON cm.node = other WHERE other NOT IN (SELECT node FROM hub) GROUP BY 1, 2) SELECT h.node, coalesce(y.community, -1) AS community FROM hub h LEFT JOIN (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY node ORDER BY k DESC, community) = 1) y ON y.node = h.node",
    "g10_hub_memberships": f"{BASE}, x AS (SELECT h.node, c.community, sum(weight) w FROM hub h JOIN bw USING (node) JOIN cm c ON c.node = other WHERE c.community >= 0 GROUP BY 1, 2), y AS (SELECT *, sum(w) OVER (PARTITION BY node) t, row_number() OVER (PARTITION BY node ORDER BY w DESC, community) rn FROM x) SELECT y.node, y.community, round(w / t, 6) AS strength, (y.community = cm.community) AS is_primary FROM y JOIN cm ON cm.node = y.node WHERE rn <= 5 AND w >= 3",
    "g14_components": f"{BASE.replace('WITH lk', 'WITH RECURSIVE lk', 1)}, u AS (SELECT i a, j b FROM sim WHERE s >= {DEDUP}), {_CC} SELECT node, min(reach) AS component FROM r GROUP BY 1",
    "g15_duplicate_groups": f"{_DUP} SELECT topic_id, canonical_id FROM dp",
    "g17_merged_links": f"{_DUP} SELECT DISTINCT chunk_id, coalesce(canonical_id, lk.topic_id) AS topic_id FROM lk LEFT JOIN dp ON dp.topic_id = lk.topic_id",
    "g18_merge_preview": f"{_DUP} SELECT canonical_id, tp.label, count(*) AS size FROM dp JOIN tp ON tp.id = canonical_id GROUP BY 1, 2 ORDER BY size DESC, canonical_id LIMIT 20",
    "g27_backbone": f"{BASE}, x AS (SELECT *, count(*) OVER (PARTITION BY node) k, sum(weight) OVER (PARTITION BY node) s FROM bw) SELECT DISTINCT least(node, other) AS src, greatest(node, other) AS dst, round(weight, 6) AS weight FROM x WHERE k <= 1 OR (s > 0 AND pow(1 - weight / s, k - 1) < {ALPHA})",
    "g28_participation": f"{BASE}, x AS (SELECT bw.node, c.community cc, count(*) k FROM bw JOIN cm c ON c.node = other GROUP BY 1, 2), y AS (SELECT x.node, sum(k) t, sum(k * k) sq, coalesce(sum(k) FILTER (cc = cm.community), 0) own FROM x JOIN cm ON cm.node = x.node GROUP BY 1) SELECT t.id AS node, coalesce(round(1 - CAST(sq AS DOUBLE) / (y.t * y.t), 6), 0) AS participation, coalesce(round(CAST(own AS DOUBLE) / y.t, 6), 1) AS internal FROM topics t LEFT JOIN y ON y.node = t.id",
    "a30_set_overlap": f"{BASE}, x AS (SELECT i, max(s) b FROM sim WHERE i % 2 = 0 AND j % 2 = 1 GROUP BY 1), y AS (SELECT i, max(s) b FROM sim WHERE i % 2 = 1 AND j % 2 = 0 GROUP BY 1), z AS (SELECT (SELECT avg(b) FROM x) p, (SELECT avg(b) FROM y) r, (SELECT count(*) FROM x WHERE b > 0.8) st) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, st AS strong FROM z",
    "j05_similar_pairs": f"{BASE} SELECT i AS id1, j AS id2, round(s, 6) AS cosine FROM sim WHERE i < j AND s >= {FULL}",
    "j06_nearest_neighbours": f"{BASE} SELECT i AS id, j AS other, round(s, 6) AS cosine, place FROM knn WHERE place <= {KNN}",
    "g07_top_hubs": f"{BASE} SELECT dg.node, tp.label, dg.degree FROM dg JOIN tp ON tp.id = dg.node ORDER BY degree DESC, node LIMIT 20",
    "g08_hubs_by_degree": f"{BASE} SELECT node FROM dg WHERE degree > (SELECT quantile_cont(degree, 0.95) FROM dg)",
    "g08_hubs_by_label": f"{BASE} SELECT id AS node FROM topics WHERE lower(label) IN ({', '.join(repr(x) for x in graph.GENERIC_LABELS)})",
    "q02_semantic_search": f"{BASE}, {_TOP % 60} SELECT book_id, title, author, greatest(0.0, round(max(s), 3)) AS score FROM tb JOIN top ON top.id = topic_id JOIN books b ON b.id = book_id GROUP BY ALL ORDER BY score DESC, book_id LIMIT 20",
    "e08_vector_index": f"{BASE}, {_TOP % 20} SELECT id, round(s, 6) AS similarity FROM top",
    "s15_author_bridge": "WITH a AS (SELECT DISTINCT id, unnest(regexp_split_to_array(author, '\\s*(?:&|;| and )\\s*')) AS name FROM books), n AS (SELECT row_number() OVER (ORDER BY name) AS author_id, name FROM (SELECT DISTINCT name FROM a WHERE name <> '')) SELECT id AS book_id, author_id FROM a JOIN n USING (name)",
    "s22_book_themes": "SELECT id, CASE WHEN id % 2 = 0 AND publisher IS NOT NULL THEN lower(publisher) ELSE coalesce(series, '') END AS themes FROM books",
    "m08_colours": "WITH c AS (SELECT DISTINCT cluster_id community, fmod(cluster_id * 7.0, 330) h FROM topics WHERE cluster_id >= 0), k AS (SELECT community, fmod(0 + h / 30, 12) r, fmod(8 + h / 30, 12) g, fmod(4 + h / 30, 12) b FROM c) SELECT community, '#' || " + " || ".join(f"lpad(lower(to_hex(CAST(floor(255 * (0.6 - 0.7 * 0.4 * greatest(-1.0, least({x} - 3, 9 - {x}, 1.0))) + 1e-9) AS BIGINT))), 2, '0')" for x in "rgb") + " AS colour FROM k",
    "q03_semantic_topics": f"{BASE}, {_TOP % 20} SELECT top.id, label, round(s, 6) AS similarity FROM top JOIN topics t ON t.id = top.id",
    "q04_semantic_books": f"{BASE}, {_TOP % 50} SELECT book_id, count(*) AS matches, round(max(s), 6) AS relevance, string_agg(DISTINCT tp.label, '; ' ORDER BY tp.label) AS labels FROM tb JOIN top ON top.id = topic_id JOIN tp ON tp.id = topic_id GROUP BY 1 ORDER BY matches DESC, book_id LIMIT 20",
    "q05_theme_search": f"{BASE}, {_TOP % 100} SELECT cluster_id, count(*) AS matches, round(max(s), 6) AS best, arg_max(label, row(round(s, 12), -t.id)) AS best_topic FROM top JOIN topics t ON t.id = top.id WHERE cluster_id >= 0 GROUP BY 1",
    "q12_cooccurring_topics": f"{BASE}, q AS (SELECT id FROM topics WHERE label = 'memory and loss') SELECT CASE WHEN a = q.id THEN b ELSE a END AS id, c AS count, round(pmi, 6) AS pmi FROM pm JOIN q ON a = q.id OR b = q.id ORDER BY c DESC, CASE WHEN a = q.id THEN b ELSE a END LIMIT 20",
    "m02_normalized": f"{BASE} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x FROM vec",
    "m09_sphere_scale": "SELECT cluster_id AS community, round(0.2 + 0.8 * sqrt(CAST(count(*) AS DOUBLE) / max(count(*)) OVER ()), 6) AS scale FROM topics WHERE cluster_id >= 0 GROUP BY 1",
    "s15_author_dimension": "SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT unnest(regexp_split_to_array(author, '\\s*(?:&|;| and )\\s*')) AS name FROM books) WHERE name <> ''",
    "s20_replaced_chunks": "SELECT id, book_id, chunk_index, CASE WHEN book_id = 1 THEN 7 ELSE word_count END AS word_count FROM chunks WHERE book_id <> 1 OR chunk_index < 5",
    "s23_upserted_pairs": f"{BASE} SELECT a AS topic1_id, b AS topic2_id, CASE WHEN a % 2 = 0 THEN c + 100 ELSE c END AS count FROM pc WHERE c >= 3",
    "s24_labels_first_wins": "SELECT label FROM topics UNION SELECT trim(topic) FROM chunk_topics WHERE trim(topic) <> ''",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
