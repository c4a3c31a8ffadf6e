"""Pipelines: documents to chunks to topics, and topics to clusters and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import chunking, text
from lexigraph.functions import vectors as V
from lexigraph.operators import community, cooccurrence, dedup, graph, matching, similarity, tables
from lexigraph.plans import relational, statistics
from lexigraph.session import Scratch, table
from lexigraph.sources import documents, models

LEAST_WORDS = 100


def gated(docs: DataFrame, most_words: int | None = None) -> DataFrame:
    """``docs`` (id, text) with words and status: 'ok', 'too short' or 'too long'; nothing raises."""
    d = docs.withColumn("words", text.word_count(F.col("text")))
    s = F.when(F.col("words") < LEAST_WORDS, "too short")
    return d.withColumn("status", (s.when(F.col("words") > most_words, "too long") if most_words else s).otherwise("ok"))


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks without topics: what is left to do when a run resumes."""
    return chunks.join(done.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")


def index_documents(docs: DataFrame, done: DataFrame | None = None, extractor: models.Extractor = models.key_phrases, target: int = chunking.TARGET_WORDS, most_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, chunk_topics): accepted documents cut into chunks, and the normalised topics of the chunks not done."""
    ok = gated(docs, most_words).where("status = 'ok'")
    chunks = chunking.chunked(ok, "id", "text", target).select(F.xxhash64("id", "chunk_index").alias("id"), F.col("id").alias("book_id"), "chunk_index", "text", "word_count")
    todo = pending(chunks, done) if done is not None else chunks
    t = models.extract_topics(todo, extractor).select("chunk_id", F.explode(text.filter_topics(F.col("topics"))).alias("topic")).distinct()
    return chunks, t


def normalized_topics(chunk_topics: DataFrame, known: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(topics, links): raw topics in normal form, each label once, with ids after the known ones; idempotent."""
    raw = chunk_topics.select("chunk_id", text.normalize_topic(F.col("topic")).alias("label")).where("label is not null").distinct()
    fresh = raw.select("label").distinct().join(known.select("label"), "label", "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = tables.numbered(fresh, "id", [F.col("label")], scratch, last.scalar() + 1).select("id", "label")
    ids = known.select("id", "label").unionByName(new)
    links = raw.join(ids, "label").select("chunk_id", F.col("id").alias("topic_id")).distinct()
    occ = links.groupBy("topic_id").agg(F.count(F.lit(1)).alias("occ"))
    topics = ids.join(occ, ids.id == occ.topic_id, "left").select("id", "label", F.coalesce("occ", F.lit(0)).cast("long").alias("occ"))
    return topics, links


def embedded(topics: DataFrame, have: DataFrame, embedder: models.Embedder = models.hashed_grams, force: bool = False) -> DataFrame:
    """(id, v) of all topics; only those without a vector are embedded, with ``force`` all."""
    if force:
        have = have.limit(0)
    todo = topics.join(have.select("id"), "id", "left_anti")
    return have.select("id", "v").unionByName(models.embed(todo, embedder).select("id", F.col("embedding").alias("v")))


def clustered(links: DataFrame, chunks: DataFrame, topics: DataFrame, vectors: DataFrame, scratch: Scratch, mode: str = "knn", kind: str = "cpm", resolution: float = 0.001, k: int = 10, least: float = 0.65, min_count: int = 5, min_pmi: float = 0.0, remove_hubs: bool = False, hub_quantile: float = 0.95, hub_method: str = "both", sample: int | None = None) -> dict[str, DataFrame]:
    """edges, membership (node, community), memberships of hubs and sizes; nothing is stored, so a dry run is to look.

    ``mode``: 'knn', 'cooccurrence' or 'full' graph; ``kind``: 'cpm', 'modularity' or 'surprise'.  Hubs are left out of
    the partition and go to the community of most of their neighbours, -1 without any.  ``sample`` takes so many topics
    by the hash of their ids and what joins them.
    """
    pairs = cooccurrence.cooccurrences(links, chunks if mode == "knn" else None, min_count)
    e = cooccurrence.cooccurrence_edges(pairs, min_count, min_pmi, mode == "knn")
    if mode == "knn":
        n = similarity.nearest(vectors, k, least)
        e = graph.merged_edges(e, n.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.greatest("cosine", F.lit(0.1)).alias("weight"), F.lit("embedding_knn").alias("type")).distinct())
    elif mode == "full":
        e = graph.merged_edges(similarity.similar_pairs(vectors, least).select(F.col("id1").alias("src"), F.col("id2").alias("dst"), F.col("cosine").alias("weight"), F.lit("embedding").alias("type")), e)
    if sample is not None:
        some = topics.select("id").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(sample)
        e = e.join(some.select(F.col("id").alias("src")), "src", "left_semi").join(some.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight", "type")
    e = scratch.put("cluster_edges", e)
    hub = scratch.put("cluster_hubs", graph.hubs(graph.degrees(topics.select("id"), e), topics, hub_quantile, method=hub_method) if remove_hubs else topics.select(F.col("id").alias("node")).limit(0))
    inner = e.join(hub.select(F.col("node").alias("src")), "src", "left_anti").join(hub.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "weight")
    m = community.surprising(inner, scratch) if kind == "surprise" else community.communities(inner, scratch, resolution, kind)
    m = scratch.put("cluster_members", m.unionByName(graph.modal_neighbour(e, hub, m)))
    sizes = m.where("community >= 0").groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return {"edges": e, "membership": m, "hub_memberships": graph.hub_memberships(e, hub, m), "sizes": sizes}


def sync_library(pages: DataFrame, books: DataFrame, catalogue: DataFrame, scratch: Scratch) -> DataFrame:
    """``books`` with the books of library pages (tag, html) that it doesn't hold, each with its match in the catalogue.

    Books are known by ipad_id; a new one gets an id after the last, the first catalogue record whose title holds its
    own (one of the same author before others) as calibre_id, and that record's author, series and publisher.
    """
    found = documents.library_pages(pages).select(F.col("id").alias("ipad_id"), "format", "title")
    fresh = scratch.put("new_books", found.join(books.select("ipad_id"), "ipad_id", "left_anti"))
    last = books.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = scratch.put("numbered_books", tables.numbered(fresh, "id", [F.col("ipad_id")], scratch, last.scalar() + 1))
    match = matching.contained(new.select("id", "title", F.lit(None).cast("string").alias("author")), catalogue)
    k = catalogue.select(F.col("id").alias("calibre_id"), F.col("author_sort").alias("author"), "series", "series_index", "publisher")
    rows = new.join(match.select("id", F.col("catalogue_id").alias("calibre_id")), "id", "left").join(k, "calibre_id", "left")
    rows = rows.select("id", "ipad_id", "calibre_id", "title", "author", "format", "series", "series_index", "publisher", F.col("calibre_id").isNotNull().alias("has_calibre_match"))
    return books.unionByName(rows, allowMissingColumns=True)


def process(chunks: DataFrame, chunk_topics: DataFrame, known: DataFrame, scratch: Scratch, threshold: float = 0.85, sure: float = 0.95, k: int = 10, least: float = 0.65, min_count: int = 2, resolution: float = 0.001) -> dict[str, DataFrame]:
    """The whole chain from raw topics to communities; each stage is a written table, so a lost executor costs one stage."""
    topics, links = normalized_topics(chunk_topics, known, scratch)
    topics, links = scratch.put("topics", topics), scratch.put("links", links)
    vec = scratch.put("vectors", embedded(topics, topics.select("id", F.array().cast("array<float>").alias("v")).limit(0)))
    usable = vec.where(V.usable(F.col("v"), models.DIM))
    books = links.join(chunks.select(F.col("id").alias("chunk_id"), "book_id"), "chunk_id").select("topic_id", "book_id").distinct()
    groups = scratch.put("groups", dedup.duplicate_groups(usable, topics, books, scratch, threshold, sure))
    links = scratch.put("merged", dedup.merge_groups(links, groups))
    gone = groups.where("topic_id <> canonical_id").select(F.col("topic_id").alias("id"))
    usable = usable.join(gone, "id", "left_anti")
    pairs = scratch.put("cooccurrence", cooccurrence.cooccurrences(links, chunks, min_count))
    knn = similarity.nearest(usable, k, least).select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.col("cosine").alias("weight"), F.lit("embedding_knn").alias("type")).distinct()
    edges = scratch.put("edges", graph.merged_edges(cooccurrence.cooccurrence_edges(pairs, min_count, 0.0, True), knn))
    return {"topics": topics.join(gone, "id", "left_anti"), "links": links, "cooccurrence": pairs, "edges": edges, "communities": community.communities(edges, scratch, resolution)}


def process_library(spark: SparkSession, source: str, target: str, scratch: Scratch, **options) -> DataFrame:
    """(table, rows, seconds) of the statistics, after ``process`` over the tables below ``source``, with ``options``: the
    topics, links, pairs and edges that come of it are written below ``target`` beside the base tables."""
    read = lambda name: table(spark, source, name)
    known = read("topics").select("id", "label")
    out = process(read("chunks").select("id", "book_id"), read("chunk_topics").select("chunk_id", "topic"), known, scratch, **options)
    of = out["communities"].select(F.col("node").alias("id"), F.col("community").alias("cluster_id"))
    topics = out["topics"].join(of, "id", "left").join(read("topics").select("id", "parent_topic_id"), "id", "left")
    new = {"topics": topics.select("id", "label", "cluster_id", "parent_topic_id", F.col("occ").alias("occurrence_count")), "chunk_topic_links": out["links"], "topic_cooccurrences": out["cooccurrence"], "edges": out["edges"]}
    for name in relational.TABLES:
        new.setdefault(name, read(name))
    for name, df in new.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
    return statistics.refresh(spark, target, target)
