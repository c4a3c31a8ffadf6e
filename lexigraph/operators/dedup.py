"""Near-duplicate topics merged into the most frequent one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.operators.graph import components
from lexigraph.operators.similarity import linking_pairs
from lexigraph.session import Scratch


def duplicate_groups(vectors: DataFrame, topics: DataFrame, topic_books: DataFrame, scratch: Scratch, threshold: float = 0.85, sure: float = 0.95) -> DataFrame:
    """(topic_id, canonical_id) of every topic in a group of two or more.

    Pairs of at least ``sure`` merge, pairs between ``threshold`` and that only if the topics share a book.  The
    canonical topic is the one with most occurrences, the smaller id among equals.
    """
    scratch = scratch.fresh()
    tb = topic_books.select("topic_id", "book_id").distinct()
    books = tb.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.col("book_id").cast("long"))).alias("books"))
    v = vectors.join(books, vectors.id == books.topic_id, "left").select("id", "v", "books")
    p = scratch.put("pairs", linking_pairs(v, threshold, sure))
    maybe = p.where(~F.col("settled"))
    shared = maybe.join(tb.select(F.col("topic_id").alias("id1"), "book_id"), "id1").join(tb.select(F.col("topic_id").alias("id2"), "book_id"), ["id2", "book_id"]).select("id1", "id2").distinct()
    edges = p.where("settled").select("id1", "id2").unionByName(shared)
    c = components(edges.select(F.col("id1").alias("src"), F.col("id2").alias("dst")), scratch)
    c = c.join(topics.select(F.col("id").alias("node"), "occ"), "node")
    best = c.groupBy("component").agg(F.max(F.struct("occ", (-F.col("node")).alias("n"))).alias("b"))
    return c.join(best, "component").select(F.col("node").alias("topic_id"), (-F.col("b.n")).alias("canonical_id"))


def merge_groups(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Links of duplicates moved to the canonical topic, each once."""
    m = links.join(groups, "topic_id", "left")
    return m.select("chunk_id", F.coalesce("canonical_id", "topic_id").alias("topic_id")).distinct()


def merge_preview(groups: DataFrame, topics: DataFrame, limit: int = 20) -> DataFrame:
    """(canonical_id, label, size) of the largest groups."""
    g = groups.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("size"))
    return g.join(topics.select(F.col("id").alias("canonical_id"), "label"), "canonical_id").orderBy(F.desc("size"), "canonical_id").limit(limit)
