"""Co-occurrence of topics in chunks, and the edges made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.scoring import cooccurrence_weight, pmi


BLOCK = 64  # topics of a chunk that meet in one join key


def chunk_pairs(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(topic1_id, topic2_id, count), topic1_id < topic2_id, of distinct (chunk_id, topic_id).

    A chunk of more than ``block`` topics is split into parts; each pair of parts is a join key of its own, so that no
    task holds the square of a large chunk.  Pairs are counted map-side.
    """
    big = links.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block)
    l = links.join(big, "chunk_id", "left").withColumn("parts", F.ceil(F.coalesce("k", F.lit(1)) / block).cast("int"))
    l = l.withColumn("part", F.pmod(F.xxhash64("topic_id"), F.col("parts")).cast("int"))
    a = l.select("chunk_id", F.col("topic_id").alias("x"), F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    b = l.select("chunk_id", F.col("topic_id").alias("y"), F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    p = a.join(b, ["chunk_id", "i", "j"]).where((F.col("x") != F.col("y")) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    return p.groupBy(F.least("x", "y").alias("topic1_id"), F.greatest("x", "y").alias("topic2_id")).agg(F.count(F.lit(1)).alias("count"))


def common_books(pairs: DataFrame, topic_books: DataFrame) -> DataFrame:
    """(topic1_id, topic2_id, book_count) of the pairs with a common book, from distinct (topic_id, book_id).

    Only the books of a pair's rarer topic are looked up, so a topic of very many books isn't spread over its pairs.
    """
    n = topic_books.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.select("topic1_id", "topic2_id").join(n.select(F.col("topic_id").alias("topic1_id"), F.col("n").alias("n1")), "topic1_id").join(n.select(F.col("topic_id").alias("topic2_id"), F.col("n").alias("n2")), "topic2_id")
    first = F.col("n1") <= F.col("n2")
    p = p.select("topic1_id", "topic2_id", F.when(first, F.col("topic1_id")).otherwise(F.col("topic2_id")).alias("rare"), F.when(first, F.col("topic2_id")).otherwise(F.col("topic1_id")).alias("other"))
    held = p.join(topic_books.select(F.col("topic_id").alias("rare"), "book_id"), "rare")
    both = held.join(topic_books.select(F.col("topic_id").alias("other"), "book_id"), ["other", "book_id"], "left_semi")
    return both.groupBy("topic1_id", "topic2_id").agg(F.count(F.lit(1)).alias("book_count"))


def cooccurrences(links: DataFrame, chunks: DataFrame | None = None, min_count: int = 1) -> DataFrame:
    """(topic1_id, topic2_id, count, pmi[, book_count]) of topics that share a chunk, topic1_id < topic2_id.

    Topics too rare for ``min_count`` go before pairs are made.  With ``chunks``, book_count is the number of books that
    hold both topics anywhere.
    """
    l = links.select("chunk_id", "topic_id").dropna().distinct()
    n = l.agg(F.count_distinct("chunk_id").alias("n"))
    k = l.groupBy("topic_id").agg(F.count(F.lit(1)).alias("k"))
    lk = l.join(k.where(F.col("k") >= min_count).select("topic_id"), "topic_id", "left_semi") if min_count > 1 else l
    p = chunk_pairs(lk).where(F.col("count") >= min_count)
    p = p.join(k.select(F.col("topic_id").alias("topic1_id"), F.col("k").alias("k1")), "topic1_id").join(k.select(F.col("topic_id").alias("topic2_id"), F.col("k").alias("k2")), "topic2_id")
    p = p.withColumn("n", n.scalar()).select("topic1_id", "topic2_id", "count", pmi(F.col("count"), F.col("k1"), F.col("k2"), F.col("n")).alias("pmi"))
    if chunks is None:
        return p
    tb = l.join(chunks.select(F.col("id").alias("chunk_id"), "book_id"), "chunk_id").select("topic_id", "book_id").dropna().distinct()
    return p.join(common_books(p, tb), ["topic1_id", "topic2_id"], "left").withColumn("book_count", F.coalesce("book_count", F.lit(0)).cast("long"))


def occurring_with(links: DataFrame, topic: DataFrame, limit: int = 20) -> DataFrame:
    """(id, count, pmi): the topics that most often share a chunk with one, ``topic`` being its (id), a row or none.

    Only the topic's own chunks are joined; what occurs nowhere else isn't counted.
    """
    l = links.select("chunk_id", "topic_id").dropna().distinct()
    of = F.broadcast(topic.select(F.col("id").alias("topic_id")))
    own = l.join(of, "topic_id", "left_semi").select("chunk_id")
    near = l.join(own, "chunk_id", "left_semi").groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"))
    k = l.groupBy("topic_id").agg(F.count(F.lit(1)).alias("k"))
    p = near.join(of, "topic_id", "left_anti").join(k, "topic_id").withColumns({"own": own.agg(F.count(F.lit(1))).scalar(), "n": l.agg(F.count_distinct("chunk_id")).scalar()})
    return p.select(F.col("topic_id").alias("id"), "count", pmi(F.col("count"), F.col("k"), F.col("own"), F.col("n")).alias("pmi")).orderBy(F.desc("count"), "id").limit(limit)


def cooccurrence_edges(pairs: DataFrame, min_count: int, min_pmi: float, book_boost: bool = False) -> DataFrame:
    """(src, dst, weight, type) of the pairs with enough count and PMI; a null PMI passes."""
    p = pairs.where((F.col("count") >= min_count) & ((F.col("pmi") >= min_pmi) | F.col("pmi").isNull()))
    w = cooccurrence_weight(F.col("count"), F.col("pmi"), F.col("book_count") if book_boost else None)
    return p.select(F.col("topic1_id").alias("src"), F.col("topic2_id").alias("dst"), w.alias("weight"), F.lit("cooccurrence").alias("type"))
