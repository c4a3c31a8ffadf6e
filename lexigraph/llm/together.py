"""Problem 6: items that appear together, with large baskets split into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.session import Scratch, table

BLOCK = 64


def item_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item1, item2, n12), item1 < item2: in how many baskets both occur, of distinct (basket, item) rows.

    A basket of more than ``block`` items is split into item blocks by hash; each pair of blocks is a join key of its
    own, so its product is shared out over many tasks, while an ordinary basket is the single key (basket, 0, 0).
    Pairs are counted map-side before they shuffle.
    """
    sizes = links.groupBy("basket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block)
    l = links.join(sizes, "basket", "left").select("basket", "item", F.ceil(F.coalesce("k", F.lit(1)) / block).cast("int").alias("nb"))
    l = l.withColumn("blk", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    a = l.select("basket", F.col("item").alias("x"), F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("nb") - 1)).alias("j"))
    b = l.select("basket", F.col("item").alias("y"), F.explode(F.sequence(F.lit(0), "blk")).alias("i"), F.col("blk").alias("j"))
    p = a.join(b, ["basket", "i", "j"]).where((F.col("i") < F.col("j")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return p.groupBy(F.least("x", "y").alias("item1"), F.greatest("x", "y").alias("item2")).agg(F.count(F.lit(1)).alias("n12"))


def associations(links: DataFrame, scratch: Scratch, min_count: int = 1, min_lift: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(item1, item2, n12, n1, n2, n, lift) of the pairs with n12 >= min_count and lift = n12 * n / (n1 * n2) >= min_lift.

    ``links`` has (basket, item); rows with a null are left out, repeats count once.  Two prunings lose nothing: an
    item in fewer than min_count baskets has no such pair; and as n12 is at most the rarer item's count, neither has
    an item in more than n / min_lift baskets.  Of the latter there are at most min_lift times the mean basket
    size, so their list may be broadcast; once they are gone no item holds more than 1 / min_lift of the baskets.
    """
    scratch = scratch.fresh()
    l = scratch.put("links", links.select("basket", "item").dropna().distinct())
    n = l.select("basket").distinct().count()
    counts = scratch.put("counts", item_counts(l))
    kept = l
    if min_lift > 0:
        hot = counts.where(F.col("n") * F.lit(float(min_lift)) > F.lit(float(n))).select("item")
        if hot.count() <= 100_000:
            hot = F.broadcast(hot)
        kept = kept.join(hot, "item", "left_anti")
    if min_count > 1:
        kept = kept.join(counts.where(F.col("n") >= min_count).select("item"), "item", "left_semi")
    p = pair_counts(kept, block).where(F.col("n12") >= min_count)
    c = counts.select("item", "n")
    p = p.join(c.select(F.col("item").alias("item1"), F.col("n").alias("n1")), "item1").join(c.select(F.col("item").alias("item2"), F.col("n").alias("n2")), "item2")
    p = p.withColumn("n", F.lit(n)).where(F.col("n12") * F.col("n") >= F.lit(min_lift) * F.col("n1") * F.col("n2"))
    return p.select("item1", "item2", "n12", "n1", "n2", "n", (F.col("n12") * F.col("n") / (F.col("n1") * F.col("n2"))).alias("lift"))


def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_topic_links").select(F.col("chunk_id").alias("basket"), F.col("topic_id").alias("item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associations(chunk_links(spark, sf_dir), Scratch(spark), 4, 20.0).select(F.col("item1").alias("topic1_id"), F.col("item2").alias("topic2_id"))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of topics with at least two common chunks, its counts and its ratio to chance."""
    return pair_columns(associations(chunk_links(spark, sf_dir), Scratch(spark), 2))


def p6_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of topics with a common chunk, its counts and its ratio to chance."""
    return pair_columns(associations(chunk_links(spark, sf_dir), Scratch(spark)))


def pair_columns(a: DataFrame) -> DataFrame:
    return a.select(F.col("item1").alias("topic1_id"), F.col("item2").alias("topic2_id"), "n12", "n1", "n2", F.round("lift", 6).alias("lift"))


_CTE = """WITH l AS (SELECT DISTINCT chunk_id c, topic_id t FROM chunk_topic_links WHERE chunk_id IS NOT NULL AND topic_id IS NOT NULL), n AS (SELECT count(DISTINCT c) n FROM l), o AS (SELECT t, count(*) k FROM l GROUP BY t),
p AS (SELECT a.t t1, b.t t2, count(*) n12 FROM l a JOIN l b ON a.c = b.c AND a.t < b.t GROUP BY 1, 2), q AS (SELECT t1, t2, n12, a.k n1, b.k n2, n FROM p JOIN o a ON a.t = t1 JOIN o b ON b.t = t2 CROSS JOIN n)"""
QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs, "p6_all_pairs": p6_all_pairs}
SQL = {
    "p6_found": f"{_CTE} SELECT t1 AS topic1_id, t2 AS topic2_id FROM q WHERE n12 >= 4 AND n12 * n >= 20 * n1 * n2",
    "p6_pairs": f"{_CTE} SELECT t1 AS topic1_id, t2 AS topic2_id, n12, n1, n2, round(CAST(n12 * n AS DOUBLE) / (n1 * n2), 6) AS lift FROM q WHERE n12 >= 2",
    "p6_all_pairs": f"{_CTE} SELECT t1 AS topic1_id, t2 AS topic2_id, n12, n1, n2, round(CAST(n12 * n AS DOUBLE) / (n1 * n2), 6) AS lift FROM q",
}
