"""Problem 9: sources mixed to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.session import Scratch, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1024
SHARD_DOCS = 50_000
SEED = 42


def source_name(c: Column) -> Column:
    """Lower case, without blanks around it, words joined by '_'; blank is null."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(c)), r"[\s_-]+", "_"), F.lit(""))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` (doc_id, source, text) with n_tokens in place of the text; special tokens are ordinary text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(x)) if x else 0 for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, n_tokens long")


def water_level(rows: DataFrame, by: list[str], seats: Column, name: str) -> DataFrame:
    """(*by, name): the level at which the shares min(cap, level * w) of a group's rows add up to its seats; infinite
    where all caps together hold no more."""
    w = Window.partitionBy(*by).orderBy(F.col("cap") / F.col("w"), "key")
    before, from_here = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    level = (seats - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(from_here)
    r = rows.select(*by, level.alias("level"), (F.col("cap") / F.col("w")).alias("full"), F.row_number().over(w).alias("place"))
    g = r.groupBy(*by).agg(F.min(F.when(F.col("level") < F.col("full"), F.struct("place", "level"))).alias("m"))
    return g.select(*by, F.coalesce("m.level", F.lit(float("inf"))).alias(name))


def apportioned(rows: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` (*by, key, w, cap, seats) with got: each group's seats by the highest quotients w / (2 k + 1), ties to the
    smaller key, none above its cap.  A null or non-positive weight gets none.

    The level of half a seat a row fewer gives every row seats that it has for certain, that of half a seat more those
    that it can have; only the seats between the two, about one for each row, are ranked.  Nothing goes through the
    driver; a window holds a row for each key of a group.
    """
    r = scratch.put("seats", rows.where("w > 0 and cap > 0 and seats > 0").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by))))
    low, high = water_level(r, by, F.col("seats") - F.col("n") / 2 - 1, "low"), water_level(r, by, F.col("seats") + F.col("n") / 2 + 1, "high")
    r = r.join(low, by).join(high, by)
    held = lambda level, more: F.least(F.col("cap"), F.greatest(F.lit(0), F.when(F.col(level) == float("inf"), F.col("cap")).otherwise(F.floor(F.col(level) * F.col("w") + 0.5)) + more)).cast("long")
    r = scratch.put("sure", r.withColumns({"sure": held("low", 0), "most": held("high", 1)}))
    left = r.groupBy(*by).agg((F.first("seats") - F.sum("sure")).alias("left"))
    seat = r.where("most > sure").select(*by, "key", "w", F.explode(F.sequence("sure", F.col("most") - 1)).alias("k"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("w") / (2 * F.col("k") + 1)), "key", "k"))
    more = seat.withColumn("place", place).join(left, by).where(F.col("place") <= F.col("left")).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("more"))
    got = r.join(more, [*by, "key"], "left").select(*by, "key", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("got"))
    return rows.join(got, [*by, "key"], "left").withColumn("got", F.coalesce("got", F.lit(0)).cast("long"))


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, weight, repeats): weights of names that are the same add up, the least max_repeats holds, a null one is 1;
    null, negative or NaN weights count as 0."""
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("target_weight").alias("w"), F.col("max_repeats").alias("m")).where("source is not null")
    w = F.when(F.isnan("w") | (F.coalesce("w", F.lit(0.0)) < 0), 0.0).otherwise(F.coalesce("w", F.lit(0.0)))
    return t.groupBy("source").agg(F.sum(w).alias("weight"), F.greatest(F.lit(0), F.min(F.coalesce("m", F.lit(1)))).cast("long").alias("repeats"))


def mix(docs: DataFrame, targets: DataFrame, scratch: Scratch, total_tokens: int | None = None, block: int = BLOCK_TOKENS, seed: int = SEED, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    documents (doc_id, source, n_tokens, repeats): how often each chosen document is to be used.
    shares (source, target_share, share, tokens, available_tokens, n_docs, most_repeats, capped): of each source named.

    Without ``total_tokens`` the mixture is as large as the sources with a weight and with text allow at their target
    shares; a larger total leaves the sources that are used up below their share and the others above.  The total
    is divided into equal-token blocks, which the sources get by highest quotients, and each source's blocks are
    apportioned in the same way to its shards (documents spread by seeded hash, about 50,000 a shard).  Within a
    shard documents stand in seeded order and fill block after block; all blocks are used as often as the quota holds
    the shard whole, and the rest of it takes blocks in this order, the last by the nearer end, so that a shard misses
    its quota by half a block (or half of a document that is larger) at most.  Documents without a source named, an id
    or a token aren't used.  Repeated rows are documents of their own.
    """
    scratch, spark = scratch.fresh(), docs.sparkSession
    want = scratch.put("targets", targets_of(targets))
    d = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("doc_id is not null and source is not null and text is not null")
    if want.count() <= 100_000:  # of more names, only those of the sizes are compared, as texts shouldn't be shuffled
        d = d.join(F.broadcast(want.select("source")), "source", "left_semi")
    sized = scratch.put("sized", token_counts(d, tokenizer).where("n_tokens > 0").join(want.select("source"), "source", "left_semi"))
    shards = max(1, math.ceil(sized.count() / SHARD_DOCS))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int"))
    have = scratch.put("have", sized.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")))
    sources = scratch.put("sources", want.join(have.groupBy("source").agg(F.sum("n").alias("available")), "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long")))
    live = sources.where("weight > 0 and repeats > 0 and available > 0")
    cap = F.col("available") * F.col("repeats")
    if total_tokens is None:
        a = live.agg(F.min(cap / F.col("weight")).alias("least"), F.sum("weight").alias("all")).first()
        total_tokens = int(a["least"] * a["all"]) if a["all"] else 0
    seats = live.select(F.lit(0).alias("all"), F.col("source").alias("key"), F.col("weight").alias("w"), F.floor(cap / block).alias("cap"), F.lit(total_tokens // block).cast("long").alias("seats"))
    quota = scratch.put("quota", apportioned(seats, ["all"], scratch.fresh()).select(F.col("key").alias("source"), F.col("got").alias("seats"), (F.col("got") >= F.col("cap")).alias("capped")))
    parts = have.join(quota.select("source", "seats"), "source").join(live.select("source", "repeats"), "source")
    parts = parts.select("source", F.col("shard").alias("key"), F.col("n").cast("double").alias("w"), F.floor(F.col("n") * F.col("repeats") / block).alias("cap"), "seats", "n", (F.col("n") * F.col("repeats")).alias("room"))
    per = scratch.put("per_shard", apportioned(parts, ["source"], scratch.fresh()))
    # What shards round down goes to those with room left, in order.
    room = F.col("room") - F.col("got") * block
    w = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    missing = (F.col("seats") - F.sum("got").over(Window.partitionBy("source"))) * block - F.coalesce(F.sum(room).over(w), F.lit(0))
    tokens = F.col("got") * block + F.greatest(F.lit(0), F.least(room, missing))
    plan = per.select("source", F.col("key").alias("shard"), tokens.alias("tokens"), "n").select("source", "shard", F.floor(F.col("tokens") / F.col("n")).alias("passes"), (F.col("tokens") % F.col("n")).alias("rest"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.join(plan, ["source", "shard"]).withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).withColumn("block", F.floor(F.col("before") / block))
    one = Window.partitionBy("source", "shard", "block")
    first, whole = F.min("before").over(one), F.sum("n_tokens").over(one)
    chosen = blocks.withColumn("repeats", F.col("passes") + F.when(first + whole / 2 <= F.col("rest"), 1).otherwise(0)).where("repeats > 0")
    chosen = scratch.put("chosen", chosen.select("doc_id", "source", "n_tokens", "repeats"))
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    all_ = got.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).scalar()
    weights = sources.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("t")).scalar()
    part = lambda x, t: F.round(F.coalesce(x / F.nullif(t, F.lit(0)), F.lit(0.0)), 6)
    shares = sources.join(got, "source", "left").join(quota.select("source", "capped"), "source", "left")
    return chosen, shares.select("source", part(F.col("weight"), weights).alias("target_share"), part(F.col("tokens"), all_).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.col("available").alias("available_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("capped", F.lit(False)).alias("capped"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), Scratch(spark))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), Scratch(spark))[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
