"""Upserts and other set-wise replacements for row-by-row writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.session import Scratch


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``old`` are added, one for each key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.xxhash64(*new.columns)]))
    once = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return old.unionByName(once.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of equal key; of several the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.xxhash64(*new.columns)]))
    once = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once, allowMissingColumns=True)


def replace_group(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of each key in ``new`` are replaced by the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def numbered(df: DataFrame, name: str, order: list[Column], scratch: Scratch, start: int | Column = 1) -> DataFrame:
    """``df`` with a number for each row in that order, from ``start`` on, without one task that sees them all: rows are
    sorted by ranges and numbered within each, and ranges are told apart by how many rows lie before them."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    d = scratch.fresh().put("sorted", d.select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_i")).drop("_at"))
    sizes = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_i") + start).cast("long")).drop("_range", "_i", "_before")


def dimension(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """(id, name): a number for each distinct value, in order of the value."""
    return numbered(df.select(name).where(F.col(name).isNotNull()).distinct(), "id", [F.col(name)], scratch).select("id", name)


def bridge(df: DataFrame, key: str, name: str, dim: DataFrame) -> DataFrame:
    """(key, id): which values of a dimension each row of (key, name) has, each once."""
    return df.select(key, name).join(dim, name).select(key, "id").distinct()


def themes_of(books: DataFrame, themes: DataFrame) -> DataFrame:
    """(id, themes array<string>) of ``books`` (id) from ``themes`` (id, themes as a JSON list); an empty list without."""
    t = books.join(themes.select("id", "themes"), "id", "left")
    return t.select("id", F.coalesce(F.from_json("themes", "array<string>"), F.array().cast("array<string>")).alias("themes"))
