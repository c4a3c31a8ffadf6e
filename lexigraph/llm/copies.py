"""Problem 3: records that differ only in form, collapsed by commutative multiset hashing.

Each normalised (field name, value) pair is hashed on its own; the hashes are added up, so the order of the fields
does not matter and nothing is sorted.  Records of equal fingerprint form a class, whose members are then compared
with its first record field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.terms import term_fields, written_form
from lexigraph.session import Scratch, table

LOW = 0xFFFFFFFF


def multiset_hash(parts: Column, seed: str) -> Column:
    """64 bits: the sums of the upper and the lower halves of the parts' hashes, whatever their order."""
    hashes = F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))
    zero = F.lit(0).cast("long")
    low = F.aggregate(hashes, zero, lambda a, h: a + h.bitwiseAND(F.lit(LOW).cast("long")))
    high = F.aggregate(hashes, zero, lambda a, h: a + F.shiftrightunsigned(h, 32))
    return low.bitwiseXOR(F.shiftleft(high, 32))


def same_multiset(a: Column, b: Column) -> Column:
    """Equality of two arrays as multisets: as they stand, or else by the count of every value; nothing is sorted."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(a, lambda x: count(a, x) == count(b, x)))


def record_parts(columns: list[str]) -> Column:
    """array<string> for records of several columns: 'name=value' of each column whose normalised value isn't empty."""
    each = [F.when(F.array_join(term_fields(F.col(c).cast("string")), " ") != "", F.concat(F.lit(f"{c}="), F.array_join(term_fields(F.col(c).cast("string")), " "))) for c in columns]
    return F.array_compact(F.array(*each))


def fingerprinted(df: DataFrame, id_col: str, parts: Column, scope: Column | None = None) -> DataFrame:
    """(scope, id, parts, fp1, fp2), one row for each distinct id of a record that has a part.

    Rows without an id or a part are left out.  The key of the shuffle holds the id, so a class of any size is spread.
    """
    d = df.select((scope if scope is not None else F.lit(0)).cast("long").alias("scope"), F.col(id_col).cast("long").alias("id"), parts.alias("parts"))
    d = d.where(F.col("id").isNotNull() & (F.size("parts") > 0))
    d = d.withColumns({"fp1": multiset_hash(F.col("parts"), "a"), "fp2": multiset_hash(F.col("parts"), "b")})
    return d.dropDuplicates(["scope", "fp1", "fp2", "id"])


KEY = ["scope", "fp1", "fp2"]


def classes(rows: DataFrame) -> DataFrame:
    """One row for each class of ``fingerprinted`` rows: (scope, fp1, fp2, first_id, first_parts, copies)."""
    return rows.groupBy(*KEY).agg(F.min(F.struct("id", "parts")).alias("f"), F.count(F.lit(1)).alias("copies")).select(*KEY, F.col("f.id").alias("first_id"), F.col("f.parts").alias("first_parts"), "copies")


def copy_pairs(rows: DataFrame) -> DataFrame:
    """(scope, first_id, other_id): every record but the first of its class beside the first, fields compared.

    ``rows`` must be cheap to read twice.  The first records are made with a map-side minimum; the join back is an
    equi-join whose hot keys Spark's adaptive skew join splits.  A record of equal fingerprint but other fields (a
    collision) is no copy.  Empty input gives no rows.
    """
    firsts = classes(rows).where("copies > 1")
    j = rows.join(firsts, KEY).where((F.col("id") != F.col("first_id")) & same_multiset(F.col("parts"), F.col("first_parts")))
    return j.select("scope", "first_id", F.col("id").alias("other_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    labels = fingerprinted(table(spark, sf_dir, "topics"), "id", term_fields(F.col("label")))
    topics = fingerprinted(table(spark, sf_dir, "chunk_topics").where("chunk_id is not null"), "raw_id", term_fields(F.col("topic")), F.col("chunk_id"))
    out = [copy_pairs(s.put(name, rows)).select(F.lit(name).alias("field"), "first_id", "other_id") for name, rows in (("label", labels), ("topic", topics))]
    return out[0].unionByName(out[1])


def counted_terms(rows: DataFrame) -> DataFrame:
    """(term, n_rows, n_labels) from (kind, id, parts), kind 0 being rows and 1 labels: every term once.

    Rows count once for an id.  They are counted by their fields as written before they meet, so a hot term is a few
    rows; those of one fingerprint are then held against its first fields, and what has other fields (a collision)
    is a term of its own.
    """
    d = rows.where(F.col("id").isNotNull() & (F.size("parts") > 0)).withColumns({"fp1": multiset_hash(F.col("parts"), "a"), "fp2": multiset_hash(F.col("parts"), "b")})
    d = d.dropDuplicates(["fp1", "fp2", "kind", "id"])
    written = d.groupBy("fp1", "fp2", "parts").agg(F.count_if(F.col("kind") == 0).alias("n_rows"), F.count_if(F.col("kind") == 1).alias("n_labels"))
    first = written.groupBy("fp1", "fp2").agg(F.min("parts").alias("f"))
    j = written.join(first, ["fp1", "fp2"]).select("n_rows", "n_labels", "fp1", "fp2", written_form(F.when(same_multiset(F.col("parts"), F.col("f")), F.col("f")).otherwise(F.col("parts"))).alias("term"))
    return j.groupBy("fp1", "fp2", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_labels").alias("n_labels")).select("term", "n_rows", "n_labels")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, n_rows, n_labels): every term once, with the raw rows and the labels that spell it."""
    t = table(spark, sf_dir, "chunk_topics").select(F.lit(0).alias("kind"), F.col("raw_id").alias("id"), term_fields(F.col("topic")).alias("parts"))
    l = table(spark, sf_dir, "topics").select(F.lit(1).alias("kind"), "id", term_fields(F.col("label")).alias("parts"))
    return counted_terms(Scratch(spark).put("rows", t.unionByName(l)))


def term_sql(x: str) -> str:
    """DuckDB: the sorted fields of a label as a list, by the same rules."""
    flat = f"regexp_replace(regexp_replace(lower({x}), '([\\p{{L}}\\p{{N}}])[''’]([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}])[''’]([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')"
    spaced = f"regexp_replace({flat}, '[^\\p{{L}}\\p{{N}}/;|,]+', ' ', 'g')"
    return f"list_sort(list_filter(list_transform(regexp_split_to_array({spaced}, '[/;|,]'), lambda f: trim(f)), lambda f: f <> ''))"


_CTE = f"""WITH l AS (SELECT id, {term_sql('label')} f FROM topics), t AS (SELECT DISTINCT chunk_id, raw_id id, {term_sql('topic')} f FROM chunk_topics),
a AS (SELECT 'label' field, id, min(id) OVER (PARTITION BY f) first_id FROM l WHERE len(f) > 0),
b AS (SELECT 'topic' field, id, min(id) OVER (PARTITION BY chunk_id, f) first_id FROM t WHERE len(f) > 0 AND chunk_id IS NOT NULL AND id IS NOT NULL)"""
QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}
SQL = {
    "p3_found": f"{_CTE} SELECT field, first_id, id AS other_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE id <> first_id",
    "p3_terms": f"WITH d AS (SELECT DISTINCT 0 kind, raw_id id, {term_sql('topic')} f FROM chunk_topics WHERE raw_id IS NOT NULL UNION ALL SELECT 1, id, {term_sql('label')} FROM topics) SELECT array_to_string(f, ' / ') AS term, count(*) FILTER (kind = 0) AS n_rows, count(*) FILTER (kind = 1) AS n_labels FROM d WHERE len(f) > 0 GROUP BY 1",
}
