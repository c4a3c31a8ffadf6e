"""Sinks: graphs as GML, results as JSON, tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, value): the lines of a GML file, in order of part and key; the text stays distributed."""
    quote = F.regexp_replace(F.col("label"), '"', "'")
    head = vertices.sparkSession.createDataFrame([(0, "", "graph [\n  directed 0")], "part int, key string, value string")
    v = vertices.select(F.lit(1).alias("part"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), F.concat(F.lit("  node [ id "), "id", F.lit(' label "'), quote, F.lit('" ]')).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lpad(F.col("src").cast("string"), 20, "0"), F.lpad(F.col("dst").cast("string"), 20, "0")).alias("key"), F.concat(F.lit("  edge [ source "), "src", F.lit(" target "), "dst", F.lit(" weight "), F.round("weight", 6).cast("string"), F.lit(" ]")).alias("value"))
    tail = vertices.sparkSession.createDataFrame([(3, "", "]")], "part int, key string, value string")
    return head.unionByName(v).unionByName(e).unionByName(tail)


def write_gml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    gml_lines(vertices, edges).orderBy("part", "key").select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_domains(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(domains, members) from a JSON list of {label, leiden_cluster_ids}: domains (id, label, cluster_count) in order of
    the file, members (cluster_id, domain_id); a cluster named by several belongs to the last, of equal labels the
    first counts.  Such a file holds a row for each domain and is read as one."""
    schema = "array<struct<label:string,leiden_cluster_ids:array<bigint>>>"
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("i", "d")).select("i", "d.*").where("label is not null")
    first = d.groupBy("label").agg(F.min("i").alias("id"))
    c = d.join(first, "label").select("i", "id", F.explode("leiden_cluster_ids").alias("cluster_id"))
    members = c.groupBy("cluster_id").agg(F.max_by("id", "i").alias("domain_id"))
    n = members.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))
    domains = first.join(n, first.id == n.domain_id, "left").select(first.id.cast("long").alias("id"), "label", F.coalesce("n", F.lit(0)).alias("cluster_count"))
    return domains, members.select("cluster_id", F.col("domain_id").cast("long").alias("domain_id"))


def write_universe(clusters: DataFrame, path: str) -> None:
    """The map of the clusters, a JSON object for each."""
    write_json(clusters.select("id", "domain", "x", "y", "z", "colour"), path)


def read_universe(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored map, None where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("id long, domain int, x double, y double, z double, colour string").json(path)


# Tables made from others, which a fresh library leaves behind.
DERIVED = "chunk_topics topics chunk_topic_links topic_cooccurrences topic_cluster_memberships cluster_labels domains cluster_domains cluster_books cluster_stats domain_stats".split()


def base_tables(tables: dict[str, DataFrame], path: str, keep: tuple[str, ...] = ("books", "chunks")) -> None:
    """A fresh library: the tables to keep are copied, derived ones there are emptied."""
    for name in DERIVED:
        if name in tables and name not in keep:
            tables[name].limit(0).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    for name in keep:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}.parquet")
