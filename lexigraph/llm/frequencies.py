"""Problem 5: how often and in how many records every term occurs, by a range-partitioned external sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.terms import term_fields, written_form
from lexigraph.session import Scratch, table


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One scan over sorted (term, record_id, row_id): distinct rows and records of each run of a term.

    Holds one batch and the last key of the one before.
    """
    last = None
    term, n_rows, n_records = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column(0).dictionary_encode()
        t, rec, row = codes.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
        words = codes.dictionary.to_pylist()
        new_t = np.r_[True, t[1:] != t[:-1]]
        new_rec = np.r_[True, rec[1:] != rec[:-1]] | new_t
        new_row = np.r_[True, row[1:] != row[:-1]] | new_rec
        if last is not None and last[0] == words[t[0]]:
            new_t[0] = False
            new_rec[0] = last[1] != rec[0]
            new_row[0] = new_rec[0] or last[2] != row[0]
        starts = np.flatnonzero(new_t)
        cuts = np.r_[0, starts] if not len(starts) or starts[0] else starts
        rows, records = np.add.reduceat(new_row.astype("i8"), cuts), np.add.reduceat(new_rec.astype("i8"), cuts)
        names = [words[t[c]] for c in cuts]
        if last is not None and not new_t[0]:
            rows[0] += n_rows
            records[0] += n_records
        elif last is not None:
            yield pa.record_batch({"term": pa.array([term], pa.string()), "n_rows": pa.array([n_rows]), "n_records": pa.array([n_records])})
        if len(names) > 1:
            yield pa.record_batch({"term": pa.array(names[:-1], pa.string()), "n_rows": pa.array(rows[:-1]), "n_records": pa.array(records[:-1])})
        term, n_rows, n_records = names[-1], int(rows[-1]), int(records[-1])
        last = (term, rec[-1], row[-1])
    if last is not None:
        yield pa.record_batch({"term": pa.array([term], pa.string()), "n_rows": pa.array([n_rows]), "n_records": pa.array([n_records])})


def term_counts(pairs: DataFrame) -> DataFrame:
    """(term, n_rows, n_records) from (term, record_id, row_id): distinct rows and distinct records naming each term.

    The pairs are range-partitioned and sorted by term and record, so that the occurrences of a hot term lie in as
    many tasks as they need while one record of a term lies in one; the runs of a term that reach over several tasks
    are added up at the end.  Rows in which any of the three is null are left out; repeated rows count once.
    """
    p = pairs.select("term", F.col("record_id").cast("long").alias("record_id"), F.col("row_id").cast("long").alias("row_id")).dropna()
    runs = p.repartitionByRange("term", "record_id").sortWithinPartitions("term", "record_id", "row_id").mapInArrow(run_lengths, "term string, n_rows long, n_records long")
    return runs.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def named_terms(chunk_topics: DataFrame) -> DataFrame:
    return chunk_topics.select(written_form(term_fields(F.col("topic"))).alias("term"), F.col("chunk_id").alias("record_id"), F.col("raw_id").alias("row_id")).dropna()


def flags(counts: DataFrame, labels: DataFrame, n_records: int, common_share: float = 0.05) -> DataFrame:
    """(term, flag) as defined for p5_found; ``labels`` has (term, occurrence_count)."""
    rare = counts.where("n_records = 1").select("term", F.lit("rare").alias("flag"))
    common = counts.where(F.col("n_records") > F.lit(common_share) * F.lit(n_records)).select("term", F.lit("common").alias("flag"))
    l = labels.where("term is not null and occurrence_count is not null")
    wrong = l.join(counts, "term", "left").where(F.col("occurrence_count") != F.coalesce("n_records", F.lit(0))).select("term", F.lit("miscounted").alias("flag")).distinct()
    return rare.unionByName(common).unionByName(wrong)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    pairs = s.put("pairs", named_terms(table(spark, sf_dir, "chunk_topics")))
    counts = s.put("counts", term_counts(pairs))
    n = pairs.select("record_id").distinct().count()
    labels = table(spark, sf_dir, "topics").select(written_form(term_fields(F.col("label"))).alias("term"), "occurrence_count")
    return flags(counts, labels, n)


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, n_rows, n_chunks) of every term."""
    return term_counts(Scratch(spark).put("pairs", named_terms(table(spark, sf_dir, "chunk_topics")))).withColumnRenamed("n_records", "n_chunks")


def _sql() -> dict[str, str]:
    from lexigraph.llm.copies import term_sql

    form = lambda c: f"nullif(array_to_string({term_sql(c)}, ' / '), '')"
    cte = f"""WITH t AS (SELECT DISTINCT {form('topic')} term, chunk_id, raw_id FROM chunk_topics), p AS (SELECT * FROM t WHERE term IS NOT NULL AND chunk_id IS NOT NULL AND raw_id IS NOT NULL),
c AS (SELECT term, count(*) n_rows, count(DISTINCT chunk_id) n_chunks FROM p GROUP BY 1), n AS (SELECT count(DISTINCT chunk_id) n FROM p), l AS (SELECT {form('label')} term, occurrence_count o FROM topics)"""
    return {
        "p5_found": f"{cte} SELECT term, 'rare' AS flag FROM c WHERE n_chunks = 1 UNION ALL SELECT term, 'common' FROM c, n WHERE n_chunks > 0.05 * n UNION ALL SELECT DISTINCT l.term, 'miscounted' FROM l LEFT JOIN c ON c.term = l.term WHERE l.term IS NOT NULL AND o IS NOT NULL AND o <> coalesce(n_chunks, 0)",
        "p5_terms": f"{cte} SELECT term, n_rows, n_chunks FROM c",
    }


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}
SQL = _sql()
