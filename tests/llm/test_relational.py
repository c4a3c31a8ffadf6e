"""Copies, components, frequencies and co-occurrence, on hard little tables."""

import random

import pytest
from pyspark.sql import functions as F

from lexigraph.functions.terms import term_fields, written_form
from lexigraph.llm import components, copies, frequencies, together


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("label,form", [("The  Sea's_edge / B", "b / the seas edge"), ("b;a,a", "a / a / b"), (" ; - ", None), ("", None), (None, None), ("x’y 12", "xy 12")])
def test_written_form(spark, label, form):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(written_form(term_fields(F.col("l")))).first()[0] == form


def test_copies_collapse_whatever_the_order(spark):
    df = spark.createDataFrame([(1, "A / b"), (2, "b; a"), (2, "b; a"), (3, "a / b / b"), (4, None), (None, "a / b"), (5, "..."), (6, "B,A")], "id long, label string").withColumn("scope", F.lit("clash")).withColumn("fp1", F.lit(1))
    p = copies.copy_pairs(copies.fingerprinted(df, "id", term_fields(F.col("label"))))
    assert rows(p) == [(0, 1, 2), (0, 1, 6)]


def test_copies_of_very_long_records(spark):
    long = " / ".join(f"w{i}" for i in range(300))
    back = " / ".join(f"W{i}" for i in reversed(range(300)))
    df = spark.createDataFrame([(1, long), (2, back), (3, long + " / w1")], "id long, label string")
    assert rows(copies.copy_pairs(copies.fingerprinted(df, "id", term_fields(F.col("label"))))) == [(0, 1, 2)]


def test_records_of_several_columns(spark):
    df = spark.createDataFrame([(1, "A  b", "c"), (2, "a-B", "C!"), (3, "c", "a b"), (4, None, None)], "id long, x string, y string")
    assert rows(copies.copy_pairs(copies.fingerprinted(df, "id", copies.record_parts(["x", "y"])))) == [(0, 1, 2)]


def test_no_copies_of_nothing(spark):
    df = spark.createDataFrame([], "id long, label string")
    assert rows(copies.copy_pairs(copies.fingerprinted(df, "id", term_fields(F.col("label"))))) == []


def groups_of(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] * 2 + [(5, 0)], [(random.Random(s).randrange(60), random.Random(s + 1).randrange(60)) for s in range(50)]])
def test_components(spark, scratch, edges):
    got = components.boruvka(spark.createDataFrame(edges, "a long, b long"), scratch)
    assert rows(got) == groups_of(edges)


def test_matches_name_topics_by_id_or_label(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "3")], "id long, label string")
    m = spark.createDataFrame([(1, None, None, "b"), (9, 1, "a", None), (None, None, "3", "a"), (None, None, None, "a"), (None, 2, "B", None)], "topic1_id long, topic2_id long, topic1_label string, topic2_label string")
    assert rows(components.resolved_matches(m, t)) == [(1, 2), (3, 1)]


def test_term_counts_over_many_batches(spark):
    rng = random.Random(4)
    data = [(rng.choice("hhhhhabc") * (i % 5 // 4 + 1), rng.randrange(40), i // 2) for i in range(3000)] + [(None, 1, 1), ("a", None, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(frequencies.term_counts(spark.createDataFrame(data, "term string, record_id long, row_id long")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    full = {x for x in data if None not in x}
    assert got == sorted((t, len({(r, i) for x, r, i in full if x == t}), len({r for x, r, _ in full if x == t})) for t in {x[0] for x in full})


def test_term_counts_of_nothing(spark):
    assert rows(frequencies.term_counts(spark.createDataFrame([], "term string, record_id long, row_id long"))) == []


@pytest.mark.parametrize("block", [2, 5, 64])
def test_large_baskets_in_blocks(spark, block):
    rng = random.Random(1)
    links = {(b, rng.randrange(25)) for b in range(20) for _ in range(3)} | {(99, i) for i in range(25)}
    want = {}
    for b in {x for x, _ in links}:
        items = sorted(i for x, i in links if x == b)
        for i, x in enumerate(items):
            for y in items[i + 1 :]:
                want[x, y] = want.get((x, y), 0) + 1
    got = together.pair_counts(spark.createDataFrame(sorted(links), "basket long, item long"), block)
    assert rows(got) == sorted((x, y, n) for (x, y), n in want.items())


def test_pruned_associations_lose_nothing(spark, scratch):
    rng = random.Random(2)
    links = [(b, i) for b in range(60) for i in {0, rng.randrange(1, 20), rng.randrange(1, 20)}] * 2 + [(None, 1), (1, None)]
    df = spark.createDataFrame(links, "basket long, item long").withColumn("n", F.lit(1))
    every = together.associations(df, scratch)
    assert rows(together.associations(df, scratch, 2, 2.0)) == rows(every.where("n12 >= 2 and n12 * n >= 2 * n1 * n2"))


def test_associations_of_nothing(spark, scratch):
    assert rows(together.associations(spark.createDataFrame([], "basket long, item long"), scratch, 2, 2.0)) == []


def test_pairs_of_one_common_chunk(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "chunk_id long, topic_id long").write.parquet(f"{tmp_path}/chunk_topic_links.parquet")
    got = {(r.topic1_id, r.topic2_id, r.n12) for r in together.QUERIES["p6_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}


def test_a_class_of_a_third_of_all_rows(spark):
    data = [(i, "B / a" if i % 2 else "a; b") for i in range(2000)] + [(2000 + i, f"t{i}") for i in range(4000)]
    df = spark.createDataFrame(data, "id long, label string")
    p = copies.copy_pairs(copies.fingerprinted(df, "id", term_fields(F.col("label"))))
    assert {(r.first_id, r.other_id) for r in p.collect()} == {(0, i) for i in range(1, 2000)}


def test_terms_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    data = [(0, 1, ["a", "b"]), (0, 2, ["b", "a"]), (0, 2, ["b", "a"]), (1, 1, ["a", "b"]), (0, 3, ["c"]), (1, 4, ["c", "c"]), (0, None, ["c"]), (0, 5, []), (0, 6, None)]
    df = spark.createDataFrame(data, "kind int, id long, parts array<string>")
    want = [("a / b", 2, 1), ("c", 1, 0), ("c / c", 0, 1)]
    assert rows(copies.counted_terms(df)) == want
    monkeypatch.setattr(copies, "multiset_hash", lambda parts, seed: F.lit(7).cast("long"))
    distinct = df.withColumn("id", F.col("id") + F.when(F.col("kind") == 1, 10).otherwise(0))  # no id under two kinds
    assert rows(copies.counted_terms(distinct)) == want


def test_a_star_and_a_chain(spark, scratch):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(300)]
    got = {r.node: r.group_id for r in components.boruvka(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{5000 + i: 5000 for i in range(301)}}
