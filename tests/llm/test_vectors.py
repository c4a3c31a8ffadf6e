"""Groups and neighbours of vectors against brute force."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import clusters, neighbors
from lexigraph.llm.vectors import DIM, usable
from lexigraph.session import Scratch


def planted(seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 1
    for size in (40, 12, 5, 4, 2, 1, 1, 1):
        c = rng.standard_normal(DIM)
        c /= np.linalg.norm(c)
        for _ in range(size):
            rows.append((i, ((c + rng.standard_normal(DIM) * 0.03) * rng.uniform(0.2, 5)).astype("f4")))
            i += 3
    rows += [(i, rows[0][1]), (i + 1, rows[0][1]), (i + 2, rows[45][1])]
    return rows


BAD = [(9001, None), (9002, [1.0] * 5), (9003, [0.0] * DIM), (9004, [float("nan")] * DIM), (9005, [float("inf")] + [0.0] * (DIM - 1)), (None, [1.0] * DIM), (9006, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>").withColumn("v", F.lit("clash"))


def cosines(rows):
    x = np.array([v for _, v in rows], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_usable(spark):
    assert [r.id for r in usable(frame(spark, BAD + [(1, [1.0] * DIM)]), "id", "embedding").collect()] == [1]


@pytest.mark.parametrize("seed", [0, 1])
def test_groups(spark, scratch, seed):
    rows = planted(seed)
    ids, near = np.array([i for i, _ in rows]), cosines(rows) >= 0.75
    want = set()
    for r in near:
        m = np.flatnonzero(r)
        if len(m) >= 5 and (near[m] == r).all():
            want |= {(int(ids[m].min()), int(ids[k])) for k in m}
    members, groups = clusters.similar_groups(frame(spark, rows + BAD), "id", "embedding", scratch)
    assert {(r.first_id, r.id) for r in members.collect()} == want
    assert len(want) and sum(r.n for r in groups.collect()) == len(want)


def test_typical_members_of_the_densest_cell(spark, scratch):
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, DIM)) * 2
    rows = [(i, a + rng.standard_normal(DIM) * (0.001 if i % 2 else 0.8)) for i in range(1, 15)] + [(100 + i, b + rng.standard_normal(DIM) * 0.3) for i in range(6)]
    m, g = clusters.similar_groups(frame(spark, rows), "id", "embedding", scratch)
    t = {r.first_id: r.typical for r in clusters.densest_members(m, scratch).collect()}
    assert set(t) == {1, 100} == {r.first_id for r in g.collect()} and t[1] == [1, 3, 5, 7, 9] and set(t[100]) <= set(range(100, 106))


def test_a_chain_is_no_group(spark, scratch):
    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.standard_normal((DIM, 2)))[0].T
    rows = [(i + 1, np.cos(i * 0.15) * a + np.sin(i * 0.15) * b) for i in range(9)]
    assert clusters.similar_groups(frame(spark, rows), "id", "embedding", scratch)[0].count() == 0


def test_neighbours(spark, scratch):
    rows = planted(2)
    ids, s = np.array([i for i, _ in rows]), cosines(rows).round(12)
    want = set()
    for k in range(len(ids)):
        order = sorted((-s[k, j], ids[j]) for j in range(len(ids)) if j != k)[:5]
        want |= {(int(ids[k]), int(j)) for c, j in order if -c >= 0.8}
    p = neighbors.neighbor_pairs(usable(frame(spark, rows + BAD), "id", "embedding"), scratch, 5, 0.8)
    got = {(r.id, r.other) for r in p.collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got) <= len(want)


def test_many_copies(spark, scratch):
    v = np.random.default_rng(1).standard_normal(DIM)
    p = neighbors.neighbor_pairs(usable(frame(spark, [(i, v) for i in range(1, 31)]), "id", "embedding"), scratch, 5, 0.8)
    assert {(r.id, r.other) for r in p.collect()} == {(i, j) for i in range(1, 31) for j in [x for x in range(1, 8) if x != i][:5]}


@pytest.mark.parametrize("rows", [[], BAD, [(1, [1.0] * DIM)]])
def test_next_to_nothing(spark, scratch, rows):
    df = frame(spark, rows)
    assert neighbors.neighbor_pairs(usable(df, "id", "embedding"), scratch, 5, 0.8).count() == 0
    assert clusters.similar_groups(df, "id", "embedding", scratch)[0].count() == 0


def test_graph_search_finds_the_nearest_centroids(monkeypatch):
    rng = np.random.default_rng(5)
    c = (rng.standard_normal((60, DIM))[rng.integers(0, 60, 2000)] + rng.standard_normal((2000, DIM)) * 0.2).astype("f4")
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[:300] + rng.standard_normal((300, DIM)).astype("f4") * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(neighbors, "DEGREE", 100)
    ids, d = neighbors.Centroids(c, np.arange(2000)).near(x)
    assert ids.shape == (300, 100) and np.allclose(d, ((x[:, None] - c[ids]) ** 2).sum(2), atol=1e-4)
    assert (ids[np.arange(300), d.argmin(1)] == (x @ c.T).argmax(1)).mean() >= 0.98


def test_nearest_centroids_in_little_memory():
    rng = np.random.default_rng(8)
    c = rng.standard_normal((600, DIM)).astype("f4")
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, 600, 50_000)] + rng.standard_normal((50_000, DIM)).astype("f4") * 0.01
    index = neighbors.Centroids(c, np.zeros(600, "i8"))
    tracemalloc.start()
    got = index.nearest(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # all at once it is 4 KB for each vector, 200 MB
    assert (got == (x @ c.T).argmax(1)).mean() >= 0.98


def test_neighbours_in_passes(spark, scratch, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((12, DIM)), 25, axis=0) + rng.standard_normal((300, DIM)) * 0.1
    points = usable(frame(spark, [(i, r.tolist()) for i, r in enumerate(x)]), "id", "embedding")
    near = lambda: {r.id: [y.id for y in r.near] for r in neighbors.nearest(points, scratch, 5, 0.5).collect()}
    monkeypatch.setattr(neighbors, "TASK_MEMBERS", 7)
    monkeypatch.setattr(neighbors, "LIST_SIZE", 20)
    whole = near()
    monkeypatch.setattr(neighbors, "PASS_ROWS", 1)
    counted = []
    monkeypatch.setattr(Scratch, "put_all", lambda self, name, frames, put=Scratch.put_all: put(self, name, (counted.append(1) or f for f in frames)))
    assert near() == whole and len(whole) == 300 and len(counted) > 1


def test_large_lists_are_divided(spark, scratch, monkeypatch):
    monkeypatch.setattr(neighbors, "TASK_MEMBERS", 7)
    monkeypatch.setattr(neighbors, "TASK_QUERIES", 5)
    monkeypatch.setattr(clusters, "TASK_MEMBERS", 7)
    monkeypatch.setattr(clusters, "TASK_QUERIES", 3)
    test_neighbours(spark, scratch)
    test_groups(spark, scratch, 0)


def test_neighbours_of_far_topics(spark, tmp_path):
    rng = np.random.default_rng(6)
    near = np.repeat(rng.standard_normal((120, 96)), 20, axis=0) + rng.standard_normal((2400, 96)) * 0.2
    x = np.concatenate([near, rng.standard_normal((200, 96))]).astype("f4")
    spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, embedding array<float>").write.parquet(f"{tmp_path}/topics.parquet")
    u = x.astype("f8")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert {(r.topic_id, r.other_id) for r in neighbors.p7_neighbors(spark, str(tmp_path)).collect()} == want
