"""Problem 1: groups of mutually similar vectors, by density clustering on shifted grids."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm.vectors import DIM, packed, sample, unit, unpacked, usable
from lexigraph.session import Scratch, table

DIMS, WIDTH = 32, 0.7
FIRST_GRIDS, FIRST_DENSITY = 4, 4
GRIDS, DENSITY = 16, 2
SIGNS = ["s1", "s2", "s3", "s4"]  # 256 bits
AT_ONCE = 8192  # seeds that are broadcast together (3 MB)
GROUPS = 65_536  # groups whose centres are broadcast together (25 MB)
TASK_MEMBERS, TASK_QUERIES = 8192, 8192


def principal_directions(x: np.ndarray, dims: int) -> np.ndarray:
    if not len(x):
        return np.eye(DIM, dims, dtype="f4")
    return np.linalg.eigh(np.cov(x.T.astype("f8")))[1][:, ::-1][:, :dims].astype("f4")


def first_within(x: np.ndarray, blocks: list[np.ndarray], cosine: float) -> np.ndarray:
    """For each unit vector the number of the first seed of that cosine or more, -1 where there is none."""
    out, base = np.full(len(x), -1, "i8"), 0
    for s in blocks:
        left = np.flatnonzero(out < 0)
        if len(left) and len(s):
            near = x[left] @ s.T >= cosine
            hit = near.any(1)
            out[left[hit]] = base + near[hit].argmax(1)
        base += len(s)
    return out


class Seeds:
    """The vectors that stand for the groups found so far, broadcast in blocks of AT_ONCE."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sent, self.n = spark, [], 0

    def add(self, x: np.ndarray) -> None:
        for lo in range(0, len(x), AT_ONCE):
            self.sent.append(self.spark.sparkContext.broadcast(x[lo : lo + AT_ONCE].tobytes()))
        self.n += len(x)

    def reader(self):
        sent = list(self.sent)
        return lambda: [np.frombuffer(b.value, "f4").reshape(-1, DIM) for b in sent]


def grid_cells(points: DataFrame, seeds: Seeds, basis: np.ndarray, rnd: int, cosine: float) -> DataFrame:
    """(cell, id, s1, s2, s3, s4): for every point without a group its cell in each of several shifted grids.

    The features are projections on the principal directions, quantised to cells of WIDTH at offsets that differ by
    grid and round; a cell is known by a 64-bit hash.  s1 to s4 are the signs of 256 random projections.
    """
    rng = np.random.default_rng(1000 + rnd)
    grids = FIRST_GRIDS if rnd == 0 else GRIDS
    shift = rng.uniform(0, WIDTH, (grids, basis.shape[1])).astype("f4")
    factor = rng.integers(0, 2**63, (grids, basis.shape[1]), dtype="u8") * np.uint64(2) + np.uint64(1)
    planes = np.random.default_rng(5).standard_normal((DIM, 64 * len(SIGNS))).astype("f4")
    load = seeds.reader()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = load()
        for b in batches:
            x = unit(unpacked(b.column(1)))
            free = np.flatnonzero(first_within(x, blocks, cosine) < 0)
            if not len(free):
                continue
            y, ids = x[free] @ basis, b.column(0).take(pa.array(free))
            signs = np.packbits(x[free] @ planes > 0, axis=1).view("i8").reshape(len(free), len(SIGNS))
            signs = [pa.array(np.ascontiguousarray(signs[:, k])) for k in range(len(SIGNS))]
            for g in range(grids):
                q = np.floor((y + shift[g]) / WIDTH).astype("i8").astype("u8")
                cell = (q * factor[g]).sum(1, dtype="u8") + np.uint64(g)
                cell = (cell ^ (cell >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.record_batch([pa.array(cell.view("i8")), ids, *signs], names=["cell", "id", *SIGNS])

    return points.mapInArrow(kernel, "cell long, id long, " + ", ".join(f"{x} long" for x in SIGNS))


def spread_labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, label): the least cell reachable along the edges (a, b), by propagating minimum labels to convergence.

    In each round a cell takes the least label of its neighbours, and then the label of that label.
    """
    both = scratch.put("adjacent", edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.put("labels", edges.select(F.col("a").alias("cell")).unionByName(edges.select(F.col("b").alias("cell"))).distinct().select("cell", F.col("cell").alias("label")))
    while True:
        low = both.join(labels.select(F.col("cell").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(low, F.col("cell") == F.col("a"), "left").select("cell", "label", F.least("label", F.coalesce("low", "label")).alias("new"))
        step = scratch.put("step", step)
        up = step.select(F.col("cell").alias("new"), F.col("new").alias("up"))
        labels = scratch.put("labels", step.join(up, "new").select("cell", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")))
        if labels.where("moved").isEmpty():
            scratch.drop("adjacent", "step")
            return labels.select("cell", "label")
        labels = labels.select("cell", "label")


def dense_seeds(cells: DataFrame, density: int, cosine: float, scratch: Scratch) -> DataFrame:
    """(id, n): a member of the densest cell of every component of adjacent dense cells, n its cell's count.

    Cells of different grids are adjacent if a point belongs to both.  In many dimensions cells of hashed coordinates
    also catch strangers, so a point belongs to its cell only if it is not clearly less similar to the cell's first
    point than the cosine, by the share of equal signs (three standard deviations to spare).
    """
    bits, p = 64 * len(SIGNS), math.acos(cosine) / math.pi
    differ = int(bits * p + 3 * math.sqrt(bits * p * (1 - p)))
    c = scratch.put("cells", cells)
    first = F.min(F.struct("id", *SIGNS)).alias("f")
    dense = c.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), first).where(F.col("n") >= density)
    d = scratch.put("dense", dense.select("cell", "n", F.col("f.id").alias("rep"), *[F.col(f"f.{x}").alias(f"r{x}") for x in SIGNS]))
    distance = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"r{x}"))) for x in SIGNS[1:]), F.bit_count(F.col(SIGNS[0]).bitwiseXOR(F.col(f"r{SIGNS[0]}"))))
    own = c.join(d, "cell").where(distance <= differ).select("cell", "id")
    stars = own.withColumn("a", F.min("cell").over(Window.partitionBy("id")))  # a row of each grid at most
    edges = scratch.put("edges", stars.groupBy("a", F.col("cell").alias("b")).agg(F.count(F.lit(1)).alias("m")))
    labels = spread_labels(edges, scratch)
    true_n = edges.groupBy(F.col("b").alias("cell")).agg(F.sum("m").alias("n")).where(F.col("n") >= 2)
    top = true_n.join(labels, "cell").join(d.select("cell", "rep"), "cell").groupBy("label").agg(F.max(F.struct("n", F.negative("rep").alias("r"))).alias("t"))
    return top.groupBy(F.negative("t.r").alias("id")).agg(F.max("t.n").alias("n"))


def unlike(x: np.ndarray, cosine: float) -> np.ndarray:
    """The seeds of which none is within the cosine of an earlier one."""
    keep: list[int] = []
    covered = np.zeros(len(x), bool)
    for i in range(len(x)):
        if not covered[i]:
            keep.append(i)
            covered |= x @ x[i] >= cosine
    return x[keep]


def label_counts(points: DataFrame, before: Seeds, seeds: Seeds, cosine: float) -> dict[int, int]:
    """How many points without a group lie within the cosine of each seed and of none before it."""
    old, new = before.reader(), seeds.reader()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b_ = old(), new()
        for b in batches:
            x = unit(unpacked(b.column(1)))
            x = x[first_within(x, a, cosine) < 0]
            g = first_within(x, b_, cosine)
            u, m = np.unique(g[g >= 0], return_counts=True)
            yield pa.record_batch({"g": pa.array(u), "m": pa.array(m)})

    return {r.g: r.m for r in points.mapInArrow(kernel, "g long, m long").groupBy("g").agg(F.sum("m").alias("m")).collect()}


def grouped(points: DataFrame, scratch: Scratch, cosine: float, least: int) -> DataFrame:
    """(id, g, v): the points with a group, being those within the cosine of a seed in a dense part of the grids.

    Round after round over the points that are still without a group, at other grid offsets, until a round but
    the first finds no further group of ``least`` points.  The first round looks for cells of four points, later ones for pairs.
    """
    spark = points.sparkSession
    n = points.count()
    basis = principal_directions(sample(points, n), DIMS)
    seeds, rnd, found = Seeds(spark), 0, 1
    while found or rnd < 2:
        found = 0
        s = scratch.put("seeds", dense_seeds(grid_cells(points, seeds, basis, rnd, cosine), FIRST_DENSITY if rnd == 0 else DENSITY, cosine, scratch))
        m = s.count()
        blocks = math.ceil(m / AT_ONCE)
        with_vectors = scratch.put("seed_vectors", points.join(F.broadcast(s) if m <= 100_000 else s, "id").select("id", "n", "v")) if m else None
        for k in range(blocks):
            t = with_vectors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow().sort_by([("n", "descending"), ("id", "ascending")])
            x = unlike(unit(unpacked(t["v"])), cosine) if t.num_rows else np.zeros((0, DIM), "f4")
            x = x[first_within(x, seeds.reader()(), cosine) < 0]
            if not len(x):
                continue
            trial = Seeds(spark)
            trial.add(x)
            counts = label_counts(points, seeds, trial, cosine)
            good = sorted(g for g, c in counts.items() if c >= least)
            seeds.add(x[good])
            found += len(good)
        rnd += 1
    load = seeds.reader()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = load()
        for b in batches:
            g = first_within(unit(unpacked(b.column(1))), blocks, cosine)
            yield pa.record_batch([b.column(0), pa.array(g), b.column(1)], names=["id", "g", "v"])

    scratch.drop("cells", "dense", "edges", "labels", "seeds", "seed_vectors")
    return points.mapInArrow(kernel, "id long, g long, v binary")


def centres(members: DataFrame) -> DataFrame:
    """(g, n, first_id, c): size, smallest id and mean direction of each group, from partial sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, i, m = np.unique(b.column(1).to_numpy(), return_inverse=True, return_counts=True)
            sums = np.zeros((len(g), DIM))
            np.add.at(sums, i, unit(unpacked(b.column(2))))
            low = np.full(len(g), np.iinfo("i8").max)
            np.minimum.at(low, i, b.column(0).to_numpy())
            yield pa.record_batch([pa.array(g), pa.array(m), pa.array(low), pa.array([x.tobytes() for x in sums], pa.binary())], names=["g", "n", "low", "s"])

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.frombuffer(b"".join(pdf["s"]), "f8").reshape(-1, DIM).sum(0)
        return pd.DataFrame({"g": [key[0]], "n": [int(pdf["n"].sum())], "first_id": [int(pdf["low"].min())], "c": [unit(s[None])[0].tobytes()]})

    return members.mapInArrow(partial, "g long, n long, low long, s binary").groupBy("g").applyInPandas(whole, "g long, n long, first_id long, c binary")


def verified(points: DataFrame, scratch: Scratch, cosine: float, least: int) -> DataFrame:
    """(g, n, first_id, c) of the groups in which any two members reach the cosine and no other point does with any.

    In blocks of about GROUPS groups, whose centres each task holds.
    """
    c = scratch.put("centres", centres(points.where("g >= 0"))).where(F.col("n") >= least)
    blocks = max(1, math.ceil(c.count() / GROUPS))
    part = lambda k: c.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == k) if blocks > 1 else c
    return reduce(DataFrame.unionByName, [verified_block(points, part(k), cosine) for k in range(blocks)])


def verified_block(points: DataFrame, c: DataFrame, cosine: float) -> DataFrame:
    """The groups of ``c`` that are right, as of ``verified``.

    Exact: with r the greatest angle of a member to its group's centre and t that of the cosine, two members can only
    miss it if one is more than t / 2 from the centre, and an outside point can only reach it within r + t.  Those
    points are held against all members; groups and such points are divided among tasks, nothing is collected.
    """
    spark = points.sparkSession
    members = points.where("g >= 0")
    t = c.orderBy("g").select("g", "c").toArrow()  # at most about GROUPS rows
    gs = t["g"].to_numpy()
    sent = spark.sparkContext.broadcast(pickle.dumps((gs, b"".join(t["c"].to_pylist()))))

    def load():
        g, c = pickle.loads(sent.value)
        return g, np.frombuffer(c, "f4").reshape(-1, DIM)

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gs, cs = load()
        for b in batches:
            g = b.column(1).to_numpy()
            at = np.searchsorted(gs, g)
            ok = (at < len(gs)) & (gs[np.minimum(at, len(gs) - 1)] == g) if len(gs) else np.zeros(len(g), bool)
            cos = np.einsum("ij,ij->i", unit(unpacked(b.column(2)))[ok], cs[at[ok]])
            u, i = np.unique(g[ok], return_inverse=True)
            low = np.full(len(u), 2.0)
            np.minimum.at(low, i, cos)
            yield pa.record_batch({"g": pa.array(u), "low": pa.array(low, pa.float64())})

    least_cos = {r.g: r.low for r in members.mapInArrow(radius, "g long, low double").groupBy("g").agg(F.min("low").alias("low")).collect()}
    t0 = math.acos(cosine)
    reach = np.array([math.cos(min(math.pi, t0 + math.acos(max(-1.0, min(1.0, least_cos[g]))))) for g in gs.tolist()]) - 1e-4
    loose = math.cos(t0 / 2) + 1e-4
    bounds = spark.sparkContext.broadcast(reach.tobytes())

    def queries_of(b: pa.RecordBatch, gs, cs, reach):
        """(rows, group numbers, own): whom to compare with all members of which group."""
        s = unit(unpacked(b.column(2))) @ cs.T
        g = b.column(1).to_numpy()
        own = gs[None, :] == g[:, None]
        return *np.nonzero(np.where(own, s < loose, s >= reach)), own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gs, cs = load()
        reach = np.frombuffer(bounds.value)
        for b in batches:
            if len(gs):
                for lo in range(0, b.num_rows, 1024):
                    j, m = np.unique(queries_of(b.slice(lo, 1024), gs, cs, reach)[1], return_counts=True)
                    yield pa.record_batch({"g": pa.array(gs[j]), "m": pa.array(m)})

    q = {r.g: r.m for r in points.mapInArrow(count, "g long, m long").groupBy("g").agg(F.sum("m").alias("m")).collect()}
    if not q:
        return c
    size = {r.g: r.n for r in c.select("g", "n").collect()}
    split = np.array([(math.ceil(size[g] / TASK_MEMBERS), math.ceil(q.get(g, 0) / TASK_QUERIES)) for g in gs.tolist()], "i8")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gs, cs = load()
        reach = np.frombuffer(bounds.value)
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                b = big.slice(lo, 1024)
                ids, g = b.column(0).to_numpy(), b.column(1).to_numpy()
                h = (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype("i8")
                rows, at, own = queries_of(b, gs, cs, reach)
                j = np.minimum(np.searchsorted(gs, g), len(gs) - 1)
                who = np.flatnonzero((gs[j] == g) & (split[j, 1] > 0))
                for role, (r, k) in enumerate(((who, j[who]), (rows, at))):
                    mine, other = h[r] % np.maximum(1, split[k, role]), split[k, 1 - role]
                    e = np.repeat(np.arange(len(r)), other)
                    if not len(e):
                        continue
                    theirs = np.arange(len(e)) - np.repeat(np.r_[0, np.cumsum(other)[:-1]], other)
                    ms, qs = (mine[e], theirs) if role == 0 else (theirs, mine[e])
                    kind = np.zeros(len(e), "i4") if role == 0 else np.where(own[r, k][e], 1, 2).astype("i4")
                    yield pa.record_batch([pa.array(gs[k[e]]), pa.array(ms), pa.array(qs), pa.array(kind), b.column(2).take(pa.array(r[e]))], names=["g", "ms", "qs", "kind", "v"])

    def compare(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        x = unpacked(t["v"]).astype("f8")
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        m, bad = x[kind == 0], False
        for k in (1, 2):
            y = x[kind == k]
            for lo in range(0, len(y), 512):
                s = y[lo : lo + 512] @ m.T
                bad |= bool((s < cosine - 1e-12).any() if k == 1 else (s >= cosine).any())
        return pa.table({"g": pa.array([t["g"][0].as_py()] if bad else [], pa.int64())})

    wrong = points.mapInArrow(spread, "g long, ms long, qs long, kind int, v binary").groupBy("g", "ms", "qs").applyInArrow(compare, "g long").distinct()
    return c.join(wrong, "g", "left_anti")


def similar_groups(df: DataFrame, id_col: str, embedding_col: str, scratch: Scratch, cosine: float = 0.75, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of the groups of ``least`` or more usable vectors of which any two have that cosine, while
    every other vector has less with each of them.

    members (first_id, id, v), groups (first_id, n, c): size and mean direction.  Rows without a usable embedding are in
    no group; copies are members like any other.  Grid density finds the groups (its only loss would be one of which no
    two members share a cell in any grid), comparison of whole vectors confirms them.
    """
    scratch = scratch.fresh()
    points = scratch.put("points", usable(df, id_col, embedding_col))
    labelled = scratch.put("labelled", grouped(points, scratch, cosine, least))
    scratch.drop("points")
    groups = scratch.put("groups", verified(labelled, scratch, cosine, least))
    g = groups.select("g", "first_id")
    m = labelled.where("g >= 0").join(F.broadcast(g) if groups.count() <= 100_000 else g, "g")
    return m.select("first_id", "id", "v"), groups.select("first_id", "n", "c")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = similar_groups(table(spark, sf_dir, "topics"), "id", "embedding", Scratch(spark))
    return m.select(F.col("first_id").alias("first_topic_id"), F.col("id").alias("topic_id"))


def densest_members(members: DataFrame, scratch: Scratch, most: int = 5) -> DataFrame:
    """(first_id, typical): of each group the ``most`` members of its densest cells, by how many of the group share a
    member's cell in all grids together, the smaller id first among equals."""
    m = members.select("first_id", "id", "v")
    basis = principal_directions(sample(m.select("id", "v"), m.count()), DIMS)
    grid = grid_cells(m.select("id", "v"), Seeds(scratch.spark), basis, 0, 2.0)  # no seed: all points
    cells = scratch.put("typical_cells", grid.select("cell", "id").join(m.select("first_id", "id"), "id"))
    n = cells.groupBy("first_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    dense = cells.join(n, ["first_id", "cell"]).groupBy("first_id", "id").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("first_id").orderBy(F.desc("n"), "id"))
    few = dense.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("first_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("typical"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first_topic_id, size, typical): every group with its size and the five topics of its densest cells."""
    s = Scratch(spark)
    m, g = similar_groups(table(spark, sf_dir, "topics"), "id", "embedding", s)
    return g.join(densest_members(m, s), "first_id").select(F.col("first_id").alias("first_topic_id"), F.col("n").alias("size"), "typical")


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters}
SQL = {
    "p1_found": """WITH t AS (SELECT id, CAST(embedding AS DOUBLE[]) e FROM topics WHERE len(embedding) = 96 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT a.id i, list_sort(list(b.id)) l FROM t a JOIN t b ON a.id = b.id OR list_cosine_similarity(a.e, b.e) >= 0.75 GROUP BY 1)
SELECT first_topic_id, topic_id FROM (SELECT min(i) OVER (PARTITION BY l) first_topic_id, i topic_id, count(*) OVER (PARTITION BY l) n, len(l) m FROM s) WHERE n >= 5 AND n = m"""
}
