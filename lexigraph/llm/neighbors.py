"""Problem 7: the most similar vectors of every vector, by balanced posting lists."""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.vectors import SAMPLE, exact_cosine, packed, sample, unit, unpacked, usable
from lexigraph.session import Scratch, table

PART = 16  # vectors of the sample for one centroid
LIST_SIZE, LIST_REACH = 6000, 0.45  # a posting list joins near centroids, up to so many vectors and so far apart
REPLICATE, PROBE = 0.02, 0.25  # distance ratios beyond the nearest centroid
SLACK = 0.1  # and, for vectors far from every centroid, squared distance beyond the nearest
RING, RINGS = 0.25, 16  # it is known in which rings of this width around each centroid members lie
TASK_MEMBERS, TASK_QUERIES = 8192, 16_384
ENTRIES, DEGREE = 8, 512  # entries of the graph for each square root of a centroid; centroids that an entry leads to
PASS_ROWS = 2**20  # members and queries that a pass shuffles, but as many as there are vectors at least
SHARE, MOST_SAMPLE = 8, 200_000  # the index is fitted on an eighth of the vectors, between 20,000 and so many


def balanced_centroids(x: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Centroids of parts of at most ``most`` vectors: k-means again and again on whatever part is too large; a part
    that k-means can't divide is halved along its widest direction."""
    rng, out, stack = np.random.default_rng(seed), [], [x]
    while stack:
        p = stack.pop()
        if len(p) <= most:
            if len(p):
                out.append(p.mean(0))
            continue
        k = min(16, math.ceil(len(p) / most) + 1)
        c = p[rng.choice(len(p), k, replace=False)]
        for _ in range(8):
            a = np.argmin((c * c).sum(1) - p @ (2 * c).T, axis=1)
            c = np.stack([p[a == j].mean(0) if (a == j).any() else c[j] for j in range(k)])
        parts = [p[a == j] for j in range(k)]
        if max(map(len, parts)) > 0.95 * len(p):
            y = p - p.mean(0)
            o = np.argsort(y @ np.linalg.svd(y[:2000], full_matrices=False)[2][0], kind="stable")
            parts = [p[o[: len(p) // 2]], p[o[len(p) // 2 :]]]
        stack += parts
    return np.array(out, "f4").reshape(-1, x.shape[1])


def joined(c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of each centroid's posting list: from the largest on, a centroid takes the nearest free ones within
    LIST_REACH, as long as the list holds at most LIST_SIZE vectors."""
    lists, free, n = np.full(len(c), -1, "i8"), np.ones(len(c), bool), 0
    sq = (c * c).sum(1)
    for i in np.argsort(-sizes, kind="stable"):
        if free[i]:
            d = sq + sq[i] - c @ (2 * c[i])
            d[i] = -1
            o = np.flatnonzero(free & (d <= LIST_REACH**2))
            o = o[np.argsort(d[o], kind="stable")]
            take = np.r_[i, o[1:][np.cumsum(sizes[o])[1:] <= LIST_SIZE]]
            lists[take], free[take] = n, False
            n += 1
    return lists


def spread_out(c: np.ndarray, n: int) -> np.ndarray:
    """n centroids, each the farthest from those before it, so that every region has an entry."""
    out, sq = [0], (c * c).sum(1)
    far = sq + sq[0] - c @ (2 * c[0])
    while len(out) < min(n, len(c)):
        i = int(far.argmax())
        out.append(i)
        far = np.minimum(far, sq + sq[i] - c @ (2 * c[i]))
    return np.array(out)


class Centroids:
    """The centroids, the posting list of each, and a graph to search them: entries spread over all regions, each with
    edges to the DEGREE centroids nearest to it.  A vector goes to its nearest entry and along its edges.

    ``occupied`` tells in which rings around each centroid there are members; unknown, everywhere.
    """

    def __init__(self, c: np.ndarray, lists: np.ndarray, graph: tuple[np.ndarray, np.ndarray] | None = None, occupied: np.ndarray | None = None):
        self.c, self.lists, self.sq = c, lists, (c * c).sum(1)
        self.occupied = np.concatenate([np.zeros((len(c), 1), "i8"), np.cumsum(occupied if occupied is not None else np.ones((len(c), RINGS), bool), axis=1)], axis=1)
        self.entries, self.edges = graph or self.graph()

    def graph(self) -> tuple[np.ndarray, np.ndarray]:
        entries, k = spread_out(self.c, ENTRIES * math.ceil(len(self.c) ** 0.5)), min(DEGREE, len(self.c))
        near = [np.argpartition(self.sq - 2 * self.c[entries[i : i + 256]] @ self.c.T, k - 1, axis=1)[:, :k] for i in range(0, len(entries), 256)]
        return entries, np.concatenate(near).astype("i4")

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, squared distances), a row for each unit vector."""
        entry = (self.sq[self.entries] - 2 * x @ self.c[self.entries].T).argmin(1)
        ids = self.edges[entry]
        d = np.empty(ids.shape, "f4")
        order = np.argsort(entry, kind="stable")
        cut = np.flatnonzero(np.r_[True, entry[order][1:] != entry[order][:-1], True]) if len(x) else [0]
        for lo, hi in zip(cut[:-1], cut[1:]):
            rows, to = order[lo:hi], self.edges[entry[order[lo]]]
            d[rows] = x[rows] @ (-2 * self.c[to].T) + (1 + self.sq[to])
        return ids, d

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each, in blocks, as ``near`` takes 4 KB for a vector."""
        out = np.empty(len(x), "i8")
        for lo in range(0, len(x), 4096):
            ids, d = self.near(x[lo : lo + 4096])
            out[lo : lo + 4096] = ids[np.arange(len(ids)), d.argmin(1)]
        return out


def places(x: np.ndarray, index: Centroids, reach: float, probe: float, replicate: float):
    """((vector, list, centroid, ring) of the members, (vector, list) of the queries) for unit vectors x.

    A member lies in the list of its nearest centroid, and on a boundary also in those of every centroid that is at
    most ``replicate`` farther.  A query looks into the lists of the centroids that are at most ``probe`` farther than
    the nearest one (and SLACK in squared distance, so that a vector far from all centroids doesn't look everywhere),
    but not where no ring has members that can lie within ``reach`` of it (exact, by the triangle inequality).
    """
    ids, sq = index.near(x)
    d1 = np.maximum(1e-12, sq.min(1, keepdims=True))
    mi, mj = np.nonzero(sq <= d1 * (1 + replicate) ** 2)
    mc = ids[mi, mj].astype("i8")
    ring = np.minimum(RINGS - 1, np.sqrt(np.maximum(0, sq[mi, mj])) / RING).astype("i8")
    qi, qj = np.nonzero(sq <= np.minimum(d1 * (1 + probe) ** 2, d1 + SLACK))
    qc, d = ids[qi, qj].astype("i8"), np.sqrt(np.maximum(0, sq[qi, qj]))
    lo = np.minimum(RINGS - 1, np.maximum(0, (d - reach) / RING - 1e-3)).astype("i8")
    hi = np.minimum(RINGS - 1, (d + reach) / RING + 1e-3).astype("i8") + 1
    ok = index.occupied[qc, hi] > index.occupied[qc, lo]
    n = len(index.c)
    q = np.unique(qi[ok] * n + index.lists[qc[ok]])
    return (mi, index.lists[mc], mc, ring), (q // n, q % n)


def nearest(points: DataFrame, scratch: Scratch, k: int = 5, min_cosine: float = -1.0, probe: float = PROBE) -> DataFrame:
    """(id, near): for every point the at most k most similar other points of cosine >= min_cosine, best first and the
    smaller id first among equals, as array<struct<far double, id long>> with far = -cosine.

    ``points`` (id, v) has distinct ids.  The index is fitted on a sample of an eighth of the vectors, from 20,000
    to 200,000, but every vector is a member and a query.  A list with more members or queries than a task should hold is divided, each part of the one
    against each part of the other, so nothing is dropped and no task holds more than 8,192 and 16,384.  The lists are
    gone through in passes, so that the vectors are on disk about once more, however many lists hold them.
    """
    scratch, spark = scratch.fresh(), points.sparkSession
    n = points.count()
    s = sample(points, n, min(MOST_SAMPLE, max(SAMPLE, n // SHARE)))
    if not len(s):
        return spark.createDataFrame([], "id long, near array<struct<far:double,id:long>>")
    c = balanced_centroids(s, PART)
    index = Centroids(c, np.zeros(len(c), "i8"))
    lists = joined(c, np.bincount(index.nearest(s), minlength=len(c)) * (n / len(s)))
    del s
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine)) + 1e-3
    sent = spark.sparkContext.broadcast(pickle.dumps((c, lists, (index.entries, index.edges))))

    def placed(batches: Iterator[pa.RecordBatch], occupied: np.ndarray | None = None):
        index = Centroids(*pickle.loads(sent.value), occupied)
        for b in batches:
            for lo in range(0, b.num_rows, 8192):
                part = b.slice(lo, 8192)
                yield part, places(unit(unpacked(part.column(1))), index, reach, probe, REPLICATE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ((_, of, cs, rings), (_, to)) in placed(batches):
            for role, key in enumerate((of, to, cs * RINGS + rings)):
                k, m = np.unique(key, return_counts=True)
                yield pa.record_batch({"role": pa.array([role] * len(k), pa.int32()), "key": pa.array(k), "m": pa.array(m)})

    # At most 18 rows for each centroid, of which there are fewer than vectors in the sample, 200,000 at most.
    sizes = points.mapInArrow(count, "role int, key long, m long").groupBy("role", "key").agg(F.sum("m").alias("m")).toArrow()
    role, key, m = (sizes[x].to_numpy() for x in ("role", "key", "m"))
    split = np.ones((len(c), 2), "i8")
    for r, most in enumerate((TASK_MEMBERS, TASK_QUERIES)):
        split[key[role == r], r] = -(-m[role == r] // most)
    occupied = np.zeros(len(c) * RINGS, bool)
    occupied[key[role == 2]] = True
    layout = spark.sparkContext.broadcast(pickle.dumps((occupied.reshape(-1, RINGS), split)))

    rows = sum(int((m[role == r] * split[key[role == r], 1 - r]).sum()) for r in (0, 1))
    passes = math.ceil(rows / max(PASS_ROWS, n)) or 1

    def spread(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        occupied, split = pickle.loads(layout.value)
        for b, ((mw, of, _, _), (qw, to)) in placed(batches, occupied):
            ids = b.column(0).to_numpy()
            one = np.unique(mw * len(split) + of)
            for role, (who, key) in enumerate(((one // len(split), one % len(split)), (qw, to))):
                now = key % passes == turn
                who, key = who[now], key[now]
                own, other = split[key, role], split[key, 1 - role]
                mine = (ids[who].astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype("i8") % own
                r = np.repeat(np.arange(len(who)), other)
                theirs = np.arange(len(r)) - np.repeat(np.r_[0, np.cumsum(other)[:-1]], other) if len(r) else r
                ms, qs = (mine[r], theirs) if role == 0 else (theirs, mine[r])
                task = (key[r] << 40) + (ms << 20) + qs
                if len(r):
                    yield pa.record_batch([pa.array(task), pa.array([bool(role)] * len(r)), pa.array(ids[who[r]]), b.column(1).take(pa.array(who[r]))], names=["task", "query", "id", "v"])

    def compare(pdf: pa.Table) -> pa.Table:
        q = pdf.filter(pdf["query"])
        m = pdf.filter(pa.compute.invert(pdf["query"])).sort_by("id")
        qi, mi, qx, mx = q["id"].to_numpy(), m["id"].to_numpy(), unpacked(q["v"]), unpacked(m["v"])
        rows, fars, nears = [], [], []
        if len(qi) and len(mi):
            mu, w = unit(mx), min(k + 4, len(mi))
            for lo in range(0, len(qi), 512):
                ids = qi[lo : lo + 512]
                s = unit(qx[lo : lo + 512]) @ mu.T
                at = np.minimum(np.searchsorted(mi, ids), len(mi) - 1)
                same = np.flatnonzero(mi[at] == ids)
                s[same, at[same]] = -3
                some = np.flatnonzero(s.max(1) >= min_cosine - 1e-5)
                s = s[some]
                top = np.argpartition(s, len(mi) - w, axis=1)[:, len(mi) - w :] if w < len(mi) else np.broadcast_to(np.arange(len(mi)), s.shape)
                val = np.take_along_axis(s, top, 1)
                i, j = np.nonzero((val >= min_cosine - 1e-5) & (val > -2))
                cos = exact_cosine(qx[lo + some[i]], mx[top[i, j]])
                keep = cos >= min_cosine
                rows.append(lo + some[i][keep])
                fars.append(-cos[keep])
                nears.append(mi[top[i, j]][keep])
        r = np.concatenate(rows) if rows else np.zeros(0, "i8")
        far, near = (np.concatenate(fars), np.concatenate(nears)) if rows else (np.zeros(0), np.zeros(0, "i8"))
        o = np.lexsort((near, far, r))
        r, far, near = r[o], far[o], near[o]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, "i8")
        keep = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k if len(r) else np.zeros(0, bool)
        r, far, near = r[keep], far[keep], near[keep]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, "i8")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(r)].astype("i4")), pa.StructArray.from_arrays([pa.array(far, pa.float64()), pa.array(near, pa.int64())], ["far", "id"]))
        return pa.table({"id": pa.array(qi[r[first]], pa.int64()), "near": lists})

    kind = "array<struct<far:double,id:long>>"
    met = lambda turn: points.mapInArrow(functools.partial(spread, turn=turn), "task long, query boolean, id long, v binary").groupBy("task").applyInArrow(compare, f"id long, near {kind}")
    found = met(0) if passes == 1 else scratch.put_all("found", map(met, range(passes)))
    g = found.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))  # k rows at most of each list probed
    return g.select("id", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))


def nearest_of_all(points: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """(id, near) as of ``nearest``, exact however far the neighbours are.

    The posting lists give every point a cosine that its k-th neighbour can't be below.  Points that are far from all
    centroids would have to look into nearly every list then, so all points are held against all others, in blocks of
    queries that are broadcast, and only what reaches that cosine is kept.
    """
    first = nearest(points, scratch, k)
    least = first.select("id", F.when(F.size("near") >= k, -F.element_at("near", k)["far"]).otherwise(-1.0).alias("least"))
    queries = scratch.put("queries", points.join(least, "id", "left").select("id", "v", F.coalesce("least", F.lit(-1.0)).alias("least")))
    blocks, found = math.ceil(queries.count() / TASK_QUERIES), []
    for n in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow()
        if not len(q):
            continue
        sent = points.sparkSession.sparkContext.broadcast(pickle.dumps((q["id"].to_numpy(), unpacked(q["v"]), q["least"].to_numpy())))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qi, qx, least = pickle.loads(sent.value)
            qu, floor = unit(qx).T, (least - 1e-5).astype("f4")
            for big in batches:
                for lo in range(0, big.num_rows, 1024):
                    b = big.slice(lo, 1024)
                    ids, x = b.column(0).to_numpy(), unpacked(b.column(1))
                    i, j = np.nonzero(unit(x) @ qu >= floor)
                    other = ids[i] != qi[j]
                    i, j = i[other], j[other]
                    parts = [slice(a, a + 65_536) for a in range(0, len(j), 65_536)]
                    far, near = -np.concatenate([np.zeros(0), *[exact_cosine(qx[j[p]], x[i[p]]) for p in parts]]), ids[i]
                    o = np.lexsort((near, far, j))
                    j, far, near = j[o], far[o], near[o]
                    first = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.zeros(0, "i8")
                    keep = np.arange(len(j)) - np.repeat(first, np.diff(np.r_[first, len(j)])) < k
                    yield pa.record_batch([pa.array(qi[j[keep]]), pa.array(far[keep]), pa.array(near[keep])], names=["id", "far", "near"])

        g = points.select("id", "v").mapInArrow(scan, "id long, far double, near long").groupBy("id").agg(F.collect_list(F.struct("far", F.col("near").alias("id"))).alias("near"))
        found.append(scratch.put(f"all{n}", g.select("id", F.slice(F.array_sort("near"), 1, k).alias("near"))))
        sent.destroy()
    return functools.reduce(DataFrame.unionByName, found) if found else first


def copy_classes(points: DataFrame, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame]:
    """(points without copies, classes): vectors of equal values are one class, of which only the smallest id stays.

    classes (rep, id, place): the members of each class of two or more in order of their ids.  Only the first k + 1 can
    be a neighbour, so a class of any size needs no more.
    """
    h = scratch.put("hashes", points.select("id", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")))
    reps = h.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.put("copies", h.join(reps, ["h1", "h2"]).select("rep", "id"))
    return points.join(members.where("id <> rep").select("id"), "id", "left_anti"), members


def neighbor_pairs(points: DataFrame, scratch: Scratch, k: int, min_cosine: float, probe: float = PROBE, whole: bool = False) -> DataFrame:
    """(id, other, cosine): the at most k most similar other points of each, of cosine >= min_cosine.

    With ``whole`` they are exact, however far, and the least cosine must be -1.  Copies are looked up once for each
    class: a point's classmates come first, of each class met the smallest ids.
    """
    scratch = scratch.fresh()
    single, members = copy_classes(points, scratch, k)
    near = scratch.put("near", nearest_of_all(single, scratch, k) if whole else nearest(single, scratch, k, min_cosine, probe))
    if members.isEmpty():
        e = near.select("id", F.explode("near").alias("n"))
        return e.select("id", F.col("n.id").alias("other"), (-F.col("n.far")).alias("cosine"))
    from pyspark.sql import Window

    first = members.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1)
    first = scratch.put("first", first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    e = near.select("id", F.explode("near").alias("n")).select("id", "n.far", F.col("n.id").alias("rep")).join(first, "rep", "left")
    e = e.select("id", F.explode(F.transform(F.coalesce("ids", F.array("rep")), lambda x: F.struct(F.col("far").alias("far"), x.alias("id")))).alias("n"))
    e = e.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("near"))  # k * (k + 1) at most
    mates = members.join(first, "rep").select("rep", "id", F.transform(F.array_except("ids", F.array("id")), lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("id"))).alias("mates"))
    own = mates.join(e.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.slice(F.concat("mates", F.coalesce("near", F.slice("mates", 1, 0))), 1, k).alias("near"))
    alone = e.join(members.select("id"), "id", "left_anti")
    x = alone.unionByName(own).select("id", F.explode("near").alias("n"))
    return x.select("id", F.col("n.id").alias("other"), (-F.col("n.far")).alias("cosine"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    points = s.put("points", usable(table(spark, sf_dir, "topics"), "id", "embedding"))
    p = neighbor_pairs(points, s, 5, 0.8)
    return p.select(F.least("id", "other").alias("topic1_id"), F.greatest("id", "other").alias("topic2_id")).distinct()


def p7_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, other_id, cosine): the five most similar topics of every topic, however far."""
    s = Scratch(spark)
    p = neighbor_pairs(s.put("points", usable(table(spark, sf_dir, "topics"), "id", "embedding")), s, 5, -1.0, whole=True)
    return p.select(F.col("id").alias("topic_id"), F.col("other").alias("other_id"), F.round("cosine", 6).alias("cosine"))


QUERIES = {"p7_found": p7_found, "p7_neighbors": p7_neighbors}
_E = "WITH t AS (SELECT id, CAST(embedding AS DOUBLE[]) e FROM topics WHERE len(embedding) = 96 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"
SQL = {
    "p7_found": f"""{_E}, s AS (SELECT a.id i, b.id j, list_cosine_similarity(a.e, b.e) c FROM t a JOIN t b ON a.id <> b.id),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, j) <= 5) SELECT DISTINCT least(i, j) AS topic1_id, greatest(i, j) AS topic2_id FROM r WHERE c >= 0.8"""
}
