"""Community detection and the measures of partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.scoring import log_grid
from lexigraph.operators import tables
from lexigraph.operators.graph import both_ways, components
from lexigraph.session import Scratch

TASK_EDGES = 2_000_000  # of a component that a task takes whole, in about 500 MB


def local_moves(adj: list[dict[int, float]], mass: list[float], of: list[int], penalty: float, rng: np.random.Generator, within: list[int] | None = None) -> bool:
    """Moves nodes to the neighbouring community of greatest gain until none gains; whether any moved.

    The gain of node i in community c is w(i, c) - penalty * mass(i) * mass(c).  With ``within``, a node that is alone
    may join a community of its own group only, which is the refinement that keeps communities connected.
    """
    total: dict[int, float] = {}
    size: dict[int, int] = {}
    for i, c in enumerate(of):
        total[c] = total.get(c, 0.0) + mass[i]
        size[c] = size.get(c, 0) + 1
    queue = rng.permutation(len(adj)).tolist()
    waiting, moved, at = set(queue), False, 0
    while at < len(queue):
        i = queue[at]
        at += 1
        waiting.discard(i)
        c = of[i]
        if within is not None and size[c] > 1:
            continue
        to: dict[int, float] = {c: 0.0}
        for j, w in adj[i].items():
            if j != i and (within is None or within[j] == within[i]):
                to[of[j]] = to.get(of[j], 0.0) + w
        total[c] -= mass[i]
        best, gain = c, to[c] - penalty * mass[i] * total[c]
        for d in sorted(to):
            g = to[d] - penalty * mass[i] * total[d]
            if g > gain + 1e-12:
                best, gain = d, g
        total[best] += mass[i]
        if best != c:
            size[c] -= 1
            size[best] += 1
            of[i], moved = best, True
            if within is None:
                for j in adj[i]:
                    if of[j] != best and j not in waiting:
                        waiting.add(j)
                        queue.append(j)
    return moved


def leiden(nodes: list[int], edges: list[tuple[int, int, float]] | tuple[np.ndarray, ...], resolution: float, kind: str = "cpm", total_weight: float | None = None, seed: int = 42, masses: dict[int, float] | None = None) -> dict[int, int]:
    """{node: community} by local moves, refinement and aggregation.  ``kind``: 'cpm' or 'modularity', which needs the
    weight of the whole graph.  With ``masses`` the nodes stand for many, and the resolution is the penalty of a pair
    of masses.  ``edges`` (node, node, weight), as a list or each an array.  The same seed gives the same result."""
    nodes = sorted(nodes)
    if not isinstance(edges, tuple):
        edges = tuple(np.array([e[i] for e in edges], t) for i, t in enumerate(("i8", "i8", "f8")))
    named, order, own = np.array(nodes, "i8"), np.lexsort(edges[::-1]), list(range(len(nodes)))  # one number for all who hold it
    adj: list[dict[int, float]] = [{} for _ in nodes]
    for lo in range(0, len(order), 65_536):
        a, b, w = (x[order[lo : lo + 65_536]] for x in edges)
        for i, j, x in zip(np.searchsorted(named, a).tolist(), np.searchsorted(named, b).tolist(), w.tolist()):
            adj[i][own[j]] = adj[i].get(j, 0.0) + x
            if i != j:
                adj[j][own[i]] = adj[j].get(i, 0.0) + x
    del edges, order
    if masses is not None:
        mass, penalty = [masses[v] for v in nodes], resolution
    elif kind == "cpm":
        mass, penalty = [1.0] * len(nodes), resolution
    else:
        mass = [sum(a.values()) for a in adj]
        penalty = resolution / (2 * (total_weight or max(1e-12, sum(mass) / 2)))
    rng = np.random.default_rng(seed)
    held = list(range(len(nodes)))  # node -> its vertex in the aggregated graph
    of = list(range(len(nodes)))
    while True:
        moved = local_moves(adj, mass, of, penalty, rng)
        fine = list(range(len(adj)))
        local_moves(adj, mass, fine, penalty, rng, within=of)
        names = {c: k for k, c in enumerate(sorted(set(fine)))}
        if not moved or len(names) == len(adj):
            break
        new: list[dict[int, float]] = [{} for _ in names]
        new_mass, new_of = [0.0] * len(names), [0] * len(names)
        for i, c in enumerate(fine):
            k = names[c]
            new_mass[k] += mass[i]
            new_of[k] = of[i]
            for j, w in adj[i].items():
                x = names[fine[j]]
                if x != k:
                    new[k][x] = new[k].get(x, 0.0) + w
        held = [names[fine[h]] for h in held]
        first = {}
        of = [first.setdefault(c, k) for k, c in enumerate(new_of)]
        adj, mass = new, new_mass
    return {v: of[held[i]] for i, v in enumerate(nodes)}


def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(pdf[c].to_numpy() for c in ("src", "dst", "weight"))


def ends(pdf: pd.DataFrame) -> list[int]:
    return np.union1d(pdf["src"], pdf["dst"]).tolist()


def numbered(labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, community) with communities numbered by size, the one with the smallest node first among equals."""
    g = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    order = tables.numbered(g, "community", [F.desc("n"), F.col("first")], scratch, 0).select("label", "community")
    return labels.join(order, "label").select("node", "community")


def moved_in_rounds(edges: DataFrame, mass: DataFrame, penalty: float, scratch: Scratch, start: DataFrame | None = None) -> DataFrame:
    """(node, label) by synchronous local moves as joins, from every node alone (or the labels of ``start``) until no
    node gains by a move.

    In each round half of the nodes, others each time, may move to the neighbouring community of greatest gain.  Moves
    made at once can undo each other: when three rounds bring no better quality, the best labels so far count.
    """
    both = scratch.put("big_both", both_ways(edges))
    labels = mass.join(start, "node").select("node", "mass", "label") if start is not None else mass.select("node", "mass", F.col("node").alias("label"))
    top, worse, r = -math.inf, 0, 0
    while True:
        size = labels.groupBy("label").agg(F.sum("mass").alias("held"))
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        own = labels.select("node", "mass", F.col("label").alias("own"))
        stay = own.select("node", F.col("own").alias("label"), F.lit(0.0).alias("w"))
        g = near.unionByName(stay).groupBy("node", "label").agg(F.sum("w").alias("w")).join(own, "node").join(size, "label")
        is_own = F.col("label") == F.col("own")
        gain = F.col("w") - penalty * F.col("mass") * (F.col("held") - F.when(is_own, F.col("mass")).otherwise(0))
        best = g.groupBy("node").agg(F.max(F.struct(F.round(gain, 9).alias("g"), is_own.alias("s"), (-F.col("label")).alias("l"))).alias("b"), F.max(F.when(is_own, F.struct("own", "mass", "w", "held"))).alias("o"))
        state = scratch.put("big_state", best.select("node", F.col("o.own").alias("label"), F.col("o.mass").alias("mass"), F.col("o.w").alias("w"), F.col("o.held").alias("held"), (-F.col("b.l")).alias("to")))
        a = state.agg(F.count_if(F.col("to") != F.col("label")).alias("wish"), F.sum(F.col("w") - penalty * F.col("mass") * F.col("held")).alias("q")).first()
        if not a.wish:
            return scratch.put("big_best", state.select("node", "label"))
        if a.q > top + 1e-9:
            top, worse, found = a.q, 0, scratch.put("big_best", state.select("node", "label"))
        else:
            worse += 1
            if worse == 3:
                return found
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        labels = state.select("node", "mass", F.when(turn, F.col("to")).otherwise(F.col("label")).alias("label"))
        r += 1


def joined_levels(edges: DataFrame, mass: DataFrame, moved: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, mass) of the graph of the communities ``moved``, those that have come apart divided; vertices
    are (node, vertex)."""
    inner = edges.join(moved.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(moved.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst")
    vertex = scratch.put("big_vertex", moved.join(components(inner, scratch.fresh()), "node", "left").select("node", F.coalesce("component", "node").alias("vertex")))
    a, b = vertex.select(F.col("node").alias("src"), F.col("vertex").alias("a")), vertex.select(F.col("node").alias("dst"), F.col("vertex").alias("b"))
    e = edges.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
    return vertex, e, mass.join(vertex, "node").groupBy(F.col("vertex").alias("node")).agg(F.sum("mass").alias("mass"))


def gained(edges: DataFrame, mass: DataFrame, labels: DataFrame, penalty: float) -> float:
    """The quality of a partition: the weight inside of communities less the penalty of their pairs of masses."""
    e = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    charged = mass.join(labels, "node").groupBy("label").agg(F.sum("mass").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("m")).first()[0] or 0.0
    return (e.where("a = b").agg(F.sum("weight")).first()[0] or 0.0) - penalty * charged / 2


def leiden_by_levels(edges: DataFrame, mass: DataFrame, penalty: float, scratch: Scratch, seed: int, task_edges: int) -> DataFrame:
    """(node, label) for components too large for one task, passes of ``one_pass`` as long as they gain: the first from
    every node alone, others from the communities so far.  ``mass`` (node, mass): what a pair is charged ``penalty`` for."""
    edges, mass = scratch.put("pass_edges", edges.select("src", "dst", "weight")), scratch.put("pass_mass", mass.select("node", "mass"))
    best, top = None, -math.inf
    while True:
        labels = scratch.put("pass_new", one_pass(edges, mass, penalty, scratch.fresh(), seed, task_edges, best))
        q = gained(edges, mass, labels, penalty)
        if q <= top + 1e-6 * abs(top):
            return best if best is not None and q < top else labels
        best, top = scratch.put("pass_best", labels), q


def one_pass(edges: DataFrame, mass: DataFrame, penalty: float, scratch: Scratch, seed: int, task_edges: int, start: DataFrame | None = None) -> DataFrame:
    """(node, label) by local moves in rounds, communities that have come apart divided, and the graph of the communities
    again in the same way, until it fits in a task, where Leiden goes on, or no two join."""
    edges, mass = scratch.put("big_edges", edges), scratch.put("big_mass", mass)
    held = scratch.put("big_held", mass.select("node", F.col("node").alias("label")))  # node -> its vertex
    while True:
        count = edges.count()
        if count <= task_edges and start is None:
            e = edges.join(mass.select(F.col("node").alias("src"), F.col("mass").alias("ms")), "src").join(mass.select(F.col("node").alias("dst"), F.col("mass").alias("md")), "dst")

            def task(pdf: pd.DataFrame) -> pd.DataFrame:
                masses = dict(zip(pdf["src"], pdf["ms"])) | dict(zip(pdf["dst"], pdf["md"]))
                m = leiden(list(masses), arrays(pdf), penalty, seed=seed, masses=masses)
                first: dict[int, int] = {}
                for v in sorted(m):
                    first.setdefault(m[v], v)
                return pd.DataFrame({"label": list(m), "to": [first[c] for c in m.values()]})

            new = e.groupBy(F.lit(1).alias("all")).applyInPandas(task, "label long, to long")
            return held.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        moved = moved_in_rounds(edges, mass, penalty, scratch, start)
        first, start = start is not None, None
        vertex, e, m = joined_levels(edges, mass, moved, scratch)
        held = scratch.put("big_held", held.join(vertex.withColumnRenamed("node", "label"), "label").select("node", F.col("vertex").alias("label")))
        if not first and vertex.where("node <> vertex").isEmpty():
            return held
        edges, mass = scratch.put("big_edges", e), scratch.put("big_mass", m)


def communities(edges: DataFrame, scratch: Scratch, resolution: float = 0.001, kind: str = "cpm", seed: int = 42, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, community) of every node with an edge, by Leiden.

    Communities don't span components, so each component is a task of its own; those too large for one task
    are made smaller by distributed local moves and aggregation first.  Modularity gets the weight of the whole graph.
    """
    scratch = scratch.fresh()
    e = scratch.put("comm_edges", edges.select("src", "dst", "weight"))
    comp = components(e, scratch)
    placed = scratch.put("comm_placed", e.join(comp.select(F.col("node").alias("src"), "component"), "src"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = placed.join(sizes.where(F.col("n") <= task_edges).select("component"), "component", "left_semi")
    big = placed.join(sizes.where(F.col("n") > task_edges).select("component"), "component", "left_semi")
    total = e.agg(F.sum("weight")).first()[0] or 0.0

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        m = leiden(ends(pdf), arrays(pdf), resolution, kind, total, seed)
        first: dict[int, int] = {}
        for v in sorted(m):
            first.setdefault(m[v], v)
        return pd.DataFrame({"node": list(m), "label": [first[c] for c in m.values()]})

    labels = small.groupBy("component").applyInPandas(task, "node long, label long")
    if not big.isEmpty():
        b = big.select("src", "dst", "weight")
        mass = both_ways(b).groupBy("node").agg(F.lit(1.0).alias("mass") if kind == "cpm" else F.sum("weight").alias("mass"))
        penalty = resolution if kind == "cpm" else resolution / max(1e-12, 2 * total)
        labels = labels.unionByName(leiden_by_levels(b, mass, penalty, scratch, seed, task_edges))
    return numbered(scratch.put("comm_labels", labels), scratch)


def sweep(edges: DataFrame, scratch: Scratch, low: float, high: float, n: int, seeds: int = 2, kind: str = "cpm", task_edges: int = TASK_EDGES) -> DataFrame:
    """(i, resolution, node, community): for each of n resolutions the best of several seeded partitions by quality.

    Every (component, resolution, seed) is a task, and the best seed is chosen for each component by itself, as the
    quality is a sum over components.  Components too large for a task go through levels at each resolution.
    """
    grid = log_grid(low, high, n)
    scratch = scratch.fresh()
    e = scratch.put("sweep_edges", edges.select("src", "dst", "weight"))
    total = e.agg(F.sum("weight")).first()[0] or 0.0
    placed = scratch.put("sweep_placed", e.join(components(e, scratch).select(F.col("node").alias("src"), "component"), "src"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = placed.join(sizes.where(F.col("n") <= task_edges).select("component"), "component", "left_semi")
    big = placed.join(sizes.where(F.col("n") > task_edges).select("component"), "component", "left_semi").select("src", "dst", "weight")
    runs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("resolution"), F.lit(s).alias("seed")) for i, r in enumerate(grid) for s in range(seeds)]))
    placed = small.select("*", runs.alias("run")).select("src", "dst", "weight", "component", "run.*")

    def task(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c, i, r, s = key
        m = leiden(ends(pdf), arrays(pdf), r, kind, total, 42 + s)
        nodes, of = np.fromiter(m, "i8", len(m)), np.fromiter(m.values(), "i8", len(m))
        a, b = (of[np.searchsorted(nodes, pdf[x].to_numpy())] for x in ("src", "dst"))
        w = pdf["weight"].to_numpy()
        if kind == "cpm":
            k = np.bincount(of).astype("f8")
            charged = r * (k * (k - 1) / 2).sum()
        else:
            k = np.bincount(np.r_[a, b], np.r_[w, w])
            charged = r * (k * k).sum() / max(1e-12, 4 * total)
        q = w[a == b].sum() - charged
        first: dict[int, int] = {}
        for v in sorted(m):
            first.setdefault(m[v], v)
        return pd.DataFrame({"component": c, "i": i, "resolution": r, "seed": s, "quality": q, "node": list(m), "label": [first[x] for x in m.values()]})

    out = scratch.put("sweep_runs", placed.groupBy("component", "i", "resolution", "seed").applyInPandas(task, "component long, i int, resolution double, seed int, quality double, node long, label long"))
    best = out.groupBy("component", "i").agg(F.max(F.struct(F.round("quality", 9).alias("q"), (-F.col("seed")).alias("s"))).alias("b")).select("component", "i", (-F.col("b.s")).alias("seed"))
    got = out.join(best, ["component", "i", "seed"]).select("i", "resolution", "node", F.col("label").alias("community"))
    if not big.isEmpty():
        mass = both_ways(big).groupBy("node").agg(F.lit(1.0).alias("mass") if kind == "cpm" else F.sum("weight").alias("mass"))
        for i, r in enumerate(grid):
            labels = leiden_by_levels(big, mass, r if kind == "cpm" else r / max(1e-12, 2 * total), scratch.fresh(), 42, task_edges)
            got = got.unionByName(labels.select(F.lit(i).alias("i"), F.lit(r).alias("resolution"), "node", F.col("label").alias("community")))
    return got


def surprise(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the surprise of a partition (node, community), edges * KL(share of them inside, share expected), natural
    log; with ``membership`` by i, a row for each i."""
    keys = [c for c in ("i",) if c in membership.columns]
    m = membership.select(*keys, "node", "community")
    e = edges.select("src", "dst").join(m.select(*keys, F.col("node").alias("src"), F.col("community").alias("a")), "src").join(m.select(*keys, F.col("node").alias("dst"), F.col("community").alias("b")), ["dst", *keys])
    inner = e.groupBy(*keys).agg(F.count_if(F.col("a") == F.col("b")).alias("inner"), F.count(F.lit(1)).alias("m"))
    pairs = m.groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("within"), F.sum("k").alias("n"))
    x = inner.join(pairs, keys) if keys else inner.join(pairs)
    q, p = F.col("inner") / F.col("m"), F.col("within") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))
    term = lambda a, b: F.when((a > 0) & (b > 0), a * F.log(a / b)).otherwise(0.0)
    return x.select(*keys, F.round(F.when(q > p, F.col("m") * (term(q, p) + term(1 - q, 1 - p))).otherwise(0.0), 6).alias("surprise"))


def surprising(edges: DataFrame, scratch: Scratch, n: int = 12, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, community) of great surprise.

    Surprise rises with the edges inside of communities and falls with the pairs inside, so its best partition is best
    for some exchange rate of the two, which is the resolution of CPM: of the partitions over a grid of resolutions
    from a thousandth of the mean weight to all of it, the one of greatest surprise, the coarsest among equals.
    """
    scratch = scratch.fresh()
    e = scratch.put("surprise_edges", edges.select("src", "dst", "weight"))
    mean = e.agg(F.avg("weight")).first()[0]
    if mean is None:
        return scratch.spark.createDataFrame([], "node long, community long")
    runs = scratch.put("surprise_runs", sweep(e, scratch, mean / 1000, mean, n, 1, "cpm", task_edges))
    best = surprise(e, runs).orderBy(F.desc("surprise"), "i").first()
    return numbered(runs.where(F.col("i") == best.i).select("node", F.col("community").alias("label")), scratch)


def sweep_table(edges: DataFrame, runs: DataFrame, scratch: Scratch, least: float = 0.9, length: int = 2) -> DataFrame:
    """(i, resolution, communities, significance, nmi, plateau, best): a row for each resolution of a sweep; nmi with the
    next one, plateau whether it lies in a run of steady ones (ends included), best the recommended one."""
    r = scratch.put("table_runs", runs)
    one = r.groupBy("i", "resolution").agg(F.count_distinct("community").alias("communities"))
    steady = scratch.put("table_nmi", stability(r))
    flat = plateaus(steady, least, length).select(F.explode(F.sequence("first", "last")).alias("i")).distinct().withColumn("plateau", F.lit(True))
    grid = [x.i for x in one.select("i").orderBy("i").collect()]  # a row for each resolution
    sig = None
    for i in grid:
        q = partition_quality(edges, r.where(F.col("i") == i).select("node", "community"), 0.0).select(F.lit(i).alias("i"), "significance")
        sig = q if sig is None else sig.unionByName(q)
    sig = scratch.put("table_significance", sig)
    best = recommended(sig, plateaus(steady, least, length), steady)
    return one.join(sig, "i").join(steady, "i", "left").join(flat, "i", "left").withColumn("plateau", F.coalesce("plateau", F.lit(False))).withColumn("best", F.col("i") == best)


def partition_quality(edges: DataFrame, membership: DataFrame, resolution: float) -> DataFrame:
    """One row: CPM quality, RB modularity and significance of a partition (node, community)."""
    m = membership
    e = edges.join(m.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inner = e.where("a = b").groupBy(F.col("a").alias("community")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("m"))
    strength = e.select(F.col("a").alias("community"), "weight").unionByName(e.select(F.col("b").alias("community"), "weight")).groupBy("community").agg(F.sum("weight").alias("k"))
    size = m.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    c = size.join(inner, "community", "left").join(strength, "community", "left").na.fill(0)
    whole = edges.agg(F.sum("weight").alias("tw"), F.count(F.lit(1)).alias("tm"))
    nodes = m.agg(F.count(F.lit(1)).alias("tn"))
    c = c.withColumns({"tw": whole.select("tw").scalar(), "tm": whole.select("tm").scalar(), "tn": nodes.scalar()})
    pairs = F.col("n") * (F.col("n") - 1) / 2
    p, pc = F.col("tm") / (F.col("tn") * (F.col("tn") - 1) / 2), F.col("m") / F.nullif(pairs, F.lit(0.0))
    term = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    kl = term(pc, p) + term(1 - pc, 1 - p)
    return c.agg(F.round(F.sum(F.col("w") - resolution * pairs), 6).alias("cpm"), F.round(F.sum(F.col("w") - F.col("k") * F.col("k") / (4 * F.col("tw"))), 6).alias("modularity"), F.round(F.sum(F.when(pairs > 0, pairs * kl).otherwise(0.0)), 6).alias("significance"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: normalised mutual information of two partitions (node, community) of the same nodes; 1 for two of one class."""
    t = a.select("node", F.col("community").alias("x")).join(b.select("node", F.col("community").alias("y")), "node").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    t = t.select("*", F.sum("k").over(Window.partitionBy("x")).alias("kx"), F.sum("k").over(Window.partitionBy("y")).alias("ky")).withColumn("n", t.agg(F.sum("k")).scalar())
    p, px, py = F.col("k") / F.col("n"), F.col("kx") / F.col("n"), F.col("ky") / F.col("n")
    s = t.agg(F.sum(p * F.log(p / (px * py))).alias("i"), (-F.sum(p * F.log(px))).alias("hx"), (-F.sum(p * F.log(py))).alias("hy"))
    return s.select(F.round(F.when(F.col("hx") + F.col("hy") > 0, 2 * F.col("i") / (F.col("hx") + F.col("hy"))).otherwise(1.0), 6).alias("nmi"))


def stability(runs: DataFrame) -> DataFrame:
    """(i, nmi) of the partitions at resolutions i and i + 1 of a sweep."""
    a, b = runs.select("i", "node", F.col("community").alias("x")), runs.select((F.col("i") - 1).alias("i"), "node", F.col("community").alias("y"))
    t = a.join(b, ["i", "node"]).groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("k"))
    t = t.select("*", F.sum("k").over(Window.partitionBy("i", "x")).alias("kx"), F.sum("k").over(Window.partitionBy("i", "y")).alias("ky"))
    t = t.join(t.groupBy("i").agg(F.sum("k").alias("n")), "i")
    p, px, py = F.col("k") / F.col("n"), F.col("kx") / F.col("n"), F.col("ky") / F.col("n")
    s = t.groupBy("i").agg(F.sum(p * F.log(p / (px * py))).alias("m"), (-F.sum(p * F.log(px))).alias("hx"), (-F.sum(p * F.log(py))).alias("hy"))
    return s.select("i", F.round(F.when(F.col("hx") + F.col("hy") > 0, 2 * F.col("m") / (F.col("hx") + F.col("hy"))).otherwise(1.0), 6).alias("nmi"))


def plateaus(nmis: DataFrame, least: float = 0.9, length: int = 2) -> DataFrame:
    """(first, last, n, mean): maximal runs of neighbouring resolutions whose NMI stays up, best mean first.

    The rows of a sweep are few, one for each resolution; the run number is a plain gaps-and-islands difference.
    """
    up = nmis.where(F.col("nmi") >= least).withColumn("island", F.col("i") - F.row_number().over(Window.orderBy("i")))
    return up.groupBy("island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n"), F.round(F.avg("nmi"), 6).alias("mean")).where(F.col("n") >= length).drop("island").orderBy(F.desc("mean"), "first")


def recommended(significance: DataFrame, runs: DataFrame, nmis: DataFrame) -> int:
    """The index of the resolution of greatest significance, else the middle of the best plateau, else of greatest NMI, else 0."""
    for df, pick in ((significance.where("significance > 0").orderBy(F.desc("significance"), "i"), lambda r: r.i), (runs, lambda r: (r.first + r.last) // 2), (nmis.orderBy(F.desc("nmi"), "i"), lambda r: r.i)):
        r = df.first()
        if r is not None:
            return int(pick(r))
    return 0


def recluster(edges: DataFrame, membership: DataFrame, scratch: Scratch, least: int = 1000, resolution: float = 0.05, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, community) with every community of ``least`` nodes or more (ten at least) divided at a finer resolution;
    one without an edge stays.

    The parts get numbers after the greatest one; the largest is numbered first.
    """
    scratch = scratch.fresh()
    m = scratch.put("re_members", membership.select("node", "community"))
    mega = m.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(10, least)).select("community")
    inside = m.join(mega, "community")
    e = edges.join(inside.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(inside.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").select("src", "dst", "weight")
    if e.isEmpty():
        return m
    last = m.agg(F.max("community")).first()[0]
    parts = communities(e, scratch, resolution, task_edges=task_edges).select("node", (F.col("community") + last + 1).alias("part"))
    return m.join(parts, "node", "left").select("node", F.coalesce("part", "community").alias("community"))
