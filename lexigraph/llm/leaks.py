"""Problem 8: evaluation passages in documents, by SimHash windows and multi-index Hamming blocks."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.words import text_of, word_lists
from lexigraph.session import Scratch, table

WINDOW = 5  # words; see window_fingerprints
RADIUS = 3  # bits; 64 bits in RADIUS + 1 blocks
BLOCKS, BITS = 4, 16
LEAST_WORDS, EDITS_PER_WORDS = 15, 8
STOCK = 8  # an opening that goes on in so many ways is a stock instruction; see openings
ITEMS_AT_ONCE = 16_384  # of 100 words, an index of about 100 MB
SIMILAR = 0.5


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints): 64-bit SimHash of every window of five words inside one text.

    A bit is set if it is set in the hashes of most of the five words: a bitwise majority, made with two full adders.
    Five words is the longest run that any passage of 15 or more words keeps whole with one word in eight edited (the
    worst is 14 words in three runs, at 16 words and two edits), so every leak has windows at distance 0; the radius
    beyond that is for windows whose words change places.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    a, b, c, d, e = (hashes[i : i + n] for i in range(WINDOW))
    s1 = a ^ b
    c1 = (a & b) | (s1 & c)
    s1 = s1 ^ c
    s2 = s1 ^ d
    c2 = (s1 & d) | (s2 & e)
    s2 = s2 ^ e
    f = (c1 & c2) | ((c1 ^ c2) & s2)
    t = text_of(starts)
    whole = np.flatnonzero(t[:n] == t[WINDOW - 1 :])
    return whole, f[whole]


class ItemIndex:
    """The windows of a block of items under the values of each of the four blocks of their fingerprint."""

    def __init__(self, ids: list[int], texts: list[str | None], opening: list[int]):
        hashes, starts, codes, self.words = word_lists(pa.array(texts, pa.string()), markup=True)
        at, prints = window_fingerprints(hashes, starts)
        self.ids, of, opening = ids, text_of(starts)[at], np.array(opening, "i8")
        self.passages = [hashes[starts[i] + opening[i] : starts[i + 1]] for i in range(len(ids))]
        inside = at - starts[of] >= opening[of]
        self.prints, self.item, self.at = prints[inside], of[inside], (at - starts[of] - opening[of])[inside]
        self.tables = []
        for k in range(BLOCKS):
            value = ((self.prints >> np.uint64(k * BITS)) & np.uint64(2**BITS - 1)).astype("i8")
            order = np.argsort(value, kind="stable")
            self.tables.append((np.r_[0, np.cumsum(np.bincount(value, minlength=2**BITS))], order))
        seen = Counter()
        for p in self.passages:
            seen.update(set(zip(p[:-1].tolist(), p[1:].tolist())))
        self.weight = {s: math.log((1 + len(ids)) / n) + 1 for s, n in seen.items()}

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window of the texts, window of the items) whose fingerprints differ in at most RADIUS bits.

        Of four blocks, one at least is equal if three bits at most differ; a pair counts at its first equal block.
        """
        out_w, out_i = [], []
        for k, (offsets, order) in enumerate(self.tables):
            value = ((prints >> np.uint64(k * BITS)) & np.uint64(2**BITS - 1)).astype("i8")
            n = offsets[value + 1] - offsets[value]
            some = np.flatnonzero(n)
            n = n[some]
            w = np.repeat(some, n)
            i = order[np.repeat(offsets[value[some]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(w))] if len(w) else np.zeros(0, "i8")
            x = prints[w] ^ self.prints[i]
            near = np.bitwise_count(x) <= RADIUS
            for j in range(k):
                near &= ((x >> np.uint64(j * BITS)) & np.uint64(2**BITS - 1)) != 0
            out_w.append(w[near])
            out_i.append(i[near])
        return np.concatenate(out_w), np.concatenate(out_i)

    def leaked(self, item: int, words: np.ndarray, pos: np.ndarray, at: np.ndarray) -> tuple[int, int, float]:
        """(passage words, edits, weighted shingle similarity) of the longest stretch of the item's passage in the
        words that keeps within one edit in eight words and is SIMILAR; zeros where there is none of 15 words.

        ``pos`` and ``at`` are the windows that hit, in the words and in the passage.  Each leak keeps a window whole, so
        it is enough to take every whole run that holds one and go on from both of its ends: nothing that stands
        elsewhere in the text can hide a stretch.
        """
        passage = self.passages[item]
        whole = (words[pos[:, None] + np.arange(WINDOW)] == passage[at[:, None] + np.arange(WINDOW)]).all(1)
        p, q, best, done = passage.tolist(), words.tolist(), (0, 0, 0.0), set()
        most = len(p) // EDITS_PER_WORDS
        for x, i in zip(pos[whole].tolist(), at[whole].tolist()):
            start = next((k for k in range(min(i, x)) if p[i - k - 1] != q[x - k - 1]), min(i, x))
            if (i - start, x - i) in done:  # a run that has been taken
                continue
            done.add((i - start, x - i))
            ends = i + WINDOW, x + WINDOW
            after = reached(p[i:], q[x : x + len(p) - i + most], most)
            before = reached(p[: ends[0]][::-1], q[max(0, ends[1] - ends[0] - most) : ends[1]][::-1], most)
            ways = [(m + n - WINDOW, -e - f, m, y, n, z) for e, (m, y) in enumerate(after) for f, (n, z) in enumerate(before)]
            for m, less, right, y, left, z in sorted((w for w in ways if w[0] >= LEAST_WORDS and -w[1] * EDITS_PER_WORDS <= w[0]), reverse=True):
                if (m, less) <= (best[0], -best[1]):
                    break
                part = p[ends[0] - left : i + right]
                kept = kept_shingles(part, q[ends[1] - left - z : x + right + y], -less)
                all_ = set(zip(part[:-1], part[1:]))
                similar = sum(self.weight[s] for s in kept) / sum(self.weight[s] for s in all_)
                if similar >= SIMILAR:
                    best = (m, -less, similar)
                    break
        return best


def reached(p: list[int], q: list[int], most: int) -> list[tuple[int, int]]:
    """For 0 to ``most`` edits, (words of p, words of q beyond these) of the longest beginning of p that ends in a word
    they share and is a beginning of q but for so many edits: the furthest points on the diagonals, edit by edit."""
    same = next((i for i, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
    row, out = {0: same}, [(same, 0)]
    for e in range(1, most + 1):
        new, best = {}, out[-1]
        for d in range(-e, e + 1):
            i = max(row.get(d, -2) + 1, row.get(d - 1, -1), row.get(d + 1, -2) + 1)
            i = min(i, len(p), len(q) - d)
            if i < 0 or i + d < 0:
                continue
            while i < len(p) and i + d < len(q) and p[i] == q[i + d]:
                i += 1
            new[d] = i
            while i > best[0] and (i + d <= 0 or p[i - 1] != q[i + d - 1]):
                i -= 1
            if i > best[0]:
                best = (i, d)
        row = new
        out.append(best)
    return out


def kept_shingles(p: list[int], q: list[int], edits: int) -> set[tuple[int, int]]:
    """The two-word shingles of p that an alignment with q of at most so many edits leaves whole."""
    cost = [[edits + 1] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) + 1):
        for j in range(max(0, i - edits), min(len(q), i + edits) + 1):
            if not i or not j:
                cost[i][j] = i + j
            else:
                cost[i][j] = cost[i - 1][j - 1] if p[i - 1] == q[j - 1] else 1 + min(cost[i - 1][j - 1], cost[i - 1][j], cost[i][j - 1])
    i, j, out, last = len(p), len(q), set(), False
    while i and j:
        if p[i - 1] == q[j - 1]:
            i, j = i - 1, j - 1
            if last:
                out.add((p[i], p[i + 1]))
            last = True
        else:
            last = False
            _, i, j = min((cost[i - 1][j - 1], i - 1, j - 1), (cost[i - 1][j], i - 1, j), (cost[i][j - 1], i, j - 1))
    return out


def item_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, n, prefix, next, fair): each beginning of n words of an item, the five words after it, and whether it
    is no longer than the rest."""
    for b in batches:
        hashes, starts, _, _ = word_lists(b.column(1), markup=True)
        ids = b.column(0).to_pylist()
        for i, item in enumerate(ids):
            h = hashes[starts[i] : starts[i + 1]]
            m = len(h) - 1
            if m < 1:
                continue
            prefix, after, one, mix = np.empty(m, "u8"), np.zeros(m, "u8"), 0, 0x9E3779B97F4A7C15
            for n, x in enumerate(h[:m].tolist()):
                one = (one ^ x) * mix + 1 & 2**64 - 1
                prefix[n] = one
            for k in range(1, WINDOW + 1):
                after = after * np.uint64(mix) + np.r_[h[k:], np.zeros(k, "u8")][:m]
            n = np.arange(1, m + 1)
            yield pa.record_batch({"item_id": pa.array([item] * m, pa.int64()), "n": pa.array(n), "prefix": pa.array(prefix.view("i8")), "next": pa.array(after.view("i8")), "fair": pa.array(n <= m + 1 - n)})


def openings(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item_id, text, opening): the number of words of each item that are a stock instruction.

    That is its longest beginning that goes on in STOCK ways or more, in items of which it is no more than half, and
    in at least half as many ways as any shorter one.  So instructions before many passages go, while a passage stays
    whatever number of items share it: what follows it in them is shorter than itself.
    """
    p = scratch.put("prefixes", items.mapInArrow(item_prefixes, "item_id long, n long, prefix long, next long, fair boolean"))
    ways = p.where("fair").select("prefix", "next").distinct().groupBy("prefix").agg(F.count(F.lit(1)).alias("ways")).where(F.col("ways") >= STOCK)
    own = p.join(ways, "prefix").select("item_id", "n", "ways").distinct()
    most = own.groupBy("item_id").agg(F.max("ways").alias("most"))
    o = own.join(most, "item_id").where(F.col("ways") * 2 >= F.col("most")).groupBy("item_id").agg(F.max("n").alias("opening"))
    return items.join(o, "item_id", "left").select("item_id", "text", F.coalesce("opening", F.lit(0)).alias("opening"))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, edits, similarity): each document that holds 15 or more words of an item's passage in
    succession with at most one word in eight altered, added or left out, once for each such item.

    ``docs`` has (doc_id, text), ``items`` (item_id, text).  Null or empty texts and rows without an id match nothing;
    repeated rows repeat their result.  Items go out in blocks of 16,384, each broadcast as an index of its windows (an
    item of 100 words takes about 6 kB) and held against all documents in one scan, so memory doesn't depend on how
    many items there are.  Every window within the radius becomes a candidate; nothing is capped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    items = scratch.put("items", openings(items, scratch))
    blocks = math.ceil(items.count() / ITEMS_AT_ONCE)
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()
        if not part:
            continue
        index = spark.sparkContext.broadcast(cloudpickle.dumps(ItemIndex([r.item_id for r in part], [r.text for r in part], [r.opening for r in part])))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = pickle.loads(index.value)
            for big in batches:
                for lo in range(0, big.num_rows, 1000):
                    b = big.slice(lo, 1000)
                    hashes, starts, _, _ = word_lists(b.column(1), markup=True)
                    at, prints = window_fingerprints(hashes, starts)
                    w, i = ix.hits(prints)
                    if not len(w):
                        continue
                    pos, item = at[w], ix.item[i]
                    doc = np.searchsorted(starts, pos, side="right") - 1
                    order = np.lexsort((pos, item, doc))
                    pos, item, doc, j = pos[order], item[order], doc[order], ix.at[i[order]]
                    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
                    rows = []
                    for s, e in zip(new, np.r_[new[1:], len(pos)]):
                        if e - s < 2:  # a leak keeps at least two windows whole
                            continue
                        d = doc[s]
                        best = ix.leaked(item[s], hashes[starts[d] : starts[d + 1]], pos[s:e] - starts[d], j[s:e])
                        if best[0]:
                            rows.append((b.column(0)[int(d)].as_py(), ix.ids[item[s]], *best))
                    if rows:
                        yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["doc_id", "item_id", "words", "edits", "similarity"])

        found = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(scan, "doc_id long, item_id long, words long, edits long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, words long, edits long, similarity double")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return f.withColumn("similarity", F.round("similarity", 6))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
SQL: dict[str, str] = {}
