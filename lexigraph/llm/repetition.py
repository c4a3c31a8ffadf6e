"""Problem 10: repetition inside documents, by the perplexity of a modified Kneser-Ney trigram model."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.words import text_of, word_lists
from lexigraph.session import Scratch, table

RUN = 6
LEAST_SHARE = 0.3
LOWER, UPPER = 0.6, 0.95  # quantiles of a language's perplexities; its band lies between them
BUCKET_WORDS, FLUSH_WORDS, SAMPLE_DOCS = 1_200_000, 1_500_000, 2000
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the number of words in a run of six words that already began earlier in that text."""
    texts, n = len(starts) - 1, len(hashes) - RUN + 1
    if n <= 0:
        return np.zeros(texts, "i8")
    t = text_of(starts)
    g = np.zeros(n, "u8")
    for j in range(RUN):
        g = g * MIX + hashes[j : j + n]
    g = g * MIX ^ (t[:n].astype("u8") + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.flatnonzero(t[:n] == t[RUN - 1 :])
    order = at[np.argsort(g[at], kind="stable")]
    again = order[1:][g[order[1:]] == g[order[:-1]]]
    step = np.zeros(len(hashes) + 1, "i8")
    np.add.at(step, again, 1)
    np.add.at(step, again + RUN, -1)
    return np.bincount(t[np.cumsum(step)[:-1] > 0], minlength=texts)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype("u8") + np.uint64(seed)) * MIX
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def home_bucket(b: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(b, 1) % np.uint64(buckets)).astype("i8")


def salts(b: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """In how many buckets the trigrams with this middle word lie: 1, for hot words more."""
    if not hot:
        return np.ones(len(b), "i8")
    words = np.array(sorted(hot), "u4")
    i = np.minimum(np.searchsorted(words, b), len(words) - 1)
    return np.where(words[i] == b, np.array([hot[w] for w in words.tolist()], "i8")[i], 1)


def gram_keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """64-bit keys of trigrams."""
    return ((b.astype("u8") << np.uint64(32) | a) * MIX) ^ (mixed(c, 3) << np.uint64(1))


def spread_of(keys: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """Over how many buckets the occurrences of each trigram are spread by their documents: 1, for hot ones more."""
    if not hot:
        return np.ones(len(keys), "i8")
    known = np.array(sorted(hot), "u8")
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[i] == keys, np.array([hot[k] for k in known.tolist()], "i8")[i], 1)


def of_language(hashes: np.ndarray, starts: np.ndarray, langs: list[str]) -> np.ndarray:
    """32-bit hashes of the words that differ from one language to another, so that each language has a model of its own."""
    salt = np.array([zlib.crc32(x.encode()) for x in langs], "u4")
    return (hashes >> np.uint64(32)).astype("u4") ^ np.repeat(salt, np.diff(starts))


def pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def gram_blocks(buckets: int, hot: dict[int, int], hot3: dict[int, int]):
    """Kernel: (doc_id, lang, text) to one row for each text (bucket -1) and blobs of sorted trigrams by bucket.

    The trigrams of one middle word share a bucket, so their contexts and continuations are counted there; those of a
    hot word are spread by their outer words over several, and the occurrences of a hot trigram by their documents.
    """

    def flush(ids, parts):
        h = np.concatenate([p[0] for p in parts])
        lengths = np.concatenate([np.diff(p[1]) for p in parts])
        doc = np.repeat(np.arange(len(lengths), dtype="u4"), lengths)
        at = np.flatnonzero(doc[2:] == doc[:-2])
        vocabulary, code = np.unique(h, return_inverse=True)
        code = code.astype("u2" if len(vocabulary) < 2**16 else "u4")
        a, b, c, d = code[at], code[at + 1], code[at + 2], doc[at].astype("u2" if len(lengths) < 2**16 else "u4")
        spread = salts(vocabulary, hot)[b]
        bucket = (home_bucket(vocabulary, buckets)[b] + np.where(spread > 1, (mixed(vocabulary[a].astype("u8") << np.uint64(32) | vocabulary[c], 2) % spread.astype("u8")).astype("i8"), 0)) % buckets
        if hot3:
            keys = gram_keys(vocabulary[a], vocabulary[b], vocabulary[c])
            n = spread_of(keys, hot3)
            m = np.flatnonzero(n > 1)
            bucket[m] = ((mixed(keys[m], 5) % np.uint64(buckets)).astype("i8") + (mixed(np.array(ids, "i8")[d[m]], 6) % n[m].astype("u8")).astype("i8")) % buckets
        order = np.lexsort((d, c, a, b, bucket))
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            o = order[cut[k] : cut[k + 1]]
            if len(o):
                yield k, pack(vocabulary, np.array(ids, "i8"), a[o], b[o], c[o], d[o])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def blocks():
            rows = list(flush(ids, parts))
            if rows:
                yield pa.record_batch({"bucket": pa.array([k for k, _ in rows], pa.int32()), "doc_id": pa.nulls(len(rows), pa.int64()), "lang": pa.nulls(len(rows), pa.string()), "n_words": pa.nulls(len(rows), pa.int64()), "n_repeated": pa.nulls(len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                hashes, starts, _, _ = word_lists(b.column(2))
                yield pa.record_batch({"bucket": pa.array([-1] * b.num_rows, pa.int32()), "doc_id": b.column(0), "lang": b.column(1), "n_words": pa.array(np.diff(starts)), "n_repeated": pa.array(repeated_words(hashes, starts)), "blob": pa.nulls(b.num_rows, pa.binary())})
                ids += b.column(0).to_pylist()
                parts.append((of_language(hashes, starts, b.column(1).to_pylist()), starts))
                n += len(hashes)
                if n >= FLUSH_WORDS:
                    yield from blocks()
                    ids, parts, n = [], [], 0
        if n:
            yield from blocks()

    return kernel


def bucket_grams(blobs) -> tuple[np.ndarray, ...]:
    """(a, b, c, doc_id) of all trigrams of a bucket, as 32-bit word hashes."""
    parts = [(v[a], v[b], v[c], ids[d]) for v, ids, a, b, c, d in map(unpack, blobs)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def gram_types(a, b, c):
    """Distinct trigrams in order of their keys: (keys, contexts (b, a), last words, counts, index of each occurrence's)."""
    keys, first, index, counts = np.unique(gram_keys(a, b, c), return_index=True, return_inverse=True, return_counts=True)
    return keys, (b.astype("u8") << np.uint64(32) | a)[first], c[first], counts, index


def of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


STATS = "kind string, bucket int, k1 long, k2 long, v1 long, v2 long, v3 long, v4 long"


def count_bucket(hot: dict[int, int], hot3: dict[int, int]):
    """Kernel: the model's counts from the trigrams of one bucket.

    'n3', 'n2': counts of counts of trigrams and of the continuation counts of bigrams; 'c': the number of words that
    each word follows.  What concerns a hot middle word is only a part here and goes out by bigram ('bc', continuation
    count) and by context ('ab': total, types with count 1, 2 and more), to be added up; so do the parts of the counts of
    hot trigrams ('abc').
    """

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c, _ = bucket_grams(pdf["blob"])
        keys, ab, c, n, _ = gram_types(a, b, c)
        parted = spread_of(keys, hot3) > 1
        hot_ab, hot_c, hot_n = ab[parted], c[parted], n[parted]
        ab, c, n = ab[~parted], c[~parted], n[~parted]
        b = (ab >> np.uint64(32)).astype("u4")
        hot_type = salts(b, hot) > 1
        bc, cont = np.unique(b.astype("u8") << np.uint64(32) | c, return_counts=True)
        hot_bc = salts((bc >> np.uint64(32)).astype("u4"), hot) > 1
        cs, nb = np.unique((bc & np.uint64(0xFFFFFFFF))[~hot_bc], return_counts=True)
        zero = lambda k: np.zeros(k, "i8")
        out = [("n3", zero(1), zero(1), *[np.array([x]) for x in of_counts(n)]), ("n2", zero(1), zero(1), *[np.array([x]) for x in of_counts(cont[~hot_bc])]), ("c", cs.astype("i8"), zero(len(cs)), nb, *[zero(len(cs))] * 3)]
        x = bc[hot_bc]
        out.append(("bc", (x >> np.uint64(32)).astype("i8"), (x & np.uint64(0xFFFFFFFF)).astype("i8"), cont[hot_bc], *[zero(len(x))] * 3))
        u, i = np.unique(ab[hot_type], return_inverse=True)
        m = n[hot_type]
        sums = [np.bincount(i, w, minlength=len(u)).astype("i8") for w in (m, m == 1, m == 2, m > 2)]
        out.append(("ab", (u >> np.uint64(32)).astype("i8"), (u & np.uint64(0xFFFFFFFF)).astype("i8"), *sums))
        out.append(("abc", hot_ab.view("i8"), hot_c.astype("i8"), hot_n, *[zero(len(hot_n))] * 3))
        frames = [pd.DataFrame({"kind": k, "bucket": key[0], "k1": k1, "k2": k2, "v1": v1, "v2": v2, "v3": v3, "v4": v4}) for k, k1, k2, v1, v2, v3, v4 in out if len(k1)]
        return pd.concat(frames).astype({"bucket": "int32"})

    return kernel


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney smoothing from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    return [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.0 for k in (1, 2, 3)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def score_bucket(hot: dict[int, int], hot3: dict[int, int], d3: list[float], d2: list[float]):
    """Kernel: for each text, the summed negative log probability and number of its trigrams in one bucket.

    ``lower`` brings what other buckets know: 'p1' the unigram probability of each last word here; for hot middle words
    'bc', their bigrams' probabilities, and 'ab', total and backoff weight of their contexts; for hot trigrams 'abc', how
    often they occur in all.
    """

    def kernel(key, grams: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
        if not len(grams):
            return pd.DataFrame({"doc_id": [], "nll": [], "n": []})
        a, b, c, doc = bucket_grams(grams["blob"])
        keys, ab, c, n, index = gram_types(a, b, c)
        tb = (ab >> np.uint64(32)).astype("u4")
        is_hot = salts(tb, hot) > 1
        by = {k: x for k, x in lower.groupby("kind")}

        def looked_up(kind: str, want: np.ndarray, *cols: str) -> list[np.ndarray]:
            x = by[kind]
            k = (x["k1"].to_numpy().astype("u8") << np.uint64(32)) | x["k2"].to_numpy().astype("u8")
            o = np.argsort(k)
            return [x[col].to_numpy()[o][np.searchsorted(k[o], want)] for col in cols]

        parted = spread_of(keys, hot3) > 1
        if parted.any():
            x = by["abc"]
            k1 = x["k1"].to_numpy().astype("i8").view("u8")
            k = gram_keys((k1 & np.uint64(0xFFFFFFFF)).astype("u4"), (k1 >> np.uint64(32)).astype("u4"), x["k2"].to_numpy().astype("u4"))
            o = np.argsort(k)
            n = n.copy()
            n[parted] = x["x"].to_numpy()[o][np.searchsorted(k[o], keys[parted])].astype("i8")
        p2, total, gamma = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
        cold = ~is_hot
        if cold.any():
            bc, i, cont = np.unique(tb[cold].astype("u8") << np.uint64(32) | c[cold], return_inverse=True, return_counts=True)
            _, ib = np.unique(bc >> np.uint64(32), return_inverse=True)
            dk, nb = discounted(cont, d2), np.bincount(ib, cont)
            (p1,) = looked_up("p1", (bc & np.uint64(0xFFFFFFFF)) << np.uint64(32), "x")
            p2[cold] = ((cont - dk) / nb[ib] + (np.bincount(ib, dk) / nb)[ib] * p1)[i]
            _, ia = np.unique(ab[cold], return_inverse=True)
            t = np.bincount(ia, n[cold])
            total[cold], gamma[cold] = t[ia], (np.bincount(ia, discounted(n[cold], d3)) / t)[ia]
        if is_hot.any():
            (p2[is_hot],) = looked_up("bc", tb[is_hot].astype("u8") << np.uint64(32) | c[is_hot], "x")
            total[is_hot], gamma[is_hot] = looked_up("ab", ab[is_hot], "x", "y")
        # The bucket's model: sorted hashes of its trigrams, beside them their log probabilities.
        model = -np.log((n - discounted(n, d3)) / total + gamma * p2).astype("f4")
        u, i = np.unique(doc, return_inverse=True)
        return pd.DataFrame({"doc_id": u, "nll": np.bincount(i, model[index]), "n": np.bincount(i)})

    return kernel


def language(c):
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("und"))


def hot_words(docs: DataFrame, n: int) -> tuple[int, dict[int, int], dict[int, tuple[int, int, int, int]]]:
    """(buckets, {word: buckets that its trigrams are spread over}, {trigram key: (buckets, a, b, c)}), from about 2,000
    documents.  They only lay out the work; no result depends on them."""
    every = max(1, n // SAMPLE_DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, starts, _, _ = word_lists(b.column(1))
            h, t = of_language(hashes, starts, b.column(0).to_pylist()), text_of(starts)
            w, k = np.unique(h, return_counts=True)
            zero = np.zeros(len(w), "i8")
            yield pa.record_batch({"a": pa.array(zero - 1), "w": pa.array(w.astype("i8")), "c": pa.array(zero), "k": pa.array(k)})
            at = np.flatnonzero(t[2:] == t[:-2])
            if len(at):
                g, k = np.unique(np.stack([h[at], h[at + 1], h[at + 2]], axis=1), axis=0, return_counts=True)
                g = g.astype("i8")
                yield pa.record_batch({"a": pa.array(g[:, 0]), "w": pa.array(g[:, 1]), "c": pa.array(g[:, 2]), "k": pa.array(k)})

    counts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("lang", "text").mapInArrow(count, "a long, w long, c long, k long").groupBy("a", "w", "c").agg(F.sum("k").alias("k"))
    total = counts.where("a < 0").agg(F.sum("k")).first()[0] or 0
    buckets = max(8, math.ceil(total * every / BUCKET_WORDS))
    top = counts.where(F.col("k") * buckets > total).collect() if total else []  # at most buckets words and buckets trigrams
    hot = {r.w: min(buckets, math.ceil(r.k * buckets / total)) for r in top if r.a < 0}
    grams = [(int(gram_keys(*(np.array([x], "u4") for x in (r.a, r.w, r.c)))[0]), (min(buckets, math.ceil(r.k * buckets / total)), r.a, r.w, r.c)) for r in top if r.a >= 0 and r.w in hot]
    return buckets, hot, dict(grams)


def perplexities(docs: DataFrame, scratch: Scratch, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """(doc_id, lang, n_words, n_repeated, share, perplexity, low, high) of every document.

    A modified Kneser-Ney trigram model of each language is counted over all its texts (with one set of discounts and
    one distribution of single words for all); each document gets its perplexity under its own, that language's band between the ``lower`` and ``upper`` quantile, and its share of words in a run of six words that
    already began earlier in it.  Repetition makes a text's own trigrams frequent, so it lies low in the band.
    The first two words of a text aren't scored; a text of fewer than three has a null perplexity, one without words a
    share of 0.  A null or blank language is 'und', spellings in other case are the same.  Rows of equal doc_id are
    parts of one document; rows with a null doc_id are left out.
    """
    scratch = scratch.fresh()
    d = docs.select("doc_id", language(F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    buckets, hot, grams3 = hot_words(d, docs.count())
    hot3 = {k: g[0] for k, g in grams3.items()}
    a = scratch.put("grams", d.mapInArrow(gram_blocks(buckets, hot, hot3), "bucket int, doc_id long, lang string, n_words long, n_repeated long, blob binary"))
    grams = a.where("bucket >= 0").select("bucket", "blob").repartition(buckets, "bucket")
    texts = a.where("bucket < 0").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.sum("n_words").alias("n_words"), F.sum("n_repeated").alias("n_repeated"))
    stats = scratch.put("stats", grams.groupBy("bucket").applyInPandas(count_bucket(hot, hot3), STATS))
    abc = stats.where("kind = 'abc'").groupBy("k1", "k2").agg(F.sum("v1").alias("n"))
    parts3 = abc.select(F.shiftrightunsigned("k1", 32).alias("b"), F.col("k1").bitwiseAND(F.lit(2**32 - 1)).alias("a"), F.col("k2").alias("c"), "n")
    hot_bc = stats.where("kind = 'bc'").select("k1", "k2", "v1").unionByName(parts3.select(F.col("b").alias("k1"), F.col("c").alias("k2"), F.lit(1).cast("long").alias("v1"))).groupBy("k1", "k2").agg(F.sum("v1").alias("n"))
    follows = scratch.put("follows", stats.where("kind = 'c'").select(F.col("k1").alias("c"), "v1").unionByName(hot_bc.select(F.col("k2").alias("c"), F.lit(1).cast("long").alias("v1"))).groupBy("c").agg(F.sum("v1").alias("n")))
    levels = lambda df, col: [F.coalesce(F.count_if(F.col(col) == k), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    sums = {r.kind: list(r)[1:] for r in stats.where("kind in ('n2', 'n3')").groupBy("kind").agg(*[F.sum(f"v{k}") for k in (1, 2, 3, 4)]).collect()}
    n3h = list(abc.agg(*levels(abc, "n")).first())
    n2h = list(hot_bc.agg(*levels(hot_bc, "n")).first())
    *n1, tokens, vocabulary = follows.agg(*levels(follows, "n"), F.sum("n"), F.count(F.lit(1))).first()
    d3, d2, d1 = discounts([x + y for x, y in zip(sums.get("n3", [0] * 4), n3h)]), discounts([x + y for x, y in zip(sums.get("n2", [0] * 4), n2h)]), discounts(n1)
    less = lambda c, d: F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
    spare = (follows.agg(F.sum(less(F.col("n"), d1))).first()[0] or 0.0) / max(1, tokens or 0)
    p1 = follows.select("c", ((F.col("n") - less(F.col("n"), d1)) / max(1, tokens or 0) + spare / (vocabulary + 1)).alias("p1"))
    rows = stats.where("kind = 'c'").join(p1, F.col("k1") == F.col("c")).select("bucket", F.lit("p1").alias("kind"), "k1", "k2", F.col("p1").alias("x"), F.lit(0.0).alias("y"))
    if hot:
        spread = scratch.spark.createDataFrame([(int(w), int((home_bucket(np.array([w], "u4"), buckets)[0] + s) % buckets)) for w, k in hot.items() for s in range(k)], "k1 long, bucket int")
        by_b = hot_bc.groupBy("k1").agg(F.sum("n").alias("nb"), F.sum(less(F.col("n"), d2)).alias("db"))
        bc = hot_bc.join(by_b, "k1").join(p1, F.col("k2") == F.col("c")).select("k1", "k2", ((F.col("n") - less(F.col("n"), d2)) / F.col("nb") + F.col("db") / F.col("nb") * F.col("p1")).alias("x"), F.lit(0.0).alias("y"))
        ones = lambda c: F.when(c, 1).otherwise(0).cast("long")
        v = stats.where("kind = 'ab'").select("k1", "k2", "v1", "v2", "v3", "v4").unionByName(parts3.select(F.col("b").alias("k1"), F.col("a").alias("k2"), F.col("n").alias("v1"), ones(F.col("n") == 1).alias("v2"), ones(F.col("n") == 2).alias("v3"), ones(F.col("n") > 2).alias("v4"))).groupBy("k1", "k2").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in (1, 2, 3, 4)])
        ab = v.select("k1", "k2", F.col("v1").cast("double").alias("x"), ((F.col("v2") * d3[0] + F.col("v3") * d3[1] + F.col("v4") * d3[2]) / F.col("v1")).alias("y"))
        for kind, df in (("bc", bc), ("ab", ab)):
            rows = rows.unionByName(df.join(F.broadcast(spread) if len(hot) <= 100_000 else spread, "k1").select("bucket", F.lit(kind).alias("kind"), "k1", "k2", "x", "y"))
    if hot3:
        # A bucket with occurrences of a hot trigram needs its count, and what is known of its middle word.
        of3 = [(int(b) << 32 | int(a_), int(b), int(a_), int(c), int((mixed(np.array([k], "u8"), 5)[0] % np.uint64(buckets) + np.uint64(i)) % np.uint64(buckets))) for k, (n, a_, b, c) in grams3.items() for i in range(n)]
        of3 = [((x + 2**63) % 2**64 - 2**63, b, a_, c, bucket) for x, b, a_, c, bucket in of3]
        places = scratch.spark.createDataFrame(of3, "ab long, b long, a long, c long, bucket int")
        rows = rows.unionByName(abc.join(places, (F.col("k1") == F.col("ab")) & (F.col("k2") == F.col("c"))).select("bucket", F.lit("abc").alias("kind"), "k1", "k2", F.col("n").cast("double").alias("x"), F.lit(0.0).alias("y")))
        for kind, df, last in (("bc", bc, "c"), ("ab", ab, "a")):
            near = places.select("b", last, "bucket").distinct()
            rows = rows.unionByName(df.join(near, (F.col("k1") == F.col("b")) & (F.col("k2") == F.col(last))).select("bucket", F.lit(kind).alias("kind"), "k1", "k2", "x", "y"))
    rows = rows.distinct().repartition(buckets, "bucket")
    scores = grams.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(score_bucket(hot, hot3, d3, d2), "doc_id long, nll double, n long")
    ppl = scores.groupBy("doc_id").agg((F.sum("nll") / F.sum("n")).alias("nll"))
    out = scratch.put("scored", texts.join(ppl, "doc_id", "left").select("doc_id", "lang", "n_words", "n_repeated", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(0.0).alias("share"), F.exp("nll").alias("perplexity")))
    scratch.drop("grams", "stats", "follows")
    bands = out.groupBy("lang").agg(F.percentile_approx("perplexity", [lower, upper], 1000).alias("q")).select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return out.join(bands, "lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents outside of their language's perplexity band, or too short for a perplexity, whose repeated share is 0.3
    or more.  Repetition makes a text likely; one under the name of another language may be unlikely for all that."""
    p = perplexities(table(spark, sf_dir, "documents"), Scratch(spark))
    outside = F.col("perplexity").isNull() | (F.col("perplexity") <= F.col("low")) | (F.col("perplexity") > F.col("high"))
    return p.where(outside & (F.col("n_repeated") >= LEAST_SHARE * F.col("n_words")) & (F.col("n_repeated") > 0)).select("doc_id")


def p10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = perplexities(table(spark, sf_dir, "documents"), Scratch(spark))
    band = F.when(F.col("perplexity") <= F.col("low"), "low").when(F.col("perplexity") > F.col("high"), "high").when(F.col("perplexity").isNotNull(), "kept")
    return p.select("doc_id", "lang", "n_words", F.round("share", 6).alias("share"), F.round("perplexity", 4).alias("perplexity"), band.alias("band"))


QUERIES = {"p10_found": p10_found, "p10_perplexity": p10_perplexity}
SQL = {
    "p10_found": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, len(ws) n, i, array_to_string(list_slice(ws, i, i + 5), ' ') k FROM w, unnest(generate_series(1, len(ws) - 5)) u(i) WHERE len(ws) > 6),
r AS (SELECT doc_id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) rn FROM g) WHERE rn > 1),
c AS (SELECT doc_id, n, count(DISTINCT i + j) m FROM r, unnest(generate_series(0, 5)) v(j) GROUP BY 1, 2)
SELECT doc_id FROM c WHERE m >= 0.3 * n"""
}
