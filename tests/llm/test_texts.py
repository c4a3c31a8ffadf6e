"""Leaks, repetition, mixing and matching of works."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import entities, leaks, mixing, repetition
from lexigraph.llm.words import word_lists

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "lan mer tik dor fen gas hul jop".split()]


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_words():
    h, starts, codes, vocabulary = word_lists(pa.array(["A-b  b", None, "", "¡Él's!", "x"]))
    assert [[vocabulary[c] for c in codes[s:e]] for s, e in zip(starts[:-1], starts[1:])] == [["a", "b", "b"], [], [], ["él", "s"], ["x"]]
    h, starts, codes, vocabulary = word_lists(pa.array(["<p>tim-\nber &amp; &eacute;t</p>"]), markup=True)
    assert [vocabulary[c] for c in codes] == ["timber", "ét"]


def leak_tables(spark):
    rng = random.Random(3)
    stock = "read the passage below and answer the question that follows it in one short sentence please"
    passages = [sentence(rng, 60) for _ in range(12)]
    items = [(i, f"{stock}\n\n{' '.join(p)}?") for i, p in enumerate(passages)] + [(50, None), (51, ""), (None, "x"), (52, " ".join(passages[3]))]
    filler = lambda: sentence(random.Random(rng.random()), 80)
    edited = passages[1][5:37]
    edited[10], edited[22] = "changed", "altered"
    dropped = passages[2][:24]
    del dropped[12]
    much = passages[4][:30]
    for k in range(0, 30, 4):
        much[k] = "other"
    docs = [
        (1, filler() + passages[0] + filler()), (2, filler() + edited + filler()), (3, dropped), (4, passages[3][10:25]), (5, passages[5][10:24]), (6, much + filler()), (7, stock.split() + filler()), (8, filler()), (9, []), (10, None),
        (11, sum((filler() for _ in range(200)), []) + passages[6][20:50]),
    ]
    docs = [(i, None if w is None else " ".join(w).upper() if i == 1 else ",\n<b>".join(w)) for i, w in docs]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))


def test_leaks(spark):
    docs, items = leak_tables(spark)
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (4, 52), (11, 6)}


def test_leak_beside_longer_run_of_a_later_part(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    edited = passage[:24]
    edited[6], edited[12], edited[18] = "x1", "x2", "x3"
    doc = passage[40:52] + [f"f{i}" for i in range(20)] + edited
    docs = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(edited)), (3, " ".join(passage[40:52] + sentence(rng, 20)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    assert {(r.doc_id, r.words, r.edits) for r in leaks.find_leaks(docs, items).collect()} == {(1, 24, 3), (2, 24, 3)}


def plain_longest(p, q):
    """The longest stretch by the whole table of edit distances from every start."""
    best = 0
    for a in range(len(p)):
        for c in range(len(q)):
            if p[a] != q[c]:
                continue
            row = list(range(len(q) - c + 1))
            for i in range(1, len(p) - a + 1):
                new = [i]
                for k in range(1, len(row)):
                    same = p[a + i - 1] == q[c + k - 1]
                    new.append(min(row[k - 1] + (not same), row[k] + 1, new[-1] + 1))
                    if same and i >= leaks.LEAST_WORDS and new[k] * leaks.EDITS_PER_WORDS <= i:
                        best = max(best, i)
                row = new
    return best


def test_longest_stretch_against_all_alignments():
    rng = random.Random(9)
    for n in range(40):
        p = [rng.randrange(30) for _ in range(36)]
        q = []
        for _ in range(3):  # parts of the passage in any order, edited
            lo = rng.randrange(20)
            for w in p[lo : lo + rng.randrange(8, 30)]:
                r = rng.random()
                q += [w] if r > 0.12 else [99] if r > 0.08 else [98, w] if r > 0.04 else []
            q += [100 + rng.randrange(50) for _ in range(4)]
        ix = leaks.ItemIndex.__new__(leaks.ItemIndex)
        ix.passages, ix.weight = [np.array(p, "u8")], {s: 1.0 for s in zip(p[:-1], p[1:])}
        hits = [(x, i) for x in range(len(q) - 4) for i in range(len(p) - 4) if q[x : x + 5] == p[i : i + 5]]
        pos, at = np.array(hits, "i8").reshape(-1, 2).T
        assert ix.leaked(0, np.array(q, "u8"), pos, at)[0] == plain_longest(p, q)


def test_items_in_several_blocks(spark, monkeypatch):
    docs, items = leak_tables(spark)
    monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", 3)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (4, 52), (11, 6)}


@pytest.mark.parametrize("many", [7, 8, 500])
def test_passage_shared_by_any_number_of_items(spark, many):
    """A passage is a case for each item that holds it; the instruction before it, used for others too, is none."""
    rng = random.Random(many)
    stock = "read the passage below and answer the question that follows it in one short sentence please"
    passage = " ".join(sentence(rng, 60))
    items = [(i, f"{passage} {' '.join(sentence(rng, 8))}?") for i in range(many)] + [(1000 + i, f"{stock} {passage} {' '.join(sentence(rng, 8))}?") for i in range(many)]
    items += [(2000 + i, f"{stock} {' '.join(sentence(rng, 40))}") for i in range(12)]
    docs = [(1, " ".join(sentence(rng, 30)) + " " + passage + " " + " ".join(sentence(rng, 30))), (2, stock + " " + " ".join(sentence(rng, 30)))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.words for r in leaks.find_leaks(docs, items).collect()}
    assert set(got) == {(1, i) for base in (0, 1000) for i in range(base, base + many)} and min(got.values()) >= 60


def test_leaks_of_nothing(spark):
    docs, items = leak_tables(spark)
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    ix = leaks.ItemIndex([1], [" ".join(f"w{i}" for i in range(300))], [0])
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype("u8")) for _ in range(len(ix.prints))])
    w, i = ix.hits(ix.prints ^ flips)
    assert set(zip(range(len(flips)), range(len(flips)))) <= set(zip(w.tolist(), i.tolist()))


def share(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, cov = set(), set()
    for i in range(len(w) - 5):
        k = tuple(w[i : i + 6])
        if k in seen:
            cov |= set(range(i, i + 6))
        seen.add(k)
    return len(cov), len(w)


def kneser_ney(texts):
    """Mean negative log probability of each text's third and later words, counted the plain way."""
    grams = [[tuple(t[i : i + 3]) for i in range(len(t) - 2)] for t in texts]
    n3 = Counter(g for t in grams for g in t)
    n2 = Counter(g[1:] for g in n3)
    n1 = Counter(g[1] for g in n2)
    d = [repetition.discounts([sum(v == k for v in n.values()) for k in (1, 2, 3, 4)]) for n in (n1, n2, n3)]
    less = lambda k, c: d[k][min(c, 3) - 1]
    t1 = sum(n1.values())
    p1 = {w: (c - less(0, c)) / t1 + sum(less(0, x) for x in n1.values()) / t1 / (len(n1) + 1) for w, c in n1.items()}
    t2, g2, t3, g3 = Counter(), Counter(), Counter(), Counter()
    for (b, _), c in n2.items():
        t2[b] += c
        g2[b] += less(1, c)
    for (a, b, _), c in n3.items():
        t3[a, b] += c
        g3[a, b] += less(2, c)
    p = lambda a, b, c: (n3[a, b, c] - less(2, n3[a, b, c])) / t3[a, b] + g3[a, b] / t3[a, b] * ((n2[b, c] - less(1, n2[b, c])) / t2[b] + g2[b] / t2[b] * p1[c])
    return [-sum(math.log(p(*g)) for g in t) / len(t) if t else None for t in grams]


@pytest.mark.parametrize("bucket", [10**6, 60])
def test_perplexity_and_shares(spark, scratch, monkeypatch, bucket):
    monkeypatch.setattr(repetition, "BUCKET_WORDS", bucket)  # the smaller one makes 'the' a hot word
    rng = random.Random(7)
    texts = [[w for x in sentence(rng, rng.randrange(0, 60)) for w in ("the", x)] for _ in range(25)]
    texts[4] = texts[4][:10] * 12
    texts[5], texts[6], texts[7], texts[8] = [], ["one"], ["one", "two"], texts[9]
    for i in (12, 13, 16, 17, 20, 21):  # English ones, which make a hot trigram
        texts[i] = ["the", "lo", "the"] * (15 + i)
    langs = [["en", "en", "und", "fr"][i % 4] for i in range(25)]
    docs = [(i, " ".join(t), ["en", " EN", None, "fr"][i % 4]) for i, t in enumerate(texts)] + [(99, None, "en"), (None, "a b c", "en")]
    got = {r.doc_id: r for r in repetition.perplexities(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit(1)), scratch).collect()}
    if bucket == 60:
        _, hot, hot3 = repetition.hot_words(spark.createDataFrame([(i, x, y) for (i, x, _), y in zip(docs, langs)], "doc_id long, text string, lang string"), 25)
        assert hot and hot3
    assert set(got) == {*range(25), 99} and got[0].lang == got[1].lang == "en" and got[2].lang == "und"
    for i, want in enumerate(kneser_ney([[f"{lang}:{w}" for w in t] for lang, t in zip(langs, texts)])):
        assert (got[i].n_repeated, got[i].n_words) == share(" ".join(texts[i]))
        assert got[i].perplexity is None if want is None else abs(math.log(got[i].perplexity) - want) < 1e-4


def test_perplexity_of_nothing(spark, scratch):
    assert repetition.perplexities(spark.createDataFrame([], "doc_id long, text string, lang string"), scratch).count() == 0


def seats_of(spark, scratch, weights, seats, caps=None):
    rows = [(0, k, float(w), (caps or {}).get(k, 10**9), seats) for k, w in weights.items()]
    return {r.key: r.got for r in mixing.apportioned(spark.createDataFrame(rows, "all int, key string, w double, cap long, seats long"), ["all"], scratch).collect()}


def by_quotients(weights, seats, caps=None):
    """One seat after the other to the highest quotient, the smaller key first among equals."""
    got, caps = dict.fromkeys(weights, 0), caps or {}
    for _ in range(seats):
        free = [k for k in weights if weights[k] > 0 and got[k] < caps.get(k, math.inf)]
        if free:
            got[min(free, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))] += 1
    return got


MANY = {f"s{i:02}": (i * 37 % 23) ** 2 + 0.5 for i in range(40)}


@pytest.mark.parametrize("weights,seats,caps", [({"a": 53, "b": 24, "c": 23}, 7, {}), ({"a": 1, "b": 1, "c": 1}, 2, {}), ({"b": 1, "a": 1}, 3, {}), ({"a": 10, "b": 0.001}, 1000, {}), ({"a": 5.5, "b": 3, "c": 1.2, "d": 0.3, "e": 0}, 97, {}), ({"a": 9, "b": 1}, 10, {"a": 3}), ({"a": 9, "b": 1}, 100, {"a": 3, "b": 4}), (MANY, 12, {}), (MANY, 5000, {"s01": 7, "s05": 300, "s11": 0})])
def test_sainte_lague(spark, scratch, weights, seats, caps):
    assert seats_of(spark, scratch, weights, seats, caps) == by_quotients(weights, seats, caps)


def mixture(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(sentence(rng, rng.randrange(5, 120))), s) for i, s in enumerate(["big"] * 300 + ["Small "] * 30 + ["other"] * 20 + [None] * 5)] + [(1000, None, "big"), (1001, "", "big"), (None, "x", "big")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([("BIG", 60.0, 1), ("small", 30.0, 4), ("none", 10.0, 2), ("null", None, None), (None, 5.0, 1)], "source string, target_weight double, max_repeats int")


@pytest.mark.parametrize("shard", [50_000, 40])
def test_mixture(spark, scratch, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard)
    docs, targets = mixture(spark)
    chosen, shares = mixing.mix(docs, targets, scratch, block=64)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"big", "small", "none", "null"} and s["none"].tokens == 0 and s["null"].target_share == 0
    assert abs(s["small"].share - 1 / 3) < 0.03 and s["small"].most_repeats <= 4 and s["big"].most_repeats <= 1
    tokens = {k: sum(r.n_tokens for r in mixing.token_counts(docs).collect() if (r.source or "").strip().lower() == k and r.doc_id is not None) for k in ("big", "small")}
    total = int(min(tokens["big"] / 60, tokens["small"] * 4 / 30) * 90)
    quota = by_quotients({"big": 60, "small": 30}, total // 64, {"big": tokens["big"] // 64, "small": tokens["small"] * 4 // 64})
    parts = max(1, math.ceil(350 / shard))
    for k, blocks in quota.items():  # half a block, or half of the largest document, in each shard
        assert abs(s[k].tokens - blocks * 64) <= parts * max(64, max(r.n_tokens for r in mixing.token_counts(docs).collect())) / 2 + 64
    again = mixing.mix(docs, targets, scratch, block=64)[0]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))


def test_mixture_larger_than_the_sources(spark, scratch):
    s = {r.source: r for r in mixing.mix(*mixture(spark), scratch, 10**9, 64)[1].collect()}
    assert s["small"].capped and s["big"].capped and s["small"].most_repeats == 4 and s["big"].most_repeats == 1


def test_mixture_of_nothing(spark, scratch):
    docs, targets = mixture(spark)
    assert mixing.mix(docs.limit(0), targets, scratch)[0].count() == 0
    assert mixing.mix(docs, targets.limit(0), scratch)[0].count() == 0


BOOKS = "id long, calibre_id long, title string, author string, series string, series_index double, publisher string, pubdate string"
CATALOGUE = "id long, title string, author_sort string, series string, series_index double, publisher string, pubdate timestamp"


def test_numbers_of_titles():
    bits = lambda *n: sum(1 << i for i in n)
    assert entities.numbers("The_Sea_Cycle_(Part_4)_12345", None) == bits(4) and entities.numbers("The Sea Cycle III", 2.0) == bits(3)
    assert entities.numbers("the sea cycle: book two v1.1", None) == bits(2) and entities.numbers("The Sea Cycle", 5.0) == bits(5)
    assert entities.numbers(None, None) == entities.numbers("Émigré", 1.5) == 0
    assert entities.tokens_of("Émigré's_Rôle 77") == entities.tokens_of("emigres role") and "^j" in entities.initials("JR Mora")


def test_works_in_two_catalogues(spark, scratch):
    rng = random.Random(8)
    works = [(i, f"The {a.title()} {b.title()} of {c.title()}", f"{d.title()}son, {e.title()}") for i, (a, b, c, d, e) in enumerate((sentence(rng, 5) for _ in range(80)), 1)]
    cat = [(i, t, a, None, 1.0, None, None) for i, t, a in works] + [(201, "The Reed Saga: Book One", "Marsh, Ann", "The Reed Saga", 1.0, None, None), (202, "The Reed Saga #2", "Marsh, Ann", "The Reed Saga", 2.0, None, None), (203, None, None, None, None, None, None)]
    turned = lambda a: " ".join(reversed(a.split(", ")))
    books = [(1000 + i, i if i % 3 == 0 else None, t.upper() if i % 2 else f"{t} (retail)", turned(a), None, None, None, None) for i, t, a in works[:60]]
    books += [(2001, None, "the reed saga ii", "A. Marsh", None, None, None, None), (2002, None, "Fenlan Mertik", "Somebody Else", None, None, None, None), (2003, 1, None, None, None, None, None, None), (2004, None, works[70][2], works[70][1], None, None, None, None), (None, None, "x", "y", None, None, None, None)]
    b, k = spark.createDataFrame(books, BOOKS).withColumn("side", F.lit(9)), spark.createDataFrame(cat, CATALOGUE).withColumn("cosine", F.lit(9))
    got = {(r.book_id, r.calibre_row_id) for r in entities.matches(b, k, scratch).where("confidence >= 0.5").collect()}
    want = {(1000 + i, i) for i in range(1, 61)} | {(2001, 202), (2004, 71)}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 1 and (2001, 201) not in got


def test_no_works(spark, scratch):
    b, k = spark.createDataFrame([], BOOKS), spark.createDataFrame([], CATALOGUE)
    assert entities.matches(b, k, scratch).count() == 0


def described_rows(rows):
    """(side, id, tokens) with every token in the title."""
    return [(side, i, sorted(t << entities.BITS | entities.TITLE for t in tokens)) for side, i, tokens in rows]


@pytest.mark.parametrize("cell,task", [(10_000, 8192), (40, 8192), (40, 25)])
def test_candidates_of_enough_cosine(spark, scratch, monkeypatch, cell, task):
    """All of them in one cell; at least 0.95 of those of the cosines that the tables are laid out for in smaller
    cells, whole or divided among tasks; never one without the cosine."""
    monkeypatch.setattr(entities, "TASK_ROWS", task)
    rng = np.random.default_rng(4)
    vectors, weight = rng.standard_normal((entities.BUCKETS, entities.DIMS)), rng.random(entities.BUCKETS) + 0.5
    rows = [(side, i, sorted(map(int, rng.choice(60, 6, replace=False)))) for side in (0, 1) for i in range(300)]
    tokens = spark.createDataFrame(described_rows(rows), "side int, id long, tokens array<int>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    normal = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = normal(np.array([(unit[t] * weight[t][:, None]).sum(0) for _, _, t in rows]))
    y = normal(x - x.mean(0))
    s = y[:300] @ y[300:].T
    found = [(r.book_id, r.calibre_row_id) for r in entities.candidates(tokens, vectors, weight, scratch, cell=cell).collect()]
    got, pairs = set(found), lambda least: set(map(tuple, np.argwhere(s >= least).tolist()))
    assert got <= pairs(entities.LEAST_COSINE - 1e-3) and len(got) == len(found) > 100
    high = pairs(entities.LEAST_COSINE + 1e-3 if cell > 300 else entities.WHOLE_COSINE)
    assert len(high & got) >= (1 if cell > 300 else 0.95) * len(high) > 0


def test_passes_find_what_one_pass_finds_and_write_matches_only(spark, scratch, monkeypatch):
    rng = np.random.default_rng(4)
    vectors, weight = rng.standard_normal((entities.BUCKETS, entities.DIMS)), rng.random(entities.BUCKETS) + 0.5
    rows = [(side, i, sorted(map(int, rng.choice(60, 6, replace=False)))) for side in (0, 1) for i in range(300)]
    tokens = spark.createDataFrame(described_rows(rows), "side int, id long, tokens array<int>").cache()
    sure = lambda pair: np.where(pair["cosine"].to_numpy() >= 0.7, 0.9, 0.01)
    one = {(r.book_id, r.calibre_row_id): r.cosine for r in entities.candidates(tokens, vectors, weight, scratch.fresh(), cell=40).collect()}
    monkeypatch.setattr(entities, "PASS_ROWS", 1)  # half a table each
    many = [((r.book_id, r.calibre_row_id), r.cosine) for r in entities.candidates(tokens, vectors, weight, scratch.fresh(), cell=40).collect()]
    assert dict(many) == one and len(many) == len(one) > 100
    own = scratch.fresh()
    few = {(r.book_id, r.calibre_row_id) for r in entities.candidates(tokens, vectors, weight, own, cell=40, ranked=sure).collect()}
    assert few == {p for p, c in one.items() if c >= 0.7} and 0 < len(few) < len(one)
    assert sum(spark.read.parquet(p).count() for p in own.paths.values()) == len(few)


def test_every_token_of_two_records_is_walked(spark):
    rows = [(i % 2, i, [i % 2, 10 + i]) for i in range(6000)]  # each of two tokens in half of the records
    rec = spark.createDataFrame(described_rows(rows), "side int, id long, tokens array<int>")
    counts = rec.select(F.explode("tokens").alias("x")).groupBy(entities.bucket(F.col("x")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    w = entities.walks(rec, counts, 0).collect()
    assert len(w) == 6000 and all(r.here[0] == r.there[0] for r in w)
    assert len({r.there[1] for r in w}) > 3000  # spread over the holders, not to a few of them


def test_tables_keep_the_chance_to_meet():
    for bits in (1, 5, 10, 20):
        n = entities.tables_needed(bits, 0.6)
        assert 1 - (1 - (1 - math.acos(0.6) / math.pi) ** bits) ** n >= entities.MEETING


def test_calibration_with_partly_wrong_labels():
    rng = np.random.default_rng(5)
    x = rng.random((4000, entities.FEATURES))
    match = x[:, 3] + x[:, 5] > 1.2
    y = np.where(match, rng.random(4000) < 0.8, rng.random(4000) < 0.002).astype("f8")
    p = entities.Calibration(x, y, np.ones(4000)).confidence(x)
    assert ((p >= 0.5) == match).mean() > 0.97
    few = entities.Calibration(x[:0], y[:0], np.ones(0)).confidence(x[:5])
    assert few.shape == (5,) and np.isfinite(few).all()
