"""Functions and operators of the core."""

import io
import math
import random
import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph import session
from lexigraph.functions import chunking, scoring, text
from lexigraph.functions import vectors as V
from lexigraph.operators import community, cooccurrence, dedup, domains, graph, matching, similarity, tables
from lexigraph.plans import pipeline, registry
from lexigraph.sources import documents, exports, models
from lexigraph.streaming import ingest


def value(spark, f, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} {'array<string>' if isinstance(a, list) else 'string'}" for i, a in enumerate(args)))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]


@pytest.mark.parametrize("given,want", [("  Deep_Sea  Life ", "deep sea life"), ("ab", None), ("love", None), ("2024-01-01T10", None), ("a<b>c", None), ("a {b}", None), ("x" * 101, None), ("sea life', 'reason: so", "sea life"), (None, None), ("", None)])
def test_normalize_topic(spark, given, want):
    assert value(spark, text.normalize_topic, given) == want


@pytest.mark.parametrize("f,given,want", [
    (text.html_to_text, "<p>A&amp;B<br/>c</p><hr>x [12] <em>y</em>", "A&B\nc\n\nx y"),
    (text.clean_markdown, "# T\n\n\n\n![i](u)x", "T\n\nx"),
    (text.strip_html, "<b>a</b>&nbsp; b ", "a b"),
    (text.remove_tags, " <b>a</b>b ", "ab"),
    (text.matching_form, "The  Sea, (2nd)!", "the sea 2nd"),
    (text.clean_author, "Last| First", "First Last"),
    (text.clean_author, "Unknown", None),
    (text.slug, "Émile & Co.", "emile_co"),
    (text.unwrap_topic, "{'topic': 'the sea's edge'}", "the sea's edge"),
    (text.json_in_text, 'so: ```json\n{"a": 1}\n``` ok', '{"a": 1}'),
    (text.json_in_text, "none", None),
    (text.word_count, None, 0),
    (text.source_url, "gutenberg:12", "https://www.gutenberg.org/ebooks/12"),
])
def test_text_functions(spark, f, given, want):
    assert value(spark, f, given) == want


def test_parse_topics_and_tags(spark):
    assert value(spark, text.parse_topics, 'x ["a b", "c"] y') == ["a b", "c"]
    assert value(spark, text.parse_topics, 'say "one" and "two"') == ["one", "two"]
    assert value(spark, text.parse_topics, "one, 'two'") == ["one", "two"]
    assert value(spark, text.parse_topics, "none") == []
    assert value(spark, text.clean_tags, ["Fiction", "Fiction - Space Opera", "space opera", "Opera", "History - General"]) == ["Space Opera", "History"]
    assert value(spark, text.key_values, "Title: A: b\n skipped: 1\nTITLE: c") == {"title": "c"}


@pytest.mark.parametrize("a,b,want", [("Hermann Hesse", "Hesse, Hermann", True), ("Hesse", "Hermann Hesse", True), ("A B", "C D", False), ("", "x", False), (None, "x", False)])
def test_authors_match(spark, a, b, want):
    assert value(spark, text.authors_match, a, b) is want


@pytest.mark.parametrize("a,b,want", [("Mr.", "Smith", True), ("by J.", "Kay", True), ("The end.", "New", False), ("it is.", "so", True), ("the U.S.", "Army", True), ("", "x", False)])
def test_false_sentence_break(spark, a, b, want):
    assert value(spark, text.false_sentence_break, a, b) is want
    assert chunking.goes_on(a, b) is want


def test_chunks():
    p = lambda n: " ".join(["word"] * n) + "."
    assert chunking.chunk_text(None) == chunking.chunk_text("") == chunking.chunk_text(p(50)) == []
    assert [len(c.split()) for c in chunking.chunk_text(p(200) + "\n\n" + p(250) + "\n\n" + p(300))] == [450, 300]
    assert [len(c.split()) for c in chunking.chunk_text(" ".join(f"W{p(150)}" for _ in range(5)))] == [450, 300]
    assert [len(c.split()) for c in chunking.chunk_text(p(1200))] == [500, 500, 200]
    assert chunking.sentences("Dr. No left. He ran! why? Yes.") == ["Dr. No left.", "He ran! why?", "Yes."]


def test_scores(spark):
    one = spark.range(1).select(scoring.pmi(F.lit(3), F.lit(5), F.lit(87), F.lit(93892)).alias("a"), scoring.pmi(F.lit(0), F.lit(5), F.lit(87), F.lit(9)).alias("z"), scoring.cooccurrence_weight(F.lit(2), F.lit(0.0)).alias("w"), scoring.relevance(F.lit(2), F.lit(9), F.lit(9), F.lit(9)).alias("r"), scoring.hsl_hex(F.lit(0.0)).alias("c")).first()
    assert round(one.a, 3) == 6.473 and one.z == 0 and round(one.w, 6) == round(math.log(3), 6) and one.r == 0 and one.c == "#e05151"
    assert scoring.log_grid(1e-4, 1.0, 5) == pytest.approx([1e-4, 1e-3, 1e-2, 0.1, 1.0])


def test_vector_codec_and_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0])], "id int, v array<float>")
    r = {x.id: x for x in df.select("id", V.from_bytes(V.to_bytes("v")).alias("b"), V.cosine(F.col("v"), F.col("v")).alias("c"), V.usable(F.col("v"), 2).alias("u")).collect()}
    assert r[1].b == [1.0, 2.0] and r[2].b is None and r[1].c == pytest.approx(1) and r[3].c is None and (r[1].u, r[2].u, r[3].u) == (True, False, False)


@pytest.mark.parametrize("block", [4096, 7])
def test_similarity_join(spark, block):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    s = u @ u.T
    got = {(r.id1, r.id2) for r in similarity.similar_pairs(df, 0.5, cell=block).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}
    near = {(r.id, r.other) for r in similarity.nearest(df, 3, cell=block).collect()}
    assert near == {(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: -s[i, j])[:3]}


@pytest.mark.parametrize("limits", [{"TASK": 16, "PASS_ROWS": 20, "QUERIES": 9}, {"WIDE": 2, "APART": 0.2, "TASK": 8, "FAR": 0.5}])
def test_similarity_joins_of_clusters_and_far_vectors(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.standard_normal((6, 12)), 20, axis=0) + rng.standard_normal((120, 12)) * 0.25, rng.standard_normal((30, 12))])
    x[125] = x[3]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, n = u @ u.T, len(x)
    df = spark.createDataFrame([(i, [float(y) for y in r], [i % 7]) for i, r in enumerate(x)], "id long, v array<double>, books array<long>")
    order = lambda i, among: sorted(among, key=lambda j: (-round(s[i, j], 12), j))
    for least in (0.6, 0.9):
        got = [(r.id1, r.id2) for r in similarity.similar_pairs(df.select("id", "v"), least, 1).collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(n) for j in range(i + 1, n) if s[i, j] >= least}
        near = {(r.id, r.place, r.other) for r in similarity.nearest(df.select("id", "v"), 4, least, 1).collect()}
        assert near == {(i, p + 1, j) for i in range(n) for p, j in enumerate(order(i, [j for j in range(n) if j != i and s[i, j] >= least])[:4])}
        links = similarity.linking_pairs(df, least, 0.95, 1).collect()
        want, have = np.eye(n, dtype=bool), np.eye(n, dtype=bool)
        for i in range(n):
            for j in range(n):
                want[i, j] |= s[i, j] >= 0.95 or (s[i, j] >= least and i % 7 == j % 7)
        for r in links:
            assert s[r.id1, r.id2] >= least
            if r.settled or r.id1 % 7 == r.id2 % 7:
                have[r.id1, r.id2] = have[r.id2, r.id1] = True
        for _ in range(8):
            want, have = (a.astype("i8") @ a.astype("i8") > 0 for a in (want, have))
        assert (want == have).all()
    near = {(r.id, r.other) for r in similarity.nearest(df.select("id", "v"), 3, cell=1).collect()}
    assert near == {(i, j) for i in range(n) for j in order(i, [j for j in range(n) if j != i])[:3]}
    a, b = df.where("id % 2 = 0").select("id", "v"), df.where("id % 3 = 0").select("id", "v")
    best = {r.id: r.best for r in similarity.best_matches(a, b, 1).collect()}
    assert best == pytest.approx({i: s[i, 0::3].max() for i in range(0, n, 2)})


def test_far_vectors_are_not_sent_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.standard_normal((60, 32)), 5, axis=0) + rng.standard_normal((300, 32)) * 0.05, rng.standard_normal((60, 32))])
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<float>")
    sent, divided = [], similarity.divided
    monkeypatch.setattr(similarity, "divided", lambda *a: sent.append(divided(*a)) or sent[-1])
    counts = []
    put = session.Scratch.put
    monkeypatch.setattr(session.Scratch, "put", lambda self, name, d: counts.append(sum(z.count() for z in sent)) or sent.clear() or put(self, name, d))
    assert similarity.nearest(df, 3, cell=1).count() == 3 * len(x)
    assert 0 < sum(counts) <= 3 * len(x)


def test_leiden_of_arrays_in_little_memory():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3000, (2, 60_000)) * 7
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    w = rng.random(len(a))
    nodes = np.unique(np.r_[a, b]).tolist()
    tracemalloc.start()
    m = community.leiden(nodes, (a, b, w), 0.05)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m == community.leiden(nodes, list(zip(a.tolist(), b.tolist(), w.tolist())), 0.05)
    assert most < 300 * len(a)  # bytes; the list of edges alone takes more than 150 for each


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.first_wins(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(tables.last_wins(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(tables.replace_group(old, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y"), (3, "z")]


def planted(spark):
    rng = random.Random(1)
    e = [(g * 10 + i, g * 10 + j, 1.0) for g in range(4) for i in range(10) for j in range(i + 1, 10) if rng.random() < 0.8] + [(0, 10, 1.0), (10, 20, 1.0), (20, 30, 1.0)]
    return spark.createDataFrame(e, "src long, dst long, weight double").withColumn("type", F.lit("cooccurrence"))


@pytest.mark.parametrize("kind,resolution,most", [("cpm", 0.1, 500_000), ("modularity", 1.0, 500_000), ("cpm", 0.1, 5)])
def test_leiden_finds_planted_communities(spark, scratch, kind, resolution, most):
    e = planted(spark)
    m = {r.node: r.community for r in community.communities(e, scratch, resolution, kind, task_edges=most).collect()}
    assert set(m) == set(range(40)) and len({(m[i], i // 10) for i in m}) == 4
    if most > 5:
        assert m == {r.node: r.community for r in community.communities(e, scratch, resolution, kind).collect()}


def test_sweep_and_plateaus(spark, scratch):
    s = community.sweep(planted(spark), scratch, 0.05, 0.4, 3, 2)
    n = community.stability(s)
    assert [r.nmi for r in n.orderBy("i").collect()] == [1.0, 1.0]
    p = community.plateaus(n)
    assert [(r.first, r.last) for r in p.collect()] == [(0, 1)]
    assert community.recommended(spark.createDataFrame([(0, 1.0), (2, 5.0)], "i int, significance double"), p, n) == 2
    assert community.recommended(spark.createDataFrame([], "i int, significance double"), p, n) == 0


def test_backbone_and_participation(spark):
    e = spark.createDataFrame([(1, 2, 10.0), (1, 3, 0.1), (1, 4, 0.1), (3, 4, 0.1)], "src long, dst long, weight double")
    assert [(r.src, r.dst) for r in graph.disparity_backbone(e, 0.05).collect()] == [(1, 2)]
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    m = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (9, 0)], "node long, community long")
    p = {r.node: r for r in graph.participation(v, e, m).collect()}
    assert p[1].participation == pytest.approx(2 / 3) and p[1].internal == pytest.approx(1 / 3) and p[2].participation == 0 and p[9].internal == 1


def test_two_tiers_of_duplicates(spark, scratch):
    ang = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    v = spark.createDataFrame([(1, ang(0)), (2, ang(5)), (3, ang(90)), (4, ang(115)), (5, ang(200)), (6, ang(225))], "id long, v array<double>")
    t = spark.createDataFrame([(i, i) for i in range(1, 7)], "id long, occ long")
    b = spark.createDataFrame([(3, 7), (4, 7), (5, 8), (6, 9)], "topic_id long, book_id long")
    assert sorted(map(tuple, dedup.duplicate_groups(v, t, b, scratch, 0.85, 0.95).collect())) == [(1, 2), (2, 2), (3, 4), (4, 4)]


def test_cooccurrence_of_nothing(spark):
    assert cooccurrence.cooccurrences(spark.createDataFrame([], "chunk_id long, topic_id long")).count() == 0


def test_domains(spark, scratch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((2, 8))
    c = spark.createDataFrame([(i, [float(x) for x in base[i % 2] + rng.standard_normal(8) * 0.05]) for i in range(10)], "id long, v array<double>")
    for d in (domains.kmeans(c, 2), domains.super_clusters(c, scratch, 0.2, 4, 0.5)):
        assert len({(r.id % 2, r.domain) for r in d.collect()}) == 2
    u = domains.universe(c, domains.kmeans(c, 2)).collect()
    assert len(u) == 10 and max(r.x for r in u) == pytest.approx(1) and all(r.colour.startswith("#") for r in u)


def epub() -> bytes:
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("b.xhtml", "<html><script>no</script><p>" + "second " * 12 + "</p></html>")
        z.writestr("a.xhtml", "<p>" + "first " * 12 + "</p>")
        z.writestr("toc.xhtml", "<p>" + "toc " * 50 + "</p>")
        z.writestr("c.opf", '<package xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator></package>')
    return f.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(epub())
    (tmp_path / "y.epub").write_bytes(b"broken")
    (tmp_path / "z.pdf").write_bytes(b"pdf")
    r = {x.path.rsplit("/", 1)[-1]: x for x in documents.read_documents(spark, str(tmp_path)).collect()}
    assert r["x.epub"].text.split("\n\n")[0].startswith("first") and (r["x.epub"].title, r["x.epub"].author) == ("T", "A") and "toc" not in r["x.epub"].text
    assert r["y.epub"].status.startswith("error") and r["z.pdf"].status == "unsupported"


def test_pages_csv_log_gml(spark, tmp_path):
    p = spark.createDataFrame([("t1", '<a href="/book?id=f1.epub">A &amp; B</a><a href="/book?id=f2">C</a>'), ("t2", '<a href="/book?id=f1.epub">A</a>')], "tag string, html string")
    assert [(r.id, r.format, r.tags) for r in documents.library_pages(p).collect()] == [("f1", "epub", ["t1", "t2"]), ("f2", "unknown", ["t1"])]
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text("id,title\n1,x\n")
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert documents.read_csv(spark, str(tmp_path / "a.csv"), schema, ["id"]).first().id == 1
    with pytest.raises(ValueError):
        documents.read_csv(spark, str(tmp_path / "a.csv"), schema, ["author"])
    log = ["10:00:01 Indexing: One", "Author: X", "Created 12 chunks", "Book done", "Indexing: Two", "Skipping: known"]
    r = documents.parse_log(spark.createDataFrame(list(enumerate(log)), "n int, value string")).orderBy("k").collect()
    assert [(x.book, x.author, x.chunks, x.status) for x in r] == [("One", "X", 12, "done"), ("Two", None, None, "skipped")]
    assert spark.range(1).select(documents.elapsed(F.lit("23:59:00"), F.lit("00:01:00"))).first()[0] == 120
    lines = exports.gml_lines(spark.createDataFrame([(1, 'a"b')], "id long, label string"), spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")).orderBy("part").collect()
    assert len(lines) == 4 and "label \"a'b\"" in lines[1].value


def test_extraction_falls_back_to_single_chunks(spark):
    def moody(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError
        return [[texts[0]]]

    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "id long, text string").coalesce(1)
    assert [(r.chunk_id, r.topics, r.status) for r in models.extract_topics(df, moody).collect()] == [(1, ["x"], "ok"), (2, [], "error: RuntimeError"), (3, ["y"], "ok")]
    assert np.linalg.norm(models.hashed_grams(["sea", ""]), axis=1).round(5).tolist() == [1.0, 0.0]


def test_pipeline(spark, scratch):
    rng = random.Random(3)
    words = "harbour lantern winter copper meadow orchard thunder timber".split()
    docs = spark.createDataFrame([(i, "\n\n".join(". ".join(" ".join(rng.choices(words, k=3)) + " and the" for _ in range(12)) for _ in range(6))) for i in range(8)] + [(90, "short"), (91, None)], "id long, text string")
    assert {r.id: r.status for r in pipeline.gated(docs).collect()}[91] == "too short"
    chunks, topics = pipeline.index_documents(docs, target=120)
    chunks, topics = scratch.put("c", chunks), scratch.put("t", topics)
    known = spark.createDataFrame([], "id long, label string")
    t, l = pipeline.normalized_topics(topics, known, scratch)
    again, _ = pipeline.normalized_topics(topics, scratch.put("known", t.select("id", "label")), scratch)
    assert sorted((r.id, r.label) for r in t.collect()) == sorted((r.id, r.label) for r in again.collect())
    assert pipeline.index_documents(docs, topics, target=120)[1].count() == 0
    out = pipeline.process(chunks, topics, known, scratch, least=0.3)
    assert out["communities"].count() > 0 and out["edges"].count() > 0


def test_streams(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, 10, "Deep Sea"), (2, 10, "deep_sea"), (3, 11, "ab")]
    spark.createDataFrame(rows, "raw_id long, chunk_id long, topic string").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(src)
    for i in range(2):
        ingest.upsert_into(ingest.topic_stream(spark, src), target, str(tmp_path / f"c{i}")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(target).collect()] == [(10, "deep sea")]
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 02:00:00", 3.0)], "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.events for r in ingest.sessions(e).collect()) == [1, 2]


def test_every_query_has_a_name_of_its_own():
    q = registry.queries()
    assert set(registry.oracle_sql()) <= set(q) and len(q) > 100


def test_refreshed_statistics(spark, tmp_path):
    from lexigraph.plans import statistics

    data = "/root/testdata/sf0.001"
    if not __import__("os").path.exists(data):
        pytest.skip("no test tables")
    r = {x.table: x.rows for x in statistics.refresh(spark, data, str(tmp_path)).collect()}
    assert set(r) == set(statistics.STATISTICS) and r["cluster_books"] == spark.read.parquet(f"{tmp_path}/cluster_books.parquet").count() > 0


def test_a_processed_library(spark, scratch, tmp_path):
    data = "/root/testdata/sf0.001"
    if not __import__("os").path.exists(data):
        pytest.skip("no test tables")
    r = {x.table: x.rows for x in pipeline.process_library(spark, data, str(tmp_path), scratch, least=0.9).collect()}
    topics, links = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("topics", "chunk_topic_links"))
    assert r["cluster_books"] > 0 and r["cluster_stats"] > 0 and topics.count() > 200 and topics.where("cluster_id is not null").count() > 0
    assert links.join(topics, links.topic_id == topics.id, "left_anti").count() == 0


def test_set_overlap_of_nothing(spark):
    e = spark.createDataFrame([], "id long, v array<double>")
    a = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert similarity.best_matches(e, a).count() == 0 and similarity.set_overlap(a, a).first().f1 == pytest.approx(1)


def test_clusters_of_every_book(spark, tmp_path):
    from lexigraph.plans import relational

    rows = {
        "books": ([(7, 1), (201, 2), (90_000, None)], "id long, calibre_id long"),
        "chunks": ([(1, 7), (2, 201), (3, 90_000)], "id long, book_id long"),
        "chunk_topic_links": ([(1, 1), (2, 1), (2, 2), (3, 2)], "chunk_id long, topic_id long"),
        "topics": ([(1, "a", 5, None), (2, "b", 5, None)], "id long, label string, cluster_id long, parent_topic_id long"),
    }
    for t in relational.TABLES:
        spark.createDataFrame(*rows.get(t, ([], "id long"))).write.parquet(f"{tmp_path}/{t}.parquet")
    got = relational.queries()["a13_clusters_of_book"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(7, 5, 1, "a", 1), (201, 5, 2, "a, b", 1), (90_000, 5, 1, "b", 1)]


@pytest.mark.parametrize("kind,resolution", [("cpm", 0.05), ("modularity", 1.0)])
def test_large_components_get_the_communities_of_small_ones(spark, scratch, kind, resolution):
    rng = random.Random(2)
    n, size = 240, 30
    e = {(i, j): 1.0 for i in range(n) for j in range(i + 1, n) if rng.random() < (0.25 if i // size == j // size else 0.004)}
    e |= {(i, i + 1): 1.0 for i in range(n - 1)}
    edges = [(i, j, w) for (i, j), w in e.items()]

    def quality(m):
        mass = [1.0] * n if kind == "cpm" else [sum(w for a, b, w in edges if v in (a, b)) for v in range(n)]
        held = {}
        for v, c in m.items():
            held[c] = held.get(c, 0.0) + mass[v]
        return sum(w for a, b, w in edges if m[a] == m[b]) - (resolution if kind == "cpm" else resolution / (2 * len(edges))) * sum(x * x for x in held.values()) / 2

    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    whole = {r.node: r.community for r in community.communities(df, scratch, resolution, kind).collect()}
    parts = {r.node: r.community for r in community.communities(df, scratch, resolution, kind, task_edges=len(edges) - 1).collect()}
    assert set(parts) == set(range(n)) and quality(parts) >= 0.97 * quality(whole)


def test_all_parts_of_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(23)]
    spark.createDataFrame([(1, "a\n\n b \n\n\nc"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words)), (2, None)], "id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    q = registry.queries()
    assert sorted(map(tuple, q["t06_all_paragraphs"](spark, str(tmp_path)).collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    assert sorted(map(tuple, q["t09_all_word_chunks"](spark, str(tmp_path)).collect())) == [(1, i, " ".join(words[i * 10 : i * 10 + 10])) for i in range(3)]


def test_numbers_over_many_ranges(spark, scratch):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert [(r.n, r.x) for r in tables.numbered(df, "n", [F.desc("x")], scratch, 10).orderBy("n").collect()] == [(10 + i, 999 - i) for i in range(1000)]
    assert tables.numbered(df.limit(0), "n", [F.col("x")], scratch).count() == 0


def test_index_of_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)) + 3 * rng.standard_normal((6, 8))[rng.integers(0, 6, 300)]
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<float>")
    similarity.write_index(df, str(tmp_path / "index"), 20)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (x[3], -x[5]):
        want = np.argsort(-(u @ (q / np.linalg.norm(q))), kind="stable")[:7].tolist()
        assert [r.id for r in similarity.search_index(spark, str(tmp_path / "index"), q.tolist(), 7).collect()] == want


def test_pairs_of_split_chunks_and_common_books(spark):
    rng = random.Random(4)
    links = [(c, t) for c in range(12) for t in rng.sample(range(60), 40 if c == 0 else rng.randrange(1, 8))] + [(1, None), (None, 1)]
    links += links[:10]
    df, chunks = spark.createDataFrame(links, "chunk_id long, topic_id long"), spark.createDataFrame([(c, c // 3) for c in range(12)], "id long, book_id long")
    of, books = {}, {}
    for c, t in {x for x in links if None not in x}:
        of.setdefault(c, set()).add(t)
        books.setdefault(t, set()).add(c // 3)
    want = {}
    for ts in of.values():
        for a in ts:
            for b in ts:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    clean = df.dropna().distinct()
    assert {(r.topic1_id, r.topic2_id): r["count"] for r in cooccurrence.chunk_pairs(clean, 5).collect()} == want
    got = {(r.topic1_id, r.topic2_id): (r["count"], r.book_count) for r in cooccurrence.cooccurrences(df, chunks).collect()}
    assert got == {k: (n, len(books[k[0]] & books[k[1]])) for k, n in want.items()}
    one = next(iter(of[0]))
    near = cooccurrence.occurring_with(df, spark.createDataFrame([(one,)], "id long"), 100).collect()
    assert {r.id: r["count"] for r in near} == {(b if a == one else a): n for (a, b), n in want.items() if one in (a, b)}
    assert cooccurrence.occurring_with(df, spark.createDataFrame([], "id long")).count() == 0


def test_titles_contained_in_titles(spark):
    books = spark.createDataFrame([(1, "The Sea!", "Ann Marsh"), (2, "It", None), (3, "Nowhere", "X"), (4, None, "X"), (5, "...", "X"), (6, "A-B", "X")], "id long, title string, author string")
    cat = spark.createDataFrame([(10, "On the Sea, again", "Other"), (11, "the sea", "Marsh, Ann"), (12, "Bit.", "Y"), (13, None, "Z"), (14, "A-B", "X")], "id long, title string, author_sort string")
    assert sorted((r.id, r.catalogue_id, r.same_author) for r in matching.contained(books, cat).collect()) == [(1, 11, True), (2, 12, False)]
    assert matching.contained(books.limit(0), cat).count() == matching.contained(books, cat.limit(0)).count() == 0


def planted_edges(k=4, size=30):
    rng = random.Random(1)
    edges = [(g * 100 + i, g * 100 + j, 1.0) for g in range(k) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.6]
    return edges + [(a * 100 + x, b * 100 + x, 0.1) for a in range(k) for b in range(a + 1, k) for x in (0, 1)]


@pytest.mark.parametrize("task_edges", [500_000, 200])
@pytest.mark.parametrize("kind", ["cpm", "modularity", "surprise"])
def test_planted_communities_of_all_qualities(spark, scratch, kind, task_edges):
    e = spark.createDataFrame(planted_edges(), "src long, dst long, weight double")
    m = community.surprising(e, scratch, 6 if task_edges > 200 else 2, task_edges) if kind == "surprise" else community.communities(e, scratch, 0.1 if kind == "cpm" else 1.0, kind, task_edges=task_edges)
    of = {r.node: r.community for r in m.collect()}
    assert len(of) == 120 and sorted(of[g * 100] for g in range(4)) == [0, 1, 2, 3] and all(c == of[v // 100 * 100] for v, c in of.items())


def test_surprise_of_partitions(spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    m = spark.createDataFrame([(v, v // 3) for v in range(6)], "node long, community long")
    q, p = 6 / 7, 6 / 15
    assert community.surprise(e, m).first().surprise == pytest.approx(7 * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))), abs=1e-6)


def test_table_of_a_sweep(spark, scratch):
    e = spark.createDataFrame(planted_edges(3, 10), "src long, dst long, weight double")
    runs = community.sweep(e, scratch, 1e-3, 1.0, 5, 1)
    large = community.sweep(e, scratch, 1e-3, 1e-2, 1, 1, task_edges=10)
    assert runs.count() == 150 and large.count() == 30
    t = community.sweep_table(e, runs, scratch).orderBy("i").collect()
    assert len(t) == 5 and sum(r.best for r in t) == 1 and [r.communities for r in t if r.best] == [3] and t[-1].nmi is None


def test_domains_loaded_and_made_anew(spark, scratch, tmp_path):
    (tmp_path / "d.json").write_text('[{"label": "a", "leiden_cluster_ids": [1, 2]}, {"label": "b", "leiden_cluster_ids": [2, 3]}, {"label": "a", "leiden_cluster_ids": [9]}, {"label": "c", "leiden_cluster_ids": []}, {"label": null}]')
    d, m = exports.load_domains(spark, str(tmp_path / "d.json"))
    assert sorted(map(tuple, d.collect())) == [(0, "a", 2), (1, "b", 2), (3, "c", 0)] and sorted(map(tuple, m.collect())) == [(1, 0), (2, 1), (3, 1), (9, 0)]
    topics = spark.createDataFrame([(i, f"label {i}", i % 3, i) for i in range(30)], "id long, label string, cluster_id long, occ long")
    of = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "id long, domain int")
    names = spark.createDataFrame([(1, "x"), (2, "y")], "domain int, label string")
    dom, mem = domains.apply_labels(of, names, topics, scratch)
    assert [tuple(r) for r in dom.orderBy("id").collect()] == [(0, "x", 2, 20, [0, 1]), (1, "y", 1, 10, [2])] and sorted(map(tuple, mem.collect())) == [(0, 0), (1, 0), (2, 1)]
    with pytest.raises(ValueError):
        domains.apply_labels(of, names.where("domain = 1"), topics, scratch)
    vec = spark.createDataFrame([(i, [float(i % 3 == j) + 0.01 * i for j in range(3)]) for i in range(30)], "id long, v array<double>")
    for method in ("kmeans", "leiden"):
        assert domains.regenerate(topics, vec, scratch, 2, method)[1].count() == 3


def test_logs_in_full(spark):
    log = ["(1/3)", "10:00:00 Indexing: One", "Resuming: 4/9 chunks already done", "Processing chunks: 5/9 (55%)", "Processing chunks: 9/9", "  (100%) ETA: 3m", "Extracted 7 unique topics", "Book done: 12.5s (9 chunks, 1.39s/chunk)", "(2/3)", "Indexing: Two", "Error indexing Two", "(3/3)", "Indexing: Three", "Created 20 chunks", "Book done: 4.0s (20 chunks, 0.2s/chunk) | Total: 2/3 books, 1,029 chunks, 0.57s/chunk avg"]
    df = spark.createDataFrame(list(enumerate(log)), "n int, value string")
    r = documents.parse_log(df).orderBy("k").collect()
    assert [(x.number, x.of, x.book, x.status, x.chunks, x.seconds) for x in r] == [(1, 3, "One", "done", 9, 12.5), (2, 3, "Two", "error", None, None), (3, 3, "Three", "done", 20, 4.0)]
    assert (r[0].resumed, r[0].done, r[0].total, r[0].topics, r[0].eta_minutes, r[0].rate) == (4, 9, 9, 7, 3, 1.39)
    t = documents.log_totals(df).first()
    assert (t.completed, t.failed, t.skipped, t.chunks, t.rate) == (2, 1, 0, 1029, 0.57)
    assert documents.parse_log(df.limit(0)).count() == 0


def test_small_text_functions(spark):
    df = spark.createDataFrame([("Ångström & Ærø ﬁ", "Added book ids: 4, 17", [" A ", "a", "", None, "b"], "Last, First", "A Tale: of (two)")], "t string, o string, l array<string>, a string, s string")
    r = df.select(text.slug("t").alias("slug"), text.last_number(F.col("o")).alias("n"), text.last_number(F.col("t")).alias("none"), text.first_spellings(F.col("l")).alias("l"), text.file_name(F.lit(7), F.col("a"), F.col("s")).alias("f"), text.progress_bar(F.lit(5), F.lit(10), 4).alias("b"), text.time_left(F.lit(5), F.lit(10), F.lit(60)).alias("e"), text.progress_bar(F.lit(0), F.lit(0)).alias("z")).first()
    assert (r.slug, r.n, r.none, r.l, r.f, r.b, r.e, r.z) == ("angstrom_r", 17, None, ["a", "b"], "7_last_a_tale.epub", "[##--] 50%", "1m 0s", "")
    q = spark.createDataFrame([(["Deep sea", "love"],), ([],), ([" "],)], "t array<string>").select(scoring.topic_quality(F.col("t"), F.lit(0.5)).alias("q")).collect()
    assert q[0].q == pytest.approx(0.4 * 0.5 + 0.25 * 0.5 + 0.15 * 0.5 + 0.1 + 0.1 * 0.4) and q[1].q == q[2].q == 0


def test_pdf_pages_and_scans(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"text")
    (tmp_path / "b.pdf").write_bytes(b"scan")
    pages = lambda c: ["word " * 150, " ", "end"] if c == b"text" else [" x "]
    r = {x.path.rsplit("/", 1)[-1]: x for x in documents.read_documents(spark, str(tmp_path), pages, lambda c: "# Head\n\n![i](u)text").collect()}
    assert r["a.pdf"].text.endswith("\n\nend") and r["b.pdf"].text == "Head\n\ntext" and r["a.pdf"].status == r["b.pdf"].status == "ok"
    assert documents.first_available(("no_such_module", len), ("json", str)) is str and documents.first_available() is None


def test_a_library_is_brought_up_to_date(spark, scratch):
    pages = spark.createDataFrame([("t", '<a href="/book?id=f1.epub">Old</a><a href="/book?id=f2.pdf">The Sea</a><a href="/book?id=f3">Unmatched Words</a>')], "tag string, html string")
    books = spark.createDataFrame([(7, "f1", "Old")], "id long, ipad_id string, title string")
    cat = spark.createDataFrame([(3, "Across the sea", "Marsh, Ann", "S", 1.0, "P")], "id long, title string, author_sort string, series string, series_index double, publisher string")
    r = {x.ipad_id: x for x in pipeline.sync_library(pages, books, cat, scratch).collect()}
    assert len(r) == 3 and (r["f2"].id, r["f2"].calibre_id, r["f2"].author, r["f2"].has_calibre_match) == (8, 3, "Marsh, Ann", True)
    assert (r["f3"].id, r["f3"].calibre_id, r["f3"].has_calibre_match) == (9, None, False) and r["f1"].id == 7


@pytest.mark.parametrize("mode,kind", [("knn", "cpm"), ("cooccurrence", "modularity"), ("full", "surprise")])
def test_clustering_modes(spark, scratch, mode, kind):
    rng = random.Random(2)
    links = [(c, (c % 3) * 10 + t) for c in range(60) for t in rng.sample(range(10), 4)]
    topics = spark.createDataFrame([(i, f"label {i}") for i in range(30)], "id long, label string")
    vec = spark.createDataFrame([(i, [float(i // 10 == j) + 0.01 * (i % 10) for j in range(3)]) for i in range(30)], "id long, v array<double>")
    chunks = spark.createDataFrame([(c, c // 5) for c in range(60)], "id long, book_id long")
    out = pipeline.clustered(spark.createDataFrame(links, "chunk_id long, topic_id long"), chunks, topics, vec, scratch, mode, kind, 0.5 if kind == "cpm" else 1.0, 3, 0.9, 2, -9.0, remove_hubs=mode == "knn")
    m = {r.node: r.community for r in out["membership"].collect()}
    assert set(m) <= set(range(30)) and len(m) >= 28
    assert all(len({m[v] for v in range(g * 10, g * 10 + 10) if v in m and m[v] >= 0} & {m[v] for v in range(30) if v // 10 != g and v in m and m[v] >= 0}) == 0 for g in range(3))
    assert sum(r["size"] for r in out["sizes"].collect()) == sum(c >= 0 for c in m.values())


def test_models_around_topics(spark):
    assert models.batch_schema(2).fieldNames() == ["chunk_1", "chunk_2"] and models.embedder_info() == {"name": "hashed_grams", "dimension": models.DIM}
    assert models.endpoint("a/b/c", {"a/": "x", "a/b": "y"}, "z") == "y" and models.endpoint("q", {"a": "x"}, "z") == "z"
    t = spark.createDataFrame([(1, ["Sea ", "sea", "Ocean"]), (2, []), (3, ["bad"])], "id long, topics array<string>")

    def merger(ts):
        if "bad" in ts:
            raise RuntimeError
        return {" Water": ts, "": ["x"], "none": []}

    assert [tuple(r) for r in models.consolidated(t, merger).collect()] == [(1, "water", ["sea", "ocean"])]
    s = spark.createDataFrame([(1, 9, ["a"]), (2, 9, ["b"]), (3, 1, ["c"])], "cluster_id long, size long, topics array<string>")
    l = models.labelled_queue(s, spark.createDataFrame([(1, "kept")], "cluster_id long, label string"))
    assert sorted(map(tuple, l.collect())) == [(1, "kept"), (2, "b")]
    b = spark.createDataFrame([(1, "T", "the wide sea and the wide sea")], "id long, title string, text string")
    assert "wide sea" in models.book_themes(b).first().themes


def test_shared_folder_is_asked_for_off_local_mode():
    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class O:
                                @staticmethod
                                def isDefined():
                                    return False

                            return O

                    return S

        class conf:  # noqa: N801
            @staticmethod
            def get(_, default=None):
                return default

    with pytest.raises(ValueError):
        session.shared_dir(Fake)
