"""The relational queries of the engine as SQL over its tables, one text for every engine that speaks the dialect.

``Dialect`` holds the few spellings that differ; everything else is plain SQL.  ``MODEL`` is the common ground: links
without repeats, topics with their occurrences recounted, and the joins and materialised statistics built on them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexigraph.session import table

TABLES = "books calibre_books chunks chunk_topics chunk_topic_links topics documents".split()


@dataclass(frozen=True)
class Dialect:
    name: str

    def joined(self, x: str, order: str, sep: str = ", ") -> str:
        if self.name == "spark":
            return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def argmax(self, x: str, by: str, tie: str) -> str:
        """x of the row with the greatest ``by``, the least ``tie`` among equals."""
        if self.name == "spark":
            return f"max_by({x}, struct({by}, -{tie}))"
        return f"arg_max({x}, row({by}, -{tie}))"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.name == "spark" else f"quantile_cont({x}, {p})"

    def long(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def first_part(self, x: str, sep: str) -> str:
        return f"split_part({x}, '{sep}', 1)"

    def paged(self, offset: int, limit: int) -> str:
        return f"LIMIT {limit} OFFSET {offset}"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def model(d: Dialect) -> str:
    relevance = """CASE WHEN topic_count < 3 THEN 0.0 ELSE (topic_count / CAST(book_total AS DOUBLE)) * 2.5 / (topic_count / CAST(book_total AS DOUBLE) + 1.5)
 * (1 + CASE WHEN book_total * CAST(size_topics AS DOUBLE) / total > 0 THEN greatest(log2(topic_count / (book_total * CAST(size_topics AS DOUBLE) / total)), 0) ELSE 0 END) END"""
    return f"""WITH lk AS (SELECT DISTINCT chunk_id, topic_id FROM chunk_topic_links WHERE chunk_id IS NOT NULL AND topic_id IS NOT NULL),
tp AS (SELECT t.id, t.label, t.cluster_id, t.parent_topic_id, {d.long('coalesce(o.n, 0)')} occ FROM topics t LEFT JOIN (SELECT topic_id, count(*) n FROM lk GROUP BY topic_id) o ON o.topic_id = t.id),
bt AS (SELECT c.book_id, l.chunk_id, t.id topic_id, t.label, t.cluster_id, t.occ FROM lk l JOIN chunks c ON c.id = l.chunk_id JOIN tp t ON t.id = l.topic_id),
cb0 AS (SELECT cluster_id, book_id, count(DISTINCT topic_id) topic_count FROM bt WHERE cluster_id IS NOT NULL GROUP BY cluster_id, book_id),
cb AS (SELECT cluster_id, book_id, topic_count, {d.long('sum(topic_count) OVER (PARTITION BY book_id)')} book_total FROM cb0),
cs AS (SELECT cluster_id, count(*) size FROM tp WHERE cluster_id IS NOT NULL GROUP BY cluster_id),
dm AS (SELECT DISTINCT cluster_id % 6 id, concat('domain ', CAST(cluster_id % 6 AS VARCHAR(9))) label FROM cs WHERE cluster_id >= 0 UNION ALL SELECT 6, 'an empty domain'),
cd AS (SELECT cluster_id, cluster_id % 6 domain_id FROM cs WHERE cluster_id >= 0),
cl AS (SELECT cluster_id, min(label) label FROM tp WHERE occ >= 20 AND cluster_id IS NOT NULL GROUP BY cluster_id),
tl AS (SELECT sum(topic_count) total FROM cb0),
rl AS (SELECT cluster_id, book_id, topic_count, book_total, {relevance} AS score FROM (SELECT cb.*, cs.size size_topics, total FROM cb CROSS JOIN tl JOIN cs USING (cluster_id) JOIN books b ON b.id = cb.book_id WHERE b.calibre_id IS NOT NULL) q),
db AS (SELECT cd.domain_id, cb.book_id, {d.long('sum(cb.topic_count)')} topic_count, max(cb.book_total) book_total FROM cd JOIN cb ON cb.cluster_id = cd.cluster_id GROUP BY cd.domain_id, cb.book_id),
dt AS (SELECT domain_id, {d.long('sum(topic_count)')} size_topics, count(*) book_count FROM db GROUP BY domain_id),
dr AS (SELECT domain_id, book_id, {relevance} AS score FROM (SELECT db.*, dt.size_topics, total FROM db CROSS JOIN tl JOIN dt ON dt.domain_id = db.domain_id JOIN books b ON b.id = db.book_id WHERE b.calibre_id IS NOT NULL) q),
ds AS (SELECT dm.id domain_id, dm.label, coalesce(dt.book_count, 0) book_count, coalesce(dt.size_topics, 0) topic_count, coalesce(r.top_books, '') top_books, coalesce(t.top_clusters, '') top_clusters FROM dm LEFT JOIN dt ON dt.domain_id = dm.id
LEFT JOIN (SELECT domain_id, {d.joined('CAST(book_id AS VARCHAR(20))', 'rn')} top_books FROM (SELECT domain_id, book_id, row_number() OVER (PARTITION BY domain_id ORDER BY round(score, 9) DESC, book_id) rn FROM dr) x WHERE rn <= 5 GROUP BY domain_id) r ON r.domain_id = dm.id
LEFT JOIN (SELECT domain_id, {d.joined('CAST(cluster_id AS VARCHAR(20))', 'rn')} top_clusters FROM (SELECT cd.domain_id, cs.cluster_id, row_number() OVER (PARTITION BY domain_id ORDER BY cs.size DESC, cs.cluster_id) rn FROM cd JOIN cs ON cs.cluster_id = cd.cluster_id) x WHERE rn <= 5 GROUP BY domain_id) t ON t.domain_id = dm.id)
"""


Q: dict[str, Callable[[Dialect], str]] = {}


def query(name: str):
    def add(f: Callable[[Dialect], str]):
        Q[name] = f
        return f

    return add


def simple(name: str, text: str) -> None:
    Q[name] = lambda d: text


def books_batch(ids: list[int]) -> str:
    """The books of these ids; none for no id, or for more than fifty."""
    return f"SELECT id, title, author FROM books WHERE {f'id IN ({chr(44).join(map(str, ids))})' if 1 <= len(ids) <= 50 else '1 = 0'}"


# Filters and lookups
simple("f01_book", "SELECT id, title, author, calibre_id FROM books WHERE id = 111")
simple("f02_book_by_title", "SELECT id, title FROM books WHERE title ILIKE '%keeper%' ORDER BY id LIMIT 1")
simple("f03_matched_books", "SELECT id, title, calibre_id FROM books WHERE calibre_id IS NOT NULL")
Q["f04_books_batch"] = lambda d: books_batch([1, 104, 106, 111, 9999999])
Q["f04_books_batch_none"] = lambda d: books_batch([])
Q["f05_all_topics"] = lambda d: model(d) + "SELECT tp.id, tp.label, tp.occ, (t.embedding IS NOT NULL) AS has_embedding FROM tp JOIN topics t ON t.id = tp.id"
simple("f06_topics_without_embedding", "SELECT id, label FROM topics WHERE embedding IS NULL")
Q["f08_cluster_eligibility"] = lambda d: model(d) + "SELECT cluster_id, count(*) AS size FROM tp WHERE cluster_id IS NOT NULL AND cluster_id >= 0 GROUP BY cluster_id HAVING count(*) >= 3"
Q["f09_theme_predicate"] = lambda d: model(d) + "SELECT cs.cluster_id, cs.size, k.n AS book_count FROM cs JOIN (SELECT cluster_id, count(*) n FROM cb GROUP BY cluster_id) k USING (cluster_id) WHERE cs.size <= 60 AND k.n >= 2"
simple("f10_label_length", "SELECT id, label FROM topics WHERE length(label) >= 4")
Q["f12_cluster_topics"] = lambda d: model(d) + "SELECT id, label, coalesce(nullif(occ, 0), 1) AS occ FROM tp WHERE cluster_id = 3"
Q["f13_browse_topics"] = lambda d: model(d) + "SELECT id, label, occ FROM tp WHERE label ILIKE '%silver%' ORDER BY occ DESC, id LIMIT 20"

# Joins
Q["j01_book_topics"] = lambda d: model(d) + "SELECT b.id AS book_id, b.title, count(*) AS mentions, count(DISTINCT bt.topic_id) AS topics FROM bt JOIN books b ON b.id = bt.book_id GROUP BY b.id, b.title"
Q["j12_clusters_without_label"] = lambda d: model(d) + "SELECT cs.cluster_id, cs.size FROM cs LEFT JOIN cl ON cl.cluster_id = cs.cluster_id WHERE cl.cluster_id IS NULL"
Q["j13_backfill_chunks"] = lambda d: model(d) + "SELECT c.id, c.book_id FROM chunks c LEFT JOIN (SELECT DISTINCT chunk_id FROM lk) x ON x.chunk_id = c.id WHERE x.chunk_id IS NULL AND c.book_id IN (SELECT book_id FROM bt)"
simple("j14_pending_chunks", "SELECT c.book_id, count(*) AS pending FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunk_topics x WHERE x.chunk_id = c.id) GROUP BY c.book_id")
simple("j15_books_without_either", "SELECT b.id FROM books b WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.book_id = b.id) AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.book_id = b.id)")
simple("j16_new_books", "SELECT k.id, k.title FROM calibre_books k WHERE NOT EXISTS (SELECT 1 FROM books b WHERE b.calibre_id = k.id)")
simple("j17_books_not_chunked", "SELECT id FROM books WHERE id NOT IN (SELECT book_id FROM chunks WHERE book_id IS NOT NULL)")
Q["j20_shared_book"] = lambda d: model(d) + ", tb AS (SELECT DISTINCT topic_id, book_id FROM bt) SELECT p.id AS topic_id, p.parent_topic_id, count(b.book_id) > 0 AS shared FROM tp p LEFT JOIN tb a ON a.topic_id = p.id LEFT JOIN tb b ON b.topic_id = p.parent_topic_id AND b.book_id = a.book_id WHERE p.parent_topic_id IS NOT NULL GROUP BY p.id, p.parent_topic_id"
Q["j21_domain_of_cluster"] = lambda d: model(d) + "SELECT cs.cluster_id, coalesce(cd.domain_id, -1) AS domain_id, coalesce(dm.label, 'Unknown') AS domain FROM cs LEFT JOIN cd ON cd.cluster_id = cs.cluster_id LEFT JOIN dm ON dm.id = cd.domain_id"
simple("j22_scalar_subquery", "SELECT b.id, (SELECT max(k.path) FROM calibre_books k WHERE k.id = b.calibre_id) AS path FROM books b")
Q["j23_top_label_per_cluster"] = lambda d: model(d) + f"SELECT cluster_id, {d.argmax('label', 'occ', 'id')} AS top_label FROM tp WHERE cluster_id IS NOT NULL GROUP BY cluster_id"

# Aggregations
Q["a01_cluster_books"] = lambda d: model(d) + "SELECT cluster_id, book_id, topic_count, book_total FROM cb"
Q["a03_cluster_stats"] = lambda d: model(d) + f"""SELECT cs.cluster_id, cs.size, coalesce(k.n, 0) AS book_count, t.top_label, t.top_topics, r.top_books FROM cs LEFT JOIN (SELECT cluster_id, count(*) n FROM cb GROUP BY cluster_id) k ON k.cluster_id = cs.cluster_id
LEFT JOIN (SELECT cluster_id, max(CASE WHEN rn = 1 THEN label END) top_label, {d.joined('label', 'rn', ' / ')} top_topics FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY occ DESC, id) rn FROM tp WHERE length(label) >= 4) x WHERE rn <= 3 GROUP BY cluster_id) t ON t.cluster_id = cs.cluster_id
LEFT JOIN (SELECT cluster_id, {d.joined('CAST(book_id AS VARCHAR(20))', 'rn')} top_books FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, book_id) rn FROM rl) y WHERE rn <= 5 GROUP BY cluster_id) r ON r.cluster_id = cs.cluster_id"""
Q["a04_domain_stats"] = lambda d: model(d) + "SELECT domain_id, label, book_count, topic_count, top_books, top_clusters FROM ds"
Q["a06_relevance"] = lambda d: model(d) + "SELECT cluster_id, book_id, round(score, 6) AS score FROM rl"
Q["a07_status"] = lambda d: model(d) + "SELECT (SELECT count(*) FROM books) AS books, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT book_id) FROM chunks) AS indexed_books, (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM topics WHERE embedding IS NOT NULL) AS embedded, (SELECT count(*) FROM lk) AS links, (SELECT count(DISTINCT topic) FROM chunk_topics) AS raw_topics"
Q["a11_occurrence_recount"] = lambda d: model(d) + "SELECT id, occ FROM tp"
Q["a12_topics_of_book"] = lambda d: "SELECT c.book_id, x.topic, count(*) AS n FROM (SELECT DISTINCT chunk_id, topic FROM chunk_topics) x JOIN chunks c ON c.id = x.chunk_id WHERE c.book_id = 1 GROUP BY c.book_id, x.topic"
Q["a13_clusters_of_book"] = lambda d: model(d) + f"SELECT book_id, cluster_id, topics, labels, count(*) OVER (PARTITION BY book_id) AS clusters FROM (SELECT book_id, cluster_id, count(DISTINCT topic_id) AS topics, {d.joined('label', 'label')} AS labels FROM (SELECT DISTINCT book_id, cluster_id, topic_id, label FROM bt WHERE cluster_id >= 0) x GROUP BY book_id, cluster_id) y"
Q["a14_book_detail_topics"] = lambda d: model(d) + "SELECT book_id, topic_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, topic_id) rn FROM (SELECT book_id, topic_id, label, count(*) n FROM bt GROUP BY book_id, topic_id, label) x) y WHERE rn <= 30"
Q["a15_related_books"] = lambda d: model(d) + "SELECT o.book_id, count(DISTINCT o.topic_id) AS shared_topics, round(count(DISTINCT o.topic_id) / CAST((SELECT count(DISTINCT topic_id) FROM bt WHERE book_id = 106) AS DOUBLE), 3) AS similarity FROM bt o WHERE o.book_id <> 106 AND o.topic_id IN (SELECT topic_id FROM bt WHERE book_id = 106) GROUP BY o.book_id"
Q["a18_cluster_summary"] = lambda d: model(d) + f"SELECT cluster_id, max(n) AS size, {d.joined('label', 'rn', '; ')} AS top_topics FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY occ DESC, id) rn, count(*) OVER (PARTITION BY cluster_id) n FROM tp WHERE cluster_id IS NOT NULL) x WHERE rn <= 5 GROUP BY cluster_id"
Q["a19_mega_clusters"] = lambda d: model(d) + "SELECT cluster_id, size, (SELECT max(cluster_id) FROM cs) AS last_id FROM cs WHERE size >= 50"
Q["a20_cluster_sizes"] = lambda d: model(d) + """, z AS (SELECT cluster_id, size FROM cs WHERE cluster_id >= 0) SELECT 'histogram' AS kind, size AS k, count(*) AS n FROM z GROUP BY size UNION ALL SELECT 'largest', cluster_id, size FROM (SELECT * FROM z ORDER BY size DESC, cluster_id LIMIT 10) x
UNION ALL SELECT 'clusters', 0, count(*) FROM z UNION ALL SELECT 'least', 0, min(size) FROM z UNION ALL SELECT 'most', 0, max(size) FROM z"""
simple("a22_formats", "SELECT coalesce(a.f, b.f) AS format, coalesce(a.n, 0) AS declared, coalesce(b.n, 0) AS matched FROM (SELECT lower(format) f, count(*) n FROM books GROUP BY lower(format)) a FULL OUTER JOIN (SELECT lower(b.format) f, count(*) n FROM books b JOIN calibre_books k ON k.id = b.calibre_id GROUP BY lower(b.format)) b ON a.f = b.f")
Q["a23_fully_indexed"] = lambda d: "SELECT c.book_id, count(*) AS chunks FROM chunks c LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_topics) x ON x.chunk_id = c.id GROUP BY c.book_id HAVING count(*) = count(x.chunk_id)"
Q["a24_progress"] = lambda d: """WITH b AS (SELECT c.book_id, count(*) n, count(x.chunk_id) done, max(c.id) last_id FROM chunks c LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_topics) x ON x.chunk_id = c.id GROUP BY c.book_id)
SELECT 'recent' AS kind, book_id AS k, CAST(last_id AS DOUBLE) AS v FROM (SELECT * FROM b ORDER BY last_id DESC LIMIT 1) x UNION ALL SELECT 'completed', book_id, n FROM (SELECT * FROM b WHERE done = n ORDER BY last_id DESC LIMIT 5) y
UNION ALL SELECT 'chunks per book', count(*), round(avg(n), 6) FROM b UNION ALL SELECT 'estimated chunks', (SELECT count(*) FROM books), round(avg(n) * (SELECT count(*) FROM books), 3) FROM b"""
Q["a25_auto_label"] = lambda d: model(d) + f"SELECT domain_id, {d.joined('label', 'rn', ' / ')} AS label FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY n DESC, label) rn FROM (SELECT cd.domain_id, tp.label, sum(tp.occ) n FROM tp JOIN cd ON cd.cluster_id = tp.cluster_id WHERE length(tp.label) >= 4 GROUP BY cd.domain_id, tp.label) x) y WHERE rn <= 3 GROUP BY domain_id"
Q["a26_merged_domains"] = lambda d: model(d) + f"""SELECT {d.long('row_number() OVER (ORDER BY clusters DESC, label)')} - 1 AS domain_id, label, clusters, topics, ids FROM (SELECT concat('merged ', CAST(cd.domain_id % 3 AS VARCHAR(9))) label, count(*) clusters, {d.long('sum(cs.size)')} topics, {d.joined('CAST(cd.cluster_id AS VARCHAR(20))', 'cd.cluster_id', ',')} ids
FROM cd JOIN cs ON cs.cluster_id = cd.cluster_id GROUP BY concat('merged ', CAST(cd.domain_id % 3 AS VARCHAR(9)))) x"""
simple("a29_corpus_topic_stats", """WITH x AS (SELECT DISTINCT raw_id, chunk_id, topic FROM chunk_topics WHERE trim(topic) <> ''), a AS (SELECT count(*) total, count(DISTINCT topic) distinct_topics, count(DISTINCT chunk_id) chunks, avg(CASE WHEN trim(topic) LIKE '% %' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) multi FROM x)
SELECT 'total' AS kind, '' AS k, CAST(total AS DOUBLE) AS v FROM a UNION ALL SELECT 'distinct', '', distinct_topics FROM a UNION ALL SELECT 'per chunk', '', round(total / CAST(chunks AS DOUBLE), 6) FROM a UNION ALL SELECT 'several words', '', round(multi, 6) FROM a UNION ALL SELECT 'one word', '', round(1 - multi, 6) FROM a
UNION ALL SELECT 'empty chunks', '', count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.chunk_id = c.id) UNION ALL SELECT 'top', topic, n FROM (SELECT topic, count(*) n FROM x GROUP BY topic ORDER BY n DESC, topic LIMIT 10) t""")
Q["a32_selection_stats"] = lambda d: model(d) + """, sel AS (SELECT cluster_id FROM cs WHERE cluster_id BETWEEN 0 AND 20), b AS (SELECT bt.* FROM bt JOIN sel ON sel.cluster_id = bt.cluster_id)
SELECT 'books' AS kind, 0 AS k, count(DISTINCT book_id) AS n FROM b UNION ALL SELECT 'topics', 0, count(DISTINCT topic_id) FROM b UNION ALL SELECT 'domain', domain_id, count(*) FROM cd JOIN sel ON sel.cluster_id = cd.cluster_id GROUP BY domain_id
UNION ALL SELECT 'book', book_id, n FROM (SELECT book_id, count(DISTINCT topic_id) n FROM b GROUP BY book_id ORDER BY n DESC, book_id LIMIT 50) x UNION ALL SELECT 'topic', id, occ FROM (SELECT tp.id, tp.occ FROM tp JOIN sel ON sel.cluster_id = tp.cluster_id ORDER BY tp.occ DESC, tp.id LIMIT 15) y"""
simple("a33_library_stats", "SELECT count(*) AS books, count(calibre_id) AS matched, count(DISTINCT author) AS authors, count(description) AS described, count(DISTINCT series) AS series FROM books")

# Window-style
Q["w01_top_topics"] = lambda d: model(d) + "SELECT cluster_id, rn AS place, id, label FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY occ DESC, id) rn FROM tp WHERE cluster_id IS NOT NULL) x WHERE rn <= 15"
Q["w02_top_books"] = lambda d: model(d) + "SELECT cluster_id, book_id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, book_id) rn FROM rl) x WHERE rn <= 5"
Q["w04_share_of_total"] = lambda d: model(d) + "SELECT book_id, cluster_id, round(topic_count / CAST(book_total AS DOUBLE), 6) AS share FROM cb"
Q["w09_min_max_scaling"] = lambda d: model(d) + "SELECT cluster_id, round(-1 + CAST(2 AS DOUBLE) * (size - min(size) OVER (PARTITION BY cluster_id % 6)) / nullif(max(size) OVER (PARTITION BY cluster_id % 6) - min(size) OVER (PARTITION BY cluster_id % 6), 0), 6) AS scaled FROM cs WHERE cluster_id >= 0"

# Sorts, limits, pagination
simple("k01_books_page", "SELECT DISTINCT b.id, b.title FROM books b JOIN chunks c ON c.book_id = b.id ORDER BY b.title, b.id LIMIT 20 OFFSET 40")
Q["k02_themes_by_density"] = lambda d: model(d) + "SELECT cluster_id, size, n AS book_count FROM (SELECT cs.cluster_id, cs.size, k.n, row_number() OVER (ORDER BY CAST(k.n AS DOUBLE) / greatest(cs.size, 1) DESC, cs.cluster_id) rn FROM cs JOIN (SELECT cluster_id, count(*) n FROM cb GROUP BY cluster_id) k USING (cluster_id)) x WHERE rn <= 50"
Q["k03_theme_detail"] = lambda d: model(d) + "SELECT 'topic' AS kind, id, n FROM (SELECT id, occ n FROM tp WHERE cluster_id = 3 ORDER BY occ DESC, id LIMIT 50) x UNION ALL SELECT 'book', book_id, topic_count FROM cb WHERE cluster_id = 3"
Q["k07_domains_ranked"] = lambda d: model(d) + "SELECT dm.id, dm.label, count(DISTINCT cd.cluster_id) AS cluster_count FROM dm LEFT JOIN cd ON cd.domain_id = dm.id GROUP BY dm.id, dm.label ORDER BY cluster_count DESC, dm.id"
Q["k07_domain_clusters"] = lambda d: model(d) + "SELECT cd.domain_id, cs.cluster_id, cs.size, row_number() OVER (PARTITION BY cd.domain_id ORDER BY cs.size DESC, cs.cluster_id) AS place FROM cd JOIN cs ON cs.cluster_id = cd.cluster_id"
Q["j09_domain_list"] = lambda d: model(d) + "SELECT dm.id, dm.label, coalesce(ds.book_count, 0) AS book_count, coalesce(ds.top_books, '') AS sample_books, coalesce(ds.top_clusters, '') AS top_clusters FROM dm LEFT JOIN (SELECT * FROM ds WHERE book_count > 0) ds ON ds.domain_id = dm.id"
Q["k06_sample"] = lambda d: model(d) + ", smp AS (SELECT id FROM topics ORDER BY md5(concat(CAST(id AS VARCHAR(20)), ':42')), id LIMIT 200), p AS (SELECT a.topic_id t1, b.topic_id t2, count(*) n FROM lk a JOIN lk b ON a.chunk_id = b.chunk_id AND a.topic_id < b.topic_id WHERE a.topic_id IN (SELECT id FROM smp) AND b.topic_id IN (SELECT id FROM smp) GROUP BY a.topic_id, b.topic_id) SELECT 'node' AS kind, id AS a, id AS b, 0 AS n FROM smp UNION ALL SELECT 'edge', t1, t2, n FROM p"
Q["k08_label_queue"] = lambda d: model(d) + "SELECT cluster_id, size FROM cs WHERE size >= 5 AND cluster_id NOT IN (SELECT cluster_id FROM cd WHERE domain_id = 0) ORDER BY size DESC, cluster_id LIMIT 40"

Q["j02_labelled_pairs"] = lambda d: model(d) + "SELECT p.t1 AS topic1_id, a.label AS label1, p.t2 AS topic2_id, b.label AS label2, p.n AS count FROM (SELECT x.topic_id t1, y.topic_id t2, count(*) n FROM lk x JOIN lk y ON x.chunk_id = y.chunk_id AND x.topic_id < y.topic_id GROUP BY x.topic_id, y.topic_id) p JOIN tp a ON a.id = p.t1 JOIN tp b ON b.id = p.t2 WHERE p.n >= 2"
# Set logic
simple("u01_raw_topics_not_labels", "SELECT lower(trim(topic)) AS topic FROM chunk_topics WHERE trim(topic) <> '' EXCEPT SELECT lower(label) FROM topics")
simple("u02_raw_topics_that_are_labels", "SELECT lower(trim(topic)) AS topic FROM chunk_topics INTERSECT SELECT lower(label) FROM topics")

# Search and browsing
Q["q01_keyword_search"] = lambda d: model(d) + """, h AS (SELECT * FROM (SELECT id, 1.0 AS score, 'title' AS match_type FROM books WHERE title ILIKE '%silver%' ORDER BY id LIMIT 20) a UNION ALL SELECT * FROM (SELECT id, 0.8, 'author' FROM books WHERE author ILIKE '%silver%' ORDER BY id LIMIT 20) b
UNION ALL SELECT book_id, 0.6, 'topic' FROM (SELECT DISTINCT book_id, label FROM bt WHERE label ILIKE '%silver%' ORDER BY book_id, label LIMIT 20) c)
SELECT id, CAST(score AS DOUBLE) AS score, match_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC) rn FROM h) x WHERE rn = 1"""
Q["q06_raw_topic_search"] = lambda d: raw_search(d, "memory")
Q["q06_full_text_fallback"] = lambda d: raw_search(d, "keeper saga")
Q["q08_book_detail"] = lambda d: model(d) + f""", own AS (SELECT topic_id, label, cluster_id, count(*) n FROM bt WHERE book_id = 106 GROUP BY topic_id, label, cluster_id), top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, topic_id) rn FROM own) x WHERE rn <= 30)
SELECT b.id, b.title, b.author, (SELECT count(*) FROM chunks c WHERE c.book_id = 106) AS chunks, (SELECT {d.joined("concat(label, ' (', CAST(n AS VARCHAR(20)), ')')", 'rn', '; ')} FROM top) AS topics,
(SELECT {d.joined("concat(CAST(cluster_id AS VARCHAR(20)), ':', coalesce(label, ''))", 'cluster_id', '; ')} FROM (SELECT DISTINCT top.cluster_id, cl.label FROM top LEFT JOIN cl ON cl.cluster_id = top.cluster_id WHERE top.cluster_id >= 0) x) AS themes FROM books b WHERE b.id = 106"""
Q["q10_domain_detail"] = lambda d: model(d) + f"SELECT b.id, b.title, {d.long('sum(cb.topic_count)')} AS total_topics FROM cd JOIN cb ON cb.cluster_id = cd.cluster_id JOIN books b ON b.id = cb.book_id WHERE cd.domain_id = 1 GROUP BY b.id, b.title"
Q["q14_topic_tree"] = lambda d: model(d) + f"""SELECT cluster_id, max(n) AS size, max(CASE WHEN rn = 1 THEN label END) AS name, {d.joined("concat(label, ' (', CAST(occ AS VARCHAR(20)), ')')", 'rn', '; ')} AS topics FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY occ DESC, id) rn, count(*) OVER (PARTITION BY cluster_id) n FROM tp WHERE cluster_id IS NOT NULL) x WHERE n >= 2 GROUP BY cluster_id"""
Q["q16_dashboard"] = lambda d: model(d) + """SELECT 'books' AS kind, '' AS k, count(*) AS n FROM books UNION ALL SELECT 'matched', '', count(calibre_id) FROM books UNION ALL SELECT 'indexed', '', count(DISTINCT book_id) FROM chunks UNION ALL SELECT 'chunks', '', count(*) FROM chunks UNION ALL SELECT 'topics', '', count(*) FROM tp
UNION ALL SELECT 'embedded', '', count(embedding) FROM topics UNION ALL SELECT 'links', '', count(*) FROM lk UNION ALL SELECT 'clusters', '', count(*) FROM cs WHERE cluster_id >= 0 UNION ALL SELECT 'format', lower(format), count(*) FROM books GROUP BY lower(format) UNION ALL SELECT 'format matched', lower(format), count(calibre_id) FROM books GROUP BY lower(format)"""
Q["q17_clusters_of_domain"] = lambda d: model(d) + "SELECT cd.domain_id, cd.cluster_id, coalesce(cl.label, concat('cluster_', CAST(cd.cluster_id AS VARCHAR(20)))) AS label FROM cd LEFT JOIN cl ON cl.cluster_id = cd.cluster_id"
simple("q18_vector_index_stats", "SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS lengths FROM topics WHERE embedding IS NOT NULL")

# ETL steps that are plain SQL
simple("s08_preferred_format", "SELECT key, format FROM (SELECT lower(trim(title)) AS key, lower(format) AS format, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY CASE lower(format) WHEN 'epub' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END, id) rn FROM books) x WHERE rn = 1")
simple("s09_catalogue_metadata", "SELECT b.id, k.title, k.author_sort, k.series, k.series_index, k.publisher, b.description, concat('ipad=', b.ipad_id, CASE WHEN k.id IS NULL THEN '' ELSE concat(';calibre=', CAST(k.id AS VARCHAR(20))) END) AS identifiers, lower(b.format) AS formats FROM books b LEFT JOIN calibre_books k ON k.id = b.calibre_id")
simple("s16_synthetic_keys", "SELECT k.id, coalesce(b.ipad_id, concat('calibre:', CAST(k.id AS VARCHAR(20)))) AS ipad_id FROM calibre_books k LEFT JOIN books b ON b.calibre_id = k.id")
simple("s17_enriched", "SELECT b.id, coalesce(b.publisher, k.publisher, 'unknown') AS publisher, coalesce(b.series, k.series) AS series FROM books b LEFT JOIN calibre_books k ON k.id = b.calibre_id")
simple("s18_untagged", "SELECT b.id FROM books b WHERE b.series IS NULL AND NOT EXISTS (SELECT 1 FROM calibre_books k WHERE k.id = b.calibre_id AND k.series IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.book_id = b.id)")
simple("e03_resume", "SELECT c.id, c.book_id, c.chunk_index FROM chunks c LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_topics) x ON x.chunk_id = c.id WHERE x.chunk_id IS NULL AND c.book_id IN (SELECT c2.book_id FROM chunks c2 JOIN chunk_topics y ON y.chunk_id = c2.id)")


def raw_search(d: Dialect, words: str) -> str:
    """Books by raw topics that hold the words in this order; where there are none, books whose title, author or series
    holds each of them."""
    each = " AND ".join(f"t ILIKE '%{w}%'" for w in words.split())
    return f"""WITH hit AS (SELECT c.book_id, count(*) n FROM chunk_topics x JOIN chunks c ON c.id = x.chunk_id WHERE x.topic ILIKE '%{words}%' GROUP BY c.book_id),
ft AS (SELECT id, concat_ws(' ', title, author, series) t FROM books) SELECT * FROM (SELECT book_id, n AS matches, 'topic' AS kind FROM hit UNION ALL SELECT id, 1, 'text' FROM ft WHERE {each} AND NOT EXISTS (SELECT 1 FROM hit)) x ORDER BY matches DESC, book_id LIMIT 20"""


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the tables of a directory.  Views are bound when the query is analysed."""
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def selection(d: Dialect) -> str:
    """The topics of some clusters within a rectangle of the first two coordinates."""
    x, y = (f"try_element_at(embedding, {i})" if d is SPARK else f"embedding[{i}]" for i in (1, 2))
    return f"SELECT id, {x} AS x, {y} AS y FROM topics WHERE {x} BETWEEN -0.1 AND 0.1 AND {y} BETWEEN -0.1 AND 0.1 AND cluster_id BETWEEN 1 AND 20"


Q["f11_selection"] = selection
Q["q18_vector_index_stats"] = lambda d: f"SELECT count(*) AS vectors, count(DISTINCT {'size' if d is SPARK else 'len'}(embedding)) AS lengths FROM topics WHERE embedding IS NOT NULL"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: run(spark, sf_dir, f(SPARK))) for k, f in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f(DUCK) for k, f in Q.items()}
