"""Queries of the text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import chunking, scoring, text
from lexigraph.operators import matching
from lexigraph.session import table


def of(name: str, source: str, key: str, **columns):
    """A query that selects a key and text functions of a table's columns."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, *[f.alias(k) for k, f in columns.items()])

    return name, q


def t05_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 100, 20)


def t12_filtered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("topics_json is not null")
    return c.select("id", F.array_join(text.filter_topics(F.from_json("topics_json", "array<string>")), "|").alias("topics"))


def s21_saved_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, topic) of the topics in chunks.topics_json, each once for a chunk."""
    c = table(spark, sf_dir, "chunks").where("topics_json is not null")
    t = c.select(F.col("id").alias("chunk_id"), F.explode(F.from_json("topics_json", "array<string>")).alias("topic"))
    return t.select("chunk_id", F.trim("topic").alias("topic")).where("topic <> ''").distinct()


def j19_catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, catalogue_id): each book's first record of equal title form, one whose author matches before others."""
    from pyspark.sql import Window

    b = table(spark, sf_dir, "books").select("id", "author", text.matching_form(F.col("title")).alias("k")).where("k <> ''")
    k = table(spark, sf_dir, "calibre_books").select(F.col("id").alias("catalogue_id"), "author_sort", text.matching_form(F.col("title")).alias("k"))
    j = b.join(k, "k").withColumn("ok", text.authors_match(F.col("author"), F.col("author_sort")))
    w = Window.partitionBy("id").orderBy(F.desc("ok"), "catalogue_id")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "catalogue_id", "ok")


def j18_contained_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, catalogue_id, same_author): each book's first record whose title holds the book's, matching authors first."""
    return matching.contained(table(spark, sf_dir, "books"), table(spark, sf_dir, "calibre_books"))


def a31_topic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, quality) of each chunk's raw topics, held against the labels of its links; equal topics count as similar."""
    raw = table(spark, sf_dir, "chunk_topics").dropna(subset=["chunk_id"]).groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.lower(text.strip(F.col("topic"))))).alias("t"))
    l = table(spark, sf_dir, "chunk_topic_links").join(table(spark, sf_dir, "topics").select(F.col("id").alias("topic_id"), F.lower("label").alias("label")), "topic_id").groupBy("chunk_id").agg(F.collect_set("label").alias("g"))
    d = raw.join(l, "chunk_id").withColumn("t", F.filter("t", lambda x: x != ""))
    f1 = 2 * F.size(F.array_intersect("t", "g")) / F.nullif(F.size("t") + F.size("g"), F.lit(0))
    return d.select("chunk_id", F.round(scoring.topic_quality(F.col("t"), f1), 6).alias("quality"))


def t06_all_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, place, paragraph): all paragraphs of every document, from place 0 on."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("place", "paragraph"))


def t09_all_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, place, part): all runs of ten words of every chunk, from place 0 on."""
    return table(spark, sf_dir, "chunks").select("id", F.posexplode(text.word_chunks(F.col("text"), 10)).alias("place", "part"))


C = F.col
_PY = [
    ("t01_html_to_text", "documents", "doc_id", dict(plain=lambda: text.html_to_text(C("text")))),
    ("t02_markdown", "documents", "doc_id", dict(plain=lambda: text.clean_markdown(C("text")))),
    ("t03_strip_html", "books", "id", dict(plain=lambda: text.strip_html(C("description")))),
    ("t04_remove_tags", "books", "id", dict(plain=lambda: text.remove_tags(C("description")))),
    ("t06_paragraphs", "documents", "doc_id", dict(n=lambda: F.size(text.paragraphs(C("text"))), first=lambda: F.get(text.paragraphs(C("text")), F.lit(0)))),
    ("t09_word_chunks", "chunks", "id", dict(n=lambda: F.size(text.word_chunks(C("text"), 10)), first=lambda: F.get(text.word_chunks(C("text"), 10), F.lit(0)))),
    ("t10_word_count", "chunks", "id", dict(words=lambda: text.word_count(C("text")))),
    ("t11_normalize_topic", "chunk_topics", "raw_id", dict(topic=lambda: text.normalize_topic(C("topic")))),
    ("t17_matching_form", "books", "id", dict(form=lambda: text.matching_form(C("title")))),
    ("t19_clean_author", "books", "id", dict(author=lambda: text.clean_author(C("author")), title=lambda: text.clean_title(C("title")))),
    ("t20_slug", "books", "id", dict(slug=lambda: text.slug(C("title")))),
    ("t24_duration", "chunks", "id", dict(d=lambda: text.duration(C("id")))),
]


def _lazy(source, key, columns):
    return lambda spark, sf_dir: table(spark, sf_dir, source).select(key, *[f().alias(k) for k, f in columns.items()])


def queries() -> dict:
    q = {name: _lazy(source, key, columns) for name, source, key, columns in _PY}
    return q | {"t05_chunks": t05_chunks, "t06_all_paragraphs": t06_all_paragraphs, "t09_all_word_chunks": t09_all_word_chunks, "t12_filtered_topics": t12_filtered_topics, "s21_saved_topics": s21_saved_topics, "j19_catalogue_match": j19_catalogue_match, "j18_contained_title": j18_contained_title, "a31_topic_quality": a31_topic_quality}


def _replaced(x: str, steps) -> str:
    for pattern, to in steps:
        to = to.replace("\n", "'||chr(10)||'")
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return x


def oracle_sql() -> dict[str, str]:
    html = _replaced("text", [(r"(?i)<br\s*/?>", "\n"), (r"(?i)<hr\s*/?>", "\n\n"), (rf"(?i)</?(?:{'|'.join(text.BLOCK_TAGS)})\b[^>]*>", "\n\n"), (r"<[^>]+>", " ")])
    for name, char in text.ENTITIES:
        html = f"replace({html}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    html = _replaced(html, [(r"\[\d+\]", ""), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"(?m)^[ \t\r]+|[ \t\r]+$", ""), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")])
    space = r"[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{1680}]"
    strip = lambda x: f"regexp_replace({x}, '\\A{space}+|{space}+\\z', '', 'g')"
    words = f"list_filter(regexp_split_to_array(text, '{space}+'), lambda w: w <> '')"
    pars = f"list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda p: {strip('p')}), lambda p: p <> '')"
    stop = ", ".join(f"'{x}'" for x in text.TOPIC_STOPLIST)
    norm = lambda x: f"regexp_replace(regexp_replace(lower({strip(x)}), '_', ' ', 'g'), ' {{2,}}', ' ', 'g')"
    good = lambda s: f"length({s}) >= 3 AND {s} NOT IN ({stop}) AND NOT regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[t ]') AND NOT regexp_matches({s}, '</?[a-z]|</div|</body|&amp;|&lt;|&gt;|/>') AND NOT regexp_matches({s}, '[{{}}\\[\\]]') AND length({s}) <= 100"
    form = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    toks = lambda x: f"list_distinct(list_filter(string_split({form(x)}, ' '), lambda w: w <> ''))"
    author = "regexp_replace(trim(author), '_\\d+$', '')"
    accents = f"lower(translate(title, '{text.PLAIN_FROM}', '{text.PLAIN_TO}'))"
    held, probe = "lower(regexp_replace(title, '[.,]', '', 'g'))", form("title")
    wc = f"len(list_filter(regexp_split_to_array(x, '{space}+'), lambda w: w <> ''))"
    mean = lambda e: f"list_sum(list_transform(t, lambda x: {e})) / len(t)"
    return {
        "t01_html_to_text": f"SELECT doc_id, {html} AS plain FROM documents",
        "t02_markdown": f"SELECT doc_id, {_replaced('text', [(chr(92) + 'n{3,}', chr(10) * 2), (r'!\[.*?\]\(.*?\)', ''), (r'(?m)^#{1,6}\s+', ''), (r'\A\s+|\s+\z', '')])} AS plain FROM documents",
        "t03_strip_html": f"SELECT id, {_replaced('description', [(r'<[^>]+>', ' '), ('&nbsp;', ' '), (r'\s+', ' '), (r'\A\s+|\s+\z', '')])} AS plain FROM books",
        "t04_remove_tags": f"SELECT id, {_replaced('description', [(r'<[^<]+?>', ''), (r'\A\s+|\s+\z', '')])} AS plain FROM books",
        "t06_paragraphs": f"SELECT doc_id, CAST(len({pars}) AS INTEGER) AS n, {pars}[1] AS first FROM documents",
        "t09_word_chunks": f"SELECT id, CAST(ceil(len({words}) / 10.0) AS INTEGER) AS n, array_to_string({words}[1:10], ' ') AS first FROM chunks",
        "t06_all_paragraphs": f"SELECT doc_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS place, unnest(l) AS paragraph FROM (SELECT doc_id, {pars} l FROM documents)",
        "t09_all_word_chunks": f"SELECT id, CAST(i AS INTEGER) AS place, array_to_string(l[i * 10 + 1:i * 10 + 10], ' ') AS part FROM (SELECT id, l, unnest(generate_series(0, CAST(ceil(len(l) / 10.0) AS BIGINT) - 1)) i FROM (SELECT id, {words} l FROM chunks))",
        "t10_word_count": f"SELECT id, CAST(len({words}) AS INTEGER) AS words FROM chunks",
        "t11_normalize_topic": f"SELECT raw_id, CASE WHEN {good('s')} THEN s END AS topic FROM (SELECT raw_id, {norm('topic')} s FROM chunk_topics)",
        "t12_filtered_topics": f"SELECT id, array_to_string(list_filter(list_transform(CAST(from_json(topics_json, '[\"VARCHAR\"]') AS VARCHAR[]), lambda t: CASE WHEN {good(norm('t'))} THEN {norm('t')} END), lambda t: t IS NOT NULL), '|') AS topics FROM chunks WHERE topics_json IS NOT NULL",
        "t17_matching_form": f"SELECT id, {form('title')} AS form FROM books",
        "t19_clean_author": f"SELECT id, CASE WHEN {author} IN ('', 'Unknown', '[Unknown Author]') THEN NULL WHEN len(string_split({author}, '|')) = 2 THEN trim(split_part({author}, '|', 2)) || ' ' || trim(split_part({author}, '|', 1)) ELSE {author} END AS author, trim(regexp_replace(regexp_replace(regexp_replace(title, '\\s*\\([A-Z][^)]+\\)\\s*$', '', 'g'), '_+\\d*$', '', 'g'), '^_+', '', 'g')) AS title FROM books",
        "t20_slug": f"SELECT id, regexp_replace(regexp_replace(regexp_replace({accents}, '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM books",
        "t24_duration": "SELECT id, CASE WHEN id >= 3600 THEN printf('%dh %dm', id // 3600, id % 3600 // 60) WHEN id >= 60 THEN printf('%dm %ds', id // 60, id % 60) ELSE printf('%ds', id) END AS d FROM chunks",
        "j18_contained_title": f"""SELECT id, catalogue_id, same_author FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY same_author DESC, catalogue_id) rn FROM (SELECT b.id, k.id catalogue_id, coalesce(least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) * 2 >= least(len(x), len(y)), false) same_author
FROM (SELECT id, {probe} f, {toks('author')} x FROM books) b JOIN (SELECT id, {held} h, {toks('author_sort')} y FROM calibre_books) k ON b.f <> '' AND contains(k.h, b.f))) WHERE rn = 1""",
        "a31_topic_quality": f"""WITH r AS (SELECT chunk_id, list_filter(list_distinct(list(lower({strip('topic')}))), lambda x: x <> '') t FROM chunk_topics WHERE chunk_id IS NOT NULL GROUP BY 1), l AS (SELECT chunk_id, list_distinct(list(lower(label))) g FROM chunk_topic_links JOIN topics ON topics.id = topic_id GROUP BY 1),
q AS (SELECT chunk_id, t, 2.0 * len(list_intersect(t, g)) / nullif(len(t) + len(g), 0) f1 FROM r JOIN l USING (chunk_id))
SELECT chunk_id, CASE WHEN len(t) > 0 THEN round(0.4 * f1 + 0.25 * {mean(f'CASE WHEN {wc} BETWEEN 2 AND 5 THEN 1.0 WHEN {wc} = 6 THEN 0.5 ELSE 0.0 END')} + 0.15 * {mean(f'CASE WHEN x IN ({stop}) THEN 0.0 ELSE 1.0 END')} + 0.1 * {mean(f'CASE WHEN {wc} > 6 THEN 0.0 ELSE 1.0 END')} + 0.1 * greatest(0, 1 - abs(len(t) - 5) * 0.2), 6) ELSE 0 END AS quality FROM q""",
        "s21_saved_topics": "SELECT DISTINCT id AS chunk_id, trim(topic) AS topic FROM (SELECT id, unnest(CAST(from_json(topics_json, '[\"VARCHAR\"]') AS VARCHAR[])) topic FROM chunks WHERE topics_json IS NOT NULL) WHERE trim(topic) <> ''",
        "j19_catalogue_match": f"""SELECT id, catalogue_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ok DESC, catalogue_id) rn FROM (SELECT b.id, k.id catalogue_id, coalesce(least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) * 2 >= least(len(x), len(y)), false) ok
FROM (SELECT id, {form('title')} f, {toks('author')} x FROM books) b JOIN (SELECT id, {form('title')} f, {toks('author_sort')} y FROM calibre_books) k ON b.f = k.f AND b.f <> '')) WHERE rn = 1""",
    }
