"""Files as texts: EPUB, HTML fragments, catalogues in CSV, logs.  PDF needs a parser of the caller's."""

from __future__ import annotations

import importlib.util
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.functions import text
from lexigraph.functions.text import ENTITIES

# Endings of the text parts of an EPUB, elements that are no text, words of a part and of a PDF at least.
PARTS = (".xhtml", ".html", ".htm", ".xml")
DROPPED = ["script", "style", "nav", "header", "footer"]
LEAST_PART_WORDS, LEAST_PDF_WORDS = 10, 100


def part_text(part: Column) -> Column:
    """Text of an HTML part without scripts and page furniture."""
    names = "|".join(DROPPED)
    bare = F.regexp_replace(F.regexp_replace(part, rf"(?i)<(?:{names})\b[^>]*/>", " "), rf"(?is)<({names})\b.*?</\1\s*>", " ")
    return text.html_to_text(bare)


def epub_parts(content: bytes) -> list[str]:
    """The HTML parts of an EPUB in order of their names, without tables of contents; parts that can't be read are left
    out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            low = name.lower()
            if (low.endswith(PARTS) or ".html_split_" in low) and not low.rsplit("/", 1)[-1].startswith("toc") and not low.endswith((".ncx", ".opf")):
                try:
                    out.append(z.read(name).decode("utf-8", "replace"))
                except (zipfile.BadZipFile, KeyError, OSError):
                    continue
    return out


def epub_metadata(content: bytes) -> tuple[str | None, str | None]:
    """(title, author) of an EPUB's package file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.lower().endswith(".opf"):
                found: dict[str, str] = {}
                for e in ElementTree.fromstring(z.read(name)).iter():
                    tag = e.tag.rsplit("}", 1)[-1]
                    if tag in ("title", "creator") and tag not in found and (e.text or "").strip():
                        found[tag] = e.text.strip()
                return found.get("title"), found.get("creator")
    return None, None


def first_available(*engines: tuple[str, Callable[[bytes], str]]) -> Callable[[bytes], str] | None:
    """The first of several (module, parser) whose module can be imported; None without any."""
    return next((parse for module, parse in engines if importlib.util.find_spec(module)), None)


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, format, title, author, text, status) of the files under a path, one row each.

    A broken or unsupported file is a row with its status, not an error.  EPUB is built in: its parts of more than ten
    words, joined by blank lines.  ``pdf`` gives the pages of a PDF's text layer; where they hold fewer than 100 words,
    ``ocr`` gives Markdown instead.  Only taking files apart runs in Python; the text is made by Columns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                kind = path.rsplit(".", 1)[-1].lower() if "." in path else "unknown"
                title = author = parts = scanned = None
                try:
                    if kind == "epub":
                        parts = epub_parts(content)
                        title, author = epub_metadata(content)
                    elif kind == "pdf" and (pdf or ocr):
                        parts = pdf(content) if pdf else []
                        if ocr and sum(len(p.split()) for p in parts) < LEAST_PDF_WORDS:
                            scanned = ocr(content)
                    status = "ok" if parts is not None else "unsupported"
                except Exception as e:  # noqa: BLE001
                    status, parts = f"error: {type(e).__name__}", None
                rows.append((path, kind, title, author, parts, scanned, status))
            yield pd.DataFrame(rows, columns=["path", "format", "title", "author", "parts", "scanned", "status"])

    d = files.mapInPandas(kernel, "path string, format string, title string, author string, parts array<string>, scanned string, status string")
    html = F.filter(F.transform("parts", part_text), lambda p: text.word_count(p) > LEAST_PART_WORDS)
    pages = F.filter(F.transform("parts", text.strip), lambda p: p != "")
    whole = F.when(F.col("scanned").isNotNull(), text.clean_markdown(F.col("scanned"))).when(F.col("format") == "epub", F.array_join(html, "\n\n")).otherwise(F.array_join(pages, "\n\n"))
    return d.select("path", "format", "title", "author", whole.alias("text"), "status")


def book_anchors(pages: Column) -> Column:
    """array<struct<file,id,format,title>> of the links '/book?id=<file>.<ext>' of an HTML page."""
    hrefs = F.regexp_extract_all(pages, F.lit(r'(?is)<a[^>]*href="/book\?id=([^"]+)"[^>]*>(.*?)</a>'), F.lit(1))
    titles = F.regexp_extract_all(pages, F.lit(r'(?is)<a[^>]*href="/book\?id=([^"]+)"[^>]*>(.*?)</a>'), F.lit(2))
    return F.zip_with(hrefs, titles, lambda h, t: F.struct(h.alias("file"), F.regexp_replace(h, r"\.[^.]*$", "").alias("id"), F.when(h.contains("."), F.regexp_extract(h, r"\.([^.]*)$", 1)).otherwise("unknown").alias("format"), unescaped(F.trim(F.regexp_replace(t, r"<[^>]+>", ""))).alias("title")))


def unescaped(c: Column) -> Column:
    for name, char in ENTITIES[1:] + ENTITIES[:1]:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def library_pages(pages: DataFrame) -> DataFrame:
    """(id, format, title, tags): the books of tag pages (tag, html), each once with all its tags, in order of its title."""
    b = pages.select("tag", F.explode(book_anchors(F.col("html"))).alias("b")).select("tag", "b.*")
    g = b.groupBy("id").agg(F.min(F.struct("format", "title")).alias("f"), F.array_sort(F.collect_set("tag")).alias("tags"))
    return g.select("id", "f.format", "f.title", "tags").orderBy(F.lower("title"), "id")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """A CSV file with a header; a missing required column or a value of the wrong type is an error."""
    header = [c.strip() for c in spark.read.text(path).first().value.split(",")]
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    types = {f.name: f.dataType for f in schema}
    return spark.read.schema(T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])).option("header", "true").option("mode", "FAILFAST").csv(path)


def parse_log(lines: DataFrame) -> DataFrame:
    """(log, k, number, of, book, author, resumed, done, total, chunks, topics, seconds, rate, eta_minutes, status): what
    extraction logs (n, value and, of several, log) say of each book, in its order.

    A line belongs to the last 'Indexing:' before it, and a wrapped one, which begins with blanks, to the line before;
    n orders the lines of a log, and a log is one stream.  A book's number is that of the line before its start.
    """
    l = lines if "log" in lines.columns else lines.withColumn("log", F.lit(""))
    s = F.regexp_replace("value", r"^\d{2}:\d{2}:\d{2}\s*", "")
    w = Window.partitionBy("log").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    l = l.select("log", "n", s.alias("s")).withColumn("line", F.sum(F.when(F.col("s").startswith("  "), 0).otherwise(1)).over(upto))
    l = l.groupBy("log", "line").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: F.trim(x["s"])), " ").alias("s"))
    started = F.regexp_like("s", F.lit(r"^Indexing: .+"))
    place = lambda i: F.when(F.regexp_like("s", F.lit(r"^\((\d+)/(\d+)\)")), F.regexp_extract("s", r"^\((\d+)/(\d+)\)", i).cast("long"))
    l = l.withColumns({"k": F.sum(F.when(started, 1).otherwise(0)).over(upto), "number": F.last(place(1), True).over(upto), "of": F.last(place(2), True).over(upto)}).where("k > 0")
    one = lambda p, i=1: F.max(F.when(F.regexp_like("s", F.lit(p)), F.regexp_extract("s", p, i)))
    last = lambda p, i=1: F.max_by(F.when(F.regexp_like("s", F.lit(p)), F.regexp_extract("s", p, i)), F.when(F.regexp_like("s", F.lit(p)), F.col("n")))
    progress, finished = r"Processing chunks: (\d+)/(\d+) \((\d+)%\)", r"Book done: ([\d.]+)s \((\d+) chunks, ([\d.]+)s/chunk\)"
    g = l.groupBy("log", "k").agg(
        F.max_by("number", F.when(started, F.col("n"))).alias("number"), F.max_by("of", F.when(started, F.col("n"))).alias("of"),
        one(r"^Indexing: (.+)").alias("book"), one(r"^Author: (.+)").alias("author"), one(r"^Resuming: (\d+)/(\d+) chunks already done").cast("long").alias("resumed"),
        last(progress).cast("long").alias("done"), last(progress, 2).cast("long").alias("total"),
        F.coalesce(one(r"Created (\d+) chunks"), one(finished, 2)).cast("long").alias("chunks"), one(r"Extracted (\d+) (?:unique )?topics").cast("long").alias("topics"),
        one(r"Book done: ([\d.]+)s").cast("double").alias("seconds"), one(finished, 3).cast("double").alias("rate"), last(r"ETA: (\d+)m").cast("long").alias("eta_minutes"),
        F.max(F.regexp_like("s", F.lit("^Skipping:"))).alias("skipped"), F.max(F.regexp_like("s", F.lit("^Error "))).alias("failed"), F.max(F.regexp_like("s", F.lit("^Book done"))).alias("ended"),
    )
    status = F.when(F.col("failed"), "error").when(F.col("skipped"), "skipped").when(F.col("ended"), "done").otherwise("open")
    return g.withColumn("status", status).drop("failed", "skipped", "ended")


def log_totals(lines: DataFrame) -> DataFrame:
    """One row for each log: its books by status, and what its last cumulative line or else its books add up to."""
    l = lines if "log" in lines.columns else lines.withColumn("log", F.lit(""))
    p = r"Total: (\d+)/(\d+) books,\s+([\d,]+)\s+chunks,\s+([\d.]+)s/chunk avg"
    part = lambda i: F.max_by(F.regexp_replace(F.regexp_extract("value", p, i), ",", ""), "n")
    total = l.where(F.regexp_like("value", F.lit(p))).groupBy("log").agg(part(1).cast("long").alias("t_books"), part(3).cast("long").alias("t_chunks"), part(4).cast("double").alias("t_rate"))
    b = parse_log(lines).groupBy("log").agg(*[F.count_if(F.col("status") == x).alias(n) for x, n in (("done", "completed"), ("skipped", "skipped"), ("error", "failed"), ("open", "open"))], F.count("resumed").alias("resumed"), F.sum(F.when(F.col("status") == "done", F.col("chunks"))).alias("chunks"), F.sum(F.when(F.col("status") == "done", F.col("topics"))).alias("topics"), F.sum("seconds").alias("seconds"))
    return b.join(total, "log", "left").select("log", F.coalesce("t_books", "completed").alias("completed"), "skipped", "failed", "open", "resumed", F.coalesce("t_chunks", "chunks").alias("chunks"), "topics", "seconds", F.coalesce("t_rate", F.col("seconds") / F.nullif("chunks", F.lit(0))).alias("rate"))


def elapsed(first: Column, last: Column) -> Column:
    """Seconds between two clock times 'HH:mm:ss', across midnight."""
    d = F.unix_timestamp(last, "HH:mm:ss") - F.unix_timestamp(first, "HH:mm:ss")
    return F.when(d < 0, d + 86400).otherwise(d)
