"""Text functions as Columns, so that they stay inside generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single words that are no topics.
TOPIC_STOPLIST = [
    "manipulation", "relationships", "technology", "society", "nature", "life", "death", "love", "power", "time",
    "people", "world", "change", "future", "communication", "conflict", "loss", "survival", "identity", "freedom",
    "control", "trust", "fear", "growth", "knowledge", "science", "culture", "politics", "art", "history", "topics",
]
# Entities and their characters, in the order of their replacement.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&nbsp;", " "), (" ", " ")]
# Elements that are paragraphs of their own.
BLOCK_TAGS = [
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "tr", "table", "section", "article",
    "aside", "figcaption", "figure", "main", "details", "summary", "dd", "dt",
]
# Words whose full stop ends no sentence.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "inc", "ltd", "co", "corp", "dept", "gen",
    "gov", "sgt", "cpl", "pvt", "capt", "col", "maj", "rev", "hon", "pres", "approx", "vol", "no", "fig", "ed",
    "trans", "repr",
]
# Tags that say nothing, what they stand before and behind in others, and how a key of the answer's
# format shows in a topic.
NOISE_TAGS = ["general", "fiction", "unknown", "adult", "non-fiction", "nonfiction"]
TAG_PREFIX, TAG_SUFFIX = r"(?i)^(?:fiction|general|non-fiction)\s*[-–/]\s*", r"(?i)\s*[-–/]\s*(?:general|fiction)$"
LEAKED_KEY = r"""['"]\s*,\s*['"](?:reason|details|passage[_ ]?(?:context|quote|relevance)|text[_ ]content|relevance)"""


def chain(c: Column, steps: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def html_to_text(c: Column) -> Column:
    """Text of an HTML fragment: block elements are paragraphs, <br> a line; footnote marks and tags are gone."""
    c = chain(c, [(r"(?i)<br\s*/?>", "\n"), (r"(?i)<hr\s*/?>", "\n\n"), (rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n\n"), (r"<[^>]+>", " ")])
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return chain(c, [(r"\[\d+\]", ""), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"(?md)^[ \t\r]+|[ \t\r]+$", ""), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")])


def clean_markdown(c: Column) -> Column:
    return chain(c, [(r"\n{3,}", "\n\n"), (r"!\[.*?\]\(.*?\)", ""), (r"(?m)^#{1,6}\s+", ""), (r"\A\s+|\s+\z", "")])


def strip_html(c: Column) -> Column:
    return chain(c, [(r"<[^>]+>", " "), ("&nbsp;", " "), (r"\s+", " "), (r"\A\s+|\s+\z", "")])


def remove_tags(c: Column) -> Column:
    return chain(c, [(r"<[^<]+?>", ""), (r"\A\s+|\s+\z", "")])


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\n+"), strip), lambda p: p != "")


def word_count(c: Column) -> Column:
    """Words between white space of any kind; null counts none."""
    return F.when(c.isNull(), 0).otherwise(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")))


def word_chunks(c: Column, target: int) -> Column:
    """A text cut every ``target`` words."""
    w = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / target).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * target + 1, F.lit(target)), " "))).otherwise(F.array().cast("array<string>"))


def false_sentence_break(before: Column, after: Column) -> Column:
    """Whether a text split after ``before`` goes on: an initial, an abbreviation, a number, or lower case."""
    last = F.regexp_extract(before, r"(\S+)\s*$", 1)
    word = F.lower(F.regexp_replace(last, r"[.!?]+$", ""))
    lower = F.regexp_like(after, F.lit(r"^\p{Ll}"))
    found = F.regexp_like(word, F.lit(r"^\p{L}$")) | F.regexp_like(word, F.lit(r"^[a-z](\.[a-z])+$")) | word.isin(ABBREVIATIONS) | lower
    return F.when((F.coalesce(before, F.lit("")) == "") | (F.coalesce(after, F.lit("")) == "") | (last == ""), False).otherwise(found)


def normalize_topic(c: Column) -> Column:
    """A topic in its comparable form; null for what is no topic: too short or long, generic, a time stamp, markup."""
    s = chain(F.lower(strip(c)), [("_", " "), (" {2,}", " ")])
    cut = F.regexp_extract(s, rf"(?s)^(.*?){LEAKED_KEY}", 1)
    leaked = F.regexp_like(s, F.lit(LEAKED_KEY))
    out = F.when(leaked, strip(F.regexp_replace(strip(cut), r"""^['"]+|['"]+$""", ""))).otherwise(s)
    bad = (F.length(s) < 3) | s.isin(TOPIC_STOPLIST) | (F.length(out) < 3) | F.regexp_like(out, F.lit(r"^\d{4}-\d{2}-\d{2}[t ]")) | F.regexp_like(out, F.lit(r"</?[a-z]|</div|</body|&amp;|&lt;|&gt;|/>")) | F.regexp_like(out, F.lit(r"[{}\[\]]")) | (F.length(out) > 100)
    return F.when(~bad, out)


def filter_topics(topics: Column) -> Column:
    return F.filter(F.transform(topics, normalize_topic), lambda t: t.isNotNull())


def unwrap_topic(c: Column) -> Column:
    """The value of a topic given as a dict in a string."""
    return F.when(F.regexp_like(c, F.lit(r"(?s)^\{.*\}$")) & F.regexp_like(c, F.lit(r""":\s*['"](.+)['"]\s*\}$""")), F.regexp_extract(c, r""":\s*['"](.+)['"]\s*\}$""", 1)).otherwise(c)


def json_in_text(c: Column) -> Column:
    """The first reading that is JSON: the whole text, a fenced block, the outermost braces; else null."""
    fenced, braces = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when((strip(x) != "") & F.try_parse_json(x).isNotNull(), strip(x))
    return F.coalesce(ok(c), ok(fenced), ok(braces))


def parse_topics(c: Column, most: int = 5) -> Column:
    """Topics in free text: a JSON array, else what is in quotes, else what is between commas."""
    s = strip(c)
    arr = F.from_json(F.regexp_extract(s, r"(?s)(\[.*?\])", 1), "array<string>")
    listed = F.filter(F.transform(arr, strip), lambda x: x.isNotNull() & (x != ""))
    quoted = F.regexp_extract_all(s, F.lit('"([^"]+)"'), F.lit(1))
    parts = F.filter(F.transform(F.split(s, ","), lambda p: F.regexp_replace(strip(p), r"""^["']+|["']+$""", "")), lambda p: (p != "") & (F.length(p) < 50))
    return F.when(arr.isNotNull(), listed).when(F.size(quoted) > 0, F.slice(quoted, 1, most)).when(s.contains(","), F.slice(parts, 1, most)).otherwise(F.array().cast("array<string>"))


def clean_tags(tags: Column, most: int = 10) -> Column:
    """Tags without noise and noise affixes, each once whatever its case, none that is part of a longer one."""
    t = F.filter(tags, lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin(NOISE_TAGS))
    t = F.transform(t, lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, TAG_PREFIX, "")), TAG_SUFFIX, "")))
    t = F.filter(t, lambda x: (x != "") & ~F.lower(x).isin(NOISE_TAGS))
    once = F.filter(t, lambda x, i: ~F.exists(F.slice(t, 1, i), lambda y: F.lower(y) == F.lower(x)))
    placed = F.array_sort(F.transform(once, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("t"))))
    kept = F.filter(placed, lambda x, i: ~F.exists(F.slice(placed, 1, i), lambda y: F.lower(y["t"]).contains(F.lower(x["t"]))))
    return F.slice(F.transform(kept, lambda x: x["t"]), 1, most)


def matching_form(c: Column) -> Column:
    return F.trim(chain(F.lower(c), [(r"[^\p{L}\p{N}_\s]", ""), (r"\s+", " ")]))


def authors_match(a: Column, b: Column) -> Column:
    """Half of the words of the shorter name at least are in the other; an empty name matches nothing."""
    x, y = (F.array_distinct(F.filter(F.split(matching_form(c), " "), lambda w: w != "")) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.coalesce((least > 0) & (F.size(F.array_intersect(x, y)) * 2 >= least), F.lit(False))


def clean_title(c: Column) -> Column:
    return F.trim(chain(c, [(r"\s*\([A-Z][^)]+\)\s*$", ""), (r"_+\d*$", ""), (r"^_+", "")]))


def clean_author(c: Column) -> Column:
    """'Last| First' the other way round, a trailing number gone; an unknown author is null."""
    s = F.regexp_replace(F.trim(c), r"_\d+$", "")
    turned = F.concat_ws(" ", F.trim(F.split_part(s, F.lit("|"), F.lit(2))), F.trim(F.split_part(s, F.lit("|"), F.lit(1))))
    return F.when(s.isin("", "Unknown", "[Unknown Author]"), None).when(F.size(F.split(s, r"\|")) == 2, turned).otherwise(s)


def _decomposed() -> tuple[str, str]:
    """Letters of Latin blocks that decompose to one ASCII letter, and those letters, by the rule of Unicode (NFKD)."""
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128)) for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)])]
    pairs = [(c, a) for c, a in pairs if len(a) == 1 and a.isalnum()]
    return "".join(c for c, _ in pairs), "".join(a for _, a in pairs)


PLAIN_FROM, PLAIN_TO = _decomposed()


def slug(c: Column) -> Column:
    """Lower case a-z and digits joined by '_'; Latin letters lose their accents, other characters go."""
    plain = F.lower(F.translate(c, PLAIN_FROM, PLAIN_TO))
    return chain(plain, [(r"[^\x00-\x7f]", ""), (r"[^a-z0-9]+", "_"), ("^_+|_+$", "")])


def short_title(c: Column) -> Column:
    """A title up to a colon, semicolon or opening bracket."""
    return F.trim(F.regexp_extract(c, r"(?s)^([^:;(]*)", 1))


def last_name(author: Column) -> Column:
    """What stands before the comma of 'Last, First', else the last word."""
    return F.when(author.contains(","), F.trim(F.split_part(author, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(author, r"(\S+)\s*$", 1))


def file_name(number: Column, author: Column, title: Column) -> Column:
    return F.concat_ws("_", number.cast("string"), slug(last_name(author)), F.concat(slug(short_title(title)), F.lit(".epub")))


def last_number(c: Column) -> Column:
    """The last whole number in a program's output, null without any."""
    n = F.regexp_extract_all(c, F.lit(r"\b(\d+)\b"), F.lit(1))
    return F.when(F.size(n) > 0, F.element_at(n, -1).cast("long"))


def first_spellings(topics: Column) -> Column:
    """Topics in lower case without blanks around them, each once, in order of their first mention; blank ones go."""
    return F.array_distinct(F.filter(F.transform(topics, lambda t: F.lower(strip(t))), lambda t: t.isNotNull() & (t != "")))


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    """'[####----] 50%'; empty without a total."""
    part = F.when(total > 0, F.least(F.lit(1.0), done / total))
    n = F.floor(part * width).cast("int")
    bar = F.format_string("[%s] %d%%", F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n)), F.floor(part * 100))
    return F.when(part.isNotNull(), bar).otherwise("")


def time_left(done: Column, total: Column, seconds: Column) -> Column:
    """How long the rest takes at the rate so far; null before anything is done."""
    return F.when(done > 0, duration((total - done) * seconds / done))


def key_values(c: Column) -> Column:
    """map<string,string> of 'key: value' lines, keys in lower case; lines that begin with a blank don't count."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.startswith(" ") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def source_url(c: Column) -> Column:
    return F.when(c.startswith("gutenberg:"), F.concat(F.lit("https://www.gutenberg.org/ebooks/"), F.split_part(c, F.lit(":"), F.lit(2))))


def cluster_label(labels: Column, n: int = 3) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(F.slice(labels, 1, n), " / ")).otherwise("Miscellaneous")


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
