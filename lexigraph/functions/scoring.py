"""Scores and weights as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigraph.functions.text import TOPIC_STOPLIST, strip, word_count


def pmi(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Pointwise mutual information, natural log; 0 where a count is 0."""
    b, x, y, t = (c.cast("double") for c in (both, first, second, n))
    return F.when((b > 0) & (x > 0) & (y > 0) & (t > 0), F.log(b * t / (x * y))).otherwise(0.0)


def cooccurrence_weight(count: Column, pmi_: Column, book_count: Column | None = None) -> Column:
    """PMI, or the log of the count where it is null or 0; raised by common books; 0.1 at least."""
    base = F.when(pmi_.isNotNull() & (pmi_ != 0), pmi_).otherwise(F.log(count.cast("double") + 1))
    return F.greatest(base * (1 + F.log(1 + F.coalesce(book_count, F.lit(0)).cast("double"))) if book_count is not None else base, F.lit(0.1))


def relevance(topic_count: Column, book_total: Column, cluster_topics: Column, all_topics: Column) -> Column:
    """How much a book is about a cluster: saturated concentration times 1 + positive PMI; 0 under three topics."""
    tc, tb, tcl, c = (x.cast("double") for x in (topic_count, book_total, cluster_topics, all_topics))
    conc, expected = tc / tb, tb * tcl / c
    return F.when(topic_count < 3, 0.0).otherwise(conc * 2.5 / (conc + 1.5) * (1 + F.when(expected > 0, F.greatest(F.log2(tc / expected), F.lit(0.0))).otherwise(0.0)))


def log_grid(low: float, high: float, n: int) -> list[float]:
    """n resolutions spaced evenly in the logarithm."""
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)] if n > 1 else [low]


def hsl_hex(hue: Column, saturation: float = 0.7, lightness: float = 0.6) -> Column:
    """'#rrggbb' of a hue in degrees."""
    amplitude = saturation * min(lightness, 1 - lightness)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue / 30, F.lit(12.0))
        v = F.lit(lightness) - amplitude * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(255 * v + 1e-9).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def sphere_scale(books: Column, most: Column) -> Column:
    return 0.2 + 0.8 * F.sqrt(books / F.nullif(most, F.lit(0)))


def rescaled(similarity: Column) -> Column:
    """Cosines from 0.5 to 1 stretched over 0 to 1; less is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - 0.5) / 0.5))


# The parts of topic_quality and the number of topics wanted.
SEMANTIC, WORD_COUNT, STOPLIST, LENGTH, COUNT, WANTED = 0.40, 0.25, 0.15, 0.10, 0.10, 5


def topic_quality(topics: Column, semantic: Column) -> Column:
    """How good a list of topics is, 0 to 1: its F1 of best cosines with the right ones (``semantic``), topics of two to
    five words, none of the stop list, none longer than six words, five of them.  0 without a topic."""
    t = F.filter(F.transform(topics, lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != ""))
    n = F.size(t)
    mean = lambda f: F.aggregate(t, F.lit(0.0), lambda a, x: a + f(x)) / n
    words = mean(lambda x: F.when(word_count(x).between(2, 5), 1.0).when(word_count(x) == 6, 0.5).otherwise(0.0))
    stop, long = mean(lambda x: F.when(x.isin(TOPIC_STOPLIST), 0.0).otherwise(1.0)), mean(lambda x: F.when(word_count(x) > 6, 0.0).otherwise(1.0))
    count = F.greatest(F.lit(0.0), 1 - F.abs(n - WANTED) * 0.2)
    return F.when(n > 0, SEMANTIC * semantic + WORD_COUNT * words + STOPLIST * stop + LENGTH * long + COUNT * count).otherwise(0.0)
