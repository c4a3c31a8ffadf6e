"""Where the engine meets models: extractors of topics, embedders of labels, labellers of clusters.

Each is a Python callable on a batch, run in Arrow kernels; the offline defaults are deterministic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Extractor = Callable[[list[str]], list[list[str]]]
Embedder = Callable[[list[str]], np.ndarray]
DIM = 384

# Words that no key phrase begins or ends with.
FUNCTION_WORDS = frozenset("a an and are as at be but by for from had has have he her his if in into is it its not of on or that the their then there they this to was were which while who with".split())


def key_phrases(texts: list[str], n: int = 5) -> list[list[str]]:
    """The most frequent runs of up to three words between function words and punctuation, longer ones first."""
    out = []
    for t in texts:
        count: Counter = Counter()
        for part in re.split(r"[.,;:!?()\[\]\"\n]+", (t or "").lower()):
            run: list[str] = []
            for w in [*re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", part), ""]:
                if w and w not in FUNCTION_WORDS:
                    run.append(w)
                else:
                    if run:
                        count[" ".join(run[:3])] += 1
                    run = []
        out.append([p for p, _ in sorted(count.items(), key=lambda x: (-x[1], -len(x[0].split()), x[0]))[:n]])
    return out


def extract_topics(chunks: DataFrame, extractor: Extractor = key_phrases, batch: int = 32, tries: int = 2) -> DataFrame:
    """(chunk_id, topics, status) of ``chunks`` (id, text): in batches, and chunk by chunk where a batch fails."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), batch):
                part, got, status = texts[lo : lo + batch], None, "ok"
                for _ in range(tries):
                    try:
                        got = extractor(part)
                        if len(got) == len(part):
                            break
                        got = None
                    except Exception:  # noqa: BLE001
                        got = None
                states = ["ok"] * len(part)
                if got is None:
                    got = []
                    for i, t in enumerate(part):
                        try:
                            got.append(extractor([t])[0])
                        except Exception as e:  # noqa: BLE001
                            got.append([])
                            states[i] = f"error: {type(e).__name__}"
                yield pa.record_batch({"chunk_id": pa.array(ids[lo : lo + batch], pa.int64()), "topics": pa.array(got, pa.list_(pa.string())), "status": pa.array(states)})

    return chunks.select("id", "text").mapInArrow(kernel, "chunk_id long, topics array<string>, status string")


def hashed_grams(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors of hashed words and character trigrams; an empty text is a zero vector."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            p = f"<{w}>"
            for g, weight in [(w, 2.0), *((p[j : j + 3], 1.0) for j in range(len(p) - 2))]:
                h = zlib.crc32(g.encode())
                out[i, h % dim] += weight if h >> 31 else -weight
    return (out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))).astype("f4")


def embed(labels: DataFrame, embedder: Embedder = hashed_grams) -> DataFrame:
    """(id, embedding) of ``labels`` (id, label)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": list(embedder(b["label"].tolist()))})

    return labels.select("id", "label").mapInPandas(kernel, "id long, embedding array<float>")


def label_clusters(summaries: DataFrame, labeller: Callable[[list[str]], str] = lambda topics: topics[0] if topics else "Miscellaneous") -> DataFrame:
    """(cluster_id, label) of ``summaries`` (cluster_id, topics array<string>)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cluster_id": b["cluster_id"], "label": [labeller(list(t)) for t in b["topics"]]})

    return summaries.select("cluster_id", "topics").mapInPandas(kernel, "cluster_id long, label string")


def batch_schema(chunks: int, topics: int = 5) -> T.StructType:
    """The answer that a model gives for several chunks at once: chunk_1 to chunk_n, each a list of topics."""
    return T.StructType([T.StructField(f"chunk_{i}", T.ArrayType(T.StringType()), False, {"items": topics}) for i in range(1, chunks + 1)])


def endpoint(model: str, routes: dict[str, str], default: str) -> str:
    """The address that serves a model: of the routes whose prefix its name has, the longest."""
    return routes[max((p for p in routes if model.startswith(p)), key=len)] if any(model.startswith(p) for p in routes) else default


def embedder_info(embedder: Embedder = hashed_grams) -> dict:
    """Name and dimension of an embedder, found by a call."""
    return {"name": getattr(embedder, "__name__", type(embedder).__name__), "dimension": int(embedder(["a"]).shape[1])}


def book_themes(books: DataFrame, extractor: Extractor = key_phrases) -> DataFrame:
    """(id, themes as a JSON list) of ``books`` (id, title, text): what the extractor says of a book's title and text."""
    t = books.select("id", F.concat_ws("\n", "title", "text").alias("text"))
    return extract_topics(t, extractor).select(F.col("chunk_id").alias("id"), F.to_json("topics").alias("themes"))


def consolidated(topics: DataFrame, merger: Callable[[list[str]], dict[str, list[str]]] = lambda ts: {t: [t] for t in ts}) -> DataFrame:
    """(id, label, originals): the topics of each book (id, topics array<string>) under the labels that a merger gives
    them; labels and originals in lower case, blank ones left out, a failing merger gives none."""
    from lexigraph.functions.text import first_spellings

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, topics in zip(b["id"], b["topics"]):
                try:
                    found = merger(list(topics)) if len(topics) else {}
                except Exception:  # noqa: BLE001
                    found = {}
                for label, originals in found.items():
                    kept = [str(o).strip().lower() for o in originals if o]
                    if label.strip() and kept:
                        rows.append((i, label.strip().lower(), kept))
            yield pd.DataFrame(rows, columns=["id", "label", "originals"])

    return topics.select("id", first_spellings(F.col("topics")).alias("topics")).mapInPandas(kernel, "id long, label string, originals array<string>")


def labelled_queue(summaries: DataFrame, labels: DataFrame, least: int = 5, labeller: Callable[[list[str]], str] | None = None) -> DataFrame:
    """``labels`` (cluster_id, label) with one for every cluster of ``summaries`` (cluster_id, size, topics) of at least
    that size that has none."""
    from lexigraph.operators.tables import last_wins

    todo = summaries.where(F.col("size") >= least).join(labels.select("cluster_id"), "cluster_id", "left_anti")
    return last_wins(labels, label_clusters(todo, labeller) if labeller else label_clusters(todo), ["cluster_id"])
