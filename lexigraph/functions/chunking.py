"""Chunks of about so many words along paragraphs, then sentences, then words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigraph.functions.text import ABBREVIATIONS

TARGET_WORDS, LEAST_WORDS = 500, 100
BATCH_WORDS = 500_000
_SHORT = frozenset(ABBREVIATIONS)


def goes_on(before: str, after: str) -> bool:
    """Whether the sentence goes on between the two parts of a text split after '.', '!' or '?'."""
    tokens = before.split()
    if not tokens or not after:
        return False
    word = tokens[-1].rstrip(".!?").lower()
    return after[0].islower() or len(word) == 1 and word.isalpha() or word in _SHORT or bool(re.fullmatch(r"[a-z](\.[a-z])+", word))


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for part in re.split(r"(?<=[.!?])\s+", text):
        if out and goes_on(out[-1], part):
            out[-1] += " " + part
        else:
            out.append(part)
    return [s.strip() for s in out if s.strip()]


def pack(pieces: list[tuple[str, int]], target: int, joint: str) -> Iterator[str]:
    """Pieces joined as long as they hold at most ``target`` words; a longer piece is one by itself."""
    held, n = [], 0
    for piece, words in pieces:
        if held and n + words > target:
            yield joint.join(held)
            held, n = [], 0
        held.append(piece)
        n += words
    if held:
        yield joint.join(held)


def sentence_chunks(text: str, target: int) -> Iterator[str]:
    run: list[tuple[str, int]] = []
    for s in sentences(text):
        words = s.split()
        if len(words) > target:
            yield from pack(run, target, " ")
            run = []
            yield from (" ".join(words[i : i + target]) for i in range(0, len(words), target))
        else:
            run.append((s, len(words)))
    yield from pack(run, target, " ")


def chunk_text(text: str | None, target: int = TARGET_WORDS, least: int = LEAST_WORDS) -> list[str]:
    """The chunks of a text.  Paragraphs stay whole where they fit, longer ones are cut by themselves; chunks of fewer
    than ``least`` words are dropped.  Null and empty texts have none."""
    out: list[str] = []
    run: list[tuple[str, int]] = []
    for p in re.split(r"\n\n+", text or ""):
        n = len(p.split())
        if n > target:
            out += pack(run, target, "\n\n")
            run = []
            out += sentence_chunks(p.strip(), target)
        elif n:
            run.append((p.strip(), n))
    out += pack(run, target, "\n\n")
    return [c for c in out if len(c.split()) >= least]


def batch_of(rows: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
    i, n, c, k = zip(*rows)
    return pa.record_batch({"id": pa.array(i, pa.int64()), "chunk_index": pa.array(n, pa.int64()), "text": pa.array(c, pa.string()), "word_count": pa.array(k, pa.int64())})


def chunked(docs: DataFrame, id_col: str, text_col: str, target: int = TARGET_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """(id, chunk_index, text, word_count) of every document's chunks; each text is one record of its task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, words = [], 0  # of many short texts, or of one long one
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                for n, c in enumerate(chunk_text(text.as_py(), target, least)):
                    k = len(c.split())
                    rows.append((i, n, c, k))
                    words += k
                if words > BATCH_WORDS:
                    yield batch_of(rows)
                    rows, words = [], 0
            if rows:
                yield batch_of(rows)

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text").mapInArrow(kernel, "id long, chunk_index long, text string, word_count long")
