"""Words of whole texts as numbers, by Arrow kernels."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def word_lists(texts: pa.Array, markup: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(hashes, starts, codes, vocabulary) of a column of texts: the 64-bit hash of every word in order, text i having
    the words starts[i]:starts[i + 1]; null and empty texts have none.

    Words are runs of letters and digits in lower case.  With ``markup``, tags and entities don't count and a word
    hyphenated at the end of a line is one word.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if markup:
        if pc.any(pc.match_substring(texts, "&")).as_py():
            texts = pa.array([html.unescape(x) if "&" in x else x for x in texts.to_pylist()], pa.large_string())
        texts = pc.replace_substring_regex(texts, r"<[^<>]*>", " ")
        texts = pc.replace_substring_regex(texts, r"([\p{L}\p{N}])[-\x{00AD}\x{2010}][ \t]*\r?\n[ \t]*([\p{Ll}])", r"\1\2")
    texts = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy().astype("i8")
    starts = starts - starts[0]
    codes = flat.indices.to_numpy(zero_copy_only=False).astype("i8")
    vocabulary = flat.dictionary.to_pylist()
    if "" in vocabulary:
        blank = codes == vocabulary.index("")
        starts = starts - np.r_[0, np.cumsum(blank)][starts]
        codes = codes[~blank]
    hashes = pd.util.hash_array(np.array(vocabulary or [""], dtype=object), categorize=False)
    return hashes[codes], starts, codes, vocabulary


def text_of(starts: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
