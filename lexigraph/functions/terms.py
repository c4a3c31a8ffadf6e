"""Words, fields and written forms of short labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}"
FIELD_SEPARATORS = "[/;|,]"


def term_fields(label: Column) -> Column:
    """array<string>: the fields of a label in the order written, each as its words joined by one space.

    Words are runs of letters and digits in lower case; an apostrophe inside a word is dropped.  Fields without a word
    do not count.  Null gives null, a label without a word an empty array.
    """
    flat = F.regexp_replace(F.lower(label), f"(?<=[{WORD}])['’](?=[{WORD}])", "")
    fields = F.split(F.regexp_replace(flat, f"[^{WORD}/;|,]+", " "), FIELD_SEPARATORS)
    return F.filter(F.transform(fields, lambda f: F.trim(f)), lambda f: f != "")


def written_form(fields: Column) -> Column:
    """The fields in ascending order joined by ' / '; null where there is none."""
    return F.when(F.size(fields) > 0, F.array_join(F.array_sort(fields), " / "))
