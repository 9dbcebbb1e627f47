"""The public word-and-punctuation tokenizer: sizes on the JVM side, positions in Python."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, decimal digits and underscores, or a run of other characters but white space.
PATTERN = r"[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]+"
COMPILED = regex.compile(PATTERN)


def token_count(text: Column) -> Column:
    """Tokens of the whole text as int; null and blank texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit("(?U)" + PATTERN)), F.lit(0))
