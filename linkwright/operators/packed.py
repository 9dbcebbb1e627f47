"""Several values packed in one field: one row per value, with its position.

Quoted spans are set aside behind numbered placeholders, so that a separator inside quotes
does not split; the rest is split at any run of separators; the spans come back through an array
lookup; the values are exploded with positions. Everything is a JVM expression: one narrow
stage, no shuffle besides the removal of repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators between values; brackets around a list count as separators too.
SEPARATORS = r"\s,;|/&+，；、\[\]{}()"
QUOTED = r"\"[^\"]*\"|'[^']*'"
# Placeholder = OPEN index SHUT. If a field holds one of these private-use characters itself, it
# is escaped first, so that no text can be taken for a placeholder.
OPEN, SHUT, ESCAPE = "\ue000", "\ue001", "\ue002"


def _escaped(c: Column) -> Column:
    for i, mark in enumerate((ESCAPE, OPEN, SHUT)):
        c = F.replace(c, F.lit(mark), F.lit(f"{ESCAPE}{i}"))
    return c


def _unescaped(c: Column) -> Column:
    for i, mark in reversed(list(enumerate((ESCAPE, OPEN, SHUT)))):
        c = F.replace(c, F.lit(f"{ESCAPE}{i}"), F.lit(mark))
    return c


def packed_values(field: Column, value_start: str) -> Column:
    """array<string>: the values of a packed `field`, in order.

    value_start: regular expression for how a value begins. Pieces that begin otherwise (`none`,
    `NA`, `-`, blanks) are no values. A quoted span is one value, separators included, unless a
    separator in it is followed by another value's beginning: then the quotes enclose a list.
    A null field has an empty array.
    """
    text = _escaped(F.coalesce(field, F.lit("")))
    spans = F.regexp_extract_all(text, F.lit(f"({QUOTED})"), F.lit(1))
    outside = F.split(text, QUOTED, -1)
    marked = F.array_join(
        F.transform(outside, lambda part, i: F.when(i < F.size(spans), F.concat(part, F.lit(OPEN), i.cast("string"), F.lit(SHUT))).otherwise(part)), ""
    )
    pieces = F.split(marked, f"[{SEPARATORS}]+", -1)
    inner_list = rf"[{SEPARATORS}]\s*{value_start}"

    def restored(piece: Column) -> Column:
        # A placeholder's text comes back where the placeholder stands, so that the order of values is kept.
        at = F.split(piece, f"(?={OPEN})|(?<={SHUT})", -1)
        number = lambda x: F.regexp_extract(x, f"^{OPEN}(\\d+){SHUT}$", 1)
        span = lambda x: F.regexp_replace(F.get(spans, number(x).cast("int")), r"^[\"']|[\"']$", "")
        inside = lambda t: F.when(t.rlike(inner_list), F.split(t, rf"[{SEPARATORS}]+(?={value_start})", -1)).otherwise(F.array(t))
        plain = lambda x: F.array(F.regexp_replace(x, r"^[\"'.]+|[\"'.]+$", ""))
        return F.flatten(F.transform(at, lambda x: F.when(x.startswith(OPEN), inside(span(x))).otherwise(plain(x))))

    values = F.transform(F.flatten(F.transform(pieces, restored)), lambda v: F.regexp_replace(_unescaped(v), r"^\s+|[\s,;|/&+，]+$", ""))
    return F.filter(values, lambda v: v.rlike(f"^{value_start}"))


def unpack(df: DataFrame, keep: list[str], field: str, value_start: str, *, position: str = "value_pos", value: str = "value") -> DataFrame:
    """One row (`keep`..., position, value) per value in `field`; positions count values from 1.

    Rows without a value give none. A value named twice keeps both positions. The same row
    delivered again gives no second result row. Other columns of `df` are not touched, whatever
    their names.
    """
    packed = df.select(*keep, packed_values(df[field], value_start).alias("__values"))
    out = packed.select(*keep, F.posexplode("__values").alias(position, value))
    return out.withColumn(position, (F.col(position) + 1).cast("int")).distinct()
