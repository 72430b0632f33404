"""String helpers shared by the text operators (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of the model-text grammar (those of
# Python's str.splitlines), the arrow and the label pattern.
LINE_BREAKS = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"
ARROW = "-->"
LABEL_RE = "\\((.*?)\\)"
TRAILING_DIGITS_RE = "(?U)(\\d+)$"


def strip(c: Column) -> Column:
    """Remove leading and trailing (Unicode) whitespace."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def nonempty(c: Column) -> Column:
    """NULL for NULL or empty strings (a falsy label is no label)."""
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(c)


def first_label(tok: Column) -> Column:
    """Text of the first ``( ... )`` group (lazy), NULL if none or empty."""
    return nonempty(F.regexp_extract(tok, LABEL_RE, 1))
