"""Normal forms of key columns, as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks at either end: ASCII white space, no-break, figure, thin and ideographic space, marks without width.
_OUTER = "^[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+|[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER, "")


def id_key(c: Column) -> Column:
    """Ignores case and outer blanks; blank becomes null."""
    s = F.lower(stripped(c))
    return F.when(s != "", s)


def code_key(c: Column) -> Column:
    """Like id_key, and '-' counts as '_'."""
    return F.translate(id_key(c), "-", "_")
