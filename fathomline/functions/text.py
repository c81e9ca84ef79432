"""Column expressions on names and short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that may surround a name (blank, tab, no-break space).
OUTER_SPACE = " \t "


def same_value(c: Column | str) -> Column:
    """The form under which two spellings of a name are the same value.

    Surrounding blanks, tabs and no-break spaces go, letters become lower case.
    A null stays null; a value of white space only becomes the empty string.
    """
    column = F.col(c) if isinstance(c, str) else c
    return F.lower(F.btrim(column, F.lit(OUTER_SPACE)))


def present(c: Column) -> Column:
    """``same_value`` with the blank value turned into null."""
    key = same_value(c)
    return F.when(F.length(key) > 0, key)


def sql_same_value(expr: str) -> str:
    """The same normal form in the oracle's dialect."""
    return f"lower(trim({expr}, ' ' || chr(9) || chr(160)))"
