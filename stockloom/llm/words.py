"""Words of a text as the contracts define them: runs of anything but the six ASCII white-space characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
SPACE_RUN = rf"[{SPACES}]+"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def word_list(column: str) -> Column:
    """The words in order; an empty array for null. Only the ends of a split can be empty."""
    return F.array_remove(F.split(text_or_empty(column), SPACE_RUN), "")


def length_of_class(text: Column, members: str) -> Column:
    """Code points of ``text`` that lie in the regex class ``members``."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", "")).cast("long")


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``rows`` already has a column of that name."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
