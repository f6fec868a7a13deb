"""Link sequences written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_link_sequence(seq: Column) -> Column:
    """Link numbers of a delimited sequence, as array<long>.

    ``;`` parts where there is one, else ``,``; parts are trimmed and empty ones
    dropped; a number with a fraction is cut to its whole part; null stays null.
    """
    text = seq.cast("string")
    parts = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, ","))
    filled = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(filled, lambda x: x.cast("double").cast("long"))
