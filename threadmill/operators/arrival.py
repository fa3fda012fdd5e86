"""The order in which rows count as arrived.

Source and surrogate id order rows as far as they go.  Rows of this package's
own ingestion have no id, and ids of different files can be equal; the rest of
a row, hashed, settles these ties, so that no answer depends on how rows are laid
out.  Rows equal in everything are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.schema import MESSAGES

ARRIVAL = ("source_order", "id")


def tie(columns: Iterable[str]) -> Column:
    """A hash of the message columns among `columns`."""
    have = set(columns)
    return F.xxhash64(*[c for c in MESSAGES.names if c in have and c != "id"])


def arrival(rows: DataFrame) -> Column:
    """A total order that is never NULL; a missing id comes first."""
    return F.struct(*(c for c in ARRIVAL if c in rows.columns), tie(rows.columns))
