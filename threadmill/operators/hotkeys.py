"""Finding keys that hold too many rows for one task.

A window over a key puts all its rows into one task.  Operators that need one
send the few large keys down a second branch that splits them.  Both branches
are exact, so which one a key takes affects speed only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.sinks.shared import settled

# A key with fewer rows is an ordinary one.
HOT_ROWS = 1_000_000

# Rows of a hot key that are enough to recognise it.
TELLING_ROWS = 1_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """All keys with about `hot_rows` rows or more; None if there are none.

    Counting every row of mostly unique keys would shuffle a good part of the
    table only to find a handful of keys.  So rows are first thinned out by a
    hash of their `identity`, to about TELLING_ROWS rows of a key that is hot.
    The hash depends on the row alone: the answer is the same however often,
    and in whatever order, the plan is evaluated.  It decides which branch a
    key takes, never what comes out.

    Runs at once, over the key and identity columns.  The keys are at most one
    in about `hot_rows` rows, and are written down, so Spark knows their size.
    """
    one_in = max(1, hot_rows // TELLING_ROWS)
    if one_in > 1:
        df = df.where(F.pmod(F.xxhash64(*keys, *identity), F.lit(one_in)) == 0)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = settled(counts.where(F.col("_rows") >= hot_rows // one_in).select(*keys))
    return None if found.isEmpty() else found


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of the keys in `hot`, from :func:`hot_keys`).

    Spark broadcasts the keys if they are few and joins by key if not.  Rows with
    a NULL key part match nothing and stay with the ordinary ones.
    """
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")
