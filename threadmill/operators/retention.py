"""Which stored files have outlived their class.  Removing them is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.times import artifact_time, moment
from threadmill.schema import RETENTION_RULES


def expired(
    artifacts: DataFrame, now: object, keep_days: dict[str, int] | None = None
) -> DataFrame:
    """Artifacts (`name`, `kind`, `mtime`) older than their kind may get.

    Only archives are dated by a stamp in their name; the rules are constants
    and become part of the plan.  Adds `dated`.
    """
    mtime = F.col("mtime").cast("timestamp")
    stamped = artifact_time(F.col("name"), mtime)
    dated, limit = F.lit(None).cast("timestamp"), F.lit(None).cast("int")
    for kind, days, by_name in RETENTION_RULES:
        of_kind = F.col("kind") == kind
        dated = F.when(of_kind, stamped if by_name else mtime).otherwise(dated)
        limit = F.when(of_kind, F.lit((keep_days or {}).get(kind, days))).otherwise(limit)
    dated_as_input = dated.cast(artifacts.schema["mtime"].dataType)
    oldest_kept = moment(artifacts, "mtime", now) - F.make_dt_interval(limit)
    return artifacts.withColumn("dated", dated_as_input).where(F.col("dated") < oldest_kept)
