"""Message-corpus analytics as Spark DataFrame and Column functions.

Nothing in the package creates a session.  Writers and streaming starters run
jobs, and so do whole runs while they are put together (`plans`, and a store's
`current` with `near`), which write intermediate tables.  All functions assume
``spark.sql.session.timeZone = UTC``; :func:`use_utc` sets it.
"""

from pyspark.sql import SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, on which every rendered date depends."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
