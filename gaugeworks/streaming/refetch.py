"""A table of days that a stream of fetches keeps up to date: recent days are replaced, older ones are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.sources.writers import replace_partitions

#: Days back from a fetch, its own day included, that may still change.
HORIZON = 3


def stored_days(spark, path: str) -> list:
    """The days that the table has; one value a day."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return [n.removeprefix("day=") for n in names if n.startswith("day=")]


def take(batch: DataFrame, path: str, horizon: int = HORIZON) -> None:
    """Put one fetch, or several in turn, into the table at ``path``, which is partitioned by ``day``.

    Rows have ``day`` and ``fetched``, the day of their fetch. A fetch replaces its days of the last ``horizon`` and
    adds those that aren't there; an older day that is there stays as it is. A day without rows in a fetch stays, too.
    Taking a fetch again gives the same table.
    """
    spark = batch.sparkSession
    for (fetched,) in batch.select("fetched").distinct().orderBy("fetched").collect():  # one in a batch, unless fetches were missed
        rows = batch.where(F.col("fetched") == F.lit(fetched))
        known = stored_days(spark, path)
        recent = F.col("day") > F.date_sub(F.lit(fetched).cast("date"), horizon)
        new = ~F.date_format("day", "yyyy-MM-dd").isin(known) if known else F.lit(True)
        replace_partitions(rows.where(recent | new).drop("fetched"), path, ["day"])


def follow(fetches: DataFrame, path: str, checkpoint: str, horizon: int = HORIZON) -> StreamingQuery:
    """Take every fetch of a stream that is there, in order; a restart goes on behind the last one that was taken."""
    return (
        fetches.writeStream.foreachBatch(lambda batch, _: take(batch, path, horizon))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
