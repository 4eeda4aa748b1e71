"""Writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """Comma-separated with a header; values with a comma, quote or line break are quoted, and quotes in them doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def lines(df: DataFrame, path: str, header: str) -> None:
    """One text file of the column ``value`` under a header line; for small files that others read."""
    head = df.sparkSession.range(1).select(F.lit(header).alias("value"))
    head.unionByName(df.select("value")).coalesce(1).write.mode("overwrite").text(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster's machines share, or in local mode in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read from there: it isn't computed again, and lost executors don't matter."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tabs and line breaks inside values become spaces; nothing else of a value is changed, and nulls are empty.

    No value is quoted: the quotation mark is a character that no value has by now.
    """
    flat = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ").alias(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").csv(path, sep="\t", header=True, quote="\r", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def replace_partitions(df: DataFrame, path: str, key: list[str]) -> None:
    """Only the partitions of ``key`` that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)
