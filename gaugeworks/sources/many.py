"""Many delimited files in one scan, each with its own delimiter and header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.sources.readers import fields

#: Delimiters in the order in which they win a tie, and lines of a file that are looked at.
DELIMITERS, LOOKED_AT = ("\t", ",", ";", "|", " "), 20


def lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value, first, id: all lines under ``path``; inside a file's first part (``first``) ids go up by one."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), "value", (F.col("_metadata.file_block_start") == 0).alias("first"), F.monotonically_increasing_id().alias("id"))


def _cut(line: Column, delimiter: Column) -> Column:
    """The fields of a line at a delimiter that is a column's value."""
    return reduce(lambda found, d: F.when(delimiter == d, fields(line, d)).otherwise(found), DELIMITERS, F.array(line))


def delimiters(heads: DataFrame) -> DataFrame:
    """file, delimiter: of each file's lines (file, value) the one with the largest mean over (1 + deviation) of field
    counts; means under 2 don't count, and a tab stands where none does. All delimiters are scored in one aggregate."""
    counts = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(d).alias("delimiter"), F.size(fields(F.col("value"), d)).alias("n")) for i, d in enumerate(DELIMITERS)])
    each = heads.where(F.trim("value") != "").select("file", F.explode(counts).alias("c")).groupBy("file", "c.place", "c.delimiter")
    scored = each.agg(F.avg("c.n").alias("mean"), F.stddev_pop("c.n").alias("spread"))
    score = F.when(F.col("mean") >= 2, F.struct(F.col("mean") / (1 + F.col("spread")), "place"))
    return scored.groupBy("file").agg(F.coalesce(F.max_by("delimiter", score), F.lit(DELIMITERS[0])).alias("delimiter"))


def unique_names(names: Column) -> Column:
    """Blank names become Column; repeats get _2, _3, regardless of case."""
    whole = F.transform(names, lambda n: F.when(F.trim(n) == "", "Column").otherwise(F.trim(n)))

    def number(n: Column, i: Column) -> Column:
        same = F.size(F.filter(F.slice(whole, F.lit(1), i + 1), lambda x: F.lower(x) == F.lower(n)))
        return F.when(same == 1, n).otherwise(F.concat(n, F.lit("_"), same.cast("string")))

    return F.transform(whole, number)


def headers(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """file, start, delimiter, names of every file under ``path`` that has a line ``header_row``."""
    lines = lines_of_files(spark, path)
    firsts = lines.where("first")
    starts = firsts.groupBy("file").agg(F.min("id").alias("start"))
    heads = firsts.join(starts, "file").withColumn("line", F.col("id") - F.col("start") + 1).where(F.col("line").between(header_row, header_row + LOOKED_AT - 1))
    named = heads.where(F.col("line") == header_row).select("file", "start", "value").join(delimiters(heads), "file")
    return named.select("file", "start", "delimiter", unique_names(_cut(F.col("value"), F.col("delimiter"))).alias("names"))


def delimited_files(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """file, fields of every data line of every file under ``path``; ``fields`` are (name, value) in the file's order.

    Each file is cut at its own delimiter and named by its own line ``header_row``; lines up to that and blank ones are
    left out. Values are trimmed, missing ones empty, and further ones have no name and are left out.
    """
    known = headers(spark, path, header_row)
    lines = lines_of_files(spark, path).where(F.trim("value") != "").join(known, "file")
    data = lines.where(~(F.col("first") & (F.col("id") - F.col("start") < header_row))).withColumn("_parts", _cut(F.col("value"), F.col("delimiter")))
    value = lambda i: F.coalesce(F.trim(F.get("_parts", i)), F.lit(""))
    return data.select("file", F.transform("names", lambda n, i: F.struct(n.alias("name"), value(i).alias("value"))).alias("fields"))


def value_of(name: str) -> Column:
    """The value under a name of ``fields``, or null where the file has no such column."""
    return F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))["value"]
