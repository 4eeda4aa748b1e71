"""Readers. What is parsed stays distributed; only headers and delimiters are settled on the driver, from a few lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from gaugeworks.functions.text import number
from gaugeworks.sources.writers import staged

#: Files whose starts are broadcast at most (some 20 MB).
KNOWN = 100_000


def where_all(df: DataFrame, equals: dict[str, object]) -> DataFrame:
    """Rows that equal every given value; pushed down to the scan."""
    return df.where(reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in equals.items()], F.lit(True)))


def union_like_first(tables: list[DataFrame]) -> DataFrame:
    """All rows, with the columns of the first table that has any row (of the first, if none has)."""
    first = next((t for t in tables if not t.isEmpty()), tables[0]).columns
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select(*first)


def union_all_columns(tables: list[DataFrame]) -> DataFrame:
    """All rows by name, with every column that any table has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_separators(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables by name, and after each table an empty row."""
    spark = tables[0].sparkSession
    blank = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in tables[0].schema])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x for t in tables for x in (t, blank)])


def cached_days(spark: SparkSession, root: str, days: list[str], schema: str) -> DataFrame:
    """Rows of the day folders ``day=yyyy-MM-dd`` under ``root``; days without one give none, nor do files that can't be read."""
    whole = f"{schema}, day date"
    found = spark.read.schema(whole).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("basePath", root).parquet(root)
    return found.where(F.col("day").isin([F.lit(d).cast("date") for d in days]))


def common_columns(source: DataFrame, target: DataFrame, keep: tuple[str, list] | None = None) -> DataFrame:
    """The columns that both have, in the target's order, and of ``keep`` (column, values) only rows with these values."""
    rows = source if keep is None else source.where(F.col(keep[0]).isin(keep[1]))
    return rows.select(*[c for c in target.columns if c in set(source.columns)])


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of ``columns`` that there are, in their order."""
    return df.select(*[c for c in columns if c in df.columns])


def exists(spark: SparkSession, table: str, column: str | None = None) -> bool:
    """Whether the session has a table, and a column of that name regardless of case."""
    if not spark.catalog.tableExists(table):
        return False
    return column is None or column.lower() in {c.lower() for c in spark.table(table).columns}


def days_to_fetch(cached: DataFrame, first: str, last: str, today: str, horizon: int = 3) -> DataFrame:
    """day, source: ``fetch`` for days that aren't cached or may still change, else ``cache``."""
    spark = cached.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    known = cached.select(F.col("day")).distinct().withColumn("_known", F.lit(True))
    fresh = F.col("day") > F.date_sub(F.lit(today).cast("date"), horizon)
    return days.join(known, "day", "left").select("day", F.when(fresh | F.col("_known").isNull(), "fetch").otherwise("cache").alias("source"))


def json_records(df: DataFrame, column: str, names: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the JSON array found at the root, data.contents, data, rows or contents; keys renamed, nulls empty."""
    roots = [F.get_json_object(column, p) for p in ("$.data.contents", "$.data", "$.rows", "$.contents")]
    array = F.coalesce(*[F.from_json(r, "array<map<string,string>>") for r in roots], F.from_json(column, "array<map<string,string>>"))
    rows = df.select(F.explode(array).alias("_r"))
    return rows.select(*[F.coalesce(F.element_at("_r", old), F.lit("")).alias(new) for old, new in names.items() if old not in drop])


def repair_json(column: Column) -> Column:
    """Trailing commas dropped, missing ones between objects added."""
    return F.regexp_replace(F.regexp_replace(column, r",\s*([}\]])", "$1"), r"\}\s*\{", "},{")


def group_definitions(df: DataFrame, column: str) -> DataFrame:
    """product_group, group_name, model from group JSON: an object with Groups or a bare array."""
    group = "array<struct<Index:int,GroupName:string,ModelList:array<string>>>"
    whole = F.from_json(repair_json(F.col(column)), f"struct<ProductGroup:string,Groups:{group}>")
    bare = F.from_json(repair_json(F.col(column)), group)
    rows = df.select(whole["ProductGroup"].alias("product_group"), F.explode(F.coalesce(whole["Groups"], bare)).alias("g"))
    return rows.select("product_group", F.col("g.GroupName").alias("group_name"), F.explode("g.ModelList").alias("model"))


def master_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated with a header line; values trimmed, missing ones empty, blank lines skipped."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="PERMISSIVE", enforceSchema=True)
    return rows.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns])


def strict_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated with a header line, which is skipped by its place; lines with fewer columns are dropped."""
    parts = F.split("value", "\t")
    rows = numbered_lines(spark, path).where("not (first and line = 1)").where(F.size(parts) >= len(columns))
    return rows.select(*[F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)])


def headerless(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited lines without a header under given names; blank lines are skipped, missing fields null, further ones left out."""
    parts = fields(F.col("value"), sep)
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def training_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Comma-separated lines with quotes, which are doubled inside quotes, under a header; all texts, '' where missing."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', enforceSchema=True)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value, first, line: the lines of each file, those of its first part (``first``) with their numbers from 1.

    Only the head of a file is told by line numbers, and it lies in the part that begins at byte 0. A folder may have
    several files, each with a head of its own; their starts are broadcast up to KNOWN files and joined by a shuffle beyond.
    """
    first = (F.col("_metadata.file_block_start") == 0).alias("first")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", first, F.monotonically_increasing_id().alias("id"))
    starts = staged(lines.where("first").groupBy("file").agg(F.min("id").alias("start")), "starts")
    starts = F.broadcast(starts) if starts.count() <= KNOWN else starts.hint("merge")
    return lines.join(starts, "file").select("file", "value", "first", (F.col("id") - F.col("start") + 1).alias("line"))


def fields(line: Column, sep: str) -> Column:
    """The fields of a line; a space stands for any white space, and then empty fields are left out."""
    if sep == " ":
        return F.filter(F.split(line, r"\s+"), lambda x: x != "")
    return F.split(line, f"\\Q{sep}\\E", -1)


def detect_delimiter(lines: list[str], choices: tuple[str, ...] = ("\t", ",", ";", "|", " ")) -> str:
    """The one with the largest mean over (1 + population deviation) of field counts, means under 2 aside; else tab."""
    best, found = 0.0, "\t"
    kept = [x for x in lines if x.strip()][:20]
    for d in choices:
        counts = [len(x.split() if d == " " else x.split(d)) for x in kept]
        mean = sum(counts) / len(counts) if counts else 0
        if mean >= 2:
            score = mean / (1 + (sum((c - mean) ** 2 for c in counts) / len(counts)) ** 0.5)
            if score > best:
                best, found = score, d
    return found


def unique_headers(names: list[str]) -> list[str]:
    """Blank names become Column; repeats get _2, _3, regardless of case."""
    seen: dict[str, int] = {}
    found = []
    for name in (n.strip() or "Column" for n in names):
        seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
        found.append(name if n == 1 else f"{name}_{n}")
    return found


def _header(lines: DataFrame, header_row: int) -> str:
    found = lines.where(F.col("first") & (F.col("line") == header_row)).orderBy("file").first()
    if found is None:
        raise ValueError(f"line {header_row} isn't there to name columns")
    return found.value


def delimited(spark: SparkSession, path: str, delimiter: str | None = None, header_row: int = 1, least: int = 1) -> DataFrame:
    """A delimited file of which line ``header_row`` names the columns, and lines before it are left out.

    Values are trimmed, missing ones empty, blank lines skipped; fewer than ``least`` columns are an error.
    """
    lines = numbered_lines(spark, path)
    head = [r.value for r in lines.where(F.col("first") & F.col("line").between(header_row, header_row + 19)).orderBy("file", "line").limit(20).collect()]
    sep = delimiter or detect_delimiter(head)
    header = _header(lines, header_row)
    names = unique_headers(header.split() if sep == " " else header.split(sep))
    if len(names) < least:
        raise ValueError(f"{least} columns are needed, {len(names)} are there")
    parts = fields(F.col("value"), sep)
    rows = lines.where((F.trim("value") != "") & ~(F.col("first") & (F.col("line") <= header_row)))
    return rows.select(*[F.coalesce(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])


def scatter(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """A file with a header, cut at tabs if the header has any, else at commas if it has any, else at ``delimiter``.

    Rows that are too short so are cut at white space, if that gives enough fields.
    """
    lines = numbered_lines(spark, path)
    header = _header(lines, 1)
    sep = "\t" if "\t" in header else "," if "," in header else delimiter
    names = unique_headers(header.split() if sep == " " else header.split(sep))
    own, loose = fields(F.col("value"), sep), fields(F.col("value"), " ")
    parts = F.when((F.size(own) < len(names)) & (F.size(loose) >= len(names)), loose).otherwise(own)
    rows = lines.where((F.trim("value") != "") & ~(F.col("first") & (F.col("line") == 1))).select(parts.alias("p"))
    return rows.select(*[F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)])


def curve_cells(cells: DataFrame, first_row: int = 5, single_row: int = 4) -> DataFrame:
    """file, sheet, x, y of cell tables (file, sheet, row, col, value): pairs of columns 1 and 2 from ``first_row`` to the
    first row where either is blank; pairs that aren't numbers are left out. Sheets of impedance have one pair, in ``single_row``."""
    key = ["file", "sheet"]
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("value")))
    rows = cells.where("col in (1, 2)").groupBy(*key, "row").agg(at(1).alias("a"), at(2).alias("b"))
    alone = F.contains(F.lower("sheet"), F.lit("impedanc"))
    whole = rows.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    # the n-th whole row from the first on is in row first_row + n - 1 unless a blank one came before it
    table = whole.where(~alone & (F.col("row") >= first_row))
    run = Window.partitionBy(*key).orderBy("row")
    table = table.withColumn("n", F.row_number().over(run)).where(F.col("row") == F.col("n") + first_row - 1).drop("n")
    both = table.unionByName(whole.where(alone & (F.col("row") == single_row)))
    return both.select(*key, number(F.col("a")).alias("x"), number(F.col("b")).alias("y")).where("x is not null and y is not null")


def dated_values(spark: SparkSession, path: str, values: int, sep: str = ",") -> DataFrame:
    """Header-less lines of a date and up to ``values`` numbers; a first field that is no date is an error."""
    schema = StructType([StructField("d", StringType()), *[StructField(f"Value{i + 1}", StringType()) for i in range(values)]])
    rows = spark.read.csv(path, sep=sep, header=False, schema=schema)
    day = F.try_to_timestamp("d", F.lit("yyyy-MM-dd")).cast(DateType())
    checked = F.coalesce(day, F.raise_error(F.concat(F.lit("no date: "), F.col("d"))).cast("date"))
    return rows.select(checked.alias("Date"), *[F.col(f"Value{i + 1}").try_cast("double").alias(f"Value{i + 1}") for i in range(values)])
