"""Schema-less datasets, measurements, and file indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.measures import improvement
from gaugeworks.functions.text import criterion_label, holds_number

JSON_ROW = "map<string,string>"


def json_fields(rows: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Fields of JSON row objects as strings."""
    data = F.from_json(column, JSON_ROW)
    return rows.select("*", *[F.element_at(data, f).alias(f) for f in fields])


def drop_json_key(column: str, key: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(column, JSON_ROW), lambda k, _: k != key))


def tags_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(w.lower()) for w in wanted]))


def tags_all(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in wanted]), F.transform(tags, F.lower))) == 0


def normal_and_test(rows: DataFrame, key: list[str], side: str, value: str) -> DataFrame:
    """The largest value of each side and the improvement from normal to test."""
    found = rows.groupBy(*key).agg(*[F.max(F.when(F.col(side) == s, F.col(value))).alias(s) for s in ("normal", "test")])
    return found.withColumn("improvement", improvement(F.col("normal"), F.col("test")))


LOT = ["variable", "variable_group", "line", "check_type", "input", "ok", "ng_total"]


def issues(rows: DataFrame, key: list[str] = LOT) -> DataFrame:
    """Lots of measurements that don't add up, with their details and what is wrong.

    ``align`` if the extraction marked it. Otherwise lots without any named defect, with criterion labels, or without
    counts are passed over, as are sums of defects over the total; then ``missing`` (a total but no defects),
    ``undercount`` (fewer than the total) or ``contradict`` (defects but no total).
    """
    named = F.trim(F.coalesce("defect_type", F.lit(""))) != ""
    each = rows.groupBy(*key).agg(
        F.bool_or(F.col("defect_type") == "__ALIGN_ERROR__").alias("_align"),
        F.bool_or(named).alias("_named"),
        F.bool_or(criterion_label(F.col("defect_type"))).alias("_criterion"),
        F.sum(F.when(named, F.col("defect_count")).otherwise(0)).alias("counted"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("variable_detail", F.lit("")))), " / ").alias("details"),
    )
    total, counted = F.col("ng_total"), F.col("counted")
    passed = ~F.col("_named") | F.col("_criterion") | ((F.col("input") == 0) & (F.col("ok") == 0)) | ((total > 0) & (counted > total))
    sums = F.when((total > 0) & (counted == 0), "missing").when((total > 0) & (counted < total), "undercount").when((total == 0) & (counted > 0), "contradict")
    kind = F.when(F.coalesce("_align", F.lit(False)), "align").when(~passed, sums)
    return each.withColumn("issue", kind).where("issue is not null").select(*key, "counted", "details", "issue")


def source_mismatch(rows: DataFrame, source: Column, least: int = 10) -> DataFrame:
    """Distinct variable, variable_detail, input of which the input isn't in the source text as a whole number."""
    checked = rows.where((F.col("input") >= least) & (F.col("defect_type") != "__ALIGN_ERROR__"))
    return checked.where(~holds_number(source, F.col("input"))).select("variable", "variable_detail", "input").distinct()


def typed_records(rows: DataFrame, column: str, texts: list[str], numbers: list[str], wanted: dict[str, str] | None = None) -> DataFrame:
    """JSON row objects as records of text fields ('' if missing) and whole numbers (0 if missing or bad), newest ``id``
    first; only rows that have the ``wanted`` values regardless of case, where All or blank wants any."""
    data = F.from_json(column, JSON_ROW)
    fields = [F.coalesce(F.element_at(data, c), F.lit("")).alias(c) for c in texts]
    whole = [F.coalesce(F.regexp_replace(F.element_at(data, c), r"[,\s]", "").try_cast("double").cast("long"), F.lit(0)).alias(c) for c in numbers]
    found = rows.select("id", *fields, *whole)
    for c, value in (wanted or {}).items():
        if value.strip() and value != "All":
            found = found.where(F.lower(c) == value.lower())
    return found.orderBy(F.desc("id"))


def term_lines(rows: DataFrame, column: str) -> DataFrame:
    """term, description, seq of ``term: description`` lines, cut at the first colon; lines without a term are skipped."""
    lines = rows.select("rid", F.posexplode(F.split(column, r"\r?\n")).alias("line", "text"))
    term, description = (F.trim(F.regexp_extract("text", "^([^:]*):(.*)$", i)) for i in (1, 2))
    return lines.select(term.alias("term"), description.alias("description"), F.struct("rid", "line").alias("seq")).where("term <> ''")


def size_roll_up(files: DataFrame) -> DataFrame:
    """Bytes and files under every folder of the paths, and its part of the root folder's bytes."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rolled = files.select("bytes", F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    root = rolled.where(~F.contains("folder", F.lit("/"))).agg(F.sum("bytes").alias("_all"))
    return rolled.crossJoin(F.broadcast(root)).withColumn("share", F.col("bytes") / F.col("_all") * 100).drop("_all")  # the right side is one total


def head_tail_hash(content: Column, part: float = 0.1) -> Column:
    """SHA-256 of the first and last tenth of the bytes, rounded up; of all where these would meet."""
    n = F.greatest(F.ceil(F.length(content) * part), F.lit(1)).cast("int")
    ends = F.concat(F.substring(content, F.lit(1), n), F.substring(content, F.length(content) - n + 1, n))
    return F.sha2(F.when(2 * n >= F.length(content), content).otherwise(ends), 256)


def same_files(files: DataFrame) -> DataFrame:
    """path, bytes, hash of files with equal content, with the group's first path and its number of files.

    Candidates agree in their number of bytes and the hash of their head and tail; the whole is hashed for these only.
    """
    files = files.withColumn("ends", head_tail_hash(F.col("content")))
    candidates = files.groupBy("bytes", "ends").agg(F.count("*").alias("n")).where("n > 1").select("bytes", "ends")
    hashed = files.join(candidates, ["bytes", "ends"], "left_semi").select("path", "bytes", F.sha2("content", 256).alias("hash"))
    groups = hashed.groupBy("bytes", "hash").agg(F.min("path").alias("first_path"), F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(groups, ["bytes", "hash"])


def folder_order(rows: DataFrame) -> DataFrame:
    """Children of each folder in order, as ``place`` from 1: folders first, then the largest, then by name."""
    at = Window.partitionBy("parent").orderBy(F.desc("is_folder"), F.desc("bytes"), "name")
    return rows.withColumn("place", F.row_number().over(at))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: the new one if there is any. Of new rows with one key the last by ``seq`` counts, if they have it."""
    if "seq" in new.columns:
        columns = [c for c in new.columns if c not in (*key, "seq")]
        new = new.groupBy(*key).agg(F.max_by(F.struct(*columns), "seq").alias("_r")).select(*key, "_r.*")
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))
