"""Process capability and regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.measures import cpk, cpk_any_side, inverse_normal, out_of_limits
from gaugeworks.functions.text import number, parse_date


def long_form(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, name, y) without blanks."""
    return wide.unpivot(ids, columns, "name", "y").where("y is not null")


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """low and high of each name; the limits are one row a plotted column."""
    return rows.join(limits, "name", "left")


def column_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, ng, ng_pct, mean, population sigma, low and high value and two-sided Cpk."""
    found = rows.groupBy(*by).agg(
        F.count("y").alias("n"),
        F.count_if(out_of_limits(F.col("y"), F.col("low"), F.col("high"))).alias("ng"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("sigma"),
        F.min("y").alias("lowest"),
        F.max("y").alias("highest"),
        F.avg("low").alias("low"),
        F.avg("high").alias("high"),
    )
    pct = F.col("ng") / F.col("n") * 100
    return found.select(*by, "n", "ng", pct.alias("ng_pct"), "mean", "sigma", "lowest", "highest", cpk(F.col("mean"), F.col("sigma"), F.col("low"), F.col("high")).alias("cpk"))


def one_sided_cpk(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sample sigma, and the limits that there are."""
    found = rows.groupBy(*by).agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"), F.avg("low").alias("low"), F.avg("high").alias("high"))
    return found.select(*by, F.coalesce("s", F.lit(0.0)).alias("sigma"), cpk_any_side(F.col("m"), F.col("s"), F.col("low"), F.col("high")).alias("cpk"))


def row_failures(rows: DataFrame, row: str, by: list[str]) -> DataFrame:
    """Rows of which any value is out of limits."""
    each = rows.groupBy(*by, row).agg(F.bool_or(out_of_limits(F.col("y"), F.col("low"), F.col("high"))).alias("bad"))
    return each.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("bad").alias("ng"), (F.count_if("bad") / F.count("*") * 100).alias("ng_pct"))


def regression(rows: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n, slope, intercept, r2 and residual sigma of y on x; null below two points or without spread in x."""
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")
    )
    return _fitted(sums, by)


def _fitted(sums: DataFrame, by: list[str]) -> DataFrame:
    slope = F.when((F.col("n") >= 2) & (F.abs(F.col("n") * F.col("sxx")) >= 1e-12), F.col("sxy") / F.col("sxx"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    r2 = F.when(F.col("slope").isNotNull(), F.when(F.col("syy") <= 1e-12, F.lit(1.0)).otherwise(1 - rest / F.col("syy")))
    found = sums.withColumn("slope", slope)
    return found.select(*by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), r2.alias("r2"), F.when(F.col("n") >= 3, F.sqrt(rest / (F.col("n") - 2))).alias("residual_sigma"))


def pairwise(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Regressions of every later column on every earlier one, from one scan and one aggregation: x_name, y_name, n,
    slope, intercept, r2, residual_sigma."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        sums.append(F.struct(F.count_if(both).alias("n"), F.regr_avgx(b, a).alias("mx"), F.regr_avgy(b, a).alias("my"), F.regr_sxx(b, a).alias("sxx"), F.regr_sxy(b, a).alias("sxy"), F.regr_syy(b, a).alias("syy")).alias(f"s{k}"))
    one = wide.agg(*sums)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), *[F.col(f"s{k}")[c].alias(c) for c in ("n", "mx", "my", "sxx", "sxy", "syy")]) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
    return _fitted(rows, ["x_name", "y_name"])


def column_deltas(wide: DataFrame, columns: list[str]) -> DataFrame:
    """step, from_column, to_column, delta: how the means of consecutive process columns differ."""
    means = wide.agg(*[F.avg(c).alias(c) for c in columns])
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(a).alias("from_column"), F.lit(b).alias("to_column"), (F.col(b) - F.col(a)).alias("delta")) for i, (a, b) in enumerate(zip(columns, columns[1:], strict=False))]
    return means.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def quadratic(rows: DataFrame, by: list[str]) -> DataFrame:
    """a + b·x + c·x² by least squares on centred x, from power sums, and r2; null below three points or without spread."""
    centre = rows.groupBy(*by).agg(F.avg("x").alias("m"), F.avg("y").alias("my"))
    u, v = F.col("x") - F.col("m"), F.col("y") - F.col("my")
    sums = rows.join(centre, by).groupBy(*by, "m", "my").agg(F.count("*").alias("n"), F.sum(v * v).alias("vv"), *[F.sum(u**k).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(v * u**k).alias(f"t{k}") for k in (0, 1, 2)])
    s = [F.col("n"), *[F.col(f"s{k}") for k in (1, 2, 3, 4)]]
    t = [F.col(f"t{k}") for k in (0, 1, 2)]

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    rows3 = [[s[i + j] for j in range(3)] for i in range(3)]
    swap = lambda k: [[t[i] if j == k else rows3[i][j] for j in range(3)] for i in range(3)]
    whole = det(rows3)
    fits = sums.withColumns({name: F.when((F.col("n") >= 3) & (F.abs(whole) > 1e-12), det(swap(k)) / whole) for k, name in enumerate(("p", "q", "r"))})
    p, q, r, m = (F.col(c) for c in ("p", "q", "r", "m"))
    rest = F.greatest(F.col("vv") - p * t[0] - q * t[1] - r * t[2], F.lit(0.0))
    r2 = F.when(p.isNotNull(), F.when(F.col("vv") <= 1e-12, F.lit(1.0)).otherwise(1 - rest / F.col("vv")))
    return fits.select(*by, (F.col("my") + p - q * m + r * m * m).alias("a"), (q - 2 * r * m).alias("b"), r.alias("c"), r2.alias("r2"))


def required_x(rows: DataFrame, by: list[str], target: float, wanted: float = 0.0) -> DataFrame:
    """``by``, state and required_x: the x at which a part ``target`` would be below ``wanted``, by the regression of y on x.

    ``Unavailable`` below three points, without spread or slope; ``Unstable`` if the slope is under 0.001, r2 under
    0.05, or the slope over the range of x under half the residual sigma; else ``Calculated``.
    """
    fits = regression(rows, by).join(rows.groupBy(*by).agg((F.max("x") - F.min("x")).alias("range")), by)
    slope, sigma = F.col("slope"), F.col("residual_sigma")
    missing = slope.isNull() | sigma.isNull() | (F.abs(slope) <= 1e-12)
    unstable = (F.abs(slope) < 0.001) | (F.col("r2") < 0.05) | (F.abs(slope) * F.col("range") < sigma * 0.5)
    state = F.when(missing, "Unavailable").when(unstable, "Unstable").otherwise("Calculated")
    x = (F.lit(wanted) + inverse_normal(F.lit(1.0 - target)) * sigma - F.col("intercept")) / slope
    return fits.select(*by, state.alias("state"), F.when(state == "Calculated", x).alias("required_x"))


def recommended_limits(stats: DataFrame, by: list[str], place: str, ng_rate: float) -> DataFrame:
    """Outermost mean ± z·sigma over the columns of each ``by``, as measured and as fitted by lines through the columns' means
    and sigmas (at ``place`` 0, 1, 2 ...): low, high, trend_low, trend_high."""
    z = inverse_normal(F.lit((1.0 + min(max(1.0 - ng_rate, 1e-6), 1 - 1e-6)) / 2))
    rows = stats.withColumn("sigma", F.greatest(F.col("sigma"), F.lit(1e-7)))
    lines = rows.groupBy(*by).agg(*[f(y, place).alias(f"{n}_{y}") for y in ("mean", "sigma") for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))])
    # with a single column there is no line, and the trend is the column itself
    fitted = lambda y: F.coalesce(F.col(f"intercept_{y}") + F.col(f"slope_{y}") * F.col(place), F.col(y))
    mean, sigma = fitted("mean"), F.greatest(fitted("sigma"), F.lit(1e-7))
    joined = rows.join(lines, by)
    return joined.groupBy(*by).agg(
        F.min(F.col("mean") - z * F.col("sigma")).alias("low"), F.max(F.col("mean") + z * F.col("sigma")).alias("high"),
        F.min(mean - z * sigma).alias("trend_low"), F.max(mean + z * sigma).alias("trend_high"),
    )


def shared_limit_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """lowest, highest, mean, n, ng, ppm (not rounded) and Cpk, which is null unless all rows have the same two limits."""
    found = rows.groupBy(*by).agg(
        F.min("y").alias("lowest"), F.max("y").alias("highest"), F.avg("y").alias("mean"), F.count("*").alias("n"), F.count_if(out_of_limits(F.col("y"), F.col("low"), F.col("high"))).alias("ng"),
        F.stddev_pop("y").alias("s"), F.count_if(F.col("low").isNotNull() & F.col("high").isNotNull()).alias("limited"), *[f(c).alias(f"{n}_{c}") for c in ("low", "high") for n, f in (("min", F.min), ("max", F.max))],
    )
    shared = (F.col("limited") == F.col("n")) & (F.col("max_low") - F.col("min_low") < 1e-12) & (F.col("max_high") - F.col("min_high") < 1e-12)
    one = F.when(shared, cpk(F.col("mean"), F.col("s"), F.col("min_low"), F.col("min_high")))
    return found.select(*by, "lowest", "highest", "mean", "n", "ng", (F.col("ng") / F.col("n") * 1e6).alias("ppm"), one.alias("cpk"))


def failed_groups(rows: DataFrame, group: str) -> DataFrame:
    """One row: groups, those that have any point out of limits, and their percentage."""
    each = rows.groupBy(group).agg(F.bool_or(out_of_limits(F.col("y"), F.col("low"), F.col("high"))).alias("bad"))
    return each.agg(F.count("*").alias("n"), F.count_if("bad").alias("ng"), (F.count_if("bad") / F.count("*") * 100).alias("ng_pct"))


def label_order(rows: DataFrame, label: str) -> DataFrame:
    """label, place: distinct labels that aren't blank, by number if all are numbers, else by text regardless of case."""
    labels = rows.where(F.trim(label) != "").select(F.col(label).alias("label")).distinct()
    numeric = labels.agg(F.bool_and(number(F.col("label")).isNotNull()).alias("_all"))
    at = Window.orderBy(F.when(F.col("_all"), number(F.col("label"))), F.when(~F.col("_all"), F.lower("label")), "label")
    return labels.crossJoin(F.broadcast(numeric)).withColumn("place", F.row_number().over(at)).drop("_all")  # one row; distinct labels


def category_buckets(rows: DataFrame, columns: list[str], y: str, order: str) -> DataFrame:
    """label, place, value: mean of each category of the columns' texts, ``(blank)`` for blanks, in the order of their first rows."""
    text = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("(blank)"))
    found = rows.groupBy(F.concat_ws(" | ", *[text(c) for c in columns]).alias("label")).agg(F.avg(y).alias("value"), F.min(order).alias("_at"))
    return found.select("label", F.row_number().over(Window.orderBy("_at")).alias("place"), "value")  # a row a category


def type_sniff(rows: DataFrame, columns: list[str], year: int) -> DataFrame:
    """name, kind of each text column: Numeric if all texts that aren't blank are numbers, Date if all are dates, else Category."""
    texts = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("y")) for c in columns])).alias("p")).select("p.*").where("trim(y) <> ''")
    found = texts.groupBy("name").agg(F.bool_and(number(F.col("y")).isNotNull()).alias("n"), F.bool_and(parse_date(F.col("y"), year).isNotNull()).alias("d"))
    return found.select("name", F.when(F.col("n"), "Numeric").when(F.col("d"), "Date").otherwise("Category").alias("kind"))


def aligned_curves(points: DataFrame) -> DataFrame:
    """curve, family, x, y: curves whose x values, rounded to two places, are the same lists share a family, named by its first curve.

    ``points`` have curve, x, y; families keep the curves apart that can't be put side by side.
    """
    rounded = points.select("curve", F.round("x", 2).alias("x"), "y")
    vectors = rounded.groupBy("curve").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # one curve's points
    families = vectors.groupBy("xs").agg(F.collect_list("curve").alias("curves"), F.min("curve").alias("family"))
    return rounded.join(families.select(F.explode("curves").alias("curve"), "family"), "curve").select("family", "curve", "x", "y")


def density(stats: DataFrame, points: int = 101) -> DataFrame:
    """The normal density at ``points`` places on [lowest − sigma, highest + sigma]."""
    at = stats.where("sigma > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    first, last = F.col("lowest") - F.col("sigma"), F.col("highest") + F.col("sigma")
    x = first + (last - first) * F.col("i") / (points - 1)
    z = (F.col("x") - F.col("mean")) / F.col("sigma")
    return at.withColumn("x", x).withColumn("density", F.exp(-z * z / 2) / (F.col("sigma") * F.sqrt(2 * F.pi())))


def heat_map(rows: DataFrame, x: Column, y: Column, value: Column) -> DataFrame:
    return rows.groupBy(x.alias("x"), y.alias("y")).agg(F.avg(value).alias("value"))


def ppm_heat_map(rows: DataFrame, x: Column, y: Column, ng: str, total: str) -> DataFrame:
    """Mean over rows of their own defects per million; rows without input don't count."""
    return heat_map(rows, x, y, F.when(F.col(total) > 0, F.col(ng) * 1e6 / F.col(total)))
