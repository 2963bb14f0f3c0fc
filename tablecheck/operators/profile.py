"""Column profiles of a whole table: presence, distinct values, numbers, likely types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from ..functions import types as ty
from ..plans.aggregate import column_metrics, column_names, distinct_rows, label, passes_over, value_counts
from ..plans.small import small_frame
from ..plans.spreading import is_small, spread
from ..plans.storage import stored

# Thresholds of the profile rules.
TYPE_SHARE = 0.8
FEWEST_CATEGORIES = 20
CATEGORY_SHARE = 0.2
HIGH_MISSING = 0.2
IDENTIFIER_SHARE = 0.95

_COUNTS = {
    "row_count": "bigint",
    "present_count": "bigint",
    "distinct_count": "bigint",
    "numeric_count": "bigint",
    "boolean_count": "bigint",
    "date_count": "bigint",
    "numeric_sum": "double",
    "numeric_min": "double",
    "numeric_max": "double",
}


def _kinds(df: DataFrame) -> DataFrame:
    """Columns whose declared type overrules a test of their text."""

    def kind(dtype: T.DataType) -> str:
        if ty.is_numeric(dtype):
            return "numeric"
        if isinstance(dtype, T.BooleanType):
            return "boolean"
        return "date" if ty.is_temporal(dtype) else "other"

    rows = [(i, f.name, kind(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return small_frame(df.sparkSession, rows, "pos int, `column` string, kind string")


def _text_tests(df: DataFrame) -> DataFrame:
    """Adds ``number``, ``boolean``, ``date``: what the column ``text`` reads as, given its ``kind``.

    In steps, so that each test of a text is worked out once. The text of a
    numeric column needs no test of its form.
    """
    text, kind, raw, free = F.col("text"), F.col("kind"), F.col("raw"), F.col("kind") == "other"
    numeric = F.when(kind == "numeric", text.try_cast("double"))
    boolean = (kind == "boolean") | (free & values.is_boolean_text(text))
    date = (kind == "date") | (free & F.col("number").isNull() & values.as_moment(text).isNotNull())
    return (
        df.withColumn("raw", numeric.when(free, values.as_number(text)))
        .withColumn("number", F.when(F.abs(raw) < float("inf"), raw))
        .withColumn("boolean", F.coalesce(boolean, F.lit(False)))
        .withColumn("date", F.coalesce(date, F.lit(False)))
    )


def _bits(value: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """A number, Boolean, date or time as a whole number or else as a double; one of the two is null. Equal values alone have equal ones."""
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return none_long, values.plain_zero(value, dtype).cast("double")
    if isinstance(dtype, T.DecimalType):
        return (value * F.lit(10**dtype.scale).cast(T.DecimalType(19, 0))).cast("long"), none_double
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long"), none_double
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value), none_double
    if isinstance(dtype, T.TimestampNTZType):
        seconds = F.hour(value) * 3600 + F.minute(value) * 60
        micros = (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")
        return (F.unix_date(value.cast("date")).cast("long") * 86_400 + seconds) * 1_000_000 + micros, none_double
    return value.cast("long"), none_double


def _is_fixed(dtype: T.DataType) -> bool:
    """Types whose values fit the pairs of ``_bits``."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision <= 18
    return ty.is_numeric(dtype) or ty.is_temporal(dtype) or isinstance(dtype, T.BooleanType)


def _fixed_counts(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """The frequencies of numbers, Booleans, dates and times in the form ``_counted`` takes: pairs of fixed width, never text."""
    bits = [c.alias(f"{which}{i}") for i, f in fields for which, c in zip("ld", _bits(names.col(f.name), f.dataType))]
    stacked = ", ".join(f"{i}, l{i}, d{i}" for i, _ in fields)
    chosen = df.select(*[names.col(f.name) for _, f in fields])
    # The table decides: a large one is split by its scan, whatever a pass reads of it.
    wide = (spread(chosen) if is_small(df) else chosen).select(*bits)
    if len(fields) == 1:
        # The shortest key: the value alone.
        i, f = fields[0]
        which, other = ("d", "l") if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else ("l", "d")
        counts = wide.groupBy(f"{which}{i}").agg(F.count(F.lit(1)).alias("n"))
        none = F.lit(None).cast("long" if other == "l" else "double").alias(other)
        counted = counts.select(F.lit(i).alias("pos"), F.col(f"{which}{i}").alias(which), none, "n")
    else:
        counted = wide.selectExpr(f"stack({len(fields)}, {stacked}) AS (pos, l, d)").groupBy("pos", "l", "d").agg(F.count(F.lit(1)).alias("n"))
    rows = [(i, f.name, ty.is_numeric(f.dataType), isinstance(f.dataType, T.BooleanType), float(10 ** getattr(f.dataType, "scale", 0))) for i, f in fields]
    kinds = small_frame(df.sparkSession, rows, "pos int, `column` string, numeric boolean, is_boolean boolean, unit double")
    # One row per column of the schema.
    known = counted.join(F.broadcast(kinds), "pos")
    raw = F.when(F.col("numeric"), F.coalesce("d", F.col("l") / F.col("unit")))
    here = F.col("l").isNotNull() | F.col("d").isNotNull()
    number = F.when(F.abs(raw) < float("inf"), raw)
    return known.select("pos", "column", "n", here.alias("here"), number.alias("number"), F.col("is_boolean").alias("boolean"), (~F.col("numeric") & ~F.col("is_boolean")).alias("date"))


def _text_counts(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """The same of all other columns. The tests of a value run once per distinct value."""
    # One row per column of the schema.
    counted = value_counts(df, fields=fields).join(F.broadcast(_kinds(df)), "pos")
    tested = _text_tests(counted.select("*", F.col("key").isNotNull().alias("here"), F.col("key").alias("text")))
    return tested.select("pos", "column", "n", "here", "number", "boolean", "date")


def _exact_counts(df: DataFrame) -> DataFrame:
    """Counts of every column from the frequencies of its values: one shuffle of each kind of column."""
    fields = list(enumerate(df.schema.fields))
    fixed = [f for f in fields if _is_fixed(f[1].dataType)]
    texts = [f for f in fields if not _is_fixed(f[1].dataType)]
    parts = [_fixed_counts(df, part) for part in passes_over(df, fixed)]
    parts += [_text_counts(df, texts)] if texts else []
    n, number = F.col("n"), F.col("number")
    return reduce(DataFrame.unionByName, parts).groupBy("pos", "column").agg(
        F.sum(n).alias("row_count"),
        F.sum(F.when(F.col("here"), n).otherwise(0)).alias("present_count"),
        F.count_if("here").alias("distinct_count"),
        F.sum(F.when(number.isNotNull(), n).otherwise(0)).alias("numeric_count"),
        F.sum(F.when(F.col("boolean") & F.col("here"), n).otherwise(0)).alias("boolean_count"),
        F.sum(F.when(F.col("date") & F.col("here"), n).otherwise(0)).alias("date_count"),
        F.sum(number * n).alias("numeric_sum"),
        F.min(number).alias("numeric_min"),
        F.max(number).alias("numeric_max"),
    )


def _approximate_counts(df: DataFrame) -> DataFrame:
    """The same counts in one pass without any shuffle of values; distinct counts are sketches of native values.

    A column has the metrics of its type only. Text is tested in a projection
    below the aggregate, once per cell; typed columns need no test.
    """
    tested: list[Column] = []
    found: dict[str, dict[str, Column]] = {}
    for i, f in enumerate(df.schema.fields):
        dtype, v = f.dataType, F.col(f"v{i}")
        tested.append((names.col(f.name) if ty.can_be_grouped(dtype) else values.as_text(names.col(f.name), dtype)).alias(f"v{i}"))
        number, counts = None, {}
        if ty.is_text(dtype):
            text = names.col(f.name)
            tested.append(values.as_number(text).alias(f"number{i}"))
            tested.append(values.is_boolean_text(text).alias(f"boolean{i}"))
            tested.append((values.as_moment(text).isNotNull() & values.as_number(text).isNull()).alias(f"date{i}"))
            v, number = F.when(v != "", v), F.col(f"number{i}")
            counts |= {"boolean_count": F.count_if(f"boolean{i}"), "date_count": F.count_if(f"date{i}")}
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            number = values.number_of(v, dtype)
        elif ty.is_numeric(dtype):
            number = v.cast("double")
        elif isinstance(dtype, T.BooleanType):
            counts["boolean_count"] = F.count(v)
        elif ty.is_temporal(dtype):
            counts["date_count"] = F.count(v)
        if number is not None:
            counts |= {"numeric_count": F.count(number), "numeric_sum": F.sum(number), "numeric_min": F.min(number), "numeric_max": F.max(number)}
        distinct = F.approx_count_distinct(values.plain_zero(v, dtype) if ty.can_be_grouped(dtype) else v)
        found[f.name] = {"row_count": F.count(F.lit(1)), "present_count": F.count(v), "distinct_count": distinct, **counts}
    known = spread(df).select(*[names.col(f.name) for f in df.schema.fields], *tested)
    return column_metrics(known, lambda name, _: found[name], _COUNTS, df.columns).fillna(0, ["numeric_count", "boolean_count", "date_count"])


def column_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """All counts the other operators of this module derive from, one row per column.

    An empty table still gives a row per column.
    """
    counted = _approximate_counts(df) if approx else _exact_counts(df)
    known = _kinds(df).select("pos", "column").join(counted.drop("pos"), "column", "left")
    zeros = {c: 0 for c in _COUNTS if c.endswith("_count")}
    present, distinct = F.col("present_count"), F.col("distinct_count")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    few = F.greatest(F.lit(FEWEST_CATEGORIES), F.ceil(present * CATEGORY_SHARE))
    likely = (
        F.when(present == 0, "empty")
        .when(F.col("numeric_count") / present >= TYPE_SHARE, "numeric")
        .when(F.col("boolean_count") / present >= TYPE_SHARE, "boolean")
        .when(F.col("date_count") / present >= TYPE_SHARE, "date")
        .when(distinct <= few, "categorical")
        .otherwise("text")
    )
    return known.fillna(zeros).select(
        "*",
        (F.col("row_count") - present).alias("missing_count"),
        share(F.col("row_count") - present, F.col("row_count")).alias("missing_ratio"),
        share(distinct, present).alias("distinct_ratio"),
        F.when(F.col("numeric_count") > 0, F.col("numeric_sum") / F.col("numeric_count")).alias("numeric_mean"),
        likely.alias("inferred_type"),
    )


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    return column_counts(df, approx).select(
        "column",
        "row_count",
        "present_count",
        "missing_count",
        "missing_ratio",
        "distinct_count",
        "distinct_ratio",
        "numeric_count",
        "numeric_mean",
        "numeric_min",
        "numeric_max",
    )


def profile_types(df: DataFrame, approx: bool = False) -> DataFrame:
    return column_counts(df, approx).select("column", "inferred_type")


def top_values(df: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent values of each column, whole; ties by their first characters, then by whole value.

    The rank window keeps k rows per column and task before it shuffles. Long
    texts are counted by their digest; those of the k rows that are left are
    picked up from the table by it.
    """
    best = Window.partitionBy("pos").orderBy(F.col("n").desc(), F.col("label"), F.col("key"))
    ranked = value_counts(df, labelled=True).filter("key IS NOT NULL").withColumn("rank", F.row_number().over(best))
    # One row per column of the schema.
    top = ranked.filter(F.col("rank") <= k).join(F.broadcast(column_names(df)), "pos")
    shown = ["column", F.col("rank").cast("long").alias("rank")]
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if not _is_fixed(f.dataType)]
    if not fields:
        return top.select(*shown, F.col("key").alias("value"), F.col("n").alias("value_count"))
    top = stored(top)
    texts = [values.as_text(names.col(f.name), f.dataType).alias(f"v{i}") for i, f in fields]
    cells = df.select(*texts).selectExpr(f"stack({len(fields)}, {', '.join(f'{i}, v{i}' for i, _ in fields)}) AS (p, v)")
    # k rows per column of the schema.
    digests = top.filter(F.col("key").startswith(values.DIGEST_MARK)).select("pos", F.col("key").alias("digest"))
    long = cells.filter(values.is_long(F.col("v"))).withColumn("d", values.compact(F.col("v")))
    whole = long.join(F.broadcast(digests), (F.col("p") == F.col("pos")) & (F.col("d") == F.col("digest"))).groupBy("p", "d").agg(F.first("v").alias("v"))
    joined = top.join(F.broadcast(whole), (F.col("pos") == F.col("p")) & (F.col("key") == F.col("d")), "left")
    return joined.select(*shown, F.coalesce("v", "key").alias("value"), F.col("n").alias("value_count"))


def top_values_text(df: DataFrame) -> DataFrame:
    """``column, top_values``: the display form ``v (n), v (n), v (n)``, values cut."""
    shown = F.struct("rank", F.concat(label(F.col("value")), F.lit(" ("), F.col("value_count"), F.lit(")")).alias("t"))
    ranked = top_values(df).groupBy("column").agg(F.array_sort(F.collect_list(shown)).alias("tops"))
    return ranked.select("column", F.array_join("tops.t", ", ").alias("top_values"))


def _row_keys(df: DataFrame) -> list[Column]:
    """Row identity for duplicates: null, empty text and the word NULL are one value."""
    keys = []
    for f in df.schema.fields:
        key = values.group_key(names.col(f.name), f.dataType)
        if ty.is_text(f.dataType):
            key = F.when(values.present(names.col(f.name)), key).otherwise(F.lit("NULL"))
        keys.append(key)
    return keys


def duplicate_rows(df: DataFrame) -> DataFrame:
    counted = distinct_rows(df, _row_keys(df))
    return counted.select((F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def profile_totals(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row for the table. The duplicate count is read as a scalar subquery."""
    return (
        column_counts(df, approx)
        .agg(
            F.max("row_count").alias("row_count"),
            F.count(F.lit(1)).alias("column_count"),
            F.count_if(F.col("inferred_type") == "numeric").alias("numeric_columns"),
            F.sum("missing_count").alias("missing_cells"),
        )
        .select("*", duplicate_rows(df).scalar().alias("duplicate_rows"))
    )


def numeric_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    numeric = column_counts(df, approx).filter(F.col("inferred_type") == "numeric")
    missing = F.col("missing_ratio") * 100
    return numeric.select("column", missing.alias("missing_percent"), "numeric_mean", "numeric_min", "numeric_max")


def eda_findings(df: DataFrame, approx: bool = False) -> DataFrame:
    """``finding, subject, value``: one row per column or table finding, or ``no_issues``.

    Findings: ``empty_column``, ``high_missing`` (value is the ratio),
    ``constant_column``, ``duplicate_rows`` (value is their number),
    ``no_rows``. The table is profiled once; the profile, one row per column,
    is then looked at as an array.
    """

    def finding(condition: Column, name: str, subject: Column | None = None, value: Column | None = None) -> Column:
        subject = F.lit(None).cast("string") if subject is None else subject
        value = F.lit(None).cast("double") if value is None else value.cast("double")
        return F.struct(
            F.lit(name).alias("finding"), subject.alias("subject"), value.alias("value"), condition.alias("on")
        )

    def of_column(c: Column) -> Column:
        here = c["present_count"] > 0
        return F.array(
            finding(~here, "empty_column", c["column"]),
            finding(here & (c["missing_ratio"] >= HIGH_MISSING), "high_missing", c["column"], c["missing_ratio"]),
            finding(here & (c["distinct_count"] == 1), "constant_column", c["column"]),
        )

    kept = F.struct("pos", "column", "row_count", "present_count", "missing_ratio", "distinct_count")
    profile = column_counts(df, approx).agg(F.array_sort(F.collect_list(kept)).alias("columns"), F.max("row_count").alias("n"))
    profile = profile.select("*", duplicate_rows(df).scalar().alias("copies"))
    whole = F.array(
        finding(F.col("copies") > 0, "duplicate_rows", value=F.col("copies")),
        finding(F.coalesce(F.col("n"), F.lit(0)) == 0, "no_rows"),
    )
    found = F.filter(F.concat(F.flatten(F.transform("columns", of_column)), whole), lambda x: x["on"])
    nothing = F.array(finding(F.lit(True), "no_issues"))
    return profile.select(F.inline(F.when(F.size(found) > 0, found).otherwise(nothing))).drop("on")


def suggestions(df: DataFrame, approx: bool = False) -> DataFrame:
    """``suggestion, columns``: what to look at next, in a fixed order.

    ``compare_by_category`` (first categorical or boolean column, with a
    numeric one present), ``plot_over_time`` (numeric, date),
    ``review_missing`` and ``identifier_like`` (all such columns),
    ``check_duplicates``; ``start_with_charts`` when there is none. Works on
    one row per column.
    """
    stats = column_counts(df, approx)

    def listed(condition: Column) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "column"))))
        return F.transform(pairs, lambda x: x["column"])

    kind = F.col("inferred_type")
    lists = stats.agg(
        listed(kind == "numeric").alias("numeric"),
        listed(kind.isin("categorical", "boolean")).alias("category"),
        listed(kind == "date").alias("date"),
        listed(F.col("missing_ratio") >= HIGH_MISSING).alias("missing"),
        listed((F.col("present_count") > 1) & (F.col("distinct_ratio") >= IDENTIFIER_SHARE)).alias("unique"),
    ).select("*", duplicate_rows(df).scalar().alias("copies"))

    def first(name: str) -> Column:
        return F.slice(F.col(name), 1, 1)

    def some(name: str) -> Column:
        return F.size(name) > 0

    def advice(rank: int, name: str, columns: Column, condition: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(name).alias("suggestion"), columns.alias("columns"), condition.alias("on")
        )

    nothing = F.array().cast("array<string>")
    rows = F.array(
        advice(1, "compare_by_category", first("category"), some("numeric") & some("category")),
        advice(2, "plot_over_time", F.concat(first("numeric"), first("date")), some("numeric") & some("date")),
        advice(3, "review_missing", F.col("missing"), some("missing")),
        advice(4, "check_duplicates", nothing, F.col("copies") > 0),
        advice(5, "identifier_like", F.col("unique"), some("unique")),
    )
    on = F.filter(rows, lambda x: x["on"])
    usual = F.array(advice(6, "start_with_charts", nothing, F.lit(True)))
    return lists.select(F.inline(F.when(F.size(on) > 0, on).otherwise(usual))).select("rank", "suggestion", "columns")
