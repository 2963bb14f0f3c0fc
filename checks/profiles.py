"""Profiles, chart data, write types and data quality."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tablecheck.operators import charts, doctor, profile, sketches, writetypes
from tablecheck.plans.storage import scratch_folder, stored
from tablecheck.sinks import export

from .common import (
    COLUMNS,
    DATE,
    MIXED_COLUMNS,
    MIXED_TWIN,
    NUMBER,
    PATCHY_COLUMNS,
    PATCHY_TWIN,
    between_percentiles,
    joined_issues,
    load,
    mixed_events,
    patchy_orders,
    union_all,
)


def _rounded(df):
    return df.select(
        *[F.round(c, 4).alias(c) if t == "double" and not c.endswith("_ratio") else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def _profile(of, table, spark, sf_dir):
    source = {"mixed": mixed_events, "patchy": patchy_orders}.get(table)
    df = source(spark, sf_dir) if source else load(spark, sf_dir, table)
    return _rounded(of(df))


def _duplicates(spark, sf_dir):
    return profile.duplicate_rows(load(spark, sf_dir, "documents").select("text", "lang"))


def profile_approx(spark, sf_dir):
    """The approximate profile, with its distinct counts judged by the exact ones."""
    df = load(spark, sf_dir, "lineitem")
    exact = profile.profile_columns(df).select("column", F.col("distinct_count").alias("exact_count"), F.col("distinct_ratio").alias("exact_ratio"))
    found = profile.profile_columns(df, approx=True).join(exact, "column")
    close = F.abs(F.col("distinct_count") - F.col("exact_count")) <= 0.25 * F.col("exact_count")
    ratio = F.abs(F.col("distinct_ratio") - F.col("exact_ratio")) <= 0.25 * F.col("exact_ratio")
    rows = found.withColumns({"distinct_close": close, "ratio_close": ratio}).drop("distinct_count", "distinct_ratio", "exact_ratio")
    return _rounded(rows)


def file_sketches(spark, sf_dir):
    """Orders as a folder of files: sketches per file, stored, merged over the files of each status, and judged by exact counts."""
    folder = scratch_folder(spark)
    load(spark, sf_dir, "orders").repartition(4).write.partitionBy("o_orderstatus").parquet(folder)
    table = spark.read.parquet(folder)
    columns = ["o_custkey", "o_totalprice", "o_orderpriority"]
    kept = stored(sketches.sketch_files(table, columns)).withColumn("status", F.regexp_extract("file", "o_orderstatus=([^/]+)", 1))
    merged = sketches.estimates(sketches.merge_sketches(kept, ["status"]), (0.5,))
    cells = table.select(F.col("o_orderstatus").alias("status"), F.expr("stack(3, 'o_custkey', CAST(o_custkey AS STRING), 'o_totalprice', CAST(o_totalprice AS STRING), 'o_orderpriority', o_orderpriority) AS (column, v)"))
    number = F.col("v").try_cast("double")
    exact = cells.groupBy("status", "column").agg(F.count_distinct("v").alias("distinct_count"))
    # A row per status and column.
    medians = F.broadcast(merged.select("status", "column", F.get("quantile_estimates", F.lit(0)).alias("median")))
    middle = F.expr(between_percentiles("number", "median", 0.47, 0.53))
    ranked = cells.withColumn("number", number).join(medians, ["status", "column"]).groupBy("status", "column", "median").agg(middle.alias("median_close")).drop("median")
    both = merged.join(exact, ["status", "column"]).join(ranked, ["status", "column"])
    close = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.greatest(F.lit(1.0), 8 * sketches.DISTINCT_ERROR * F.col("distinct_count"))
    return both.select("status", "column", "row_count", "filled_count", "distinct_count", close.alias("distinct_close"), "median_close")


def infer_types(spark, sf_dir):
    return writetypes.infer_write_types(mixed_text(spark, sf_dir)).drop("sample_value")


TYPED_TEXT = """
SELECT CAST(event_id AS {text}) AS whole, CAST(value AS {text}) AS fraction, CAST(CAST(ts AS DATE) AS {text}) AS day,
       CAST(ts AS {text}) AS moment, CASE WHEN user_id > 70 THEN 'TRUE' ELSE 'false' END AS flag, event_type AS word,
       nullif(event_type, event_type) AS nothing, value AS number, props
FROM events
"""


def mixed_text(spark, sf_dir):
    from .common import sql

    return sql(spark, sf_dir, TYPED_TEXT.format(text="STRING"), "events")


def create_parquet_cast(spark, sf_dir):
    columns = [
        export.OutputColumn("whole", "n", "BIGINT"),
        export.OutputColumn("fraction", "n", "BIGINT"),
        export.OutputColumn("fraction", "price", "DECIMAL(9, 1)"),
        export.OutputColumn("word", "bad number", "DOUBLE"),
        export.OutputColumn("moment", "at", "TIMESTAMP"),
        export.OutputColumn("day", "day", "DATE"),
        export.OutputColumn("flag", "flag", "BOOLEAN"),
        export.OutputColumn("number", "half", "BIGINT"),
        export.OutputColumn("props", "", "GEOMETRY"),
    ]
    return export.typed_columns(mixed_text(spark, sf_dir), columns)


def _chart(of, table, spark, sf_dir, **arguments):
    return _rounded(of(load(spark, sf_dir, table), **arguments))


def _quality(source, spark, sf_dir):
    df = source(spark, sf_dir) if callable(source) else load(spark, sf_dir, source)
    return joined_issues(doctor.data_quality(df)).drop("data_type")


def _totals(spark, sf_dir):
    return doctor.data_quality_totals(load(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars"))


QUERIES = {
    "profile_columns": partial(_profile, profile.profile_columns, "lineitem"),
    "profile_documents": partial(_profile, profile.profile_columns, "documents"),
    "profile_mixed": partial(_profile, profile.profile_columns, "mixed"),
    "profile_approx": profile_approx,
    "file_sketches": file_sketches,
    "profile_types": partial(_profile, profile.profile_types, "mixed"),
    "profile_types_orders": partial(_profile, profile.profile_types, "orders"),
    "top_values": partial(_profile, profile.top_values, "documents"),
    "top_values_text": partial(_profile, profile.top_values_text, "orders"),
    "duplicate_rows": _duplicates,
    "profile_totals": partial(_profile, profile.profile_totals, "patchy"),
    "eda_findings": partial(_profile, profile.eda_findings, "patchy"),
    "numeric_summary": partial(_profile, profile.numeric_summary, "patchy"),
    "suggestions": lambda spark, sf_dir: profile.suggestions(patchy_orders(spark, sf_dir)).withColumn("columns", F.array_join("columns", ",")),
    "infer_types": infer_types,
    "create_parquet_cast": create_parquet_cast,
    "bar_data": partial(_chart, charts.bar_data, "lineitem", x="l_suppkey", y="l_extendedprice", agg="sum", limit=40),
    "bar_count": partial(_chart, charts.bar_data, "events", x="props", limit=100),
    "line_data": partial(_chart, charts.line_data, "lineitem", x="l_shipdate", y="l_quantity", agg="avg", limit=100),
    "scatter_data": partial(_chart, charts.scatter_data, "orders", x="o_custkey", y="o_totalprice", limit=60, order_by=["o_orderkey"]),
    "histogram": partial(_chart, charts.histogram, "lineitem", x="l_extendedprice", limit=20),
    "data_quality": partial(_quality, patchy_orders),
    "data_quality_lineitem": partial(_quality, "lineitem"),
    "data_quality_totals": _totals,
}


def long_form(source: str, columns: list[str]) -> str:
    """(pos, column, kind, v) of every cell, v null when missing."""
    kinds = {
        "BOOLEAN": "boolean",
        "DATE": "date",
        "TIMESTAMP": "date",
        "VARCHAR": "other",
    }
    case = " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in kinds.items())
    parts = [
        f"SELECT {i} AS pos, '{c}' AS \"column\", typeof({c}) AS t, nullif(regexp_replace(CAST({c} AS VARCHAR), '^-0\\.0$', '0.0'), '') AS v FROM ({source})"
        for i, c in enumerate(columns)
    ]
    return f"SELECT pos, \"column\", v, CASE {case} ELSE 'numeric' END AS kind FROM ({union_all(parts)})"


def counts(source: str, columns: list[str]) -> str:
    return f"""
    SELECT pos, "column", count(*) AS row_count, count(v) AS present_count, count(*) - count(v) AS missing_count,
           count(DISTINCT v) AS distinct_count, count(num) AS numeric_count, avg(num) AS numeric_mean,
           min(num) AS numeric_min, max(num) AS numeric_max,
           CASE WHEN count(*) > 0 THEN (count(*) - count(v)) / count(*) ELSE 0 END AS missing_ratio,
           CASE WHEN count(v) > 0 THEN count(DISTINCT v) / count(v) ELSE 0 END AS distinct_ratio,
           CASE WHEN count(v) = 0 THEN 'empty' WHEN count(num) / count(v) >= 0.8 THEN 'numeric'
                WHEN count(*) FILTER (WHERE is_bool) / count(v) >= 0.8 THEN 'boolean'
                WHEN count(*) FILTER (WHERE is_date) / count(v) >= 0.8 THEN 'date'
                WHEN count(DISTINCT v) <= greatest(20, ceil(count(v) * 0.2)) THEN 'categorical' ELSE 'text' END AS inferred_type
    FROM (SELECT *, v IS NOT NULL AND (kind = 'boolean' OR (kind = 'other' AND lower(v) IN ('true', 'false'))) AS is_bool,
                 v IS NOT NULL AND (kind = 'date' OR (kind = 'other' AND num IS NULL AND regexp_matches(v, '{DATE}')
                                    AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL)) AS is_date
          FROM (SELECT *, CASE WHEN kind IN ('numeric', 'other') AND regexp_matches(v, '{NUMBER}') THEN TRY_CAST(v AS DOUBLE) END AS num
                FROM ({long_form(source, columns)})))
    GROUP BY pos, "column"
    """


def _columns_twin(source: str, columns: list[str]) -> str:
    return f"""SELECT "column", row_count, present_count, missing_count, missing_ratio, distinct_count,
                      distinct_ratio, numeric_count, round(numeric_mean, 4) AS numeric_mean,
                      numeric_min, numeric_max FROM ({counts(source, columns)})"""


def _types_twin(source: str, columns: list[str]) -> str:
    return f'SELECT "column", inferred_type FROM ({counts(source, columns)})'


_CUT = "CASE WHEN length({0}) > 24 THEN substring({0}, 1, 23) || '...' ELSE {0} END"


def _top_twin(source: str, columns: list[str]) -> str:
    return f"""
    SELECT "column", rank, value, value_count FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value_count DESC, {_CUT.format("value")}, key) AS rank FROM (
        SELECT "column", v AS value, CASE WHEN length(v) > 64 THEN '#' || sha256(v) ELSE v END AS key, count(*) AS value_count
        FROM ({long_form(source, columns)}) WHERE v IS NOT NULL GROUP BY ALL))
    WHERE rank <= 3"""


def _duplicates_of(source: str, columns: list[str]) -> str:
    keys = ", ".join(f"coalesce(nullif(CAST({c} AS VARCHAR), ''), 'NULL') AS {c}" for c in columns)
    return f"SELECT (SELECT count(*) FROM ({source})) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM ({source})))"


PATCHY_COUNTS = counts(PATCHY_TWIN, PATCHY_COLUMNS)
NAMED = {"missing": "missing_ratio >= 0.2", "unique": "present_count > 1 AND distinct_ratio >= 0.95", "numeric": "inferred_type = 'numeric'"}


def _first(condition: str) -> str:
    return f"""(SELECT string_agg("column", ',' ORDER BY pos) FROM (SELECT * FROM c WHERE {condition} ORDER BY pos LIMIT 1))"""


def _all(condition: str) -> str:
    return f"""(SELECT string_agg("column", ',' ORDER BY pos) FROM c WHERE {condition})"""


SUGGESTIONS_TWIN = f"""
WITH c AS ({PATCHY_COUNTS}),
all_rows AS (
  SELECT 1 AS rank, 'compare_by_category' AS suggestion, {_first("inferred_type IN ('categorical', 'boolean')")} AS columns,
         {_first(NAMED['numeric'])} IS NOT NULL AS ok
  UNION ALL SELECT 2, 'plot_over_time', {_first(NAMED['numeric'])} || ',' || {_first("inferred_type = 'date'")}, true
  UNION ALL SELECT 3, 'review_missing', {_all(NAMED['missing'])}, true
  UNION ALL SELECT 4, 'check_duplicates', '', ({_duplicates_of(PATCHY_TWIN, PATCHY_COLUMNS)}) > 0
  UNION ALL SELECT 5, 'identifier_like', {_all(NAMED['unique'])}, true)
SELECT rank, suggestion, columns FROM all_rows WHERE ok AND columns IS NOT NULL"""

FINDINGS_TWIN = f"""
WITH c AS ({PATCHY_COUNTS})
SELECT 'empty_column' AS finding, "column" AS subject, CAST(NULL AS DOUBLE) AS value FROM c WHERE present_count = 0
UNION ALL SELECT 'high_missing', "column", round(missing_ratio, 4) FROM c WHERE present_count > 0 AND missing_ratio >= 0.2
UNION ALL SELECT 'constant_column', "column", NULL FROM c WHERE present_count > 0 AND distinct_count = 1
UNION ALL SELECT 'duplicate_rows', NULL, n FROM (SELECT ({_duplicates_of(PATCHY_TWIN, PATCHY_COLUMNS)}) AS n) WHERE n > 0"""

DUCK_TYPED = TYPED_TEXT.format(text="VARCHAR")


def _infer_twin() -> str:
    parts = []
    for c in "whole fraction day moment flag word nothing number props".split():
        v = f"nullif(CAST({c} AS VARCHAR), '')"
        number = f"CASE WHEN regexp_matches({v}, '{NUMBER}') THEN TRY_CAST({v} AS DOUBLE) END"
        dated = f"({number}) IS NULL AND regexp_matches({v}, '{DATE}') AND TRY_CAST({v} AS TIMESTAMP) IS NOT NULL"
        parts.append(
            f"""SELECT '{c}' AS "column", CASE WHEN count({v}) = 0 THEN 'VARCHAR'
                WHEN bool_and(lower({v}) IN ('true', 'false')) THEN 'BOOLEAN'
                WHEN count({number}) = count({v}) AND bool_and(floor({number}) = {number}) THEN 'BIGINT'
                WHEN count({number}) = count({v}) THEN 'DOUBLE'
                WHEN count(*) FILTER (WHERE {dated}) = count({v})
                  THEN CASE WHEN bool_or(regexp_matches({v}, '[tT ][0-9]{{1,2}}:[0-9]{{2}}')) THEN 'TIMESTAMP' ELSE 'DATE' END
                ELSE 'VARCHAR' END AS write_type, count(*) - count({v}) AS missing_count FROM ({DUCK_TYPED})"""
        )
    return union_all(parts)


def quality_twin(source: str, columns: dict[str, str]) -> str:
    """Data quality of columns given as {name: family}."""
    parts = []
    for c, family in columns.items():
        text, ranged = family == "text", family in ("numeric", "temporal")
        empty = f"count(*) FILTER (WHERE {c} = '')" if text else "CAST(NULL AS BIGINT)"
        words = f"count(*) FILTER (WHERE lower(trim({c})) IN ('unknown', 'n/a', 'na', 'null', 'none', '0'))" if text else "CAST(NULL AS BIGINT)"
        shift = " + 0" if family == "numeric" else ""
        low = f"CAST(min({c}){shift} AS VARCHAR)" if ranged else "CAST(NULL AS VARCHAR)"
        high = f"CAST(max({c}){shift} AS VARCHAR)" if ranged else "CAST(NULL AS VARCHAR)"
        zero = f"min({c}) = 0 AND max({c}) = 0" if family == "numeric" else "false"
        outside = (lambda v: f"{v} < '1900-01-01' OR {v} > '2200-01-01'") if family == "temporal" else (lambda v: "false")
        parts.append(
            f"""SELECT '{c}' AS "column", null_count, null_ratio, empty_string_count, suspicious_default_count, min_value, max_value,
              concat_ws(',', CASE WHEN null_ratio >= 0.5 THEN 'high_null_ratio' END, CASE WHEN empty_string_count > 0 THEN 'empty_strings' END,
                CASE WHEN suspicious_default_count / n >= 0.1 THEN 'default_values' END, CASE WHEN zero THEN 'all_zero' END,
                CASE WHEN {outside('min_value')} THEN 'min_out_of_range' END, CASE WHEN {outside('max_value')} THEN 'max_out_of_range' END) AS issues
            FROM (SELECT count(*) AS n, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 4) AS null_ratio,
                         {empty} AS empty_string_count, {words} AS suspicious_default_count, {low} AS min_value, {high} AS max_value,
                         {zero} AS zero FROM ({source}))"""
        )
    return union_all(parts)


PATCHY_FAMILIES = dict(
    zip(PATCHY_COLUMNS, ["numeric", "text", "text", "text", "text", "numeric", "numeric", "temporal"])
)
LINEITEM_FAMILIES = dict(zip(COLUMNS["lineitem"], ["numeric"] * 8 + ["text", "text", "temporal"]))

ORACLES = {
    "profile_columns": _columns_twin("SELECT * FROM lineitem", COLUMNS["lineitem"]),
    "profile_documents": _columns_twin("SELECT * FROM documents", COLUMNS["documents"]),
    "profile_mixed": _columns_twin(MIXED_TWIN, MIXED_COLUMNS),
    "profile_approx": "SELECT * EXCLUDE (distinct_count, distinct_ratio), distinct_count AS exact_count, true AS distinct_close, true AS ratio_close FROM ("
    + _columns_twin("SELECT * FROM lineitem", COLUMNS["lineitem"])
    + ")",
    "file_sketches": """SELECT o_orderstatus AS status, 'o_custkey' AS "column", count(*) AS row_count, count(o_custkey) AS filled_count, count(DISTINCT o_custkey) AS distinct_count,
                               true AS distinct_close, true AS median_close FROM orders GROUP BY 1
        UNION ALL SELECT o_orderstatus, 'o_totalprice', count(*), count(o_totalprice), count(DISTINCT o_totalprice), true, true FROM orders GROUP BY 1
        UNION ALL SELECT o_orderstatus, 'o_orderpriority', count(*), count(nullif(o_orderpriority, '')), count(DISTINCT nullif(o_orderpriority, '')), true, NULL FROM orders GROUP BY 1""",
    "profile_types": _types_twin(MIXED_TWIN, MIXED_COLUMNS),
    "profile_types_orders": _types_twin("SELECT * FROM orders", COLUMNS["orders"]),
    "top_values": _top_twin("SELECT * FROM documents", COLUMNS["documents"]),
    "top_values_text": f"""SELECT "column", string_agg({_CUT.format("value")} || ' (' || value_count || ')', ', ' ORDER BY rank) AS top_values
                           FROM ({_top_twin("SELECT * FROM orders", COLUMNS["orders"])}) GROUP BY "column" """,
    "duplicate_rows": f"SELECT ({_duplicates_of('SELECT text, lang FROM documents', ['text', 'lang'])}) AS duplicate_rows",
    "profile_totals": f"""SELECT max(row_count) AS row_count, count(*) AS column_count,
                                 count(*) FILTER (WHERE inferred_type = 'numeric') AS numeric_columns,
                                 CAST(sum(missing_count) AS BIGINT) AS missing_cells,
                                 ({_duplicates_of(PATCHY_TWIN, PATCHY_COLUMNS)}) AS duplicate_rows FROM ({PATCHY_COUNTS})""",
    "eda_findings": FINDINGS_TWIN,
    "numeric_summary": f"""SELECT "column", round(missing_ratio * 100, 4) AS missing_percent, round(numeric_mean, 4) AS numeric_mean,
                                  numeric_min, numeric_max FROM ({PATCHY_COUNTS}) WHERE inferred_type = 'numeric'""",
    "suggestions": SUGGESTIONS_TWIN,
    "infer_types": _infer_twin(),
    "create_parquet_cast": f"""SELECT CAST(whole AS BIGINT) AS n, CAST(round_even(CAST(fraction AS DOUBLE), 0) AS BIGINT) AS n_2,
        CAST(fraction AS DECIMAL(18, 4)) AS price, CAST(NULL AS DOUBLE) AS "bad number", CAST(moment AS TIMESTAMP) AS "at",
        CAST("day" AS DATE) AS "day", CAST(flag AS BOOLEAN) AS flag, CAST(round_even(number, 0) AS BIGINT) AS half, props AS column_9
        FROM ({DUCK_TYPED})""",
    "bar_data": """SELECT CAST(l_suppkey AS VARCHAR) AS label, round(sum(l_extendedprice), 4) AS value FROM lineitem
                   GROUP BY 1 ORDER BY abs(sum(l_extendedprice)) DESC, 1 LIMIT 40""",
    "bar_count": "SELECT props AS label, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "line_data": """SELECT CAST(l_shipdate AS VARCHAR) AS label, round(avg(l_quantity), 4) AS value FROM lineitem
                    GROUP BY l_shipdate ORDER BY l_shipdate LIMIT 100""",
    "scatter_data": "SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders ORDER BY o_orderkey LIMIT 60",
    "histogram": """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
        k AS (SELECT CAST(least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
        SELECT CAST(r.range AS INT) AS bin, round(lo + r.range * ((hi - lo) / 20), 4) AS bin_start,
               round(lo + (r.range + 1) * ((hi - lo) / 20), 4) AS bin_end, coalesce(n, 0) AS count
        FROM range(20) r CROSS JOIN b LEFT JOIN k ON k.bin = r.range""",
    "data_quality": quality_twin(PATCHY_TWIN, PATCHY_FAMILIES),
    "data_quality_lineitem": quality_twin("SELECT * FROM lineitem", LINEITEM_FAMILIES),
    "data_quality_totals": """SELECT count(*) AS total_rows, count(DISTINCT (text, lang, source, n_chars)) AS distinct_rows,
                                     count(*) - count(DISTINCT (text, lang, source, n_chars)) AS duplicate_rows FROM documents""",
}
