"""Joins, comparisons, diffs, edits, JSON reshaping."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tablecheck.operators import compare, edits, joins, jsonshape, smartdiff
from tablecheck.sources import jsonrecords

from .common import CHANGED, COLUMNS, diff_pair, load, sql, union_all

ORDERS = COLUMNS["orders"]
# Display name of each mapped column of the diff pair, with the column on the other side.
PAIRS = {c: (c, c) for c in ORDERS} | {"o_custkey": ("o_custkey -> oCustKey", "oCustKey")}


# --- joins ---------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label")


def _join(how, spark, sf_dir):
    if how == "inner":
        return joins.join_tables(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), "o_custkey", "c_custkey", how)
    return joins.join_tables(_vectors(spark, sf_dir), load(spark, sf_dir, "labels"), "vec_id", "doc_id", how)


def _join_count(how, spark, sf_dir):
    if how == "full":
        return joins.join_count(_vectors(spark, sf_dir), load(spark, sf_dir, "labels"), "vec_id", "doc_id", how)
    return joins.join_count(load(spark, sf_dir, "events"), load(spark, sf_dir, "lineitem"), "user_id", "l_suppkey", how)


def join_count_mixed(spark, sf_dir):
    """Text keys, of which several mean one number, against numbers."""
    texts = sql(spark, sf_dir, "SELECT CASE WHEN event_id % 2 = 0 THEN '0' ELSE '' END || CAST(user_id AS STRING) AS key_text FROM events", "events")
    return joins.join_count(texts, load(spark, sf_dir, "supplier"), "key_text", "s_suppkey", "left")


def _join_twin(how: str) -> str:
    if how == "inner":
        left = ", ".join(f'o.{c} AS "base.{c}"' for c in ORDERS)
        right = ", ".join(f'c.{c} AS "join.{c}"' for c in COLUMNS["customer"])
        return f"SELECT {left}, {right} FROM orders o JOIN customer c ON o_custkey = c_custkey"
    return f"""SELECT e.vec_id AS "base.vec_id", e.label AS "base.label", l.doc_id AS "join.doc_id", l.quality AS "join.quality",
                      l.toxic AS "join.toxic" FROM embeddings e {how} JOIN labels l ON e.vec_id = l.doc_id"""


# --- compare -------------------------------------------------------------------------------------


def _texts(df):
    return df.withColumn("mismatched_columns", F.array_join("mismatched_columns", ","))


def positional(order, spark, sf_dir):
    base, other = diff_pair(spark, sf_dir)
    mapping = [(c, PAIRS[c][1]) for c in ORDERS]
    return _texts(compare.positional_compare(base, other, mapping, order))


def compare_summary(spark, sf_dir):
    base, other = diff_pair(spark, sf_dir)
    mapping = [(c, PAIRS[c][1]) for c in ORDERS]
    found = compare.positional_compare(base, other, mapping, ("o_orderdate", "o_orderdate"))
    return compare.compare_summary(base, other, found)


def _position_twin(order: str) -> str:
    def numbered(source: str, columns: list[str]) -> str:
        ties = ", ".join(f'"{c}" NULLS LAST' for c in columns)
        return f"SELECT *, row_number() OVER (ORDER BY {order} NULLS LAST, {ties}) - 1 AS i FROM ({source})"

    shown = ", ".join(f'b.{c} AS "base.{PAIRS[c][0]}"' for c in ORDERS)
    shown += ", " + ", ".join(f'c."{PAIRS[c][1]}" AS "compare.{PAIRS[c][0]}"' for c in ORDERS)
    every = ",".join(PAIRS[c][0] for c in ORDERS)
    changed = "concat_ws(',', " + ", ".join(
        f"CASE WHEN b.{c} IS DISTINCT FROM c.\"{PAIRS[c][1]}\" THEN '{PAIRS[c][0]}' END" for c in ORDERS
    ) + ")"
    return f"""
    WITH b AS ({numbered('SELECT * FROM orders', ORDERS)}), c AS ({numbered(CHANGED, [PAIRS[c][1] for c in ORDERS])}),
    j AS (SELECT coalesce(b.i, c.i) AS row_index,
                 CASE WHEN b.i IS NULL THEN 'missing_in_base' WHEN c.i IS NULL THEN 'missing_in_compare'
                      WHEN {changed} <> '' THEN 'value_mismatch' ELSE 'unchanged' END AS status,
                 CASE WHEN b.i IS NULL OR c.i IS NULL THEN '{every}' ELSE {changed} END AS mismatched_columns, {shown}
          FROM b FULL JOIN c ON b.i = c.i)
    SELECT * FROM j WHERE status <> 'unchanged'"""


def _diff(spark, sf_dir):
    return smartdiff.smart_diff(*diff_pair(spark, sf_dir))


def _keyed(spark, sf_dir, of):
    """The same diff on a key with many rows each."""
    base, other = diff_pair(spark, sf_dir)
    mapping = [(c, PAIRS[c][1]) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")]
    return of(base, other, mapping, ("o_custkey", "oCustKey"))


def _diff_twin(columns: list[str], key: str) -> str:
    shown = ", ".join(f'b.{c} AS "base.{PAIRS[c][0]}"' for c in columns)
    shown += ", " + ", ".join(f'c."{PAIRS[c][1]}" AS "compare.{PAIRS[c][0]}"' for c in columns)
    every = ",".join(PAIRS[c][0] for c in columns)
    changed = "concat_ws(',', " + ", ".join(
        f"CASE WHEN b.{c} IS DISTINCT FROM c.\"{PAIRS[c][1]}\" THEN '{PAIRS[c][0]}' END" for c in columns
    ) + ")"
    other = PAIRS[key][1]
    return f"""
    SELECT coalesce(CAST(b.{key} AS VARCHAR), CAST(c."{other}" AS VARCHAR)) AS key,
           CASE WHEN b.here IS NULL THEN 'missing_in_base' WHEN c.here IS NULL THEN 'missing_in_compare'
                WHEN {changed} <> '' THEN 'value_mismatch' ELSE 'unchanged' END AS status,
           CASE WHEN b.here IS NULL OR c.here IS NULL THEN '{every}' ELSE {changed} END AS mismatched_columns, {shown}
    FROM (SELECT *, true AS here FROM orders) b FULL JOIN (SELECT *, true AS here FROM ({CHANGED})) c
      ON b.{key} IS NOT DISTINCT FROM c."{other}" """


def _summary_twin(columns: list[str], key: str) -> str:
    return f"""
    SELECT count(*) FILTER (WHERE status = 'missing_in_base') AS inserted_rows,
           count(*) FILTER (WHERE status = 'missing_in_compare') AS deleted_rows,
           count(*) FILTER (WHERE status = 'value_mismatch') AS changed_rows,
           count(*) FILTER (WHERE status = 'unchanged') AS unchanged_rows, count(*) AS rows_compared,
           (SELECT count(*) FROM orders) AS total_rows_base, (SELECT count(*) FROM ({CHANGED})) AS total_rows_compare,
           (SELECT count(*) FROM (
              SELECT k FROM (SELECT {key} AS k, 1 AS b, 0 AS c FROM orders UNION ALL SELECT "{PAIRS[key][1]}", 0, 1 FROM ({CHANGED}))
              GROUP BY k HAVING sum(b) > 1 OR sum(c) > 1)) AS duplicate_keys
    FROM ({_diff_twin(columns, key)})"""


def _preview(spark, sf_dir):
    return _texts(compare.preview(_diff(spark, sf_dir).filter("status <> 'unchanged'"), "key"))


def key_stats(spark, sf_dir):
    stats = smartdiff.key_stats(*diff_pair(spark, sf_dir)).drop("pos")
    return stats.withColumn("score", F.round("score", 4))


def _key_twin() -> str:
    names = {"o_orderkey": 4 + 1, "o_custkey": 4, "o_orderstatus": 1, "o_totalprice": 1, "o_orderdate": 1, "o_orderpriority": 1}
    parts = []
    for c in ORDERS:
        other = PAIRS[c][1]
        parts.append(
            f"""SELECT '{c}' AS base_column, '{other}' AS compare_column, bt AS base_total, bd AS base_distinct, bt - bn AS base_nulls,
                  ct AS compare_total, cd AS compare_distinct, ct - cn AS compare_nulls,
                  round({names[c]} + 4 * (bd / bt + cd / ct) - 4 * ((bt - bn) / bt + (ct - cn) / ct), 4) AS score
                FROM (SELECT count(*) AS bt, count(DISTINCT {c}) AS bd, count({c}) AS bn FROM orders),
                     (SELECT count(*) AS ct, count(DISTINCT "{other}") AS cd, count("{other}") AS cn FROM ({CHANGED}))"""
        )
    return union_all(parts)


# --- edits ---------------------------------------------------------------------------------------

# Edits by day of the month: 7 price doubled, 8 status to null, 9 price to a word (does not fit),
# 13 deleted, 21 copied to a new key with two cells set.
EDITS = """
SELECT 'update' AS op, CAST(o_orderkey AS STRING) AS key, 'o_totalprice' AS `column`, CAST(CAST(o_totalprice * 2 AS DECIMAL(18, 2)) AS STRING) AS value
FROM orders WHERE extract(day FROM o_orderdate) = 7
UNION ALL SELECT 'update', CAST(o_orderkey AS STRING), 'o_orderstatus', 'NULL' FROM orders WHERE extract(day FROM o_orderdate) = 8
UNION ALL SELECT 'update', CAST(o_orderkey AS STRING), 'o_totalprice', 'cheap' FROM orders WHERE extract(day FROM o_orderdate) = 9
UNION ALL SELECT 'delete', CAST(o_orderkey AS STRING), NULL, NULL FROM orders WHERE extract(day FROM o_orderdate) = 13
UNION ALL SELECT 'insert', CAST(-o_orderkey - 1 AS STRING), 'o_custkey', CAST(o_custkey AS STRING) FROM orders WHERE extract(day FROM o_orderdate) = 21
UNION ALL SELECT 'insert', CAST(-o_orderkey - 1 AS STRING), 'o_orderdate', CAST(o_orderdate AS STRING) FROM orders WHERE extract(day FROM o_orderdate) = 21
"""


def _edits(spark, sf_dir):
    return load(spark, sf_dir, "orders"), sql(spark, sf_dir, EDITS, "orders")


def apply_edits(spark, sf_dir):
    return edits.apply_edits(*_edits(spark, sf_dir), "o_orderkey").rows


def rejected_edits(spark, sf_dir):
    return edits.apply_edits(*_edits(spark, sf_dir), "o_orderkey").rejects


def edit_summary(spark, sf_dir):
    return edits.edit_summary(*_edits(spark, sf_dir), "o_orderkey", 1)


def rename_columns(spark, sf_dir):
    return edits.rename_columns(load(spark, sf_dir, "nation"), {"n_name": " nation name ", "n_regionkey": "region.key"})


# --- JSON ----------------------------------------------------------------------------------------

# Documents of every shape, by event type.
DOCS = """
SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN '[' || props || ', {"k": null, "t": "x"}]'
                                 WHEN 'error' THEN '[1, "two", ' || props || ']' WHEN 'signup' THEN CAST(user_id AS %s)
                                 ELSE '{"broken": ' END AS doc
FROM events
"""
RECORDS = """
SELECT event_id, '{"data": {"items": [' || props || ', {"k": ' || CAST(user_id AS %s) || '}]}, "empty": {}}' AS doc FROM events
"""
DOCS_TWIN, RECORDS_TWIN = DOCS % "VARCHAR", RECORDS % "VARCHAR"


def _docs(spark, sf_dir):
    return sql(spark, sf_dir, DOCS % "STRING", "events")


def json_to_table(spark, sf_dir):
    return jsonshape.json_to_table(_docs(spark, sf_dir), "doc", "event_id")


def json_validate(spark, sf_dir):
    return jsonshape.json_validate(_docs(spark, sf_dir), "doc", "event_id")


def json_record_path(spark, sf_dir):
    found = jsonrecords.json_record_path(sql(spark, sf_dir, RECORDS % "STRING", "events"), "doc", "$.data.items", ["event_id"])
    return found.select("event_id", F.col("pos").cast("bigint").alias("pos"), F.try_variant_get("value", "$.k", "bigint").alias("k"))


def select_records(spark, sf_dir):
    shape = "data STRUCT<items: ARRAY<STRUCT<k: BIGINT>>>"
    parsed = sql(spark, sf_dir, RECORDS % "STRING", "events").select(F.from_json("doc", shape).alias("d")).select("d.*")
    return jsonrecords.select_records(parsed, "data.items.0")


def flatten_json(spark, sf_dir):
    shape = "data STRUCT<items: ARRAY<STRUCT<k: BIGINT>>>, empty STRUCT<>"
    parsed = sql(spark, sf_dir, RECORDS % "STRING", "events").select("event_id", F.from_json("doc", shape).alias("d"))
    nested = parsed.select(F.struct("event_id", F.struct(F.col("event_id").alias("id")).alias("inner")).alias("outer"), "d.data", "d.empty")
    return jsonrecords.flatten_json(nested)


_TYPE = """CASE json_type(%s) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
           WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"""
_VALUE = "CASE WHEN json_type({0}) = 'NULL' THEN 'null' WHEN json_type({0}) = 'VARCHAR' THEN {0} ->> '$' ELSE CAST({0} AS VARCHAR) END"

JSON_TWIN = f"""
WITH d AS (SELECT event_id AS id, CAST(json(doc) AS JSON) AS j FROM ({DOCS_TWIN}) WHERE json_valid(doc)),
m AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN 'object' WHEN json_type(j) <> 'ARRAY' THEN 'scalar'
                     WHEN len(list_filter(CAST(j AS JSON[]), lambda x: json_type(x) <> 'OBJECT')) = 0 THEN 'records' ELSE 'values' END AS mode FROM d),
items AS (SELECT id, mode, unnest(CAST(j AS JSON[])) AS item, unnest(range(len(CAST(j AS JSON[])))) AS i FROM m WHERE mode IN ('records', 'values')),
fields AS (SELECT id, mode, i, item, unnest(json_keys(item)) AS k FROM items WHERE mode = 'records'),
objects AS (SELECT id, mode, j, unnest(json_keys(j)) AS k, unnest(range(len(json_keys(j)))) AS i FROM m WHERE mode = 'object'),
cells AS (
  SELECT id, mode, i AS row_index, NULL AS key, item AS v FROM items WHERE mode = 'values'
  UNION ALL SELECT id, mode, i, k, json_extract(item, '$."' || k || '"') FROM fields
  UNION ALL SELECT id, mode, i, k, json_extract(j, '$."' || k || '"') FROM objects
  UNION ALL SELECT id, mode, 0, NULL, j FROM m WHERE mode = 'scalar')
SELECT id, mode, row_index, key, {_TYPE % 'v'} AS type, {_VALUE.format('v')} AS value FROM cells"""


QUERIES = {f"join_{how}": partial(_join, how) for how in joins.JOIN_KINDS} | {
    "join_count": partial(_join_count, "inner"),
    "join_count_mixed": join_count_mixed,
    "join_count_full": partial(_join_count, "full"),
    "positional_compare": partial(positional, ("o_orderdate", "o_orderdate")),
    "positional_compare_text": partial(positional, ("o_orderpriority", "o_orderpriority")),
    "compare_summary": compare_summary,
    "key_stats": key_stats,
    "smart_diff": lambda spark, sf_dir: _texts(_diff(spark, sf_dir)),
    "smart_diff_many": lambda spark, sf_dir: _texts(_keyed(spark, sf_dir, smartdiff.smart_diff)),
    "smart_diff_summary": lambda spark, sf_dir: smartdiff.smart_diff_summary(*diff_pair(spark, sf_dir)),
    "smart_diff_summary_many": lambda spark, sf_dir: _keyed(spark, sf_dir, smartdiff.smart_diff_summary),
    "smart_diff_preview": _preview,
    "diff_by_column": lambda spark, sf_dir: smartdiff.diff_by_column(_diff(spark, sf_dir)),
    "apply_edits": apply_edits,
    "rejected_edits": rejected_edits,
    "edit_summary": edit_summary,
    "rename_columns": rename_columns,
    "json_to_table": json_to_table,
    "json_validate": json_validate,
    "json_record_path": json_record_path,
    "select_records": select_records,
    "flatten_json": flatten_json,
}

_MANY = ["o_custkey", "o_orderstatus", "o_orderpriority"]
_DAY = "extract(day FROM o_orderdate)"
_CELLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

ORACLES = {f"join_{how}": _join_twin(how) for how in joins.JOIN_KINDS} | {
    "join_count": "SELECT count(*) AS total_rows FROM events JOIN lineitem ON user_id = l_suppkey",
    "join_count_mixed": "SELECT count(*) AS total_rows FROM events LEFT JOIN supplier ON user_id = s_suppkey",
    "join_count_full": "SELECT count(*) AS total_rows FROM embeddings FULL JOIN labels ON vec_id = doc_id",
    "positional_compare": _position_twin("o_orderdate"),
    "positional_compare_text": _position_twin("o_orderpriority"),
    "compare_summary": f"""SELECT (SELECT count(*) FROM orders) AS total_rows_base, (SELECT count(*) FROM ({CHANGED})) AS total_rows_compare,
        greatest((SELECT count(*) FROM orders), (SELECT count(*) FROM ({CHANGED}))) AS rows_compared, count(*) AS mismatch_count,
        count(*) FILTER (WHERE status = 'value_mismatch') AS value_mismatches, count(*) FILTER (WHERE status = 'missing_in_base') AS missing_in_base,
        count(*) FILTER (WHERE status = 'missing_in_compare') AS missing_in_compare, count(*) > 1000 AS truncated
        FROM ({_position_twin("o_orderdate")})""",
    "key_stats": _key_twin(),
    "smart_diff": _diff_twin(ORDERS, "o_orderkey"),
    "smart_diff_many": _diff_twin(_MANY, "o_custkey"),
    "smart_diff_summary": _summary_twin(ORDERS, "o_orderkey"),
    "smart_diff_summary_many": _summary_twin(_MANY, "o_custkey"),
    "smart_diff_preview": f"""SELECT * FROM ({_diff_twin(ORDERS, "o_orderkey")}) WHERE status <> 'unchanged' ORDER BY key LIMIT 1000""",
    "diff_by_column": f"""SELECT "column", count(*) AS changed_rows FROM (
        SELECT unnest(string_split(mismatched_columns, ',')) AS "column" FROM ({_diff_twin(ORDERS, "o_orderkey")}) WHERE status <> 'unchanged') GROUP BY 1""",
    "apply_edits": f"""SELECT o_orderkey, o_custkey, CASE WHEN {_DAY} = 8 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN {_DAY} = 7 THEN CAST(CAST(o_totalprice * 2 AS DECIMAL(18, 2)) AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
          o_orderdate, o_orderpriority FROM orders WHERE {_DAY} <> 13
        UNION ALL SELECT -o_orderkey - 1, o_custkey, NULL, NULL, o_orderdate, NULL FROM orders WHERE {_DAY} = 21""",
    "rejected_edits": f"""SELECT 'update' AS op, CAST(o_orderkey AS VARCHAR) AS key, 'o_totalprice' AS "column", 'cheap' AS value,
        'value_does_not_fit' AS reason FROM orders WHERE {_DAY} = 9""",
    "edit_summary": f"""SELECT CAST(1 AS BIGINT) AS renamed_columns, cells AS changed_cells, delta AS row_delta, 1 + cells + abs(delta) * 6 AS changes
        FROM (SELECT count(*) FILTER (WHERE {_DAY} IN (7, 8)) AS cells, count(*) FILTER (WHERE {_DAY} = 21) - count(*) FILTER (WHERE {_DAY} = 13) AS delta
              FROM orders)""",
    "rename_columns": 'SELECT n_nationkey, n_name AS "nation name", n_regionkey AS "region.key" FROM nation',
    "json_to_table": JSON_TWIN,
    "json_validate": f"""SELECT event_id AS id, CASE WHEN json_valid(doc) THEN 'valid' ELSE 'invalid' END AS status,
        CASE WHEN json_valid(doc) THEN CAST(json(doc) AS VARCHAR) END AS minified FROM ({DOCS_TWIN})""",
    "json_record_path": f"""SELECT event_id, unnest(range(2)) AS pos, CAST(json_extract_string(unnest(CAST(json_extract(doc, '$.data.items') AS JSON[])), '$.k') AS BIGINT) AS k
        FROM ({RECORDS_TWIN})""",
    "select_records": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "flatten_json": f"""SELECT event_id AS "outer.event_id", event_id AS "outer.inner.id", CAST(json_extract(doc, '$.data.items') AS VARCHAR) AS "data.items",
        CAST(NULL AS VARCHAR) AS empty FROM (SELECT event_id, json(doc) AS doc FROM ({RECORDS_TWIN}))""",
}
