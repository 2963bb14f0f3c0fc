"""Queries a user runs as SQL over the open tables, table view operations, as-of join."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tablecheck.operators import asof, query, schema
from tablecheck.sources.tables import read_table

from .common import CHECK_DIR, DATE, MIXED_COLUMNS, MIXED_TWIN, NUMBER, between_percentiles, file_name, load, mixed_events, sql, union_all

# name -> (tables, Spark SQL, DuckDB SQL or None when the text is the same)
SHARED = {
    "g_filter": (
        "lineitem",
        """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag,
                  CASE WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount IS NULL THEN 'none' ELSE 'low' END AS discount_band
           FROM lineitem
           WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 30 AND l_linestatus ILIKE 'f%'
             AND l_shipdate IS NOT NULL AND l_tax IS DISTINCT FROM 0.0""",
        None,
    ),
    "g_join": (
        "customer orders nation region",
        """SELECT r_name, n_name, count(*) AS n_orders, CAST(round(sum(o_totalprice), 2) AS DECIMAL(18, 2)) AS total
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
        None,
    ),
    "g_semi": (
        "customer orders",
        """SELECT c_custkey, c_name FROM customer
           WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)""",
        None,
    ),
    "g_anti": (
        "documents labels",
        """SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
        None,
    ),
    "g_subquery": (
        "orders customer",
        """SELECT o_orderkey, o_custkey, o_totalprice,
                  (SELECT max(c_mktsegment) FROM customer WHERE c_custkey = o_custkey) AS segment
           FROM orders o
           WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)
             AND o_orderdate >= (SELECT min(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
        None,
    ),
    "g_group": (
        "lineitem",
        """SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts,
                  count(*) FILTER (WHERE l_returnflag = 'R') AS returned, CAST(sum(l_quantity) AS BIGINT) AS quantity
           FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1""",
        None,
    ),
    "g_rollup": (
        "lineitem",
        """SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS INT) AS is_total, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
           FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
        None,
    ),
    "g_cube": (
        "orders",
        """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
        None,
    ),
    "g_grouping_sets": (
        "documents",
        """SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
           FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""",
        None,
    ),
    "g_stats": (
        "lineitem",
        """SELECT l_returnflag, round(percentile(l_extendedprice, 0.5), 3) AS median_price,
                  round(percentile(l_quantity, 0.9), 3) AS q90, round(stddev_samp(l_quantity), 6) AS sd,
                  round(var_pop(l_tax), 6) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS correlation
           FROM lineitem GROUP BY l_returnflag""",
        """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 3) AS median_price,
                  round(quantile_cont(l_quantity, 0.9), 3) AS q90, round(stddev_samp(l_quantity), 6) AS sd,
                  round(var_pop(l_tax), 6) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS correlation
           FROM lineitem GROUP BY l_returnflag""",
    ),
    "g_window_rank": (
        "orders",
        """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER p AS BIGINT) AS rk,
                  CAST(dense_rank() OVER p AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quarter,
                  lag(o_totalprice) OVER w AS previous, lead(o_orderkey, 2) OVER w AS second_next,
                  first_value(o_orderkey) OVER w AS first_key
           FROM orders
           WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
                  p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
        None,
    ),
    "g_window_frame": (
        "events",
        """SELECT event_id, CAST(count(*) OVER r AS BIGINT) AS day_count, round(sum(value) OVER s, 4) AS last_three,
                  max(value) OVER t AS running_max
           FROM events
           WINDOW r AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW),
                  s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
                  t AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        None,
    ),
    "g_topk": (
        "orders",
        """SELECT o_orderstatus, o_orderkey, o_totalprice FROM (
             SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) ranked
           WHERE rn <= 10""",
        None,
    ),
    "g_order_limit": (
        "part",
        """SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 25""",
        None,
    ),
    "g_setops": (
        "customer supplier nation",
        """WITH anywhere AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier),
                supplied AS (SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier),
                solvent AS (SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < 0)
           SELECT k FROM anywhere UNION ALL SELECT k FROM supplied UNION ALL SELECT k FROM solvent""",
        None,
    ),
    "g_string": (
        "pages",
        r"""SELECT page_id, lower(url) AS low, CAST(length(html) AS BIGINT) AS chars, substring(url, 1, 12) AS head,
                  regexp_extract(url, '^https?://([^/]+)', 1) AS host, replace(url, 'example', 'sample') AS renamed,
                  concat_ws('|', upper(substring(url, 1, 4)), CAST(page_id AS STRING)) AS tag,
                  regexp_replace(url, '[0-9]+', '#') AS masked, url LIKE 'https%' AS secure
           FROM pages""",
        r"""SELECT page_id, lower(url) AS low, CAST(length(html) AS BIGINT) AS chars, substring(url, 1, 12) AS head,
                  regexp_extract(url, '^https?://([^/]+)', 1) AS host, replace(url, 'example', 'sample') AS renamed,
                  concat_ws('|', upper(substring(url, 1, 4)), CAST(page_id AS VARCHAR)) AS tag,
                  regexp_replace(url, '[0-9]+', '#', 'g') AS masked, url LIKE 'https%' AS secure
           FROM pages""",
    ),
    "g_date": (
        "events",
        """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, count(*) AS n, CAST(min(extract(minute FROM ts)) AS BIGINT) AS first_minute,
                  max(CAST(ts AS DATE)) AS day, max(ts + INTERVAL '1' DAY) AS next_day
           FROM events GROUP BY date_trunc('hour', ts)""",
        """SELECT date_trunc('hour', ts) AS hour, count(*) AS n, CAST(min(extract(minute FROM ts)) AS BIGINT) AS first_minute,
                  max(CAST(ts AS DATE)) AS day, max(ts + INTERVAL '1' DAY) AS next_day
           FROM events GROUP BY date_trunc('hour', ts)""",
    ),
    "g_math": (
        "lineitem",
        """SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 6) AS root, CAST(floor(l_extendedprice) AS BIGINT) AS low,
                  CAST(ceil(l_extendedprice) AS BIGINT) AS high, round(ln(l_quantity + 1), 6) AS log, abs(l_tax - l_discount) AS gap,
                  l_orderkey % 10 AS digit, round(power(l_quantity, 2), 2) AS square, greatest(l_tax, l_discount) + 0.0 AS larger
           FROM lineitem""",
        None,
    ),
    "g_array": (
        "embeddings",
        """SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS norm,
                  CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive, round(array_max(embedding), 5) AS largest
           FROM embeddings""",
        """SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm,
                  len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_max(embedding), 5) AS largest
           FROM embeddings""",
    ),
    "g_unnest": (
        "embeddings",
        """SELECT label, CAST(pos AS BIGINT) AS pos, count(*) AS n, CAST(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive
           FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x GROUP BY label, pos""",
        """SELECT label, pos, count(*) AS n, CAST(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive
           FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos""",
    ),
    "g_json": (
        "events",
        """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k INT').k * 2 AS doubled,
                  get_json_object(props, '$.missing') IS NULL AS absent FROM events""",
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS INT) * 2 AS doubled,
                  json_extract(props, '$.missing') IS NULL AS absent FROM events""",
    ),
    "g_variant": (
        "events",
        """SELECT event_id, variant_get(doc, '$.k', 'INT') AS k, try_variant_get(doc, '$.missing', 'STRING') IS NULL AS absent,
                  CAST(doc:k AS BIGINT) * 2 AS doubled, try_variant_get(doc, '$', 'INT') IS NULL AS no_number, is_variant_null(parse_json('null')) AS is_null,
                  schema_of_variant(doc) AS shape, (SELECT schema_of_variant_agg(parse_json(props)) FROM events) AS common_shape
           FROM (SELECT event_id, parse_json(props) AS doc FROM events)""",
        """WITH d AS (SELECT event_id, CAST(props AS JSON) AS doc FROM events),
                f AS (SELECT event_id, key || ': ' || CASE json_type(doc, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(doc, '$.' || key) END AS field
                      FROM d, unnest(json_keys(doc)) u(key))
           SELECT event_id, CAST(doc->'k' AS INT) AS k, (doc->'missing') IS NULL AS absent, CAST(doc->'k' AS BIGINT) * 2 AS doubled,
                  try_cast(CAST(doc AS VARCHAR) AS INT) IS NULL AS no_number, json_type('null'::JSON) = 'NULL' AS is_null,
                  'OBJECT<' || (SELECT string_agg(field, ', ' ORDER BY field) FROM f WHERE f.event_id = d.event_id) || '>' AS shape,
                  'OBJECT<' || (SELECT string_agg(DISTINCT field, ', ' ORDER BY field) FROM f) || '>' AS common_shape
           FROM d""",
    ),
    "g_map": (
        "events",
        """WITH per AS (SELECT user_id, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY user_id, event_type),
                maps AS (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS counts,
                                map_from_entries(collect_list(struct(event_type, cents))) AS sums FROM per GROUP BY user_id),
                worked AS (SELECT user_id, counts, map_zip_with(sums, counts, (k, s, n) -> s / n) AS means, transform_values(counts, (k, n) -> n * 2) AS doubled,
                                  transform_keys(counts, (k, n) -> upper(k)) AS loud, map_filter(counts, (k, n) -> n > 1) AS several FROM maps)
           SELECT user_id, event_type, mean, CAST(cardinality(counts) AS BIGINT) AS kinds, element_at(doubled, event_type) AS doubled, loud[upper(event_type)] AS n,
                  map_contains_key(several, event_type) AS again, array_contains(map_keys(map_concat(counts, map('none', CAST(0 AS BIGINT)))), 'none') AS added
           FROM worked LATERAL VIEW explode(means) m AS event_type, mean""",
        """SELECT user_id, event_type, CAST(round(sum(value) * 100) AS BIGINT) / count(*) AS mean, count(*) OVER (PARTITION BY user_id) AS kinds, count(*) * 2 AS doubled,
                  count(*) AS n, count(*) > 1 AS again, true AS added FROM events GROUP BY user_id, event_type""",
    ),
    "g_struct": (
        "orders",
        """WITH s AS (SELECT o_orderstatus, named_struct('price', o_totalprice, 'key', o_orderkey) AS top,
                             named_struct('y', CAST(extract(year FROM o_orderdate) AS INT), 'q', CAST(quarter(o_orderdate) AS INT)) AS period FROM orders),
                g AS (SELECT o_orderstatus, period, max(top) AS best, min(top) AS least, count(*) AS n FROM s GROUP BY o_orderstatus, period)
           SELECT o_orderstatus, period.y AS y, period.q AS q, best.key AS best_key, least.price AS least_price, side, amount
           FROM g LATERAL VIEW inline(array(struct('best' AS k, best.price AS v), struct('n' AS k, CAST(n AS DOUBLE) AS v))) i AS side, amount""",
        """WITH g AS (SELECT o_orderstatus, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q,
                             max({'price': o_totalprice, 'key': o_orderkey}) AS best, min(o_totalprice) AS least_price, count(*) AS n FROM orders GROUP BY ALL)
           SELECT o_orderstatus, y, q, best.key AS best_key, least_price, 'best' AS side, best.price AS amount FROM g
           UNION ALL SELECT o_orderstatus, y, q, best.key, least_price, 'n', CAST(n AS DOUBLE) FROM g""",
    ),
    "g_approx": (
        "lineitem",
        f"""WITH sketches AS (
             SELECT l_returnflag AS flag, approx_count_distinct(l_partkey, 0.02) AS estimate, hll_sketch_estimate(hll_sketch_agg(l_partkey, 12)) AS sketch,
                    approx_percentile(l_extendedprice, 0.5, 1000) AS median,
                    CASE WHEN count(l_quantity) > 0 THEN kll_sketch_get_quantile_double(kll_sketch_agg_double(l_quantity), CAST(0.9 AS DOUBLE)) END AS most
             FROM lineitem GROUP BY l_returnflag),
           ranked AS (
             SELECT /*+ BROADCAST(sketches) */ flag, estimate, sketch, {between_percentiles("l_extendedprice", "median", 0.48, 0.52)} AS middle, {between_percentiles("l_quantity", "most", 0.86, 0.94)} AS upper_end
             FROM lineitem JOIN sketches ON l_returnflag <=> flag GROUP BY flag, estimate, sketch, median, most),
           exact AS (SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag)
           SELECT l_returnflag, parts, abs(estimate - parts) <= 0.15 * parts AS counted, abs(sketch - parts) <= 0.15 * parts AS sketched, middle, upper_end
           FROM exact JOIN ranked ON l_returnflag <=> flag""",
        """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS counted,
                  true AS sketched, approx_quantile(l_extendedprice, 0.5) BETWEEN quantile_cont(l_extendedprice, 0.48) AND quantile_cont(l_extendedprice, 0.52) AS middle,
                  approx_quantile(l_quantity, 0.9) BETWEEN quantile_cont(l_quantity, 0.86) AND quantile_cont(l_quantity, 0.94) AS upper_end
           FROM lineitem GROUP BY l_returnflag""",
    ),
    "g_cte": (
        "orders nation",
        """WITH RECURSIVE months AS (SELECT 1 AS m UNION ALL SELECT m + 1 FROM months WHERE m < 12),
                by_month AS (SELECT CAST(extract(month FROM o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1)
           SELECT months.m, coalesce(by_month.n, 0) AS n FROM months LEFT JOIN by_month ON months.m = by_month.m""",
        None,
    ),
    "g_pivot": (
        "orders",
        """SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders)
           PIVOT (count(1) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""",
        """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
                  count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""",
    ),
    "g_unpivot": (
        "labels",
        """SELECT * FROM labels UNPIVOT (flag FOR name IN (quality, toxic))""",
        """SELECT doc_id, 'quality' AS name, quality AS flag FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""",
    ),
    "g_lateral": (
        "customer orders",
        """SELECT c_custkey, s.n, s.largest FROM customer,
             LATERAL (SELECT count(*) AS n, max(o_totalprice) AS largest FROM orders WHERE o_custkey = c_custkey) s""",
        """SELECT c_custkey, coalesce(n, 0) AS n, largest FROM customer
           LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    ),
}


def _shared(name, spark, sf_dir):
    tables, text, _ = SHARED[name]
    return sql(spark, sf_dir, text, *tables.split())


def scan_parquet(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_extendedprice").filter("l_quantity > 25")


def sql_readonly(spark, sf_dir):
    text = 'SELECT "o_orderstatus", count(*) AS n, max(o_totalprice) AS top FROM parquet_data GROUP BY 1 ;; '
    return query.run_sql(spark, load(spark, sf_dir, "orders"), text)


def page(spark, sf_dir):
    return query.page(load(spark, sf_dir, "orders"), ["o_custkey"], 2000, 1000).rows


def page_after(spark, sf_dir):
    return query.page_after(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], {"o_custkey": 700, "o_orderkey": 5000}, 500)


def _quick(group, func, metric, spark, sf_dir):
    return query.quick_aggregate(load(spark, sf_dir, "lineitem"), group, func, metric, 200)


def _sorted(direction, spark, sf_dir):
    return query.sorted_positions(mixed_events(spark, sf_dir), "mixed", direction)


def choose_columns(spark, sf_dir):
    return query.choose_columns(load(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey", "c_mktsegment"])


def schema_search(spark, sf_dir):
    found = schema.search_columns(schema.parquet_schema(spark, sf_dir), "PRICE")
    return found.select(file_name("file").alias("file"), "name", "physical_type")


def numeric_columns(spark, sf_dir):
    return query.numeric_columns(mixed_events(spark, sf_dir)).select("column")


def page_deep(spark, sf_dir):
    """A page that begins after three quarters of the table."""
    pages = query.open_pages(load(spark, sf_dir, "lineitem"), ["l_shipdate"])
    return pages.rows(pages.total * 3 // 4, 500)


def asof_join(spark, sf_dir):
    views = load(spark, sf_dir, "events").filter("event_type = 'view'").selectExpr("user_id AS v_user", "ts AS v_ts", "event_id AS v_event")
    return asof.asof_join(load(spark, sf_dir, "events"), views, "ts", "v_ts", "user_id", "v_user", "left").select("event_id", "v_event", "v_ts")


def asof_join_inner(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    errors = events.filter("event_type = 'error'").selectExpr("user_id AS e_user", "ts AS e_ts", "value AS e_value")
    joined = asof.asof_join(events.filter("event_type = 'purchase'"), errors, "ts", "e_ts", "user_id", "e_user")
    return joined.select("event_id", "e_ts", "e_value")


def range_join(spark, sf_dir):
    bands = load(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    joined = asof.range_join(load(spark, sf_dir, "customer"), "c_acctbal", bands, "low", "high")
    return joined.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last_customer"))


QUERIES = {name: partial(_shared, name) for name in SHARED} | {
    "scan_parquet": scan_parquet,
    "sql_readonly": sql_readonly,
    "page": page,
    "page_after": page_after,
    "page_deep": page_deep,
    "quick_agg_count": partial(_quick, "l_partkey", "count", None),
    "quick_agg_sum": partial(_quick, "l_partkey", "sum", "l_quantity"),
    "quick_agg_avg": partial(_quick, "l_partkey", "avg", "l_quantity"),
    "quick_agg_min": partial(_quick, "l_partkey", "min", "l_extendedprice"),
    "quick_agg_max": partial(_quick, "l_partkey", "max", "l_extendedprice"),
    "quick_agg_global": partial(_quick, None, "sum", "l_quantity"),
    "sort_asc": partial(_sorted, "asc"),
    "sort_desc": partial(_sorted, "desc"),
    "choose_columns": choose_columns,
    "schema_search": schema_search,
    "numeric_columns": numeric_columns,
    "asof_join": asof_join,
    "asof_join_inner": asof_join_inner,
    "g_range_join": range_join,
}


def _quick_twin(func: str, metric: str, alias: str) -> str:
    return f"SELECT l_partkey, {func}({metric}) AS {alias} FROM lineitem GROUP BY l_partkey ORDER BY {alias} DESC NULLS LAST, l_partkey LIMIT 200"


def _sort_twin(direction: str) -> str:
    nulls = "NULLS FIRST" if direction == "DESC" else "NULLS LAST"
    keys = ", ".join(f"{k} {direction} {nulls}" for k in ("rank", "number", "moment", "words"))
    ties = ", ".join(f"{c} NULLS LAST" for c in MIXED_COLUMNS)
    return f"""
    WITH src AS ({MIXED_TWIN}),
    keyed AS (SELECT *, CASE WHEN regexp_matches(mixed, '{NUMBER}') THEN TRY_CAST(mixed AS DOUBLE) END AS number,
                     CASE WHEN regexp_matches(mixed, '{DATE}') THEN TRY_CAST(mixed AS TIMESTAMP) END AS stamp FROM src),
    ranked AS (SELECT *, CASE WHEN mixed IS NULL THEN 3 WHEN number IS NOT NULL THEN 0 WHEN stamp IS NOT NULL THEN 1 ELSE 2 END AS rank,
                      CASE WHEN number IS NULL THEN stamp END AS moment FROM keyed)
    SELECT row_number() OVER (ORDER BY {keys}, {ties}) - 1 AS position, {', '.join(MIXED_COLUMNS)}
    FROM (SELECT *, CASE WHEN rank = 2 THEN mixed END AS words FROM ranked)"""


ORACLES = {name: twin or text for name, (_, text, twin) in SHARED.items()} | {
    "scan_parquet": "SELECT l_orderkey, l_shipdate, l_extendedprice FROM lineitem WHERE l_quantity > 25",
    "sql_readonly": "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1",
    "page": """SELECT * FROM orders ORDER BY o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
               LIMIT 1000 OFFSET 2000""",
    "page_after": """SELECT * FROM orders WHERE o_custkey > 700 OR (o_custkey = 700 AND o_orderkey > 5000)
                     ORDER BY o_custkey, o_orderkey LIMIT 500""",
    "quick_agg_count": _quick_twin("count", "*", "row_count"),
    "quick_agg_sum": _quick_twin("sum", "l_quantity", "sum_l_quantity"),
    "quick_agg_avg": _quick_twin("avg", "l_quantity", "avg_l_quantity"),
    "quick_agg_min": _quick_twin("min", "l_extendedprice", "min_l_extendedprice"),
    "quick_agg_max": _quick_twin("max", "l_extendedprice", "max_l_extendedprice"),
    "quick_agg_global": "SELECT sum(l_quantity) AS sum_l_quantity FROM lineitem",
    "sort_asc": _sort_twin("ASC"),
    "sort_desc": _sort_twin("DESC"),
    "choose_columns": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "schema_search": f"""SELECT regexp_extract(file_name, '[^/]+$') AS file, name, type AS physical_type
                         FROM parquet_schema('{CHECK_DIR}/*.parquet') WHERE num_children IS NULL AND contains(lower(name), 'price')""",
    "numeric_columns": "SELECT \"column\" FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS n FROM ({MIXED_TWIN}) WHERE regexp_matches(CAST({c} AS VARCHAR), '{NUMBER}')"
            for c in MIXED_COLUMNS
        ]
    )
    + ") WHERE n > 0",
    "page_deep": """SELECT * EXCLUDE (place) FROM (
          SELECT *, row_number() OVER (ORDER BY l_shipdate NULLS LAST, l_orderkey NULLS LAST, l_partkey NULLS LAST, l_suppkey NULLS LAST, l_linenumber NULLS LAST,
                 l_quantity NULLS LAST, l_extendedprice NULLS LAST, l_discount NULLS LAST, l_tax NULLS LAST, l_returnflag NULLS LAST, l_linestatus NULLS LAST) - 1 AS place,
          FROM lineitem) WHERE place >= (SELECT count(*) * 3 // 4 FROM lineitem) AND place < (SELECT count(*) * 3 // 4 + 500 FROM lineitem)""",
    "asof_join": """SELECT e.event_id, v.v_event, v.v_ts FROM events e ASOF LEFT JOIN
                    (SELECT user_id AS v_user, ts AS v_ts, event_id AS v_event FROM events WHERE event_type = 'view') v
                    ON e.user_id = v.v_user AND e.ts >= v.v_ts""",
    "asof_join_inner": """SELECT p.event_id, e.ts AS e_ts, e.value AS e_value
                          FROM (SELECT * FROM events WHERE event_type = 'purchase') p
                          ASOF JOIN (SELECT * FROM events WHERE event_type = 'error') e ON p.user_id = e.user_id AND p.ts >= e.ts""",
    "g_range_join": """WITH bands AS (SELECT p_type, p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY ALL)
                       SELECT p_type, p_brand, count(*) AS n, max(c_custkey) AS last_customer
                       FROM customer JOIN bands ON c_acctbal BETWEEN low AND high GROUP BY p_type, p_brand""",
}
