"""Relations of a catalog, workbooks, edited copies, listings: what lies behind a path or a name."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from tablecheck.operators import compare, dataset, doctor, edits, schema
from tablecheck.plans.files import access_settings, file_system
from tablecheck.plans.small import small_frame
from tablecheck.plans.storage import scratch_folder, shuffle_partitions, stored
from tablecheck.sinks import export
from tablecheck.sources import catalog, options, tables

from .common import diff_pair, load

# Relations of the schema that is made for a query: a table and views over two tables.
RELATIONS = {"region_rows": ("region", "BASE TABLE"), "nation_rows": ("nation", "VIEW"), "supplier_rows": ("supplier", "VIEW")}


class _Schema:
    """A schema of a query's own, which is gone when the query's result is stored."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self.name = spark, sf_dir, f"tables_{uuid.uuid4().hex[:12]}"

    def __enter__(self):
        folder = scratch_folder(self.spark)
        self.spark.sql(f"CREATE SCHEMA {self.name} LOCATION '{folder}'")
        for name, (source, kind) in RELATIONS.items():
            if kind == "VIEW":
                self.spark.sql(f"CREATE VIEW {self.name}.{name} AS SELECT * FROM parquet.`{self.sf_dir}/{source}.parquet`")
            else:
                load(self.spark, self.sf_dir, source).write.option("path", f"{folder}/{name}").saveAsTable(f"{self.name}.{name}")
        return self

    def __exit__(self, *_):
        self.spark.sql(f"DROP SCHEMA {self.name} CASCADE")

    def relations(self):
        return catalog.list_relations(self.spark).filter(F.col("schema") == self.name)


def relations(spark, sf_dir):
    """Every relation of a schema with the number of its rows."""
    with _Schema(spark, sf_dir) as own:
        found = own.relations()
        counted = [catalog.open_relation(spark, r).agg(F.lit(r["name"]).alias("n"), F.count("*").alias("n_rows")) for r in found.collect()]
        rows = counted[0]
        for more in counted[1:]:
            rows = rows.unionByName(more)
        return stored(found.join(rows, F.col("name") == F.col("n")).select("name", "type", "n_rows"))


def select_relation(spark, sf_dir):
    """Rows of the relation that is chosen by its name."""
    with _Schema(spark, sf_dir) as own:
        chosen = catalog.select_relation(own.relations(), {"name": "nation_rows", "database": "another"})
        return stored(catalog.open_relation(spark, chosen))


def catalog_check(spark, sf_dir):
    """The check of a catalog with several relations, and of the data of one."""
    with _Schema(spark, sf_dir) as own:
        found = doctor.catalog_check(own.relations(), f"{own.name}.nation_rows")
        quality = doctor.health(doctor.doctor_table(spark.table(f"{own.name}.nation_rows"))).select("errors", "warnings")
        return stored(found.select("tables", "views", F.array_join("issues", ",").alias("issues")).crossJoin(F.broadcast(quality)))


def export_all_relations(spark, sf_dir):
    """All relations of a schema exported, and read again."""
    folder = scratch_folder(spark)
    with _Schema(spark, sf_dir) as own:
        chosen = own.relations().orderBy("name").collect()
        done = export.export_relations(spark, chosen, folder, "parquet")
    told = small_frame(spark, [(r["name"], d.rows, d.files > 0) for r, d in zip(chosen, done)], "name string, told_rows bigint, has_files boolean")
    back = [spark.read.parquet(d.path).agg(F.lit(r["name"]).alias("n"), F.count("*").alias("n_rows")) for r, d in zip(chosen, done)]
    rows = back[0]
    for more in back[1:]:
        rows = rows.unionByName(more)
    return told.join(rows, F.col("name") == F.col("n")).select("name", "told_rows", "n_rows", "has_files")


def _sheet(rows: list[list[str | None]]) -> bytes:
    """A workbook of text cells, whose texts are shared."""
    texts: dict[str, int] = {}
    lines = []
    for number, row in enumerate(rows, 1):
        cells = [f'<c t="s"><v>{texts.setdefault(v, len(texts))}</v></c>' if v else "<c/>" for v in row]
        lines.append(f'<row r="{number}">{"".join(cells)}</row>')
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    link = f'<Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/s.xml"/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="t" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{link}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(t)}</t></si>" for t in texts)}</sst>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks_scan(spark, sf_dir):
    """Orders written as workbooks, one by each task for each status, and read as one table with inferred types."""
    folder, settings = scratch_folder(spark), access_settings(spark)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    columns = orders.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for status, rows in batch.groupby("o_orderstatus"):
                cells = [[None if v is None else str(v) for v in row] for row in rows[columns].itertuples(index=False)]
                system, inner = file_system(f"{folder}/{status}-{uuid.uuid4().hex}.xlsx", settings)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as sink:
                    sink.write(_sheet([columns, *cells]))
                yield pd.DataFrame({"written": [len(rows)]})

    spread = orders.repartition(shuffle_partitions(spark), "o_orderkey").select(*[F.col(c).cast("string").alias(c) for c in columns])
    spread.mapInPandas(write, "written long").agg(F.sum("written")).first()
    found = tables.read_table(spark, folder, {"format": "workbook", "infer_types": True, "only_workbooks": True})
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in orders.dtypes])


def reader_options(spark, sf_dir):
    """A file with a delimiter, quote and null text of its own, read by its options; the options that apply are echoed beside the rows."""
    path = f"{scratch_folder(spark)}/customer.csv"
    given = {"delimiter": ";", "quote": "'", "null_string": "NONE"}
    customer = load(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    customer.write.option("header", True).option("sep", ";").option("quote", "'").option("nullValue", "NONE").csv(path)
    echoed = options.normalize_options("csv", given)
    back = tables.read_table(spark, path, given)
    return back.select("c_custkey", "c_name", "c_mktsegment", *[F.lit(str(v)).alias(f"option_{k}") for k, v in sorted(echoed.items())])


def saved_copy(spark, sf_dir):
    """Orders with edited cells and a deleted row, saved beside the source and read back."""
    orders = load(spark, sf_dir, "orders")
    wanted = orders.filter("o_orderkey % 50 = 0").select(
        F.when(F.col("o_orderkey") % 100 == 0, "delete").otherwise("update").alias("op"), F.col("o_orderkey").cast("string").alias("key"),
        F.when(F.col("o_orderkey") % 100 != 0, "o_totalprice").alias("column"), F.when(F.col("o_orderkey") % 100 != 0, "1.5").alias("value"),
    )
    path = f"{scratch_folder(spark)}/orders_edited.parquet"
    export.save_edited_copy(edits.apply_edits(orders, wanted, "o_orderkey").rows, f"{sf_dir}/orders.parquet", path)
    return tables.read_table(spark, path)


def nested_fields(spark, sf_dir):
    """Number of nested fields of the embeddings, beside the rows and values that the nested column holds."""
    vectors = load(spark, sf_dir, "embeddings")
    held = vectors.agg(F.count("*").alias("n_rows"), F.sum(F.size("embedding")).alias("n_values"))
    return schema.nested_field_count(schema.schema_columns(vectors)).toDF("nested_fields").crossJoin(F.broadcast(held))


def unreadable_files(spark, sf_dir):
    """A copy of a table, and the same file cut in half: the cut one is listed with its error, the other with its rows."""
    folder = scratch_folder(spark)
    load(spark, sf_dir, "nation").coalesce(1).write.parquet(f"{folder}/whole")
    settings = access_settings(spark)
    source = spark.read.format("binaryFile").load(f"{folder}/whole").select("content").first()["content"]  # one small file
    system, inner = file_system(f"{folder}/cut/cut.parquet", settings)
    system.create_dir(inner.rsplit("/", 1)[0])
    with system.open_output_stream(inner) as sink:
        sink.write(bytes(source[: len(source) // 2]))
    scan = dataset.scan_dataset(spark, folder)
    return scan.select("partition_dir", "row_count", F.col("error").isNotNull().alias("unreadable"))


def compared_columns(spark, sf_dir):
    """Columns of two versions of orders side by side, with the filled values of each."""
    base, other = diff_pair(spark, sf_dir)
    found = compare.compare_metadata(base, other).select("side", "pos", "column", "data_type", "nullable_status", "type_signature")
    filled = None
    for side, df in (("base", base), ("compare", other)):
        items = F.array(*[F.struct(F.lit(c).alias("c"), F.count(c).alias("filled")) for c in df.columns])
        one = df.agg(items.alias("items")).select(F.lit(side).alias("s"), F.inline("items"))
        filled = one if filled is None else filled.unionByName(one)
    return found.join(filled, (F.col("side") == F.col("s")) & (F.col("column") == F.col("c"))).drop("s", "c")


def strict_mapping(spark, sf_dir):
    """Rows compared over a mapping that is accepted, and the reasons why others are not."""
    base, other = diff_pair(spark, sf_dir)
    mapping = [("o_orderkey", "o_orderkey"), ("o_custkey", "oCustKey"), ("o_totalprice", "o_totalprice")]
    pairs = compare.check_mapping(base, other, mapping)
    left = base.select(*[F.col(p.base).alias(p.display) for p in pairs])
    right = other.select(*[F.col(p.compare).alias(p.display) for p in pairs])
    shared = left.intersect(right).agg(F.count("*").alias("n")).select(F.lit("accepted").alias("mapping"), F.lit(None).cast("string").alias("refused"), "n")
    refusals = []
    for name, wrong in (("unlike_types", [("o_orderkey", "o_orderpriority")]), ("no_column", [("o_orderkey", "gone")]), ("used_twice", [("o_orderkey", "o_orderkey"), ("o_custkey", "o_orderkey")]), ("strict", None)):
        try:
            compare.check_mapping(base, other, wrong)
        except ValueError as problem:
            refusals.append((name, str(problem), None))
    return shared.unionByName(small_frame(spark, refusals, "mapping string, refused string, n bigint"))


QUERIES = {
    "relations": relations,
    "select_relation": select_relation,
    "catalog_check": catalog_check,
    "export_all_relations": export_all_relations,
    "workbooks_scan": workbooks_scan,
    "reader_options": reader_options,
    "saved_copy": saved_copy,
    "nested_fields": nested_fields,
    "unreadable_files": unreadable_files,
    "compare_metadata": compared_columns,
    "strict_mapping": strict_mapping,
}

_COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS name, '{kind}' AS type, count(*) AS n_rows FROM {source}" for name, (source, kind) in RELATIONS.items())

ORACLES = {
    "relations": _COUNTS,
    "select_relation": "SELECT * FROM nation",
    "catalog_check": """SELECT CAST(1 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS views, 'several_relations' AS issues, CAST(0 AS BIGINT) AS errors,
        (SELECT count(*) FROM (SELECT unnest([count(*) FILTER (n_name = ''), CASE WHEN max(n_nationkey) = 0 THEN 1 ELSE 0 END, CASE WHEN max(n_regionkey) = 0 THEN 1 ELSE 0 END]) AS bad FROM nation) WHERE bad > 0)
        + (SELECT CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM nation)) THEN 1 ELSE 0 END FROM nation) AS warnings""",
    "export_all_relations": f"SELECT name, n_rows AS told_rows, n_rows, true AS has_files FROM ({_COUNTS})",
    "workbooks_scan": "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders",
    "reader_options": """SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, ';' AS option_delimiter, 'utf-8' AS option_encoding, '"' AS option_escape, 'True' AS option_header,
        'NONE' AS option_null_string, '''' AS option_quote FROM customer""",
    "saved_copy": """SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 THEN 1.5 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 100 <> 0""",
    "nested_fields": "SELECT CAST(1 AS BIGINT) AS nested_fields, count(*) AS n_rows, CAST(sum(len(embedding)) AS BIGINT) AS n_values FROM embeddings",
    "unreadable_files": "SELECT 'whole' AS partition_dir, count(*) AS row_count, false AS unreadable FROM nation UNION ALL SELECT 'cut', NULL, true",
    "compare_metadata": """WITH cols AS (SELECT row_number() OVER () - 1 AS pos, column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS t,
            CASE column_type WHEN 'VARCHAR' THEN 'TEXT' WHEN 'TIMESTAMP' THEN 'TEMPORAL' ELSE 'NUMERIC' END AS s FROM (DESCRIBE SELECT * FROM orders)),
        n AS (SELECT unnest([count(o_orderkey), count(o_custkey), count(o_orderstatus), count(o_totalprice), count(o_orderdate), count(o_orderpriority)]) AS filled,
                     unnest(range(6)) AS pos,
                     unnest([count(o_orderkey) FILTER (k), count(o_custkey) FILTER (k), count(o_orderstatus) FILTER (k), count(o_totalprice) FILTER (k), count(o_orderdate) FILTER (k), count(o_orderpriority) FILTER (k)]) AS later
              FROM (SELECT *, extract(day FROM o_orderdate) <> 13 AS k FROM orders UNION ALL SELECT * REPLACE (NULL AS o_orderkey, NULL AS o_custkey, NULL AS o_orderstatus, NULL AS o_totalprice, NULL AS o_orderdate, NULL AS o_orderpriority), false FROM orders WHERE false)),
        again AS (SELECT count(*) AS m FROM orders WHERE extract(day FROM o_orderdate) = 21)
        SELECT 'base' AS side, CAST(pos AS INT) AS pos, c AS "column", t AS data_type, 'nullable' AS nullable_status, s AS type_signature, filled FROM cols JOIN n USING (pos)
        UNION ALL SELECT 'compare', CAST(pos AS INT), CASE c WHEN 'o_custkey' THEN 'oCustKey' ELSE c END, t, 'nullable', s, later + m FROM cols JOIN n USING (pos), again""",
    "strict_mapping": """SELECT 'accepted' AS mapping, CAST(NULL AS VARCHAR) AS refused, count(*) AS n FROM (
            SELECT DISTINCT o_orderkey, o_custkey, o_totalprice FROM orders WHERE extract(day FROM o_orderdate) NOT IN (7, 13))
        UNION ALL SELECT * FROM (VALUES ('unlike_types', 'Mapping: ''o_orderkey'' and ''o_orderpriority'' are of different types.', CAST(NULL AS BIGINT)),
            ('no_column', 'Mapping: the compare table has no column ''gone''.', NULL), ('used_twice', 'Mapping: compare column ''o_orderkey'' is used more than once.', NULL),
            ('strict', 'Without a mapping both tables need the same columns in the same order.', NULL))""",
}
