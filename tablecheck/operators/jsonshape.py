"""JSON text columns as tables: shape, type names, validity, compact form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..plans.spreading import spread


def _type_name(shape: Column) -> Column:
    """JSON type from Spark's name of a variant's shape."""
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .otherwise("number")
    )


def _text(value: Column) -> Column:
    """Text without quotes for strings, compact JSON for the rest."""
    shape = F.schema_of_variant(value)
    return F.when(shape == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def json_to_table(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """``id, mode, row_index, key, type, value`` of each JSON document.

    An array of objects gives its records (``records``: a row per field,
    ``row_index`` is the record), another array its elements (``values``), an
    object its fields (``object``), anything else itself (``scalar``). Invalid
    documents give no rows; see ``json_validate``.
    """
    parsed = spread(df).select(names.col(id_col).alias("id"), F.try_parse_json(names.col(json_col)).alias("doc")).filter("doc IS NOT NULL")
    shape = F.schema_of_variant("doc")
    items = F.col("doc").try_cast("array<variant>")
    records = F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    mode = (
        F.when(shape.startswith("ARRAY"), F.when(records, "records").otherwise("values"))
        .when(shape.startswith("OBJECT"), "object")
        .otherwise("scalar")
    )
    shaped = parsed.select("id", "doc", mode.alias("mode"))
    spark = df.sparkSession

    def exploded(rows: DataFrame) -> DataFrame:
        return rows.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()).toDF("pos", "field", "item"))

    def row(index: Column, key: Column, value: Column) -> list[Column]:
        kind = _type_name(F.schema_of_variant(value))
        return ["id", "mode", index.cast("long").alias("row_index"), key.alias("key"), kind.alias("type"), _text(value).alias("value")]

    no_key = F.lit(None).cast("string")
    outer = exploded(shaped.filter("mode <> 'scalar'"))
    plain = outer.filter("mode <> 'records'").select(*row(F.col("pos"), F.col("field"), F.col("item")))
    scalar = shaped.filter("mode = 'scalar'").select(*row(F.lit(0), no_key, F.col("doc")))
    record = outer.filter("mode = 'records'").select("id", "mode", F.col("pos").alias("record"), F.col("item").alias("doc"))
    fields = exploded(record).select(*row(F.col("record"), F.col("field"), F.col("item")))
    return plain.unionByName(fields).unionByName(scalar)


def json_validate(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """``id, status, minified``: ``valid``/``invalid`` and the compact form of each document."""
    text = names.col(json_col)
    parsed = F.try_parse_json(text)
    status = F.when(parsed.isNull(), "invalid").otherwise("valid")
    return df.select(names.col(id_col).alias("id"), status.alias("status"), F.to_json(parsed).alias("minified"))
