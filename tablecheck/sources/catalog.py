"""Tables and views of the Spark catalog as relations to choose from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas that are never offered, the schema listed first.
SYSTEM_SCHEMAS = ("information_schema", "sys", "global_temp")
MAIN_SCHEMA = "default"

RELATION_SCHEMA = "`database` string, `schema` string, `name` string, `type` string"


def list_relations(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``database, schema, name, type``: the main schema first, then by schema and name.

    ``database`` is a Spark catalog; temporary views are left out.
    """
    current = spark.catalog.currentCatalog()
    catalog = database or current
    rows = []
    try:
        if catalog != current:
            spark.catalog.setCurrentCatalog(catalog)
        for schema in spark.catalog.listDatabases():
            if schema.name in SYSTEM_SCHEMAS:
                continue
            for table in spark.catalog.listTables(schema.name):
                if not table.isTemporary:
                    kind = "VIEW" if "VIEW" in (table.tableType or "") else "BASE TABLE"
                    rows.append((catalog, schema.name, table.name, kind))
    finally:
        if catalog != current:
            spark.catalog.setCurrentCatalog(current)
    found = spark.createDataFrame(rows, RELATION_SCHEMA)
    return found.orderBy((F.col("schema") != MAIN_SCHEMA), "schema", "name")


def select_relation(relations: DataFrame, wanted: Mapping[str, str] | None = None):
    """The first relation that has every stated part; the database part may give way."""
    fields = ("schema", "name", "type", "database")
    stated = {k: v for k, v in (wanted or {}).items() if k in fields and v}
    for parts in (stated, {k: v for k, v in stated.items() if k != "database"}):
        matching = relations
        for field, value in parts.items():
            matching = matching.filter(F.col(field) == value)
        found = matching.take(1)
        if found:
            return found[0]
    raise ValueError(f"There is no such relation: {stated or 'the catalog is empty'}.")


def open_relation(spark: SparkSession, relation) -> DataFrame:
    """The chosen relation as a DataFrame."""
    parts = [relation["database"], relation["schema"], relation["name"]]
    return spark.table(".".join("`" + p.replace("`", "``") + "`" for p in parts if p))
