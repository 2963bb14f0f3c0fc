"""Mounting the files of a folder as temporary views."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unique_view_names
from ..plans.files import list_files, qualified, relative_path
from .options import family_of
from .tables import read_table

# Folders that are never entered.
SKIPPED_FOLDERS = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build")
MOUNT_SCHEMA = "`view` string, path string, format string, error string"

_log = logging.getLogger(__name__)


def tables_below(spark: SparkSession, folder: str) -> DataFrame:
    """``path, format`` of every table: supported files, and folders of part files that have one format.

    ``path`` is relative to the folder. Files are listed and put together by
    Spark; a folder that is a table, by its name or by its parts, is not
    entered, so the topmost one counts.
    """
    folder = qualified(spark, folder)
    files = list_files(spark, folder).select(relative_path(folder, F.col("path")).alias("path"))
    parts = F.split("path", "/")
    skipped = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*SKIPPED_FOLDERS))
    files = files.filter(~skipped).withColumn("format", family_of(F.col("path"))).withColumn("depth", F.size(parts) - 1)
    # The folders above each file, the topmost first.
    above = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = files.filter("depth > 0").select("format", F.element_at(above, -1).alias("folder"), F.element_at(parts, -1).startswith("part-").alias("part"))
    parted = inside.filter("part AND format IS NOT NULL").groupBy("folder").agg(F.min("format").alias("format"), F.max("format").alias("most")).filter("format = most")
    placed = files.withColumn("folder", F.explode(F.when(F.col("depth") > 0, above).otherwise(F.array(F.lit(None).cast("string")))))
    placed = placed.join(parted.select("folder", F.col("format").alias("parts_format")), "folder", "left")
    table_format = F.coalesce(family_of(F.col("folder")), "parts_format")
    top = F.min(F.when(table_format.isNotNull(), F.struct(F.length("folder").alias("n"), "folder", table_format.alias("format")))).alias("top")
    found = placed.groupBy("path", "format").agg(top).select(F.coalesce("top.folder", "path").alias("path"), F.coalesce("top.format", "format").alias("format"))
    return found.filter("format IS NOT NULL").distinct()


def mount_folder(spark: SparkSession, folder: str, options: dict[str, dict] | None = None) -> DataFrame:
    """A temporary view per table; gives ``view, path, format, error``.

    ``options`` are reader options by relative path. A table that cannot be
    read is logged and listed with its error.
    """
    base = folder.rstrip("/")
    found = sorted(map(tuple, tables_below(spark, folder).collect()))  # a view each
    rows = []
    for name, (path, family) in zip(unique_view_names(path for path, _ in found), found):
        full = f"{base}/{path}"
        try:
            read_table(spark, full, {**(options or {}).get(path, {}), "format": family}).createOrReplaceTempView(name)
            rows.append((name, path, family, None))
        except Exception as problem:  # one bad file must not hide the others
            _log.warning("cannot mount %s: %s", full, problem)
            rows.append((None, path, family, str(problem).splitlines()[0]))
    return spark.createDataFrame(rows, MOUNT_SCHEMA)
