"""Arrow IPC (files and streams) and Feather: planned, read, written and committed in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.files import access_settings, any_case, file_system, files_to_open, list_files, open_file, opens_directly, qualified
from ..plans.shipping import ship_package
from ..plans.storage import stored

EXTENSIONS = (".arrow", ".ipc", ".feather")
# Batches read by one task, and bytes of small files that share one.
BATCHES_PER_SPAN = 16
BYTES_PER_TASK = 128 << 20

_SPANS = "path string, start int, `end` int, bytes bigint, error string"


def open_layout(source):
    """(reader, is a file): the file layout first, then the stream layout."""
    try:
        return pa.ipc.open_file(source), True
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source), False


def _spans(files: DataFrame) -> DataFrame:
    """A row for every few batches of each file, from its footer; with ``end`` -1 all of it, as streams have no footer."""
    settings = access_settings(files.sparkSession)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size in zip(batch["path"], batch["file_size"]):
                try:
                    with open_file(path, settings) as source:
                        reader, is_file = open_layout(source)
                        count = reader.num_record_batches if is_file else -1
                    starts = range(0, count, BATCHES_PER_SPAN) if is_file else [0]
                    rows = [(path, i, min(i + BATCHES_PER_SPAN, count), int(size) // max(1, len(starts)), None) for i in starts]
                except Exception as problem:  # raised where the rows are read, as for any other format
                    rows = [(path, 0, -1, int(size), f"{path}: {type(problem).__name__}: {problem}")]
                yield pd.DataFrame(rows, columns=["path", "start", "end", "bytes", "error"])

    return stored(files.select("path", "file_size").mapInPandas(plan, _SPANS))


def _first_schema(files: DataFrame, settings: dict[str, str]) -> StructType:
    """The schema of the first file by name, which stands for all."""
    from pyspark.sql.pandas.types import from_arrow_schema

    first = files.groupBy().agg(F.min_by(F.struct("path", "content"), "path").alias("f")).select("f.*").first()
    if first.path is None:
        raise FileNotFoundError("There is no Arrow file.")
    with open_file(first.path, settings, first.content) as source:
        return from_arrow_schema(open_layout(source)[0].schema)


def read_arrow(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files, folders or globs of Arrow files as one table, with the columns of the first file by name.

    Footers are read in tasks; what they say about batches is a table, whose
    rows are dealt out again, so large files are split and small ones share
    tasks. Files that tasks cannot open come whole through Spark's reader.
    """
    ship_package(spark)
    settings = access_settings(spark)
    roots = [qualified(spark, p) for p in ([path] if isinstance(path, str) else path)]
    names = any_case(*EXTENSIONS)
    files = files_to_open(spark, roots, names)
    schema = _first_schema(files, settings)
    if all(opens_directly(r, settings) for r in roots):
        spans = _spans(files)
        count, size = spans.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        tasks = max(min(count, spark.sparkContext.defaultParallelism), -(-size // BYTES_PER_TASK), 1)
        work = spans.select("path", "start", "end", "error", F.lit(None).cast("binary").alias("content")).repartition(int(tasks))
    else:
        work = files.select("path", F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(None).cast("string").alias("error"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"]:
                    raise OSError(row["error"])
                with open_file(row["path"], settings, row["content"]) as source:
                    reader, is_file = open_layout(source)
                    end = reader.num_record_batches if is_file and row["end"] < 0 else row["end"]
                    for found in (reader.get_batch(i) for i in range(row["start"], end)) if is_file else reader:
                        columns = [found.column(f.name) if f.name in found.schema.names else pa.nulls(len(found), f.type) for f in target]
                        yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type, safe=False) for c, f in zip(columns, target)], schema=target)

    return work.mapInArrow(read, schema)


def write_arrow(rows: DataFrame, path: str, extension: str, mode: str = "errorifexists") -> int:
    """One file of the folder for each task; gives the number of files.

    Attempts write under names of their own in a hidden folder, and tell only
    when they end. What they tell is stored; the files of the attempts that
    count are then moved into place, in tasks, in a step that can be repeated.
    Old files go and ``_SUCCESS`` comes after that.
    """
    spark, schema = rows.sparkSession, rows.schema
    ship_package(spark)
    settings, path = access_settings(spark), qualified(spark, path)
    if not opens_directly(path, settings):
        raise ValueError(f"Tasks cannot write Arrow files to {path!r}; choose a local folder or an object store.")
    system, root = file_system(path, settings)
    old = None
    if _exists(system, root):
        if mode == "errorifexists":
            raise FileExistsError(path)
        if mode == "overwrite":
            old = stored(list_files(spark, path, any_case(*EXTENSIONS)).select("path"))
    job = uuid.uuid4().hex[:12]
    attempts = f"{root}/_attempts-{job}"
    system.create_dir(attempts, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        context, target = TaskContext.get(), to_arrow_schema(schema)
        place, _ = file_system(path, settings)
        name = f"part-{context.partitionId():05d}-{job}.{extension}"
        attempt = f"{attempts}/{context.taskAttemptId()}-{name}"
        options = pa.ipc.IpcWriteOptions(compression="lz4" if extension == "feather" else None)
        with place.open_output_stream(attempt) as sink, pa.ipc.new_file(sink, target, options=options) as writer:
            for batch in batches:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target)], schema=target))
        yield pa.RecordBatch.from_pydict({"attempt": [attempt], "final": [f"{root}/{name}"]})

    told = stored(rows.mapInArrow(write, "attempt string, final string"))
    _in_tasks(told, settings, path, _move)
    if old is not None:
        _in_tasks(old.select(F.col("path").alias("attempt"), F.lit("").alias("final")), settings, path, _remove)
    system.delete_dir(attempts)
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass
    return told.count()


def _exists(system, inner: str) -> bool:
    import pyarrow.fs as pafs

    return system.get_file_info(inner).type != pafs.FileType.NotFound


def _move(system, attempt: str, final: str) -> None:
    if _exists(system, attempt):  # else an earlier try of this task has moved it
        system.move(attempt, final)
    elif not _exists(system, final):
        raise FileNotFoundError(attempt)


def _remove(system, path: str, _: str) -> None:
    inner = file_system(path)[1]
    if _exists(system, inner):
        system.delete_file(inner)


def _in_tasks(pairs: DataFrame, settings: dict[str, str], path: str, use) -> None:
    """``use(system, attempt, final)`` for every row, in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = file_system(path, settings)
        for batch in batches:
            for attempt, final in zip(batch["attempt"], batch["final"]):
                use(system, attempt, final)
            yield pd.DataFrame({"done": [len(batch)]})

    spread = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism)
    spread.mapInPandas(run, "done long").agg(F.sum("done")).first()
