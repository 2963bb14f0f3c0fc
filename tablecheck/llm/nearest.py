"""Approximate nearest neighbours by cross-polytope hashing, with exact distances.

Unit vectors are turned by pseudo-rotations, three rounds of random signs and a fast Hadamard transform, and hashed to the signed
axis they lie nearest to. ``TABLES`` rotations make as many tables. A query looks into the ``PROBES`` axes that it lies nearest to in each
table; every vector found there is compared exactly, in double precision, on the original vectors.

A bucket (table and axis) is cut into blocks of rows and of queries, so that a bucket that holds a third of all vectors is many
tasks; each block gives back a few rows for each query. Equal vectors are one row with their smallest ids; more than a result can
name are never needed, as ties go to smaller ids. A query that finds fewer rows than asked for although more exist looks into all buckets
of one table, which hold every vector.

Vectors of ``embeddings`` that are null, of another length than most, zero, or hold a null or a number that is not finite take no part, neither
as queries nor as candidates. Rows with equal vec_id are one candidate each; ranks tell them apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from tablecheck.llm.common import checkpointed, map_slices

TABLES = 8
PROBES = 20
#: Rows and queries of a block.
BLOCK = 4_096
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def rotated(vectors: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors after the pseudo-rotation of a table; filled with zeros to a power of two."""
    size = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), size))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng((SEED, table)).choice((-1.0, 1.0), size=(3, size))
    for row in signs:
        x = hadamard(x * row)
    return x


def axes(vectors: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """(vector, table, probe): signed axes, nearest first; axis k is 2k, its opposite 2k + 1."""
    out = []
    for table in range(tables):
        x = rotated(vectors, table)
        signed = np.stack([x, -x], axis=2).reshape(len(x), -1)
        out.append(np.argsort(-signed, axis=1, kind="stable")[:, :probes])
    return np.stack(out, axis=1)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector): those that take part; the vector as bytes of doubles."""
    whole = F.col(column)
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(whole, lambda x: x != 0)
    rows = vectors.select("vec_id", whole.cast("array<double>").alias("embedding")).filter(whole.isNotNull() & F.coalesce(fine, F.lit(False)))
    # One row for each length.
    length = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size("embedding") == (length["length"] if length else 0))

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            # Adding 0 makes -0.0 and 0.0 one value.
            flat = np.asarray(batch.column("embedding").flatten(), dtype=np.float64).reshape(batch.num_rows, -1) + 0.0
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in flat], pa.binary())], names=["vec_id", "vector"])

        return work

    return map_slices(rows, start, StructType([vectors.schema["vec_id"]]).add("vector", BinaryType()))


def _with_axes(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """The rows with ``axes``: for each table the nearest signed axes, in one array."""

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = axes(np.stack([np.frombuffer(v) for v in batch.column("vector").to_pylist()]), tables, probes)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found.reshape(len(found), -1).astype(np.int32)), pa.list_(pa.int32()))], names=[*batch.schema.names, "axes"])

        return work

    return map_slices(rows, start, StructType([*rows.schema.fields]).add("axes", ArrayType(IntegerType())))


def _in_buckets(rows: DataFrame, probes: int) -> DataFrame:
    """A row for each table and axis."""
    placed = rows.select("*", F.posexplode("axes").alias("place", "axis")).drop("axes")
    return placed.withColumn("bucket", F.col("axis") * F.lit(1 << 10) + F.floor(F.col("place") / probes).cast("int")).drop("place", "axis")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """How many blocks the rows of each bucket are cut into: a row for each table and axis at most."""
    return rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


def _nearest_classes(classes: DataFrame, queries: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """(query_id, class, score): for each query the k nearest classes that its buckets hold."""
    base = checkpointed(_in_buckets(_with_axes(classes.select("class", "vector"), tables, 1), 1))
    asked = checkpointed(_in_buckets(_with_axes(queries, tables, probes), probes))
    plan = _blocks(base, "row_blocks").join(_blocks(asked, "query_blocks"), "bucket")
    base = base.join(F.broadcast(plan), "bucket")  # at most tables * 2 * dimensions rows
    asked = asked.join(F.broadcast(plan), "bucket")
    base = base.withColumn("r", F.pmod(F.xxhash64("class"), "row_blocks").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))

    def compare(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(wanted):
            ids = rows["class"].to_numpy()
            x = np.stack([np.frombuffer(v) for v in rows["vector"]])
            for query_id, vector in zip(wanted["query_id"], wanted["vector"], strict=True):
                score = np.sqrt(((x - np.frombuffer(vector)) ** 2).sum(axis=1))
                best = np.lexsort((ids, score))[:k]
                found.append(pd.DataFrame({"query_id": query_id, "class": ids[best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "class": [], "score": []})

    key = ["bucket", "r", "q"]
    kind = classes.schema["class"].dataType.simpleString()
    met = base.select(*key, "class", "vector").groupBy(*key).cogroup(asked.select(*key, "query_id", "vector").groupBy(*key)).applyInPandas(compare, f"query_id {kind}, class {kind}, score double")
    return _first(met.groupBy("query_id", "class").agg(F.min("score").alias("score")), k, "class")


def _first(rows: DataFrame, k: int, tie: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, itself left out."""
    rows = usable(vectors)
    # The ids of a vector that a result can name: k, and the query itself.
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    named = rows.withColumn("nth", F.row_number().over(by_vector)).filter(F.col("nth") <= k + 1)
    classes = checkpointed(named.groupBy("vector").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("members")))
    queries = checkpointed(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct())

    def results(asked: DataFrame, tables: int, probes: int) -> DataFrame:
        near = _nearest_classes(classes, asked, k + 1, tables, probes).drop("rank")
        members = near.join(classes.select("class", "members"), "class")
        # The query's own row is left out once; other rows of its id stay.
        own = F.array_position("members", F.col("query_id")).cast("int")
        others = F.when(own > 0, F.concat(F.slice("members", F.lit(1), own - 1), F.slice("members", own + 1, F.size("members")))).otherwise(F.col("members"))
        found = members.select("query_id", "score", F.explode(others).alias("vec_id"))
        return checkpointed(_first(found, k, "vec_id").select("query_id", "rank", "vec_id", "score"))

    found = results(queries, tables, probes)
    several = classes.select(F.size("members").alias("n")).limit(k + 1).agg(F.sum("n")).first()[0] or 0
    least = min(k, several - 1)
    short = queries.join(found.filter(F.col("rank") >= least), "query_id", "left_anti") if least > 0 else queries.limit(0)
    short = checkpointed(short)
    if short.isEmpty():
        return found
    width = len(classes.first()["vector"]) // 8
    whole = results(short, 1, 2 << max(0, (width - 1).bit_length()))
    return found.join(short.select("query_id"), "query_id", "left_anti").union(whole)
