"""Shards that all have the mixture of the whole: proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked. A row's fractional rank, (rank + start) / rows of the source with a
start between 0 and 1 drawn from the source's name, is where it stands in a line that mixes all sources evenly; the line is cut into
shards whose row counts differ by one at most.

Ranks and positions are exact, but no window spans a source or the table. Hashes are uniform, so a source is cut into equal ranges of
the hash, the line into equal ranges of the fraction; counts per range give where a range starts and a window ranks within it. The
number of ranges follows the shuffle partitions, so a source that holds a third of all rows is ranked in as many tasks as the cluster
has. The text is only measured; it is never shuffled.

Results: null texts have size 8 and the checksum of no bytes; rows with a null source are a source of their own; equal rows and rows
with the same doc_id are told apart by their text's MD5, and share their places in any order if all is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import seeded_hash, shuffle_partitions

#: Hash values lie below this.
HASHES = 1 << 60
#: Ranges for each shuffle partition.
RANGES = 4


def shard_documents(docs: DataFrame, shards: int = 24, seed: str = "shard") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): the place of every document."""
    if shards < 1:
        raise ValueError("At least one shard is needed.")
    ranges = RANGES * shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        _stratum().alias("stratum"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text_md5"),
        seeded_hash(seed, "doc_id").alias("drawn"),
    ).withColumn("cell", _range(F.col("drawn") / F.lit(float(HASHES)), ranges))

    # Rank within the source: rows in earlier cells, then the order within the cell.
    source = Window.partitionBy("stratum")
    cells = (
        docs.select(_stratum().alias("stratum"), seeded_hash(seed, "doc_id").alias("drawn"))
        .withColumn("cell", _range(F.col("drawn") / F.lit(float(HASHES)), ranges))
        .groupBy("stratum", "cell")
        .agg(F.count("*").alias("n"))
        .select(
            "stratum",
            "cell",
            (F.sum("n").over(source.orderBy("cell")) - F.col("n")).alias("before"),
            F.sum("n").over(source).alias("rows"),
        )
    )
    within = Window.partitionBy("stratum", "cell").orderBy("drawn", "doc_id", "text_md5")
    start = seeded_hash(seed, "stratum") / F.lit(float(HASHES))
    ranked = (
        rows.join(cells, ["stratum", "cell"])
        .withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
        .withColumn("fraction", (F.col("rank") + start) / F.col("rows"))
        .withColumn("stretch", _range(F.col("fraction"), ranges))
        .drop("before", "rows", "rank", "cell")
    )

    # Position in the line, in the same way. There is one row for each stretch here.
    line = Window.orderBy("stretch")
    stretches = (
        ranked.groupBy("stretch")
        .agg(F.count("*").alias("n"))
        .select(
            "stretch",
            (F.sum("n").over(line) - F.col("n")).alias("before"),
            F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rows"),
        )
    )
    placed = Window.partitionBy("stretch").orderBy("fraction", F.col("source").asc_nulls_last(), "drawn", "doc_id", "text_md5")
    return (
        ranked.join(F.broadcast(stretches), "stretch")
        .withColumn("position", F.col("before") + F.row_number().over(placed) - 1)
        .withColumn("shard", F.expr(f"(position * {shards}) div rows").cast("int"))
        # The first position of a shard is the least that the division above maps to it.
        .withColumn("slot", F.expr(f"position - ((shard * rows + {shards - 1}) div {shards})"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )


def _stratum() -> Column:
    """The source as a key that is never null."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))


def _range(fraction: Column, ranges: int) -> Column:
    """The equal range of 0 to 1, of so many, in which a fraction lies."""
    return F.least(F.floor(fraction * F.lit(float(ranges))), F.lit(ranges - 1)).cast("int")
