"""Numbers for rows of files, in the order of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PART_BITS = 33


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Adds a number that rises from file to file by path, and within a file by place.

    ``rows`` is read from files directly. Spark packs files and blocks into partitions by size; within one they keep
    their places, so a block's rank and the running number of the partition make the order whatever the packing.
    """
    marked = rows.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_from"),
                         F.monotonically_increasing_id().alias("_at"))
    # One row per block: a short list, ranked in one task.
    blocks = marked.select("_path", "_from").distinct().withColumn("_rank", F.row_number().over(W.orderBy("_path", "_from")) - 1)
    number = F.shiftleft(F.col("_rank").cast("long"), PART_BITS) + F.col("_at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return marked.join(blocks, ["_path", "_from"]).withColumn(name, number).drop("_path", "_from", "_at", "_rank")
