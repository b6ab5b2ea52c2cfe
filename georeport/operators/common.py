"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that nested lambdas do not evaluate it again per element."""
    return F.transform(F.array(value), body)[0]


#: Folders chosen here, by application: that of the job at hand, or a local session's own.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: that of the job at hand, else the cluster's shared one, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster it would be
    a different one on each machine, so it is an error there.
    """
    app = spark.sparkContext.applicationId
    if app in _FOLDERS:
        return _FOLDERS[app]
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _FOLDERS[app] = tempfile.mkdtemp(prefix="georeport-")
    return _FOLDERS[app]


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Steps written inside the block go to a folder of their own, which is deleted at its end; results have to be stored elsewhere by then."""
    app, root = spark.sparkContext.applicationId, shared_dir(spark)
    own, outer = f"{root.rstrip('/')}/job-{uuid.uuid4().hex}", _FOLDERS.get(app)
    _FOLDERS[app] = own
    try:
        yield own
    finally:
        del _FOLDERS[app]
        if outer:
            _FOLDERS[app] = outer
        files, path = pafs.FileSystem.from_uri(own) if ":" in own else (pafs.LocalFileSystem(), own)
        if files.get_file_info(path).type == pafs.FileType.Directory:
            files.delete_dir(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it from there.

    Computes the input once, cuts its lineage, gives later joins exact sizes, and survives
    lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_join(rows: DataFrame, others: DataFrame, on: list[str], share: int = 256) -> DataFrame:
    """``rows.join(others, on)`` where the result is much larger than both sides; keys are no floating point numbers.

    The rows of a key are dealt in parts of about ``share``, each of which meets all others of its key, so one name with many rows is many
    small pieces of work. They go to a fixed number of tasks, since sizes of the sides say nothing about that of the result. A task
    goes through the others and repeats a whole part for each: it keeps one part at a time, and its result packs well.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    many = rows.groupBy(*on).agg(F.ceil(F.count("*") / share).cast("int").alias("_parts")).filter("_parts > 1").dropna(subset=on)
    many = written(many, "many")
    parts = F.coalesce("_parts", F.lit(1))
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind]
    dealt = rows.join(many, on, "left").withColumn("_part", F.pmod(F.xxhash64(*hashed), parts).cast("int"))
    # Names of columns may be on both sides.
    rest = [c for c in others.columns if c not in on]
    each = others.select(*on, *(F.col(c).alias(f"_o{no}") for no, c in enumerate(rest)))
    each = each.join(many, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = each.repartition(tasks, *on, "_part").hint("merge").join(dealt.repartition(tasks, *on, "_part"), [*on, "_part"])
    return met.select(*on, *(c for c in rows.columns if c not in on), *(F.col(f"_o{no}").alias(c) for no, c in enumerate(rest)))


def totals_before(numbers: Column, block: int = 8, levels: int = 3) -> Column:
    """For each element of an array of longs, the sum of the elements before it.

    Spark has no scan over an array, and a fold that appends is quadratic. Sums are
    taken per block and per block of blocks first, so an element costs a few additions.
    """
    def add(acc: Column, x: Column) -> Column:
        return acc + x

    def inside(chunk: Column, start: Column) -> Column:
        return F.transform(chunk, lambda x, i: F.aggregate(F.slice(chunk, 1, i), start, add))

    if levels == 0:
        return let(numbers, lambda xs: inside(xs, F.lit(0).cast("long")))

    def run(xs: Column) -> Column:
        last = F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / block).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * block + 1, block))

        def join(cs: Column) -> Column:
            sums = F.transform(cs, lambda c: F.aggregate(c, F.lit(0).cast("long"), add))
            return F.flatten(F.zip_with(cs, totals_before(sums, block, levels - 1), inside))

        return let(chunks, join)

    return let(numbers, run)
