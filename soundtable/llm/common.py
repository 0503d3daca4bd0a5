"""What the training-data operators share: scratch tables, checked broadcasts, row removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two- or three-column table may be broadcast (about 50 MB).
BROADCAST_ROWS = 1_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, or in local mode a temporary one.

    A cluster with neither that setting nor a warehouse in a shared file system is an error: executors would write where nobody reads."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = tempfile.mkdtemp(prefix="soundtable-") if local else shared_warehouse(spark.conf.get("spark.sql.warehouse.dir"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_warehouse(folder: str) -> str:
    """The scratch folder in a warehouse that all machines see."""
    if folder.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/") + "/scratch"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/soundtable/{label}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a job when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession):
    """Shuffle files of jobs run inside go when their job ends: what the jobs made is written, so nobody reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write_table(spark: SparkSession, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_path(spark, label)
    with short_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of tables made by write_table. Only for tables no later plan reads."""
    for name in {f.rsplit("/", 1)[0] for table in tables for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text that a Python task takes from a batch at once.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose strings in that column have about `size` bytes together, one row at least: what a task
    builds for a slice is bounded by that, or by the longest text."""
    for batch in batches:
        texts, first = batch.column(column), 0
        if not batch.num_rows:
            continue
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())).to_numpy()
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(ends.searchsorted(done + size, side="right")))
            yield batch.slice(first, last - first)
            first = last


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has (in any case): `name`, with underscores if need be."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_within(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table (cheap to count: written before) has at most `rows` rows; else left to the optimizer."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def remove_rows(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs without the rows whose keys (compared null-safely) are in `gone`, a written table with a column for each key.

    Columns stay as they are, whatever their names."""
    marks = {name: unused(f"__key_{name}", docs) for name in keys}
    marked = docs.select("*", *[key.alias(marks[name]) for name, key in keys.items()])
    outs = {name: unused(f"__gone_{name}", marked) for name in keys}
    gone = broadcast_within(gone.distinct().select(*[F.col(k).alias(outs[k]) for k in keys]))
    on = None
    for name in keys:
        one = F.col(marks[name]).eqNullSafe(F.col(outs[name]))
        on = one if on is None else on & one
    return marked.join(gone, on, "left_anti").drop(*marks.values())


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str) -> Column:
    """128 bits that identify a text (null: empty)."""
    return F.unhex(F.md5(text_or_empty(name)))


def ascii_lower(text: Column) -> Column:
    """A-Z only, so that all languages and engines agree."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Runs of anything but space and the control characters 9 to 13."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(word_list: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles in order, repeats included; empty with fewer than k words."""
    count = F.size(word_list) - (k - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(word_list, i, k), " "))),
    ).otherwise(F.array().cast("array<bigint>"))
