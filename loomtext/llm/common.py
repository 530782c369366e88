"""What the training-data operators share: written intermediates, row keys, distributed ranks."""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes that separate words under the class ``[\x20\x09-\x0D]``.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Stands for a null id in equi-joins.
NULL_ID = -(2**63)
#: Bytes of rows that :func:`small_batches` lets go to Python at a time; a longer row stands alone.
BATCH_BYTES = 8 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from spark.checkpoint.dir. Where it is unset, one is made,
    but in local mode only: executors elsewhere would not see it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="loomtext-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The lineage ends there: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/loomtext/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loomtext_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what :func:`materialize` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.loomtext_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES, where Spark by itself bounds only their number.

    Beside its heap an executor holds each task's batch several times over (Arrow, the buffer it is sent from, the
    worker), 200 MB a task for 10,000 texts. It is a setting of the session and stays, since a stage's result is
    planned when it is written; a smaller one is kept. Batches decide no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if known > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def any_names(*roles: str, replaces: tuple[str, ...] = ()) -> Callable:
    """For a function on documents whose parameters ``roles`` name columns: their names, whatever they are,
    cannot clash with its own. Columns are numbered on the way in and named back on the way out; those in
    ``replaces`` make way for the ones it adds."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            call = inspect.signature(f).bind(docs, *args, **options)
            call.apply_defaults()
            used = {role: call.arguments[role] for role in roles}
            docs = docs.drop(*[c for c in replaces if c not in used.values()])
            numbered = {c: f"c{i}" for i, c in enumerate(docs.columns)}
            call.arguments |= {role: numbered[c] for role, c in used.items()} | {next(iter(call.arguments)): docs.toDF(*numbered.values())}
            out = f(*call.args, **call.kwargs)
            return out.toDF(*docs.columns, *out.columns[len(docs.columns) :])

        return run

    return wrap


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer if ``docs`` has such a column."""
    while name in docs.columns:
        name += "_"
    return name


def row_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``__id`` (never null) and ``__h`` (hash of the text).

    Rows alike in both are the same row repeated, and get the same result.
    """
    return df.withColumns(
        {"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__h": F.xxhash64(F.col(text))}
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 64) -> DataFrame:
    """``out``: the row's 0-based, gapless rank within ``keys`` in the order (bucket, ``order``).

    A bucket is a hash of ``order``, so no task ever holds a whole key: rows are counted by
    (key, bucket) with map-side combining, the counts are summed up (``buckets`` rows a key), and
    only the rows of one bucket are sorted together.
    """
    part = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = part.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__b").alias("__kb"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    on = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__b").orderBy(*order)
    return (
        part.withColumn("__r", F.row_number().over(within) - 1)
        .join(starts, on)
        .withColumn(out, (F.col("__start") + F.col("__r")).cast("long"))
        .drop("__b", "__kb", "__start", "__r", "__n", *[f"__k{i}" for i in range(len(keys))])
    )


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def trimmed(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.trim(text, F.lit(SPACE_CHARS))


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A table, dealt to all cores where it has fewer splits than that. At scale it has more, and nothing
    is moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
