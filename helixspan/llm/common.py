"""Shared plumbing of the training-data operators: table access, staging and Arrow batch maps."""
from __future__ import annotations

import ctypes
import os
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary file: in the given folder, or else in the package of public tokenizers. The files are never copied."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor can see.

    Where that setting is unset, a folder of the warehouse serves in local mode (tests); a cluster
    must name a shared folder, since its executors don't see the driver's own. The folder goes
    when the driver's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Runs actions with Arrow batches of at most so many rows, where rows hold whole texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim_memory() -> None:
    """Gives freed memory back to the system, where its C library can: workers live on into stages that need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of batches after which a task gives freed memory back.
TRIM_BYTES = 4 << 20


def released(run):
    """run for mapInArrow, which gives freed memory back as batches pass and at its end: Python workers live on into other tasks."""

    def passing(batches):
        left = TRIM_BYTES
        for batch in batches:
            left -= batch.nbytes
            yield batch
            if left < 0:  # what was made of the batches so far is done with
                trim_memory()
                left = TRIM_BYTES

    def whole(batches):
        yield from run(passing(batches))
        trim_memory()

    return whole


def map_rows(df: DataFrame, fn, schema: str, piece_rows: int = 512) -> DataFrame:
    """mapInArrow with fn(columns: dict[str, list]) -> dict[str, list | pa.Array], in small pieces.

    A piece holds at most piece_rows rows, so that one batch of long texts doesn't become
    one huge Python list; every row still goes through.
    """
    names = df.columns
    target = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, piece_rows):
                piece = batch.slice(at, piece_rows)
                out = fn({n: piece.column(i) for i, n in enumerate(names)})
                yield as_batch(out, target)

    return df.mapInArrow(released(run), schema)


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in target:
        v = columns[f.name]
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        arrays.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def column_place(df: DataFrame, name: str) -> int | None:
    """Place of the column of this name: spelled the same, or else the first one that differs only by case."""
    if name in df.columns:
        return df.columns.index(name)
    return next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., which never clash; toDF(*df.columns) gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; a missing one is null. Extra columns, whatever their names, fall away."""
    kind = {"text": "string", "html": "string", "lang": "string", "source": "string", "url": "string"}
    place, own = {n: column_place(docs, n) for n in names}, by_place(docs)
    return own.select(
        *[F.lit(None).cast(kind.get(n, "bigint")).alias(n) if i is None else F.col(f"c{i}").alias(n) for n, i in place.items()]
    )
