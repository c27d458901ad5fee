"""Byte ranges of files, read in tasks: listing, cutting into spans, and reading of single ranges."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 32 << 20
BLOCK = 1 << 20


def spans(spark: SparkSession, path, span: int = SPAN) -> DataFrame:
    """(file, size, start, stop): the files at a path cut into ranges of bytes, dealt out over the tasks.

    Only names and sizes are listed; no content is read here.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).filter("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(span).cast("bigint")))
    cut = files.select("file", "size", starts.alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + span, F.col("size"))).repartition(spark.sparkContext.defaultParallelism * 4, "file", "start")


@contextmanager
def opened(uri: str):
    """A file with seek and read. Local files by Python itself, others by the file system of their address."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        with open("/" + rest.lstrip("/") if scheme == "file" else uri, "rb") as f:
            yield f
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri)
    with system.open_input_file(at) as f:
        yield f


def lines_from(f, start: int, stop: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, part, ended) of the lines that start in [start, stop), without their ends.

    A line longer than a block comes in parts, of which the last one is ended, so that memory
    is bounded whatever a line's length. A range in the middle of one line has no lines, and isn't read beyond itself.
    """
    at = start
    if start:
        f.seek(start - 1)
        at = None
        seen = start - 1
        while seen < stop - 1:
            block = f.read(min(BLOCK, stop - 1 - seen))
            if not block:
                return
            i = block.find(b"\n")
            if i >= 0:
                at = seen + i + 1
                break
            seen += len(block)
        if at is None:
            return
    f.seek(at)
    held, begun = b"", at  # begun: where the current line starts
    while True:
        block = f.read(BLOCK)
        if not block:
            if held or begun < at:
                yield begun, held, True
            return
        data, base = held + block, at - len(held)
        at += len(block)
        i = 0
        while (j := data.find(b"\n", i)) >= 0:
            if begun >= stop:
                return
            yield begun, data[i:j], True
            i = j + 1
            begun = base + i
        if begun >= stop:
            return
        held = data[i:]
        if len(held) >= BLOCK:
            yield begun, held, False
            held = b""
