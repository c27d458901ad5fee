"""Indexed sequence files: where each record's bases stand, and reading of chosen ranges by their bytes.

The index has a row for each record: file, name, length, offset of the first base, bases and
bytes of a line. It is made by tasks over byte ranges; the parts of a record that several
ranges hold are put together from a few numbers for each range. With it, base i of a record stands
at offset + i div line_bases * line_bytes + i mod line_bases, so that a piece of a record is
read alone: by the data source `fasta_ranges`, whose partitions are lists of pieces chosen by
the filters on name, start and stop, or by `fetch`, for a table of ranges.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .bytes import SPAN, opened, spans, lines_from

INDEX = "file string, name string, length bigint, offset bigint, line_bases bigint, line_bytes bigint"
PIECES = "name string, start bigint, stop bigint, bases string"
_PARTS = (
    "file string, start bigint, place bigint, named boolean, name string, offset bigint, bases bigint, first bigint, first_bytes bigint, "
    "low bigint, high bigint, last bigint, blank_end boolean, blank_start boolean, blank_inside boolean"
)


# --- index -------------------------------------------------------------------------------------


def _parts(f, start: int, stop: int) -> Iterator[dict]:
    """The records, or parts of them, whose lines start in the range, as sums over their lines.

    low and high are the least and largest size of all lines but the last, which may be shorter.
    """
    part, place, size, begun, head, name = None, 0, 0, None, False, b""

    def new(named, name=None):
        return dict(named=named, name=name, offset=None, bases=0, first=None, first_bytes=None, low=None, high=None, last=None, blank_end=False, blank_start=False, blank_inside=False)

    def line(p, at, n, n_bytes):
        if n == 0:
            p["blank_start"] |= p["last"] is None
            p["blank_end"] = True
            return
        p["blank_inside"] |= p["blank_end"] and p["last"] is not None
        p["blank_end"] = False
        if p["last"] is not None:
            p["low"], p["high"] = (p["last"] if p[k] is None else f(p[k], p["last"]) for k, f in (("low", min), ("high", max)))
        else:
            p["offset"], p["first"], p["first_bytes"] = at, n, n_bytes
        p["bases"] += n
        p["last"] = n

    for at, text, ended in lines_from(f, start, stop):
        if at != begun:
            begun, size, head, name, ends = at, 0, text[:1] == b">", b"", b""
        if head:
            name += text if len(name) < 1 << 16 else b""
        size += len(text)
        ends = text[-1:] or ends
        if not ended:
            continue
        if head:
            if part is not None:
                yield part | {"place": place}
                place += 1
            words = name[1:].split(None, 1)
            part = new(True, words[0].decode("utf-8") if words and not name[1:2].isspace() else "")
        else:
            part = new(False) if part is None else part
            line(part, at, size - (ends == b"\r"), size + 1)
    if part is not None:
        yield part | {"place": place}


def index(spark: SparkSession, path, span: int = SPAN) -> DataFrame:
    """A row for each record of the files; records whose lines can't be counted off (uneven, or none) are an error when read."""
    target = _arrow(spark, _PARTS)

    def run(batches):
        for batch in batches:
            for file, start, stop in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "start", "stop"))):
                with opened(file) as f:
                    rows = [r | {"file": file, "start": start} for r in _parts(f, start, stop)]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    parts = spans(spark, path, span).mapInArrow(run, _PARTS)
    # A record that ends in its own range is whole; the last one of a range goes on with the nameless
    # first parts of the ranges after it. A window holds these edges, two for each range of a file.
    own = Window.partitionBy("file", "start")
    marked = parts.withColumn("edge", (F.col("place") == F.max("place").over(own)) | ~F.col("named"))
    along = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    edges = marked.filter("edge").withColumn("record", F.sum(F.col("named").cast("int")).over(along))
    whole = marked.filter("not edge").withColumn("record", F.concat_ws("#", F.col("start").cast("string"), F.col("place").cast("string")))
    rows = edges.withColumn("record", F.col("record").cast("string")).unionByName(whole)
    key = F.struct("start", "place")
    filled = F.col("last").isNotNull()
    g = rows.groupBy("file", "record").agg(
        F.max("name").alias("name"), F.sum("bases").alias("length"), F.min_by("offset", F.when(filled, key)).alias("offset"),
        F.min_by("first", F.when(filled, key)).alias("line_bases"), F.min_by("first_bytes", F.when(filled, key)).alias("line_bytes"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sort_array(F.collect_list(F.when(filled, F.struct("start", "place", "last", "blank_end", "blank_start")))).alias("ends"), F.max("blank_inside").alias("blank_inside"),
    )
    before_last = F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))
    even = (
        F.coalesce(F.col("low") == F.col("line_bases"), F.lit(True)) & F.coalesce(F.col("high") == F.col("line_bases"), F.lit(True)) & ~F.col("blank_inside")
        & F.forall(before_last, lambda e: (e.last == F.col("line_bases")) & ~e.blank_end) & F.forall(F.slice("ends", 2, F.greatest(F.size("ends"), F.lit(1))), lambda e: ~e.blank_start)
        & (F.element_at("ends", -1)["last"] <= F.col("line_bases"))
    )
    fault = F.when(F.col("name").isNull(), F.lit("lines before the first record")).when(F.col("length") == 0, F.concat(F.lit("empty sequence "), "name")).when(
        ~even, F.concat(F.lit("uneven line length in "), "name"))
    g = g.withColumn("fault", fault).filter(F.col("name").isNotNull() | (F.col("length") > 0))
    return g.select("file", F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("string")).otherwise(F.col("name")).alias("name"), "length", "offset", "line_bases", "line_bytes")


def write_index(spark: SparkSession, path, to: str, span: int = SPAN) -> None:
    index(spark, path, span).write.mode("overwrite").parquet(to)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# --- ranges ------------------------------------------------------------------------------------


def bases_in(f, offset: int, line_bases: int, line_bytes: int, start: int, stop: int) -> bytes:
    """Bases [start, stop) of a record, read from its own bytes alone."""
    if stop <= start:
        return b""
    place = lambda i: offset + i // line_bases * line_bytes + i % line_bases
    f.seek(place(start))
    return f.read(place(stop - 1) + 1 - place(start)).translate(None, b"\r\n")


class Pieces(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows  # (file, name, offset, line_bases, line_bytes, start, stop), neighbours in a file together


_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class RangesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.piece, self.split = options["index"], int(options.get("piece", 1 << 14)), int(options.get("split", SPAN))
        self.filters: list = []

    def pushFilters(self, filters):
        """Takes what is known of a piece before it is read: comparisons of name, start and stop."""
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("name", "start", "stop") and len(f.attribute) == 1:
                self.filters.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        """Pieces in the order of the files, so many to a partition as have `split` bytes; the index is a row for each record."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        if self.index.startswith("file:") or ":" not in self.index:
            system, at = fs.LocalFileSystem(), "/" + self.index.removeprefix("file:").lstrip("/")
        else:
            system, at = fs.FileSystem.from_uri(self.index)
        rows = pq.read_table(at, filesystem=system).sort_by([("file", "ascending"), ("offset", "ascending")]).to_pylist()
        out, held, size = [], [], 0
        for r in rows:
            if not self._may(r["name"], None):
                continue
            for start in self._starts(r["length"]):
                stop = min(start + self.piece, r["length"])
                if self._may(r["name"], (start, stop)):
                    held.append((r["file"], r["name"], r["offset"], r["line_bases"], r["line_bytes"], start, stop))
                    size += stop - start
                    if size >= self.split:
                        out.append(Pieces(held))
                        held, size = [], 0
        return [*out, Pieces(held)] if held or not out else out

    def _starts(self, length: int):
        """Starts of pieces, from the first to the last that the filters on start and stop may choose."""
        low, high = 0, length
        for kind, name, value in self.filters:
            if name == "start" and kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                low = max(low, value)
            if name == "stop" and kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                low = max(low, value - self.piece)
            if name in ("start", "stop") and kind in (EqualTo, LessThan, LessThanOrEqual):
                high = min(high, value + 1)
        return range(max(low, 0) // self.piece * self.piece, high, self.piece)

    def _may(self, name: str, ends) -> bool:
        known = {"name": name} if ends is None else {"name": name, "start": ends[0], "stop": ends[1]}
        return all(_TESTS[kind](known[c], value) for kind, c, value in self.filters if c in known)

    def read(self, partition: Pieces):
        names, starts, stops, texts, size = [], [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(texts, pa.string())], names=["name", "start", "stop", "bases"]
            )

        last, rows = None, partition.rows
        for i, (file, *_) in enumerate(rows):
            if file == last:
                continue
            last = file
            with opened(file) as f:
                for _, name, offset, line_bases, line_bytes, start, stop in (r for r in rows[i:] if r[0] == file):
                    names.append(name)
                    starts.append(start)
                    stops.append(stop)
                    texts.append(bases_in(f, offset, line_bases, line_bytes, start, stop).decode("ascii"))
                    size += stop - start
                    if size >= 1 << 22:
                        yield batch()
                        names, starts, stops, texts, size = [], [], [], [], 0
        if names:
            yield batch()


class FastaRanges(DataSource):
    """Options: index (a folder of write_index), piece (bases of a row), split (bytes of a partition)."""

    @classmethod
    def name(cls):
        return "fasta_ranges"

    def schema(self):
        return PIECES

    def reader(self, schema):
        return RangesReader(dict(self.options))


def read_ranges(spark: SparkSession, index_path: str, piece: int = 1 << 14, split: int = SPAN) -> DataFrame:
    """(name, start, stop, bases): all pieces of the indexed files; filters on name, start and stop choose what is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaRanges)
    return spark.read.format("fasta_ranges").option("index", index_path).option("piece", piece).option("split", split).load()


def pieces(spark: SparkSession, index_path: str, size: int) -> DataFrame:
    """Pieces in the form that the sequence operators meet: (name, chunk, offset, bases, length), without a whole record anywhere."""
    rows = read_ranges(spark, index_path, size).select("name", F.floor(F.col("start") / size).alias("chunk"), F.col("start").alias("offset"), "bases")
    lengths = spark.read.parquet(index_path).groupBy("name").agg(F.max("length").alias("length"))
    return rows.join(lengths, "name")


def fetch(regions: DataFrame, index_rows: DataFrame) -> DataFrame:
    """regions (name, start, stop, ...) with their bases, cut at the record's end; regions on unknown records are left out.

    Regions meet the index by name and are read in the order of their bytes, so a task opens each file once
    and walks it forwards. A region's own bases are one value.
    """
    spark = regions.sparkSession
    own = regions.columns
    met = regions.join(index_rows.withColumnsRenamed({"file": "_file", "length": "_length", "offset": "_offset", "line_bases": "_bases", "line_bytes": "_bytes"}), "name")
    met = met.withColumns({"_from": F.greatest(F.col("start"), F.lit(0)), "_to": F.least("stop", "_length")})
    met = met.repartitionByRange("_file", "_offset", "_from").sortWithinPartitions("_file", "_offset", "_from")
    schema = ", ".join(f"`{n}` {t}" for n, t in met.select(*own).dtypes) + ", bases string"
    target = _arrow(spark, schema)
    needs = ("_file", "_offset", "_bases", "_bytes", "_from", "_to")

    def run(batches):
        name, held = None, None
        try:
            for batch in batches:
                texts = []
                for file, *numbers in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in needs)):
                    if file != name:
                        if held is not None:
                            held.__exit__(None, None, None)
                        held = opened(file)
                        f, name = held.__enter__(), file
                    texts.append(bases_in(f, *numbers).decode("ascii"))
                arrays = [batch.column(batch.schema.get_field_index(c)).cast(target.field(c).type) for c in own]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], schema=target)
        finally:
            if held is not None:
                held.__exit__(None, None, None)

    return met.mapInArrow(run, schema)
