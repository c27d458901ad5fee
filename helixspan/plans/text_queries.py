"""Driver queries that write tables as text of each format and read them back, with the SQL of what must come out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences, signal
from ..sources import fasta, lines, sinks, text, vcf
from ..sources.staging import scratch
from ..streaming import join as stream_join
from . import commands
from . import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _bed(spark, sf_dir) -> DataFrame:
    a = v.point_b(spark, sf_dir).withColumn("alleles", F.concat_ws("/", "ref", "alt"))
    return a.select("chrom", "start", "stop", "alleles", "orderkey")


_BED = f"WITH b AS ({v.SQL_PB}) SELECT chrom, start_, stop_, ref || '/' || alt AS alleles, CAST(orderkey AS VARCHAR) AS second FROM b"


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("chrom", F.col("start").alias("start_"), F.col("stop").alias("stop_"), F.get("extra", F.lit(0)).alias("alleles"), F.get("extra", F.lit(1)).alias("second"))


@query(_BED)
def bed_written_and_read(spark, sf_dir):
    path = scratch(spark, "bed")
    sinks.write_bed(_bed(spark, sf_dir), path, ["alleles", "orderkey"])
    return _read(text.read_bed(spark, path))


@query(_BED)
def bed_in_many_compressed_files(spark, sf_dir):
    path = scratch(spark, "bedgz")
    sinks.bed_lines(_bed(spark, sf_dir), ["alleles", "orderkey"]).write.option("compression", "gzip").text(path)
    return _read(text.read_bed(spark, path))


def _placed(rows: DataFrame, *folder: str) -> DataFrame:
    """rows (file, line, ...) with `place`, the line's number in its folder: its file's parts one after another by name."""
    from pyspark.sql import Window

    parts = rows.groupBy(*folder, "file").agg(F.max("line").alias("_n"))
    w = (Window.partitionBy(*folder) if folder else Window.partitionBy(F.lit(0))).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts.select("file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")), "file").withColumn("place", F.col("line") + F.col("_before"))


_BRANDS = "SELECT p_brand || '_' || (p_partkey % 50) AS chrom, CAST(p_partkey AS BIGINT) AS start_ FROM part"
_BY_PLACE = "regexp_extract(chrom, '^[^0-9]*', 0), CAST(regexp_extract(chrom, '([0-9]+)_', 1) AS INT), CAST(regexp_extract(chrom, '_([0-9]+)', 1) AS INT), start_"


@query(f"SELECT chrom, start_, row_number() OVER (ORDER BY {_BY_PLACE}) AS place FROM ({_BRANDS})")
def bed_file_in_natural_order(spark, sf_dir):
    """Each line's place in the parts that the sink writes, one after another."""
    rows = v.table(spark, sf_dir, "part").selectExpr("concat(p_brand, '_', CAST(p_partkey % 50 AS STRING)) AS chrom", "CAST(p_partkey AS BIGINT) AS start", "CAST(p_partkey + 1 AS BIGINT) AS stop")
    path = scratch(spark, "ordered")
    sinks.write_bed(rows, path)
    f = F.split("value", "\t")
    return _placed(lines.numbered(spark, path)).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("bigint").alias("start_"), "place")


@query("SELECT 'chr' || (o_custkey % 22 + 1) AS chrom, o_orderkey % 500 AS start_, o_orderkey % 500 AS stop_, 'chr' || (o_custkey % 22 + 1) || chr(9) || (o_orderkey % 500) || chr(9) || o_orderkey AS line FROM orders")
def positions_written_and_read(spark, sf_dir):
    path = scratch(spark, "positions")
    v.point_b(spark, sf_dir).select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("orderkey").cast("string")).alias("value")).write.text(path)
    return text.read_positions(spark, path).withColumnsRenamed({"start": "start_", "stop": "stop_"})


@query(f"SELECT name, seq, CAST(len(seq) AS BIGINT) AS length FROM ({v.SQL_SEQS}) WHERE len(seq) > 0")
def fasta_written_and_read(spark, sf_dir):
    path = scratch(spark, "fasta")
    sinks.write_fasta(v.sequences(spark, sf_dir).filter("seq <> ''"), path)
    rows = text.read_fasta(spark, path)
    return rows.select("name", "seq").join(text.fasta_index(rows), "name")


def _indexed(spark, sf_dir) -> str:
    """A folder with the index of the sequences, which are written as files of wrapped lines."""
    path, to = scratch(spark, "fasta"), scratch(spark, "fasta-index")
    sinks.write_fasta(v.sequences(spark, sf_dir).filter("seq <> ''"), path)
    fasta.write_index(spark, path, to)
    return to


@query(f"SELECT name, len(seq) // 4 AS start_, len(seq) // 4 + len(seq) // 3 + 5 AS stop_, substr(seq, len(seq) // 4 + 1, len(seq) // 3 + 5) AS bases FROM ({v.SQL_SEQS}) WHERE seq <> ''")
def fasta_ranges(spark, sf_dir):
    """A range of each record, read by its bytes."""
    rows = spark.read.parquet(_indexed(spark, sf_dir))
    n = F.col("length")
    lo = F.floor(n / 4)
    asked = rows.select("name", lo.alias("start"), (lo + F.floor(n / 3) + 5).alias("stop"))
    return fasta.fetch(asked, rows).withColumnsRenamed({"start": "start_", "stop": "stop_"})


@query(f"""SELECT name, CAST(i AS BIGINT) AS start_, CAST(least(i + 128, len(seq)) AS BIGINT) AS stop_, substr(seq, CAST(i AS INT) + 1, 128) AS bases
 FROM ({v.SQL_SEQS}), range(0, 1000000, 128) t(i) WHERE i < len(seq) AND i >= 200 AND least(i + 128, len(seq)) <= 1500""")
def fasta_pieces_by_place(spark, sf_dir):
    """Pieces chosen by start and stop; the source takes both filters and reads no others."""
    rows = fasta.read_ranges(spark, _indexed(spark, sf_dir), 128).filter("start >= 200 AND stop <= 1500")
    return rows.withColumnsRenamed({"start": "start_", "stop": "stop_"})


@query(f"SELECT name, CAST(len(seq) AS BIGINT) AS length, len(seq) - len(replace(seq, 'A', '')) - len(replace(seq, 'T', '')) + len(seq) AS at FROM ({v.SQL_SEQS}) WHERE seq <> ''")
def token_counts_of_an_indexed_file(spark, sf_dir):
    """Bases of whole records counted over the pieces of an indexed file, of which none is ever one row."""
    pieces = fasta.pieces(spark, _indexed(spark, sf_dir), sequences.PIECE).drop("length")
    whole = sequences.lengths_of(pieces).select(F.col("name").alias("chrom"), F.lit(0).cast("bigint").alias("start"), F.col("length").alias("stop"))
    return sequences.token_counts(whole, pieces, ["a/t"]).select(F.col("chrom").alias("name"), F.col("stop").alias("length"), F.col("a/t").alias("at"))


@query("SELECT 'chr' || p_partkey AS chrom, CAST(10 + i AS BIGINT) AS start_, CAST(11 + i AS BIGINT) AS stop_, CAST(p_size AS DOUBLE) + i AS value FROM part, range(0, 3) t(i)")
def wiggle_written_and_read(spark, sf_dir):
    path = scratch(spark, "wiggle")
    lines = F.concat_ws("\n", F.format_string("fixedStep chrom=chr%d start=11 step=1", F.col("p_partkey").cast("bigint")), *[(F.col("p_size") + i).cast("string") for i in range(3)])
    v.table(spark, sf_dir, "part").select(lines.alias("value")).write.text(path)
    out = signal.track_intervals(text.read_wiggle(spark, path))
    return out.select("chrom", F.col("start").alias("start_"), F.col("stop").alias("stop_"), "value")


_RECORDS = """SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, CAST(p_partkey AS BIGINT) AS pos, substr('ACGT', p_partkey % 4 + 1, 1) AS ref,
 substr('ACGT', (p_partkey + 1) % 4 + 1, 1) || ',' || substr('ACGT', (p_partkey + 2) % 4 + 1, 1) AS alts, 'rs' || p_partkey AS id, CAST(p_size AS DOUBLE) AS qual,
 CASE WHEN p_size % 3 = 0 THEN 'PASS' WHEN p_size % 3 = 1 THEN 'a;q10' ELSE '' END AS filters, CAST(p_size AS VARCHAR) AS dp, CASE WHEN p_size % 2 = 0 THEN '0/1' ELSE '1|2' END AS gt FROM part"""


def _header() -> vcf.Header:
    return vcf.Header.parse([
        "##fileformat=VCFv4.1", '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="known">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="call">', '##FILTER=<ID=q10,Description="low">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
    ])


def _records(spark, sf_dir) -> DataFrame:
    base = lambda k: f"substr('ACGT', CAST((p_partkey + {k}) % 4 + 1 AS INT), 1)"
    return v.table(spark, sf_dir, "part").selectExpr(
        "0 AS source", "CAST(p_partkey AS BIGINT) AS ord", "concat('chr', CAST(p_partkey % 22 + 1 AS STRING)) AS chrom", "CAST(p_partkey AS BIGINT) AS pos",
        "array(concat('rs', CAST(p_partkey AS STRING))) AS ids", f"{base(0)} AS ref", f"array({base(1)}, {base(2)}) AS alts", "CAST(p_size AS DOUBLE) AS qual",
        "CASE WHEN p_size % 3 = 0 THEN array('PASS') WHEN p_size % 3 = 1 THEN array('a', 'q10') ELSE CAST(array() AS array<string>) END AS filters",
        "map('DP', array(CAST(p_size AS STRING)), 'DB', CAST(array() AS array<string>)) AS info", "array('GT') AS format",
        "map('s1', map('GT', CASE WHEN p_size % 2 = 0 THEN '0/1' ELSE '1|2' END)) AS samples",
    )


@query(f"SELECT * FROM ({_RECORDS})")
def vcf_written_and_read(spark, sf_dir):
    path = scratch(spark, "vcf")
    sinks.write_vcf(_records(spark, sf_dir), _header(), path)
    rows = vcf.read_rows(spark, path, vcf.read_header(spark, path))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return rows.filter(F.map_contains_key("info", "DB") & ~F.map_contains_key("samples", "s2")).select(
        "chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.get("ids", F.lit(0)).alias("id"), "qual", F.array_join("filters", ";").alias("filters"),
        F.get(get(F.col("info"), "DP"), F.lit(0)).alias("dp"), get(get(F.col("samples"), "s1"), "GT").alias("gt"),
    )


_HEADER_LINES = (
    "['##fileformat=VCFv4.1', '##INFO=<ID=DP,Number=1,Type=Integer,Description=\"depth\">', '##INFO=<ID=DB,Number=0,Type=Flag,Description=\"known\">', "
    "'##FORMAT=<ID=GT,Number=1,Type=String,Description=\"call\">', '##FILTER=<ID=q10,Description=\"low\">', "
    "array_to_string(['#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 's1', 's2'], chr(9))]"
)


@query(f"""WITH r AS (SELECT chrom || chr(9) || pos || chr(9) || id || chr(9) || ref || chr(9) || alts || chr(9) || CAST(CAST(qual AS INT) AS VARCHAR) || chr(9) || CASE filters WHEN '' THEN '.' ELSE filters END
  || chr(9) || 'DB;DP=' || dp || chr(9) || 'GT' || chr(9) || gt || chr(9) || '.' AS line, CAST(pos % 3 AS INT) AS source,
  6 + row_number() OVER (PARTITION BY pos % 3 ORDER BY CAST(substr(chrom, 4) AS INT), pos) AS place FROM ({_RECORDS}))
 SELECT line, source, place FROM r UNION ALL
 SELECT h.line, s.source, h.place FROM (SELECT DISTINCT source FROM r) s, (SELECT unnest({_HEADER_LINES}) AS line, CAST(unnest(range(1, 7)) AS BIGINT) AS place) h""")
def vcf_files_by_source(spark, sf_dir):
    """All lines of each source's folder, header among them, with their places in the folder's parts one after another."""
    path = scratch(spark, "by-source")
    sinks.write_by_source(_records(spark, sf_dir).withColumn("source", (F.col("pos") % 3).cast("int")), _header(), path)
    rows = lines.numbered(spark, path + "/*").withColumn("source", F.regexp_extract("file", "source=([0-9]+)", 1).cast("int"))
    return _placed(rows, "source").select(F.col("value").alias("line"), "source", "place")


_LISTED = "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS line, o_custkey % 22 + 1 AS c, o_orderkey % 500 AS s FROM orders"
_BAD = """CASE WHEN k % 97 = 1 THEN '# a comment' WHEN k % 97 = 2 THEN '' WHEN k % 97 = 3 THEN chr(9) || s || chr(9) || s WHEN k % 97 = 4 THEN 'chr' || c
 WHEN k % 97 = 5 THEN 'chr' || c || chr(9) || 'x' || s || chr(9) || s WHEN k % 97 = 6 THEN 'chr' || c || chr(9) || s || chr(9) || '1e3' WHEN k % 97 = 7 THEN 'chr' || c || chr(9) || (s + 1) || chr(9) || s
 ELSE 'chr' || c || chr(9) || s || chr(9) || (s + 1) END"""


@query(f"""WITH l AS (SELECT k, line, {_BAD} AS value FROM ({_LISTED}))
 SELECT line, value, CASE k % 97 WHEN 3 THEN 'no chromosome' WHEN 4 THEN 'no start position' WHEN 5 THEN 'no start position' WHEN 6 THEN 'no stop position' ELSE 'stop before start' END AS reason
 FROM l WHERE k % 97 BETWEEN 3 AND 7""")
def bad_lines_located(spark, sf_dir):
    """Malformed lines of a file of many splits, each with its number in the file."""
    return lines.checked_bed(spark, _listed(spark, sf_dir))[1].select("line", "value", "reason")


def _listed(spark, sf_dir) -> str:
    rows = v.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CAST(o_custkey % 22 + 1 AS STRING) AS c", "o_orderkey % 500 AS s")
    path = scratch(spark, "listed")
    rows.selectExpr("k", f"{_BAD.replace('chr(9)', 'char(9)')} AS value").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)  # one file, which is read in splits
    return path


@query(f"""WITH l AS (SELECT *, lag(c) OVER (ORDER BY line) AS c0, lag(s) OVER (ORDER BY line) AS s0 FROM ({_LISTED}) WHERE k % 97 NOT BETWEEN 1 AND 7)
 SELECT line, 'chr' || c || chr(9) || s || chr(9) || (s + 1) AS value FROM l WHERE c < c0 OR (c = c0 AND s + 1 <= s0)""")
def lines_out_of_order(spark, sf_dir):
    """Lines that lie before the good one before them, over the splits' borders too."""
    return lines.checked_bed(spark, _listed(spark, sf_dir), in_order=True)[1].filter(F.col("reason") == "not in order").select("line", "value")


@query("""WITH w AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i, CAST(p_size % 4 AS DOUBLE) AS v FROM part),
 t AS (SELECT *, CASE WHEN lag(v) OVER (ORDER BY i) = v THEN 0 ELSE 1 END AS turn FROM w), r AS (SELECT *, sum(turn) OVER (ORDER BY i) AS run FROM t)
 SELECT CAST(min(i) * 5 + 99 AS BIGINT) AS start_, CAST(max(i) * 5 + 104 AS BIGINT) AS stop_, v AS value FROM r GROUP BY run, v""")
def wiggle_of_one_long_block(spark, sf_dir):
    """One block of one file, longer than a split: the header and the runs go on from split to split."""
    path = scratch(spark, "long-wiggle")
    head = spark.createDataFrame([(-1, "fixedStep chrom=chr1 start=100 step=5 span=5")], "k bigint, value string")
    body = v.table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS k", "CAST(p_size % 4 AS STRING) AS value")
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)  # one file, which is read in splits
    return signal.track_intervals(text.read_wiggle(spark, path)).select(F.col("start").alias("start_"), F.col("stop").alias("stop_"), "value")


@query("""WITH n AS (SELECT n_nationkey AS k, replace(n_name, ' ', '_') AS name, CAST(n_regionkey AS VARCHAR) AS r FROM nation),
 s AS (SELECT string_agg(name, chr(9) ORDER BY CASE WHEN k < 15 THEN 0 ELSE 1 END, k) AS names FROM n)
 SELECT '##fileformat=VCFv4.1' AS line UNION ALL SELECT '##FILTER=<ID=' || name || ',Description="' || r || '">' FROM n
 UNION ALL SELECT '##INFO=<ID=R' || r || ',Number=1,Type=Integer,Description="' || min(name) || '">' FROM n GROUP BY r
 UNION ALL SELECT array_to_string(['#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', names], chr(9)) FROM s""")
def vcf_headers_merged(spark, sf_dir):
    """Two headers with filters, fields and samples of overlapping halves of a table, as one."""
    n = [(r.k, r.name, r.r) for r in v.table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS INT) AS k", "replace(n_name, ' ', '_') AS name", "CAST(n_regionkey AS STRING) AS r").orderBy("k").collect()]
    least = {r: min(x[1] for x in n if x[2] == r) for r in {x[2] for x in n}}

    def half(rows, samples):
        meta = [f'##FILTER=<ID={name},Description="{r}">' for _, name, r in rows] + [f'##INFO=<ID=R{r},Number=1,Type=Integer,Description="{least[r]}">' for r in sorted({x[2] for x in rows})]
        cols = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]
        return vcf.Header.parse(["##fileformat=VCFv4.1", *meta, "\t".join(cols)])

    a, b = [x for x in n if x[0] < 15], [x for x in n if x[0] >= 8]
    merged = half(a, [x[1] for x in a]).merge(half(b, [x[1] for x in b]))
    return spark.createDataFrame([(x,) for x in merged.render()], "line string")


@query("SELECT unnest(['INFO/DB', 'INFO/DP', 'FORMAT/GT']) AS key WHERE (SELECT count(*) FROM part) > 0")
def vcf_undeclared_fields(spark, sf_dir):
    return vcf.undeclared(_records(spark, sf_dir), vcf.Header())


@query(f"SELECT pos, CAST(dp AS BIGINT) AS \"DP\", true AS \"DB\" FROM ({_RECORDS})")
def vcf_typed_info(spark, sf_dir):
    return vcf.typed_info(_records(spark, sf_dir), _header(), ["DP", "DB"]).select("pos", "DP", "DB")


@query(f"SELECT chrom, pos, 'DP' AS key, CASE WHEN qual % 7 = 0 THEN 'many' ELSE '1,2' END AS value FROM ({_RECORDS}) WHERE qual % 7 IN (0, 1)")
def vcf_ill_typed_info(spark, sf_dir):
    dp = F.when(F.col("qual") % 7 == 0, F.array(F.lit("many"))).when(F.col("qual") % 7 == 1, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1")))
    return vcf.ill_typed(_records(spark, sf_dir).withColumn("info", F.create_map(F.lit("DP"), dp)), _header())


@query(f"SELECT chrom, CAST(qual AS BIGINT) AS dp, gt FROM ({_RECORDS})")
def vcf_calls_in_long_form(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("samples", F.transform_values("samples", lambda k, c: F.map_concat(c, F.create_map(F.lit("DP"), F.get(F.element_at("info", "DP"), F.lit(0))))))
    return vcf.to_calls(rows).select("chrom", F.col("dp").cast("bigint").alias("dp"), "gt")


@query("SELECT CAST(o_orderkey AS VARCHAR) || chr(9) || o_orderstatus AS line FROM orders")
def sam_lines_written_and_read(spark, sf_dir):
    path = scratch(spark, "sam")
    v.table(spark, sf_dir, "orders").select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value")).write.text(path)
    return text.read_sam(spark, path).select("line")


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def report_written_and_read(spark, sf_dir):
    path = scratch(spark, "report")
    sinks.write_report(v.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("o_orderstatus string, n bigint").csv(path)


@query("SELECT * FROM (VALUES ('bed', 'bed'), ('empty', 'empty'), ('positions', 'positions'), ('unknown', 'unknown'), ('vcf', 'vcf')) t(made, found)")
def kinds_of_files(spark, sf_dir):
    made = {
        "bed": _bed(spark, sf_dir).select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string")).alias("value")), "empty": spark.createDataFrame([("# no data",)], "value string"),
        "positions": v.table(spark, sf_dir, "nation").select(F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string"), F.lit("x")).alias("value")),
        "unknown": v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "vcf": sinks.vcf_lines(_records(spark, sf_dir), _header()),
    }
    found = []
    for kind, lines in made.items():
        path = scratch(spark, kind)
        lines.coalesce(1).write.text(path)
        found.append((kind, text.kind_of(spark, path)))
    return spark.createDataFrame(found, "made string, found string")


# --- streams -----------------------------------------------------------------------------------------------


@query(f"""WITH a AS ({v.SQL_A}), b AS ({v.SQL_B}) SELECT 'pair' AS kind, a.chrom, a.orderkey AS a_id, a.start_ AS a_start, a.stop_ AS a_stop, b.orderkey AS b_id, b.start_ AS b_start, b.stop_ AS b_stop
 FROM a JOIN b ON a.chrom = b.chrom AND a.start_ < b.stop_ AND b.start_ < a.stop_""")
def overlap_of_two_streams(spark, sf_dir):
    """Both tables as streams of files in the order of their places, joined batch by batch with state that goes with the watermark."""
    rank, streams = F.expr("CAST(substr(chrom, 4) AS BIGINT)"), []
    for name, rows in (("a", v.interval_a(spark, sf_dir)), ("b", v.interval_b(spark, sf_dir))):
        rows = rows.select("chrom", "start", "stop", F.col("orderkey").alias("id"))
        path = scratch(spark, f"stream-{name}")
        for low, high in ((1, 5), (6, 11), (12, 17), (18, 22)):  # the source brings files in the order in which they were written
            rows.filter(rank.between(low, high)).repartitionByRange(2, rank, "start").write.mode("append").parquet(path)
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path))
    return stream_join.run_through(stream_join.interval_join(*streams, rank, width=1 << 18), scratch(spark, "stream-out"), scratch(spark, "stream-state"))


# --- command functions on rows in the form of their files ------------------------------------------------


def _extra(rows: DataFrame, *names: str) -> DataFrame:
    """Rows as read_bed gives them; the first further column is the alleles."""
    return rows.select("chrom", "start", "stop", F.array(F.concat_ws("/", "ref", "alt"), *[F.col(n).cast("string") for n in names]).alias("extra"))


_AB = f"WITH a AS ({v.SQL_PA}), b AS ({v.SQL_PB}) "
_MET = "a.chrom = b.chrom AND a.start_ < b.stop_ AND b.start_ < a.stop_"


@query(_AB + f"SELECT chrom || chr(9) || start_ || chr(9) || stop_ || chr(9) || ref || '/' || alt AS line FROM (SELECT DISTINCT a.chrom, a.start_, a.stop_, a.ref, a.alt FROM a JOIN b ON {_MET})")
def intersect_default(spark, sf_dir):
    a, b = _extra(v.point_a(spark, sf_dir)), _extra(v.point_b(spark, sf_dir))
    return commands.intersect(a, b)[0]


@query(_AB + f"""SELECT chrom || chr(9) || greatest(start_, b0) || chr(9) || least(stop_, b1) AS line FROM
 (SELECT a.chrom, a.start_, a.stop_, a.ref, a.alt, min(b.start_) AS b0, min(b.stop_) AS b1 FROM a JOIN b ON {_MET} GROUP BY ALL)""")
def intersect_format_i(spark, sf_dir):
    a, b = _extra(v.point_a(spark, sf_dir)), _extra(v.point_b(spark, sf_dir))
    return commands.intersect(a, b, commands.Intersect(format="I"))[0]


@query(_AB + f"SELECT a.chrom, a.start_, a.stop_, 'a' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_MET}) UNION ALL SELECT b.chrom, b.start_, b.stop_, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_MET})")
def intersect_misses(spark, sf_dir):
    _, miss_a, miss_b = commands.intersect(_extra(v.point_a(spark, sf_dir)), _extra(v.point_b(spark, sf_dir)))
    show = lambda df, side: df.select("chrom", F.col("start").alias("start_"), F.col("stop").alias("stop_"), F.lit(side).alias("side"))
    return show(miss_a, "a").unionByName(show(miss_b, "b"))


@query(f"""WITH c AS ({v.SQL_CALLS}), s AS (SELECT site, count_if(ft NOT IN ('', '.')) AS e, count_if(ft NOT IN ('', '.', 'PASS')) AS f FROM c GROUP BY site)
 SELECT site AS pos, CASE WHEN e > 0 AND f / e > 0.6 THEN CASE WHEN site % 2 = 0 THEN 'sf60' ELSE 'q10;sf60' END WHEN site % 2 = 0 THEN 'PASS' ELSE 'PASS;q10' END AS filters FROM s WHERE site % 5 <> 0""")
def site_filter_command(spark, sf_dir):
    """Sites of the calls as records; every fifth has no FT field."""
    c = v.calls(spark, sf_dir)
    call = F.struct(F.concat("sample", F.lit("_"), F.col("ord").cast("string")).alias("k"), F.create_map(F.lit("FT"), F.col("ft")).alias("v"))
    rows = c.groupBy("site").agg(F.map_from_entries(F.collect_list(call)).alias("samples")).select(
        F.col("site").alias("pos"), "samples", F.when(F.col("site") % 2 == 0, F.array(F.lit("PASS"))).otherwise(F.array(F.lit("q10"))).alias("filters"),
        F.when(F.col("site") % 5 == 0, F.array(F.lit("GT"))).otherwise(F.array(F.lit("GT"), F.lit("FT"))).alias("format"),
    )
    return commands.vcf_site_filter(rows, 0.6).select("pos", F.array_join("filters", ";").alias("filters"))


@query("SELECT CAST(p_partkey AS BIGINT) AS pos, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS kept FROM part WHERE p_size >= 10 AND p_size % 2 = 0")
def depth_filter_command(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("samples", F.create_map(F.lit("s1"), F.when(F.col("qual") % 2 == 0, F.create_map(F.lit("DP"), F.col("qual").cast("int").cast("string"))).otherwise(F.create_map(F.lit("DP"), F.lit(".")))))
    return commands.vcf_filter(rows, 10).select("pos", F.size("samples").alias("kept"))


@query(_AB + """SELECT chrom, start_, stop_, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), start_, stop_) AS place
 FROM (SELECT chrom, start_, stop_ FROM b UNION ALL SELECT chrom, start_, start_ FROM b)""")
def sort_beds_and_positions(spark, sf_dir):
    """Each row's place in the parts that the sorted rows are written to, one after another."""
    b = v.point_b(spark, sf_dir).select("chrom", "start", "stop", F.lit(None).cast("string").alias("alleles"))
    out = commands.sort([b, b.withColumn("stop", F.col("start"))])
    path = scratch(spark, "sorted")
    out.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string")).alias("value")).write.text(path)
    f = F.split("value", "\t")
    number = lambda i: F.get(f, F.lit(i)).cast("bigint")
    return _placed(lines.numbered(spark, path)).select(F.get(f, F.lit(0)).alias("chrom"), number(1).alias("start_"), number(2).alias("stop_"), "place")
