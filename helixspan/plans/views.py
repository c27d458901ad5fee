"""Interval, allele, call and sequence shapes of the star-schema tables, in Spark and as SQL text.

The SQL texts state the same shapes for the oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHROM = "concat('chr', CAST({} % 22 + 1 AS STRING))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interval_a(spark, sf_dir, start: str = "(l_orderkey * 37 + l_linenumber * 11) % 1000000", zero: bool = False) -> DataFrame:
    width = "CAST(l_quantity AS BIGINT)"
    width = f"CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE {width} END" if zero else width
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{CHROM.format('l_suppkey')} AS chrom", f"{start} AS start", f"{start} + {width} AS stop", "l_orderkey AS orderkey", "l_linenumber AS line",
        "substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS ref", "substr('ACGT', CAST((l_partkey + 1 + l_linenumber % 3) % 4 + 1 AS INT), 1) AS alt",
        "l_returnflag AS flag",
    )


def interval_a0(spark, sf_dir) -> DataFrame:
    return interval_a(spark, sf_dir, "(l_orderkey * 53) % 1000000", True)


def interval_b(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"{CHROM.format('o_custkey')} AS chrom", "(o_orderkey * 53) % 1000000 AS start",
        "(o_orderkey * 53) % 1000000 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS stop", "o_orderkey AS orderkey",
        "substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS ref", "substr('ACGTMRWSYKVHDBN', CAST(o_custkey % 15 + 1 AS INT), 1) AS alt",
    )


def _sql_a(start: str, width: str) -> str:
    return f"""SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, {start} AS start_, {start} + {width} AS stop_, l_orderkey AS orderkey, l_linenumber AS line,
  substr('ACGT', l_partkey % 4 + 1, 1) AS ref, substr('ACGT', (l_partkey + 1 + l_linenumber % 3) % 4 + 1, 1) AS alt, l_returnflag AS flag FROM lineitem"""


SQL_A = _sql_a("(l_orderkey * 37 + l_linenumber * 11) % 1000000", "CAST(l_quantity AS BIGINT)")
SQL_A0 = _sql_a("(l_orderkey * 53) % 1000000", "CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END")
SQL_B = """SELECT 'chr' || (o_custkey % 22 + 1) AS chrom, (o_orderkey * 53) % 1000000 AS start_, (o_orderkey * 53) % 1000000 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS stop_,
  o_orderkey AS orderkey, substr('ACGT', o_orderkey % 4 + 1, 1) AS ref, substr('ACGTMRWSYKVHDBN', o_custkey % 15 + 1, 1) AS alt FROM orders"""


def point_a(spark, sf_dir) -> DataFrame:
    """Intervals on few places, so that positions and alleles meet."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{CHROM.format('l_suppkey')} AS chrom", "l_orderkey % 500 AS start", "l_orderkey % 500 + 1 AS stop", "l_orderkey AS orderkey", "l_linenumber AS line",
        "substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS ref", "substr('ACGT', CAST((l_partkey + 1 + l_linenumber % 3) % 4 + 1 AS INT), 1) AS alt",
    )


def point_b(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"{CHROM.format('o_custkey')} AS chrom", "o_orderkey % 500 AS start", "o_orderkey % 500 + 1 AS stop", "o_orderkey AS orderkey",
        "substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS ref", "substr('ACGTMRWSYKVHDBN', CAST(o_custkey % 15 + 1 AS INT), 1) AS alt",
    )


SQL_PA = """SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey % 500 AS start_, l_orderkey % 500 + 1 AS stop_, l_orderkey AS orderkey, l_linenumber AS line,
  substr('ACGT', l_partkey % 4 + 1, 1) AS ref, substr('ACGT', (l_partkey + 1 + l_linenumber % 3) % 4 + 1, 1) AS alt FROM lineitem"""
SQL_PB = """SELECT 'chr' || (o_custkey % 22 + 1) AS chrom, o_orderkey % 500 AS start_, o_orderkey % 500 + 1 AS stop_, o_orderkey AS orderkey,
  substr('ACGT', o_orderkey % 4 + 1, 1) AS ref, substr('ACGTMRWSYKVHDBN', o_custkey % 15 + 1, 1) AS alt FROM orders"""

_GT = "CASE CAST(floor(value) AS BIGINT) % 8 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' WHEN 3 THEN '1|0' WHEN 4 THEN './.' WHEN 5 THEN '0/.' WHEN 6 THEN '1/2' ELSE '.' END"
_FT = "CASE WHEN event_type = 'click' THEN 'LOWQ' WHEN event_type = 'view' THEN 'PASS' WHEN event_type = 'purchase' THEN 'OK' ELSE '.' END"
_DP = "CASE WHEN CAST(floor(value) AS BIGINT) % 11 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 40 END"


def calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id DIV 50 AS site", "event_id AS ord", "concat('s', CAST(user_id AS STRING)) AS sample", f"{_GT} AS gt", f"{_FT} AS ft", f"{_DP} AS dp",
        "CAST(event_id % 3 AS INT) AS source", "value",
    )


SQL_CALLS = f"SELECT event_id // 50 AS site, event_id AS ord, 's' || user_id AS sample, {_GT} AS gt, {_FT} AS ft, {_DP} AS dp, CAST(event_id % 3 AS INT) AS source, value FROM events"


def sites(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id DIV 50 AS site").distinct().selectExpr(
        "site", "substr('ACGT', CAST(site % 4 + 1 AS INT), 1) AS ref",
        "array(substr('ACGT', CAST((site + 1) % 4 + 1 AS INT), 1), substr('ACGT', CAST((site + 2 + site DIV 4 % 2) % 4 + 1 AS INT), 1)) AS alts",
        "map('DB', CASE WHEN site % 3 = 0 THEN array('1', NULL) WHEN site % 3 = 1 THEN array(NULL, '.') ELSE array('x') END) AS info",
    )


SQL_SITES = """SELECT DISTINCT event_id // 50 AS site, substr('ACGT', (event_id // 50) % 4 + 1, 1) AS ref,
  [substr('ACGT', (event_id // 50 + 1) % 4 + 1, 1), substr('ACGT', (event_id // 50 + 2 + (event_id // 50) // 4 % 2) % 4 + 1, 1)] AS alts FROM events"""


def sequences(spark, sf_dir) -> DataFrame:
    """The bases of each document's whole text."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq"))


SQL_SEQS = "SELECT 'd' || doc_id AS name, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents"


def raw_alleles(spark, sf_dir) -> DataFrame:
    """Untrimmed alleles with shared ends, from part attributes."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_partkey * 7 % 9000 + 10 AS pos",
        "concat(repeat('CA', CAST(p_size % 3 AS INT)), substr('ACGTTGCA', CAST(p_partkey % 5 + 1 AS INT), CAST(p_size % 4 + 1 AS INT)), repeat('G', CAST(p_partkey % 3 AS INT))) AS ref",
        "concat(repeat('CA', CAST(p_size % 3 AS INT)), substr('GATTACAC', CAST(p_partkey % 4 + 1 AS INT), CAST(p_partkey % 5 AS INT)), repeat('G', CAST(p_partkey % 3 AS INT))) AS alt",
    )


SQL_RAW = """SELECT p_partkey AS id, p_partkey * 7 % 9000 + 10 AS pos,
  concat(repeat('CA', CAST(p_size % 3 AS INT)), substr('ACGTTGCA', CAST(p_partkey % 5 + 1 AS INT), CAST(p_size % 4 + 1 AS INT)), repeat('G', CAST(p_partkey % 3 AS INT))) AS ref,
  concat(repeat('CA', CAST(p_size % 3 AS INT)), substr('GATTACAC', CAST(p_partkey % 4 + 1 AS INT), CAST(p_partkey % 5 AS INT)), repeat('G', CAST(p_partkey % 3 AS INT))) AS alt FROM part"""


def infos(spark, sf_dir) -> DataFrame:
    """Field values by group (order), source order (line number, then the row itself)."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 5000 AS grp", "l_orderkey * 100 + l_linenumber AS ord", "l_extendedprice AS ord2", "l_partkey AS ord3",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE array(CAST(l_partkey % 7 AS STRING), CAST(CAST(l_quantity AS BIGINT) % 5 AS STRING)) END AS v",
        "array(CAST(l_orderkey % 5000 % 9 AS STRING)) AS same", "CASE WHEN l_linenumber % 2 = 0 THEN array('p', 'q') ELSE array('q', 'p') END AS bag",
        "concat(substr('ABCD', CAST(l_partkey % 4 + 1 AS INT), 1), '/', substr('CDEF', CAST(l_suppkey % 4 + 1 AS INT), 1)) AS names", "CAST(l_partkey % 2 + 1 AS INT) AS num",
    )


SQL_INFOS = """SELECT l_orderkey % 5000 AS grp, l_orderkey * 100 + l_linenumber AS ord, l_extendedprice AS ord2, l_partkey AS ord3,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE [CAST(l_partkey % 7 AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR)] END AS v,
  CAST(l_orderkey % 5000 % 9 AS VARCHAR) AS same,
  substr('ABCD', l_partkey % 4 + 1, 1) AS n1, substr('CDEF', l_suppkey % 4 + 1, 1) AS n2, CAST(l_partkey % 2 + 1 AS INT) AS num FROM lineitem"""
