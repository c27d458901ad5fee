"""Driver queries of the interval and variant operators, with the SQL that states their results."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as al
from ..functions import genotype as g
from ..functions import regions as rg
from ..functions.natkey import natural_key
from ..operators import annotate, calls, cigar, compare, contraction, info, islands, merging, overlap, reach, report, sequences, signal, sorting, sweep
from ..sources import text
from ..streaming import intervals as streams
from . import projection
from . import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_OVERLAP = "((a.start_ < b.stop_ AND b.start_ < a.stop_) OR (a.start_ = a.stop_ AND b.start_ = b.stop_ AND a.start_ = b.start_))"
_TOUCH = f"({_OVERLAP} OR ((a.start_ = a.stop_ OR b.start_ = b.stop_) AND a.start_ <= b.stop_ AND b.start_ <= a.stop_))"
_AB = f"WITH a AS ({v.SQL_A}), b AS ({v.SQL_B}) "
_A0B = f"WITH a AS ({v.SQL_A0}), b AS ({v.SQL_B}) "
_PAB = f"WITH a AS ({v.SQL_PA}), b AS ({v.SQL_PB}) "
_MASK = "instr('ACMGRSVTWYHKDBN', {})"
_NAT = "array_to_string(list_transform(regexp_extract_all({}, '([0-9]+|[^0-9]+)', 1), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ends(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_", "stop": "stop_"})


# --- interval joins ---------------------------------------------------------------------------


@query(_AB + f"""SELECT a.chrom, greatest(a.start_, b.start_) AS i_start, least(a.stop_, b.stop_) AS i_stop, a.start_ AS a_start, a.stop_ AS a_stop,
  b.start_ AS b_start, b.stop_ AS b_stop, a.orderkey AS a_orderkey, b.orderkey AS b_orderkey FROM a JOIN b ON a.chrom = b.chrom AND {_OVERLAP}""")
def overlap_join(spark, sf_dir):
    pairs = overlap.overlap_join(v.interval_a(spark, sf_dir).select("chrom", "start", "stop", "orderkey"), v.interval_b(spark, sf_dir).select("chrom", "start", "stop", "orderkey"), tiers=1)
    return overlap.with_intersection(pairs)


@query(_AB + f"""SELECT concat_ws('\t', a.chrom, greatest(a.start_, b.start_), least(a.stop_, b.stop_), a.chrom, a.start_, a.stop_, a.orderkey, b.start_, b.stop_) AS line
  FROM a JOIN b ON a.chrom = b.chrom AND {_OVERLAP}""")
def overlap_full_projection(spark, sf_dir):
    extra = F.array(F.col("orderkey").cast("string")).alias("extra")
    a, b = (f(spark, sf_dir).select("chrom", "start", "stop", extra) for f in (v.interval_a, v.interval_b))
    return overlap.overlap_join(a, b).select(projection.line("I A B1-2").alias("line"))


@query(_A0B + f"SELECT a.chrom, a.start_ AS a_start, a.stop_ AS a_stop, b.start_ AS b_start, b.stop_ AS b_stop FROM a JOIN b ON a.chrom = b.chrom AND {_TOUCH}")
def overlap_adjacent(spark, sf_dir):
    a, b = (f(spark, sf_dir).select("chrom", "start", "stop") for f in (v.interval_a0, v.interval_b))
    return overlap.overlap_join(a, b, adjacent=True)


@query(_A0B + f"SELECT a.chrom, a.start_ AS a_start, a.stop_ AS a_stop, b.start_ AS b_start, b.stop_ AS b_stop FROM a JOIN b ON a.chrom = b.chrom AND {_OVERLAP}")
def overlap_insertions(spark, sf_dir):
    a, b = (f(spark, sf_dir).select("chrom", "start", "stop") for f in (v.interval_a0, v.interval_b))
    return overlap.overlap_join(a, b, width=64)


@query(_PAB + "SELECT a.chrom, a.start_, a.stop_, a.orderkey AS a_orderkey, a.line AS a_line, b.orderkey AS b_orderkey FROM a JOIN b ON a.chrom = b.chrom AND a.start_ = b.start_ AND a.stop_ = b.stop_")
def exact_pos(spark, sf_dir):
    a, b = v.point_a(spark, sf_dir).drop("ref", "alt"), v.point_b(spark, sf_dir).drop("ref", "alt")
    return _ends(overlap.equal_join(a, b))


_KEYS = "a.chrom = b.chrom AND a.start_ = b.start_ AND a.stop_ = b.stop_"
_PAIR = "SELECT a.chrom, a.start_, a.stop_, a.orderkey AS a_orderkey, a.line AS a_line, b.orderkey AS b_orderkey FROM a JOIN b ON "


@query(_PAB + _PAIR + f"{_KEYS} AND a.ref = b.ref AND a.alt = b.alt")
def exact_allele(spark, sf_dir):
    return _ends(overlap.equal_join(v.point_a(spark, sf_dir), v.point_b(spark, sf_dir), ("chrom", "start", "stop", "ref", "alt"))).drop("ref", "alt")


@query(_PAB + _PAIR + f"{_KEYS} AND a.ref = b.ref AND ({_MASK.format('a.alt')} & {_MASK.format('b.alt')}) <> 0")
def iub_match(spark, sf_dir):
    out = overlap.equal_join_by(v.point_a(spark, sf_dir), v.point_b(spark, sf_dir), ("ref", "alt"), overlap.partial_allele_match())
    return _ends(out.drop("a_ref", "a_alt", "b_ref", "b_alt"))


_RC = "translate({}, 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN')"


def _either(r, a):
    m = lambda x: f"({_MASK.format('a.alt')} & {_MASK.format(x)}) <> 0"
    return f"(a.ref = {r} AND {m(a)}) OR (a.ref = {a} AND {m(r)})"


@query(_PAB + _PAIR + f"{_KEYS} AND ({_either('b.ref', 'b.alt')} OR {_either(_RC.format('b.ref'), _RC.format('b.alt'))})")
def revcomp_match(spark, sf_dir):
    out = overlap.equal_join_by(v.point_a(spark, sf_dir), v.point_b(spark, sf_dir), ("ref", "alt"), overlap.strand_agnostic_match(F.array("b_ref", "b_alt")))
    return _ends(out.drop("a_ref", "a_alt", "b_ref", "b_alt"))


def _a_and_b(spark, sf_dir):
    return tuple(f(spark, sf_dir).select("chrom", "start", "stop", "orderkey") for f in (v.interval_a, v.interval_b))


@query(_AB + f"SELECT a.chrom, a.start_, a.stop_, a.orderkey FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND {_OVERLAP})")
def overlap_semi(spark, sf_dir):
    return _ends(reach.semi(*_a_and_b(spark, sf_dir)))


@query(_AB + f"SELECT a.chrom, a.start_, a.stop_, a.orderkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND {_OVERLAP})")
def overlap_anti_a(spark, sf_dir):
    return _ends(reach.anti(*_a_and_b(spark, sf_dir)))


@query(_AB + f"SELECT b.chrom, b.start_, b.stop_, b.orderkey FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND {_OVERLAP})")
def overlap_anti_b(spark, sf_dir):
    a, b = _a_and_b(spark, sf_dir)
    return _ends(reach.anti(b, a))


@query(_AB + f"""SELECT a.chrom, a.start_, a.stop_, 'a' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND {_OVERLAP})
  UNION ALL SELECT b.chrom, b.start_, b.stop_, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND {_OVERLAP})""")
def symmetric_difference(spark, sf_dir):
    return _ends(reach.symmetric_difference(*_a_and_b(spark, sf_dir)))


_A0, _AT = "(l_orderkey * 53) % 3000", "CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END"


@query(f"""WITH a AS (SELECT 'chr' || (l_suppkey % 3 + 1) AS chrom, {_A0} AS start_, {_A0} + {_AT} AS stop_, l_orderkey AS orderkey, l_linenumber AS line FROM lineitem),
 b AS (SELECT 'chr' || (s_suppkey % 3 + 1) AS chrom, s_suppkey * 37 % 3000 AS start_, s_suppkey * 37 % 3000 + s_nationkey AS stop_ FROM supplier)
 SELECT a.*, CAST((SELECT count(*) FROM b WHERE a.chrom = b.chrom AND {_OVERLAP}) AS BIGINT) AS n FROM a""")
def overlap_partner_counts(spark, sf_dir):
    return _ends(reach.partner_counts(*_deep(spark, sf_dir)))


def _deep(spark, sf_dir):
    """Many rows on few places: empty ones among them, and far more than a bin's width can part."""
    a = v.table(spark, sf_dir, "lineitem").selectExpr("concat('chr', CAST(l_suppkey % 3 + 1 AS STRING)) AS chrom", f"{_A0} AS start", f"{_A0} + {_AT} AS stop", "l_orderkey AS orderkey", "l_linenumber AS line")
    b = v.table(spark, sf_dir, "supplier").selectExpr("concat('chr', CAST(s_suppkey % 3 + 1 AS STRING)) AS chrom", "CAST(s_suppkey AS BIGINT) * 37 % 3000 AS start", "CAST(s_suppkey AS BIGINT) * 37 % 3000 + s_nationkey AS stop")
    return a, b


@query(f"""WITH a AS (SELECT 'chr' || (l_suppkey % 3 + 1) AS chrom, {_A0} AS start_, {_A0} + {_AT} AS stop_, l_orderkey AS orderkey, l_linenumber AS line FROM lineitem),
 b AS (SELECT 'chr' || (s_suppkey % 3 + 1) AS chrom, s_suppkey * 37 % 3000 AS start_, s_suppkey * 37 % 3000 + s_nationkey AS stop_ FROM supplier)
 SELECT a.chrom, b.start_ AS b_start, CAST(count(*) AS BIGINT) AS n, CAST(sum(a.orderkey * 10 + a.line) AS BIGINT) AS keys, CAST(sum(least(a.stop_, b.stop_) - greatest(a.start_, b.start_)) AS BIGINT) AS shared
 FROM a JOIN b ON a.chrom = b.chrom AND {_OVERLAP} GROUP BY ALL""")
def sweep_join_of_deep_rows(spark, sf_dir):
    """Sums over all pairs. Rows of one place meet the same rows, so a row for each place goes through the join, with its number of rows and their sum."""
    a, b = _deep(spark, sf_dir)
    place = ["chrom", "start", "stop"]
    a = a.groupBy(*place).agg(F.count("*").alias("rows"), F.sum(F.col("orderkey") * 10 + F.col("line")).alias("keys"))
    b = b.groupBy(*place).agg(F.count("*").alias("rows"))
    pairs = overlap.with_intersection(sweep.sweep_join(a, b, room=1024)).withColumn("n", F.col("a_rows") * F.col("b_rows"))
    return pairs.groupBy("chrom", "b_start").agg(
        F.sum("n").alias("n"), F.sum(F.col("a_keys") * F.col("b_rows")).alias("keys"), F.sum((F.col("i_stop") - F.col("i_start")) * F.col("n")).alias("shared"))


@query(_AB + f"""SELECT a.chrom, a.start_, a.stop_, CAST(sum(greatest(0, least(a.stop_, b.stop_) - greatest(a.start_, b.start_))) AS BIGINT) AS covered,
  CAST(count_if(a.start_ <= b.start_ AND b.stop_ <= a.stop_) AS BIGINT) AS n_contained FROM a JOIN b ON a.chrom = b.chrom AND {_OVERLAP} GROUP BY ALL""")
def region_overlap(spark, sf_dir):
    pairs = overlap.overlap_join(*_a_and_b(spark, sf_dir), tiers=1)
    ends = [F.col(c) for c in ("a_start", "a_stop", "b_start", "b_stop")]
    return pairs.groupBy("chrom", F.col("a_start").alias("start_"), F.col("a_stop").alias("stop_")).agg(
        F.sum(rg.overlap_length(*ends)).alias("covered"), F.count_if(rg.contains(*ends)).alias("n_contained")
    )


# --- order, union, distinct -------------------------------------------------------------------


@query(f"SELECT p_brand, p_partkey, row_number() OVER (ORDER BY {_NAT.format('p_brand')}, p_brand, p_partkey) AS place FROM part")
def sort_natural(spark, sf_dir):
    # The place of every row in the one global order is the result, so one window holds them all.
    from pyspark.sql import Window

    w = Window.orderBy(natural_key(F.col("p_brand")), "p_brand", "p_partkey")
    return v.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"WITH a AS ({v.SQL_PA}) SELECT chrom, start_, stop_, ref || '/' || alt AS alleles, min(orderkey * 100 + line) AS first_ord FROM a GROUP BY ALL")
def sort_distinct(spark, sf_dir):
    a = v.point_a(spark, sf_dir).select("chrom", "start", "stop", F.concat_ws("/", "ref", "alt").alias("alleles"), (F.col("orderkey") * 100 + F.col("line")).alias("first_ord"))
    return _ends(sorting.distinct_loci(a, "alleles", ["first_ord"]))


@query(f"WITH a AS ({v.SQL_A}), b AS ({v.SQL_B}) SELECT 0 AS source, chrom, start_, stop_ FROM a UNION ALL SELECT 1, chrom, start_, stop_ FROM b")
def union_all_sources(spark, sf_dir):
    return _ends(sorting.sorted_union([f(spark, sf_dir).select("chrom", "start", "stop") for f in (v.interval_a, v.interval_b)]))


@query(f"""WITH a AS ({v.SQL_A}) SELECT chrom, start_, stop_, orderkey, line FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY stop_ - start_ DESC, start_, orderkey, line) AS r
  FROM (SELECT DISTINCT chrom, start_, stop_, orderkey, line FROM a)) WHERE r = 1""")
def top1_per_group(spark, sf_dir):
    a = v.interval_a(spark, sf_dir).select("chrom", "start", "stop", "orderkey", "line").distinct()
    return _ends(sorting.first_of(a, ["chrom"], [F.col("start") - F.col("stop"), "start", "orderkey", "line"]))


# --- islands --------------------------------------------------------------------------------------

_ISLES = """, p AS (SELECT *, max(stop_) OVER (PARTITION BY {keys} ORDER BY start_, stop_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {src}),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR {cut} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_, stop_ ROWS UNBOUNDED PRECEDING) AS isle FROM p) """


def _isles(cut: str, keys: str = "chrom", src: str = "a") -> str:
    return _ISLES.format(cut=cut, keys=keys, src=src)


@query(f"WITH a AS ({v.SQL_A})" + _isles("start_ >= far") + "SELECT chrom, CAST(isle AS BIGINT) AS isle, min(start_) AS start_, max(stop_) AS stop_, count(*) AS n FROM i GROUP BY chrom, isle")
def islands_by_overlap(spark, sf_dir):
    ids = islands.island_ids(v.interval_a(spark, sf_dir).select("chrom", "start", "stop"), name="isle")
    return _ends(ids.groupBy("chrom", "isle").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")))


def _merge_query(name: str, distance: int, names: bool = False, count: bool = False):
    cols = ", string_agg(DISTINCT flag, ';' ORDER BY flag) AS names" * names + ", count(*) AS n" * count
    sql = f"WITH a AS ({v.SQL_A})" + _isles(f"start_ - far > {distance}") + f"SELECT chrom, min(start_) AS start_, max(stop_) AS stop_{cols} FROM i GROUP BY chrom, isle"

    def run(spark, sf_dir):
        return _ends(islands.merged(v.interval_a(spark, sf_dir), distance, "flag" if names else None, count))

    run.__name__ = name
    query(sql)(run)


_merge_query("interval_merge_d0", 0)
_merge_query("interval_merge_d10", 10)
_merge_query("merge_count", 0, count=True)
_merge_query("merge_names", 5, names=True)


@query(f"""WITH a0 AS (SELECT DISTINCT chrom, start_, stop_, flag FROM ({v.SQL_A})), l AS (SELECT *, row_number() OVER w AS r, lag(flag) OVER w AS before FROM a0 WINDOW w AS (PARTITION BY chrom ORDER BY start_, stop_, flag)),
 a AS (SELECT *, sum(CASE WHEN r = 1 OR before <> flag THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_, stop_, flag ROWS UNBOUNDED PRECEDING) AS run FROM l)""" + _isles("start_ - far > 20", "chrom, run")
       + "SELECT chrom, min(start_) AS start_, max(stop_) AS stop_, min(flag) AS name, count(*) AS n FROM i GROUP BY chrom, run, isle")
def merge_same_name(spark, sf_dir):
    a = v.interval_a(spark, sf_dir).select("chrom", "start", "stop", "flag").distinct()
    return _ends(islands.merged(a, 20, count=True, same_name="flag"))


@query(f"WITH a AS ({v.SQL_A})" + _isles("start_ - far > 0") + "SELECT chrom, min(start_) AS start_, max(stop_) AS stop_ FROM i GROUP BY chrom, isle")
def merge_in_blocks(spark, sf_dir):
    return _ends(islands.merged(v.interval_a(spark, sf_dir).select("chrom", "start", "stop"), 0, block=1 << 14))


@query(f"WITH a AS ({v.SQL_A})" + _isles("start_ >= far") + """, n AS (SELECT count(*) AS n FROM i GROUP BY chrom, isle)
  SELECT count(*) AS bundles, max(n) AS largest, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd FROM n""")
def bundle_stats(spark, sf_dir):
    ids = islands.island_ids(v.interval_a(spark, sf_dir).select("chrom", "start", "stop"))
    s = islands.bundle_stats(ids.groupBy("chrom", "island").agg(F.count("*").alias("n")))
    return s.select("bundles", "largest", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
 s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM l)
 SELECT user_id, min(ts) AS start_, max(ts) + INTERVAL 30 MINUTE AS stop_, count(*) AS n FROM s GROUP BY user_id, s.n""")
def session_like(spark, sf_dir):
    return _ends(streams.sessions(v.table(spark, sf_dir, "events")))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start_, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop_, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return _ends(streams.windowed_counts(v.table(spark, sf_dir, "events")))


@query("""WITH l AS (SELECT user_id, event_id, CAST(floor(value / 50) AS BIGINT) AS level FROM events),
 t AS (SELECT *, CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END AS turn FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM t)
 SELECT user_id, CAST(run AS BIGINT) AS run, level, min(event_id) AS first_, max(event_id) AS last_, count(*) AS n FROM r GROUP BY user_id, run, level""")
def rle_signal(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "CAST(floor(value / 50) AS BIGINT) AS level")
    return islands.run_lengths(e, ["user_id"], ["event_id"], "level").withColumnsRenamed({"first": "first_", "last": "last_"})


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM events""")
def forward_fill(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", islands.carried(F.when(F.col("event_type") == "view", F.col("event_id")), ["user_id"], ["event_id"]).alias("last_view"))


@query("""WITH p AS (SELECT 'u' || user_id AS chrom, 10 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS lo, CAST(floor(value / 50) AS DOUBLE) AS value, event_id FROM events),
 t AS (SELECT *, CASE WHEN lag(value) OVER w = value THEN 0 ELSE 1 END AS turn FROM p WINDOW w AS (PARTITION BY chrom ORDER BY event_id)),
 r AS (SELECT *, sum(turn) OVER (PARTITION BY chrom ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM t)
 SELECT chrom, min(lo) AS start_, max(lo) + 10 AS stop_, value FROM r WHERE value <> 0 GROUP BY chrom, run, value""")
def wiggle_intervals(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").selectExpr(
        "user_id AS block", "event_id AS ord", "concat('chru', CAST(user_id AS STRING)) AS chrom", "1L AS start", "10L AS step", "10L AS span", "CAST(floor(value / 50) AS DOUBLE) AS value"
    )
    return _ends(signal.track_intervals(e, strip_prefix=True, nonzero=True))


# --- sequences -------------------------------------------------------------------------------------

_CHARS = f"WITH s AS ({v.SQL_SEQS}), c AS (SELECT name, unnest(range(1, len(seq) + 1)) AS i, seq FROM s), b AS (SELECT name, i, substr(seq, i, 1) AS base FROM c)"


@query(_CHARS + """, r AS (SELECT *, i - row_number() OVER (PARTITION BY name, base ORDER BY i) AS run FROM b)
 SELECT name, min(i) - 1 AS start_, max(i) AS stop_, base FROM r GROUP BY name, base, run HAVING count(*) >= 3""")
def homopolymer_runs(spark, sf_dir):
    return _ends(sequences.homopolymers(v.sequences(spark, sf_dir), 3))


_REGIONS = "SELECT name AS chrom, CAST(1000 * k AS BIGINT) AS start_, CAST(1000 * k + 1000 AS BIGINT) AS stop_, seq FROM (SELECT *, unnest(range(0, (len(seq) + 999) // 1000)) AS k FROM s)"


def _regions(spark, sf_dir):
    """The whole of every sequence, in regions of 1000 bases."""
    return v.sequences(spark, sf_dir).filter("seq <> ''").selectExpr("name AS chrom", "explode(sequence(0, (length(seq) - 1) DIV 1000)) AS k").selectExpr(
        "chrom", "CAST(1000 * k AS BIGINT) AS start", "CAST(1000 * k + 1000 AS BIGINT) AS stop"
    )


@query(f"WITH s AS ({v.SQL_SEQS}), r AS ({_REGIONS})" + """, x AS (SELECT chrom, start_, least(stop_, len(seq)) AS stop_, substr(seq, start_ + 1, 1000) AS w FROM r)
 SELECT chrom, start_, stop_, len(w) - len(regexp_replace(w, '[AT]', '', 'g')) AS at_bases, len(w) - len(regexp_replace(w, '[CG]', '', 'g')) AS cg_bases FROM x""")
def token_base_counts(spark, sf_dir):
    out = sequences.token_counts(_regions(spark, sf_dir), v.sequences(spark, sf_dir), ("a/t", "c/g"))
    return _ends(out.withColumnsRenamed({"a/t": "at_bases", "c/g": "cg_bases"}))


@query(f"""WITH s AS ({v.SQL_SEQS}), r AS (SELECT name AS chrom, CAST(0 AS BIGINT) AS start_, len(seq) AS stop_, seq FROM s)
 SELECT chrom, start_, stop_, len(seq) - len(replace(seq, 'CG', '')) AS pair_bases FROM r""")
def token_pair_counts(spark, sf_dir):
    seqs = v.sequences(spark, sf_dir)
    whole = seqs.select(F.col("name").alias("chrom"), F.lit(0).cast("bigint").alias("start"), F.length("seq").cast("bigint").alias("stop"))
    return _ends(sequences.token_counts(whole, seqs, ("cg",)).withColumnRenamed("cg", "pair_bases"))


_VARIANTS = "SELECT name AS chrom, CAST(5 AS BIGINT) AS start_, CAST(6 AS BIGINT) AS stop_, substr('ACGT', CAST(len(seq) % 4 + 1 AS INT), 1) AS ref, seq FROM s"


def _ref_alleles(spark, sf_dir):
    return v.sequences(spark, sf_dir).selectExpr("name AS chrom", "5L AS start", "6L AS stop", "substr('ACGT', CAST(length(seq) % 4 + 1 AS INT), 1) AS ref")


@query(f"""WITH s AS ({v.SQL_SEQS}), r AS (SELECT *, CAST(5 + 20 * k AS BIGINT) AS start_, substr('ACGT', CAST((len(seq) + k) % 4 + 1 AS INT), 1) AS ref FROM (SELECT *, unnest(range(0, len(seq) // 20 + 1)) AS k FROM s WHERE seq <> ''))
 SELECT name AS chrom, start_, start_ + 1 AS stop_, ref, substr(seq, start_ + 1, 1) AS found, CASE WHEN len(seq) < start_ + 1 THEN 'out of range' END AS error FROM r WHERE len(seq) < start_ + 1 OR substr(seq, start_ + 1, 1) <> ref""")
def char_mismatch(spark, sf_dir):
    """Every twentieth base of every sequence, and a place behind the end of some."""
    s = v.sequences(spark, sf_dir)
    places = s.filter("seq <> ''").selectExpr("name AS chrom", "length(seq) AS n", "explode(sequence(0, length(seq) DIV 20)) AS k")
    rows = places.selectExpr("chrom", "CAST(5 + 20 * k AS BIGINT) AS start", "CAST(6 + 20 * k AS BIGINT) AS stop", "substr('ACGT', CAST((n + k) % 4 + 1 AS INT), 1) AS ref")
    return _ends(sequences.reference_mismatches(rows, s))


@query(f"""WITH s AS ({v.SQL_SEQS}), r AS (SELECT *, CASE ref WHEN 'A' THEN 'CC' WHEN 'C' THEN 'G' ELSE 'A' END AS alt FROM ({_VARIANTS}) WHERE len(seq) >= 30),
 q AS (SELECT *, CASE WHEN ref = alt THEN 7 ELSE 6 END AS p, CASE WHEN ref = alt THEN '' ELSE ref END AS r1, CASE WHEN ref = alt THEN '' ELSE alt END AS a1 FROM r)
 SELECT chrom, chrom || '_6_0' AS name, CAST(1 AS BIGINT) AS start_, least(p + len(r1) - 1 + 10, len(seq)) AS stop_,
  CASE WHEN len(r1) < len(a1) THEN (p - 1 + len(r1)) || 'M' || (len(a1) - len(r1)) || 'I' || (least(p + len(r1) + 9, len(seq)) - p - len(r1) + 1) || 'M'
   ELSE (p - 1 + len(r1) + least(p + len(r1) + 9, len(seq)) - p - len(r1) + 1) || 'M' END AS cigar,
  substr(seq, 1, p - 1) || a1 || substr(seq, p + len(r1), least(p + len(r1) + 9, len(seq)) - p - len(r1) + 1) AS contig FROM q""")
def contig_substring(spark, sf_dir):
    seqs = v.sequences(spark, sf_dir).filter(F.length("seq") >= 30)
    alt = F.when(F.col("ref") == "A", "CC").when(F.col("ref") == "C", "G").otherwise("A")
    variants = _ref_alleles(spark, sf_dir).select("chrom", F.lit(6).cast("bigint").alias("pos"), F.col("chrom").alias("id"), "ref", F.array(alt).alias("alts"))
    return _ends(sequences.variant_contigs(variants, seqs, flank=10))


@query(f"""WITH s AS ({v.SQL_SEQS}), q AS (SELECT name, seq FROM s WHERE len(seq) >= 60)
 SELECT name AS transcript, name AS chrom, CAST(0 AS BIGINT) AS start_, CAST(45 AS BIGINT) AS stop_, '15M10N20M' AS cigar, substr(seq, 1, 15) || substr(seq, 26, 20) AS contig FROM q""")
def transcript_stitch(spark, sf_dir):
    seqs = v.sequences(spark, sf_dir).filter(F.length("seq") >= 60)
    parts = seqs.select("name", F.explode(F.array(F.struct(F.lit(5).alias("a"), F.lit(15).alias("b")), F.struct(F.lit(25).alias("a"), F.lit(40).alias("b")))).alias("x"))
    regions = parts.select(F.col("name").alias("transcript"), F.col("name").alias("chrom"), F.col("x.a").cast("bigint").alias("start"), F.col("x.b").cast("bigint").alias("stop"))
    return _ends(sequences.transcripts(regions, seqs, pad=5))


# --- alleles ----------------------------------------------------------------------------------------

_P = "coalesce(list_position(list_transform(range(1, greatest(length({a}), length({b}), 1) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)), true) - 1, length({a}))"
_TRIM = f"""WITH x AS ({v.SQL_RAW}), p AS (SELECT *, {_P.format(a='ref', b='alt')} AS p FROM x),
 q AS (SELECT id, pos + p AS pos, substr(ref, p + 1) AS ref, substr(alt, p + 1) AS alt FROM p),
 s AS (SELECT *, CASE WHEN ref = '' OR alt = '' THEN 0 ELSE {_P.format(a='reverse(ref)', b='reverse(alt)')} END AS s FROM q),
 t AS (SELECT id, pos, substr(ref, 1, length(ref) - s) AS ref, substr(alt, 1, length(alt) - s) AS alt FROM s)"""


def _trimmed(spark, sf_dir):
    return v.raw_alleles(spark, sf_dir).select("id", al.trimmed(F.col("pos"), F.col("ref"), F.col("alt")).alias("r")).select("id", "r.*")


@query(_TRIM + "SELECT id, pos, ref, alt FROM t")
def allele_trim(spark, sf_dir):
    return _trimmed(spark, sf_dir)


@query(_TRIM + "SELECT id, pos - 1 AS start_, pos - 1 + length(ref) AS stop_ FROM t")
def allele_region(spark, sf_dir):
    r = al.edited_region(F.struct("pos", "ref", "alt"))
    return _ends(_trimmed(spark, sf_dir).select("id", r.alias("r")).select("id", "r.*"))


@query(_TRIM + """SELECT id, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN ref = '' AND alt <> '' THEN 'INS' WHEN alt = '' AND ref <> '' THEN 'DEL' ELSE 'INVALID' END AS kind,
 CASE WHEN length(ref) = length(alt) THEN 'SUBSTITUTION' WHEN length(ref) < length(alt) THEN 'INSERTION' ELSE 'DELETION' END AS by_length, length(ref) <> length(alt) AND (ref = '' OR alt = '') AS simple FROM t""")
def variant_type(spark, sf_dir):
    r, a = F.col("ref"), F.col("alt")
    return _trimmed(spark, sf_dir).select("id", al.variant_type(r, a).alias("kind"), al.length_type(r, a).alias("by_length"), al.pure_indel(r, a).alias("simple"))


@query(f"SELECT id, reverse(translate(ref, 'ACGT', 'TGCA')) AS rc FROM ({v.SQL_RAW})")
def reverse_complement(spark, sf_dir):
    return v.raw_alleles(spark, sf_dir).select("id", al.reverse_complement(F.col("ref")).alias("rc"))


_SHIFT_IN = f"SELECT name AS chrom, CAST(len(seq) // 2 AS BIGINT) AS pos, substr(seq, len(seq) // 2, 1 + len(seq) % 3) AS ref, seq FROM ({v.SQL_SEQS}) WHERE len(seq) >= 8"


@query(f"""WITH x AS ({_SHIFT_IN}), y AS (SELECT *, reverse(substr(seq, 1, pos - 1)) AS l, length(ref) AS n FROM x),
 z AS (SELECT *, coalesce(list_position(list_transform(range(1, length(l) + 1), lambda i: substr(l, i, 1) <> substr(reverse(ref), CAST((i - 1) % n + 1 AS INT), 1)), true) - 1, length(l)) AS k FROM y)
 SELECT chrom, pos - k AS pos, right(ref, CAST(k % n AS INT)) || left(ref, CAST(n - k % n AS INT)) AS ref, '' AS alt, k AS shift FROM z""")
def left_shift(spark, sf_dir):
    seqs = v.sequences(spark, sf_dir).filter(F.length("seq") >= 8)
    gone = seqs.selectExpr("name AS chrom", "CAST(length(seq) DIV 2 AS BIGINT) AS pos", "substr(seq, CAST(length(seq) DIV 2 AS INT), CAST(1 + length(seq) % 3 AS INT)) AS ref", "'' AS alt")
    return sequences.left_aligned(gone, seqs)


# --- calls ---------------------------------------------------------------------------------------------

_C = f"WITH c AS ({v.SQL_CALLS}) "
_FILTERED = "(ft NOT IN ('', '.', 'PASS'))"


@query(_C + """SELECT ord, gt = '.' AS empty, contains(gt, '|') AS phased, gt = '0/.' AS part, gt IN ('.', './.') AS missing, gt <> '.' AS diploid,
 gt IN ('0/1', '1|0', '1/2') AS het, gt IN ('0/0', '1/1') AS hom, gt = '0/0' AS reference FROM c""")
def gt_predicates(spark, sf_dir):
    t = F.col("gt")
    names = {"empty": g.is_empty, "phased": g.is_phased, "part": g.is_partial, "missing": g.is_null, "diploid": g.is_diploid, "het": g.is_het, "hom": g.is_hom, "reference": g.is_reference}
    return v.calls(spark, sf_dir).select("ord", *[f(t).alias(n) for n, f in names.items()])


@query(_C + "SELECT ord, CASE WHEN dp >= 10 THEN gt END AS gt FROM c")
def depth_blank(spark, sf_dir):
    return calls.blank_low_depth(v.calls(spark, sf_dir), 10).select("ord", "gt")


@query(_C + f"SELECT ord, CASE WHEN NOT {_FILTERED} OR ft = 'OK' THEN gt END AS gt FROM c")
def filter_whitelist(spark, sf_dir):
    return calls.blank_filtered(v.calls(spark, sf_dir), ["OK"]).select("ord", "gt")


@query(_C + "SELECT DISTINCT site FROM c WHERE dp >= 35")
def depth_filter_sites(spark, sf_dir):
    return calls.drop_empty_sites(calls.blank_low_depth(v.calls(spark, sf_dir), 35), ["site"]).select("site").distinct()


@query(_C + f"""SELECT site, count(*) AS n_samples, CAST(count_if(gt <> '.') AS BIGINT) AS n_genotypes, CAST(count_if(ft NOT IN ('', '.')) AS BIGINT) AS n_evaluated, CAST(count_if({_FILTERED}) AS BIGINT) AS n_failed,
 CASE WHEN count_if({_FILTERED}) / count_if(ft NOT IN ('', '.')) > 0.6 THEN 'sf60' ELSE 'PASS' END AS filter FROM c GROUP BY site HAVING count_if(ft NOT IN ('', '.')) > 0""")
def site_filter(spark, sf_dir):
    return calls.site_filter(v.calls(spark, sf_dir), ["site"], 0.6)


_LIVE = f"gt NOT IN ('.', './.', '0/.') AND NOT {_FILTERED}"


@query(_C + f"SELECT site, gt AS genotype, count(*) AS n FROM c WHERE {_LIVE} GROUP BY ALL")
def genotype_dist(spark, sf_dir):
    return report.genotype_distribution(v.calls(spark, sf_dir))


_ALLELES = f""", u AS (SELECT site, ord, sample, unnest(string_split_regex(gt, '[/|]')) AS al FROM c WHERE {_LIVE}),
 k AS (SELECT site, CAST(al AS INT) AS allele, count(*) AS copies, count(DISTINCT ord) AS samples FROM u GROUP BY ALL),
 m AS (SELECT site, CAST(sum(copies) AS BIGINT) AS total, min(copies) AS least, max(CASE WHEN allele = 0 THEN copies ELSE 0 END) AS refs, max(CASE WHEN samples = 1 THEN 1 ELSE 0 END) = 1 AS singleton FROM k GROUP BY site),
 f AS (SELECT site, total, CASE WHEN refs = 0 THEN 0.0 ELSE least / total END AS maf, singleton FROM m),
 w AS (SELECT *, CASE WHEN singleton THEN 'singleton' WHEN maf < 0.01 THEN 'very_rare' WHEN maf < 0.05 THEN 'rare' ELSE 'common' END AS rarity FROM f) """
_CA = _C.rstrip() + _ALLELES


@query(_CA + "SELECT site, allele, copies, samples FROM k")
def allele_counts(spark, sf_dir):
    return report.allele_counts(v.calls(spark, sf_dir))


@query(_CA + "SELECT site, total, round(CAST(maf AS DOUBLE), 9) AS maf, singleton, rarity FROM w")
def maf_and_rarity(spark, sf_dir):
    return report.site_summary(v.calls(spark, sf_dir)).withColumn("maf", F.round("maf", 9))


_CHANGES = f""", t AS ({v.SQL_SITES}), h AS (SELECT u.site, u.sample, t.ref, t.alts[CAST(u.al AS INT)] AS alt FROM u JOIN t ON u.site = t.site WHERE u.al <> '0'),
 z AS (SELECT site, sample, CASE WHEN ref IN ('G', 'T') THEN translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END AS change FROM h) """


@query(_CA.rstrip() + _CHANGES + "SELECT site, change, count(*) AS n FROM z GROUP BY ALL")
def spectrum(spark, sf_dir):
    return report.spectrum(v.calls(spark, sf_dir), v.sites(spark, sf_dir))


@query(_CA.rstrip() + _CHANGES + """SELECT sample, CAST(count_if(change IN ('A>G', 'C>T')) AS BIGINT) AS transitions, CAST(count_if(change NOT IN ('A>G', 'C>T')) AS BIGINT) AS transversions,
 round(CASE WHEN count_if(change NOT IN ('A>G', 'C>T')) > 0 THEN count_if(change IN ('A>G', 'C>T')) / count_if(change NOT IN ('A>G', 'C>T')) END, 9) AS ratio FROM z GROUP BY sample""")
def transition_ratio(spark, sf_dir):
    s = report.spectrum(v.calls(spark, sf_dir), v.sites(spark, sf_dir), ("sample",))
    return report.transitions_ratio(s, ("sample",)).withColumn("ratio", F.round("ratio", 9))


_SUMMARY = f"""SELECT c.sample, CAST(count_if({_LIVE}) AS BIGINT) AS n_calls, CAST(count_if({_FILTERED}) AS BIGINT) AS n_filtered,
 CAST(count_if(gt IN ('./.', '0/.') AND NOT {_FILTERED}) AS BIGINT) AS n_non_diploid, CAST(count_if({_LIVE} AND gt = '0/0') AS BIGINT) AS n_ref,
 CAST(count_if({_LIVE} AND gt IN ('0/1', '1|0', '1/2')) AS BIGINT) AS n_het, CAST(count_if({_LIVE} AND gt = '1/1') AS BIGINT) AS n_hom,
 CAST(count_if({_LIVE} AND gt <> '0/0' AND rarity = 'singleton') AS BIGINT) AS n_singleton, CAST(count_if({_LIVE} AND gt <> '0/0' AND rarity = 'very_rare') AS BIGINT) AS n_very_rare,
 CAST(count_if({_LIVE} AND gt <> '0/0' AND rarity = 'rare') AS BIGINT) AS n_rare, CAST(count_if({_LIVE} AND gt <> '0/0' AND rarity = 'common') AS BIGINT) AS n_common,
 CAST((SELECT count(DISTINCT site) FROM c) - count_if({_LIVE}) - count_if({_FILTERED}) AS BIGINT) AS n_missing
 FROM c LEFT JOIN w ON c.site = w.site GROUP BY c.sample"""


@query(_CA + _SUMMARY)
def sample_summary(spark, sf_dir):
    return report.sample_summary(v.calls(spark, sf_dir))


@query(_CA.rstrip() + f", s AS ({_SUMMARY}) SELECT round(avg(n_het), 6) AS n_het_mean, round(stddev_samp(n_het), 6) AS n_het_sd, round(avg(n_ref), 6) AS n_ref_mean, round(stddev_samp(n_ref), 6) AS n_ref_sd FROM s")
def set_metrics(spark, sf_dir):
    m = report.set_metrics(report.sample_summary(v.calls(spark, sf_dir)), ["n_het", "n_ref"])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("SELECT DISTINCT event_id // 50 AS site, CAST(a AS INT) AS allele, NOT ((event_id // 50) % 3 = 0 AND a = 1) AS novel FROM events, range(1, 3) t(a)")
def novel_known(spark, sf_dir):
    return report.novelty(v.sites(spark, sf_dir), ["DB"])


# --- field merging --------------------------------------------------------------------------------

_I = f"WITH x AS ({v.SQL_INFOS}) "
_ORDER = "ord, ord2, ord3"


def _merge_info(name: str, column: str, sql: str, show=lambda c: F.array_join(c, ",", "~")):
    def run(spark, sf_dir):
        rows = v.infos(spark, sf_dir)
        return rows.groupBy("grp").agg(show(info.merger(name)(F.col(column), [F.col(c) for c in ("ord", "ord2", "ord3")])).alias("merged"))

    run.__name__ = "info_" + name.replace("-", "_")
    query(sql)(run)


_merge_info("first", "v", _I + f"SELECT grp, array_to_string(arg_min_null(v, row(ord, ord2, ord3)), ',') AS merged FROM x GROUP BY grp")
_merge_info("earliest", "v", _I + "SELECT grp, array_to_string(arg_min(v, row(ord, ord2, ord3)) FILTER (WHERE v IS NOT NULL), ',') AS merged FROM x GROUP BY grp")
_merge_info("uniq-concat", "v", _I + """, e AS (SELECT grp, ord, ord2, ord3, unnest(v) AS w, generate_subscripts(v, 1) AS i FROM x WHERE v IS NOT NULL),
 f AS (SELECT grp, w, min(row(ord, ord2, ord3, i)) AS place FROM e GROUP BY grp, w), j AS (SELECT grp, string_agg(w, ',' ORDER BY place) AS merged FROM f GROUP BY grp)
 SELECT g.grp, coalesce(j.merged, '') AS merged FROM (SELECT DISTINCT grp FROM x) g LEFT JOIN j ON j.grp = g.grp""")
_merge_info("sum", "v", _I + """SELECT grp, coalesce(CAST(CAST(sum(CAST(v[1] AS DOUBLE)) AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(sum(CAST(v[2] AS DOUBLE)) AS DOUBLE) AS VARCHAR), '') AS merged FROM x GROUP BY grp""",
            lambda c: F.array_join(c.cast("array<string>"), ","))
_merge_info("enforce-equal", "same", _I + "SELECT grp, min(same) AS merged FROM x GROUP BY grp")
_merge_info("enforce-equal-unordered", "bag", _I + "SELECT grp, 'p,q' AS merged FROM x GROUP BY grp", lambda c: F.array_join(F.array_sort(c), ","))


@query(_I + """, e AS (SELECT grp, num, n1 AS w FROM x UNION SELECT grp, num, n2 FROM x)
 SELECT grp, num, string_agg(w, '/' ORDER BY w) AS merged FROM e GROUP BY grp, num""")
def info_per_alt_list(spark, sf_dir):
    rows = v.infos(spark, sf_dir)
    m = rows.groupBy("grp").agg(info.per_alt_delimited(F.array("names"), F.array("num"), F.col("num")).alias("m"))
    return m.select("grp", F.posexplode("m").alias("i", "merged")).filter("merged <> ''").select("grp", (F.col("i") + 1).alias("num"), "merged")


# --- sources and samples ----------------------------------------------------------------------------


@query(_C + "SELECT site, source, min(ord) AS ord FROM c GROUP BY site, source")
def first_per_source(spark, sf_dir):
    return calls.first_per_source(v.calls(spark, sf_dir), ["site"], ["ord"]).filter("kept").select("site", "source", "ord")


@query(_C + "SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY site, source ORDER BY ord) AS r FROM c) WHERE r > 1")
def rejects(spark, sf_dir):
    return calls.first_per_source(v.calls(spark, sf_dir), ["site"], ["ord"]).filter("not kept").select("ord")


@query(_C + f"SELECT site, ord, gt, ft FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_FILTERED}, ord) AS r FROM c) WHERE r = 1")
def sample_priority(spark, sf_dir):
    return calls.priority_pick(v.calls(spark, sf_dir).select("site", "ord", "gt", "ft"), ["site"], "unfiltered", "ord")


_CANON = "CASE WHEN contains(gt, '|') THEN gt WHEN gt IN ('./.') THEN '' WHEN gt = '0/.' THEN '0' WHEN gt = '0/0' THEN '0' WHEN gt = '1/1' THEN '1' ELSE gt END"


@query(_C + f""", d AS (SELECT site, ord AS source, sample, ft, CASE WHEN gt = '.' THEN NULL ELSE {_CANON} END AS k FROM c),
 p AS (SELECT *, first_value(k IGNORE NULLS) OVER (PARTITION BY site ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lead FROM d)
 SELECT site, CAST(count_if(coalesce(k = lead, false) AND NOT {_FILTERED}) AS BIGINT) AS agreeing, count(*) AS total, count_if(coalesce(k = lead, false) AND NOT {_FILTERED}) / count(*) >= 0.1 AS passes FROM p GROUP BY site""")
def consensus(spark, sf_dir):
    rows = v.calls(spark, sf_dir).drop("source").withColumnRenamed("ord", "source")
    return calls.consensus(rows, ["site"], 0.1)


@query(_C + """, m AS (SELECT site, sample, min(gt) AS gt FROM c WHERE sample IN ('s3', 's1', 's2') GROUP BY ALL)
 SELECT s.site, a.gt AS g1, b.gt AS g2, d.gt AS g3 FROM (SELECT DISTINCT site FROM c) s LEFT JOIN m a ON a.site = s.site AND a.sample = 's1'
 LEFT JOIN m b ON b.site = s.site AND b.sample = 's2' LEFT JOIN m d ON d.site = s.site AND d.sample = 's3'""")
def array_reheader(spark, sf_dir):
    one = v.calls(spark, sf_dir).groupBy("site", "sample").agg(F.min("gt").alias("gt"))
    rows = one.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("m"))
    r = rows.select("site", calls.reheadered(F.col("m"), ["s1", "s2", "s3"]).alias("r"))
    return r.select("site", *[F.get("r", F.lit(i)).alias(f"g{i + 1}") for i in range(3)])


@query(_C + "SELECT sample, count(*) AS n FROM (SELECT sample FROM c UNION ALL SELECT sample || '-dup' FROM c WHERE source = 1) GROUP BY sample")
def sample_mirror(spark, sf_dir):
    return calls.mirrored(v.calls(spark, sf_dir), 1, "-dup").groupBy("sample").agg(F.count("*").alias("n"))


@query(_C + "SELECT CASE sample WHEN 's1' THEN 'one' WHEN 's2' THEN 'two' ELSE sample END AS sample, count(*) AS n FROM c GROUP BY 1")
def sample_rename(spark, sf_dir):
    return calls.renamed(v.calls(spark, sf_dir), {"s1": "one", "s2": "two"}).groupBy("sample").agg(F.count("*").alias("n"))


@query(_C + "SELECT ord, translate(gt, '12', '31') AS gt FROM c")
def renumber_gt(spark, sf_dir):
    return v.calls(spark, sf_dir).select("ord", g.renumbered(F.col("gt"), F.array(F.lit(0), F.lit(3), F.lit(1))).alias("gt"))


@query(_C + "SELECT site, list_sort(list(DISTINCT ft)) AS filters, len(list_filter(list(DISTINCT ft), lambda x: x NOT IN ('PASS', '.', 'OK'))) > 0 AS filtered FROM c GROUP BY site")
def filter_sets(spark, sf_dir):
    s = v.calls(spark, sf_dir).groupBy("site").agg(F.array_sort(F.collect_set("ft")).alias("filters"))
    return s.withColumn("filtered", calls.is_site_filtered(F.col("filters"), ["OK"]))


# --- components, annotation, comparison ------------------------------------------------------------


def _records(spark, sf_dir):
    """Records on few places with 1 or 2 alternatives; ordinals are unique."""
    e = v.table(spark, sf_dir, "events").selectExpr(
        "CAST((event_id + event_id DIV 300) % 3 AS INT) AS source", "event_id AS ord", "concat('c', CAST(event_id % 5 AS STRING)) AS chrom", "event_id * 7 % 300 * 3 + 1 AS pos",
        "substr('ACGTAC', CAST(event_id * 7 % 300 % 4 + 1 AS INT), CAST(1 + user_id % 3 AS INT)) AS ref",
        "array(concat(substr('ACGTAC', CAST(event_id * 7 % 300 % 4 + 1 AS INT), 1), substr('TTG', CAST(user_id % 2 + 1 AS INT), 1))) AS alts",
    )
    return e


_RECORDS = """SELECT CAST((event_id + event_id // 300) % 3 AS INT) AS source, event_id AS ord, 'c' || (event_id % 5) AS chrom, event_id * 7 % 300 * 3 + 1 AS pos,
 substr('ACGTAC', event_id * 7 % 300 % 4 + 1, 1 + user_id % 3) AS ref, substr('ACGTAC', event_id * 7 % 300 % 4 + 1, 1) || substr('TTG', user_id % 2 + 1, 1) AS alt FROM events"""
_EDITS = f"""x AS ({_RECORDS}), p AS (SELECT *, {_P.format(a='ref', b='alt')} AS p FROM x), q AS (SELECT *, pos + p AS tp, substr(ref, p + 1) AS r1, substr(alt, p + 1) AS a1 FROM p),
 s AS (SELECT *, CASE WHEN r1 = '' OR a1 = '' THEN 0 ELSE {_P.format(a='reverse(r1)', b='reverse(a1)')} END AS s FROM q),
 t AS (SELECT source, ord, chrom, pos, ref, alt, tp, substr(r1, 1, length(r1) - s) AS tr, substr(a1, 1, length(a1) - s) AS ta FROM s)"""


@query(f"""WITH RECURSIVE {_EDITS}, o AS (SELECT *, pos - 1 AS start_, pos - 1 + length(ref) AS stop_ FROM t),
 f AS (SELECT *, max(stop_) OVER (PARTITION BY chrom ORDER BY start_, stop_, source, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM o),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR start_ >= far THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_, stop_, source, ord ROWS UNBOUNDED PRECEDING) AS isle FROM f)
 SELECT ord, min(ord) OVER (PARTITION BY chrom, isle, tp, length(tr)) AS component FROM i""")
def components(spark, sf_dir):
    return merging.with_components(_records(spark, sf_dir)).select("ord", "component")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS ord, l_orderkey // 400 * 1000 + l_partkey % 211 AS place FROM lineitem WHERE l_linenumber <= 2),
 l AS (SELECT ord, min(ord) OVER (PARTITION BY place) AS first FROM n), g AS (SELECT ord AS a, first AS b FROM l UNION SELECT first, ord FROM l),
 c(node, reach) AS (SELECT a, a FROM g UNION SELECT g.b, c.reach FROM c JOIN g ON g.a = c.node AND c.reach < g.b)
 SELECT node AS ord, min(reach) AS component FROM c GROUP BY node""")
def components_by_contraction(spark, sf_dir):
    """Orders that hang together over the places of their first lines."""
    e = v.table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").selectExpr("l_orderkey AS ord", "l_orderkey DIV 400 * 1000 + l_partkey % 211 AS place").distinct()
    links = e.join(e.groupBy("place").agg(F.min("ord").alias("first")), "place")
    found = contraction.components(links.select(F.col("ord").alias("a"), F.col("first").alias("b")))
    return e.select("ord").distinct().join(found.withColumnRenamed("node", "ord"), "ord", "left").select("ord", F.coalesce("component", "ord").alias("component"))


@query(f"""WITH {_EDITS}, m AS (SELECT a.ord AS a_id, b.ord AS b_id FROM t a JOIN t b ON a.chrom = b.chrom AND a.tp = b.tp AND a.tr = b.tr AND a.ta = b.ta WHERE a.source = 0 AND b.source = 1)
 SELECT a_id, min(b_id) AS b_id FROM m GROUP BY a_id""")
def annotate_best_match(spark, sf_dir):
    r = _records(spark, sf_dir)
    a = r.filter("source = 0").withColumn("a_id", F.col("ord"))
    b = r.filter("source = 1").withColumn("b_id", F.col("ord"))
    return annotate.best_matches(a, b).select("a_id", "b_id")


_RUNS = """SELECT 'c' || (o_custkey % 5) AS chrom, (o_orderkey * 53) % 900 AS start_, (o_orderkey * 53) % 900 + o_orderkey % 12 + 2 AS stop_, substr('ACGT', o_orderkey % 4 + 1, 1) AS base FROM orders"""


@query(f"""WITH {_EDITS}, h AS ({_RUNS}), j AS (SELECT t.ord, max(CASE WHEN length(tr) <> length(ta) AND (tr = '' OR ta = '') AND length(tr || ta) <= 2 AND tr || ta = repeat(base, length(tr || ta)) AND start_ <= tp - 1 AND tp - 1 <= stop_ THEN 1 ELSE 0 END) AS flag
 FROM t JOIN h ON t.chrom = h.chrom AND t.pos - 1 < h.stop_ AND h.start_ < t.pos - 1 + length(t.ref) GROUP BY t.ord) SELECT ord AS v_id, flag FROM j""")
def homopolymer_flag(spark, sf_dir):
    runs = v.table(spark, sf_dir, "orders").selectExpr(
        "concat('c', CAST(o_custkey % 5 AS STRING)) AS chrom", "(o_orderkey * 53) % 900 AS start", "(o_orderkey * 53) % 900 + o_orderkey % 12 + 2 AS stop", "substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS base"
    )
    out = annotate.homopolymer_flags(_records(spark, sf_dir).withColumn("v_id", F.col("ord")), runs)
    return out.select("v_id", F.get("flags", F.lit(0)).alias("flag"))


def _compared(spark, sf_dir):
    c = v.calls(spark, sf_dir).filter("gt not in ('.', '0/0')")
    alleles = F.transform(F.filter(g.indices(F.col("gt")), lambda x: x.isNull() | (x > 0)), lambda x: F.coalesce(x.cast("string"), F.lit("none")))
    return c.select(F.col("site").alias("bundle"), "source", F.col("ord").alias("record"), F.lit("s").alias("sample"), F.array_sort(alleles).alias("alleles"), F.col("gt").isin("./.", "0/.").alias("has_null"))


_CMP = _C + """, r AS (SELECT site, source, ord, CASE gt WHEN '0/1' THEN ['1'] WHEN '1|0' THEN ['1'] WHEN '1/1' THEN ['1', '1'] WHEN './.' THEN ['none', 'none'] WHEN '0/.' THEN ['none'] ELSE ['1', '2'] END AS al, gt IN ('./.', '0/.') AS nul FROM c WHERE gt NOT IN ('.', '0/0')),
 u AS (SELECT DISTINCT site, source, ord, unnest(al) AS a FROM r), p AS (SELECT site, a, bit_or(CAST(1 AS BIGINT) << source) AS mask, count(*) AS n FROM u GROUP BY site, a),
 e AS (SELECT site, al, bit_or(CAST(1 AS BIGINT) << source) AS mask FROM r WHERE NOT nul GROUP BY site, al),
 h AS (SELECT u.ord, max(CASE WHEN p.n > 1 THEN 1 ELSE 0 END) AS hit FROM u JOIN p ON p.site = u.site AND p.a = u.a GROUP BY u.ord),
 l AS (SELECT CASE WHEN h.hit = 1 THEN 'partial_miss' ELSE 'complete_miss' END AS kind, p.mask FROM u JOIN p ON p.site = u.site AND p.a = u.a AND p.n = 1 JOIN h ON h.ord = u.ord),
 k AS (SELECT 'partial_match' AS kind, mask FROM p UNION ALL SELECT 'exact_match', mask FROM e UNION ALL SELECT kind, mask FROM l) """


@query(_CMP + "SELECT kind, mask, 's' AS sample, count(*) AS n FROM k GROUP BY kind, mask")
def match_mask_counts(spark, sf_dir):
    return compare.mask_counts(_compared(spark, sf_dir))


@query(_CMP + """, g AS (SELECT CAST(m AS BIGINT) AS mask, kind FROM range(1, 8) t(m), (SELECT unnest(['exact_match', 'partial_match', 'partial_miss', 'complete_miss']) AS kind))
 SELECT g.mask, g.kind, count(k.kind) AS s, lpad(bin(g.mask), 3, '0') AS files FROM g LEFT JOIN k ON k.mask = g.mask AND k.kind = g.kind GROUP BY g.mask, g.kind""")
def match_dense_table(spark, sf_dir):
    return compare.dense_table(compare.mask_counts(_compared(spark, sf_dir)), 3, ["s"])


_FILES = 150
_MANY = f"""WITH c AS ({v.SQL_CALLS}), r AS (SELECT site, ord % {_FILES} AS f, gt FROM c WHERE gt NOT IN ('.', '0/0', './.', '0/.')),
 u AS (SELECT DISTINCT site, f, CASE gt WHEN '0/1' THEN '1' WHEN '1|0' THEN '1' WHEN '1/1' THEN '1' ELSE '12' END AS a FROM r),
 w AS (SELECT site, unnest(CASE a WHEN '1' THEN ['1'] ELSE ['1', '2'] END) AS allele, f FROM u),
 p AS (SELECT site, allele, list_sort(list(DISTINCT f)) AS fs FROM w GROUP BY ALL), k AS (SELECT fs, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY fs) """


def _many_files(spark, sf_dir):
    """The partial matches' counts of the calls, dealt out to so many files."""
    c = _compared(spark, sf_dir).filter("NOT has_null").withColumn("source", (F.col("record") % _FILES).cast("int"))
    return compare.mask_counts(c, compare.words_for(_FILES)).filter("kind = 'partial_match'")


@query(_MANY + f"SELECT array_to_string(list_transform(range({_FILES}), lambda i: CASE WHEN list_contains(fs, {_FILES} - 1 - i) THEN '1' ELSE '0' END), '') AS files, n AS s FROM k")
def match_masks_of_many_files(spark, sf_dir):
    return compare.sparse_table(_many_files(spark, sf_dir), _FILES, ["s"]).select("files", "s")


@query(_MANY + "SELECT list_sum(list_transform(a.fs, lambda i: (i + 1) * (i + 1))) AS files, a.n, CAST(sum(b.n) AS BIGINT) AS n_at_least FROM k a JOIN k b ON list_has_all(b.fs, a.fs) GROUP BY a.fs, a.n")
def match_counts_of_at_least_these_files(spark, sf_dir):
    """Masks shown as the sum of the squares of their files' numbers."""
    squares = F.aggregate(F.transform(compare.flags(F.col("mask"), _FILES), lambda x, i: x * (i + 1) * (i + 1)), F.lit(0), lambda a, x: a + x)
    return compare.at_least(_many_files(spark, sf_dir), _FILES).select(squares.cast("bigint").alias("files"), "n", "n_at_least")


@query("""WITH x AS (SELECT p_partkey AS id, p_partkey % 5 + 1 AS d, p_partkey % 30 + 1 AS k FROM part)
 SELECT id || chr(9) || '0' || chr(9) || 'ref' || chr(9) || '1' || chr(9) || '60' || chr(9) || CASE WHEN k <= 11 THEN '20M' ELSE (31 - k) || 'M' || d || 'D' || (k - 11) || 'M' END || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*'
  || chr(9) || 'ZR:Z:REMAP-ref|1|90-30M' || d || 'D30M,' || k AS line FROM x""")
def cigar_merge(spark, sf_dir):
    """Alignment lines whose tags place them on a contig with a deletion: the reads of 20 bases that cross it get it in their CIGAR."""
    lines = v.table(spark, sf_dir, "part").select(F.concat_ws(
        "\t", F.col("p_partkey").cast("string"), F.lit("0"), F.lit("ref"), F.lit("1"), F.lit("60"), F.lit("20M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"),
        F.format_string("ZR:Z:REMAP-ref|1|90-30M%dD30M,%d", F.col("p_partkey") % 5 + 1, F.col("p_partkey") % 30 + 1),
    ).alias("line"))
    return lines.select(cigar.remapped_lines(F.col("line")).alias("line"))


@query(f"""WITH RECURSIVE {_EDITS}, o AS (SELECT *, pos - 1 AS start_, pos - 1 + length(ref) AS stop_ FROM t),
 f AS (SELECT *, max(stop_) OVER (PARTITION BY chrom ORDER BY start_, stop_, source, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM o),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR start_ >= far THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_, stop_, source, ord ROWS UNBOUNDED PRECEDING) AS isle FROM f),
 c AS (SELECT *, min(ord) OVER (PARTITION BY chrom, isle, tp, length(tr)) AS component FROM i),
 k AS (SELECT *, row_number() OVER (PARTITION BY component, source ORDER BY pos, ord) AS place FROM c)
 SELECT chrom, first(pos ORDER BY pos, source, ord) AS pos, string_agg(ord, ',' ORDER BY pos, source, ord) AS merged, CAST(count(*) AS INT) AS n_samples, '' AS filters FROM k WHERE place = 1 GROUP BY chrom, component
 UNION ALL SELECT chrom, pos, CAST(ord AS VARCHAR), 1, 'REJECTED' FROM k WHERE place > 1""")
def record_merge(spark, sf_dir):
    """Records of three sources merged by component; those that a source repeats in a component are rejected."""
    e = F.array().cast("array<string>")
    r = _records(spark, sf_dir).withColumns({
        "ids": e, "qual": F.lit(None).cast("double"), "filters": e, "info": F.create_map(F.lit("N"), F.array(F.col("ord").cast("string"))),
        "format": F.array(F.lit("GT")), "samples": F.create_map(F.concat(F.lit("s"), F.col("source").cast("string")), F.create_map(F.lit("GT"), F.lit("0/1"))),
    })
    out = merging.merge_records(r, merging.Strategy(mergers={"N": "uniq-concat"}, reject_filter="REJECTED"))
    return out.select("chrom", "pos", F.array_join(F.element_at("info", "N"), ",").alias("merged"), F.size("samples").alias("n_samples"), F.array_join("filters", ";").alias("filters"))


@query("SELECT true AS fits, CAST(count(*) AS BIGINT) AS n FROM orders")
def random_intervals(spark, sf_dir):
    """What holds for as many random rows as a table has: their chromosomes, widths and alleles fit each other."""
    ref, alt = F.substring_index("alleles", "/", 1), F.substring_index("alleles", "/", -1)
    bases = lambda a: F.when(a == "*", 0).otherwise(F.length(a))
    fits = F.col("chrom").cast("int").between(1, 21) & (F.col("start") >= 0) & (F.col("stop") - F.col("start") == bases(ref)) & (ref != alt)
    return text.random_intervals(spark, v.table(spark, sf_dir, "orders").count(), 7).groupBy(fits.alias("fits")).agg(F.count("*").alias("n"))


# --- functions and operators beside those above --------------------------------------------------------

_PREFIX = "coalesce(list_position(list_transform(range(1, greatest(length({0}), length({1}), 1) + 1), lambda i: substr({0}, i, 1) <> substr({1}, i, 1)), true) - 1, length({0}))"


@query(f"SELECT id, least({_PREFIX.format('ref', 'alt')}, {_PREFIX.format('ref', 'other')}) AS n FROM (SELECT *, ref || 'T' AS other FROM ({v.SQL_RAW}))")
def prefix_of_all(spark, sf_dir):
    return v.raw_alleles(spark, sf_dir).select("id", al.common_prefix_of_all(F.array("ref", "alt", F.concat("ref", F.lit("T")))).alias("n"))


@query(f"""WITH x AS (SELECT *, {_PREFIX.format('ref', 'alt')} AS p FROM ({v.SQL_RAW})), y AS (SELECT id, pos, pos - 1 + p AS s,
 CASE WHEN length(alt) > length(ref) THEN pos - 1 + p + 1 WHEN length(alt) < length(ref) THEN pos - 1 + p + length(ref) ELSE pos - 1 + length(ref) END AS e, length(alt) > length(ref) AS longer FROM x)
 SELECT id, least(pos, CASE WHEN longer THEN s + 1 ELSE s END) AS start_, greatest(pos, e) AS stop_ FROM y""")
def indel_span(spark, sf_dir):
    span = al.indel_aware_span(F.col("pos"), F.col("ref"), F.array("alt"))
    return v.raw_alleles(spark, sf_dir).select("id", span["start"].alias("start_"), span["stop"].alias("stop_"))


@query(_C + "SELECT ord, NOT (gt IN ('0/0', '0/1', '1/1', '1|0', '0/.', '1/2')) AS apart FROM c")
def gt_disjoint(spark, sf_dir):
    return v.calls(spark, sf_dir).select("ord", g.disjoint(F.col("gt"), F.lit("0/1")).alias("apart"))


@query(_C + f"SELECT ord, {_FILTERED} AS filtered, NOT {_FILTERED} AS unfiltered, true AS either FROM c")
def filter_modes(spark, sf_dir):
    ft = F.col("ft")
    return v.calls(spark, sf_dir).select("ord", *[calls.filter_mode(ft, m).alias(n) for m, n in (("filtered", "filtered"), ("unfiltered", "unfiltered"), ("both", "either"))])


@query(_C + "SELECT ord, array_to_string(list_sort(list_distinct(list_filter([ft, 'q10'], lambda x: x <> 'PASS') || ['sf50'])), ';') AS filters FROM c")
def filter_added(spark, sf_dir):
    return v.calls(spark, sf_dir).select("ord", F.array_join(calls.add_filter(F.array("ft", F.lit("q10")), F.lit("sf50")), ";").alias("filters"))


@query(f"SELECT orderkey, line, start_ % 7 = 0 AS exact, {_TOUCH.replace('a.', '').replace('b.start_', 'b0').replace('b.stop_', 'b1')} AS near FROM (SELECT *, start_ + start_ % 7 AS b0, stop_ + start_ % 7 AS b1 FROM ({v.SQL_A0}))")
def mergeable_regions(spark, sf_dir):
    a = v.interval_a0(spark, sf_dir)
    by = F.col("start") % 7
    ends = [F.col("start"), F.col("stop"), F.col("start") + by, F.col("stop") + by]
    return a.select("orderkey", "line", rg.mergeable(*ends, exact=True).alias("exact"), rg.mergeable(*ends).alias("near"))


@query(f"SELECT name, start_, stop_, base FROM (SELECT name, unnest(regexp_extract_all(seq, '(A+|C+|G+|T+)', 1)) AS run, generate_subscripts(regexp_extract_all(seq, '(A+|C+|G+|T+)', 1), 1) AS i, seq FROM ({v.SQL_SEQS})) r, "
       "LATERAL (SELECT CAST(coalesce(length(array_to_string(list_slice(regexp_extract_all(seq, '(A+|C+|G+|T+)', 1), 1, i - 1), '')), 0) AS BIGINT) AS start_) s, LATERAL (SELECT start_ + length(run) AS stop_, substr(run, 1, 1) AS base) t "
       "WHERE length(run) >= 4 AND base IN ('A', 'T')")
def homopolymers_of_some_bases(spark, sf_dir):
    return _ends(sequences.homopolymers(v.sequences(spark, sf_dir), 4, "-AT"))


@query(f"""WITH s AS ({v.SQL_SEQS}), v AS (SELECT name, seq, CAST(len(seq) // 2 AS BIGINT) AS mid FROM s WHERE len(seq) >= 40)
 SELECT 'REMAP-' || name || '|' || (mid - 5) || '|' || (mid + 6) || '|5=1X5=|5|6|' || b AS name, substr(seq, mid - 4, 5) || b || substr(seq, mid + 2, 5) AS seq
 FROM v, (SELECT unnest(['A', 'G']) AS b) WHERE b <> substr(seq, mid + 1, 1)""")
def contigs_by_base(spark, sf_dir):
    s = v.sequences(spark, sf_dir).filter("length(seq) >= 40")
    rows = s.selectExpr("name AS chrom", "CAST(length(seq) DIV 2 AS BIGINT) AS start", "CAST(length(seq) DIV 2 + 1 AS BIGINT) AS stop", "substr(seq, CAST(length(seq) DIV 2 + 1 AS INT), 1) AS ref", "'R' AS alt")
    return sequences.base_contigs(rows, s, 5)


@query(f"WITH i AS ({v.SQL_INFOS}) SELECT grp, any_value(same) AS same, 'p,q' AS bag, true AS gone, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY grp")
def merged_by_named_ways(spark, sf_dir):
    rows = v.infos(spark, sf_dir).withColumn("bag", F.array_sort("bag"))
    out = info.merged_fields(rows, ["grp"], {"same": "enforce-equal", "bag": "enforce-equal-unordered", "v": "ignore"}, ["ord", "ord2", "ord3"])
    counts = rows.groupBy("grp").agg(F.count("*").alias("n"))
    return out.join(counts, "grp").select("grp", F.array_join("same", ",").alias("same"), F.array_join("bag", ",").alias("bag"), F.col("v").isNull().alias("gone"), "n")


@query(_AB.replace(v.SQL_A, v.SQL_A.replace("CAST(l_quantity AS BIGINT)", "(CASE WHEN l_orderkey % 97 = 0 THEN 5000 ELSE 1 END) * CAST(l_quantity AS BIGINT)")) + f"SELECT a.chrom, a.start_ AS a_start, a.stop_ AS a_stop, b.start_ AS b_start, b.stop_ AS b_stop FROM a JOIN b ON a.chrom = b.chrom AND {_OVERLAP}")
def overlap_long(spark, sf_dir):
    """Some intervals of a are so long that the join uses coarser tiers."""
    a, b = (f(spark, sf_dir) for f in (v.interval_a, v.interval_b))
    long = F.when(F.col("orderkey") % 97 == 0, 5000).otherwise(1) * (F.col("stop") - F.col("start"))
    return overlap.overlap_join(a.withColumn("stop", F.col("start") + long).select("chrom", "start", "stop"), b.select("chrom", "start", "stop"), tiers=2)


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_of_each_key(spark, sf_dir):
    return streams.latest_per_key(v.table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query(_AB + f"SELECT a.chrom, a.start_ AS a_start, a.stop_ AS a_stop, b.start_ AS b_start, b.stop_ AS b_stop FROM a JOIN b ON a.chrom = b.chrom AND {_OVERLAP}")
def overlap_of_a_stream(spark, sf_dir):
    a, b = (f(spark, sf_dir).select("chrom", "start", "stop") for f in (v.interval_a, v.interval_b))
    return streams.overlapping(a, b)


@query(f"WITH a AS ({v.SQL_PA}) SELECT orderkey, line, place FROM (SELECT orderkey, line, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), start_, stop_, orderkey, line) AS place FROM a) WHERE place <= 25")
def first_rows(spark, sf_dir):
    """The limit over the whole order: the first 25 loci of all."""
    from pyspark.sql import Window

    order = [natural_key(F.col("chrom")), F.col("start"), F.col("stop"), F.col("orderkey"), F.col("line")]
    rows = v.point_a(spark, sf_dir).orderBy(*order).limit(25)
    return rows.select("orderkey", "line", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS before, event_type FROM events) WHERE event_id < before")
def out_of_order(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), F.col("event_id").alias("start"), "user_id")
    return islands.unsorted_rows(e, ["user_id", "start"]).select("user_id", F.col("start").alias("event_id"))


from . import text_queries as _texts  # noqa: E402  (they use the same tables)

QUERIES.update(_texts.QUERIES)
ORACLES.update(_texts.ORACLES)

from . import command_queries as _commands  # noqa: E402

QUERIES.update(_commands.QUERIES)
ORACLES.update(_commands.ORACLES)
