"""Signal tracks: fixed-step blocks to intervals, equal neighbours as one."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import lines


def track_intervals(points: DataFrame, strip_prefix: bool = False, nonzero: bool = False) -> DataFrame:
    """(chrom, start, stop, value) from points (block, ord, chrom, start, step, span, value).

    start is the block's first position from 1. Where step equals span, equal consecutive
    values of a block become one interval; otherwise each value has its own. Points that carry their own
    place and split (as read_wiggle gives them) are compared inside their split, and over a border with the
    last point before it, so a block may be of any length; other blocks are a task's each.
    """
    if "at" not in points.columns:
        number = F.row_number().over(Window.partitionBy("block").orderBy("ord")) - 1
        points = points.withColumns({"at": F.col("start") - 1 + number * F.col("step"), "file": F.col("block"), "split": F.lit(0)})
    rows = points.withColumnRenamed("ord", "line")
    rows = lines.latest(rows, "_last", F.struct("block", "value"), own=False)
    goes_on = (F.col("step") == F.col("span")) & (F.col("_last.block") == F.col("block")) & F.col("_last.value").eqNullSafe(F.col("value"))
    rows = lines.running(rows, {"_run": F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)})
    out = rows.groupBy("file", "_run", "chrom", "value").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("span")).alias("stop"))
    if strip_prefix:
        out = out.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    if nonzero:
        out = out.filter(F.col("value") != 0)
    return out.select("chrom", "start", "stop", "value")
