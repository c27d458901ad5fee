"""Natural ("version") order of names as a sortable text."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Digit runs padded to 20 places, so that text order is natural order: 1 < 2 < 10 < MT < X.

    Runs of more digits go after all shorter ones by a mark, and among themselves by their length; names with
    such runs are taken apart run by run. Names that differ only in leading zeros tie; add the name itself as a later sort key.
    """
    padded = F.regexp_replace(name, "([0-9]+)", "0" * 20 + "$1")
    short = F.regexp_replace(padded, "[0-9]*([0-9]{20})(?![0-9])", "$1")

    def run(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        n = F.length(digits)
        number = F.when(n <= 20, F.lpad(digits, 20, "0")).otherwise(F.concat(F.lit(":"), F.lpad(n.cast("string"), 10, "0"), digits))
        return F.when(x.rlike("^[0-9]"), number).otherwise(x)

    long = F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1), run), "")
    return F.when(name.rlike("[0-9]{21}"), long).otherwise(short)


def locus_order(chrom="chrom", start="start", stop="stop") -> list[Column]:
    return [natural_key(F.col(chrom)), F.col(chrom), F.col(start), F.col(stop)]
