"""Fill-in-middle examples: a text is cut at two seeded units and written with markers.

Units are runs of ASCII letters and single other code points, matched left to right over the
whole text by the regex library; only the end offset of each unit is kept, in a compact array,
so a text of any length costs a few bytes a unit and two lookups give the three slices. Seeds
are digests of the document's id, so that a repeated run, a lost task or another partitioning
gives the same examples.

Defined cases: a null text is the empty text, whose form is plain; a null doc_id has the empty
string in its seed's place; rows of one doc_id have one seed, and each its own text's slices;
texts with one of the markers stay plain, since they couldn't be taken apart again; an empty
table has no rows; columns of other names, or names that differ only by case, fall away.
"""
from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns

# The markers and units of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")

#: Examples written per 100 documents with a text, and those in the order suffix, prefix, middle per 100 of these.
FIM_SHARE, SPM_SHARE = 90, 20

EXAMPLE = "n bigint, form string, prefix string, middle string, suffix string, output string"
DIGEST = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """End offset of each unit, in code points."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in UNIT.finditer(text)))


def seeds(doc_id) -> tuple[int, ...]:
    """The first four 8-digit groups of the seed's hex digest, as unsigned integers."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def example(doc_id, text: str, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> tuple:
    """(units, form, prefix, middle, suffix, output); a plain form has no slices."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = seeds(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= fim_share:
        return n, "plain", None, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[second - 1] if second else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", prefix, middle, suffix, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", prefix, middle, suffix, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text again, from the output and its form alone.

    No marker overlaps itself or another one, and no slice holds one, so the first place at
    which a marker stands after the one before is where it was written.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} starts with {first}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _rows(batches: Iterator[tuple[pd.Series, pd.Series]], fim_share: int, spm_share: int, of) -> Iterator[pd.DataFrame]:
    """A frame of of(example) for each batch; a null id comes as NaN only where ids are floats, so they come as strings."""
    for ids, texts in batches:
        yield pd.DataFrame([of(example(i, t or "", fim_share, spm_share)) for i, t in zip(ids, texts)], columns=of.columns)


class _Whole:
    columns = ["n", "form", "prefix", "middle", "suffix", "output"]

    def __call__(self, e: tuple) -> tuple:
        return e


class _Digest:
    columns = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def __call__(self, e: tuple) -> tuple:
        n, form, prefix, middle, _, output = e
        sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
        return n, form, *sizes, _sha256(output), _sha256(restore(output, form))


def _mapped(docs: DataFrame, schema: str, of, fim_share: int, spm_share: int) -> DataFrame:
    @F.pandas_udf(schema)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for frame in _rows(batches, fim_share, spm_share, of):
            for c in ("n", "prefix_chars", "middle_chars"):
                if c in frame:
                    frame[c] = frame[c].astype("Int64")
            yield frame

    own = doc_columns(docs, "doc_id", "text")
    made = own.select("doc_id", cut(F.col("doc_id").cast("string"), F.col("text")).alias("e"))
    return made.select("doc_id", "e.*")


def examples(docs: DataFrame, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix and output of each row; narrow, without a shuffle."""
    return _mapped(docs, EXAMPLE, _Whole(), fim_share, spm_share)


def digests(docs: DataFrame, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """The examples as sizes and digests, and the digest of the text that each output gives back.

    The digests are taken where the example is made, so that no text is sent back to the JVM.
    """
    return _mapped(docs, DIGEST, _Digest(), fim_share, spm_share)
