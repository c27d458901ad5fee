"""CIGAR texts: parsing, subsets and the composition of a contig's CIGAR with a read's."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OP = re.compile(r"(\d+)([MIDNSHP=X])")
IN_CONTIG = frozenset("MI=X")


def parse(text: str) -> list[tuple[int, str]]:
    ops = [(int(n), k) for n, k in _OP.findall(text)]
    if "".join(f"{n}{k}" for n, k in ops) != text:
        raise ValueError(f"bad CIGAR {text!r}")
    return joined(ops)


def joined(ops) -> list[tuple[int, str]]:
    """Neighbouring operations of one kind as one; empty ones fall away."""
    out: list[list] = []
    for n, k in ops:
        if n and out and out[-1][1] == k:
            out[-1][0] += n
        elif n:
            out.append([n, k])
    return [(n, k) for n, k in out]


def show(ops) -> str:
    return "".join(f"{n}{k}" for n, k in ops)


def length(ops) -> int:
    """Bases of the sequence the CIGAR describes."""
    return sum(n for n, k in ops if k in IN_CONTIG)


def structural(ops) -> list[tuple[int, str]]:
    return joined((n, "M" if k in "=X" else k) for n, k in ops)


def subset(ops, start: int, size: int) -> list[tuple[int, str]]:
    """The part that covers size bases from start on; deletions between them stay."""
    out, at = [], 0
    for n, k in ops:
        if size <= 0:
            break
        if k not in IN_CONTIG:
            if out:
                out.append((n, k))
            continue
        skip = min(n, max(0, start - at))
        at += skip
        take = min(n - skip, size)
        if take:
            out.append((take, k))
            at += take
            size -= take
    return joined(out)


def compose(contig: str, read: str, position: int) -> str:
    """CIGAR on the reference of a read that lies at position (from 1) of a contig.

    Matches follow the contig's own operations, deletions of the contig come along, mismatches
    and insertions of the read stay; a read with other operations can't be remapped.
    """
    inner = parse(read)
    left = subset(structural(parse(contig)), position - 1, length(inner))[::-1]
    out: list[tuple[int, str]] = []
    for n, k in inner:
        if k == "I":
            out.append((n, k))
            continue
        if k not in "M=X":
            raise ValueError(f"operation {k} can't be remapped")
        while n and left:
            m, x = left.pop()
            if x not in IN_CONTIG and k != "X":
                out.append((m, x))
                continue
            take = min(m, n)
            if m > take:
                left.append((m - take, x))
            out.append((take, "X" if k == "X" else x))
            n -= take
    return show(joined(out))


def remapped_lines(lines: Column) -> Column:
    """SAM lines with a ZR:Z:REMAP tag with their CIGAR composed and MD:Z: dropped; others as they are."""

    @F.pandas_udf("string")
    def remap(s):
        return s.map(lambda x: x if x is None else remap_line(x))

    tagged = F.contains(lines, F.lit("\tZR:Z:REMAP"))
    return F.when(tagged, remap(F.when(tagged, lines))).otherwise(lines)  # other lines aren't sent to Python


def remap_line(line: str) -> str:
    """The tag's value has the contig's CIGAR as its third part by `-`, and the read's place as the second by `,`."""
    tag = re.search(r"ZR:Z:(REMAP[^\t]*)", line)
    if tag is None:
        return line
    fields = [f for f in line.split("\t") if not f.startswith("MD:Z:")]
    contig, place = tag[1].split("-")[2].split(",")[0], int(tag[1].split(",")[1])
    fields[5] = compose(contig, fields[5], place)
    return "\t".join(fields)
